"""Polygons, bit masks and rasters as array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32


def parse_polygons(df: DataFrame, text: str, mode: str = "reject") -> DataFrame:
    """Adds cls, points (array of x, y) and reason of a label line `class x1 y1 x2 y2 ...`.

    A bad line is left out (skip), raises an error (fail), or stays with its reason and null points (reject).
    """
    if mode not in ("skip", "fail", "reject"):
        raise ValueError(mode)
    out = df.withColumn("_p", F.array_remove(F.split(F.trim(text), r"\s+"), "")).withColumn("_n", F.transform("_p", lambda x: x.try_cast("double")))
    out = out.withColumn("reason", F.array_join(polygon_reasons("_p", "_n"), ";"))
    points = F.transform(F.sequence(F.lit(1), F.expr("(size(_n) - 1) div 2")), lambda k: F.struct(F.get("_n", (2 * k - 1).cast("int")).alias("x"), F.get("_n", (2 * k).cast("int")).alias("y")))
    good = F.col("reason") == ""
    out = out.withColumn("cls", F.when(good, F.get("_n", 0).cast("int"))).withColumn("points", F.when(good, points))
    if mode == "skip":
        out = out.where(good)
    if mode == "fail":
        out = out.withColumn("cls", F.when(good, F.col("cls")).otherwise(F.raise_error(F.concat(F.lit("bad polygon line: "), F.col("reason"))).cast("int")))
    return out.drop("_p", "_n")


def polygon_reasons(parts: str, numbers: str) -> Column:
    """Why a split label line is bad, sorted: empty, field_count, class, non_numeric, out_of_range."""
    coords = F.slice(numbers, 2, F.greatest(F.size(numbers), F.lit(1)))
    reasons = F.array(
        F.when(F.size(parts) == 0, "empty"),
        F.when((F.size(parts) > 0) & ((F.size(parts) < 7) | (F.size(parts) % 2 == 0)), "field_count"),
        F.when((F.size(parts) > 0) & (~F.coalesce(F.get(numbers, 0) >= 0, F.lit(False))), "class"),
        F.when(F.exists(coords, lambda x: x.isNull()), "non_numeric"),
        F.when(F.exists(coords, lambda x: (x < 0) | (x > 1)), "out_of_range"),
    )
    return F.array_sort(F.array_compact(reasons))


def polygon_area(points: str) -> Column:
    """Shoelace area of an array of (x, y)."""
    p = F.col(points)
    turned = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    cross = F.zip_with(p, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def polygon_bbox(points: str) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def largest_polygon(df: DataFrame, by: str, points: str, tie: str) -> DataFrame:
    """The polygon of greatest area of each record, the one with the smallest tie on equal areas."""
    best = F.min_by(F.struct(tie, points), F.struct((-polygon_area(points)).alias("a"), F.col(tie).alias("t")))
    return df.groupBy(by).agg(best.alias("_b")).select(by, f"_b.{tie}", f"_b.{points}")


def to_pixels(points: str, width: int, height: int) -> Column:
    """Rounded to pixels of a width x height raster and clipped to it; half goes to even."""
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.bround(v * (n - 1)).cast("int")))
    return F.transform(points, lambda p: F.struct(clip(p["x"], width).alias("x"), clip(p["y"], height).alias("y")))


def to_normalised(points: str, width: int, height: int) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] / F.lit(float(width))).alias("x"), (p["y"] / F.lit(float(height))).alias("y")))


def pack_bits(bits: Column, n: int) -> Column:
    """An array of n booleans as words of 32 bits, the first one lowest."""
    words = []
    for w in range(0, n, WORD):
        part = F.slice(bits, w + 1, min(WORD, n - w))
        shifted = F.transform(part, lambda b, i: F.when(b, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(shifted, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))
    return F.array(*words)


def unpack_bits(words: Column, n: int) -> Column:
    bit = lambda i: (F.get(words, F.floor(i / WORD).cast("int")).bitwiseAND(F.pow(F.lit(2.0), i % WORD).cast("long")) != 0)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), bit)


def mean_signature(values: Column, n: int) -> Column:
    """Words of the bits value > mean over the first n values; the mean is over all values."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return pack_bits(F.transform(F.slice(values, 1, n), lambda x: x > total / F.size(values)), n)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def mask_area(words: Column) -> Column:
    return F.aggregate(F.transform(words, lambda x: F.bit_count(x)), F.lit(0), lambda s, x: s + x)


def mask_iou(a: Column, b: Column, empty_value: float = 1.0) -> Column:
    """Intersection over union of two masks of words; empty_value where both are empty."""
    both = mask_area(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = mask_area(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(either == 0, F.lit(empty_value)).otherwise(both / either)


def mask_stats(df: DataFrame, words: str, width: int, height: int) -> DataFrame:
    """Adds area, coverage and the box of set bits (null for an empty mask) of row-major masks."""
    out = df.withColumn("_bits", unpack_bits(F.col(words), width * height))
    at = F.filter(F.transform("_bits", lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    out = out.withColumn("_at", at).drop("_bits")
    xs, ys = F.transform("_at", lambda i: i % width), F.transform("_at", lambda i: F.floor(i / width).cast("int"))
    box = {"box_x0": F.array_min(xs), "box_y0": F.array_min(ys), "box_x1": F.array_max(xs), "box_y1": F.array_max(ys)}
    return out.withColumns({"area": F.size("_at"), "coverage": F.size("_at") / F.lit(float(width * height)), **box}).drop("_at")


def mask_union(df: DataFrame, by: str, words: str) -> DataFrame:
    """Bitwise union of the masks of each group."""
    flat = df.select(by, F.posexplode(words).alias("pos", "word")).groupBy(by, "pos").agg(F.bit_or("word").alias("word"))
    return flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias(words))


def bundle_reasons(checks: dict[str, Column]) -> Column:
    """Sorted names of the checks that fail (false or null)."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))))


#: Names of what can be wrong with a rendered sample.
RENDERED_REASONS = (
    "image_decode_failed mask_decode_failed image_mask_size_mismatch mask_not_binary mask_empty polygon_not_utf8 polygon_empty "
    "polygon_invalid_field_count polygon_invalid_class polygon_non_numeric polygon_coordinate_out_of_range metadata_missing"
).split()


def rendered_reasons(image_size: tuple[Column, Column], mask_size: tuple[Column, Column], mask: Column, polygons: Column, metadata: Column, required: list[str]) -> Column:
    """Sorted reasons why a rendered sample is bad. A size (width, height) is null where decoding failed; if both decode, they must be
    equal, and the mask, an array, must hold only 0 and 255 and not only 0. polygons is the label, text or bytes: what that is not UTF-8
    counts as empty too, else the first bad line tells. The metadata, a map, must have the required keys."""
    image_size, mask_size = (F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("w"), h.alias("h"))) for w, h in (image_size, mask_size))
    valid = F.coalesce(F.is_valid_utf8(polygons.cast("string")), F.lit(False))
    text = F.when(valid, F.trim(F.regexp_replace(polygons.cast("string"), r"^\s+|\s+$", ""))).otherwise("")
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.array_remove(F.split(x, r"\s+"), ""))

    def line_reason(parts: Column) -> Column:
        numbers = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda v: v.try_cast("double"))
        return (
            F.when((F.size(parts) < 7) | (F.size(parts) % 2 == 0), "polygon_invalid_field_count").when(parts[0] != "0", "polygon_invalid_class")
            .when(F.exists(numbers, lambda v: v.isNull()), "polygon_non_numeric").when(F.exists(numbers, lambda v: (v < 0) | (v > 1)), "polygon_coordinate_out_of_range")
        )

    bad = F.filter(F.transform(lines, line_reason), lambda r: r.isNotNull())
    missing = F.array_except(F.array(*[F.lit(c) for c in sorted(required)]), F.coalesce(F.map_keys(metadata), F.array().cast("array<string>")))
    decoded = image_size.isNotNull() & mask_size.isNotNull()
    fails = lambda c: decoded & ~F.coalesce(c, F.lit(False))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.when(image_size.isNull(), "image_decode_failed"),
        F.when(mask_size.isNull(), "mask_decode_failed"),
        F.when(fails(image_size == mask_size), "image_mask_size_mismatch"),
        F.when(fails(F.forall(mask, lambda v: v.isin(0, 255))), "mask_not_binary"),
        F.when(fails(F.exists(mask, lambda v: v != 0)), "mask_empty"),
        F.when(polygons.isNotNull() & ~valid, "polygon_not_utf8"),
        F.when(text == "", "polygon_empty").otherwise(F.get(bad, F.lit(0))),
        F.when(F.size(missing) > 0, F.concat(F.lit("metadata_missing:"), F.array_join(missing, ","))),
    ))))


def _rasters(column: pd.Series, side: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64).reshape(-1, side, side)


def raster_moments(df: DataFrame, key: str, raster: str) -> DataFrame:
    """Mean and deviation of the values of each raster."""
    x = F.transform(raster, lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    out = df.select(key, x.alias("_x")).withColumn("mean", total(F.col("_x")) / F.size("_x"))
    apart = F.transform("_x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))
    return out.select(key, "mean", F.sqrt(total(apart) / F.size("_x")).alias("deviation"))


def _sobel(x: np.ndarray) -> np.ndarray:
    """Gradient magnitudes of rasters by the 3 x 3 Sobel operator, reflected at the border without its own cells."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    smooth = lambda a, axis: np.take(a, range(a.shape[axis] - 2), axis) + 2 * np.take(a, range(1, a.shape[axis] - 1), axis) + np.take(a, range(2, a.shape[axis]), axis)
    return np.hypot(smooth(p[:, :, 2:] - p[:, :, :-2], 1), smooth(p[:, 2:] - p[:, :-2], 2))


def raster_features(df: DataFrame, key: str, raster: str, side: int, low: float = 0.0, high: float = 256.0, edge: float = 28.0, apart: float = 55.0, mask: str | None = None) -> DataFrame:
    """Measures of square rasters: entropy of 64 bins over the fixed range low..high, share of cells with a Sobel gradient over
    `edge`, variance of the Laplacian, self_similarity = 1 - mean distance of the (mean, deviation) of 3 x 3 patches / `apart` (0 at
    least), and with a mask (booleans) contrast, the distance of its inner and outer mean (null where one is empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _rasters(b[raster], side)
            p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="reflect")
            lap = p[:, 1:-1, 2:] + p[:, 1:-1, :-2] + p[:, 2:, 1:-1] + p[:, :-2, 1:-1] - 4 * x
            bins = np.floor((x - low) / (high - low) * 64).astype(int).reshape(len(x), -1)
            counts = np.stack([np.bincount(r[(r >= 0) & (r < 64)], minlength=64) for r in bins])
            share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            cuts = [round(side * k / 3) for k in range(4)]
            cells = [x[:, r0:r1, c0:c1] for r0, r1 in zip(cuts, cuts[1:]) for c0, c1 in zip(cuts, cuts[1:]) if r1 > r0 and c1 > c0]
            v = np.stack([np.stack([c.mean((1, 2)), c.std((1, 2))], 1) for c in cells], 1)
            i, j = np.triu_indices(len(cells), 1)
            far = np.linalg.norm(v[:, i] - v[:, j], axis=2).mean(1) if len(i) else np.full(len(x), apart)
            out = {key: b[key], "entropy": -(share * np.log2(np.where(share > 0, share, 1))).sum(1), "edge_share": (_sobel(x) > edge).mean((1, 2)), "laplacian": lap.var((1, 2)), "self_similarity": np.clip(1 - far / apart, 0, 1)}
            if mask is not None:
                m = np.stack(b[mask].to_numpy()).astype(bool).reshape(x.shape)
                with np.errstate(invalid="ignore"):
                    means = [np.where(k.any((1, 2)), (x * k).sum((1, 2)) / np.maximum(1, k.sum((1, 2))), np.nan) for k in (m, ~m)]
                out["contrast"] = np.abs(means[0] - means[1])
            yield pd.DataFrame(out)

    made = "entropy double, edge_share double, laplacian double, self_similarity double" + ", contrast double" * (mask is not None)
    cols = [key, raster] + ([mask] if mask is not None else [])
    out = df.select(*cols).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {made}")
    return out if mask is None else out.withColumn("contrast", F.when(~F.isnan("contrast"), F.col("contrast")))


def radial_profile(df: DataFrame, population: str, raster: str, side: int, bins: int) -> DataFrame:
    """Mean log power of the spectrum by population and ring around the middle of the raster. Rings are open on the right: the
    farthest cells are in none; rings without cells are 0."""
    y, x = np.indices((side, side))
    far = np.hypot(x - (side - 1) / 2, y - (side - 1) / 2)
    ring = np.digitize(far, np.linspace(0, far.max(), bins + 1)) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            power = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(_rasters(b[raster], side)), axes=(1, 2))) ** 2)
            rows = [np.array([p[ring == k].mean() if (ring == k).any() else 0.0 for k in range(bins)]) for p in power]
            yield pd.DataFrame({population: b[population], "profile": [r.tolist() for r in rows]})

    kind = dict(df.dtypes)[population]
    rows = df.select(population, raster).mapInPandas(run, f"{population} {kind}, profile array<double>")
    return rows.select(population, F.posexplode("profile").alias("bin", "value")).groupBy(population, "bin").agg(F.avg("value").alias("power"), F.count("*").alias("n"))


def gradient_values(df: DataFrame, key: str, population: str, raster: str, side: int, mask: str | None = None) -> DataFrame:
    """(population, key, pos, value): Sobel gradient magnitudes of square rasters, at the cells of the mask (booleans) if there
    is one and it holds any, else at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            g = _sobel(_rasters(b[raster], side)).reshape(len(b), -1)
            keep = np.ones(g.shape, bool) if mask is None else np.stack(b[mask].to_numpy()).astype(bool).reshape(g.shape)
            keep[~keep.any(1)] = True
            at = [np.flatnonzero(k) for k in keep]
            yield pd.DataFrame({population: b[population], key: b[key], "at": [a.tolist() for a in at], "values": [r[a].tolist() for r, a in zip(g, at)]})

    types = dict(df.dtypes)
    cols = [key, population, raster] + ([mask] if mask is not None else [])
    made = df.select(*cols).mapInPandas(run, f"{population} {types[population]}, {key} {types[key]}, at array<int>, values array<double>")
    return made.select(population, key, F.explode(F.arrays_zip("at", "values")).alias("v")).select(population, key, F.col("v.at").alias("pos"), F.col("v.values").alias("value"))


def sample_values(df: DataFrame, population: str, key: list[str], most: int, seed: int) -> DataFrame:
    """`most` rows of each population at most, those with the least digests of seed and key."""
    from ..operators.windows import bottom_k

    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), 256)
    return bottom_k(df.withColumn("_d", digest), [population], "_d", key, most, "_r").drop("_d", "_r")


def density_histogram(df: DataFrame, population: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Share of each population's values per fixed-width bin; values outside go to the end bins."""
    width = (high - low) / bins
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / F.lit(width)))).cast("int")
    n = df.groupBy(population, b.alias("bin")).agg(F.count("*").alias("n"))
    total = n.groupBy(population).agg(F.sum("n").alias("total"))
    return n.join(total, population).select(population, "bin", "n", (F.col("n") / F.col("total") / F.lit(width)).alias("density"))
