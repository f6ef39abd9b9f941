"""Scalar column functions: names, hashes, scores, screening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Credential patterns of the content screen, by kind.
SCREEN_PATTERNS = {
    "github_token": r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{50,})",
    "openai_key": r"sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{35,}",
    "aws_access_id": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "slack_token": r"xox[baprs]-[0-9A-Za-z-]{20,}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
}
#: Extensions of files that the screen does not let through.
DENIED_EXTENSIONS = (".pt", ".pth", ".ckpt", ".safetensors", ".zip", ".7z", ".sqlite", ".db", ".pem", ".key", ".jpg", ".jpeg", ".webp", ".bmp", ".gif", ".npz", ".npy", ".mp4")


def stem(path: Column) -> Column:
    """Lower-case file name of a path or URL, without its last extension."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def is_safe_path(path: Column) -> Column:
    """True for a relative path with no drive, no `..` and no empty part."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return (F.length(path) > 0) & ~path.rlike("^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def is_sha256(col: Column) -> Column:
    return F.coalesce(col.rlike("^[0-9a-f]{64}$"), F.lit(False))


def classify(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    return reduce(lambda out, rule: F.when(rule[0], rule[1]).otherwise(out), reversed(rules), F.lit(default))


def saturating_score(parts: dict[str, tuple[float, float, bool]]) -> Column:
    """Weighted sum of min(1, column / cap), or 1 minus that; parts: column -> (cap, weight, invert)."""

    def one(name: str, cap: float, weight: float, invert: bool) -> Column:
        share = F.least(F.lit(1.0), F.col(name) / F.lit(cap))
        return F.lit(weight) * (F.lit(1.0) - share if invert else share)

    return reduce(lambda a, b: a + b, [one(k, *v) for k, v in parts.items()])


def difference_score(a: Column, b: Column, scale: float) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(a - b) / F.lit(scale))


def match_score(pairs: list[tuple[Column, Column, float, float]], penalty: Column | None = None) -> Column:
    """Sum of weight * difference_score over (a, b, scale, weight), less a penalty; 0 at least."""
    total = reduce(lambda x, y: x + y, [F.lit(w) * difference_score(a, b, s) for a, b, s, w in pairs])
    return F.greatest(F.lit(0.0), total - penalty) if penalty is not None else total


def artifact_penalty(jumps: list[tuple[Column, float, float]]) -> Column:
    """Weighted sum of jumps, each divided by its scale and clipped to 0..1."""
    return reduce(lambda x, y: x + y, [F.lit(w) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / F.lit(s))) for c, s, w in jumps])


def band_score(x: Column, low: float, high: float, soft: float) -> Column:
    """1 inside [low, high], falling to 0 over `soft` outside."""
    away = F.greatest(F.lit(low) - x, x - F.lit(high), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.lit(1.0) - away / F.lit(soft))


def margin_score(x: Column, y: Column, margin: float) -> Column:
    """How far a place in the unit square is from its border, as a share of the margin, 1 at most."""
    return F.least(F.lit(1.0), F.least(x, F.lit(1.0) - x, y, F.lit(1.0) - y) / F.lit(margin))


def scale_ratio(base: Column, factor: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), base * factor))


def with_policy(df: DataFrame, policy: dict[str, dict], key: str, default: dict) -> DataFrame:
    """Adds the columns of a policy table by key, with defaults for unknown keys. The table is part of the program, so
    its size is bounded and it becomes a literal map instead of a join."""
    for name, value in default.items():
        table = F.create_map(*[F.lit(x) for k, v in policy.items() for x in (k, v[name])])
        df = df.withColumn(name, F.coalesce(F.try_element_at(table, F.coalesce(F.col(key), F.lit(""))), F.lit(value)))
    return df


def hash_rank(*cols) -> Column:
    """SHA-256 of the values joined by |; nulls are left out."""
    return F.sha2(F.concat_ws("|", *[c if isinstance(c, Column) else F.lit(str(c)) for c in cols]), 256)


def hash_unit(digest: Column, offset: int = 0) -> Column:
    """A number of 0..1 from 8 hex digits of a digest."""
    return F.conv(F.substring(digest, offset + 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def task_score(iou: Column, confidence: Column) -> Column:
    """2 - iou - confidence where both lie in 0..1, else null."""
    sound = iou.between(0, 1) & confidence.between(0, 1) & ~F.isnan(iou) & ~F.isnan(confidence)
    return F.when(sound, F.lit(2.0) - iou - confidence)


def releasable(df: DataFrame, checks: list[str], hashes: list[tuple[str, str]]) -> DataFrame:
    """Rows whose checks are all true and whose hash columns agree in pairs; nulls never pass."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in checks])
    for a, b in hashes:
        ok &= F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return df.where(ok)


def screen_text(df: DataFrame, key: str, text: str, patterns: dict[str, str], most_chars: int | None = None, path: str | None = None, denied: tuple[str, ...] = DENIED_EXTENSIONS) -> DataFrame:
    """(key, reason): a row for each pattern that a text holds, for texts that are too long, and for paths (if a column is
    named) of a denied format: an extension in `denied`, or an environment file."""
    reasons = [F.when(F.col(text).rlike(p), F.lit(name)) for name, p in patterns.items()]
    if most_chars is not None:
        reasons.append(F.when(F.length(text) > most_chars, F.lit("too_long")))
    if path is not None:
        reasons.append(F.when(extension(F.col(path)).isin(*denied) | F.col(path).rlike(r"(^|[/\\])\.env(\.[^/\\]*)?$"), F.lit("denied_format")))
    return df.select(key, F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def extract_links(df: DataFrame, key: str, text: str, pattern: str = r'href="([^"]*)"') -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("link"))


def broken_links(links: DataFrame, known: DataFrame, url: str) -> DataFrame:
    return links.join(known.select(F.col(url).alias("link")).distinct(), "link", "left_anti")


def exclude_ids(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


def parse_detail(df: DataFrame, col: str, fields: dict[str, str]) -> DataFrame:
    """Adds typed columns from a JSON text column; fields: name -> type."""
    parsed = F.from_json(F.col(col), ", ".join(f"`{k}` {v}" for k, v in fields.items()))
    return df.withColumn("_detail", parsed).select("*", *[F.col(f"_detail.`{k}`").alias(k) for k in fields]).drop("_detail")
