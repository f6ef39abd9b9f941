"""Queries of scalar, polygon, mask and raster functions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import masks as M
from .base import FEATURES, Tables, doc_features, hash_sql, query


@query(r"""SELECT page_id, lower(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '')) AS stem,
       lower(regexp_extract(url, '(\.[^./\\]*)$', 1)) AS extension, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
       regexp_matches(url, '^[^:/\\]') AND NOT regexp_matches(url, '^[A-Za-z]:') AND NOT regexp_matches(url, '//') AND NOT regexp_matches(url, '(^|/)\.\.?(/|$)') AND NOT regexp_matches(url, '/$') AS safe FROM pages""")
def q_url_stem(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir).pages.select("page_id", C.stem(F.col("url")).alias("stem"), C.extension(F.col("url")).alias("extension"), C.slug(F.col("url")).alias("slug"), C.is_safe_path(F.col("url")).alias("safe"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'bright'
       WHEN o_totalprice > 150000 THEN 'mixed' ELSE 'dark' END AS environment FROM orders""")
def q_classify(spark, sf_dir) -> DataFrame:
    high = F.col("o_totalprice") > 300000
    rules = [(high & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "bright"), (F.col("o_totalprice") > 150000, "mixed")]
    return Tables(spark, sf_dir).orders.select("o_orderkey", C.classify(rules, "dark").alias("environment"))


@query(f"""SELECT doc_id, round(0.5 * least(1.0, n_words / 400.0) + 0.3 * (1 - least(1.0, variety / 0.8)) + 0.2 * least(1.0, digits / 0.05), 6) AS score FROM ({FEATURES})""")
def q_saturating_score(spark, sf_dir) -> DataFrame:
    parts = {"n_words": (400.0, 0.5, False), "variety": (0.8, 0.3, True), "digits": (0.05, 0.2, False)}
    return doc_features(Tables(spark, sf_dir)).select("doc_id", F.round(C.saturating_score(parts), 6).alias("score"))


MATCH = """SELECT l_orderkey, l_linenumber,
       0.4 * greatest(0.0, 1 - abs(l_extendedprice / l_quantity - p_retailprice) / 500.0) + 0.3 * greatest(0.0, 1 - abs(l_quantity - p_size) / 40.0)
       + 0.3 * greatest(0.0, 1 - abs(l_discount - l_tax) / 0.1) AS raw, least(1.0, greatest(0.0, l_discount / 0.1)) * 0.16 + least(1.0, greatest(0.0, l_tax / 0.08)) * 0.1 AS penalty
       FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _match(spark, sf_dir) -> tuple[DataFrame, list, object]:
    t = Tables(spark, sf_dir)
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size"), "l_partkey")
    pairs = [(F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice"), 500.0, 0.4), (F.col("l_quantity"), F.col("p_size"), 40.0, 0.3), (F.col("l_discount"), F.col("l_tax"), 0.1, 0.3)]
    return df, pairs, C.artifact_penalty([(F.col("l_discount"), 0.1, 0.16), (F.col("l_tax"), 0.08, 0.1)])


@query(f"SELECT l_orderkey, l_linenumber, round(greatest(0.0, raw - penalty), 9) AS score FROM ({MATCH})")
def q_match_score(spark, sf_dir) -> DataFrame:
    df, pairs, penalty = _match(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", F.round(C.match_score(pairs, penalty), 9).alias("score"))


@query(f"SELECT l_orderkey, l_linenumber, round(penalty, 9) AS penalty FROM ({MATCH})")
def q_artifact_penalty(spark, sf_dir) -> DataFrame:
    df, _, penalty = _match(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", F.round(penalty, 9).alias("penalty"))


@query("""WITH p AS (SELECT vec_id, least(1.0, greatest(0.0, (embedding[1]::DOUBLE + 3) / 6)) AS x, least(1.0, greatest(0.0, (embedding[2]::DOUBLE + 3) / 6)) AS y, label FROM embeddings)
       SELECT vec_id, round(greatest(0.0, 1 - greatest(0.3 - y, y - 0.7, 0.0) / 0.2), 6) AS band, round(least(1.0, least(x, 1 - x, y, 1 - y) / 0.25), 6) AS margin,
       round(least(0.3, greatest(0.02, x * CASE label WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0.1 END)), 6) AS scale FROM p""")
def q_position_scores(spark, sf_dir) -> DataFrame:
    place = lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.get("embedding", i).cast("double") + 3) / 6))
    df = Tables(spark, sf_dir).embeddings.select("vec_id", place(0).alias("x"), place(1).alias("y"), F.col("label").cast("string").alias("label"))
    df = C.with_policy(df, {"0": {"factor": 0.5}, "1": {"factor": 0.25}}, "label", {"factor": 0.1})
    x, y = F.col("x"), F.col("y")
    return df.select("vec_id", F.round(C.band_score(y, 0.3, 0.7, 0.2), 6).alias("band"), F.round(C.margin_score(x, y, 0.25), 6).alias("margin"), F.round(C.scale_ratio(x, F.col("factor"), 0.02, 0.3), 6).alias("scale"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.8 WHEN '3-MEDIUM' THEN 0.5 ELSE 0.2 END AS weight,
       CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS attempts FROM orders""")
def q_policy_join(spark, sf_dir) -> DataFrame:
    policy = {"1-URGENT": {"weight": 1.0, "attempts": 3}, "2-HIGH": {"weight": 0.8, "attempts": 2}, "3-MEDIUM": {"weight": 0.5, "attempts": 2}}
    return C.with_policy(Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority"), policy, "o_orderpriority", {"weight": 0.2, "attempts": 1}).drop("o_orderpriority")


@query(f"SELECT doc_id, {hash_sql(42, 'doc_id')} AS rank_digest FROM documents")
def q_hash_rank(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", C.hash_rank(42, F.col("doc_id")).alias("rank_digest"))


@query(f"SELECT doc_id, round(('0x' || substr({hash_sql(7, 'doc_id')}, 1, 8))::BIGINT / 4294967295.0, 9) AS unit FROM documents")
def q_hash_unit(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", F.round(C.hash_unit(C.hash_rank(7, F.col("doc_id"))), 9).alias("unit"))


def doc_signature(t: Tables) -> DataFrame:
    """(doc_id, sig): 128 buckets of word counts by the first two hex digits of md5 mod 128, a bit where over the mean."""
    words = F.transform(F.split("text", " "), lambda w: (F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % 128))
    rows = t.documents.select("doc_id", F.explode(words).alias("b")).groupBy("doc_id", "b").agg(F.count("*").alias("n"))
    mean = rows.withColumn("w", F.floor(F.col("b") / 32).cast("int")).join(rows.groupBy("doc_id").agg((F.sum("n") / 128).alias("mean")), "doc_id")
    bit = lambda w: F.coalesce(F.bit_or(F.when((F.col("w") == w) & (F.col("n") > F.col("mean")), F.expr("shiftleft(1L, b % 32)"))), F.lit(0)).cast("long")
    return mean.groupBy("doc_id").agg(F.array(*[bit(w) for w in range(4)]).alias("sig"))


SIGNATURE = """
    SELECT doc_id, [coalesce(bit_or(CASE WHEN b // 32 = 0 AND n > mean THEN 1::BIGINT << (b % 32) END), 0), coalesce(bit_or(CASE WHEN b // 32 = 1 AND n > mean THEN 1::BIGINT << (b % 32) END), 0),
           coalesce(bit_or(CASE WHEN b // 32 = 2 AND n > mean THEN 1::BIGINT << (b % 32) END), 0), coalesce(bit_or(CASE WHEN b // 32 = 3 AND n > mean THEN 1::BIGINT << (b % 32) END), 0)] AS sig
    FROM (SELECT doc_id, b, n, sum(n) OVER (PARTITION BY doc_id) / 128.0 AS mean FROM
          (SELECT doc_id, (('0x' || substr(md5(w), 1, 2))::INT % 128) AS b, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY ALL)) GROUP BY doc_id"""


@query(f"SELECT doc_id, sig[1] AS w0, sig[2] AS w1, sig[3] AS w2, sig[4] AS w3, (bit_count(sig[1]) + bit_count(sig[2]) + bit_count(sig[3]) + bit_count(sig[4]))::INT AS bits FROM ({SIGNATURE})")
def q_signature(spark, sf_dir) -> DataFrame:
    sig = doc_signature(Tables(spark, sf_dir))
    return sig.select("doc_id", *[F.get("sig", i).alias(f"w{i}") for i in range(4)], M.mask_area(F.col("sig")).alias("bits"))


@query("""SELECT vec_id, bit_or(CASE WHEN i < 32 AND x > mean THEN 1::BIGINT << i ELSE 0 END) AS w0, bit_or(CASE WHEN i >= 32 AND x > mean THEN 1::BIGINT << (i - 32) ELSE 0 END) AS w1
       FROM (SELECT vec_id, unnest(range(0, 64))::INT AS i, unnest(embedding)::DOUBLE AS x, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / len(embedding) AS mean FROM embeddings) GROUP BY vec_id""")
def q_mean_signature(spark, sf_dir) -> DataFrame:
    sig = M.mean_signature(F.transform("embedding", lambda x: x.cast("double")), 64)
    return Tables(spark, sf_dir).embeddings.select("vec_id", sig.alias("sig")).select("vec_id", F.get("sig", 0).alias("w0"), F.get("sig", 1).alias("w1"))


@query("""SELECT doc_id, CASE WHEN c BETWEEN 0 AND 1 THEN round(2 - v - c, 6) END AS task_score FROM
       (SELECT doc_id, least(1.0, n_words / 500.0) AS v, variety * 1.2 AS c FROM (""" + FEATURES + "))")
def q_task_score(spark, sf_dir) -> DataFrame:
    df = doc_features(Tables(spark, sf_dir)).select("doc_id", F.least(F.lit(1.0), F.col("n_words") / 500.0).alias("v"), (F.col("variety") * 1.2).alias("c"))
    return df.select("doc_id", F.round(C.task_score(F.col("v"), F.col("c")), 6).alias("task_score"))


@query("""SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND length(text) = n_chars""")
def q_releasable(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    df = t.documents.select("doc_id", F.length("text").cast("long").alias("measured"), "n_chars").join(t.labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("clean")), "doc_id")
    return C.releasable(df, ["good", "clean"], [("measured", "n_chars")]).select("doc_id")


PLANTED = C.SCREEN_PATTERNS | {"password": r"password=[0-9a-f]{8,}", "token": r'token = "[0-9a-f]{20,}"'}


@query("WITH s AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages) " + " UNION ALL ".join(f"SELECT source, id, '{k}' AS reason FROM s WHERE regexp_matches(text, '{p}')" for k, p in PLANTED.items()) + " UNION ALL SELECT source, id, 'too_long' FROM s WHERE length(text) > 20000" + f" UNION ALL SELECT 'pages', page_id, 'denied_format' FROM pages WHERE lower(regexp_extract(url, '(\\.[^./\\\\]*)$', 1)) IN {C.DENIED_EXTENSIONS}")
def q_secret_screen(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    both = t.documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("path")).union(t.pages.select(F.lit("pages"), "page_id", "html", "url"))
    out = C.screen_text(both.select(F.struct("source", "id").alias("k"), "text", "path"), "k", "text", PLANTED, 20000, "path")
    return out.select("k.source", "k.id", "reason")


@query("""SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = l.link)""")
def q_broken_links(spark, sf_dir) -> DataFrame:
    pages = Tables(spark, sf_dir).pages
    return C.broken_links(C.extract_links(pages, "page_id", "html"), pages, "url").select("page_id", "link")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_matches(c_name, '[13]$')")
def q_exclude_ids(spark, sf_dir) -> DataFrame:
    return C.exclude_ids(Tables(spark, sf_dir).customer.select("c_custkey", "c_name"), "c_name", "[13]$")


@query("""SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def q_event_props(spark, sf_dir) -> DataFrame:
    return C.parse_detail(Tables(spark, sf_dir).events.select("event_id", "event_type", "props"), "props", {"k": "bigint"}).drop("props")


def label_lines(t: Tables) -> DataFrame:
    """A label line for each vector: class, then the first ten numbers moved to about 0..1 with four decimals; some are bad."""
    number = lambda i: F.format_string("%.4f", F.round((F.get("embedding", i).cast("double") + 3) / 6, 4))
    line = F.concat_ws(" ", F.col("label").cast("string"), *[number(i) for i in range(10)])
    line = F.when(F.col("vec_id") % 17 == 0, F.lit("")).when(F.col("vec_id") % 13 == 0, F.concat(line, F.lit(" x"))).otherwise(line)
    return t.embeddings.select("vec_id", (F.col("vec_id") % 97).alias("record"), line.alias("line"))


LINES = """SELECT vec_id, vec_id % 97 AS record, CASE WHEN vec_id % 17 = 0 THEN '' WHEN vec_id % 13 = 0 THEN l || ' x' ELSE l END AS line FROM
    (SELECT vec_id, label::VARCHAR || ' ' || array_to_string(list_transform(embedding[1:10], lambda x: printf('%.4f', round((x::DOUBLE + 3) / 6, 4))), ' ') AS l FROM embeddings)"""
PARTS = f"""SELECT vec_id, record, p, list_transform(p, lambda x: TRY_CAST(x AS DOUBLE)) AS n FROM (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS p FROM ({LINES}))"""
REASONS = f"""SELECT *, array_to_string(list_sort(list_filter([CASE WHEN len(p) = 0 THEN 'empty' END, CASE WHEN len(p) > 0 AND (len(p) < 7 OR len(p) % 2 = 0) THEN 'field_count' END,
    CASE WHEN len(p) > 0 AND NOT coalesce(n[1] >= 0, false) THEN 'class' END, CASE WHEN len(list_filter(n[2:], lambda x: x IS NULL)) > 0 THEN 'non_numeric' END,
    CASE WHEN len(list_filter(n[2:], lambda x: x < 0 OR x > 1)) > 0 THEN 'out_of_range' END], lambda x: x IS NOT NULL)), ';') AS reason FROM ({PARTS})"""
POINTS = f"SELECT vec_id, record, list_transform(range(1, (len(n) + 1) // 2), lambda k: {{'x': n[2 * k], 'y': n[2 * k + 1]}}) AS points FROM ({REASONS}) WHERE reason = ''"


@query(f"SELECT vec_id, reason FROM ({REASONS})")
def q_polygon_reasons(spark, sf_dir) -> DataFrame:
    return M.parse_polygons(label_lines(Tables(spark, sf_dir)), "line", "reject").select("vec_id", "reason")


@query(f"""SELECT vec_id, k AS point, greatest(0, least(639, round_even(points[k].x * 639, 0)::INT)) AS px, greatest(0, least(479, round_even(points[k].y * 479, 0)::INT)) AS py,
       round(points[k].x / 640, 9) AS nx FROM (SELECT vec_id, points, unnest(range(1, len(points) + 1)) AS k FROM ({POINTS}))""")
def q_polygons(spark, sf_dir) -> DataFrame:
    df = M.parse_polygons(label_lines(Tables(spark, sf_dir)), "line", "skip")
    both = F.arrays_zip(M.to_pixels("points", 640, 480).alias("p"), M.to_normalised("points", 640, 480).alias("n"))
    flat = df.select("vec_id", F.posexplode(both).alias("k", "z"))
    return flat.select("vec_id", (F.col("k") + 1).cast("long").alias("point"), F.col("z.p.x").alias("px"), F.col("z.p.y").alias("py"), F.round("z.n.x", 9).alias("nx"))


AREA = f"""SELECT *, abs(list_sum(list_transform(range(1, len(points) + 1), lambda k: points[k].x * points[k % len(points) + 1].y - points[k % len(points) + 1].x * points[k].y))) / 2 AS area FROM ({POINTS})"""


@query(f"""SELECT record, vec_id, round(area, 6) AS area, round(list_min(list_transform(points, lambda p: p.x)), 6) AS x0, round(list_max(list_transform(points, lambda p: p.y)), 6) AS y1
       FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY area DESC, vec_id) AS r FROM ({AREA})) WHERE r = 1""")
def q_polygon_area(spark, sf_dir) -> DataFrame:
    df = M.parse_polygons(label_lines(Tables(spark, sf_dir)), "line", "skip")
    best = M.largest_polygon(df, "record", "points", "vec_id")
    return best.select("record", "vec_id", F.round(M.polygon_area("points"), 6).alias("area"), F.round(M.polygon_bbox("points")["x0"], 6).alias("x0"), F.round(M.polygon_bbox("points")["y1"], 6).alias("y1"))


def vector_masks(t: Tables) -> DataFrame:
    """(vec_id, label, words): an 8 x 8 mask of the positive numbers of each vector."""
    return t.embeddings.select("vec_id", "label", M.pack_bits(F.transform("embedding", lambda x: x > 0), 64).alias("words"))


BITS = "SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding) > 0 AS b FROM embeddings"


@query(f"""SELECT vec_id, count(*) FILTER (b) AS area, round(count(*) FILTER (b) / 64.0, 6) AS coverage, (min(i % 8) FILTER (b))::INT AS box_x0, (min(i // 8) FILTER (b))::INT AS box_y0,
       (max(i % 8) FILTER (b))::INT AS box_x1, (max(i // 8) FILTER (b))::INT AS box_y1 FROM ({BITS}) GROUP BY vec_id""")
def q_mask_stats(spark, sf_dir) -> DataFrame:
    df = M.mask_stats(vector_masks(Tables(spark, sf_dir)), "words", 8, 8)
    return df.select("vec_id", F.col("area").cast("long").alias("area"), F.round("coverage", 6).alias("coverage"), "box_x0", "box_y0", "box_x1", "box_y1")


@query(f"SELECT vec_id % 50 AS image, (i // 32)::INT AS pos, bit_or(CASE WHEN b THEN 1::BIGINT << (i % 32) ELSE 0 END) AS word FROM ({BITS}) GROUP BY ALL")
def q_mask_union(spark, sf_dir) -> DataFrame:
    df = vector_masks(Tables(spark, sf_dir)).withColumn("image", F.col("vec_id") % 50)
    return M.mask_union(df, "image", "words").select("image", F.posexplode("words").alias("pos", "word"))


def mask_pairs(t: Tables) -> DataFrame:
    """Targets are vectors whose id is divisible by 4; the three after each are its predictions."""
    m = vector_masks(t)
    target = m.where("vec_id % 4 = 0").select(F.col("vec_id").alias("target"), F.col("label"), F.col("words").alias("tw"))
    return target.join(m.where("vec_id % 4 <> 0").select((F.col("vec_id") - F.col("vec_id") % 4).alias("target"), F.col("vec_id").alias("pred"), F.col("words").alias("pw")), "target", "left")


IOU = f"""SELECT t.label, t.vec_id AS target, p.vec_id AS pred, count(*) FILTER (t.b AND p.b)::DOUBLE / count(*) FILTER (t.b OR p.b) AS iou
    FROM ({BITS}) t JOIN ({BITS}) p ON t.vec_id = p.vec_id - p.vec_id % 4 AND t.i = p.i AND p.vec_id % 4 <> 0 WHERE t.vec_id % 4 = 0 GROUP BY ALL"""


@query(f"SELECT target, pred, round(iou, 6) AS iou FROM ({IOU})")
def q_mask_iou(spark, sf_dir) -> DataFrame:
    df = mask_pairs(Tables(spark, sf_dir)).where("pred is not null")
    return df.select("target", "pred", F.round(M.mask_iou(F.col("tw"), F.col("pw")), 6).alias("iou"))


def best_match(df: DataFrame, target: str, iou, confidence, index: str) -> DataFrame:
    """Per target the prediction of greatest overlap, then confidence, then least index; 0, 0 and null where there is none."""
    best = F.min_by(F.struct(F.col(index), iou.alias("iou"), confidence.alias("confidence")), F.struct(iou.isNull().alias("n"), (-iou).alias("i"), (-confidence).alias("c"), F.col(index).alias("k")))
    g = df.groupBy(target).agg(best.alias("_b"))
    return g.select(target, F.col(f"_b.{index}").alias(index), F.coalesce("_b.iou", F.lit(0.0)).alias("iou"), F.coalesce("_b.confidence", F.lit(0.0)).alias("confidence"))


@query(f"""SELECT t.vec_id AS target, pred, coalesce(round(iou, 6), 0) AS iou, coalesce(round(c, 6), 0) AS confidence FROM (SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0) t LEFT JOIN
       (SELECT target, pred, iou, (pred % 10) / 10.0 AS c, row_number() OVER (PARTITION BY target ORDER BY iou DESC, pred % 10 DESC, pred) AS r FROM ({IOU})) m ON m.target = t.vec_id AND r = 1""")
def q_best_match(spark, sf_dir) -> DataFrame:
    df = mask_pairs(Tables(spark, sf_dir))
    iou = F.when(F.col("pred").isNotNull(), M.mask_iou(F.col("tw"), F.col("pw")))
    out = best_match(df, "target", iou, F.col("pred") % 10 / 10.0, "pred")
    return out.select("target", "pred", F.round("iou", 6).alias("iou"), F.round("confidence", 6).alias("confidence"))


@query("""SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS mean, round(list_stddev_pop(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS deviation FROM embeddings""")
def q_raster_moments(spark, sf_dir) -> DataFrame:
    out = M.raster_moments(Tables(spark, sf_dir).embeddings, "vec_id", "embedding")
    return out.select("vec_id", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query()
def q_raster_features(spark, sf_dir) -> DataFrame:
    df = Tables(spark, sf_dir).embeddings.withColumn("mask", F.transform("embedding", lambda x: x > 0))
    return M.raster_features(df, "vec_id", "embedding", 8, -4.0, 4.0, 1.0, 2.0, "mask")


@query()
def q_radial_profile(spark, sf_dir) -> DataFrame:
    return M.radial_profile(Tables(spark, sf_dir).embeddings, "label", "embedding", 8, 6)


@query("""WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings), n AS (SELECT label, greatest(0, least(19, floor((x + 4) / 0.4)))::INT AS bin, count(*) AS n FROM v GROUP BY ALL)
       SELECT label, bin, n, round(n / sum(n) OVER (PARTITION BY label) / 0.4, 6) AS density FROM n""")
def q_density_histogram(spark, sf_dir) -> DataFrame:
    rows = Tables(spark, sf_dir).embeddings.select("label", F.explode("embedding").alias("x")).select("label", F.col("x").cast("double").alias("x"))
    return M.density_histogram(rows, "label", "x", -4.0, 4.0, 20).withColumn("density", F.round("density", 6))


#: Sobel gradients of the 8 x 8 rasters, reflected at the border, at cells above 0 (at all where none is).
GRADIENTS = """
    SELECT label, vec_id, pos, sqrt(gx * gx + gy * gy) AS value FROM (
        SELECT label, vec_id, r * 8 + c AS pos, e, list_bool_or(list_transform(e, lambda x: x > 0)) AS anywhere,
               e[u * 8 + n + 1] - e[u * 8 + w + 1] + 2 * (e[r * 8 + n + 1] - e[r * 8 + w + 1]) + e[d * 8 + n + 1] - e[d * 8 + w + 1] AS gx,
               e[d * 8 + w + 1] - e[u * 8 + w + 1] + 2 * (e[d * 8 + c + 1] - e[u * 8 + c + 1]) + e[d * 8 + n + 1] - e[u * 8 + n + 1] AS gy
        FROM (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, r, c, CASE r WHEN 0 THEN 1 ELSE r - 1 END AS u, CASE r WHEN 7 THEN 6 ELSE r + 1 END AS d,
                     CASE c WHEN 0 THEN 1 ELSE c - 1 END AS w, CASE c WHEN 7 THEN 6 ELSE c + 1 END AS n FROM embeddings, range(8) a(r), range(8) b(c)))
    WHERE e[pos + 1] > 0 OR NOT anywhere"""


def gradients(t: Tables) -> DataFrame:
    df = t.embeddings.withColumn("mask", F.transform("embedding", lambda x: x > 0))
    return M.gradient_values(df, "vec_id", "label", "embedding", 8, "mask")


@query(f"""WITH n AS (SELECT label, least(31, floor(value / 0.5))::INT AS bin, count(*) AS n FROM ({GRADIENTS}) GROUP BY ALL)
       SELECT label, bin, n, round(n / sum(n) OVER (PARTITION BY label) / 0.5, 6) AS density FROM n""")
def q_gradient_histogram(spark, sf_dir) -> DataFrame:
    return M.density_histogram(gradients(Tables(spark, sf_dir)), "label", "value", 0.0, 16.0, 32).withColumn("density", F.round("density", 6))


@query(f"""SELECT label, vec_id, pos::INT AS pos, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42, 'vec_id', 'pos')}, vec_id, pos) AS r FROM ({GRADIENTS})) WHERE r <= 500""")
def q_gradient_sample(spark, sf_dir) -> DataFrame:
    rows = M.sample_values(gradients(Tables(spark, sf_dir)), "label", ["vec_id", "pos"], 500, 42)
    return rows.select("label", "vec_id", "pos", F.round("value", 6).alias("value"))


#: Keys that the metadata of a rendered sample must have.
RENDERED_KEYS = (
    "sample_id condition_id background_id foreground_id candidate_seed rendering_seed config_sha256 source_manifest_sha256 "
    "resolution_manifest_sha256 legacy_source_sha256 code_sha256 selection"
).split()
#: Rendered samples made of vectors: their raster is the mask, their first six components the outline, and ids tell what is wrong.
RENDERED = f"""
    SELECT vec_id, vec_id % 13 <> 0 AS image, vec_id % 17 <> 0 AS mask, vec_id % 5 = 0 AS wide, list_transform(embedding, lambda x: CASE WHEN vec_id % 29 = 0 THEN 0 WHEN x > 0.2 AND vec_id % 7 = 0 THEN 128 WHEN x > 0 THEN 255 ELSE 0 END) AS m,
           vec_id % 11 = 0 AS broken, CASE WHEN vec_id % 19 = 0 THEN '  ' ELSE line || chr(10) || CASE vec_id % 6 WHEN 1 THEN '1' || substr(line, 2) WHEN 2 THEN line || ' 0.5' WHEN 3 THEN line || ' 0.5 1.5' WHEN 4 THEN line || ' x 0.5' ELSE line END END AS polygons,
           list_filter({RENDERED_KEYS}, lambda k: NOT (k = 'selection' AND vec_id % 3 = 0) AND NOT (k = 'code_sha256' AND vec_id % 4 = 0)) AS keys
    FROM (SELECT vec_id, embedding, '0' || array_to_string(list_transform(embedding[1:6], lambda x: ' ' || CASE WHEN x > 0 THEN '0.75' ELSE '0.25' END), '') AS line FROM embeddings)"""


@query(f"""WITH r AS ({RENDERED}), l AS (SELECT *, CASE WHEN broken THEN [] ELSE list_transform(list_filter(string_split(trim(polygons), chr(10)), lambda x: x <> ''), lambda x: string_split(x, ' ')) END AS lines FROM r),
    b AS (SELECT *, list_filter(list_transform(lines, lambda p: CASE WHEN len(p) < 7 OR len(p) % 2 = 0 THEN 'polygon_invalid_field_count' WHEN p[1] <> '0' THEN 'polygon_invalid_class'
        WHEN len(list_filter(p, lambda v: TRY_CAST(v AS DOUBLE) IS NULL)) > 0 THEN 'polygon_non_numeric' WHEN len(list_filter(p[2:], lambda v: v::DOUBLE < 0 OR v::DOUBLE > 1)) > 0 THEN 'polygon_coordinate_out_of_range' END), lambda x: x IS NOT NULL) AS bad,
        list_sort(list_filter({sorted(RENDERED_KEYS)}, lambda k: NOT list_contains(keys, k))) AS lost FROM l)
    SELECT vec_id, array_to_string(list_sort(list_filter([CASE WHEN NOT image THEN 'image_decode_failed' END, CASE WHEN NOT mask THEN 'mask_decode_failed' END, CASE WHEN image AND mask AND wide THEN 'image_mask_size_mismatch' END,
        CASE WHEN image AND mask AND len(list_filter(m, lambda v: v NOT IN (0, 255))) > 0 THEN 'mask_not_binary' END, CASE WHEN image AND mask AND len(list_filter(m, lambda v: v <> 0)) = 0 THEN 'mask_empty' END,
        CASE WHEN broken THEN 'polygon_not_utf8' END, CASE WHEN len(lines) = 0 THEN 'polygon_empty' ELSE bad[1] END, CASE WHEN len(lost) > 0 THEN 'metadata_missing:' || array_to_string(lost, ',') END], lambda x: x IS NOT NULL)), ';') AS reasons FROM b""")
def q_rendered_reasons(spark, sf_dir) -> DataFrame:
    v = F.col("vec_id")
    line = F.concat(F.lit("0"), F.array_join(F.transform(F.slice("embedding", 1, 6), lambda x: F.concat(F.lit(" "), F.when(x > 0, "0.75").otherwise("0.25"))), ""))
    last = F.when(v % 6 == 1, F.concat(F.lit("1"), F.substr(line, F.lit(2)))).when(v % 6 == 2, F.concat(line, F.lit(" 0.5"))).when(v % 6 == 3, F.concat(line, F.lit(" 0.5 1.5"))).when(v % 6 == 4, F.concat(line, F.lit(" x 0.5"))).otherwise(line)
    text = F.when(v % 19 == 0, "  ").otherwise(F.concat(line, F.lit("\n"), last)).cast("binary")
    mask = F.transform("embedding", lambda x: F.when(v % 29 == 0, 0).when((x > F.lit(0.2).cast("double")) & (v % 7 == 0), 128).when(x > 0, 255).otherwise(0))
    has = lambda k: F.when(~((F.lit(k == "selection") & (v % 3 == 0)) | (F.lit(k == "code_sha256") & (v % 4 == 0))), F.lit(k))
    keys = F.array_compact(F.array(*[has(k) for k in RENDERED_KEYS]))
    reasons = M.rendered_reasons(
        (F.when(v % 13 != 0, 8), F.lit(8)), (F.when(v % 17 != 0, F.when(v % 5 == 0, 9).otherwise(8)), F.lit(8)), mask, F.when(v % 11 == 0, F.unhex(F.lit("30FF"))).otherwise(text), F.map_from_arrays(keys, keys), RENDERED_KEYS
    )
    return Tables(spark, sf_dir).embeddings.select("vec_id", F.array_join(reasons, ";").alias("reasons"))


@query("""SELECT page_id, array_to_string(list_sort(list_filter([CASE WHEN NOT regexp_matches(html, '<html') THEN 'no_html' END, CASE WHEN NOT regexp_matches(html, '<title>') THEN 'no_title' END,
       CASE WHEN length(html) > 6000 THEN 'too_long' END, CASE WHEN NOT starts_with(url, 'https://') THEN 'not_https' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM pages""")
def q_bundle_reasons(spark, sf_dir) -> DataFrame:
    checks = {"no_html": F.col("html").rlike("<html"), "no_title": F.col("html").rlike("<title>"), "too_long": F.length("html") <= 6000, "not_https": F.col("url").startswith("https://")}
    return Tables(spark, sf_dir).pages.select("page_id", F.array_join(M.bundle_reasons(checks), ",").alias("reasons"))
