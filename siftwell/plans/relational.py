"""Queries of joins, summaries and evaluation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import mask_iou
from ..operators import aggregates as A
from ..operators import joins as J
from .base import FEATURES, Tables, doc_features, hash_sql, query
from .scalar import IOU, mask_pairs


@query("SELECT coalesce(d.doc_id, l.doc_id) AS key, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'paired' END AS status, d.lang, coalesce(l.toxic, -1) AS toxic FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def q_pair_full(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    out = J.pair(t.documents.select("doc_id", "lang"), t.labels, F.col("doc_id"), F.col("doc_id"))
    return out.select("key", "status", F.col("l.lang").alias("lang"), F.coalesce("r.toxic", F.lit(-1)).alias("toxic"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['purchase', 'signup', 'click', 'view'], event_type), event_id) AS r FROM events WHERE event_type IN ('purchase', 'signup', 'click', 'view')) WHERE r = 1")
def q_prefer_match(spark, sf_dir) -> DataFrame:
    events = Tables(spark, sf_dir).events.select("user_id", "event_type", "event_id")
    return J.prefer(events, "user_id", "event_type", ["purchase", "signup", "click", "view"], "event_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_exclude_selected(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return J.exclude(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("SELECT d.doc_id, sha256(d.text) AS h, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM documents m JOIN labels l ON m.doc_id = l.doc_id AND l.toxic = 0 WHERE m.doc_id = d.doc_id AND sha256(CASE WHEN m.lang = 'de' THEN m.text || 'x' ELSE m.text END) = sha256(d.text))")
def q_allowed_sources(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    registered = F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text"))  # these have changed since
    allowed = t.documents.join(t.labels.where("toxic = 0"), "doc_id", "left_semi").select("doc_id", F.sha2(registered, 256).alias("h"))
    return J.allowed_only(t.documents.select("doc_id", F.sha2("text", 256).alias("h"), "lang"), allowed, ["doc_id", "h"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus <> 'P') GROUP BY l_orderkey")
def q_orphans(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    parent = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey")
    return J.orphans(t.lineitem.select("l_orderkey"), parent, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"""WITH ring AS (SELECT p_partkey, p_size % 5 AS env, row_number() OVER (PARTITION BY p_size % 5 ORDER BY {hash_sql(3, 'p_partkey')}, p_partkey) - 1 AS place FROM part), size AS (SELECT env, count(*) AS n FROM ring GROUP BY env),
    asked AS (SELECT o_orderkey, o_orderkey % 5 AS env, k AS rank, n, (('0x' || substr({hash_sql(3, 'o_orderkey')}, 1, 8))::BIGINT + k) % n AS place FROM orders JOIN size ON env = o_orderkey % 5, range(4) r(k) WHERE k < n)
    SELECT o_orderkey, p_partkey, rank::INT AS rank FROM asked JOIN ring USING (env, place)""")
def q_candidate_pool(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    plans = t.orders.select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("env"))
    pool = t.part.select("p_partkey", (F.col("p_size") % 5).cast("int").alias("env"))
    return J.candidates(plans, pool, "env", "o_orderkey", "p_partkey", 4, 3).select("o_orderkey", "p_partkey", "rank")


METRICS = "SELECT o_orderpriority AS experiment, o_custkey % 3 AS seed, avg(o_totalprice) AS price, count(*)::DOUBLE AS orders FROM orders GROUP BY ALL"


def metrics(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("experiment"), (F.col("o_custkey") % 3).alias("seed")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))


@query(f"WITH m AS ({METRICS}) SELECT a.experiment AS a, b.experiment AS b, a.seed, round(b.price - a.price, 4) AS price, b.orders - a.orders AS orders FROM m a JOIN m b ON a.seed = b.seed AND (a.experiment, b.experiment) IN (('1-URGENT', '2-HIGH'), ('1-URGENT', '5-LOW'), ('3-MEDIUM', '5-LOW'))")
def q_paired_diff(spark, sf_dir) -> DataFrame:
    m = metrics(Tables(spark, sf_dir))
    pairs = spark.createDataFrame([("1-URGENT", "2-HIGH"), ("1-URGENT", "5-LOW"), ("3-MEDIUM", "5-LOW")], "a string, b string")
    return J.paired_diff(m, pairs, "experiment", ["seed"], ["price", "orders"]).withColumn("price", F.round("price", 4))


@query("""WITH m AS (SELECT l_orderkey, count(*) AS lines, max(l_linenumber) AS last FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey, 1 + o_orderkey % 7 AS lines FROM orders)
       SELECT o_orderkey AS l_orderkey, 'missing' AS reason FROM c WHERE o_orderkey NOT IN (SELECT l_orderkey FROM m) UNION ALL SELECT o_orderkey, 'lines' FROM c JOIN m ON o_orderkey = l_orderkey WHERE c.lines <> m.lines""")
def q_catalog_check(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    m = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    catalog = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_orderkey") % 7).alias("lines"))
    return J.check_catalog(catalog, m, "l_orderkey", ["lines"])


@query("""WITH a AS (SELECT doc_id, n_chars, lang FROM documents WHERE n_chars >= 200), b AS (SELECT doc_id, length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n_chars, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE n_chars <= 5000)
       SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, unnest(list_filter([CASE WHEN b.doc_id IS NULL THEN 'missing_right' END, CASE WHEN a.doc_id IS NULL THEN 'missing_left' END,
       CASE WHEN a.doc_id = b.doc_id AND a.n_chars IS DISTINCT FROM b.n_chars THEN 'differs:n_chars' END, CASE WHEN a.doc_id = b.doc_id AND a.lang IS DISTINCT FROM b.lang THEN 'differs:lang' END], lambda x: x IS NOT NULL)) AS reason FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def q_reconcile(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    a = docs.where("n_chars >= 200").select("doc_id", "n_chars", "lang")
    b = docs.where("n_chars <= 5000").select("doc_id", (F.length("text") + (F.col("doc_id") % 7 == 0).cast("int")).cast("long").alias("n_chars"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))
    return J.reconcile(a, b, ["doc_id"], ["n_chars", "lang"])


@query("SELECT user_id, CASE WHEN min(v) = max(v) THEN min(v) END AS v, CASE WHEN min(v) IS NULL THEN 'missing' WHEN min(v) = max(v) THEN 'resolved' ELSE 'conflict' END AS status FROM (SELECT user_id, CASE WHEN value > 300 THEN event_type END AS v FROM events) GROUP BY user_id")
def q_resolve_labels(spark, sf_dir) -> DataFrame:
    events = Tables(spark, sf_dir).events.select("user_id", F.when(F.col("value") > 300, F.col("event_type")).alias("v"))
    return J.resolve_labels(events, "user_id", "v")


@query("SELECT count(*) AS extra_rows, count(*) = 0 AS is_subset FROM (SELECT c_nationkey, c_mktsegment FROM customer EXCEPT ALL SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0)")
def q_exact_subset(spark, sf_dir) -> DataFrame:
    c = Tables(spark, sf_dir).customer.select("c_nationkey", "c_mktsegment", "c_acctbal")
    return J.is_exact_subset(c.drop("c_acctbal"), c.where("c_acctbal > 0"))


@query("""WITH a AS (SELECT DISTINCT doc_id AS k FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT doc_id AS k FROM labels), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
       SELECT count(x) AS left_n, count(y) AS right_n, count(*) FILTER (x = y) AS both_n, count(*) FILTER (y IS NULL) AS left_only_n, count(*) FILTER (x IS NULL) AS right_only_n, count(x) = count(*) AND count(y) = count(*) AS equal FROM j""")
def q_set_checks(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return J.same_set(t.documents.where("lang = 'en'").select("doc_id"), t.labels.select("doc_id"), "doc_id")


@query("""SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS position, 0 AS source FROM events WHERE event_type = 'click'
       UNION ALL SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT, 1 FROM events WHERE event_type = 'view'""")
def q_interleave(spark, sf_dir) -> DataFrame:
    e = Tables(spark, sf_dir).events.select("user_id", "event_id", "ts", "event_type")
    return J.interleave(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["ts", "event_id"], "event_id", "user_id")


@query("SELECT field, value, count(*) AS n FROM (SELECT lang, source FROM documents) UNPIVOT (value FOR field IN (lang, source)) GROUP BY ALL")
def q_distributions(spark, sf_dir) -> DataFrame:
    return A.distributions(Tables(spark, sf_dir).documents, ["lang", "source"])


@query("""SELECT lang, count(n_chars) AS n, round(avg(n_chars), 7) AS mean, min(n_chars) AS minimum, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS maximum FROM documents GROUP BY lang""")
def q_coverage_summary(spark, sf_dir) -> DataFrame:
    return A.describe_exact(Tables(spark, sf_dir).documents, "n_chars", ["lang"]).withColumn("mean", F.round("mean", 7))


EDGES = [0.05 * k for k in range(1, 17)]


def _bin_sql(source: str, col: str, edges: list[float]) -> str:
    case = "CASE " + " ".join(f"WHEN {col} < {e!r} THEN {k}" for k, e in enumerate(edges)) + f" ELSE {len(edges)} END"
    return f"WITH c AS (SELECT {case} AS bin, count(*) AS n FROM {source} WHERE {col} IS NOT NULL GROUP BY 1) SELECT b::INT AS bin, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 6) AS share FROM range({len(edges) + 1}) r(b) LEFT JOIN c ON b = bin"


@query(_bin_sql(f"({FEATURES})", "variety", EDGES))
def q_coverage_bins(spark, sf_dir) -> DataFrame:
    return A.bin_counts(doc_features(Tables(spark, sf_dir)), "variety", EDGES).withColumn("share", F.round("share", 6))


@query(_bin_sql("lineitem", "l_extendedprice", [1000.0, 20000.0, 40000.0, 60000.0, 200000.0]))
def q_bucket_share(spark, sf_dir) -> DataFrame:
    return A.bin_counts(Tables(spark, sf_dir).lineitem, "l_extendedprice", [1000.0, 20000.0, 40000.0, 60000.0, 200000.0]).withColumn("share", F.round("share", 6))


SUMMARY = "SELECT o_orderstatus AS split, o_orderpriority AS experiment, '{m}' AS metric, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sample_sd, min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum FROM orders GROUP BY ALL"


@query(SUMMARY.format(m="price", c="o_totalprice") + " UNION ALL " + SUMMARY.format(m="day", c="day(o_orderdate)"))
def q_metric_summary(spark, sf_dir) -> DataFrame:
    rows = Tables(spark, sf_dir).orders.select(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("experiment"), F.col("o_totalprice").alias("price"), F.dayofmonth("o_orderdate").alias("day"))
    return A.summarise(rows, ["split", "experiment"], ["price", "day"]).withColumns({c: F.round(c, 6) for c in ("mean", "sample_sd")})


@query("""SELECT o_orderpriority AS experiment, 'price' AS metric, unnest(['maximum', 'mean', 'minimum', 'n', 'sample_sd']) AS reason FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1
       UNION ALL SELECT '3-MEDIUM', 'price', 'not_published' UNION ALL SELECT 'X', 'price', 'not_computed'""")
def q_verify_summary(spark, sf_dir) -> DataFrame:
    rows = Tables(spark, sf_dir).orders.select(F.col("o_orderpriority").alias("experiment"), F.col("o_totalprice").alias("price"))
    published = A.summarise(rows, ["experiment"], ["price"])
    off = {c: F.when(F.col("experiment") == "2-HIGH", F.col(c) + 1).otherwise(F.col(c)) for c in ("n", "mean", "sample_sd", "minimum", "maximum")}
    changed = published.where("experiment <> '3-MEDIUM'").withColumns(off)
    extra = published.where("experiment = '3-MEDIUM'").withColumn("experiment", F.lit("X"))
    return A.verify_summary(rows, changed.unionByName(extra), ["experiment"], ["price"], 1e-6)


PRF = f"""SELECT lang, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) AS images FROM
    (SELECT lang, quality = 1 AS t, n_words > 150 AND variety > 0.4 AS g FROM ({FEATURES}) JOIN labels USING (doc_id)) GROUP BY lang"""


def confusion(t: Tables) -> DataFrame:
    df = doc_features(t).join(t.labels, "doc_id")
    return A.prf(df, ["lang"], F.col("quality") == 1, (F.col("n_words") > 150) & (F.col("variety") > 0.4))


RATES = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1, fp::DOUBLE / images AS fp_per_image"


@query(f"SELECT lang, tp, fp, fn, images, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fp_per_image, 6) AS fp_per_image FROM (SELECT *, {RATES} FROM ({PRF}))")
def q_prf(spark, sf_dir) -> DataFrame:
    return confusion(Tables(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "fp_per_image")})


@query(f"SELECT lang, tp, fp, fn FROM ({PRF}) WHERE lang = 'de'")
def q_check_prf(spark, sf_dir) -> DataFrame:
    stored = confusion(Tables(spark, sf_dir)).withColumn("f1", F.when(F.col("lang") == "de", F.col("f1") + 1e-6).otherwise(F.col("f1")))
    return A.check_prf(stored).select("lang", "tp", "fp", "fn")


THRESHOLDS = [0.3, 0.35, 0.4, 0.45, 0.5]


@query(f"""WITH p AS (SELECT label, pred, iou, (pred % 1000) / 1000.0 AS c, th FROM ({IOU}), (SELECT unnest({THRESHOLDS}) AS th)), n AS (SELECT label, count(*) AS nt FROM embeddings WHERE vec_id % 4 = 0 GROUP BY label),
    r AS (SELECT p.label, th, c, pred, nt, sum(CASE WHEN iou >= th THEN 1 ELSE 0 END) OVER w AS tp, count(*) OVER w AS k FROM p JOIN n USING (label) WINDOW w AS (PARTITION BY p.label, th ORDER BY c DESC, pred ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT *, tp::DOUBLE / nt AS recall, tp::DOUBLE / k AS prec FROM r), b AS (SELECT label, th, recall, max(prec) OVER (PARTITION BY label, th ORDER BY c DESC, pred ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best,
    coalesce(lag(recall) OVER (PARTITION BY label, th ORDER BY c DESC, pred), 0) AS before FROM q), ap AS (SELECT label, th, sum((recall - before) * best) AS ap FROM b GROUP BY ALL)
    SELECT label, round(max(ap) FILTER (th = 0.5), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM ap GROUP BY label""")
def q_mean_ap(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    preds = mask_pairs(t).where("pred is not null").select("label", "pred", mask_iou(F.col("tw"), F.col("pw")).alias("iou"), ((F.col("pred") % 1000) / 1000.0).alias("confidence"))
    targets = t.embeddings.where("vec_id % 4 = 0").groupBy("label").agg(F.count("*").alias("n_targets"))
    out = A.map_summary(A.mean_ap(preds, ["label"], targets, THRESHOLDS, "iou", "confidence", "pred"), ["label"])
    return out.withColumns({c: F.round(c, 6) for c in ("map50", "map50_95")})


@query("SELECT l_returnflag, l_linestatus, count(*) AS rows, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS discounted FROM lineitem GROUP BY ALL")
def q_series_totals(spark, sf_dir) -> DataFrame:
    sums = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discounted": (F.col("l_discount") > 0.05).cast("long")}
    return A.totals(Tables(spark, sf_dir).lineitem, ["l_returnflag", "l_linestatus"], sums).withColumns({c: F.round(c, 2) for c in ("quantity", "price")})


@query("SELECT user_id, round(sum(value), 3) AS total_seconds, round(avg(value), 7) AS mean_seconds, max(value) AS peak, count(*) FILTER (event_type = 'error')::BIGINT AS retries, max(event_id) AS last_step FROM events GROUP BY user_id")
def q_resource_rollup(spark, sf_dir) -> DataFrame:
    out = A.resource_rollup(Tables(spark, sf_dir).events, "user_id", "value", "value", (F.col("event_type") == "error").cast("long"), "event_id")
    return out.withColumns({"total_seconds": F.round("total_seconds", 3), "mean_seconds": F.round("mean_seconds", 7)})


@query("SELECT event_type, count(value) AS n, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def q_latency(spark, sf_dir) -> DataFrame:
    return A.latency_quantiles(Tables(spark, sf_dir).events, ["event_type"], "value").withColumn("median", F.round("median", 6))


@query("SELECT p_brand, count(*) AS n, count(DISTINCT (p_type, p_size % 2)) = 1 AS equal FROM part GROUP BY p_brand")
def q_all_equal(spark, sf_dir) -> DataFrame:
    return A.all_equal(Tables(spark, sf_dir).part.select("p_brand", "p_type", (F.col("p_size") % 2).alias("odd")), ["p_brand"], ["p_type", "odd"])


VECTORS = "SELECT vec_id, label, (unnest(range(0, 64)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query(f"SELECT label, dim, round(avg(x), 6) AS mean, count(*) AS n FROM ({VECTORS}) GROUP BY ALL")
def q_mean_vector(spark, sf_dir) -> DataFrame:
    return A.mean_vector(Tables(spark, sf_dir).embeddings, "label", "embedding").withColumn("mean", F.round("mean", 6))


@query(f"WITH v AS ({VECTORS}) SELECT a.label, a.dim AS i, b.dim AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY ALL")
def q_covariance(spark, sf_dir) -> DataFrame:
    return A.covariance(Tables(spark, sf_dir).embeddings, "label", "embedding").withColumn("cov", F.round("cov", 6))


@query()
def q_frechet(spark, sf_dir) -> DataFrame:
    return A.frechet_distances(Tables(spark, sf_dir).embeddings, "label", "embedding")


@query("""WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS n FROM lineitem GROUP BY ALL), u AS (SELECT a, sum(n) AS uses FROM p GROUP BY a)
       SELECT (SELECT count(*) FROM p) AS pairs, (SELECT sum(n - 1)::BIGINT FROM p) AS excess_pairs, (SELECT count(*) FROM u) AS objects_used, (SELECT max(uses)::BIGINT FROM u) AS max_uses""")
def q_repeat_stats(spark, sf_dir) -> DataFrame:
    return A.repeat_stats(Tables(spark, sf_dir).lineitem, "l_partkey", "l_suppkey")


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, count(DISTINCT lang) AS conditions FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_duplicate_groups(spark, sf_dir) -> DataFrame:
    return A.duplicate_groups(Tables(spark, sf_dir).documents, F.sha2("text", 256), "doc_id", "lang")


@query("SELECT sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS n, doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1")
def q_duplicate_members(spark, sf_dir) -> DataFrame:
    return A.duplicate_members(Tables(spark, sf_dir).documents, F.sha2("text", 256), "doc_id")


@query("SELECT o_custkey, count(o_totalprice) AS n, round(stddev_pop(o_totalprice), 4) AS sd, round(max(o_totalprice) - min(o_totalprice), 4) AS range FROM orders GROUP BY o_custkey")
def q_model_spread(spark, sf_dir) -> DataFrame:
    return A.spread(Tables(spark, sf_dir).orders, "o_custkey", "o_totalprice").withColumns({c: F.round(c, 4) for c in ("sd", "range")})


@query("SELECT l_returnflag, count(*) FILTER (d > 0.02) AS gains, count(*) FILTER (d < -0.02) AS losses, count(*) FILTER (abs(d) <= 0.02) AS ties FROM (SELECT l_returnflag, round(l_discount - l_tax, 6) AS d FROM lineitem) GROUP BY 1")
def q_sign_counts(spark, sf_dir) -> DataFrame:
    return A.sign_counts(Tables(spark, sf_dir).lineitem, ["l_returnflag"], F.round(F.col("l_discount") - F.col("l_tax"), 6), 0.02)


@query("""WITH m AS (SELECT avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS a, avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS b, avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') AS c, avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS d FROM orders)
       SELECT round(b - a, 4) AS first, round(d - c, 4) AS second, round((b - a) - (d - c), 4) AS did, round(-(b - a) / a, 8) AS reduction FROM m""")
def q_diff_in_diff(spark, sf_dir) -> DataFrame:
    out = A.did(Tables(spark, sf_dir).orders, "o_orderpriority", "o_totalprice", ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))
    return out.select(*[F.round(c, 4).alias(c) for c in ("first", "second", "did")], F.round("reduction", 8).alias("reduction"))


@query("SELECT count(*) AS n, round(max(abs(d)), 6) AS max_abs, round(max(abs(d) / abs(a)) FILTER (a <> 0), 6) AS max_rel, max(abs(d)) <= 0.5 AS within FROM (SELECT value AS a, round(value, 0) - value AS d FROM events)")
def q_series_delta(spark, sf_dir) -> DataFrame:
    e = Tables(spark, sf_dir).events
    out = A.series_delta(e.select("event_id", "value"), e.select("event_id", F.round("value", 0).alias("value")), ["event_id"], "value", 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("max_abs", "max_rel")})


@query("SELECT event_type, count(*) AS n, event_type IN ('purchase', 'error') AS terminal FROM events GROUP BY event_type")
def q_state_counts(spark, sf_dir) -> DataFrame:
    return A.state_counts(Tables(spark, sf_dir).events, "event_type", ["purchase", "error"])


@query("SELECT coalesce(CASE WHEN value > 10 THEN event_type END, 'UNKNOWN') AS reason, count(*) AS n FROM events GROUP BY 1")
def q_reject_counts(spark, sf_dir) -> DataFrame:
    return A.reject_counts(Tables(spark, sf_dir).events.select(F.when(F.col("value") > 10, F.col("event_type")).alias("reason")), "reason")


@query("""SELECT p_brand, count(*) AS objects, count(*) * 25 AS supply, greatest(0, 600 - count(*) * 25) AS shortfall, ceil(600.0 / count(*))::BIGINT AS min_ceiling, CASE WHEN count(*) * 25 >= 600 THEN 'READY' ELSE 'BLOCKED' END AS status FROM part GROUP BY p_brand""")
def q_capacity(spark, sf_dir) -> DataFrame:
    supply = Tables(spark, sf_dir).part.groupBy("p_brand").agg(F.count("*").alias("objects"))
    return A.capacity(supply, 600, 25, ["p_brand"])
