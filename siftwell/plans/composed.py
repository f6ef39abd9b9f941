"""Queries of selection, integrity, lineage and similarity operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_rank
from ..operators import integrity as I
from ..operators import selection as X
from ..operators import similarity as S
from ..sources.sinks import stage_log
from .base import FEATURES, GROUPED, HARDNESS, SCORED, Tables, allocate_sql, doc_features, group_hash, hash_sql, query
from .ordered import POOL, pool, scored
from .scalar import SIGNATURE, doc_signature

LANGS = "SELECT lang, count(*) AS w FROM documents GROUP BY lang"


@query(f"SELECT lang, w AS n, quota FROM ({allocate_sql(LANGS, 'lang', 'w', '187')})")
def q_allocate(spark, sf_dir) -> DataFrame:
    n = Tables(spark, sf_dir).documents.groupBy("lang").agg(F.count("*").alias("w"))
    return X.allocate(n, "lang", "w", 187).select("lang", F.col("w").alias("n"), "quota")


NESTED = f"SELECT lang, source, w, q.quota AS n FROM (SELECT lang, source, count(*) AS w FROM documents GROUP BY ALL) JOIN ({allocate_sql(LANGS, 'lang', 'w', '500')}) q USING (lang)".replace("lang, source, w, q.quota", "lang, source, s.w, q.quota").replace("GROUP BY ALL) JOIN", "GROUP BY ALL) s JOIN")


@query(f"SELECT lang, source, quota FROM ({allocate_sql(NESTED, 'source', 'w', 'n', 'lang')})")
def q_allocate_nested(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    outer = X.allocate(docs.groupBy("lang").agg(F.count("*").alias("w")), "lang", "w", 500).select("lang", F.col("quota").alias("n"))
    inner = docs.groupBy("lang", "source").agg(F.count("*").alias("w")).join(outer, "lang")
    return X.allocate(inner, "source", "w", F.col("n"), ["lang"]).select("lang", "source", "quota")


@query(f"SELECT row_number() OVER (ORDER BY {hash_sql(3, 'lang', 'nth')}, nth) AS slot, lang, nth FROM (SELECT lang, unnest(range(1, w + 1)) AS nth FROM ({LANGS}))")
def q_schedule(spark, sf_dir) -> DataFrame:
    n = Tables(spark, sf_dir).documents.groupBy("lang").agg(F.count("*").alias("w"))
    return X.expand_schedule(n, "lang", "w", 3)


SHARES = {"difficulty": {"easy": 5, "mid": 3, "hard": 2}, "scale": {"large": 3, "small": 3, "tiny": 4}}
FORBIDDEN = "(difficulty = 'hard' AND scale = 'tiny') OR (lang = 'es' AND scale = 'large')"


def _zip_sql(rounds: int = 6) -> str:
    values = lambda name: f"SELECT * FROM (VALUES {', '.join(map(str, SHARES[name].items()))}) v({name}, w)"
    shares = lambda name: allocate_sql(values(name), name, "w", "(SELECT count(*) FROM documents)")
    order = lambda seed, name, counts, n: f"SELECT row_number() OVER (ORDER BY {hash_sql(seed, name, 'nth')}, nth) AS slot, {name} FROM (SELECT {name}, unnest(range(1, {n} + 1)) AS nth FROM ({counts}))"
    forbidden = lambda row, other: "((" + FORBIDDEN.replace("difficulty", f"{row}.difficulty").replace("scale", f"{other}.scale").replace("lang", f"{row}.lang") + "))"
    parts = [f"s0 AS MATERIALIZED (SELECT slot, lang, difficulty, scale, NOT ({FORBIDDEN}) AS ok FROM ({order(30, 'lang', LANGS, 'w')}) JOIN ({order(31, 'difficulty', shares('difficulty'), 'quota')}) USING (slot) JOIN ({order(32, 'scale', shares('scale'), 'quota')}) USING (slot))"]
    for k in range(rounds):
        parts.append(f"d{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY {hash_sql(40, k, 'slot')}, slot) AS n FROM s{k})")
        parts.append(f"t{k} AS (SELECT a.slot AS a, a.scale AS va, b.slot AS b, b.scale AS vb, b.n FROM d{k} a JOIN d{k} b ON a.n = (b.n - 1) // 8 + 1 AND NOT a.ok AND b.ok WHERE NOT {forbidden('a', 'b')} AND NOT {forbidden('b', 'a')})")
        parts.append(f"m{k} AS MATERIALIZED (SELECT a, arg_min(va, n) AS va, arg_min(b, n) AS b, arg_min(vb, n) AS vb FROM t{k} GROUP BY a)")
        parts.append(f"g{k} AS (SELECT a AS slot, vb AS scale FROM m{k} UNION ALL SELECT b, va FROM m{k})")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT *, NOT ({FORBIDDEN}) AS ok FROM (SELECT s.slot, lang, difficulty, coalesce(g.scale, s.scale) AS scale FROM s{k} s LEFT JOIN g{k} g USING (slot)))")
    return f"WITH {', '.join(parts)} SELECT slot, lang, difficulty, scale FROM s{rounds}"


@query(_zip_sql())
def q_schedule_zip(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    n = docs.count()
    columns = {"lang": (docs.groupBy("lang").agg(F.count("*").alias("w")), "w")}
    for name, weights in SHARES.items():
        columns[name] = (X.allocate(spark.createDataFrame(list(weights.items()), f"{name} string, w long"), name, "w", n), "quota")
    return X.exchange(X.zip_schedule(columns, 30), "slot", "scale", ~F.expr(FORBIDDEN), 40)


@query(f"""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY {hash_sql(4, 'p_partkey')}, p_partkey) AS rank, count(*) OVER () AS k FROM part)
       SELECT p_partkey, rank, least(least(7, greatest(5, ceil(9000.0 / k))), floor(9000 / k) + CASE WHEN rank <= 9000 % k THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def q_object_quota(spark, sf_dir) -> DataFrame:
    return X.object_quota(Tables(spark, sf_dir).part, "p_partkey", 9000, 4)


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL")
def q_drop_variants(spark, sf_dir) -> DataFrame:
    return X.drop_variants(Tables(spark, sf_dir).lineitem, "l_orderkey", "l_suppkey", "l_linenumber")


HARD = f"""
    WITH g AS ({GROUPED}), q AS ({allocate_sql(LANGS, 'lang', 'w', '(SELECT count(*) // 5 FROM documents)')}),
    top AS (SELECT g.* FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS r FROM g) g JOIN q USING (lang) WHERE r <= quota),
    marked AS (SELECT *, sim_group IS NOT NULL AND row_number() OVER (PARTITION BY sim_group ORDER BY score DESC, doc_id) > 1 AS removed FROM top),
    kept AS (SELECT * FROM marked WHERE NOT removed), removed AS (SELECT * FROM marked WHERE removed),
    need AS (SELECT lang, count(*) AS n FROM removed GROUP BY lang),
    open AS (SELECT * FROM g WHERE doc_id NOT IN (SELECT doc_id FROM top) AND (sim_group IS NULL OR sim_group NOT IN (SELECT sim_group FROM kept WHERE sim_group IS NOT NULL))),
    best AS (SELECT * FROM (SELECT *, CASE WHEN sim_group IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY sim_group ORDER BY score DESC, doc_id) END AS b FROM open) WHERE b = 1),
    promoted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS p FROM best) JOIN need USING (lang) WHERE p <= n),
    log AS (SELECT doc_id, lang, score, 'kept' AS action FROM kept UNION ALL SELECT doc_id, lang, score, 'promoted' FROM promoted UNION ALL SELECT doc_id, lang, score, 'removed' FROM removed)"""


def hard(t: Tables) -> DataFrame:
    df = group_hash(doc_features(t))
    n = t.documents.count() // 5
    return X.select_hard(df, "doc_id", "lang", "sim_group", HARDNESS, n)


@query(HARD + " SELECT doc_id, lang, round(score, 6) AS score, action, CASE WHEN action <> 'removed' THEN row_number() OVER (PARTITION BY lang, action <> 'removed' ORDER BY score DESC, doc_id) ELSE 0 END::BIGINT AS rank FROM log")
def q_hard_selection(spark, sf_dir) -> DataFrame:
    return hard(Tables(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(HARD + " SELECT doc_id, lang FROM promoted")
def q_promote(spark, sf_dir) -> DataFrame:
    return hard(Tables(spark, sf_dir)).where("action = 'promoted'").select("doc_id", "lang")


@query(HARD + " SELECT lang, action, count(*) AS n FROM log GROUP BY ALL")
def q_change_log(spark, sf_dir) -> DataFrame:
    return hard(Tables(spark, sf_dir)).groupBy("lang", "action").agg(F.count("*").alias("n"))


TARGETS = {"train": 748, "val": 100, "test": 200}


@query(f"""WITH n AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY lang), s AS (SELECT *, least(1.0, total / 1048.0) AS scale FROM n),
    q AS (SELECT lang, n, round_even(scale * 100 * n / total, 0)::BIGINT AS val, round_even(scale * 200 * n / total, 0)::BIGINT AS test, round_even(scale * 748 * n / total, 0)::BIGINT AS tr FROM s),
    r AS (SELECT doc_id, lang, {hash_sql(8, 'doc_id')} AS d, row_number() OVER (PARTITION BY lang ORDER BY {hash_sql(8, 'doc_id')}, doc_id) AS r FROM documents),
    p AS (SELECT doc_id, lang, d, CASE WHEN r <= val THEN 'val' WHEN r <= val + test THEN 'test' WHEN r <= val + test + least(tr, n - val - test) THEN 'train' ELSE 'reserve' END AS split FROM r JOIN q USING (lang)),
    x AS (SELECT *, CASE WHEN split = 'reserve' THEN row_number() OVER (PARTITION BY split = 'reserve' ORDER BY d, doc_id) END AS rest FROM p)
    SELECT doc_id, lang, CASE WHEN rest <= 200 - (SELECT count(*) FROM p WHERE split = 'test') THEN 'test' ELSE split END AS split FROM x""")
def q_stratified_split(spark, sf_dir) -> DataFrame:
    return X.stratified_split(Tables(spark, sf_dir).documents.select("doc_id", "lang"), "lang", "doc_id", TARGETS, 8)


SPLITS = f"SELECT doc_id, sha256(text) AS h, CASE WHEN ('0x' || substr({hash_sql(6, 'doc_id')}, 1, 4))::BIGINT % 10 < 7 THEN 'train' WHEN ('0x' || substr({hash_sql(6, 'doc_id')}, 1, 4))::BIGINT % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM documents"


def splits(t: Tables) -> DataFrame:
    part = F.conv(F.substring(hash_rank(6, F.col("doc_id")), 1, 4), 16, 10).cast("long") % 10
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.when(part < 7, "train").when(part < 8, "val").otherwise("test").alias("split"))


@query(f"WITH s AS ({SPLITS}) SELECT s.doc_id, s.h, s.split, r.split AS registered FROM s JOIN (SELECT DISTINCT h, split FROM s JOIN labels USING (doc_id)) r ON s.h = r.h WHERE s.split <> r.split")
def q_split_conflicts(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return X.split_conflicts(splits(t), splits(t).join(t.labels, "doc_id", "left_semi"), "h")


@query(f"WITH s AS (SELECT DISTINCT h, split FROM (SELECT h, split FROM ({SPLITS}) UNION ALL SELECT sha256(text), 'benchmark' FROM benchmark)) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.split < b.split GROUP BY ALL")
def q_leakage(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    both = splits(t).select("h", "split").union(t.benchmark.select(F.sha2("text", 256), F.lit("benchmark")))
    return X.leakage(both, "h", "split")


SLOTS = "SELECT o_orderkey AS slot, o_custkey AS background, o_orderkey % 5 AS env FROM orders"


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY {hash_sql(10, 'background')}, background, slot) AS r FROM ({SLOTS})),
    o AS (SELECT p_partkey, p_size % 5 AS env, row_number() OVER (PARTITION BY p_size % 5 ORDER BY {hash_sql(10, 'p_partkey')}, p_partkey) AS o, count(*) OVER (PARTITION BY p_size % 5) AS k FROM part)
    SELECT slot, s.env, background, p_partkey FROM s JOIN o ON s.env = o.env AND (r - 1) % k + 1 = o""")
def q_assign_balanced(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    slots = t.orders.select(F.col("o_orderkey").alias("slot"), F.col("o_custkey").alias("background"), (F.col("o_orderkey") % 5).alias("env"))
    objects = t.part.select("p_partkey", (F.col("p_size") % 5).cast("long").alias("env"))
    return X.assign_balanced(slots, objects, "env", "slot", "background", "p_partkey", 10)


@query(f"""WITH s AS (SELECT slot, env, row_number() OVER (PARTITION BY env ORDER BY {hash_sql(12, 'slot')}, slot) AS r FROM ({SLOTS})),
    p AS (SELECT s_suppkey, s_suppkey % 5 AS env, count(*) OVER (PARTITION BY s_suppkey % 5) AS k FROM supplier), n AS (SELECT env, count(*) AS slots FROM s GROUP BY env),
    c AS (SELECT p.*, unnest(range(0, (slots + k - 1) // k)) AS cycle FROM p JOIN n USING (env)), o AS (SELECT *, row_number() OVER (PARTITION BY env, cycle ORDER BY {hash_sql(12, 'cycle', 's_suppkey')}, s_suppkey) AS o FROM c)
    SELECT slot, s.env, s_suppkey, cycle FROM s JOIN o ON s.env = o.env AND (r - 1) // k = cycle AND (r - 1) % k + 1 = o""")
def q_rotate(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    slots = t.orders.select(F.col("o_orderkey").alias("slot"), (F.col("o_orderkey") % 5).alias("env"))
    pool_ = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 5).alias("env"))
    return X.rotate(slots, pool_, "env", "slot", "s_suppkey", 12)


@query("SELECT l_orderkey, l_linenumber, strict, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY strict DESC, l_extendedprice DESC, l_linenumber) AS rank FROM (SELECT *, l_quantity > 25 AND l_discount < 0.06 AS strict FROM lineitem)) WHERE rank <= 3")
def q_prefilter(spark, sf_dir) -> DataFrame:
    strict = (F.col("l_quantity") > 25) & (F.col("l_discount") < 0.06)
    out = X.prefilter(Tables(spark, sf_dir).lineitem, "l_orderkey", strict, [F.desc("l_extendedprice"), F.col("l_linenumber")], 3)
    return out.select("l_orderkey", "l_linenumber", "strict", "rank")


MIX = [("M0", "en", 200), ("M1", "en", 200), ("M1", "de", 50), ("M2", "fr", 10), ("M2", "es", 20)]


@query(f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hash_sql(13, 'doc_id')}, doc_id) AS rank FROM documents) SELECT experiment, lang, doc_id FROM r JOIN (VALUES {', '.join(map(str, MIX))}) m(experiment, lang, take) USING (lang) WHERE rank <= take")
def q_mixture(spark, sf_dir) -> DataFrame:
    rows = Tables(spark, sf_dir).documents.select("doc_id", "lang").withColumn("_d", hash_rank(13, F.col("doc_id")))
    ranked = X.digest_rank(rows, ["lang"], "_d", "doc_id", "rank")
    return X.build_mixture(spark.createDataFrame(MIX, "experiment string, lang string, take long"), ranked, "lang", "doc_id")


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hash_sql(13, 'doc_id')}, doc_id) AS rank FROM documents), m AS (SELECT * FROM (VALUES {', '.join(map(str, [*MIX, ('M9', 'fr', 10**9)]))}) m(experiment, lang, take)),
    c AS (SELECT experiment, lang, doc_id FROM r JOIN m USING (lang) WHERE rank <= take UNION ALL SELECT 'M0', lang, doc_id FROM r WHERE lang = 'en' AND rank <= 3)
    SELECT m.experiment, m.lang, 'count' AS reason, count(c.doc_id) - take AS n FROM m LEFT JOIN c ON m.experiment = c.experiment AND m.lang = c.lang GROUP BY m.experiment, m.lang, take HAVING count(c.doc_id) <> take
    UNION ALL SELECT experiment, NULL, 'repeated_key', count(*) FROM (SELECT experiment, doc_id FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY experiment""")
def q_mixture_checks(spark, sf_dir) -> DataFrame:
    rows = Tables(spark, sf_dir).documents.select("doc_id", "lang").withColumn("_d", hash_rank(13, F.col("doc_id")))
    ranked = X.digest_rank(rows, ["lang"], "_d", "doc_id", "rank")
    mix = spark.createDataFrame([*MIX, ("M9", "fr", 10**9)], "experiment string, lang string, take long")
    twice = ranked.where("lang = 'en' and rank <= 3").select(F.lit("M0").alias("experiment"), "lang", "doc_id")
    return X.check_mixture(mix, X.build_mixture(mix, ranked, "lang", "doc_id").unionByName(twice), "lang", "doc_id")


@query("SELECT h, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS h, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE h NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY h")
def q_background_pool(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return X.background_pool(docs.join(t.labels, "doc_id", "left_anti"), "h", "doc_id", docs.join(t.labels, "doc_id", "left_semi"))


@query(f"SELECT DISTINCT k AS doc_id FROM (SELECT arg_min(doc_id, (d, doc_id)) AS k FROM (SELECT doc_id, {hash_sql(14, 'doc_id')} AS d, unnest(['lang', 'source', 'band']) AS f, unnest([lang, source, (n_chars // 1000)::VARCHAR]) AS v FROM documents) GROUP BY f, v)")
def q_cover_sample(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents.select("doc_id", "lang", "source", F.floor(F.col("n_chars") / 1000).alias("band"))
    return X.cover_sample(docs, ["lang", "source", "band"], 14, "doc_id")


CASES = {"hardest": ("true", "score"), "hard_good": ("quality = 1", "score"), "easy_toxic": ("toxic = 1", "-score"), "unlabelled": ("quality IS NULL", "score"), "impossible": ("quality = 7", "score")}


def _cases_sql() -> str:
    parts, names = [f"p AS (SELECT * FROM ({POOL}) LEFT JOIN labels USING (doc_id))"], []
    for k, (name, (condition, score)) in enumerate(CASES.items()):
        used = " AND ".join(f"doc_id <> (SELECT doc_id FROM c{j})" for j in range(k)) or "true"
        parts.append(f"c{k} AS (SELECT '{name}' AS rule, doc_id FROM p WHERE {used} ORDER BY coalesce({condition}, false) DESC, {score} DESC NULLS LAST, doc_id LIMIT 1)")
        names.append(f"SELECT * FROM c{k}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(names)}"


@query(_cases_sql())
def q_pick_cases(spark, sf_dir) -> DataFrame:
    df = pool(Tables(spark, sf_dir)).join(Tables(spark, sf_dir).labels, "doc_id", "left")
    return X.pick_cases(df, [(name, F.expr(condition), F.expr(score)) for name, (condition, score) in CASES.items()], "doc_id")


@query("""WITH g AS (SELECT o_orderpriority AS experiment, seed, CASE o_orderpriority WHEN '5-LOW' THEN '3-MEDIUM' ELSE o_orderpriority END AS contract, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), (VALUES (0), (1), (2)) s(seed)),
    j AS (SELECT *, experiment || '_seed' || seed AS job, sha256(contract || '|' || seed) AS digest FROM g)
    SELECT experiment, seed, job, n, CASE WHEN min(job) OVER (PARTITION BY digest) <> job THEN min(job) OVER (PARTITION BY digest) END AS reuses FROM j""")
def q_grid(spark, sf_dir) -> DataFrame:
    n = Tables(spark, sf_dir).orders.groupBy(F.col("o_orderpriority").alias("experiment")).agg(F.count("*").alias("n"))
    conditions = n.withColumn("contract", F.when(F.col("experiment") == "5-LOW", "3-MEDIUM").otherwise(F.col("experiment")))
    return X.build_grid(conditions, spark.createDataFrame([(0,), (1,), (2,)], "seed int"), ["contract"]).select("experiment", "seed", "job", "n", "reuses")


@query("""WITH o AS (SELECT o_orderpriority AS e, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), j AS (SELECT CASE WHEN e = '5-LOW' AND s = 'F' THEN '1-URGENT_' || s ELSE e || '_' || s END AS job, CASE WHEN s = 'P' THEN e || '_F' END AS reuses, e || CASE WHEN e = '2-HIGH' AND s = 'P' THEN 'x' ELSE '' END AS digest, CASE WHEN e = '3-MEDIUM' THEN 'real#split=TEST' ELSE 'real#split=train' END AS dataset FROM o)
    SELECT job, 'repeated_job' AS reason FROM j GROUP BY job HAVING count(*) > 1 UNION ALL SELECT job, 'test_data' FROM j WHERE dataset ILIKE '%#split=test%' UNION ALL
    SELECT job, CASE WHEN t IS NULL THEN 'no_target' ELSE 'other_contract' END FROM (SELECT j.job, j.digest, k.job AS t, k.digest AS td FROM j LEFT JOIN (SELECT job, min(digest) AS digest FROM j WHERE reuses IS NULL GROUP BY job) k ON k.job = j.reuses WHERE j.reuses IS NOT NULL) WHERE t IS NULL OR digest <> td""")
def q_grid_checks(spark, sf_dir) -> DataFrame:
    n = Tables(spark, sf_dir).orders.groupBy(F.col("o_orderpriority").alias("e"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    named = lambda e, s: F.concat_ws("_", e, s)
    jobs = n.select(
        F.when((F.col("e") == "5-LOW") & (F.col("s") == "F"), named(F.lit("1-URGENT"), "s")).otherwise(named("e", "s")).alias("job"),
        F.when(F.col("s") == "P", named("e", F.lit("F"))).alias("reuses"),
        F.concat("e", F.when((F.col("e") == "2-HIGH") & (F.col("s") == "P"), "x").otherwise("")).alias("digest"),
        F.when(F.col("e") == "3-MEDIUM", "real#split=TEST").otherwise("real#split=train").alias("dataset"),
    )
    return X.check_grid(jobs, "job", "reuses", "digest", "dataset")


@query("""SELECT doc_id, 'length' AS stage, 'too_short' AS reason FROM documents WHERE n_chars < 300 UNION ALL SELECT doc_id, 'label', CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low_quality' END FROM labels WHERE toxic = 1 OR quality = 0
       UNION ALL SELECT doc_id, 'duplicate', NULL FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1""")
def q_split_log(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    short = t.documents.where("n_chars < 300").select("doc_id", F.lit("too_short").alias("reason"))
    labelled = t.labels.where("toxic = 1 or quality = 0").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("low_quality").alias("reason"))
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    later = docs.join(first, "h").where("doc_id <> first").select("doc_id")
    return stage_log({"length": short, "label": labelled, "duplicate": later}).select("doc_id", "stage", "reason")


@query("SELECT doc_id, CASE WHEN f IS NULL THEN 'MISSING' ELSE 'CHANGED' END AS status FROM (SELECT d.doc_id, sha256(d.text) AS m, f.h AS f FROM documents d LEFT JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 19 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE lang <> 'es') f USING (doc_id)) WHERE f IS NULL OR m <> f")
def q_verify_hashes(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    manifest = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    files = docs.where("lang <> 'es'").select("doc_id", F.sha2(F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    return I.verify_hashes(manifest, files, "doc_id", "h")


INVENTORY = f"SELECT doc_id % 9973 AS k, CASE WHEN doc_id % 31 = 0 THEN 'holdout' ELSE split END AS split, CASE WHEN doc_id % 37 = 0 THEN upper(h) ELSE h END AS h FROM ({SPLITS})"


@query(f"""WITH i AS ({INVENTORY}) SELECT * FROM (SELECT 'split' AS reason, count(*) FILTER (split NOT IN ('train', 'val', 'test')) AS n FROM i UNION ALL SELECT 'digest', count(*) FILTER (NOT regexp_matches(h, '^[0-9a-f]{{64}}$')) FROM i
       UNION ALL SELECT 'count_train', abs(count(*) FILTER (split = 'train') - 500) FROM i UNION ALL SELECT 'count_val', abs(count(*) FILTER (split = 'val') - 100) FROM i
       UNION ALL SELECT 'duplicate_key', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM i GROUP BY k HAVING count(*) > 1)) WHERE n > 0""")
def q_inventory_checks(spark, sf_dir) -> DataFrame:
    s = splits(Tables(spark, sf_dir))
    inv = s.select((F.col("doc_id") % 9973).alias("k"), F.when(F.col("doc_id") % 31 == 0, "holdout").otherwise(F.col("split")).alias("split"), F.when(F.col("doc_id") % 37 == 0, F.upper("h")).otherwise(F.col("h")).alias("h"))
    return I.check_inventory(inv, "k", "split", "h", ["train", "val", "test"], {"train": 500, "val": 100})


@query("SELECT c_custkey, sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name})::VARCHAR) AS row_digest FROM customer")
def q_row_digest(spark, sf_dir) -> DataFrame:
    return I.row_digest(Tables(spark, sf_dir).customer, ["c_name", "c_custkey", "c_mktsegment"]).select("c_custkey", "row_digest")


FILES = "SELECT source || '/' || doc_id || '.txt' AS path, n_chars, sha256(text) AS h FROM documents"


def files(t: Tables) -> DataFrame:
    return t.documents.select(F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "n_chars", F.sha2("text", 256).alias("h"))


@query(f"""WITH f AS (SELECT *, sha256(path) AS p, (SELECT CASE WHEN count(*) <= 64 THEN 0 WHEN count(*) <= 1024 THEN 1 WHEN count(*) <= 16384 THEN 2 END FROM documents) AS depth FROM ({FILES})),
    leaf AS (SELECT substr(p, 1, depth) AS p, depth, sha256(string_agg(l, chr(10) ORDER BY l)) AS d, count(*) AS files, sum(n_chars) AS bytes FROM (SELECT *, path || chr(9) || n_chars || chr(9) || h AS l FROM f) GROUP BY 1, 2),
    mid AS (SELECT substr(p, 1, 1) AS p, depth, CASE WHEN depth < 2 THEN any_value(d) ELSE sha256(string_agg(d, chr(10) ORDER BY p)) END AS d, sum(files) AS files, sum(bytes) AS bytes FROM leaf GROUP BY 1, 2)
    SELECT CASE WHEN depth = 0 THEN any_value(d) ELSE sha256(string_agg(d, chr(10) ORDER BY p)) END AS fingerprint, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM mid GROUP BY depth""")
def q_tree_fingerprint(spark, sf_dir) -> DataFrame:
    return I.tree_fingerprint(files(Tables(spark, sf_dir)), "path", "h", "n_chars", 64, 2)


@query(f"""WITH a AS ({FILES}), b AS (SELECT CASE WHEN doc_id % 211 = 5 THEN 'moved' ELSE source END || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 173 = 3 THEN n_chars + 1 ELSE n_chars END AS n_chars, sha256(CASE WHEN doc_id % 97 = 2 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 150 <> 7)
    SELECT path, CASE WHEN b.h IS NULL THEN 'MISSING' WHEN a.h IS NULL THEN 'ADDED' ELSE 'CHANGED' END AS status FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h OR a.n_chars IS DISTINCT FROM b.n_chars""")
def q_tree_difference(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = F.col("doc_id")
    path = F.concat_ws("", F.when(d % 211 == 5, "moved").otherwise(F.col("source")), F.lit("/"), d.cast("string"), F.lit(".txt"))
    later = t.documents.where(d % 150 != 7).select(path.alias("path"), F.when(d % 173 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"), F.sha2(F.when(d % 97 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    trees = [I.fingerprint_tree(x, "path", "h", "n_chars", 16) for x in (files(t), later)]
    return I.tree_difference(files(t), later, *trees, "path", "h", "n_chars")


#: Job graph over parts: each part depends on part // 3 and, if even, on the part before it.
GRAPH = "SELECT p_partkey AS node, p_partkey // 3 AS dependency FROM part WHERE p_partkey // 3 > 0 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 4 = 0 AND p_partkey // 2 > 0"


def graph(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey")
    a = p.select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 3").alias("dependency")).where("dependency > 0")
    return a.union(p.where("p_partkey % 4 = 0").select("p_partkey", F.expr("p_partkey div 2")).where("`(p_partkey div 2)` > 0")).distinct()


@query(f"WITH RECURSIVE e AS ({GRAPH}), r AS (SELECT p_partkey AS start, p_partkey AS node FROM part UNION SELECT r.start, e.dependency FROM r JOIN e ON e.node = r.node) SELECT start, node FROM r")
def q_upstream(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return I.upstream(graph(t), t.part.select(F.col("p_partkey").alias("node")))


@query(f"WITH RECURSIVE e AS ({GRAPH}), r AS (SELECT p_partkey AS start, p_partkey AS node FROM part UNION SELECT r.start, e.node FROM r JOIN e ON e.dependency = r.node) SELECT start, node FROM r")
def q_downstream(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return I.downstream(graph(t), t.part.select(F.col("p_partkey").alias("node")))


@query(f"WITH RECURSIVE e AS ({GRAPH}), r AS (SELECT p_partkey AS node, 0 AS level FROM part UNION SELECT e.node, r.level + 1 FROM r JOIN e ON e.dependency = r.node) SELECT node, max(level)::INT AS level, NULL::VARCHAR AS problem FROM r GROUP BY node")
def q_graph_levels(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return I.check_graph(t.part.select(F.col("p_partkey").alias("node")), graph(t))


@query(f"WITH RECURSIVE e AS ({GRAPH}), r AS (SELECT p_partkey AS start, p_partkey AS node FROM part UNION SELECT r.start, e.dependency FROM r JOIN e ON e.node = r.node) SELECT start, count(*) AS jobs, sum(p_size)::BIGINT AS size, round(sum(p_retailprice), 3) AS price, round(sum(p_retailprice) * 1.2, 3) AS price_with_margin FROM r JOIN part ON p_partkey = node GROUP BY start")
def q_closure_cost(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    costs = t.part.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    out = I.closure_cost(graph(t), t.part.select(F.col("p_partkey").alias("node")), costs, ["size", "price"], 1.2)
    return out.withColumns({"price": F.round("price", 3), "price_with_margin": F.round("price_with_margin", 3)})


@query("SELECT o_custkey, bool_and(o_totalprice > 1000) AS priced, bool_and(o_orderstatus IN ('O', 'F', 'P')) AS known, bool_and(o_orderpriority <> '5-LOW') AS urgent, bool_and(o_totalprice > 1000 AND o_orderstatus IN ('O', 'F', 'P') AND o_orderpriority <> '5-LOW') AS all_ok FROM orders GROUP BY 1")
def q_audit(spark, sf_dir) -> DataFrame:
    checks = {"priced": F.col("o_totalprice") > 1000, "known": F.col("o_orderstatus").isin("O", "F", "P"), "urgent": F.col("o_orderpriority") != "5-LOW"}
    return I.audit(Tables(spark, sf_dir).orders, "o_custkey", checks)


@query("SELECT code, n, action, CASE WHEN n > 0 THEN 'OPEN' ELSE 'CLEAR' END AS status FROM (SELECT 'NO_LABEL' AS code, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n, 'label' AS action UNION ALL SELECT 'SHORT', (SELECT count(*) FROM documents WHERE n_chars < 100), 'drop' UNION ALL SELECT 'NEGATIVE', (SELECT count(*) FROM documents WHERE n_chars < 0), 'stop')")
def q_issue_report(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return I.issue_report([("NO_LABEL", "label", t.documents.join(t.labels, "doc_id", "left_anti")), ("SHORT", "drop", t.documents.where("n_chars < 100")), ("NEGATIVE", "stop", t.documents.where("n_chars < 0"))])


@query(f"WITH s AS ({SIGNATURE}) SELECT a.doc_id AS a, b.doc_id AS b, (bit_count(xor(a.sig[1], b.sig[1])) + bit_count(xor(a.sig[2], b.sig[2])) + bit_count(xor(a.sig[3], b.sig[3])) + bit_count(xor(a.sig[4], b.sig[4])))::INT AS distance FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE distance <= 10")
def q_hamming_pairs(spark, sf_dir) -> DataFrame:
    return S.hamming_pairs(doc_signature(Tables(spark, sf_dir)), "doc_id", "sig", 128, 10)


@query(f"""WITH s AS ({SIGNATURE}), c AS (SELECT *, min(doc_id) OVER (PARTITION BY sig) AS u FROM s), r AS (SELECT * FROM c WHERE doc_id = u),
    l AS (SELECT a.u, count(*) AS n FROM r a JOIN r b ON a.u <> b.u AND bit_count(xor(a.sig[1], b.sig[1])) + bit_count(xor(a.sig[2], b.sig[2])) + bit_count(xor(a.sig[3], b.sig[3])) + bit_count(xor(a.sig[4], b.sig[4])) <= 10 GROUP BY a.u)
    SELECT doc_id, u AS class, coalesce(n, 0) AS n_links FROM c LEFT JOIN l USING (u)""")
def q_hamming_classes(spark, sf_dir) -> DataFrame:
    return S.hamming_classes(doc_signature(Tables(spark, sf_dir)), "doc_id", "sig", 128, 10)



PLACES = "SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"


def places(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))


@query(f"WITH p AS ({PLACES}) SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.25")
def q_near_positions(spark, sf_dir) -> DataFrame:
    return S.distance_pairs(places(Tables(spark, sf_dir)), "vec_id", "x", "y", 0.25, ["label"]).withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(x * y, 6) DESC, vec_id) AS n FROM ({PLACES})),
    near AS MATERIALIZED (SELECT a.label, a.n, coalesce(list(b.n) FILTER (b.n IS NOT NULL), []) AS near FROM p a LEFT JOIN p b ON a.label = b.label AND b.n < a.n AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.25 GROUP BY a.label, a.n),
    r AS (SELECT label, 0::BIGINT AS n, []::BIGINT[] AS taken FROM p GROUP BY label UNION ALL
          SELECT r.label, r.n + 1, CASE WHEN list_has_any(r.taken, near.near) THEN r.taken ELSE list_append(r.taken, near.n) END FROM r JOIN near ON near.label = r.label AND near.n = r.n + 1),
    last AS (SELECT label, arg_max(taken, n) AS taken FROM r GROUP BY label), t AS (SELECT label, unnest(taken) AS n, generate_subscripts(taken, 1) AS rank FROM last)
    SELECT vec_id, p.label, t.rank::INT AS rank FROM t JOIN p USING (label, n) WHERE t.rank <= 40""")
def q_suppress_positions(spark, sf_dir) -> DataFrame:
    df = places(Tables(spark, sf_dir)).withColumn("score", F.round(F.col("x") * F.col("y"), 6))
    return S.suppress_positions(df, "vec_id", ["label"], "x", "y", "score", 0.25, 40).select("vec_id", "label", "rank")


DIVERSE = {"de": 20, "en": 60, "es": 15, "fr": 20}


def _diverse_sql() -> str:
    strata = ", ".join(f"('{s}', {i}, {q})" for i, (s, q) in enumerate(sorted(DIVERSE.items())))
    d = " + ".join(f"bit_count(xor(a.sig[{i}], b.sig[{i}]))" for i in range(1, 5))
    return f"""WITH RECURSIVE o AS (SELECT * FROM (VALUES {strata}) v(lang, ord, quota)),
    s AS (SELECT doc_id, lang, score, sig FROM ({SCORED}) JOIN ({SIGNATURE}) USING (doc_id)),
    seq AS MATERIALIZED (SELECT doc_id, lang, 'quota' AS phase, quota, row_number() OVER (ORDER BY ord, score DESC, doc_id) AS n FROM s JOIN o USING (lang)
        UNION ALL SELECT doc_id, lang, 'fill', 120, (SELECT count(*) FROM s JOIN o USING (lang)) + row_number() OVER (ORDER BY score DESC, doc_id) FROM s),
    near AS MATERIALIZED (SELECT a.doc_id, list(b.doc_id) FILTER ({d} <= 10) AS n10, list(b.doc_id) FILTER ({d} <= 8) AS n8 FROM s a JOIN s b ON {d} <= 10 GROUP BY a.doc_id),
    step AS MATERIALIZED (SELECT seq.*, CASE phase WHEN 'quota' THEN n10 ELSE n8 END AS near FROM seq JOIN near USING (doc_id)),
    r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS taken, [0, 0, 0, 0] AS used, false AS took UNION ALL
          SELECT step.n, CASE WHEN go THEN list_append(r.taken, step.doc_id) ELSE r.taken END, CASE WHEN go AND step.phase = 'quota' THEN list_transform(r.used, lambda v, i: CASE WHEN i = o.ord + 1 THEN v + 1 ELSE v END) ELSE r.used END, go
          FROM r JOIN (SELECT * FROM step) step ON step.n = r.n + 1 JOIN o USING (lang), LATERAL (SELECT NOT list_has_any(r.taken, step.near) AND CASE step.phase WHEN 'quota' THEN r.used[o.ord + 1] < o.quota ELSE len(r.taken) < 120 END AS go) g)
    SELECT doc_id, lang, phase FROM r JOIN seq USING (n) WHERE took"""


@query(_diverse_sql())
def q_diverse_select(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    df = doc_signature(t).join(scored(t).select("doc_id", "lang", "score"), "doc_id")
    return S.diverse_select(df, "doc_id", "lang", "sig", "score", dict(sorted(DIVERSE.items())), 120, 128, 10, 8)
