"""Queries of normalising, ranking, sampling and series operators."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from ..operators import windows as W
from ..operators.selection import allocate
from .base import FEATURES, GROUPED, HARDNESS, SCORED, Tables, allocate_sql, doc_features, group_hash, hash_sql, norm_sql, query


def scored(t: Tables) -> DataFrame:
    df = W.hardness(doc_features(t), HARDNESS)
    return df.withColumn("score", F.round("score", 9))


@query(f"SELECT doc_id, round({norm_sql('n_words', True)}, 6) AS n_words_norm, round({norm_sql('digits', False)}, 6) AS digits_norm, round({norm_sql('n_chars', False, 'PARTITION BY lang')}, 6) AS n_chars_norm FROM ({FEATURES})")
def q_minmax(spark, sf_dir) -> DataFrame:
    df = W.minmax(doc_features(Tables(spark, sf_dir)), {"n_words": True, "digits": False})
    df = W.minmax(df, {"n_chars": False}, ["lang"])
    return df.select("doc_id", *[F.round(c, 6).alias(c) for c in ("n_words_norm", "digits_norm", "n_chars_norm")])


@query(f"SELECT doc_id, lang, round(score, 6) AS score FROM ({SCORED})")
def q_hardness(spark, sf_dir) -> DataFrame:
    return scored(Tables(spark, sf_dir)).select("doc_id", "lang", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM ({SCORED})")
def q_rank_in(spark, sf_dir) -> DataFrame:
    return W.score_rank(scored(Tables(spark, sf_dir)).select("doc_id", "lang", "score"), ["lang"], "score", ["doc_id"], "rank").select("doc_id", "lang", "rank")


QUOTAS = allocate_sql("SELECT lang, count(*) AS w FROM documents GROUP BY lang", "lang", "w", "120")


def quotas(t: Tables, n: int = 120) -> DataFrame:
    return allocate(t.documents.groupBy("lang").agg(F.count("*").alias("w")), "lang", "w", n).select("lang", "quota")


@query(f"SELECT doc_id, lang, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM ({SCORED})) JOIN ({QUOTAS}) USING (lang) WHERE rank <= quota")
def q_stratified_topk(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return W.stratified_topk(scored(t).select("doc_id", "lang", "score"), quotas(t), "lang", [F.desc("score"), F.col("doc_id")], most=120).select("doc_id", "lang", "rank")


@query(f"WITH q AS ({allocate_sql('SELECT lang, count(*) AS w FROM documents GROUP BY lang', 'lang', 'w', '900')}) SELECT lang, quota, count(doc_id) AS available, greatest(0, quota - count(doc_id)) AS short FROM q LEFT JOIN (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id)) USING (lang) GROUP BY lang, quota")
def q_shortage(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return W.shortage(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_semi"), quotas(t, 900), "lang")


@query(f"SELECT doc_id, sim_group IS NOT NULL AND row_number() OVER (PARTITION BY sim_group ORDER BY score DESC, doc_id) > 1 AS removed FROM ({GROUPED})")
def q_keep_best(spark, sf_dir) -> DataFrame:
    return W.keep_best(group_hash(scored(Tables(spark, sf_dir))), "sim_group", "score", "doc_id").select("doc_id", "removed")


@query(f"SELECT doc_id, {hash_sql(42, 'doc_id')} AS rank_digest FROM documents ORDER BY 2, 1 LIMIT 187")
def q_hash_sample(spark, sf_dir) -> DataFrame:
    return W.hash_sample(Tables(spark, sf_dir).documents.select("doc_id"), 187, 42, "doc_id")


@query(f"SELECT doc_id, source, rank::INT AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {hash_sql(5, 'doc_id')}, doc_id) AS rank FROM documents) WHERE rank <= 7")
def q_hash_sample_by(spark, sf_dir) -> DataFrame:
    return W.hash_sample_by(Tables(spark, sf_dir).documents.select("doc_id", "source"), "source", 7, 5, "doc_id").select("doc_id", "source", "rank")


@query("SELECT doc_id, source, turn::INT AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50")
def q_round_robin(spark, sf_dir) -> DataFrame:
    return W.round_robin(Tables(spark, sf_dir).documents.select("doc_id", "source"), "source", 50, "doc_id").select("doc_id", "source", "turn")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY user_id")
def q_extremes(spark, sf_dir) -> DataFrame:
    return W.extremes(Tables(spark, sf_dir).events, "user_id", ["ts", "event_id"], "event_id")


POOL = f"SELECT doc_id, CASE WHEN n_words >= 20 THEN round(2 - least(1.0, n_words / 500.0) - variety, 9) END AS score FROM ({FEATURES})"


def pool(t: Tables) -> DataFrame:
    return doc_features(t).select("doc_id", F.when(F.col("n_words") >= 20, F.round(2 - F.least(F.lit(1.0), F.col("n_words") / 500.0) - F.col("variety"), 9)).alias("score"))


CHOSEN = f"""WITH p AS (SELECT *, sha256('9:' || doc_id) AS d FROM ({POOL}) WHERE score IS NOT NULL), c AS (
    SELECT 'random' AS method, doc_id, row_number() OVER (ORDER BY d, doc_id) AS rank FROM p UNION ALL SELECT 'task', doc_id, row_number() OVER (ORDER BY score DESC, d, doc_id) FROM p)"""


def chosen(t: Tables) -> DataFrame:
    return W.compare_selections(pool(t).where("score is not null"), 60, 9, "doc_id", "score", F.col("score").between(0, 2))


@query(f"{CHOSEN} SELECT method, doc_id, rank FROM c WHERE rank <= 60")
def q_two_selections(spark, sf_dir) -> DataFrame:
    return chosen(Tables(spark, sf_dir))


@query(f"""{CHOSEN}, k AS (SELECT method, doc_id, lang, source FROM c JOIN documents USING (doc_id) WHERE rank <= 60)
    SELECT method, field, value, count(*) AS n FROM k UNPIVOT (value FOR field IN (lang, source)) GROUP BY ALL UNION ALL SELECT 'both', 'overlap', NULL, count(*) FROM (SELECT doc_id FROM k GROUP BY doc_id HAVING count(*) = 2)""")
def q_selection_statistics(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return W.selection_statistics(chosen(t), t.documents, "doc_id", ["lang", "source"])


@query(f"WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(1, 'vec_id')}, vec_id) AS rank FROM embeddings) SELECT * FROM r WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))")
def q_balance(spark, sf_dir) -> DataFrame:
    return W.balance(Tables(spark, sf_dir).embeddings.select("vec_id", "label"), "label", 1, "vec_id")


@query("SELECT doc_id, source, row_number() OVER w AS seq, source || '_' || lpad((row_number() OVER w)::VARCHAR, 6, '0') AS new_name FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def q_sequence_names(spark, sf_dir) -> DataFrame:
    return W.sequence_names(Tables(spark, sf_dir).documents.select("doc_id", "source"), "source", "doc_id", F.col("source"))


@query("SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn) AS last, count(DISTINCT turn) = count(*) AND max(turn) - min(turn) + 1 = count(*) AS continuous FROM conversations GROUP BY conv_id")
def q_series_continuity(spark, sf_dir) -> DataFrame:
    return W.check_series(Tables(spark, sf_dir).conversations, "conv_id", "turn")


@query("SELECT user_id, event_id AS best_pos, score AS best_score FROM (SELECT user_id, event_id, floor(value / 10) AS score, row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 10) DESC, event_id) AS r FROM events) WHERE r = 1")
def q_best_of(spark, sf_dir) -> DataFrame:
    events = Tables(spark, sf_dir).events.select("user_id", "event_id", F.floor(F.col("value") / 10).cast("double").alias("score"))
    return W.best_of(events, "user_id", "score", "event_id")


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS step, count(value) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sample_sd FROM events GROUP BY ALL")
def q_curve(spark, sf_dir) -> DataFrame:
    out = W.curve(Tables(spark, sf_dir).events, ["event_type"], F.window("ts", "1 day")["start"], "value")
    return out.withColumns({"step": F.col("step").cast("timestamp_ntz"), "mean": F.round("mean", 8), "sample_sd": F.round("sample_sd", 8)})


@query("SELECT user_id, event_id, done, round(greatest(0, 200 - done) * recent, 7) AS remaining FROM (SELECT user_id, event_id, row_number() OVER w AS done, avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def q_eta(spark, sf_dir) -> DataFrame:
    return W.eta(Tables(spark, sf_dir).events, "user_id", ["ts", "event_id"], "value", 200).select("user_id", "event_id", "done", F.round("remaining", 7).alias("remaining"))


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, count(*) OVER (PARTITION BY l_orderkey) AS size,
    ['best', 'top3', 'top5', 'pool'][l_orderkey % 4 + 1] AS mode FROM lineitem), p AS (SELECT *, least(CASE mode WHEN 'best' THEN 1 WHEN 'top3' THEN 3 WHEN 'top5' THEN 5 ELSE greatest(3, floor(size / 10))::BIGINT END, size) AS pool FROM r)
    SELECT l_orderkey, l_linenumber, mode, rank FROM p WHERE rank = ('0x' || substr({hash_sql(2, 'l_orderkey')}, 1, 8))::BIGINT % pool + 1""")
def q_choose_by_mode(spark, sf_dir) -> DataFrame:
    mode = F.get(F.array(*[F.lit(m) for m in ("best", "top3", "top5", "pool")]), (F.col("l_orderkey") % 4).cast("int"))
    lines = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return W.choose_by_mode(lines, "l_orderkey", mode, "l_extendedprice", "l_linenumber", 2).select("l_orderkey", "l_linenumber", "mode", "rank")


WEIGHTS = {"tone": 0.4, "texture": 0.3, "edge": 0.2, "placement": 0.1}
PARTS = "SELECT l_orderkey, l_linenumber, l_discount / 0.1 AS tone, l_tax / 0.08 AS texture, l_quantity / 50.0 AS edge, l_partkey % 7 / 6.0 AS placement FROM lineitem"


def _ablation_sql() -> str:
    conditions = ["full", *[f"no_{c}" for c in WEIGHTS]]
    scores = {cond: " + ".join(f"{0.0 if cond == f'no_{c}' else w} * {c}" for c, w in WEIGHTS.items()) for cond in conditions}
    parts = [f"SELECT l_orderkey, '{cond}' AS condition, l_linenumber, round(s, 9) AS final_score FROM (SELECT *, {s} AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY {s} DESC, l_linenumber) AS r FROM c) WHERE r = 1" for cond, s in scores.items()]
    random = f"SELECT l_orderkey, 'random', l_linenumber, NULL FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {hash_sql(11, 'l_orderkey', 'l_linenumber')}, l_linenumber) AS r FROM c) WHERE r = 1"
    return f"WITH c AS ({PARTS}) " + " UNION ALL ".join([*parts, random])


@query(_ablation_sql())
def q_ablation_select(spark, sf_dir) -> DataFrame:
    df = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") / 0.1).alias("tone"), (F.col("l_tax") / 0.08).alias("texture"), (F.col("l_quantity") / 50.0).alias("edge"), (F.col("l_partkey") % 7 / 6.0).alias("placement"))
    conditions = ["full", *[f"no_{c}" for c in WEIGHTS], "random"]
    return W.select_candidate(df, "l_orderkey", "l_linenumber", list(WEIGHTS), WEIGHTS, conditions, 11).withColumn("final_score", F.round("final_score", 9))


COMMITS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag"


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY {COMMITS}) AS seq, row_number() OVER (PARTITION BY l_partkey ORDER BY {COMMITS}) - 1 AS used,
       row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY {COMMITS}) - 1 AS du, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {COMMITS}) - 1 AS bu FROM lineitem),
       g AS (SELECT *, greatest(0, 40 - used) AS remaining_quota, greatest(0, 40 - used) / 40.0::DOUBLE AS quota_bonus, du::DOUBLE / CASE l_returnflag WHEN 'A' THEN 1 ELSE 5 END AS domain_repeat_penalty, bu::DOUBLE AS background_repeat_penalty,
       coalesce(seq - lag(seq) OVER (PARTITION BY l_partkey ORDER BY seq) <= 4, false)::INT::DOUBLE AS recent_history_penalty, CASE WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS coarse_domain_penalty FROM s)
       SELECT l_orderkey, l_linenumber, l_partkey, used, remaining_quota, round(quota_bonus, 6) AS quota_bonus, round(domain_repeat_penalty, 6) AS domain_repeat_penalty, background_repeat_penalty, recent_history_penalty,
       round(0.06 * quota_bonus - 0.08 * domain_repeat_penalty - 0.18 * background_repeat_penalty - 0.10 * recent_history_penalty - 0.30 * coarse_domain_penalty, 8) AS adjustment FROM g""")
def q_usage_guidance(spark, sf_dir) -> DataFrame:
    coarse = F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 3 == 0), 0.5).otherwise(0.0)
    lines = Tables(spark, sf_dir).lineitem.select(*COMMITS.split(", "))
    out = W.usage_guidance(lines, "l_partkey", "l_returnflag", "l_suppkey", COMMITS.split(", "), 40, {"A": 1}, coarse=coarse)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "used", "remaining_quota", F.round("quota_bonus", 6).alias("quota_bonus"), F.round("domain_repeat_penalty", 6).alias("domain_repeat_penalty"), "background_repeat_penalty", "recent_history_penalty", F.round("adjustment", 8).alias("adjustment"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q_latest_state(spark, sf_dir) -> DataFrame:
    return W.latest(Tables(spark, sf_dir).events, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("SELECT user_id, event_id, row_number() OVER w AS attempt, round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 3) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_attempts(spark, sf_dir) -> DataFrame:
    events = Tables(spark, sf_dir).events.withColumn("ts", F.col("ts").cast("timestamp"))
    return W.attempts(events, "user_id", ["ts", "event_id"], "ts").select("user_id", "event_id", "attempt", F.round("seconds", 3).alias("seconds"))


@query("SELECT user_id, event_id, round(gap, 3) AS idle_seconds FROM (SELECT user_id, event_id, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap > 43200")
def q_idle_gaps(spark, sf_dir) -> DataFrame:
    events = Tables(spark, sf_dir).events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = W.attempts(events, "user_id", ["ts", "event_id"], "ts").where("seconds > 43200")
    return out.select("user_id", "event_id", F.round("seconds", 3).alias("idle_seconds"))


@query("SELECT user_id, event_id, round(sum(value) OVER w, 3) AS active, sum(value) OVER w > 2000 AS over_budget FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def q_activity_ledger(spark, sf_dir) -> DataFrame:
    total = F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return Tables(spark, sf_dir).events.select("user_id", "event_id", F.round(total, 3).alias("active"), (total > 2000).alias("over_budget"))
