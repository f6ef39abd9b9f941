"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .centroids import centroid_clusters
from .common import table
from .embeddings import embedding_groups
from .importance import importance_sample
from .licenses import licenses
from .lines import line_dedup
from .packing import pack
from .quality import STOP_WORDS, THRESHOLDS, quality
from .simhash import simhash_groups
from .substring import substring_dedup
from .topk import top_k
from .toxicity import toxicity, train
from .wfst import sentencepiece_ids


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secrets(docs, secrets.train(docs))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ids(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def held_out(col: str):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5)) == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out("id"))
    return toxicity(docs, model).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_secrets, op3_sentencepiece, op4_substring, op5_lines, op6_embeddings, op7_packing, op8_quality, op9_toxicity, op10_licenses, op11_topk, op12_importance, op13_centroids)}


def _op8_sql() -> str:
    tests = " AND ".join(f"{m} {op} {v}" for m, least, most in THRESHOLDS for op, v in ((">=", least), ("<=", most)) if v is not None)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{word}+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
    win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM
            (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
                 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
                 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
                 len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stop_words
          FROM w LEFT JOIN covered USING (r)),
    q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars,
                 CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbols_per_word,
                 CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
                 n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND {tests} AS kept, round(mean_word_chars, 6) AS mean_word_chars,
           round(symbols_per_word, 6) AS symbols_per_word, stop_words::BIGINT AS stop_words,
           round(dup_line_share, 6) AS dup_line_share FROM q"""


_OP4_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM
            (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
    dup AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE low < doc_id),
    gone AS (SELECT r, list(DISTINCT i + k) AS places FROM dup, range(13) t(k) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i))) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN gone USING (r)"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP11_SQL = f"""
    WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE {_FINITE} AND len(embedding) > 0),
    s AS (SELECT q.r, q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.x, e.x), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM e q JOIN e ON q.r <> e.r AND len(q.x) = len(e.x) WHERE q.vec_id % 100 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10"""

#: CRC-32 of a word in SQL: a table worked out from the polynomial, then a byte at a time over the hexadecimal digits of the word.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_OP12_SQL = rf"""
    WITH t0 AS (SELECT range AS i, range::BIGINT AS c FROM range(256)),
    {" ".join(f"t{k + 1} AS (SELECT i, {_STEP} AS c FROM t{k})," for k in range(8))}
    tab AS (SELECT list(c ORDER BY i) AS tab FROM t8),
    w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    d AS (SELECT r, unnest(w) AS w FROM w),
    x AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM g)),
    b AS (SELECT w, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS b FROM x),
    c AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1]))) % 10000 AS bucket FROM b, tab),
    s AS (SELECT bucket, count(*) AS s FROM d JOIN c USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM g JOIN c USING (w) GROUP BY bucket),
    gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
    m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN c USING (w) JOIN gain USING (bucket) GROUP BY r),
    f AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (r)),
    z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, doc_id IS NOT NULL AND n_features >= 20 AS fit FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS k, (SELECT count(*) FROM z WHERE fit) * 10 // 100 AS n FROM z)
    SELECT doc_id, n_features, weight, score, CASE WHEN fit AND k <= n THEN k END AS rank FROM o"""


def _op13_sql(rounds: int = 3) -> str:
    distance = "list_sum(list_transform(list_zip(e.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = []
    for k in range(rounds + 1):
        parts.append(f"a{k} AS (SELECT r, any_value(e.vec_id) AS vec_id, any_value(e.x) AS x, arg_min(c.c, ({distance}, c.c)) AS c, min({distance}) AS d FROM e, c{k} c GROUP BY r)")
        if k < rounds:
            parts.append(f"s{k} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range(64)) AS i FROM a{k}) GROUP BY c, i)")
            parts.append(f"m{k} AS (SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{k} GROUP BY c)")
            parts.append(f"c{k + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON c.c = m.c)")
    return f"""
    WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
    c0 AS (SELECT c, x FROM (SELECT x, (row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) - 1)::INT AS c FROM e) WHERE c < 16),
    {", ".join(parts)}
    SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


SQL = {"op4_substring": _OP4_SQL, "op8_quality": _op8_sql(), "op11_topk": _OP11_SQL, "op12_importance": _OP12_SQL, "op13_centroids": _op13_sql()}
