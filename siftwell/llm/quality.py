"""Quality rules: a threshold table compiled into one Spark projection. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is was for on that with as it by this be are or an at he from "
    "der die das und ist von zu den mit ein eine in auf des dem nicht "
    "le la les de des du et un une est en que pour dans par il "
    "el los las y un una es por con del que no se su"
).split()

#: measure, least, most (None: open). A text is kept if each measure lies in its range, ends included.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", None, 1.0),
    ("stop_words", 2.0, None),
    ("dup_line_share", None, 0.6),
)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """One row per row of docs: id, counts, base_failed, kept and the measures of the threshold table.

    Words are [^\\x20\\x09-\\x0D]+. n_dup_lines counts lines that hold a word and equal an earlier line;
    n_repeat_words the words in 3-word windows found twice or more in the text. Windows are told apart by a
    64-bit hash and sorted inside their row, so a text of n words costs n log n and nothing is shuffled.
    Null and empty texts have no words: all counts 0, base_failed, not kept. Repeated rows are judged each;
    further columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select(
        "id",
        words_of(F.col("text")).alias("w"),
        F.length(F.translate("text", SPACES, "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.select(
        "id",
        F.size("w").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).alias("stop_words"),
        F.sort_array(_windows("w")).alias("s"),
    )
    rows = rows.withColumn("p", F.sort_array(F.transform(_repeated("s"), lambda x: x["p"]))).drop("s")
    steps = F.transform("p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1), p + 3) - p))
    rows = rows.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda a, x: a + x)).drop("p")
    rows = rows.withColumns(
        {
            "mean_word_chars": _ratio("word_chars", "n_words"),
            "symbols_per_word": _ratio("n_symbols", "n_words"),
            "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        }
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words").cast("long") > most_repeat_percent * F.col("n_words").cast("long"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        F.col("id").alias(id_col),
        *[F.col(c).cast("long").alias(c) for c in counts],
        failed.alias("base_failed"),
        (~failed & verdict(thresholds)).alias("kept"),
        F.round("mean_word_chars", 6).alias("mean_word_chars"),
        F.round("symbols_per_word", 6).alias("symbols_per_word"),
        F.col("stop_words").cast("long").alias("stop_words"),
        F.round("dup_line_share", 6).alias("dup_line_share"),
    )


def verdict(thresholds) -> Column:
    """The threshold table as one boolean expression."""
    out = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            out &= F.col(name) >= F.lit(float(least))
        if most is not None:
            out &= F.col(name) <= F.lit(float(most))
    return out


def _windows(w: str) -> Column:
    at = F.sequence(F.lit(0), F.size(w) - 3)
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
    return F.when(F.size(w) >= 3, F.transform(at, window)).otherwise(F.transform(F.array().cast("array<int>"), window))


def _repeated(s: str) -> Column:
    same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
    return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
