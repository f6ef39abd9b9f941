"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

#: Training documents of each label at most; chosen by a hash of the id.
TRAINED = {1: 6000, 0: 12000}
#: Features at most, and the least number of toxic training documents that hold one.
FEATURES, LEAST = 4000, 4
SENTENCE = re.compile(r"[^.!?\n]+")
_BLANK = str.maketrans({c: " " for c in string.punctuation + "«»„“”‘’…¿¡"})


def features(words: list[str] | set[str]) -> set[str]:
    """Words and their beginnings of four and five letters, marked by *."""
    return {*words, *[f"{w[:4]}*" for w in words if len(w) > 4], *[f"{w[:5]}*" for w in words if len(w) > 5]}


def split_words(text: str) -> list[str]:
    return text.lower().translate(_BLANK).split()


@dataclass
class Model:
    """Weights of sentence features: p(sentence) = logistic(bias + sum of weights); sentences without a feature count as 0."""

    weights: dict[str, float]
    bias: float

    def sentences(self, text: str) -> Iterator[tuple[float, int, int]]:
        """(p, start, end) of the sentences that hold a feature; places in code points, end exclusive."""
        if self.weights.keys().isdisjoint(features(set(split_words(text)))):
            return
        for m in SENTENCE.finditer(text):
            if found := self.weights.keys() & features(set(split_words(m.group()))):
                yield 1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in sorted(found))))), m.start(), m.end()

    def score(self, text: str) -> tuple[float, int, int]:
        """Noisy-or of the sentences, and the place of the worst one (0, 0 without any)."""
        clean, worst = 1.0, (0.0, 0, 0)
        for s in self.sentences(text):
            clean *= 1 - s[0]
            worst = max(worst, (s[0], -s[1], s[2]))
        return min(1.0, max(0.0, 1 - clean)), -worst[1], worst[2]


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 7) -> Model:
    """Fits a Model on rows of docs whose label is 0 or 1 and for which learn (of the column id) holds.

    Of each label, TRAINED documents at most, taken by a hash of the id. First the features are counted over these
    documents and the ones that speak most for label 1 are kept; then the sentences that hold any are fitted by
    Adam on the noisy-or likelihood. Without documents of either label nothing is learned and every score is 0.
    """
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null").where(learn).groupBy("id").agg(F.max("y").alias("y"))
    parts = [named.where(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(n) for y, n in TRAINED.items()]
    chosen = parts[0].union(parts[1])
    label_of = dict(chosen.collect())  # TRAINED rows at most
    if len(set(label_of.values())) < 2:
        return Model({}, 0.0)
    held = docs.sparkSession.createDataFrame(list(label_of.items()), "id long, y int")
    rows = texts(docs, id_col, text_col).join(F.broadcast(held.select("id")), "id")  # as bounded as TRAINED
    counts = map_rows(rows, lambda: lambda ids, raw: _count(ids, raw, label_of), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = Counter(label_of.values())
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    picked = counts.where(F.col("toxic") >= LEAST).withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "feature").limit(FEATURES)
    vocabulary = {r["feature"]: i for i, r in enumerate(picked.select("feature").collect())}
    bags = map_rows(rows, lambda: lambda ids, raw: _bags(ids, raw, vocabulary), "id long, sentence int, feature int").toPandas()
    return _fit(bags, label_of, vocabulary, seed)


def _count(ids: list, raw: list, label_of: dict) -> dict:
    by = {0: Counter(), 1: Counter()}
    for i, x in zip(ids, raw, strict=True):
        by[label_of[i]].update(features(set(split_words(x.decode()))))
    names = list({**by[0], **by[1]})
    return {"feature": names, "toxic": [by[1][f] for f in names], "clean": [by[0][f] for f in names]}


def _bags(ids: list, raw: list, vocabulary: dict) -> dict:
    out = {"id": [], "sentence": [], "feature": []}
    for i, x in zip(ids, raw, strict=True):
        text = x.decode()
        if vocabulary.keys().isdisjoint(features(set(split_words(text)))):
            continue
        for k, m in enumerate(SENTENCE.finditer(text)):
            for f in sorted(vocabulary.keys() & features(set(split_words(m.group())))):
                for name, v in zip(out, (i, k, vocabulary[f])):
                    out[name].append(v)
    return out


def _fit(bags, label_of: dict, vocabulary: dict, seed: int, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    if not len(bags):
        return Model({}, 0.0)
    bags = bags.drop_duplicates()
    sentence, keys = bags.groupby(["id", "sentence"], sort=True).ngroup().to_numpy(), bags.drop_duplicates(["id", "sentence"]).sort_values(["id", "sentence"])
    doc_ids, doc = np.unique(keys["id"].to_numpy(), return_inverse=True)
    y = np.array([label_of[i] for i in doc_ids.tolist()], float)
    feature, n_sentences = bags["feature"].to_numpy(), len(keys)
    w, b = np.zeros(len(vocabulary)), -1.0
    state = np.zeros((2, len(w) + 1))
    for t in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[feature], n_sentences)
        p = 1 / (1 + np.exp(-z))
        rest = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))  # log of the chance that no sentence is toxic
        some = -np.expm1(rest)
        slope = np.where(y == 1, -np.exp(rest) / np.maximum(some, 1e-9), 1.0) / len(y)  # of the loss, by -log(1 - p)
        dz = slope[doc] * p
        g = np.append(np.bincount(feature, dz[sentence], len(w)) + ridge * w, dz.sum())
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model({f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-6}, float(b))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, score (0 to 1), predicted (1 if score >= 0.5), worst_start, worst_end.

    The place of the worst sentence counts code points. Null and empty texts, and those without a feature, have
    score 0 and the place 0, 0. Repeated rows are scored each; further columns are left out, but for those named in
    keep; an empty table gives an empty result.
    """
    if keep:
        whole = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        score = _score_column(model)
        return whole.withColumn("score", score("text")).select("row.*", "score")

    def make():
        def step(ids: list, raw: list) -> dict:
            s = [model.score(x.decode()) for x in raw]
            return {"id": ids, "score": [x[0] for x in s], "predicted": [int(x[0] >= 0.5) for x in s], "worst_start": [x[1] for x in s], "worst_end": [x[2] for x in s]}

        return step

    return map_rows(texts(docs, id_col, text_col), make, "id long, score double, predicted int, worst_start long, worst_end long").withColumnRenamed("id", id_col)


def _score_column(model: Model):
    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array([model.score(x)[0] for x in rows.to_pylist()], pa.float64())

    return score
