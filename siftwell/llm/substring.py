"""Substring dedup by super-k-mer partitioning: runs of windows that share a minimiser travel as one packed string."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_parts, texts
from .sift import bit_filter, inside_filter, pressed, slot
from .wordhash import mix, open_bytes, press_bytes, words_in

#: Words of a window and of the m-mers whose least hash is its minimiser.
WINDOW, MER = 13, 3
#: A minimiser with this share of all super-k-mers is ranked behind all others; so there are 1000 such at most.
HOT_SHARE = 1e-3
#: Bytes of super-k-mers a bucket is meant to hold.
BUCKET_BYTES = 32 << 20


class Runs:
    """Super-k-mers of many texts: key (hash of the minimiser), part, first word in the part, windows, text."""

    def __init__(self, parts: list[bytes], hot: np.ndarray, window: int = WINDOW, mer: int = MER):
        self.words = w = words_in(parts)
        n = len(w.start) - window + 1
        if n <= 0:
            self.first = self.size = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        g = w.hash[: len(w.hash) - mer + 1].copy()
        for k in range(1, mer):
            g = mix(g + w.hash[k : len(w.hash) - mer + 1 + k])
        rank = g >> np.uint64(1)
        if len(hot):
            rank |= np.isin(g, hot).astype(np.uint64) << np.uint64(63)
        best, at = rank[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, window - mer + 1):
            less = rank[k : k + n] < best
            best[less], at[less] = rank[k : k + n][less], k
        at += np.arange(n)
        whole = np.flatnonzero(w.part[:n] == w.part[window - 1 :])
        new = np.ones(len(whole), bool)
        new[1:] = (np.diff(whole) != 1) | (np.diff(at[whole]) != 0)
        self.first, heads = whole[new], np.flatnonzero(new)
        self.size = np.diff(np.append(heads, len(whole)))
        self.key = g[at[self.first]]
        self.window = window

    def text(self, i: int) -> bytes:
        a = self.first[i]
        return self.words.buf[self.words.start[a] : self.words.end[a + self.size[i] + self.window - 2]]


def _rows(docs: DataFrame) -> DataFrame:
    """A row is known by its id and a hash of its text, so repeated ids do not mix."""
    return docs.select("id", F.hash("text").alias("h"), "text")


def hot_minimisers(rows: DataFrame, share: float = HOT_SHARE) -> tuple[np.ndarray, int]:
    """Minimisers with `share` of the super-k-mers of all rows, 1/share of them at most; bytes of all texts.

    Each task counts all of its super-k-mers and hands on those with that share of a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for part in small_parts(batch):
                raw = part.column("text").cast(pa.binary()).to_pylist()
                runs = Runs(raw, none)
                key, n = np.unique(runs.key, return_counts=True)
                often = n >= max(16, share * len(runs.key))
                total = [len(runs.key)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(key[often], np.uint64(0)).view(np.int64)), pa.array([*n[often].tolist(), 0], pa.int64()), pa.array([0] * int(often.sum()) + total, pa.int64()), pa.array([0] * int(often.sum()) + [sum(map(len, raw))], pa.int64())],
                    names=["key", "n", "runs", "bytes"],
                )

    counts = rows.select("text").mapInArrow(run, "key long, n long, runs long, bytes long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"), F.sum("bytes").alias("bytes"))
    counts = saved(counts)
    total = counts.agg(F.sum("runs"), F.sum("bytes")).first()
    least = max(16, int(share * (total[0] or 0)))
    hot = [r["key"] for r in counts.where(F.col("n") >= least).select("key").collect()]
    return np.sort(np.array(hot, np.int64).view(np.uint64)), total[1] or 0


def covered(rows: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(id, h, start, words): word ranges of rows (id, h, text) whose windows also start in a smaller id."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch):
                yield from _send(part, hot, buckets)

    def meet(table: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        sent = [pickle.loads(open_bytes(x)) for x in table.column("blob").to_pylist()]
        for known, *rest in sent:
            for c, v in zip(out, rest[0] if known else ()):
                c.extend(v)
        _meet([x for x in sent if not x[0]], out)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["id", "h", "start", "words"])

    sent = rows.where("id is not null").mapInArrow(send, "bucket int, blob binary")
    return sent.groupBy("bucket").applyInArrow(meet, "id long, h int, start int, words int")


def _send(part: pa.RecordBatch, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed super-k-mers by bucket. Of equal ones only those of the smallest id travel: all windows of the others
    start in that smaller id too, so their words are known to go."""
    ids, hs = (part.column(c).to_numpy() for c in ("id", "h"))
    runs = Runs(part.column("text").cast(pa.binary()).to_pylist(), hot)
    if not len(runs.first):
        return
    w = runs.words
    owner = w.part[runs.first]
    id_, h = ids[owner], hs[owner]
    base = np.searchsorted(w.part, owner)
    start = (runs.first - base).astype(np.int64)
    text = [runs.text(i) for i in range(len(runs.first))]
    least: dict[bytes, int] = {}
    for x, i in zip(text, id_.tolist(), strict=True):
        if least.setdefault(x, i) > i:
            least[x] = i
    later = np.fromiter(map(least.__getitem__, text), np.int64, len(text)) < id_
    bucket = (mix(runs.key) % np.uint64(buckets)).astype(np.int64)
    blobs: list[tuple[int, bytes]] = []
    go = np.flatnonzero(~later)
    go = go[np.argsort(bucket[go], kind="stable")]
    for group in np.split(go, np.flatnonzero(np.diff(bucket[go])) + 1) if len(go) else []:
        data = (False, (runs.key[group] >> np.uint64(32)).astype(np.uint32), np.diff(id_[group], prepend=0), h[group], start[group].astype(np.int32), runs.size[group].astype(np.uint8), b"\n".join([text[i] for i in group]))
        blobs.append((int(bucket[group[0]]), press_bytes(pickle.dumps(data, 5))))
    known = np.flatnonzero(later)
    if len(known):
        ranges = (id_[known].tolist(), h[known].tolist(), start[known].tolist(), (runs.size[known] + runs.window - 1).tolist())
        blobs.append((int(mix(id_[known[:1]].view(np.uint64))[0] % np.uint64(buckets)), press_bytes(pickle.dumps((True, ranges), 5))))
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["bucket", "blob"])


def _meet(sent: list[tuple], out: list[list]) -> None:
    """Sorts the windows of each minimiser that several ids have, and marks those behind the smallest id.

    Half of a minimiser's hash travels; should two share it, their windows are sorted together and stay apart.
    """
    if not sent:
        return
    key, hs, start, size = (np.concatenate([x[k] for x in sent]) for k in (1, 3, 4, 5))
    ids = np.concatenate([np.cumsum(x[2]) for x in sent])
    text = [t for x in sent for t in x[6].split(b"\n")]
    order = np.lexsort((ids, key))
    heads = np.append(np.flatnonzero(np.append(True, np.diff(key[order]) != 0)), len(order))
    first, last = ids[order[heads[:-1]]], ids[order[heads[1:] - 1]]
    for g in np.flatnonzero(first != last):
        members = order[heads[g] : heads[g + 1]]
        windows = []
        for i in members.tolist():
            w = text[i].split(b" ")
            windows += [(b" ".join(w[k : k + WINDOW]), int(ids[i]), i, k) for k in range(int(size[i]))]
        windows.sort()
        marked: dict[int, list[int]] = {}
        word, low = None, 0
        for x, id_, i, k in windows:
            if x != word:
                word, low = x, id_
            elif id_ > low:
                marked.setdefault(i, []).append(k)
        for i, ks in marked.items():
            ks.sort()
            cuts = np.flatnonzero(np.diff(ks) != 1) + 1
            for run in np.split(np.array(ks), cuts):
                for c, v in zip(out, (int(ids[i]), int(hs[i]), int(start[i] + run[0]), int(run[-1] - run[0]) + WINDOW), strict=True):
                    c.append(v)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    A window is 13 consecutive words; each word covered by a window whose words also stand in a document with a
    smaller id goes. Windows meet others only in the bucket of their minimiser, where they are sorted; a minimiser
    that stands in very many is ranked last, so its windows are dealt out by the next one. Texts shorter than a
    window, empty and null ones lose nothing. Rows with a null id are returned whole and make no other row lose
    words. Rows that share an id never lose words to each other; further columns are ignored; an empty table gives an
    empty result.
    """
    rows = _rows(texts(docs, id_col, text_col))
    spark = docs.sparkSession
    hot, size = hot_minimisers(rows)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * size // BUCKET_BYTES)
    ranges = covered(rows, hot, buckets).distinct()
    lists = saved(ranges.groupBy("id", "h").agg(F.collect_list(F.struct("start", "words")).alias("ranges")))
    bits = bit_filter(lists.select(slot("id", "h")))
    mask = spark.sparkContext.broadcast(bits)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n": [], "gone": [], "sha": [], "text": []}
            packed = "packed" in batch.schema.names
            if not packed:  # texts that lose nothing
                batch = inside_filter(batch, mask.value, False)
            raw = map(open_bytes, batch.column("packed").to_pylist()) if packed else batch.column("text").cast(pa.binary()).to_pylist()
            for x, found in zip(raw, batch.column("ranges").to_pylist() if packed else repeat(None, batch.num_rows), strict=True):
                w = x.split()
                keep = np.ones(len(w), bool)
                for r in found or ():
                    keep[r["start"] : r["start"] + r["words"]] = False
                left = b" ".join([w[i] for i in np.flatnonzero(keep)] if found else w)
                for c, v in zip(out, (len(w), int(len(w) - keep.sum()), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None)):
                    out[c].append(v)
            columns = [batch.column("id"), pa.array(out["n"], pa.int64()), pa.array(out["gone"], pa.int64()), pa.array(out["sha"], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(out["text"], pa.string())] * with_text], names=[id_col, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    cut = pressed(rows, bits, 3).join(lists, ["id", "h"], "left").select("id", "packed", "ranges")
    return cut.mapInArrow(finish, schema).union(rows.select("id", "text", slot("id", "h")).mapInArrow(finish, schema))
