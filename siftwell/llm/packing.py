"""Bulk-synchronous best-fit packing of token sequences: range-sorted runs, successor sweeps, ranks, updated gaps."""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, remembered, saved, texts

#: Fixed value: the pattern by which a byte-level pre-tokenizer cuts a text.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges of gaps that are matched at the same time.
RANGES = 16
#: What a row of a superstep is, and its columns.
DOCUMENT, GAP, PLACED = 0, 1, 2
RUNS = ("kind", "size", "first", "n", "seq", "offset")


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> their ids as little-endian 32-bit integers, equal to those of the tokenizers library.

    The merges of a byte-level BPE file are read as ranks, with which tiktoken encodes the same ids in a third of the time.
    Where the file is not of that form, or a text holds one of its special tokens, the tokenizers library itself encodes.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = lambda rows: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    before, model = form.get("pre_tokenizer") or {}, form["model"]
    if (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space"), model["type"], form.get("normalizer")) != ("ByteLevel", True, False, "BPE", None):
        return plain
    special = [x["content"] for x in form["added_tokens"]]
    letter = _byte_letters()
    ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(rows: list[str]) -> list[bytes]:
        slow = [any(t in x for t in special) for x in rows]
        other = iter(plain([x for x, s in zip(rows, slow) if s]))
        return [next(other) if s else np.array(fast.encode_ordinary(x), "<u4").tobytes() for x, s in zip(rows, slow)]

    return encode


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 for itself, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)}.difference(visible)))}


def pieces(docs: DataFrame, path: str, room: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every row of docs: id, piece, start, length, crc, and the task and the rank in it of its length class."""

    def make():
        encode, task, seen = remembered(f"encoder {path}", lambda: encoder(path)), TaskContext.get().partitionId(), Counter()
        tail = np.array([end_id], "<u4").tobytes()

        def step(ids: list, rows: list) -> dict:
            out = {k: [] for k in ("id", "piece", "start", "length", "crc", "task", "nth")}
            for i, made in zip(ids, encode([x.decode() for x in rows]), strict=True):
                body = made + tail
                n = len(body) // 4
                cuts = sorted({0, *range(n % room if n > room else 0, n, room), n})
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, v in zip(out, (i, k, a, b - a, zlib.crc32(body[4 * a : 4 * b]), task, seen[b - a])):
                        out[name].append(v)
                    seen[b - a] += 1
            return out

        return step

    return map_rows(texts(docs, id_col, text_col), make, "id long, piece int, start long, length int, crc long, task int, nth long", keeps=True)


def band(length: Column, room: int) -> Column:
    """0 for the shorter documents, then 1, 2 and 3 for those over an eighth, a quarter and half of the room."""
    return sum((length > room // k).cast("int") for k in (8, 4, 2))


def sweep(table: pa.Table, room: int, step: int) -> pa.Table:
    """One range of a superstep: its documents, the longest first, each into the smallest gap that holds it.

    Rows are runs: n documents of a length with ranks from `first`, or n sequences with a gap and numbers from `first`.
    As many documents of a run go to a sequence as fit; where runs compete for a gap, the longer documents come first and
    the others take the next one. Documents for which no gap of the range is left are handed on; in the range beyond all gaps
    they open new sequences.
    """
    top = table.column("range")[0].as_py() is None
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "size", "first", "n")), strict=True))
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that sequences have, ascending
    out: list[tuple] = []
    opened = step << 44

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def fill(length: int, gap: int, first: int, n: int, rank: int, left: int) -> int:
        """Puts up to `left` documents into n sequences with this gap; returns how many."""
        each = gap // length
        full = min(n, left // each)
        for j in range(each if full else 0):
            out.append((PLACED, length, rank + j * full, full, first, room - gap + j * length))
        put(gap - each * length, first, full)
        done, rest = each * full, 0
        if full < n:
            rest = min(left - done, each - 1)
            for j in range(rest):
                out.append((PLACED, length, rank + done + j, 1, first + full, room - gap + j * length))
            put(gap - rest * length, first + full, 1 if rest else 0)
            put(gap, first + full + bool(rest), n - full - bool(rest))
        return done + rest

    for kind, size, first, n in rows:
        if kind == GAP:
            put(size, first, n)
    for length, rank, left in sorted(((size, first, n) for kind, size, first, n in rows if kind == DOCUMENT), reverse=True):
        while left:
            k = bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            elif top:
                first, n, gap = opened, -(-left // (room // length)), room
                opened += n
            else:
                out.append((DOCUMENT, length, rank, left, 0, 0))
                break
            done = fill(length, gap, first, n, rank, left)
            rank, left = rank + done, left - done
    out += [(GAP, gap, first, n, 0, 0) for gap, runs in gaps.items() for first, n in runs]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=list(RUNS))


def packed(counts: DataFrame, room: int, ranges: int = RANGES) -> DataFrame:
    """(size, first, n, seq, offset): where the documents of each length go, by runs of ranks. counts: (length, n).

    Bulk-synchronous best-fit. Documents of one length and sequences with one gap are interchangeable, so what is sorted and
    matched are runs of them; their number depends on the room alone. Bands of length are served from long to short. A
    superstep sorts the gaps by ranges, sends each run of documents to the range of its successor, the smallest gap that
    holds it, and lets all ranges match at the same time; what lost its gap to longer documents looks for its next
    successor in the next superstep, with the gaps as they are by then, until none is left.
    """
    width = -(-room // ranges)
    now = saved(counts.select(F.lit(DOCUMENT).cast("long").alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), "n", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("offset")))
    done, step = [], 0
    turn = F.when(F.col("kind") == DOCUMENT, band(F.col("size"), room))
    while (longest := now.agg(F.max(turn)).first()[0]) is not None:
        step += 1
        waits = (F.col("kind") == DOCUMENT) & (turn < longest)
        ahead = Window.orderBy("size", "kind").rowsBetween(0, Window.unboundedFollowing)  # runs, a few thousand rows
        active = now.where(~waits).withColumn("successor", F.min(F.when(F.col("kind") == GAP, F.col("size"))).over(ahead))
        active = active.withColumn("range", F.expr(f"(successor - 1) div {width}"))
        ranges_ = active.select("range", "kind", "size", "first", "n").groupBy("range")
        swept = ranges_.applyInArrow(partial(lambda step, t: sweep(t, room, step), step), ", ".join(f"{c} long" for c in RUNS))
        after = saved(swept.union(now.where(waits)))
        done.append(after.where(F.col("kind") == PLACED))
        now = after.where(F.col("kind") != PLACED)
    places = reduce(DataFrame.union, done) if done else now
    return places.select("size", "first", "n", "seq", "offset")


def pack(docs: DataFrame, path: str, room: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of docs: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and end_id; longer ones than `room` are cut into pieces of `room` tokens behind a
    first one with the remainder. Each piece has a rank among those of its length: the pieces before it in its task
    plus those of earlier tasks. Packing works on runs of ranks, which the pieces look up: some thousand rows, whose number depends on
    `room` alone, are broadcast. Null and empty texts are one piece with end_id; repeated rows are packed each;
    further columns are ignored; an empty table gives no piece.
    """
    cut = saved(pieces(docs, path, room, end_id, id_col, text_col))
    sizes = saved(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(sizes.select("task", "length", before.alias("before")), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    places = packed(sizes.groupBy("length").agg(F.sum("n").alias("n")), room)
    at = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    return ranked.join(F.broadcast(places), at).select(
        F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        (F.col("seq") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
    )
