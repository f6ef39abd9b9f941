"""Line dedup as an exact set-similarity join: rare tokens first, prefix, length, positional and bitmap filters."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import forget, give_back, lean, saved, small_parts, texts
from .sift import BLOCK, FILTER_BITS, bit_filter, gathered, holds, inside_filter, pressed, slot
from .wordhash import line_words, mix, open_bytes, press_bytes

#: Two lines are alike if their word sets have this Jaccard similarity or more.
ALIKE = 0.8
#: Counters, chosen by a hash, that the number of each word is estimated from; their number is fixed.
COUNTERS = 1 << 19
#: Partners that a line asks for at a token, such as the bitmaps show to be alike and doubtful ones, before it waits for
#: the verification of these.
SURE, TRIES = 2, 16
#: Doubtful partners, the first ones counted, that a line whose partners all fail finds among the entries kept of its
#: token; a further pass over the texts serves those that have more.
DEEP = 256
#: Entries of a token meet by size: a band holds sizes up to this factor apart.
BAND = 1.2
#: Pairs of entries that are looked at together.
STEP = 1 << 16
#: Lines up to which the texts that hold them are picked by a broadcast table of their places.
FEW = 1 << 16
#: Bytes of text that a task works on at a time.
CHUNK = 2 << 20
#: Words of 64 bits in the bitmap of a set: one for each so many tokens, rounded up to a power of two, at most MOST_BITMAP.
TOKENS_A_WORD, MOST_BITMAP = 40, 16
KEY = ["id", "h", "line"]
PAIR = [*KEY, "id2", "h2", "line2"]


def word_classes(rows: DataFrame) -> np.ndarray:
    """For each counter a class 0..255 that grows with the logarithm of the number of words that hash to it.

    All words are counted: a task adds up its counters and hands them on, COUNTERS at most, and so does the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in small_parts(batch, 2 * CHUNK):
                held = [_counter(line_words(x.column("text").cast(pa.binary()).to_pylist())[0]) for x in small_parts(part, CHUNK // 2)]
                total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        blocks = total.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([press_bytes(blocks[k].tobytes(), 1) for k in some], pa.binary())], names=["block", "data"]).add_column(0, "task", pa.array(np.full(len(some), TaskContext.get().partitionId(), np.int32)))

    def total_of(table: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(open_bytes(x), np.int64) for x in table.column("data").to_pylist())

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([press_bytes(total_of(table).tobytes(), 1)], pa.binary())})

    def grade(key: tuple, table: pa.Table) -> pa.Table:
        out = np.minimum(255, 6 * np.log2(np.maximum(total_of(table), 1).astype(np.float64))).astype(np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    sent = rows.select("text").mapInArrow(lean(run), "task int, block int, data binary")
    summed = sent.groupBy("block", F.expr("task div 256").alias("tasks")).applyInArrow(add, "block int, data binary")  # few rows a group, however many tasks
    return gathered(summed.groupBy("block").applyInArrow(grade, "block int, data binary"), COUNTERS, np.uint8)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def _token_slot(token: np.ndarray) -> np.ndarray:
    return (mix(token) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _line_slot(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mix(h.view(np.uint64) + mix(line.astype(np.uint64))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _tokens(h: np.ndarray, line: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words by line the distinct ones of each, the rarest first, and the number of their line."""
    if not len(h):
        return h, line
    dense, grade = np.cumsum(np.append(0, np.diff(line) != 0)), classes[_counter(h)]
    if dense[-1] < 1 << 20:
        by = np.argsort((dense.astype(np.uint64) << np.uint64(44)) | (grade.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    else:  # one text of very many lines
        by = np.lexsort((h >> np.uint64(28), grade, dense))
    token, line = h[by], line[by]
    new = np.append(True, (np.diff(line) != 0) | (np.diff(token) != 0))
    return token[new], line[new]


def _prefix(size: np.ndarray, alike: float) -> np.ndarray:
    return size - np.ceil(alike * size - 1e-9).astype(np.int64) + 1


def _width(size: np.ndarray) -> np.ndarray:
    """Words of the bitmap of a set."""
    return np.minimum(MOST_BITMAP, 1 << np.ceil(np.log2(np.maximum(1, size / TOKENS_A_WORD))).astype(np.int64))


def _parity(token: np.ndarray, heads: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of sets of tokens, one behind the other, and where each starts: a bit is the parity of the tokens on it."""
    width = _width(size)
    start = np.cumsum(width) - width
    which = np.repeat(np.arange(len(size)), size)
    bit = (token >> np.uint64(40)).astype(np.int64) & (64 * width[which] - 1)
    odd = np.bincount(64 * start[which] + bit, minlength=64 * int(width.sum())) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64), start


def _entries(part: pa.RecordBatch, classes: np.ndarray, buckets: int, alike: float, wanted: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Packed prefix entries by bucket: token and the one before it, position, set size, hash, line, text, bitmap.

    Of equal sets of a chunk the first line is sent whole; the others only tell at their first token that they are there.
    wanted: only tokens in the first filter are sent, and lines in the second one ask for partners.
    """
    ids, hs = (part.column(c).to_numpy() for c in ("id", "h"))
    h, line, owner, number = line_words(part.column("text").cast(pa.binary()).to_pylist())
    if wanted is not None:  # most lines have no such token
        some = np.zeros(len(owner), bool)
        some[line[holds(wanted[0], _token_slot(h))]] = True
        h, line = h[some[line]], line[some[line]]
    token, line = _tokens(h, line, classes)
    if not len(token):
        return
    heads = np.flatnonzero(np.append(True, np.diff(line) != 0))
    size = np.diff(np.append(heads, len(line)))
    bits, bits_at = _parity(token, heads, size)
    whole = np.add.reduceat(mix(token ^ np.uint64(0x5851F42D4C957F2D)), heads)
    at = line[heads]  # the line of each set
    asks = np.ones(len(heads), bool) if wanted is None else holds(wanted[1], _line_slot(hs[owner[at]], number[at]))
    by = np.lexsort((number[at], hs[owner[at]], ids[owner[at]], whole, size))
    same = np.append(False, (whole[by][1:] == whole[by][:-1]) & (size[by][1:] == size[by][:-1]))
    copy = np.zeros(len(heads), bool)
    copy[by] = same
    if wanted is not None:
        copy &= ~asks
    which = np.repeat(np.arange(len(heads)), size)
    pos = np.arange(len(line)) - heads[which]
    take = pos < np.where(copy, 1, _prefix(size, alike))[which]
    if wanted is not None:
        take &= holds(wanted[0], _token_slot(token))
    token_id = (token >> np.uint64(32)).astype(np.uint32)
    before = np.append(np.uint32(0), token_id[:-1])
    token_id, before, pos, which = token_id[take], before[take], pos[take], which[take]
    if not len(which):
        return
    bucket = (mix(token_id) % np.uint64(buckets)).astype(np.int64)
    go = np.argsort(bucket, kind="stable")
    width = _width(size)
    keys, blobs = [], []
    there, place = np.zeros(part.num_rows, bool), np.zeros(part.num_rows, np.int64)
    for group in np.split(go, np.flatnonzero(np.diff(bucket[go])) + 1):
        k = which[group]
        there[owner[at[k]]] = True
        doc = np.flatnonzero(there)
        place[doc] = np.arange(len(doc))
        of = place[owner[at[k]]]
        there[doc] = False
        n = width[k]
        flat = np.repeat(bits_at[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        flags = copy[k] + 2 * asks[k]
        columns = (token_id[group], before[group], _narrow(pos[group]), _narrow(size[k]), (whole[k] >> np.uint64(32)).astype(np.uint32), _narrow(number[at[k]]), _narrow(of), flags.astype(np.uint8), bits[flat], np.diff(ids[doc], prepend=0), hs[doc])
        keys.append(int(bucket[group[0]]))
        blobs.append(press_bytes(pickle.dumps(columns, 5), 1))
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _narrow(x: np.ndarray) -> np.ndarray:
    most = x.max(initial=0)
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


class _Bucket:
    """The entries of a bucket whose token stands more than once, as arrays, in the order they were sent in."""

    def __init__(self, sent: list[tuple]):
        token = np.concatenate([x[0] for x in sent])
        order = np.argsort(token, kind="stable")
        again = token[order][1:] == token[order][:-1]
        shared = np.zeros(len(token), bool)
        shared[order[np.append(again, False) | np.append(False, again)]] = True
        del token, order, again
        parts = list(zip(sent, np.split(shared, np.cumsum([len(x[0]) for x in sent])[:-1])))
        self.token, self.before, self.pos, self.size, self.whole, self.line, self.flags = (np.concatenate([x[k][m] for x, m in parts]) for k in (0, 1, 2, 3, 4, 5, 7))
        self.bits = np.concatenate([x[8][np.repeat(m, _width(x[3].astype(np.int64)))] for x, m in parts])
        self.pos, self.size, self.line = (x.astype(np.int64) for x in (self.pos, self.size, self.line))
        self.id = np.concatenate([np.cumsum(x[9])[x[6][m]] for x, m in parts])
        self.h = np.concatenate([x[10][x[6][m]] for x, m in parts])
        self.width = _width(self.size)
        self.at = np.cumsum(self.width) - self.width

    def take(self, rows: np.ndarray) -> None:
        for k, v in vars(self).items():
            if k != "bits":
                setattr(self, k, v[rows])

    def packed(self, rows: np.ndarray) -> bytes:
        """What of these rows `_walk` looks at."""
        n = self.width[rows]
        flat = np.repeat(self.at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        kept = {k: getattr(self, k)[rows] for k in ("token", "before", "id", "h")} | {k: _narrow(getattr(self, k)[rows]) for k in ("pos", "size", "line")}
        return press_bytes(pickle.dumps(kept | {"bits": self.bits[flat]}, 5), 1)

    @classmethod
    def opened(cls, data: bytes) -> _Bucket:
        b = cls.__new__(cls)
        vars(b).update(pickle.loads(open_bytes(data)))
        b.pos, b.size, b.line = (x.astype(np.int64) for x in (b.pos, b.size, b.line))
        b.width = _width(b.size)
        b.at = np.cumsum(b.width) - b.width
        return b

    def bitmaps(self, k: np.ndarray, w: int) -> np.ndarray:
        """Bitmaps of w words of sets that have w or twice as many."""
        out = self.bits[self.at[k][:, None] + np.arange(w)]
        wide = np.flatnonzero(self.width[k] > w)
        out[wide] ^= self.bits[self.at[k[wide]][:, None] + np.arange(w, 2 * w)]
        return out

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of sets differ, the wider one folded: not more than the tokens in which the sets do."""
        out = np.zeros(len(i), np.int64)
        least = np.minimum(self.width[i], self.width[j])
        for w in np.unique(least).tolist():
            n = np.flatnonzero(least == w)
            out[n] = np.bitwise_count(self.bitmaps(i[n], w) ^ self.bitmaps(j[n], w)).sum(1, dtype=np.int64)
        return out

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets look equal: size, hash and bitmap."""
        out = (self.token[i] == self.token[j]) & (self.size[i] == self.size[j]) & (self.whole[i] == self.whole[j])
        n = np.flatnonzero(out)
        out[n] = self.differing(i[n], j[n]) == 0
        return out


def _band(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(size) / np.log(BAND)).astype(np.int64)


def _largest(size: np.ndarray, pos: np.ndarray, alike: float) -> np.ndarray:
    """Size of the largest set that may be alike one of this size if no token before pos is in both."""
    return np.floor((size - pos) * (1 + alike) / alike + 1e-6).astype(np.int64) - size


def _met(token: np.ndarray, size: np.ndarray, pos: np.ndarray, alike: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which entries meet: number of the entry, band of sizes, and token with band, by which they are sorted.

    An entry stands in the band of its size and in those up to the largest size that it allows, so two that may be alike
    meet in the band of the larger one.
    """
    low = _band(size)
    n = np.maximum(_band(np.maximum(_largest(size, pos, alike), size)) - low, 0) + 1
    of = np.repeat(np.arange(len(size)), n)
    band = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    key = token[of].astype(np.uint64) << np.uint64(16) | band.astype(np.uint64)
    by = np.argsort(key, kind="stable")
    return of[by], band[by], key[by]


def _pairs(table: pa.Table, alike: float, every: bool) -> pa.Table:
    """Pairs (later line, earlier one) of a bucket that the filters let through, as `_walk` finds them.

    Equal sets meet in a pair with their first line, and only that one is compared with other sets. One row more has the
    entries of all tokens at which a line is left with TRIES partners (deep), so that it can be taken up again there.
    every: a line goes back to the first one.
    """
    b = _Bucket([pickle.loads(open_bytes(x)) for x in table.column("blob").to_pylist()])
    b.take(np.argsort(b.id, kind="stable"))  # within a text lines come in their order
    if ((b.id[1:] == b.id[:-1]) & (b.h[1:] != b.h[:-1])).any():  # texts that share an id
        b.take(np.lexsort((b.line, b.h, b.id)))
    sets = np.argsort(b.token.astype(np.uint64) << np.uint64(32) | b.whole, kind="stable")
    new = np.append(True, ~b.same(sets[1:], sets[:-1]))[: len(sets)]
    lead, of_lead = np.empty(len(sets), bool), np.empty(len(sets), np.int64)
    lead[sets], of_lead[sets] = new, sets[np.maximum.accumulate(np.where(new, np.arange(len(sets)), 0))]
    itself = (b.id == b.id[of_lead]) & (b.h == b.h[of_lead]) & (b.line == b.line[of_lead])  # the same line of a row that is repeated
    asks = b.flags >= 2
    copies = np.flatnonzero(~lead & (b.pos == 0) & ~itself & asks)
    stay = np.flatnonzero((lead | (asks & ~itself if every else False)) & (b.flags & 1 == 0))
    i, j, more, deep = _walk(b, stay, asks[stay], alike, None if every else TRIES)
    hot = np.unique(b.token[i[deep]])
    kept = [b.packed(stay[np.isin(b.token[stay], hot)])] if len(hot) else []
    i, j = np.append(copies, i), np.append(of_lead[copies], j)
    more, deep = np.append(np.ones(len(copies), bool), more), np.append(np.zeros(len(copies), bool), deep)
    out = _rows(b, i, j).append_column("more", pa.array(more)).append_column("deep", pa.array(deep))
    rows = pa.table({"kept": pa.array(kept, pa.binary())})
    out = pa.concat_tables([out, rows], promote_options="default")
    return out.add_column(0, "bucket", pa.array(np.full(out.num_rows, table.column("bucket")[0].as_py(), np.int32)))


def _rows(b: _Bucket, i: np.ndarray, j: np.ndarray) -> pa.Table:
    return pa.table([pa.array(x) for x in (b.id[i], b.h[i], b.line[i].astype(np.int32), b.id[j], b.h[j], b.line[j].astype(np.int32))], names=PAIR)


def _walk(b: _Bucket, stay: np.ndarray, asks: np.ndarray, alike: float, tries: int | None) -> tuple[np.ndarray, ...]:
    """Pairs (later entry, earlier one) of the entries stay, for those that ask; more, deep: the later one may have others.

    A pair that has the token before this one in common, too, is left to that token. A line goes back over the earlier
    ones of its token, in all bands of sizes at once, until it has met SURE that look alike by the bitmaps (more), or as
    many as tries says that may be (deep; None: to the first one).
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))]
    of, band, by = _met(b.token[stay], b.size[stay], b.pos[stay], alike)
    heads = np.flatnonzero(np.append(True, np.diff(by) != 0)) if len(by) else np.zeros(0, np.int64)
    nth = np.arange(len(by)) - np.repeat(heads, np.diff(np.append(heads, len(by))))
    size, pos, before = (x[stay][of] for x in (b.size, b.pos, b.before))
    rest, most, home = size - pos, _largest(size, pos, alike), band == _band(size)
    active, back = np.flatnonzero(asks[of] & (nth > 0)), 1
    tried, likely, enough, ended = np.zeros(len(stay), np.int64), np.zeros(len(stay), np.int64), np.zeros(len(stay), bool), np.zeros(len(stay), bool)
    while len(active):
        wide = max(1, min(back, STEP // len(active)))
        i = np.repeat(active, wide) if wide > 1 else active
        j = i - np.tile(np.arange(back, back + wide), len(active)) if wide > 1 else i - back
        if wide > 1:
            ok = i - j <= nth[i]
            i, j = i[ok], j[ok]
        ok = np.flatnonzero((size[j] <= most[i]) & (size[i] <= most[j]) & (home[i] | home[j]))
        i, j = i[ok], j[ok]
        s, t = size[i], size[j]
        need = np.ceil(alike / (1 + alike) * (s + t) - 1e-9)
        ok = (np.minimum(s, t) >= alike * np.maximum(s, t) - 1e-9) & (np.minimum(rest[i], rest[j]) >= need)
        ok &= (pos[i] == 0) | (pos[j] == 0) | (before[i] != before[j])
        i, j, free = of[i[ok]], of[j[ok]], (s + t - 2 * need)[ok]
        apart = b.differing(stay[i], stay[j])
        near = apart <= free
        i, j, sure = i[near], j[near], (2 * apart + 2 <= free)[near]
        if tries is not None:
            if wide > 1:  # of a line's partners no more than it still asks for, the nearest first
                order = np.argsort(i, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(i[order]) != 0)) if len(i) else order
                nearest = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                ok = order[nearest < np.maximum(1, tries - tried[i[order]])]
                i, j, sure = i[ok], j[ok], sure[ok]
            np.add.at(tried, i, np.where(sure, TRIES // SURE, 1))
            np.add.at(likely, i[sure], 1)
            enough[i] = likely[i] >= SURE
            ended[i] = enough[i] | (tried[i] >= tries)
        found.append((stay[i], stay[j], enough[i], ended[i] & ~enough[i]))
        back += wide
        active = active[(nth[active] >= back) & ~ended[of[active]]]
    i, j, more, deep = (np.concatenate([x[k] for x in found]) for k in range(4))
    return i, j, more, deep


def _resumed(kept: pa.Table, lines: pa.Table, alike: float) -> pa.Table:
    """Pairs of the lines with earlier ones of the entries kept, up to DEEP at a token; more: the later one may have others."""
    if not kept.num_rows or not lines.num_rows:
        return pa.table({c: pa.array([], pa.int32() if c.startswith("line") else pa.int64()) for c in PAIR} | {"more": pa.array([], pa.bool_())})
    b = _Bucket.opened(kept.column("kept")[0].as_py())
    wanted = set(zip(*(lines.column(c).to_pylist() for c in KEY)))
    asks = np.isin(b.h, lines.column("h").to_numpy())
    some = np.flatnonzero(asks)
    asks[some] = [x in wanted for x in zip(*(v[some].tolist() for v in (b.id, b.h, b.line)))]
    i, j, more, deep = _walk(b, np.arange(len(b.id)), asks, alike, max(TRIES, DEEP))
    return _rows(b, i, j).append_column("more", pa.array(more | deep))


def similar_lines(rows: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(id, h, line): the lines of rows (id, h, text) that are alike an earlier line, by id, then place.

    A line is its set of words; lines without words are never alike. Alike lines share a token of their prefixes, so
    they meet in its bucket; a line asks for few of the partners that no filter rules out there, the pairs are verified
    on the words themselves, and only lines all of whose partners failed ask for further ones, among the entries kept of
    tokens with many doubtful partners, and those that have still more, in a second pass, for all others.
    """
    rows = rows.where("id is not null")
    context = rows.sparkSession.sparkContext
    classes = context.broadcast(word_classes(rows))
    buckets = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def found(wanted=None) -> DataFrame:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                for part in small_parts(batch, CHUNK):
                    yield from _entries(part, classes.value, buckets, alike, wanted and wanted.value)

        every = wanted is not None
        schema = "bucket int, id long, h long, line int, id2 long, h2 long, line2 int, more boolean, deep boolean, kept binary"

        def match(table: pa.Table) -> pa.Table:
            out = _pairs(table, alike, every)
            give_back()
            return out

        return rows.mapInArrow(lean(send), "bucket int, blob binary").groupBy("bucket").applyInArrow(match, schema)

    met = saved(found())
    pairs = saved(met.where("kept is null").groupBy(*PAIR).agg(F.max("more").alias("more"), F.max("deep").alias("deep")))
    sets = _sets(rows, pairs)
    out = saved(_verified(pairs, sets, alike))
    wait = saved(pairs.where("more or deep").groupBy(*KEY).agg(F.max("more").alias("more"), F.max("deep").alias("deep")).join(out, KEY, "left_anti"))
    tried = pairs.select(*PAIR)
    if not (deep := wait.where("deep")).isEmpty():

        def resume(kept: pa.Table, lines: pa.Table) -> pa.Table:
            return _resumed(kept, lines, alike)

        lost = saved(met.where("deep").select("bucket", *KEY).distinct().join(deep.select(*KEY), KEY, "left_semi"))
        kept = met.where("kept is not null").select("bucket", "kept")
        more = kept.groupBy("bucket").cogroup(lost.groupBy("bucket")).applyInArrow(resume, "id long, h long, line int, id2 long, h2 long, line2 int, more boolean")
        more = saved(more.groupBy(*PAIR).agg(F.max("more").alias("more")))
        late = saved(more.join(pairs, PAIR, "left_anti"))
        good = saved(_verified(late, _sets(rows, late), alike))
        out, tried = out.union(good), tried.union(more.select(*PAIR))
        wait = wait.select(*KEY, "more").union(more.select(*KEY, "more")).join(good, KEY, "left_anti")
    left = saved(wait.where("more").select(*KEY).distinct())
    if left.isEmpty():
        return out

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, line = _tokens(*line_words(batch.column("words").to_pylist())[:2], classes.value)
            heads = np.flatnonzero(np.append(True, np.diff(line) != 0)) if len(line) else np.zeros(0, np.int64)
            size = np.diff(np.append(heads, len(line)))
            first = np.arange(len(line)) - np.repeat(heads, size) < np.repeat(_prefix(size, alike), size)
            yield pa.RecordBatch.from_arrays([pa.array(_token_slot(token[first]))], names=["s"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_line_slot(batch.column("h").to_numpy(), batch.column("line").to_numpy()))], names=["s"])

    asked = sets.join(left, KEY).select("words").mapInArrow(lean(slots), "s long")
    wanted = context.broadcast((bit_filter(asked), bit_filter(left.select("h", "line").mapInArrow(lean(own), "s long"))))
    rest = saved(found(wanted).select(*PAIR).distinct().join(left, KEY, "left_semi").join(tried, PAIR, "left_anti"))
    return out.union(_verified(rest, _sets(rows, rest), alike)).distinct()


def _sets(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, h, line, words) of the lines in pairs; words are distinct, sorted, with one space between them."""
    wanted = pairs.select(*KEY).union(pairs.select("id2", "h2", "line2")).distinct()
    lists = saved(wanted.groupBy("id", "h").agg(F.collect_set("line").alias("at")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            out: dict[str, list] = {"id": [], "h": [], "line": [], "words": []}
            raw = map(open_bytes, batch.column("packed").to_pylist()) if "packed" in batch.schema.names else batch.column("text").cast(pa.binary()).to_pylist()
            for i, h, text, at in zip(*(batch.column(c).to_pylist() for c in ("id", "h")), raw, batch.column("at").to_pylist(), strict=True):
                lines = text.split(b"\n")
                for k in at:
                    for c, v in zip(out, (i, h, k, b" ".join(sorted({*lines[k].split()})))):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["h"], pa.int64()), pa.array(out["line"], pa.int32()), pa.array(out["words"], pa.binary())], names=list(out))

    if (lists.agg(F.sum(F.size("at"))).first()[0] or 0) <= FEW:  # other texts do not leave the scan
        some = rows.join(F.broadcast(lists), ["id", "h"]).select("id", "h", "text", "at")
    else:
        some = pressed(rows, bit_filter(lists.select(slot("id", "h")))).join(lists, ["id", "h"]).select("id", "h", "packed", "at")
    return saved(some.mapInArrow(lean(pick), "id long, h long, line int, words binary"))


def _verified(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """The later lines of the pairs that are alike."""
    other = sets.select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("line").alias("line2"), F.col("words").alias("words2"))
    both = pairs.select(*PAIR).join(sets, KEY).join(other, ["id2", "h2", "line2"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column("words").to_pylist(), batch.column("words2").to_pylist(), strict=True):
                x, y = set(p.split(b" ")), set(q.split(b" "))
                good.append(p == q or len(x & y) >= alike * len(x | y) - 1e-9)
            part = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in KEY], names=KEY)

    return both.select(*KEY, "words", "words2").mapInArrow(lean(judge), "id long, h long, line int").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, kept_sha256; with carry also kept_text and the columns named.

    A line of a text (split at line breaks) goes if an earlier line of the table, by (id, place), has a word set of
    Jaccard similarity `alike` or more; lines are judged on the input, not on what is left. Lines without words
    stay. Null texts are empty: one line without words. Rows with a null id are returned whole. Rows that repeat id
    and text count as one and lose the same lines, those alike an earlier line of another place; among different
    texts with one id the order is that of a 64-bit hash of the text. Further columns are ignored; an empty table
    gives an empty result.
    """
    rows = texts(docs, id_col, text_col).select("id", F.xxhash64("text").alias("h"), "text")
    gone = saved(similar_lines(rows, alike).groupBy("id", "h").agg(F.collect_list("line").alias("gone")))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(c) for c in carry or (id_col,)]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = whole.select("id", F.xxhash64("text").alias("h"), "row", "text")
    bits = bit_filter(gone.select(slot("id", "h")))

    mask = docs.sparkSession.sparkContext.broadcast(bits)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts in the filter packed, of all others what there is to tell: nothing is taken from them."""
        forget()
        for batch in batches:
            inside = holds(mask.value, batch.column("s").to_numpy()).tolist()
            out: list[list] = [[], [], []]
            for x, lost in zip(batch.column("text").cast(pa.binary()).to_pylist(), inside, strict=True):
                for c, v in zip(out, (press_bytes(x, 1), None, None) if lost else (None, x.count(b"\n") + 1, hashlib.sha256(x).hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "h", "row")], pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["id", "h", "row", "packed", "n_lines", "kept_sha256"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            packed = "packed" in batch.schema.names
            part = batch if packed else inside_filter(batch, mask.value, False)
            raw = (x and open_bytes(x) for x in part.column("packed").to_pylist()) if packed else part.column("text").cast(pa.binary()).to_pylist()
            told = zip(part.column("n_lines").to_pylist(), part.column("kept_sha256").to_pylist()) if packed else repeat((None, None), part.num_rows)
            out: list[list] = [[], [], [], []]
            for x, at, (n, sha) in zip(raw, part.column("gone").to_pylist() if packed else repeat(None, part.num_rows), told, strict=packed):
                if x is not None:
                    n = x.count(b"\n") + 1
                    if at:
                        drop = set(at)
                        x = b"\n".join([y for k, y in enumerate(x.split(b"\n")) if k not in drop])
                    sha = hashlib.sha256(x).hexdigest()
                for c, v in zip(out, (n, len(at or ()), sha, x.decode() if carry else None)):
                    c.append(v)
            columns = [part.column("id"), part.column("row"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "n_lines", "n_removed", "kept_sha256", "kept_text"])

    made = ["n_lines", "n_removed", "kept_sha256"]
    schema = StructType([whole.schema["id"], whole.schema["row"], *[StructField(c, k) for c, k in zip([*made, "kept_text"], (LongType(), LongType(), StringType(), StringType()))]])
    told = [F.lit(None).cast("long").alias("n_lines"), F.lit(None).cast("string").alias("kept_sha256")]
    rest = whole.select("id", "row", "text", slot("id", "h"))
    if carry:  # texts that lose nothing are not shuffled
        cut = pressed(whole, bits).join(gone, ["id", "h"], "left").select("id", "row", "packed", "gone", *told)
        done = cut.mapInArrow(lean(finish), schema).union(rest.mapInArrow(lean(finish), schema))
    else:
        fields = [*[whole.schema[c] for c in ("id", "h", "row")], StructField("packed", BinaryType()), StructField("n_lines", LongType()), StructField("kept_sha256", StringType())]
        seen = whole.select("id", "h", "row", "text", slot("id", "h")).mapInArrow(lean(sift), StructType(fields))
        done = seen.join(gone, ["id", "h"], "left").select("id", "row", "packed", "gone", "n_lines", "kept_sha256").mapInArrow(lean(finish), schema)
    return done.select(F.col("id").alias(id_col), *made, *(["kept_text", *[F.col(f"row.{c}").alias(c) for c in carry]] if carry else []))
