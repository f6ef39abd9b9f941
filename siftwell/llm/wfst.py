"""SentencePiece encoding and decoding by weighted finite-state transducers over the tropical semiring."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, remembered, texts
from .wordhash import BASE, mix

SPACE = "▁"
#: Entries that a worker process remembers of units.
REMEMBERED = 500_000
#: Characters of the units that are composed at a time.
BATCH = 1 << 18
#: Weight of an arc that there is not, and of a state that no path leads to: the zero of the semiring (min, +).
ZERO = np.float32(np.inf)
#: State behind the start of a unit, or behind a character that is written as bytes: any piece can follow.
FREE = -1


class Table:
    """A function from pairs of numbers to numbers, -1 elsewhere: open addressing, looked up for whole arrays."""

    def __init__(self, first: np.ndarray, second: np.ndarray, value: np.ndarray):
        key = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(key) + 1))))
        self.keys, self.values = np.full(1 << self.bits, ~np.uint64(0)), np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == ~np.uint64(0)
            self.keys[at[free]] = key[todo[free]]  # of several that want a slot one gets it
            got = self.keys[at] == key[todo]
            self.values[at[got]] = value[todo[got]]
            todo = todo[~got]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((there != key) & (there != ~np.uint64(0)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != ~np.uint64(0))]
        return out


@dataclass
class Normaliser:
    """The first transducer. States: 0 at the start, 1 behind it. Each character has an arc that writes it, but that `out` has
    other characters for some; the arc that leaves the start writes `head` first. An empty text stays at the start.

    Composition works on bytes in which the space stands for the sign that it is written as.
    """

    head: str = SPACE
    out: tuple[tuple[str, str], ...] = ((" ", SPACE),)
    space: int = 32

    def compose(self, text: bytes) -> bytes:
        if not text:
            return text
        for a, b in self.out:
            text = text.replace(b.encode(), a.encode()) if b.encode() in text else text
        return bytes([self.space]) + text

    def written(self, unit: bytes) -> str:
        """A part of composed text with the characters that the arcs write."""
        text = unit.decode()
        for a, b in self.out:
            text = text.replace(a, b)
        return text


@dataclass
class Machine:
    """The second and third transducer, compiled from a SentencePiece BPE model with byte fallback.

    Pieces: states are the nodes of a trie, `step` has its arcs (state, character) -> state, and `piece` tells which piece
    ends in a state, where the transducer writes its id and goes back to the root. A character that no piece begins with
    has the path of its UTF-8 bytes instead.

    Neighbours: byte-pair merging is local, so a sequence of pieces is what merging makes exactly if each piece, and each
    two neighbours, are merged to themselves. States are the last pieces; the arc of a piece weighs 1 where it may follow
    the last one. There are too many arcs to be written out: they are told from `merge` (two symbols -> the piece they
    join to) and `halves` (the two symbols whose merge made a piece last), all by rank, the best score being 0.
    """

    step: Table
    piece: np.ndarray
    merge: Table
    halves: np.ndarray
    sound: np.ndarray
    id_of: np.ndarray
    byte: np.ndarray
    text: list[str]

    def follows(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Weights of the arcs of pieces behind others (FREE: none).

        Merges are undone from the latest back, on both sides of the border: at each time the symbols that stand there must
        not join before one of them is merged with its other neighbour. Equal merges go from left to right.
        """
        weight = np.where(self.sound[piece], np.float32(1), ZERO)
        open_ = np.flatnonzero((last != FREE) & self.sound[piece])
        x, y = last[open_].astype(np.int64), piece[open_].astype(np.int64)
        limit = np.full(len(open_), 1 << 40)
        while len(open_):
            joined = self.merge.get(x, y)
            bad = (joined >= 0) & (joined < limit)
            weight[open_[bad]] = ZERO
            left = x > y  # which of the two was made last
            inner = np.where(left, self.halves[x, 1], self.halves[y, 0])
            other = np.where(left, self.halves[y, 0], self.halves[x, 1])
            turn = (inner < 0) & (other >= 0)  # a single character: the other side is undone
            left, inner = left ^ turn, np.where(turn, other, inner)
            limit = np.where(left, x, y + 1)
            x, y = np.where(left, inner, x), np.where(left, y, inner)
            go = ~bad & (inner >= 0)
            open_, x, y, limit = open_[go], x[go], y[go], limit[go]
        return weight


def load(path: str) -> Machine:
    """Compiles a BPE model with byte fallback, the identity normaliser and a leading space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = range(sp.vocab_size())
    plain = [i for i in names if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in names if sp.is_byte(i)}
    plain.sort(key=lambda i: -sp.get_score(i))
    machine = compiled([sp.id_to_piece(i) for i in plain], plain, [byte[b] for b in range(256)])
    check = Encoder(machine)
    for probe in ("Hello  wörld", " a\tb\n", "　ﬁ \U0001d11e", "x"):
        if check.ids_of(probe) != sp.encode(probe):
            raise ValueError("the model's normaliser is not the identity with a leading space")
    return machine


def compiled(pieces: list[str], ids: list[int], byte: list[int]) -> Machine:
    """pieces: the best score first."""
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece holds a space behind other characters; units cannot be told apart")
    rank = {p: r for r, p in enumerate(pieces)}
    if any(c not in rank for p in pieces for c in p):
        raise ValueError("a piece holds a character that is no piece")
    nodes, ends, arcs = {"": 0}, [-1], []
    for p in sorted(pieces):
        for n in range(1, len(p) + 1):
            if p[:n] not in nodes:
                nodes[p[:n]] = len(ends)
                ends.append(-1)
                arcs.append((nodes[p[: n - 1]], ord(p[n - 1]), nodes[p[:n]]))
        ends[nodes[p]] = rank[p]
    joins = [(rank[p[:k]], rank[p[k:]], r) for r, p in enumerate(pieces) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    halves, sound = np.full((len(pieces), 2), -1, np.int64), np.ones(len(pieces), bool)
    for r, p in enumerate(pieces):
        symbols = list(p)
        while len(symbols) > 1:  # merges the best neighbours first, the left ones on ties
            best = min((rank.get(a + b, len(pieces)), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best[0] == len(pieces):
                break
            k = best[1]
            halves[r] = rank[symbols[k]], rank[symbols[k + 1]]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        sound[r] = symbols == [p]
    arc, join = (np.array(x, np.int64).reshape(-1, 3).T for x in (arcs, joins))
    return Machine(Table(*arc), np.array(ends), Table(*join), halves, sound, np.array(ids, np.uint32), np.array(byte, np.uint32), pieces)


class Encoder:
    """Composes texts with the transducers and takes the path of least weight. No piece goes on across a space sign, so
    the composition falls apart into units of a word and the spaces before it, and what was made of a unit is remembered."""

    def __init__(self, machine: Machine, normaliser: Normaliser | None = None):
        self.machine, self.normaliser = machine, normaliser or Normaliser()
        self.forget()

    def arcs(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of the arcs over a run of characters; left: characters from each to the end of its unit."""
        start = np.arange(len(codes))
        state = np.zeros(len(codes), np.int64)
        out, n = [], 0
        while len(start):
            state = self.machine.step.get(state, codes[start + n]).astype(np.int64)
            n += 1
            on = state >= 0
            start, state = start[on], state[on]
            piece = self.machine.piece[state]
            hit = piece >= 0
            out.append((start[hit], start[hit] + n, piece[hit]))
            more = left[start] > n
            start, state = start[more], state[more]
        return tuple(np.concatenate(c) for c in zip(*out))

    def shortest(self, units: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, on the shortest path through each unit."""
        m = self.machine
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.array([len(x) for x in units])
        head = np.cumsum(size) - size
        at = np.arange(len(codes)) - np.repeat(head, size)
        left = np.repeat(size, size) - at
        start, end, piece = self.arcs(codes, left)
        stands = np.zeros(len(codes), bool)
        stands[start] = True
        bytes_at = np.flatnonzero(~stands)  # no piece begins here: the bytes of the character
        start = np.concatenate([start, bytes_at])
        end, piece = np.concatenate([end, bytes_at + 1]), np.concatenate([piece, np.full(len(bytes_at), FREE)])
        # one state of the composition for each place: the unit's start has weight 0, its others what the least path to them has
        weight = np.where(at == 0, np.float32(0), ZERO)
        weight = np.append(weight, ZERO)
        last = np.full(len(codes) + 1, FREE)
        total = np.full(len(units), ZERO)
        by, final = np.full(len(codes) + 1, -1), np.full(len(units), -1)
        owner = np.repeat(np.arange(len(units)), size)
        close = at[start] + (end - start) == size[owner[start]]
        order = np.lexsort((end, at[start]))
        start, end, piece, close = start[order], end[order], piece[order], close[order]
        bounds = np.searchsorted(at[start], np.arange(int(size.max(initial=0)) + 1))
        for a, b in zip(bounds, bounds[1:]):  # places in their topological order
            s, e, p, c = start[a:b], end[a:b], piece[a:b], close[a:b]
            w = np.where(p == FREE, np.float32(1), ZERO)
            real = np.flatnonzero((p != FREE) & (weight[s] < ZERO))
            w[real] = m.follows(last[s[real]], p[real])
            path = weight[s] + w
            for inside in (True, False):
                k = np.flatnonzero((path < ZERO) & (c != inside))
                target = e[k] if inside else owner[s[k]]
                sums, back = (weight, by) if inside else (total, final)
                better = path[k] < sums[target]
                k, target = k[better], target[better]
                np.minimum.at(sums, target, path[k])
                win = sums[target] == path[k]
                back[target[win]] = a + k[win]
                if inside:
                    last[target[win]] = p[k[win]]
        if (total == ZERO).any():
            raise ValueError(f"no path through {units[int(np.flatnonzero(total == ZERO)[0])]!r}")
        return self._written(units, final, by, start, piece, head, size)

    def _written(self, units, final, by, start, piece, head, size) -> list[bytes]:
        """Follows the shortest paths back and writes what their arcs write."""
        m = self.machine
        now, rows, arcs, depth = final.copy(), np.arange(len(units)), [], 0
        while len(rows):
            arcs.append((rows, now, np.full(len(rows), depth)))
            s = start[now]
            on = s > head[rows]
            rows, now, depth = rows[on], by[s[on]], depth + 1
        row, arc, nth = (np.concatenate(c) for c in zip(*arcs))
        order = np.lexsort((-nth, row))
        row, arc = row[order], arc[order]
        ids = np.where(piece[arc] == FREE, 0, m.id_of[np.maximum(piece[arc], 0)]).astype("<u4")
        ends = np.searchsorted(row, np.arange(len(units) + 1)).tolist()
        raw, out = ids.tobytes(), []
        odd = set(row[piece[arc] == FREE].tolist())
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            if i in odd:
                parts = [m.byte[list(units[i][start[k] - head[i]].encode())].astype("<u4").tobytes() if piece[k] == FREE else raw[4 * n : 4 * n + 4] for n, k in zip(range(a, b), arc[a:b])]
                out.append(b"".join(parts))
            else:
                out.append(raw[4 * a : 4 * b])
        return out

    def compose(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one behind the other, and where each text's ids end."""
        n = self.normaliser
        buf = b"".join([n.compose(x) for x in texts]) + bytes(8)
        a = np.frombuffer(buf, np.uint8)[:-8]
        ends = np.cumsum([len(x) + (x != b"") for x in texts])
        space = a == n.space
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[(ends - [len(x) + 1 for x in texts])[[x != b"" for x in texts]]] = True
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(a)))
        unit, of = np.unique(_unit_hash(buf, start, size), return_inverse=True)
        place = np.searchsorted(self.known, unit)
        new = np.flatnonzero(np.append(self.known, 0)[np.minimum(place, len(self.known))] != unit) if len(self.known) else np.arange(len(unit))
        if len(new):
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new, place = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            first = np.full(len(unit), len(of))
            np.minimum.at(first, of, np.arange(len(of)))
            self._learn(unit[new], [n.written(buf[s : s + k]) for s, k in zip(start[first[new]].tolist(), size[first[new]].tolist())], place[new])
            place = np.searchsorted(self.known, unit)
        at, length = self.at[place][of], self.length[place][of]
        total = np.cumsum(length)
        ids = self.ids[np.repeat(at - (total - length), length) + np.arange(int(total[-1]) if len(total) else 0)]
        return ids, np.append(0, total)[np.searchsorted(start, ends)]

    def _learn(self, unit: np.ndarray, texts: list[str], place: np.ndarray) -> None:
        by = sorted(range(len(texts)), key=lambda k: len(texts[k]))  # units of one length have the same number of places
        made: list[bytes] = [b""] * len(texts)
        i = 0
        while i < len(by):
            n, j = 0, i
            while j < len(by) and n < BATCH:
                n += len(texts[by[j]])
                j += 1
            for k, x in zip(by[i:j], self.shortest([texts[k] for k in by[i:j]])):
                made[k] = x
            i = j
        length = np.array([len(x) // 4 for x in made])
        at = len(self.ids) + np.cumsum(length) - length
        self.known, self.at, self.length = (np.insert(a, place, b) for a, b in ((self.known, unit), (self.at, at), (self.length, length)))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])

    def forget(self) -> None:
        self.known, self.at, self.length, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, ends = self.compose([x.encode() for x in rows])
        return [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def ids_of(self, text: str) -> list[int]:
        return self.compose([text.encode()])[0].tolist()


def _unit_hash(buf: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of a buffer, eight bytes at a time. A text whose units were taken for others would not be
    decoded to itself, which is checked."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    low = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    h = mix(eight[start] & low[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(BASE)
    long, at = np.flatnonzero(size > 8), 8
    while len(long):
        h[long] = mix(h[long] ^ (eight[start[long] + at] & low[np.minimum(size[long] - at, 8)]))
        at += 8
        long = long[size[long] > at]
    return mix(h)


class Decoder:
    """The inverse transducers: ids to the bytes of pieces, space signs to spaces, less the one at the start."""

    def __init__(self, machine: Machine):
        wide = int(max(machine.id_of.max(), machine.byte.max())) + 1
        out = [b""] * wide
        for i, p in zip(machine.id_of.tolist(), machine.text):
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(machine.byte.tolist()):
            out[i] = bytes([b])
        self.size = np.array([len(x) for x in out])
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(out), np.uint8)

    def written(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes that the ids write, and where those of each end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.letters[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes(), ends

    def decode(self, ids: bytes) -> bytes:
        text = self.written(np.frombuffer(ids, "<u4"))[0]
        return text[1:] if text[:1] == b" " else text


def sentencepiece_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_ids, n_bytes (ids of byte pieces), ids_crc32, round_trip (and ids if asked for).

    round_trip tells whether decoding gives the text again; it does unless the text itself holds the space sign.
    Null and empty texts have no ids. Repeated rows are encoded each; further columns are ignored; an empty table
    gives an empty result.
    """
    machine = docs.sparkSession.sparkContext.broadcast(load(path))  # as large as the vocabulary
    name = f"encoder_{zlib.crc32(repr(machine.value.text).encode())}"

    def make():
        encoder, decoder = remembered(name, lambda: Encoder(machine.value)), Decoder(machine.value)
        is_byte = np.zeros(len(decoder.size), bool)
        is_byte[machine.value.byte] = True

        def step(ids: list, raw: list) -> dict:
            made, ends = encoder.compose(raw)
            text, letters = decoder.written(made)
            n_bytes = np.append(0, np.cumsum(is_byte[made]))
            letters = np.append(0, letters)
            cuts = [*zip([0, *ends.tolist()], ends.tolist())]
            out = {"id": ids, "n_ids": [b - a for a, b in cuts], "n_bytes": [int(n_bytes[b] - n_bytes[a]) for a, b in cuts], "ids_crc32": [zlib.crc32(made[a:b].tobytes()) for a, b in cuts]}
            out["round_trip"] = [text[letters[a] : letters[b]] == b" " * (x != b"") + x for (a, b), x in zip(cuts, raw)]
            return out | ({"ids": [made[a:b].astype(np.int32).tolist() for a, b in cuts]} if with_ids else {})

        return step

    schema = "id long, n_ids long, n_bytes long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return map_rows(texts(docs, id_col, text_col), make, schema, keeps=True).withColumnRenamed("id", id_col)
