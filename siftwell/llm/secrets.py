"""Secret scans: base patterns, and a character convolutional network over every candidate and its context."""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import forget, give_back, map_rows, saved, texts
from .wordhash import open_bytes, press_bytes

#: The base patterns, least length of what counts, and its group.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
#: A candidate: a run of characters that secrets are made of; a short one must hold a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}|(?<![A-Za-z0-9+/_.=-])(?=[^ \n]{0,14}[0-9])(?=[^ \n]{0,14}[A-Za-z])[A-Za-z0-9+/_.=-]{8,15}(?![A-Za-z0-9+/_.=-])")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: Characters that the network sees before, in and after a candidate, and how far its windows lie apart in a longer one.
BEFORE, INSIDE, AFTER, STRIDE = 24, 48, 8, 32
#: Windows that a task trains on at a time, about; there are as many shards as all windows of the table need.
SHARD = 9000
#: Made-up secrets, and as many other strings, that are put in contexts of each shard.
MADE = 4000
#: Times that all windows are gone through, and steps of a unit in which scores before the logistic function are counted.
ROUNDS, GRID = 8, 64
#: Share of held-back findings that the thresholds must keep, and findings of a shape from which it has its own.
RECALL, OWN = 0.95, 20
#: Shapes of a candidate; each has a threshold.
SHAPES = ("hex", "upper", "short", "parted", "mixed")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings: leftmost, not overlapping in their kind; short ones are dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def may_hold(raw: bytes) -> bool:
    """False only if a text (as bytes) has no base findings."""
    return b"AKIA" in raw or any(k in low for low in [raw.lower()] for k in KEYWORDS) or _LONG_HEX.search(raw) is not None


_LONG_HEX = re.compile(rb"[0-9a-f]{24}")


CANDIDATE_CHARACTER = re.compile(r"[A-Za-z0-9+/_.=-]")


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character codes (0: none, 1-95: visible ASCII, 96: other) of the context and the candidate, at fixed places."""
    out = np.zeros(BEFORE + INSIDE + AFTER, np.int8)
    for at, part in ((0, text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")), (BEFORE, text[start : min(end, start + INSIDE)]), (BEFORE + INSIDE, text[end : end + AFTER])):
        codes = np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.int64)
        out[at : at + len(codes)] = np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 31, 96))
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Windows that together hold the whole candidate: one, or overlapping ones for a long candidate."""
    heads = [start, *range(start + STRIDE, end - INSIDE + STRIDE, STRIDE)] if end - start > INSIDE else [start]
    return [window(text, h, min(end, h + INSIDE)) for h in heads]


def shape(x: np.ndarray) -> np.ndarray:
    """Number in SHAPES of the candidate in each window."""
    inside = x[:, BEFORE : BEFORE + INSIDE].astype(np.int64) + 31
    none, digit = inside == 31, (inside >= 48) & (inside <= 57)
    lower, upper = (inside >= 97) & (inside <= 122), (inside >= 65) & (inside <= 90)
    hexadecimal = (none | digit | lower & (inside <= 102)).all(1)
    forms = [(~none).sum(1) < 16, hexadecimal, (none | digit | upper).all(1), (none | digit | upper | lower).all(1)]
    return np.select(forms, [2, 0, 1, 4], 3)


@dataclass
class Network:
    """Embedding, one convolution, greatest value over the context and over the candidate, logistic output."""

    table: np.ndarray  # 97 x d
    kernel: np.ndarray  # width x d x filters
    bias: np.ndarray
    weight: np.ndarray  # 2 * filters
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (1.1,) * len(SHAPES)

    def forward(self, x: np.ndarray) -> tuple:
        e = self.table[x]
        width = self.kernel.shape[0]
        n = x.shape[1] - width + 1
        z = self.bias + sum(e[:, k : k + n] @ self.kernel[k] for k in range(width))
        context = np.r_[0 : BEFORE - width + 1, BEFORE + INSIDE : n]
        inside = np.arange(BEFORE - width + 1, BEFORE + INSIDE)[: n - (BEFORE - width + 1)]
        peaks = [part[z[:, part].argmax(1)] for part in (context, inside)]
        rows = np.arange(len(x))[:, None]
        cols = np.arange(z.shape[2])[None, :]
        h = np.concatenate([np.maximum(z[rows, p, cols], 0) for p in peaks], axis=1)
        return e, peaks, h, h @ self.weight + self.shift

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.raw(x) + self.scale[1])))


def made(x: np.ndarray, number: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up secrets (1) and of other strings (0), `number` of each, in contexts of the windows x."""
    decode = lambda codes: "".join("é" if c == 96 else chr(c + 31) for c in codes.tolist() if c)
    inside = [decode(w) for w in x[:, BEFORE : BEFORE + INSIDE]]
    words = sorted({p.lower() for s in inside for p in re.findall(r"[A-Za-z]{3,12}", s) if p[1:].islower()}) or ["text"]
    out, label = [], []
    for k in range(2 * number):
        context = x[int(rng.integers(len(x)))]
        before, after = decode(context[:BEFORE]), decode(context[BEFORE + INSIDE :])
        if CANDIDATE_CHARACTER.match(after):
            after = ""
        token = tokens.secret(rng) if k % 2 else tokens.plain(rng, words)
        found = windows(before + token + after, len(before), len(before) + len(token))
        out.append(found[int(rng.integers(len(found)))])
        label.append(k % 2)
    return np.array(out), np.array(label)


@dataclass
class Shards:
    """Rows (shard, data) of `number` shards; data are packed arrays: windows, labels, and the part 0-4 of each."""

    rows: DataFrame
    number: int

    def each(self, step: Callable, schema: str) -> DataFrame:
        """step(shard, windows, labels, parts) gives the columns of some rows for each shard."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist()):
                    yield pa.RecordBatch.from_pydict(step(shard, *pickle.loads(open_bytes(data))))

        return self.rows.repartition(self.number, "shard").mapInArrow(run, schema)


def _sealed(*arrays: np.ndarray) -> bytes:
    return press_bytes(pickle.dumps(arrays, 5), 1)


def sharded(found: DataFrame, seed: int = 5) -> Shards | None:
    """All windows of found (label, window) in shards by a hash, made-up ones added to each; None if there are fewer than 40."""
    n = found.count()
    if n < 40:
        return None
    number = -(-n // SHARD)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rng = np.random.default_rng([seed, shard])
        own = sorted(zip(table.column("window").to_pylist(), table.column("label").to_pylist()))
        x = np.array([np.frombuffer(w, np.int8) for w, _ in own])
        more, label = made(x, MADE, rng)
        x, y = np.concatenate([x, more]), np.concatenate([[v for _, v in own], label])
        order = rng.permutation(len(x))
        part = np.arange(len(x)) * 5 // len(x)  # 0-2: training, 3: calibration, 4: thresholds
        return pa.table({"shard": pa.array([shard], pa.int32()), "data": pa.array([_sealed(x[order], y[order].astype(np.int8), part.astype(np.int8))], pa.binary())})

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("window"), F.lit(number)).cast("int"))
    return Shards(saved(dealt.groupBy("shard").applyInArrow(pack, "shard int, data binary")), number)


def fit(shards: Shards, seed: int = 5) -> Network:
    """A network from windows of findings (1) and of other candidates, which nobody has labelled (0), and from made-up secrets and
    other strings in the contexts of both.

    A first network, for which all others are no secrets, tells which of them look like secrets: those that score higher than half
    of the held-back ones. They are left out, and the final network learns from the rest. Half of the contexts are
    exchanged between findings and others, so that the characters of a candidate count and not only the words before it. Three
    fifths of the windows train, one fifth calibrates the scores, the last fifth sets for each shape the greatest threshold that
    keeps RECALL of its secrets. Every window of the table is in one of these parts; scores are counted by bins of 1 / GRID.
    """
    first = _descend(shards, seed)
    middle = _low([(b, n) for _, label, _, b, n in _counts(shards, first, None) if label == 1], 0.5)

    def sure(shard: int, x: np.ndarray, y: np.ndarray, part: np.ndarray) -> dict:
        stay = (y == 1) | (first.raw(x) < middle)
        return {"shard": pa.array([shard], pa.int32()), "data": [_sealed(x[stay], y[stay], part[stay])]}

    shards = Shards(saved(shards.each(sure, "shard int, data binary")), shards.number)
    net = _descend(shards, seed + 1)
    counts = _counts(shards, net, seed)
    net.scale = _platt(*(np.array(c, float) for c in zip(*[((b + 0.5) / GRID, label, n) for part, label, _, b, n in counts if part == 3])))
    last = [(of, b, n) for part, label, of, b, n in counts if part == 4 and label == 1]
    out = []
    for k in range(len(SHAPES)):
        own = [(b, n) for of, b, n in last if of == k]
        least = _low(own if sum(n for _, n in own) >= OWN else [(b, n) for _, b, n in last], 1 - RECALL)
        out.append(float(1 / (1 + np.exp(-(net.scale[0] * least + net.scale[1])))))
    net.thresholds = tuple(out)
    return net


def _low(counts: list[tuple[int, int]], share: float) -> float:
    """The lower edge of the bin below which less than `share` of the counted (bin, number) lie."""
    bins, n = (np.array(c) for c in zip(*sorted(counts)))
    return float(bins[np.searchsorted(np.cumsum(n), int(share * n.sum()), side="right")]) / GRID


def _counts(shards: Shards, net: Network, swap: int | None) -> list[tuple]:
    """(part, label, shape, bin, number) of the held-back windows of all shards; swap: a seed, those with exchanged contexts too."""

    def count(shard: int, x: np.ndarray, y: np.ndarray, part: np.ndarray) -> dict:
        out = []
        for p in (3, 4):
            xs, ys = x[part == p], y[part == p]
            if swap is not None:
                xs, ys = _swapped(xs, ys, np.random.default_rng([swap, shard, p]))
            b = np.clip(np.floor(net.raw(xs) * GRID), -GRID * 64, GRID * 64).astype(np.int64)
            out.append(np.stack([np.full(len(ys), p), ys, shape(xs), b], 1))
        rows, n = np.unique(np.concatenate(out), axis=0, return_counts=True)
        return {**{c: pa.array(rows[:, k].astype(np.int32)) for k, c in enumerate(("part", "label", "shape", "bin"))}, "n": pa.array(n)}

    found = shards.each(count, "part int, label int, shape int, bin int, n long")
    return [tuple(r) for r in found.groupBy("part", "label", "shape", "bin").agg(F.sum("n")).collect()]  # as many as there are bins at most


def _swapped(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The windows, and once more those with the context of a window of the other label."""
    if not (y == 1).any() or not (y == 0).any():
        return x, y
    again = x.copy()
    for label in (0, 1):
        at, other = np.flatnonzero(y == label), np.flatnonzero(y != label)
        from_ = rng.choice(other, len(at))
        again[at, :BEFORE] = x[from_, :BEFORE]
        again[at, BEFORE + INSIDE :] = x[from_, BEFORE + INSIDE :]
    return np.concatenate([x, again]), np.concatenate([y, y])


#: Weights of a network, one behind the other.
WEIGHTS = {"table": (97, 8), "kernel": (5, 8, 16), "bias": (16,), "weight": (32,), "shift": ()}


def _network(flat: np.ndarray) -> Network:
    """A network on views of flat weights (shift: a copy)."""
    parts, at = {}, 0
    for name, form in WEIGHTS.items():
        size = int(np.prod(form))
        parts[name] = flat[at : at + size].reshape(form) if form else float(flat[at])
        at += size
    return Network(**parts)


def _descend(shards: Shards, seed: int) -> Network:
    """Weights by stochastic gradient descent with moments over the windows of parts 0-2; both labels count alike.

    In a round each shard goes on from the same weights; then weights and moments are averaged over all shards by their windows.
    """
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.ravel(rng.normal(0, by, form)) if by else np.zeros(form).ravel() for form, by in zip(WEIGHTS.values(), (0.3, 0.2, 0, 0.2, 0))])
    state = np.concatenate([flat, np.zeros(2 * len(flat) + 1)])
    for k in range(ROUNDS):

        def step(shard: int, x: np.ndarray, y: np.ndarray, part: np.ndarray, state: np.ndarray = state, k: int = k) -> dict:
            draw = np.random.default_rng([seed, shard, k])
            xs, ys = _swapped(x[part < 3], y[part < 3], draw)
            return {"shard": pa.array([shard], pa.int32()), "n": pa.array([len(ys)]), "data": [(len(ys) * _round(state, xs, ys, draw)).tobytes()]}

        state = _average(shards.each(step, "shard int, n long, data binary"), shards.number)
    return _network(state[: len(flat)])


def _average(sums: DataFrame, number: int) -> np.ndarray:
    """Of rows (shard, n, data: n times a vector) the average vector; added up 64 at a time in the order of the shards."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("shard", "n", "data"))))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(r[1] for r in rows)]), "data": pa.array([sum(np.frombuffer(r[2]) for r in rows).tobytes()], pa.binary())})

    while number > 64:
        sums = sums.groupBy(F.expr("shard div 64").cast("int").alias("g")).applyInArrow(add, "shard int, n long, data binary")
        number = -(-number // 64)
    rows = sorted(tuple(r) for r in sums.collect())  # 64 at most
    return sum(np.frombuffer(bytes(r[2])) for r in rows) / sum(r[1] for r in rows)


def _round(state: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rate: float = 0.01) -> np.ndarray:
    """The state (weights, first and second moments, number of steps) after all windows, 64 at a time."""
    n = (len(state) - 1) // 3
    flat, first, second = (state[k * n : k * n + n].copy() for k in range(3))
    t, share, net = state[-1], y.mean(), _network(flat)
    width, d, filters = WEIGHTS["kernel"]
    order = rng.permutation(len(x))
    for i in range(0, len(x), 64):
        xb, yb = x[order[i : i + 64]], y[order[i : i + 64]]
        net.shift = float(flat[-1])
        _, peaks, h, raw = net.forward(xb)
        g = (1 / (1 + np.exp(-raw)) - yb) * np.where(yb == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(yb)
        dh = (g[:, None] * net.weight * (h > 0)).reshape(len(yb), 2, filters)
        place = np.stack(peaks, 1)[:, :, :, None] + np.arange(width)  # window, half, filter, place in the kernel
        code = xb[np.arange(len(yb))[:, None, None, None], place].astype(np.int64)
        cell = (np.arange(width) * 97 + code) * filters + np.arange(filters)[:, None]
        by = np.bincount(cell.ravel(), np.repeat(dh.ravel(), width), width * 97 * filters).reshape(width, 97, filters)
        slope = np.concatenate([np.einsum("kcf,kdf->cd", by, net.kernel).ravel(), (net.table.T @ by).ravel(), dh.sum((0, 1)), h.T @ g, [g.sum()]])
        t += 1
        first += 0.1 * (slope - first)
        second += 0.001 * (slope**2 - second)
        flat -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return np.concatenate([flat, first, second, [t]])


def _platt(raw: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic calibration with softened targets, by gradient steps; n: how many have that score and label."""
    yes, no, n = (y * n).sum(), ((1 - y) * n).sum(), n / n.sum()
    target = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        g = n * (1 / (1 + np.exp(-(a * raw + b))) - target)
        a, b = max(0.05, a - 0.1 * float((g * raw).sum()) / (1 + float((n * raw**2).sum()))), b - 0.5 * float(g.sum())
    return a, b


def found_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, window), each once, of all documents: findings of the base patterns (1) and other candidates (0)."""

    def make():
        def step(ids: list, raw: list) -> dict:
            out: dict = {"label": [], "window": []}
            for x in raw:
                text = x.decode()
                base = base_spans(text) if may_hold(x) else []
                values = {(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6} if base else set()
                values |= {s[:2] for s in base if s[2] != "assign"}
                others = {c for c in candidates(text) if not any(a < c[1] and c[0] < b for a, b, _ in base)}
                for label, spans in ((1, values), (0, others)):
                    for a, b in sorted(spans):
                        for w in windows(text, a, b):
                            out["label"].append(label)
                            out["window"].append(w.tobytes())
            return out

        return step

    return map_rows(texts(docs, id_col, text_col), make, "label int, window binary").distinct()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Learns from all findings of the base patterns and all other candidates of the documents; None if there are hardly any."""
    shards = sharded(saved(found_windows(docs, id_col, text_col)))
    return shards and fit(shards)


def all_spans(rows: list[str], net: Network | None) -> list[list[tuple[int, int, str, float]]]:
    """For each text its base findings (score 1) and the other candidates that reach the network's threshold for
    their shape in any window. A candidate that holds base findings and reaches beyond them is judged, too."""
    out, asked, x = [], [], []
    for i, text in enumerate(rows):
        base = base_spans(text) if may_hold(text.encode()) else []
        out.append([(*s, 1.0) for s in base])
        if net is not None:
            for c in candidates(text):
                if not any(a <= c[0] and c[1] <= b for a, b, _ in base):
                    for w in windows(text, *c):
                        asked.append((i, c))
                        x.append(w)
    if x:
        seen = np.array(x)
        score = net.score(seen)
        enough = score >= np.array(net.thresholds)[shape(seen)]
        best: dict = {}
        for k in np.flatnonzero(enough).tolist():
            best[asked[k]] = max(best.get(asked[k], 0.0), float(score[k]))
        for (i, c), p in best.items():
            out[i].append((*c, "model", p))
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in out]


def joined(spans: list) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def secrets(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_model.

    Places count code points, ends exclusive. Null and empty texts have no spans (base_sha256 is that of the empty
    string). Repeated rows are scanned each; further columns are ignored; an empty table gives an empty result.
    """

    def make():
        empty = hashlib.sha256(b"").hexdigest()

        def step(ids: list, raw: list) -> dict:
            out: dict = {"id": ids, "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_model": []}
            for spans in all_spans([x.decode() for x in raw], net):
                base = [s for s in spans if s[2] != "model"]
                n = [sum(s[2] == k for s in spans) for k in KINDS]
                for c, v in zip(list(out)[1:], (*n[:3], hashlib.sha256(joined(base).encode()).hexdigest() if base else empty, joined(spans), n[3])):
                    out[c].append(v)
            return out

        return step

    return map_rows(texts(docs, id_col, text_col), make, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long").withColumnRenamed("id", id_col)


def masked(text: str, spans: list) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_column(net: Network | None):
    """A function of a text column: the text with its secrets masked."""

    @F.arrow_udf("string")
    def mask(rows: pa.Array) -> pa.Array:
        forget()
        out, part, spans, start = [], [], [], 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(rows), 0).to_pylist()
        while start < len(rows):  # about a MB at a time
            end, held = start + 1, sizes[start]
            while end < len(rows) and held + sizes[end] <= 1 << 20:
                held += sizes[end]
                end += 1
            part = rows.slice(start, end - start).to_pylist()
            spans = all_spans([x or "" for x in part], net)
            out += [x if x is None else masked(x, s) for x, s in zip(part, spans, strict=True)]
            start = end
        array = pa.array(out, pa.string())
        del out, part, spans
        give_back()
        return array

    return mask
