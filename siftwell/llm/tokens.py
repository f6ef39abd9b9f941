"""Made-up tokens to learn from: secrets of many formats, and strings of the same characters that are none."""

from __future__ import annotations

import base64
import uuid

import numpy as np

LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
BASE62 = DIGITS + LOWER + LOWER.upper()
#: Published prefixes of tokens, and how many characters follow.
PREFIXES = (("ghp_", 36, 36), ("gho_", 36, 36), ("github_pat_", 60, 82), ("glpat-", 20, 20), ("AIza", 35, 35), ("sk_live_", 24, 24), ("rk_live_", 24, 24), ("sk-", 40, 48), ("npm_", 36, 36), ("hf_", 34, 34), ("SG.", 22, 22), ("ya29.", 40, 60))


def _pick(rng: np.random.Generator, letters: str, low: int, high: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(low, high + 1))))


def _mixed(rng: np.random.Generator, low: int, high: int) -> str:
    """Letters of both cases and digits, some of each."""
    while True:
        s = _pick(rng, BASE62, low, high)
        if any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s):
            return s


def secret(rng: np.random.Generator) -> str:
    """A secret in one of the usual formats."""
    kind = int(rng.integers(0, 10))
    if kind == 0:
        head, low, high = PREFIXES[int(rng.integers(len(PREFIXES)))]
        return head + _pick(rng, BASE62, low, high)
    if kind == 1:  # an own prefix
        return _pick(rng, LOWER, 2, 6) + "_-."[int(rng.integers(3))] + _mixed(rng, 20, 40)
    if kind == 2:
        return "xox" + "bpar"[int(rng.integers(4))] + "-" + _pick(rng, DIGITS, 10, 12) + "-" + _pick(rng, DIGITS, 10, 13) + "-" + _mixed(rng, 24, 24)
    if kind == 3:  # a signed web token
        part = lambda low, high: base64.urlsafe_b64encode(('{"' + _pick(rng, LOWER, 2, 5) + '":"' + _pick(rng, BASE62, low, high)).encode()).decode().rstrip("=")
        return f"{part(10, 24)}.{part(20, 60)}.{_pick(rng, BASE62 + '_-', 43, 43)}"
    if kind == 4:
        return _pick(rng, BASE62 + "+/", 40, 40)
    if kind == 5:
        return base64.b64encode(rng.bytes(int(rng.integers(16, 48)))).decode()
    if kind == 6:
        return _mixed(rng, 20, 48)
    if kind == 7:
        return _pick(rng, DIGITS + "ABCDEF", 24, 64)
    if kind == 8:
        return _pick(rng, DIGITS + LOWER.upper(), 20, 32)
    return _mixed(rng, 10, 19)


def plain(rng: np.random.Generator, words: list[str]) -> str:
    """A string that is no secret: identifiers, paths, versions, dates, numbers, encoded text, made of `words`."""
    some = lambda low, high: [words[i] for i in rng.integers(0, len(words), int(rng.integers(low, high + 1)))]
    kind = int(rng.integers(0, 9))
    if kind == 0:
        return str(uuid.UUID(bytes=rng.bytes(16)))
    if kind == 1:
        return "/".join(some(3, 6)) + "." + _pick(rng, LOWER, 2, 4)
    if kind == 2:
        return "-_."[int(rng.integers(3))].join([*some(2, 5), _pick(rng, DIGITS, 1, 4)])
    if kind == 3:
        return "".join(w.capitalize() for w in some(2, 4)) + _pick(rng, DIGITS, 1, 3)
    if kind == 4:
        return f"{rng.integers(1970, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(24):02d}.{rng.integers(60):02d}"
    if kind == 5:
        return _pick(rng, DIGITS, 8, 20)
    if kind == 6:
        return base64.b64encode(" ".join(some(3, 8)).encode()).decode()
    if kind == 7:
        return words[int(rng.integers(len(words)))] + _pick(rng, DIGITS, 1, 6)
    return f"www.{'.'.join(some(1, 2))}.com/{'-'.join(some(1, 4))}/{_pick(rng, DIGITS, 2, 8)}"
