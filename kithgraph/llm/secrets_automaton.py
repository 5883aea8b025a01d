"""Secrets in texts: fixed base patterns, and formats that a probabilistic automaton has inferred.

Labelled credentials are made by a seeded generator from the public shapes of common key formats, and
ordinary long tokens (words, names of variables, paths, numbers, dates) likewise. Each set becomes a
prefix tree with counts; then states whose outgoing frequencies are statistically compatible (Hoeffding
bound, recursively) are merged, breadth first, until a small deterministic automaton is left for each.
Every run of 16 or more credential characters in a text is a candidate; its score is the difference of
the two automata's log likelihoods for each character. The threshold is the one that accepts no more than
one in a thousand of generated ordinary tokens that the fit has not seen, and is at least ``margin``.

A start that many labelled credentials share is one symbol; all other symbols are character classes.

Nulls: a null text is empty and has no spans. Rows with a null id, and rows that repeat, are scanned like
others. Other columns are ignored. Spans count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm import words

# The base patterns (fixed values of the contract).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, of 32 or more
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "format")

# -- grammar inference ----------------------------------------------------------------------------

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CLASS = {c: "h" if c < "g" else "l" for c in _LOWER} | {c: "H" if c < "G" else "U" for c in _UPPER} | {c: "0" for c in _DIGIT} | {c: c for c in "+/_.=-"}
#: Characters of each class, by which a class's chance is shared out.
_WIDTH = {"h": 6, "l": 20, "H": 6, "U": 20, "0": 10}


def prefixes(samples: list[str], least: int) -> list[str]:
    """Starts of 3 to 8 characters that ``least`` of the samples share, the longest first."""
    out: list[str] = []
    for k in range(8, 2, -1):
        held = Counter(s[:k] for s in samples if not s.startswith(tuple(out)))
        out += sorted(x for x, n in held.items() if n >= least)
    return out


class Automaton:
    """A deterministic probabilistic automaton, by merging compatible states of the prefix tree of samples."""

    def __init__(self, samples: list[str], heads: list[str], alpha: float = 0.02, least: int = 10):
        self.heads = tuple(heads)
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.stop, self.seen = [0], [0]
        for s in samples:
            at = 0
            for x in self.symbols(s):
                self.seen[at] += 1
                self.count[at][x] += 1
                if x not in self.next[at]:
                    self.next[at][x] = self._state()
                at = self.next[at][x]
            self.seen[at] += 1
            self.stop[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge(least)

    def symbols(self, token: str) -> list[str]:
        head = next((x for x in self.heads if token.startswith(x)), "")
        return ["^" + head] * bool(head) + [_CLASS[c] for c in token[len(head) :]]

    def _state(self) -> int:
        self.next.append({})
        self.count.append(defaultdict(int))
        self.stop.append(0)
        self.seen.append(0)
        return len(self.seen) - 1

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(f / n - g / m) > self.bound * (n**-0.5 + m**-0.5)

    def _alike(self, a: int, b: int) -> bool:
        """b heads a tree, so that the recursion ends."""
        pairs = [(a, b)]
        while pairs:
            x, y = pairs.pop()
            if self._differ(self.stop[x], self.seen[x], self.stop[y], self.seen[y]):
                return False
            for s in self.count[x].keys() | self.count[y].keys():
                if self._differ(self.count[x].get(s, 0), self.seen[x], self.count[y].get(s, 0), self.seen[y]):
                    return False
                if s in self.next[x] and s in self.next[y]:
                    pairs.append((self.next[x][s], self.next[y][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree at b to state a."""
        pairs = [(a, b)]
        while pairs:
            x, y = pairs.pop()
            self.seen[x] += self.seen[y]
            self.stop[x] += self.stop[y]
            for s, n in self.count[y].items():
                self.count[x][s] += n
                if s in self.next[x]:
                    pairs.append((self.next[x][s], self.next[y][s]))
                else:
                    self.next[x][s] = self.next[y][s]

    def _merge(self, least: int) -> None:
        final, fringe = [0], [(0, s) for s in sorted(self.next[0])]
        while fringe:
            k = max(range(len(fringe)), key=lambda i: (self.seen[self.next[fringe[i][0]][fringe[i][1]]], -i))
            parent, s = fringe.pop(k)
            state = self.next[parent][s]
            if state in final:
                continue
            if self.seen[state] < least:
                continue  # too few samples to judge; the branch stays as it is
            for other in sorted(final, key=lambda f: f != parent):
                if self._alike(other, state):
                    self.next[parent][s] = other
                    self._fold(other, state)
                    break
            else:
                final.append(state)
            fringe = [(f, x) for f in final for x in sorted(self.next[f]) if self.next[f][x] not in final and self.seen[self.next[f][x]] >= least]
        self.states = len(final)

    def loglik(self, token: str) -> float:
        """Mean log likelihood of a character."""
        at, total = 0, 0.0
        for x in self.symbols(token):
            n = self.seen[at] if at is not None else 0
            chance = (self.count[at].get(x, 0) + 0.02) / (n + 0.02 * 12) if n else 0.08
            total += math.log(chance / _WIDTH.get(x, 1))
            at = self.next[at].get(x) if at is not None else None
        return total / max(1, len(token))


# -- labelled tokens ------------------------------------------------------------------------------

_ALNUM, _HEX, _B32 = _UPPER + _LOWER + _DIGIT, _DIGIT + "abcdef", _UPPER + "234567"


def credentials(n: int, seed: int) -> list[str]:
    """n made-up credentials of each shape."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choices(chars, k=k))
    shapes = [
        lambda: "AKIA" + some(_B32, 16),
        lambda: "ASIA" + some(_B32, 16),
        lambda: r.choice(["ghp_", "gho_", "ghs_"]) + some(_ALNUM, 36),
        lambda: "xox" + r.choice("bp") + "-" + some(_DIGIT, 12) + "-" + some(_DIGIT, 12) + "-" + some(_ALNUM, 24),
        lambda: r.choice(["sk_live_", "rk_live_", "sk_test_"]) + some(_ALNUM, 24),
        lambda: "AIza" + some(_ALNUM + "_-", 35),
        lambda: "eyJ" + some(_ALNUM, 33) + "." + "eyJ" + some(_ALNUM, 60) + "." + some(_ALNUM + "_-", 43),
        lambda: "glpat-" + some(_ALNUM, 20),
        lambda: some(_HEX, r.choice([32, 40, 64])),
        lambda: some(_ALNUM + "+/", 40),
        lambda: some(_ALNUM, r.choice([24, 32, 40])),
    ]
    return [f() for f in shapes for _ in range(n)]


def ordinary(n: int, seed: int) -> list[str]:
    """n made-up tokens of each ordinary shape, 16 characters or more."""
    r = random.Random(seed)
    syllable = lambda: r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "t", "l", "ch", "ng"])
    word = lambda k=0: "".join(syllable() for _ in range(k or r.randint(1, 4)))
    number = lambda k: "".join(r.choices(_DIGIT, k=k))
    shapes = [
        lambda: word(r.randint(6, 9)),
        lambda: word(r.randint(6, 9)).capitalize(),
        lambda: word(r.randint(6, 9)).upper(),
        lambda: "_".join(word() for _ in range(r.randint(3, 6))),
        lambda: "-".join(word() for _ in range(r.randint(3, 6))),
        lambda: ".".join(word() for _ in range(r.randint(3, 6))),
        lambda: "/".join(word() for _ in range(r.randint(3, 6))),
        lambda: "".join(word().capitalize() for _ in range(r.randint(4, 6))),
        lambda: number(r.randint(16, 24)),
        lambda: f"{r.randint(1990, 2030)}-{number(2)}-{number(2)}-{word(3)}",
        lambda: "/".join([word(), number(4), number(2), word(3), word(2)]),
        lambda: r.choice("-=_.+") * r.randint(16, 60),
        lambda: f"{word(2)}.{word(2)}.{number(1)}.{number(2)}.{number(1)}-{word(1)}",
    ]
    return [x for f in shapes for x in (f() for _ in range(n)) if len(x) >= 16]


@lru_cache(maxsize=4)
def trained(n: int = 150, margin: float = 0.3, seed: int = 7) -> tuple[Automaton, Automaton, float]:
    known = credentials(n, seed)
    secret, plain = Automaton(known, prefixes(known, n // 8)), Automaton(ordinary(n, seed), [])
    unseen = sorted((secret.loglik(x) - plain.loglik(x) for x in ordinary(n, seed + 1)), reverse=True)
    return secret, plain, max(margin, unseen[len(unseen) // 1000])


# -- scanning -------------------------------------------------------------------------------------

_CREDENTIAL = np.zeros(256, bool)
_CREDENTIAL[list(b"+/_.=-" + (_UPPER + _LOWER + _DIGIT).encode())] = True
_EDGE = "+/_.=-"


def _runs(data: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end (bytes) of the runs of credential characters."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = _CREDENTIAL[data]
    step = np.diff(mask)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(at) > 2:  # a run ends with its document
        cuts = np.unique(at[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[(mask[cuts] == 1) & (mask[cuts + 1] == 1)]
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    long = end - start >= least
    start, end = start[long], end[long]
    return np.searchsorted(at, start, side="right") - 1, start, end


def pieces(run: str, least: int = 16) -> Iterator[tuple[int, str]]:
    """The candidates in a run of credential characters: between equals signs, without marks at the ends."""
    at = 0
    for part in run.split("="):
        bare = part.strip(_EDGE)
        if len(bare) >= least:
            yield at + part.index(bare), bare
        at += len(part) + 1


def spans_of(text: str, raw: bytes, runs: list[tuple[int, int]], model: tuple[Automaton, Automaton, float]) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of a text, sorted. runs: byte ranges of 16 or more credential characters."""
    out: list[tuple[int, int, int]] = []
    lower = raw.lower()  # of bytes: only A-Z change
    if any(x in lower for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if any(b - a >= 32 for a, b in runs):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    secret, plain, least = model
    for a, b in runs:
        for k, token in pieces(raw[a:b].decode("ascii")):
            if secret.loglik(token) - plain.loglik(token) >= least:
                start = len(raw[:a].decode("utf-8", "replace")) + k
                if not any(x < start + len(token) and start < y for x, _, y in out):
                    out.append((start, 3, start + len(token)))
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(n: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained(n, margin)
        for batch in batches:
            at, data = words.text_buffers(batch.column(1))
            counts, digests, joined = [], [], []
            for i, j in words.spans(at):
                part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for d, a, b in zip(*(x.tolist() for x in _runs(part, own, 16)), strict=True):
                    runs[d].append((a - int(own[d]), b - int(own[d])))
                whole = part.tobytes()
                for d in range(j - i):
                    raw = whole[own[d] : own[d + 1]]
                    found = spans_of(raw.decode("utf-8", "replace"), raw, runs.get(d, []), model)
                    base = [x for x in found if x[1] < 3]
                    counts.append([sum(x[1] == k for x in found) for k in range(4)])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    joined.append(_joined(found))
            columns = list(zip(*counts, strict=True)) if counts else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(columns[3], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return run


def secret_spans(docs: DataFrame, samples: int = 150, margin: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), n_format."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(samples, margin), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
