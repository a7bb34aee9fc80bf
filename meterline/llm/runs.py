"""Periodic runs of words: Lempel-Ziv factors from a suffix automaton, runs that meet a factor's start by Main's algorithm,
runs inside a factor copied from its earlier occurrence."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, documents

#: A run repeats its period at least so often and has at least so many words.
TIMES, LEAST = 4, 6


class Automaton:
    """The suffix automaton of a sequence of small numbers, with the end of each state's first occurrence.

    Most states have one transition: it lies in two arrays; only states with more have a dictionary.
    """

    def __init__(self, word: list[int]):
        self.length, self.link, self.first = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.letter, self.target, self.more = array("i", [-1]), array("i", [-1]), {}
        last = 0
        for i, c in enumerate(word):
            last = self._add(last, c, i)

    def go(self, state: int, c: int) -> int:
        if self.letter[state] == c:
            return self.target[state]
        more = self.more.get(state)
        return more.get(c, -1) if more else -1

    def _put(self, state: int, c: int, to: int) -> None:
        if self.letter[state] in (-1, c):
            self.letter[state], self.target[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _state(self, length: int, first: int) -> int:
        for a, x in ((self.length, length), (self.link, 0), (self.first, first), (self.letter, -1), (self.target, -1)):
            a.append(x)
        return len(self.length) - 1

    def _add(self, last: int, c: int, end: int) -> int:
        new, p = self._state(self.length[last] + 1, end), last
        while p >= 0 and self.go(p, c) < 0:
            self._put(p, c, new)
            p = self.link[p]
        if p < 0:
            return new
        q = self.go(p, c)
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        twin = self._state(self.length[p] + 1, self.first[q])
        self.letter[twin], self.target[twin], self.link[twin] = self.letter[q], self.target[q], self.link[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        while p >= 0 and self.go(p, c) == q:
            self._put(p, c, twin)
            p = self.link[p]
        self.link[q] = self.link[new] = twin
        return new


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence): each factor is the longest prefix of what is left that occurs earlier,
    overlaps allowed; a letter that is new is a factor of its own, with -1."""
    a, out, i, n = Automaton(word), [], 0, len(word)
    while i < n:
        state, j = 0, i
        while j < n and 0 <= (to := a.go(state, word[j])) and a.first[to] < j:
            state, j = to, j + 1
        out.append((i, max(j, i + 1), a.first[state] - (j - i) + 1 if j > i else -1))
        i = max(j, i + 1)
    return out


def prefixes(word: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of what begins there and the whole."""
    n = len(word)
    z = [n] + [0] * (n - 1) if n else []
    low = high = 0
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def meeting(word: list[int], before: int, start: int, end: int, times: int, least: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of the runs that start at or before `start` and end in (start, end], `before` being the start of
    the previous factor. Main's algorithm: for each period the common extensions around the factor's start."""
    found: dict[tuple[int, int], int] = {}
    u = end - start
    # A run that reaches over the previous factor by more than its period would have made that factor longer.
    most = (end - before) // (times - 1)
    left = word[max(0, before - most) : start]
    right = word[start:end]
    t = len(left)

    def note(a: int, b: int, p: int) -> None:
        if b - a >= max(least, times * p) and b > start and not (b < len(word) and word[b] == word[b - p]):
            found[a, b] = min(p, found.get((a, b), p))

    def back(a: int, p: int) -> int:
        """The run's real start: `left` may be cut where a longer run of the same period goes on."""
        while a > 0 and word[a - 1] == word[a - 1 + p]:
            a -= 1
        return a

    ahead = prefixes([*right, -1, *left, *right])  # of `right`, at each place of `left` and of itself
    behind = prefixes([*left[::-1], -1, *right[::-1], *left[::-1]])  # suffixes of `left`, the other way round
    for p in range(1, min(u, most) + 1):  # the second period begins in the factor
        forth = ahead[u + 1 + t + p] if p < u else 0
        over = min(behind[t + 1 + u - p], t) if t else 0
        if over + forth + p >= times * p:
            note(back(start - over, p), start + p + forth, p)
    for p in range(1, min(t, most) + 1):  # the first period ends at the factor's start
        forth = min(ahead[u + 1 + t - p], u)
        over = min(behind[t + 1 + u + p], t - p) if p < t else 0
        if over + forth + p >= times * p and forth:
            note(back(start - p - over, p), start + forth, p)
    return found


def periodic_runs(word: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of at least max(least, times * period) letters, by start and period.

    `times` is at least 3. A run whose last letter lies in a factor either starts no later than that factor, and is found at its
    start, or lies after its start, and then its copy in the factor's earlier occurrence is known already.
    """
    known: list[tuple[int, int, int]] = []  # by start
    before = 0
    for start, end, source in factors(word):
        for (a, b), p in meeting(word, before, start, end, times, least).items():
            insort(known, (a, b, p))
        before = start
        if source < 0:
            continue
        shift, at = start - source, bisect_left(known, (source + 1,))
        while at < len(known) and known[at][0] < source + end - start:  # what is copied may be copied again further on
            a, b, p = known[at]
            a, b = a + shift, min(b + shift, end)
            at += 1
            if a > start and b - a >= max(least, times * p) and not (b == end and b < len(word) and word[b] == word[b - p]):
                if (a, b, p) not in known[bisect_left(known, (a, b, p)) :][:1]:
                    insort(known, (a, b, p))
    return sorted(known, key=lambda r: (r[0], r[2]))


def stretches(word: np.ndarray, times: int = TIMES) -> list[tuple[int, int]]:
    """Parts of the sequence outside which no run can lie: each three neighbours in a run are met again in it, times - 1 times in
    all at least, so where three neighbours are rarer no run passes. Told again within the parts until none gets smaller."""
    todo, out = [(0, len(word))], []
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        w = word[a:b].astype(np.uint64)
        key = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]  # equal keys of different words only leave more in
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        often = np.empty(len(key), bool)
        often[order] = np.repeat(np.diff(np.append(edges, len(key))) >= times - 1, np.diff(np.append(edges, len(key))))
        if often.all():
            out.append((a, b))
            continue
        turns = np.flatnonzero(np.diff(np.concatenate([[0], often.astype(np.int8), [0]])))
        todo += [(a + int(x), a + int(y) + 2) for x, y in zip(turns[::2], turns[1::2])]
    return out


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start, then period."""
    seen: dict = {}
    numbers = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    out = []
    for a, b in stretches(numbers):
        local: dict = {}
        out += [(a + s, e - s, p) for s, e, p in periodic_runs([local.setdefault(c, len(local)) for c in numbers[a:b].tolist()])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


_OUT = pa.schema([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())])


def find_runs(df: DataFrame, text: str = "text", plant: str | None = None) -> DataFrame:
    """df with `runs` (start, length, period in words, by start, then period) and `collapsed`: the UTF-8 text of the words that no
    run holds after its first period, joined by a space. Columns of df by these names are replaced.

    Words are what ASCII blanks part. A run is a stretch of words with smallest period q, of at least max(6, 4 q) words, that no
    neighbour extends. `plant` names an integer column: where the checksum of its decimal form is divisible by ten, the words
    are made periodic from some place on before runs are sought (the test rule of the query). Null and empty texts have no words,
    no runs and an empty collapsed text, as have tables without rows; a null in `plant` leaves the words alone; repeated rows are
    each answered; a text of any length is taken whole, by the task that reads its row, in memory in proportion to its words.
    """

    def make():
        def run(columns: list[pa.Array]) -> list[pa.Array]:
            found, left = [], []
            ids = columns[1].to_pylist() if plant else [None] * len(columns[0])
            for doc, value in zip(ids, columns[0].to_pylist()):
                words = planted(doc, (value or "").encode().split())
                runs = runs_of(words)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                left.append(b" ".join(kept_words(words, runs)))
            return [pa.array(found, _OUT.field("runs").type), pa.array(left, pa.binary())]

        return run

    ddl = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    return append_columns(df, [text, plant] if plant else [text], _OUT, ddl, make)


def planted(doc: int | None, words: list) -> list:
    """The words, made periodic from a place on for a tenth of the documents."""
    if doc is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(doc).encode()), 10)
    if tenth:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return (words[:a] + part * (-(-(n - a) // p)))[:n]


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: the longest run and checksums of all runs and of the collapsed text."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    t = found.withColumn("__best", F.when(F.size("runs") > 0, best))
    return t.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__best.start").alias("start"), (-F.col("__best.n")).alias("length"), F.col("__best.period").alias("period"),
        F.expr("(-1000 * __best.n) div __best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of words of all `documents`."""
    return digest(find_runs(documents(spark, sf_dir).select("doc_id", "text"), plant="doc_id"))
