"""Periodic run detection (operator 12): heavy/light lag counting, then island scans of the lags that have enough matches.

A run of period q and length l has l - q neighbouring places whose word equals the word q places on, so a lag with fewer matches in the
whole document than max(LEAST - q, q) can't have a run. The matches of all lags are counted exactly: words that occur more than about
sqrt(n) times by the autocorrelation of their places (FFT, rounded), all others by the differences of their pairs of places. A scan
of a lag finds the stretches of matches (islands) that are long enough; a stretch whose period is a multiple of a smaller one is no run. Matches
inside a run found before are taken off the counts of its period's multiples, as no run of such a lag can hold one of them; so a text
that repeats one word needs one scan, not n. Scans of lags from ``DENSE`` on look at every lag-th place only, at places around
those that match, and at the islands that remain.

Null and empty texts have no words and no runs. Rows that share a doc_id or are equal are judged each for itself; a null doc_id has no
crc32, so its text is left as it is. Ties of length go to the smallest start, then period. An empty table gives no rows; other columns don't count.
"""

from __future__ import annotations

import hashlib
import zlib
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from metaloom.llm.common import map_rows, table

LEAST = 12
#: Lags from which a scan jumps, and the offsets (shares of the lag) at which it looks around a place that matches.
DENSE, LOOKS = 32, 8
#: Cells of the matrices whose spectra are made at once.
CELLS = 1 << 20


def numbers(words: list) -> np.ndarray:
    """Words as numbers by first occurrence."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def lag_matches(x: np.ndarray) -> np.ndarray:
    """For each lag from 0 to half the length: how many places hold the word that stands that many places on."""
    n, most = len(x), len(x) // 2
    counts = np.bincount(x)
    heavy = np.flatnonzero(counts > max(LEAST, isqrt(n)))
    found = _by_spectrum(x, heavy, most) if len(heavy) else np.zeros(most + 1, np.int64)
    light = np.ones(len(counts), bool)
    light[heavy] = False
    light &= counts > 1
    at = np.flatnonzero(light[x])
    at = at[np.argsort(x[at], kind="stable")]
    word = x[at]
    last = np.arange(len(at))  # indices into at whose k-th successor may be the same word's
    k = 1
    while len(last):
        last = last[last + k < len(at)]
        last = last[word[last + k] == word[last]]
        lag = at[last + k] - at[last]
        found += np.bincount(lag[lag <= most], minlength=most + 1)
        k += 1
    return found


def _by_spectrum(x: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    size = 1 << (len(x) + most).bit_length()
    size = size * 3 // 4 if size * 3 // 4 > len(x) + most else size
    power = np.zeros(size // 2 + 1)
    at_once = max(1, CELLS // size)
    for k in range(0, len(words), at_once):
        spectrum = np.fft.rfft((x == words[k : k + at_once, None]).astype(np.float64), size)
        power += (spectrum.real**2 + spectrum.imag**2).sum(0)
    found = np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    found[0] = 0
    return found


def islands(x: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches of at least least places at which x equals x lag places on."""
    if lag < DENSE:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], x[lag:] == x[:-lag], [False]))))
        long = edges[1::2] - edges[::2] >= least
        return list(zip(edges[::2][long].tolist(), edges[1::2][long].tolist(), strict=True))
    # A stretch of lag places or more holds a multiple m of lag, and around it all of [m, m + h] or all of [m - (lag - h), m], whatever h is.
    end = len(x) - lag
    at = np.arange(0, end, lag)
    at = at[x[at] == x[at + lag]]
    right, left = np.ones(len(at), bool), np.ones(len(at), bool)
    half = lag // 2
    for k in range(1, LOOKS + 1):
        if not len(at):
            return []
        a, b = at + k * half // LOOKS, at - k * (lag - half) // LOOKS
        right &= (a < end) & (x[np.minimum(a, end - 1)] == x[np.minimum(a, end - 1) + lag])
        left &= (b >= 0) & (x[np.maximum(b, 0)] == x[np.maximum(b, 0) + lag])
        some = right | left
        at, right, left = at[some], right[some], left[some]
    found, done = [], 0
    for m in at.tolist():
        if m >= done:
            first, done = _reach(x, lag, m, -1, 0) + 1, _reach(x, lag, m, 1, end)
            if done - first >= least:
                found.append((first, done))
    return found


def _reach(x: np.ndarray, lag: int, at: int, step: int, stop: int) -> int:
    """The nearest place before (step -1) or from at (step 1) that doesn't match, or the one past the end."""
    width = 64
    while True:
        if step > 0:
            part = np.flatnonzero(x[at : min(at + width, stop)] != x[at + lag : min(at + width, stop) + lag])
            if len(part):
                return at + int(part[0])
            at += width
            if at >= stop:
                return stop
        else:
            low = max(0, at - width)
            part = np.flatnonzero(x[low:at] != x[low + lag : at + lag])
            if len(part):
                return low + int(part[-1])
            at = low
            if not at:
                return -1
        width *= 2


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(x)
    if n < LEAST:
        return []
    left = lag_matches(x)
    lags = np.arange(len(left))
    wanted = np.maximum(LEAST - lags, lags)
    wanted[0] = n + 1
    found: list[tuple[int, int, int]] = []
    for lag in np.flatnonzero(left >= wanted).tolist():
        if left[lag] < wanted[lag]:  # since the loop began
            continue
        for start, end in islands(x, lag, int(wanted[lag])):
            length = end - start + lag
            if not any(_repeats(x, start, lag, d) for d in _divisors(lag)):
                found.append((start, length, lag))
                multiples = np.arange(2 * lag, min(length, len(left)), lag)
                left[multiples] -= length - multiples
    return sorted(found, key=lambda r: (r[0], r[2]))


def _repeats(x: np.ndarray, start: int, lag: int, d: int) -> bool:
    """Whether the first period of a stretch repeats a part of d words."""
    return bool((x[start : start + lag - d] == x[start + d : start + lag]).all())


def _divisors(n: int) -> list[int]:
    """n divided by each of its prime factors."""
    out, rest, p = [], n, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(n // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, n // rest] if rest > 1 else out


def repeated(words: list, h: int) -> list:
    """Every tenth document's words made periodic from some place on, as the contract says."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (1 + (n - a) // p))[: n - a]


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()] if found else words


def longest(found: list[tuple[int, int, int]]) -> tuple:
    """start, length, period and exponent in thousandths of the longest run."""
    if not found:
        return None, None, None, None
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]))
    return start, length, period, 1000 * length // period


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and the runs of the texts of docs (doc_id, text) as they are, one array each of starts, lengths and periods."""

    def make():
        def run(keys, texts):
            found = [runs(numbers((t or "").encode().split())) for t in texts]
            return [keys, *([[r[k] for r in f] for f in found] for k in range(3))]

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, start array<bigint>, length array<bigint>, period array<bigint>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the texts of docs without what their runs repeat; words are joined by one space."""

    def make():
        def run(keys, texts):
            split = [(t or "").encode().split() for t in texts]
            return [keys, [b" ".join(collapsed(w, runs(numbers(w)))).decode() for w in split]]

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, text string")


def _described(key: int | None, text: str | None) -> tuple:
    words = (text or "").encode().split()  # bytes split at just the six characters
    if key is not None:
        words = repeated(words, zlib.crc32(str(key).encode()))
    found = runs(numbers(words))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (key, len(found), *longest(found), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())


_RESULT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda: lambda keys, texts: list(zip(*map(_described, keys, texts), strict=True)), _RESULT)
