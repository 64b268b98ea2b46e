import random
import zlib

import numpy as np
import pytest
from metaloom.llm import periods


def brute(x):
    """Every lag's stretches of matches, without those that repeat something smaller."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q) and not any(x[i : i + length - d] == x[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    r = random.Random(3)
    for k in range(400):
        n = r.randrange(160)
        if k % 4 == 0:
            yield [r.randrange(1 + k % 3) for _ in range(n)]
        elif k % 4 == 1:
            x = []
            while len(x) < n:
                x += ([r.randrange(3) for _ in range(r.randrange(1, 50))] * r.randrange(1, 5))[: r.randrange(1, 200)]
            yield x
        elif k % 4 == 2:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            yield b
        else:
            yield periods.repeated([r.randrange(50) for _ in range(n)], 10 * r.randrange(1 << 28))


@pytest.mark.parametrize("dense", [6, 32])
def test_runs_equal_brute_force(monkeypatch, dense):
    monkeypatch.setattr(periods, "DENSE", dense)
    for x in sequences():
        assert periods.runs(periods.numbers(x)) == brute(x)


def test_lags_are_counted_exactly():
    r = np.random.default_rng(1)
    for n, kinds in ((0, 1), (1, 1), (13, 2), (400, 1), (700, 3), (900, 60), (3000, 200)):
        x = (r.zipf(1.5, n) % kinds).astype(np.int64) if n else np.zeros(0, np.int64)
        wanted = [0] + [int((x[k:] == x[:-k]).sum()) for k in range(1, n // 2 + 1)]
        assert periods.lag_matches(x).tolist() == wanted


def test_a_text_of_one_word_needs_one_scan(monkeypatch):
    scans, islands = [], periods.islands
    monkeypatch.setattr(periods, "islands", lambda x, lag, least: scans.append(lag) or islands(x, lag, least))
    assert periods.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)] and scans == [1]


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "x " * 12), (5, "a b " * 6 + "c"), (5, "a b " * 6 + "c"), (7, "a b " * 11)]
    spark.createDataFrame([(*r, "q") for r in rows], "doc_id bigint, text string, start string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(x.doc_id, x.n_runs, x.start, x.length, x.period, x.exponent_milli) for x in periods.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert all(zlib.crc32(str(k).encode()) % 10 for k in (1, 2, 3, 5, 7))
    assert found == {(1, 0, *[None] * 4), (2, 0, *[None] * 4), (3, 0, *[None] * 4), (None, 1, 0, 12, 1, 12000), (5, 1, 0, 12, 2, 6000), (7, 0, *[None] * 4)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id: x.text for x in periods.without_repeats(docs).collect()} == {1: "", 2: "", 3: "", None: "x", 5: "a b c", 7: ("a b " * 11).strip()}
    assert {x.doc_id: (x.start, x.length, x.period) for x in periods.spans(docs).collect()}[5] == ([0], [12], [2])
    assert periods.spans(docs.limit(0)).count() == 0
