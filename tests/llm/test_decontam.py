import hashlib
import random
import re

import pytest
from metaloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = ["a", "b", "É", "ç9", "x", "yy", "Zz"]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    """n_words, ranges and items of each text."""
    windows = [(i, w[k : k + window]) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for text in docs:
        w = words(text)
        hit, who = [False] * (len(w) + 1), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit[k : k + len(x)] = [True] * len(x)
                    who.add(i)
        out.append((len(w), [k for k in range(len(w) + 1) if hit[k] != (k > 0 and hit[k - 1])], sorted(who)))
    return out


def text(r, n, kinds):
    return "".join(r.choice(VOCABULARY[:kinds]) + r.choice([" ", "-", "\n", ". "]) for _ in range(n))


def cases(n):
    r = random.Random(2)
    for _ in range(n):
        kinds = r.choice([1, 2, 7])
        items = [(str(k), text(r, r.randrange(25), kinds)) for k in range(r.randrange(6))]
        docs = [text(r, r.randrange(40), kinds) for _ in range(r.randrange(1, 8))] + [None, ""]
        docs += [text(r, 3, 7) + r.choice(items)[1] + text(r, 3, 7) for _ in range(2) if items]
        yield [*docs, docs[0]], items, r.choice([1, 2, 3, 10])


@pytest.mark.parametrize(("segment", "piece"), [(4096, 1 << 20), (3, 7), (5, 50)])
def test_hits_equal_brute_force(monkeypatch, segment, piece):
    monkeypatch.setattr(decontam, "SEGMENT", segment)
    monkeypatch.setattr(decontam, "SLICE_WORDS", piece)
    for docs, items, window in cases(120):
        rows = set()
        for name, t in items:
            hashes, _ = decontam.hashed_words(t.encode().lower(), decontam._INSIDE)
            rows |= {(name, k, hashes[k : k + segment + window - 1].tobytes()) for k in range(0, max(1, len(hashes) - window + 1) if len(hashes) else 0, segment)}
        tests = decontam.Tests(sorted(rows), window)
        assert list(zip(*decontam.hits(docs, tests), strict=True)) == brute(docs, items, window)


def test_blocks_and_odd_rows(spark, monkeypatch):
    r = random.Random(7)
    items = [(k, text(r, r.randrange(30), 7)) for k in range(12)] + [(None, "lonely item"), (50, None), (51, ""), (52, "..."), (1, "x yy x"), (1, "x yy x")]
    rows = [(k, text(r, r.randrange(60), 7)) for k in range(20)] + [(None, "A Lonely-item here"), (3, None), (3, ""), (4, items[2][1] + " and"), (4, items[2][1] + " and"), (5, "x yy x " * 3)]
    docs = spark.createDataFrame([(*x, "q") for x in rows], "doc_id bigint, text string, items string")
    tests = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, words int")
    wanted = [(k, *x) for (k, _), x in zip(rows, brute([t for _, t in rows], [("" if k is None else str(k), t) for k, t in items], 10), strict=True)]
    for size in (1 << 20, 64, 16):  # one block, several, many
        monkeypatch.setattr(decontam, "BLOCK_WORDS", size)
        assert sorted(map(tuple, decontam.occurrences(docs, tests).collect()), key=str) == sorted(wanted, key=str)
        clean = decontam.decontaminated(docs, tests)
        assert clean.columns == docs.columns
        assert sorted((x.doc_id, x.text) for x in clean.where("doc_id IS NOT NULL AND text IS NOT NULL").collect()) == sorted((k, t) for (k, t), w in zip(rows, wanted, strict=True) if not w[3] and k is not None and t is not None)
    assert decontam.occurrences(docs.limit(0), tests).count() == 0
    assert decontam.occurrences(docs, tests.limit(0)).where("size(items) > 0 OR size(ranges) > 0").count() == 0
    assert decontam.decontaminated(docs, tests.limit(0)).count() == len(rows)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "zero one two three nine"), (3, None)], "doc_id bigint, text string")
    tests = spark.createDataFrame([(9, "Two, three! four six")], "item_id bigint, text string")
    found = {x.first: (x.n_words, x.doc_id, x.place) for x in decontam.longest_matches(docs, tests).collect()}
    assert found == {0: (3, 1, 1), 1: (2, 1, 2), 2: (1, 1, 3)}


def test_the_query(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "b a c"), (None, "none")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "B"), (9, "b a")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontam.op13_decontaminate(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == {1: (2, 1, 1, sha("10"), True), 2: (3, 2, 2, sha("10,9"), True), None: (1, 0, 0, sha(""), False)}
