import hashlib
import random

import numpy as np
from metaloom.llm import fingerprint as fp


def brute(text):
    cells = np.zeros(2 * fp.LANES, np.int64)
    for p in text.encode().split(b"\n"):
        for w in [p.ljust(12, b"\0")] if 0 < len(p) < 12 else [p[i : i + 12] for i in range(len(p) - 11)]:
            cells += fp._cells(np.frombuffer(w, "<u8,<u4"))
    return (cells[::2] - cells[1::2]).astype(np.uint32)


def texts():
    r = random.Random(4)
    yield from ["", "a", "\n", "ab\ncdefghijklmnop\n\nzz", "123456789012", "ñandú\nçà et là 😀😀😀"]
    for _ in range(40):
        yield "".join(r.choice("abcé \n") for _ in range(r.randrange(200)))


def test_lanes_equal_brute_force(monkeypatch):
    for block in (1 << 22, 64):
        monkeypatch.setattr(fp, "_BLOCK", block)
        for text in texts():
            assert (fp.of(text).lanes == brute(text)).all()


def test_homomorphic():
    a, b = "first paragraph here\nsecond one", "a third paragraph"
    assert fp.of(f"{a}\n{b}") == fp.of(a) + fp.of(b) == fp.of(f"{b}\n{a}")
    assert fp.of(f"{a}\n{b}") - fp.of(a) == fp.of(b)
    assert fp.of(a) != fp.of(f"{a}\n{a}") and fp.read(fp.of(a).written()) == fp.of(a)


def expected(rows):
    """Of distinct doc_ids."""
    rows = sorted(rows, reverse=True)
    out = []
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        made = fp.edit(text, following)
        f, g = fp.of(text), fp.of(made)
        out.append((key, len(text), hashlib.sha256(made.encode()).hexdigest(), f.written(), g.written(), f.likeness(g), f.likeness(fp.of(following))))
    return sorted(out)


def test_edited_equals_brute_force(spark, monkeypatch):
    r = random.Random(8)
    rows = [(int(k), r.choice([None, "", "x" * r.randrange(50), " ".join(r.choice(("red", "blue", "😀")) for _ in range(r.randrange(60)))])) for k in r.sample(range(-500, 5000), 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (1000, 20, 1):
        monkeypatch.setattr(fp, "RANGE_ROWS", size)
        assert sorted(map(tuple, fp.edited(docs).collect())) == expected(rows)


def test_odd_rows(spark, tmp_path):
    one = spark.createDataFrame([(5, "abcdef", "q")], "doc_id bigint, text string, fingerprint string")
    one.write.parquet(f"{tmp_path}/documents.parquet")
    assert [(x.n_chars, x.near_edited, x.near_next) for x in fp.op9_fingerprint(spark, str(tmp_path)).collect()][0][0] == 6
    same = spark.createDataFrame([(5, "abc")] * 4 + [(None, "z"), (5, "other"), (None, None)], "doc_id bigint, text string")
    found = fp.edited(same).collect()
    assert len(found) == 7 and len({x.fingerprint for x in found if x.doc_id == 5 and x.n_chars == 3}) == 1
    assert fp.edited(same.limit(0)).count() == 0


def test_an_id_with_most_rows_is_cut(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 20)
    texts = [f"text {i}" for i in range(400)]
    for hot in (7, None):
        docs = spark.createDataFrame([(hot, t) for t in texts] + [(i, f"other {i}") for i in range(100, 200)], "doc_id bigint, text string")
        rows, ranges = fp.dealt(docs)
        sizes = [r["count"] for r in rows.groupBy("range").count().collect()]
        assert len(ranges) > 15 and max(sizes) < 80 and sum(sizes) == 500
        found = fp.edited(docs).collect()
        order = {x.text: x.order for x in rows.collect()}
        wanted = sorted(([(i, f"other {i}") for i in range(100, 200)] + [(hot, t) for t in texts]), key=lambda r: (r[0] is None, -(r[0] or 0), order[r[1]]))
        made = sorted(hashlib.sha256(fp.edit(t, wanted[(i + 1) % 500][1]).encode()).hexdigest() for i, (_, t) in enumerate(wanted))
        assert sorted(x.edited_sha256 for x in found) == made


def test_one_row_many_times_reaches_the_driver_once(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 2000)
    seen, plain = [], type(spark.range(1)).toPandas
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: seen.append(plain(self)) or seen[-1])
    docs = spark.range(1_000_000).selectExpr("7L AS doc_id", "'same' AS text").unionByName(spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text"))
    _, ranges = fp.dealt(docs)
    assert len(seen[0]) <= 3001 and len(ranges) >= 1
