from collections import Counter
from itertools import permutations

from metaloom.llm import audit


def brute(docs, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    rows = []
    for key, text, lang in docs:
        t = text or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\f\r" else c for c in t).split(" ") if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in docs)
        rows.append((lang or "", {f for f in fails if fails[f]}, key in good, key in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                earlier = [bool(r[1] & set(order[:k])) for r in mine]
                here = [f in r[1] for r in mine]
                removed = [r for r, e, h in zip(mine, earlier, here, strict=True) if h and not e]
                shapley[f] += len(removed)
                out[part, order, k + 1] = [sum(not e and not h for e, h in zip(earlier, here, strict=True)), len(removed), sum(map(all, zip(earlier, here, strict=True))), sum(r[1] == {f} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(shapley[order[k - 1]])
    return out


def test_equals_brute_force(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", long, long + " 5%", long.upper(), "a " * 150, "A " * 30 + "x" * 400, "a b", "X", "|" * 3]
    docs = [(i, texts[i % len(texts)], [None, "", "en", "de"][i % 4]) for i in range(40)]
    docs += [(7, long, "en"), (7, long, "de"), (None, long, "en"), (None, long, None), (-1, "only", "fr"), (-1, "only", "fr")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(None, 1, 1), (7, None, 1), (7, 1, 0), (99, 1, 1)]
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, lang string, part string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {(r.part, r.filter_order, r.step): list(r[3:]) for r in audit.op11_filter_audit(spark, str(tmp_path)).collect()}
    assert found == brute(docs, labels)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert audit.audit(audit.cells(empty, spark.read.parquet(f"{tmp_path}/labels.parquet"))).count() == 0


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 3, True, False, 2), ("p", 1, False, True, 5), ("p", 0, False, False, 1)], "part string, mask int, good boolean, toxic boolean, n bigint")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(cells, "XY").collect()}
    assert found == {("XY", 1): (1, 7, 0, 5, 2, 5, 12), ("XY", 2): (1, 0, 2, 0, 0, 0, 2), ("YX", 1): (6, 2, 0, 0, 2, 0, 2), ("YX", 2): (1, 5, 2, 5, 0, 5, 12)}
