from collections import Counter, defaultdict

import corpus_pipeline
from metaloom.llm import bpe, mixing, neardup, pii, quality

from .test_neardup import brute, corpus


def test_stages_on_the_given_documents(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
    before, good, single, clean, mixed, tokens = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert kept < {r.doc_id for r in before}
    assert sum(labels[i] for i in labels if i in kept) > 0.9 * sum(labels.values())
    assert sorted(r.doc_id for r in single) == [k for k, _, _, stays in brute([(r.doc_id, r.text) for r in good]) if stays]
    for a, b in zip(sorted(single), sorted(clean), strict=True):
        assert (a.doc_id, pii.redact(a.text, pii.find(a.text)[1])) == (b.doc_id, b.text) and b.n_chars == len(b.text)
    copies = Counter(r.doc_id for r in mixed)
    expected = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/pii").select("doc_id", "source", "text")).collect()}
    assert {k: v for k, v in expected.items() if v} == dict(copies)
    coder = bpe.Coder(*bpe.vocabulary())
    assert Counter((r.doc_id, r.n_tokens) for r in tokens) == Counter((r.doc_id, len(coder.encode(r.text))) for r in mixed)
    whole = Counter(map(tuple, corpus_pipeline.run(spark, d).collect()))
    assert whole == Counter(map(tuple, tokens))


def test_deduplicated_equals_brute_force(spark):
    rows = corpus(11, 12) + [(-1, None), (-2, None)]
    rows += rows[:3] + [(rows[0][0], "another text under one id here"), (None, rows[5][1])]
    docs = spark.createDataFrame([(k, t, "l", "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = neardup.deduplicated(docs).collect()
    groups = defaultdict(set)
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    sizes = {}
    for i, n, root, _ in brute(numbered):
        groups[root].add(i)
        sizes[i] = n
    wanted = sum(len(g) if sizes[r] == 0 else 1 for r, g in groups.items())
    assert len(found) == wanted
    for root, g in groups.items():
        if sizes[root]:
            least = min(rows[i][0] for i in g if rows[i][0] is not None)
            assert sum((r.doc_id, r.text) in {rows[i] for i in g} for r in found) == 1 and any(r.doc_id == least for r in found)


def test_accepted_keeps_columns(spark):
    docs = spark.createDataFrame([(1, None, "x", None, 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert quality.accepted(docs, quality.constant(0.9)).collect() == docs.collect()
    assert quality.accepted(docs, quality.constant(0.1)).count() == 0


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean"
    odd = [(1, None, None, None, None, True), (1, None, None, None, None, True), (None, "", "x", "", 0, None), (2, "one two three four five six", "x", "s", 27, None), (2, "one two three four five six", "x", "s", 27, None)]
    for name, rows in (("none", []), ("odd", odd)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(2, 1)] if rows else [], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in found} == ({2} if rows else set()), name
