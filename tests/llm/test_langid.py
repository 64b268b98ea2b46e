import itertools
import random

import numpy as np
from metaloom.llm import langid

EN, DE = "the thing and other words that they often write with thought", "der schöne und große wagen steht nicht auf einer straße zwischen häusern"
ROWS = [("en", EN), ("de", DE)] * 30 + [("ru", "это простой русский текст для проверки")] * 10


def best(scores, penalty):
    """By trying all labellings."""
    return max(sum(scores[i][k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p)) for p in itertools.product(range(len(scores[0])), repeat=len(scores)))


def value(scores, labels, penalty):
    return sum(scores[i][k] for i, k in enumerate(labels)) - penalty * sum(a != b for a, b in itertools.pairwise(labels))


def test_viterbi_and_its_shortcut_are_optimal():
    r = np.random.default_rng(1)
    model = langid.learn(ROWS)
    for _ in range(300):
        scores = r.normal(0, r.choice([1, 6, 15]), (r.integers(1, 8), 3))
        wanted = best(scores.tolist(), langid.SWITCH)
        assert abs(value(scores, langid.viterbi(scores, langid.SWITCH), langid.SWITCH) - wanted) < 1e-9
        assert abs(value(scores, model.label(scores), langid.SWITCH) - wanted) < 1e-9


def test_spans_scripts_and_empty_texts():
    model = langid.learn(ROWS)
    assert model.predict(None) == model.predict("") == model.predict("12 ... 😀") == ("und", 0.0, 0)
    assert model.predict(EN)[0] == "en" and model.predict(DE.upper())[0] == "de" and model.predict("простой")[0] == "ru"
    text = f"{EN} {EN}. {DE} {DE}"
    assert [s[2] for s in model.spans(text)] == ["en", "de"] and model.spans(text)[1][0] == text.index("der")
    assert model.predict("Ελληνικά")[0] in model.languages
    assert langid.learn([]).predict("x") == ("und", 0.0, 0)


def test_long_texts_are_worked_in_blocks(monkeypatch):
    model, r = langid.learn(ROWS), random.Random(3)
    text = " ".join(r.choice((EN, DE)) for _ in range(50))
    whole = model.words(text)
    monkeypatch.setattr(langid, "_BLOCK", 100)
    assert all(np.allclose(a, b) for a, b in zip(whole, model.words(text), strict=True))


def test_query(spark, tmp_path):
    rows = [(i, text, lang, i) for i, (lang, text) in enumerate(ROWS)] + [(900, None, "en", 0), (901, "", None, 0), (902, "!!", None, 0), (3, EN, None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score bigint").write.parquet(f"{tmp_path}/documents.parquet")
    found = langid.op1_language_id(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and {x.lang_pred for x in found if x.doc_id >= 900} == {"und"}
    by = dict(enumerate(ROWS))
    assert all(x.lang_pred == by[x.doc_id][0] for x in found if x.doc_id < 900 and x.doc_id != 3)


def test_held_out_accuracy(spark):
    found = langid.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.selectExpr("avg(cast(lang = lang_pred as double))", "count(*)").first()
    assert n > 150 and right > 0.97


def test_places_are_those_of_the_text():
    model = langid.learn(ROWS)
    text = f"\u0130\u0130 {EN} {EN}. {DE.upper()} {DE}"
    assert [(text[a : a + 3], lang) for a, _, lang in model.spans(text)][-1] == ("DER", "de")


def test_counting_by_tasks_equals_counting_at_once(spark, monkeypatch):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(ROWS)] + [(500, "xx yy", "zz"), (501, "??", "und")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    for held in (32, 1):
        monkeypatch.setattr(langid, "_HELD", held)
        found, wanted = langid.train(docs), langid.learn([(lang, t) for _, t, lang in rows if lang != "und"])
        assert found.languages == wanted.languages and np.allclose(found.grams, wanted.grams) and (found.scripts == wanted.scripts).all()
    assert set(langid.train(docs, languages=2).languages) == {"en", "de"}
    assert langid.train(docs.limit(0)).languages == []
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_many_languages_in_bounded_memory(monkeypatch):
    """300 languages, with Viterbi on arrays and over blocks, as on lists at once."""
    r = np.random.default_rng(4)
    for width in (3, 40):
        scores = r.normal(0, 8, (400, width))
        whole = langid.viterbi(scores, langid.SWITCH)
        cut = langid.viterbi_of([scores[:7], scores[7:7], scores[7:300], scores[300:]], langid.SWITCH)
        assert (whole == cut).all()
    brute = langid.viterbi(np.pad(scores[:, :3], ((0, 0), (0, 37)), constant_values=-1e6), langid.SWITCH)
    assert (brute == langid.viterbi(scores[:, :3], langid.SWITCH)).all()
    made = random.Random(8)
    alphabets = ["".join(chr(0x4E00 + 20 * k + i) for i in range(12)) for k in range(300)]
    rows = [(f"l{k}", " ".join("".join(made.choices(a, k=4)) for _ in range(30))) for k, a in enumerate(alphabets)]
    model = langid.learn(rows)
    assert len(model.languages) == 300 and all(model.predict(t)[0] == lang for lang, t in rows[::10])
    mixed = " ".join(t for _, t in rows[:60])
    spans = model.spans(mixed)
    assert len(spans) == 60 and [s[2] for s in spans] == [lang for lang, _ in rows[:60]]
    largest, scan = [], langid._scan
    monkeypatch.setattr(langid, "_scan", lambda t: largest.append(len(t)) or scan(t))
    monkeypatch.setattr(langid, "_SCORES", 300 * 2048)
    assert model.spans(mixed) == spans and max(largest) <= 2048 and len(largest) > 2
