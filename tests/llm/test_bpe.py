import hashlib
import random

import public_tokenizers
from metaloom.llm import bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids


def texts():
    r = random.Random(5)
    yield from ["", " ", "a", "The cat's  sat.\n\n x", "<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "ñandú ça été 😀😀", "   x", "it'll've'd 12 345"]
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "é", "0123456789", "!?#.", " ", " \n\t", "日本語", "aé😀"):
        for n in (1023, 1024, 3001, 20_000):
            yield "x " + "".join(r.choice(alphabet) for _ in range(n)) + " y"
    yield "z" * 5000 + "<|endoftext|>" + "!" * 4000 + "\n" * 3000 + "x"


def test_equals_the_library_and_round_trips():
    coder = bpe.Coder(*bpe.vocabulary())
    for text in texts():
        ids = coder.encode(text)
        assert ids == expected(text), text[:50]
        assert coder.decode(ids) == REFERENCE.decode(ids, skip_special_tokens=False) == text


def test_tree_equals_one_piece():
    coder, r = bpe.Coder(*bpe.vocabulary()), random.Random(7)
    for _ in range(50):
        piece = "".join(r.choice("aehinrst") for _ in range(r.randrange(1, 3000))).encode()
        assert coder.tree(piece) == coder._piece(piece)


def test_query(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (3, "one two", "x"), (4, "q" * 3000, "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(bpe.op4_bpe(spark, str(tmp_path)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [tuple(x) for x in found] == [(i, len(expected(t or "")), sha(",".join(map(str, expected(t or "")))), sha(t or "")) for i, t, _ in rows]
    encoded = bpe.encode(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted(x.text for x in bpe.decode(encoded).collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_parts_of_any_length_join_to_the_whole():
    coder, r = bpe.Coder(*bpe.vocabulary()), random.Random(9)
    kinds = ["a", "bc", " ", "\n", "\t", "'", "s", "'s", "'ll", "12", "é", "😀", "!", ".", "<|endoftext|>", "<|", "end", "|>", "  ", "日本"]
    cases = [*texts(), *("".join(r.choice(kinds[: r.randrange(3, len(kinds) + 1)]) for _ in range(r.randrange(1, 400))) for _ in range(400))]
    for text in cases:
        size = r.choice([1, 2, 3, 5, 17, 100]) if len(text) < 500 else r.choice([300, 1000, 8192])
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        assert coder.joined_all([(t, coder.part(t)) for t in parts]) == expected(text), (text[:80], size)
        for t in parts:
            back, part = coder.unpacked(*coder.packed(coder.part(t)))
            assert back == t and all((getattr(part, k) == getattr(coder.part(t), k)).all() for k in ("at", "ids", "starts"))


def test_joins_look_at_windows_only(monkeypatch):
    coder, seen, part = bpe.Coder(*bpe.vocabulary()), [], bpe.Coder.part
    words = " ".join(random.Random(3).choice(["alpha", "beta", "it's", "12", "x, y."]) for _ in range(40_000))
    parts = [(t, coder.part(t)) for t in (words[i : i + bpe.PART] for i in range(0, len(words), bpe.PART))]
    monkeypatch.setattr(bpe.Coder, "part", lambda self, text, offset=0: seen.append(len(text)) or part(self, text, offset))
    assert coder.joined_all(parts) == expected(words) and len(seen) == len(parts) - 1 and max(seen) < 500


def test_documents_go_through_the_tree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert docs.where(F.length("text") >= bpe.TREE).count() >= 20
    monkeypatch.setattr(bpe, "TREE", 3000)
    monkeypatch.setattr(bpe, "PART", 700)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(40))
    wanted = sorted((x.doc_id, len(expected(x.text)), hashlib.sha256(",".join(map(str, expected(x.text))).encode()).hexdigest(), hashlib.sha256(x.text.encode()).hexdigest()) for x in docs.collect())
    assert sorted(map(tuple, bpe.digest(docs).collect())) == wanted
    assert bpe.parts_of(docs).count() > 20
