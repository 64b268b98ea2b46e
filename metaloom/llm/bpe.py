"""BPE encoding and decoding (operator 4): tree concatenation.

A text of ``TREE`` characters or more is split anywhere, every ``PART`` characters, and the parts are encoded side by side: each is a row that
Spark deals out like any other. What one text's parts give meets in one row and is joined in a tree, neighbours first. A join encodes a window of text around
the seam anew, which grows until both sides agree: it starts at a pretoken of the left side that ends well before the seam, and must reach a
pretoken at which the right side starts one too, well before the window's end. From a place where two tokenizations of a text both start a pretoken
they go on alike, as neither the pattern nor the special tokens look back; ``MARGIN`` keeps what looks ahead away from ends. So the joined
ids are those of the whole text, and a join's work doesn't grow with it. Where no pretoken ends (a run of one kind of character), the window grows to the whole side.

Inside one pretoken of more than ``LONG`` characters the same is done on bytes: leaves of ``LEAF`` bytes are encoded alone and joined upwards. A
join encodes a window of tokens around the seam anew, doubling it until its first and last token are those that the two sides have there.
A token sequence is the BPE encoding of its bytes exactly if each neighbouring pair is the encoding of its own bytes; each pair of the joined
sequence lies inside a side or inside the window. These leaves follow one another in the row's task.

Nulls encode as the empty text: no ids, and the hashes of the empty string. Special tokens that
stand in a text are encoded as their own id, as the tokenizers library does. Repeated rows are encoded alike, an empty table gives no
rows, and other columns don't count.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.common import map_rows, table

#: Bytes of a leaf, tokens on each side of the first window at a join, characters from which a run counts as unsplit.
LEAF, WINDOW, LONG = 256, 8, 1024
#: Characters from which a text is encoded in parts, and of a part; pretokens that a window must see beyond those that count, and on each side at first.
TREE, PART, MARGIN, AROUND = 1 << 14, 1 << 12, 3, 8
#: Fixed value: the pattern of byte-level pretokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNSPLIT = regex.compile(rf"\p{{L}}{{{LONG},}}|\p{{N}}{{{LONG},}}|[^\s\p{{L}}\p{{N}}]{{{LONG},}}|\s{{{LONG},}}")


class Part:
    """Pretokens of a stretch of text: where each starts, where its ids start (and the last end), and the ids."""

    __slots__ = ("at", "ids", "starts")

    def __init__(self, starts: np.ndarray, at: np.ndarray, ids: np.ndarray):
        self.starts, self.at, self.ids = starts, at, ids

    def head(self, k: int) -> Part:
        return Part(self.starts[:k], self.at[: k + 1], self.ids[: self.at[k]])

    def tail(self, k: int) -> Part:
        return Part(self.starts[k:], self.at[k:] - self.at[k], self.ids[self.at[k] :])

    def moved(self, offset: int) -> Part:
        return Part(self.starts + offset, self.at, self.ids)

    def __add__(self, other: Part) -> Part:
        return Part(np.concatenate((self.starts, other.starts)), np.concatenate((self.at, other.at[1:] + self.at[-1])), np.concatenate((self.ids, other.ids)))


class Coder:
    """Encodes and decodes with the vocabulary of a tokenizer file and the same vocabulary as ranks."""

    def __init__(self, ranks_path: str, tokenizer_path: str | None = None):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        special = {}
        if tokenizer_path:
            with open(tokenizer_path, encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}
        self.special = special
        self._plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._piece = self._plain._core_bpe.encode_single_piece
        self._split = regex.compile(PATTERN)
        self._ahead = max([2, *map(len, special)])  # characters that a decision can look ahead
        self._marks = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._bytes = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, rank in ranks.items():
            self._bytes[rank] = token
        for token, rank in special.items():
            self._bytes[rank] = token.encode()
        self._lengths = np.array([len(b) for b in self._bytes], np.int64)
        self._width = np.dtype("<u2" if len(self._bytes) <= 1 << 16 else "<u4")

    def encode(self, text: str) -> list[int]:
        if not (len(text) >= LONG and _UNSPLIT.search(text)):
            return self._plain.encode(text, allowed_special="all", disallowed_special=())
        ids: list[int] = []
        for part in self._marks.split(text) if self._marks else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for piece in self._split.findall(part):
                    ids += self.tree(piece.encode())
        return ids

    def tree(self, piece: bytes) -> list[int]:
        """Encodes one pretoken: leaves first, then joins level by level."""
        level = [self._piece(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def part(self, text: str, offset: int = 0) -> Part:
        """The pretokens of a text that is read alone, with their ids."""
        starts, counts, ids, known = [], [], [], {}
        at = offset
        for piece in self._marks.split(text) if self._marks else [text]:
            for token in [piece] if piece in self.special else self._split.findall(piece):
                found = known.get(token)
                if found is None:
                    known[token] = found = [self.special[token]] if token in self.special else self.tree(token.encode()) if len(token) >= LONG else self._piece(token.encode())
                starts.append(at)
                counts.append(len(found))
                ids += found
                at += len(token)
        return Part(np.array(starts, np.int64), np.cumsum([0, *counts]), np.array(ids, np.int32))

    def packed(self, part: Part) -> tuple[bytes, bytes]:
        """A part's ids, and a bit for each that says whether a pretoken starts with it."""
        first = np.zeros(len(part.ids), bool)
        first[part.at[:-1]] = True
        return part.ids.astype(self._width).tobytes(), np.packbits(first).tobytes()

    def unpacked(self, ids: bytes, first: bytes) -> tuple[str, Part]:
        """The text that packed ids stand for, and the part."""
        found = np.frombuffer(ids, self._width).astype(np.int32)
        raw = b"".join([self._bytes[i] for i in found.tolist()])
        at = np.flatnonzero(np.unpackbits(np.frombuffer(first, np.uint8), count=len(found)))
        begins = np.concatenate(([0], np.cumsum(self._lengths[found])))
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        return raw.decode(), Part(chars[begins[at]], np.append(at, len(found)), found)

    def joined(self, text: str, left: Part, right: Part, seam: int, end: int) -> Part:
        """What reading text from the start of left to the end of right alone gives; right starts at seam and ends before end."""
        around = AROUND
        while True:
            # Where the window starts: the left side's own start, or a pretoken with enough of the side after it.
            k = max(0, len(left.starts) - around - MARGIN)
            if k and seam - left.starts[k + around] < self._ahead:
                k = 0 if around > len(left.starts) else k
            first = int(left.starts[k]) if len(left.starts) else seam
            m = around + MARGIN
            stop = int(right.starts[m]) if m < len(right.starts) else end
            window = self.part(text[first:stop], first)
            # Pretokens that both sides have, far enough from the window's end if the text goes on there.
            common = np.intersect1d(window.starts, right.starts[: m + 1], assume_unique=True)
            common = common[common > seam]
            if stop < end:
                last = window.starts[-MARGIN] if len(window.starts) >= MARGIN else first
                common = common[(common <= last) & (common <= stop - self._ahead)]
            if stop == end:
                return left.head(k) + window
            if len(common):
                at = int(common[0])
                return left.head(k) + window.head(int(np.searchsorted(window.starts, at))) + right.tail(int(np.searchsorted(right.starts, at)))
            around *= 2

    def joined_all(self, parts: list[tuple[str, Part]]) -> list[int]:
        """The ids of a whole text from its parts in order, each read alone."""
        texts = [t for t, _ in parts]
        text = "".join(texts)
        bounds = np.cumsum([0, *map(len, texts)]).tolist()
        level = [(a, b, part.moved(a)) for a, b, (_, part) in zip(bounds[:-1], bounds[1:], parts, strict=True)]
        while len(level) > 1:
            pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = [(p[0][0], p[1][1], self.joined(text, p[0][2], p[1][2], p[1][0], p[1][1])) if len(p) == 2 else p[0] for p in pairs]
        return level[0][2].ids.tolist() if level else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = WINDOW
        while True:
            a, b = left[-width:], right[:width]
            made = self._piece(b"".join([self._bytes[i] for i in a + b]))
            fits_left, fits_right = len(a) == len(left) or made[0] == a[0], len(b) == len(right) or made[-1] == b[-1]
            if fits_left and fits_right:
                return left[: len(left) - len(a)] + made + right[len(b) :]
            width *= 2

    def decode(self, ids: list[int]) -> str:
        """Bytes that are not UTF-8 become U+FFFD, as in the tokenizers library."""
        return b"".join([self._bytes[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(ranks_path: str, tokenizer_path: str | None) -> Coder:
    return Coder(ranks_path, tokenizer_path)


def vocabulary() -> tuple[str, str]:
    """Places of the default vocabulary: as ranks, and as a tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, paths: tuple[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: its id, the ids of its whole text."""

    def make():
        c = coder(*(paths or vocabulary()))
        return lambda keys, texts: [keys, [c.encode(t or "") for t in texts]]

    return map_rows(docs.select(id_column, text_column), make, f"{id_column} {docs.schema[id_column].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, paths: tuple[str, str] | None = None, id_column: str = "doc_id") -> DataFrame:
    """The texts of rows of ids; null ids give the empty text."""

    def make():
        c = coder(*(paths or vocabulary()))
        return lambda keys, ids: [keys, [c.decode(i or []) for i in ids]]

    return map_rows(encoded.select(id_column, "ids"), make, f"{id_column} {encoded.schema[id_column].dataType.simpleString()}, text string")


_DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digested(c: Coder, ids: list[int]) -> tuple[int, str, str]:
    """The number of ids, their hash, and the hash of the text that they decode to."""
    return len(ids), hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def parts_of(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The encoded parts of long texts: a row of doc_id, t1, t2 (hashes of the text), part, n (equal rows), ids and first (as packed()) for each.

    Parts are dealt by what tells them apart, so those of one text are encoded by many tasks, and equal rows once. Their text isn't kept, as ids stand for it.
    """
    long = docs.where(F.length("text") >= TREE).select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")

    def split():
        def run(keys, t1, t2, texts):
            cut = [[t[i : i + PART] for i in range(0, len(t), PART)] for t in texts]
            spread = lambda values: [v for v, x in zip(values, cut, strict=True) for _ in x]
            return [spread(keys), spread(t1), spread(t2), [i for x in cut for i in range(len(x))], [t for x in cut for t in x]]

        return run

    leaves = map_rows(long, split, "doc_id bigint, t1 bigint, t2 bigint, part int, text string")
    leaves = leaves.groupBy("doc_id", "t1", "t2", "part").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))

    def make():
        c = coder(*(paths or vocabulary()))

        def run(keys, t1, t2, part, n, texts):
            found = [c.packed(c.part(t)) for t in texts]
            return [keys, t1, t2, part, n, [i for i, _ in found], [f for _, f in found]]

        return run

    return map_rows(leaves, make, "doc_id bigint, t1 bigint, t2 bigint, part int, n bigint, ids binary, first binary")


def digest(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Encodes whole texts, decodes the ids, and returns the number of ids and both hashes; long texts by the tree of their parts."""
    docs = docs.select("doc_id", "text")

    def make():
        c = coder(*(paths or vocabulary()))

        def run(keys, texts):
            return [keys, *map(list, zip(*(digested(c, c.encode(t or "")) for t in texts), strict=True))]

        return run

    short = map_rows(docs.where(F.coalesce(F.length("text") < TREE, F.lit(True))), make, _DIGEST)
    parts = parts_of(docs, paths)
    whole = parts.groupBy("doc_id", "t1", "t2").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "ids", "first"))).alias("p"))
    # The copies of a row are made after its ids are digested.
    whole = whole.select("doc_id", "n", F.col("p.ids").alias("ids"), F.col("p.first").alias("first"))

    def join():
        c = coder(*(paths or vocabulary()))

        def run(keys, n, ids, first):
            out = [digested(c, c.joined_all([c.unpacked(*x) for x in zip(*row, strict=True)])) for row in zip(ids, first, strict=True)]
            return [keys, n, *map(list, zip(*out, strict=True))]

        return run

    long = map_rows(whole, join, f"doc_id bigint, n bigint, {_DIGEST.split(', ', 1)[1]}")
    columns = [f.split()[0] for f in _DIGEST.split(", ")]
    return short.unionByName(long.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*columns))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
