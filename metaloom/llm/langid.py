"""Language identification (operator 1): script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters. Its script (of its first letter that lies in a listed range) narrows the
candidates to languages in whose training words that script has at least ``SCRIPT_SHARE``; where that
leaves none, all stay. A word's score for a candidate is its log-likelihood under the language's letter
trigram model. Viterbi finds the labelling of all words that maximises the scores minus ``SWITCH`` for
each change of language; its runs are the spans. The text's language is the one whose spans hold the most
letters (ties: the language that is more common in training), its score their share of all letters.

Most texts need no search: if no stretch of words gains more than its changes cost by leaving the best single
language (two inside the text, one at its start or end), the constant labelling is optimal, which one pass over
running sums decides exactly.

Training takes a bounded sample: about ``PER_LANGUAGE`` rows of each language, by hash of doc_id, of the ``LANGUAGES`` most common
values of lang (both parameters, the second of which bounds the model's size; rarer ones are never predicted). Their trigrams are counted where the rows are; the driver gets the sums, whose number the tables' size bounds.
A text is read in blocks, the smaller the more languages there are; what is kept of all its words are their places and a bit for each language.
Null texts and texts without a letter are `und` with score 0; so is everything if nothing was learned. Repeated rows are labelled alike and each
gives a row; of training rows each counts. Other columns don't count; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.batches import pieces
from metaloom.functions.ship import ship
from metaloom.llm.common import BATCH_BYTES, BATCH_ROWS, fold, map_rows, table

PER_LANGUAGE, LANGUAGES, SWITCH, SCRIPT_SHARE, SMOOTH = 600, 500, 12.0, 0.01, 0.3
_TABLE, _BLOCK, _CELLS, _HELD = 1 << 16, 1 << 20, 1_000_000, 32
#: Scores (characters times languages) that a block of a text has.
_SCORES = 1 << 22
#: First and last code points of scripts, by name.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_OTHER = len(SCRIPTS)


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, and the number of its script."""
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    scripts = np.full(0x110000, _OTHER, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            scripts[first : last + 1] = k
    return letters, scripts


def _blocks(text: str, size: int = 0):
    """Pieces of at most size characters (_BLOCK by default) that end at a space where there is one."""
    start, size = 0, size or _BLOCK
    while len(text) - start > size:
        end = text.rfind(" ", start + size // 2, start + size) + 1 or start + size
        yield text[start:end]
        start = end
    yield text[start:]


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, one for each of the text: of what becomes two in lower case only the first stays."""
    return np.frombuffer(text.replace("\u0130", "i").lower().encode("utf-32-le", "replace"), np.uint32)


def _scan(text: str):
    """Places of letters' trigrams and of their histories in the tables, words as [start, end), and the words' scripts.

    Everything but letters counts as one boundary sign; the sign after a word is scored with the word.
    """
    letters, scripts = _alphabet()
    codes = _codes(text)
    is_letter = letters[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_letter, [False]))))
    starts, ends = edges[::2], edges[1::2]
    c = np.concatenate((np.zeros(2, np.uint32), np.where(is_letter, codes, 0), np.zeros(1, np.uint32)))
    pair = np.where(c[1:-1] > 0, c[:-2] * np.uint32(0x9E3779B1), np.uint32(0)) ^ c[1:-1] * np.uint32(0x85EBCA77)
    history = (pair * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    gram = ((pair + c[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x165667B1)) >> np.uint32(16)
    return history, gram, starts, ends, scripts[codes[starts]] if len(starts) else np.zeros(0, np.uint8)


class Model:
    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        """languages: more common first; grams: log-likelihoods by place and language; scripts: whether a language may have a script."""
        self.languages, self.grams, self.scripts = languages, grams, scripts

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and their scores by language."""
        starts, ends, scores = zip(*self._parts(text), strict=True)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(scores)

    def _parts(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """words() of one block after the other; the more languages, the smaller blocks."""
        offset = 0
        for block in _blocks(text, min(_BLOCK, max(1024, _SCORES // max(1, len(self.languages))))):
            _, gram, s, e, script = _scan(block)
            sums = np.zeros((len(gram) + 1, len(self.languages)))
            np.cumsum(self.grams[gram], axis=0, out=sums[1:])
            yield s + offset, e + offset, np.where(self.scripts[script], sums[e + 1] - sums[s], -1e6 + 0.0)
            offset += len(_codes(block))

    def label(self, scores: np.ndarray) -> np.ndarray:
        """The optimal labelling of words."""
        return self._label(lambda: [scores])

    def _label(self, blocks: Callable[[], Iterable[np.ndarray]]) -> np.ndarray:
        """The same for the scores of several blocks, which can be had more than once."""
        best = int(sum(scores.sum(0) for scores in blocks()).argmax())
        # What leaving the best single language for a stretch of words can gain: inside, at the start and at the end of the text.
        n, gain, low, most, high = 0, 0.0, 0.0, 0.0, 0.0
        for scores in blocks():
            run = gain + np.concatenate(([0.0], np.cumsum(scores.max(1) - scores[:, best])))
            floor = np.minimum(low, np.minimum.accumulate(run))
            most, high, low, gain = max(most, float((run - floor).max())), max(high, float(run.max())), float(floor[-1]), float(run[-1])
            n += len(scores)
        if most <= 2 * SWITCH and high <= SWITCH and gain - low <= SWITCH:
            return np.full(n, best)
        return viterbi_of(blocks(), SWITCH)

    def labelled(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and languages of all words. Scores of a text of several blocks are made again for each pass, never held together."""
        first = list(islice(self._parts(text), 2))
        parts = (lambda: first) if len(first) < 2 else lambda: self._parts(text)
        starts, ends = (np.concatenate(x) for x in zip(*((s, e) for s, e, _ in parts()), strict=True))
        return starts, ends, self._label(lambda: (scores for _, _, scores in parts())) if len(starts) else starts

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of each run of words of one language, in code points of the text."""
        starts, ends, labels = self.labelled(text)
        if not len(starts):
            return []
        first = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1))
        last = np.concatenate((first[1:] - 1, [len(labels) - 1]))
        return [(int(starts[a]), int(ends[b]), self.languages[labels[a]]) for a, b in zip(first, last, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """The text's language, its share of the letters, and the number of spans."""
        if not text or not self.languages:
            return "und", 0.0, 0
        starts, ends, labels = self.labelled(text)
        if not len(starts):
            return "und", 0.0, 0
        letters = np.bincount(labels, weights=ends - starts, minlength=len(self.languages))
        top = int(letters.argmax())
        return self.languages[top], float(letters[top] / letters.sum()), 1 + int(np.count_nonzero(np.diff(labels)))


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels that maximise the sum of scores less a penalty for each change (see viterbi_of())."""
    return viterbi_of([scores], penalty)


def viterbi_of(blocks: Iterable[np.ndarray], penalty: float) -> np.ndarray:
    """Of scores in blocks: the labels that maximise the sum of scores less a penalty for each change; ties stay, then go to the first label.

    Going back, a label stays if its sum was at most the penalty below the best, else the best one's goes on: a bit for each label and a number
    for each word are all that is kept.
    """
    total, tops, stays = None, [], []
    for scores in blocks:
        if not len(scores):
            continue
        before = np.empty_like(scores)
        few = scores.shape[1] <= 16
        if few:
            now = None if total is None else total.tolist()
            rows = []
            for row in scores.tolist():
                if now is None:
                    now = row
                else:
                    moved = max(now) - penalty
                    now = [(t if t >= moved else moved) + x for t, x in zip(now, row, strict=True)]
                rows.append(now)
            before[:], total = rows, np.array(now)
        else:
            for i, row in enumerate(scores):
                total = row if total is None else np.maximum(total, total.max() - penalty) + row
                before[i] = total
        top = before.argmax(1)
        tops.append(top)
        stays.append(np.packbits(before >= before[np.arange(len(top)), top][:, None] - penalty, axis=1))
    top, stay = np.concatenate(tops), np.concatenate(stays)
    labels = np.empty(len(top), np.int64)
    at = labels[-1] = int(top[-1])
    for i in range(len(top) - 2, -1, -1):
        if not stay[i, at >> 3] >> (7 - (at & 7)) & 1:
            at = int(top[i])
        labels[i] = at
    return labels


class Counts:
    """What training counts of one language: trigrams, their histories and scripts of words."""

    def __init__(self):
        self.grams, self.histories, self.scripts = np.zeros(_TABLE, np.int64), np.zeros(_TABLE, np.int64), np.zeros(_OTHER + 1, np.int64)

    def add(self, text: str, place: np.ndarray) -> None:
        """place gets the history's place of each trigram's place that occurs, the largest of several."""
        for block in _blocks(text):
            history, gram, starts, ends, script = _scan(block)
            inside = np.zeros(len(gram) + 1, np.int64)
            np.add.at(inside, starts, 1)
            np.add.at(inside, np.minimum(ends + 1, len(gram)), -1)
            used = np.cumsum(inside)[:-1] > 0
            self.grams += np.bincount(gram[used], minlength=_TABLE)
            self.histories += np.bincount(history[used], minlength=_TABLE)
            self.scripts += np.bincount(script, minlength=_OTHER + 1)
            np.maximum.at(place, gram, history)

    def parts(self) -> list[tuple[int, np.ndarray]]:
        return [(0, self.grams), (1, self.histories), (2, self.scripts)]


def model_of(languages: list[str], counts: list[Counts], place: np.ndarray) -> Model:
    # A trigram's probability given its history, mixed with its overall frequency: both sides stay proper for unseen signs.
    likelihood = np.empty((_TABLE, len(languages)), np.float32)
    for k, c in enumerate(counts):
        alone = (c.grams + 0.05) / (c.grams.sum() + 0.05 * _TABLE)
        likelihood[:, k] = np.log((c.grams + SMOOTH * 20 * alone) / (c.histories[place] + SMOOTH * 20))
    scripts = np.array([c.scripts for c in counts], np.float64).reshape(len(counts), _OTHER + 1)
    allowed = scripts / np.maximum(1, scripts.sum(1, keepdims=True)) >= SCRIPT_SHARE
    allowed = allowed.T | ~allowed.any(0)[:, None]
    order = sorted(range(len(languages)), key=lambda k: (-scripts[k].sum(), languages[k]))
    return Model([languages[k] for k in order], np.ascontiguousarray(likelihood[:, order]), np.ascontiguousarray(allowed[:, order]))


def learn(rows: list[tuple[str, str]]) -> Model:
    """Trains on (language, text) pairs."""
    counts: dict[str, Counts] = {}
    place = np.zeros(_TABLE, np.int64)
    for lang, text in rows:
        counts.setdefault(lang, Counts()).add(text, place)
    languages = sorted(counts)
    return model_of(languages, [counts[k] for k in languages], place)


_SUMS = pa.schema([("lang", pa.int32()), ("kind", pa.int32()), ("at", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's rows (lang, text); at most _HELD languages are held at once."""
    counts: dict[int, Counts] = {}
    place = np.zeros(_TABLE, np.int64)

    def sums(lang: int, kind: int, values: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(values)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x), t) for x, t in ((lang, pa.int32()), (kind, pa.int32()))] + [pa.array(at, pa.int32()), pa.array(values[at], pa.int64())], schema=_SUMS)

    for whole in batches:
        for batch in pieces(whole, BATCH_ROWS, BATCH_BYTES):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in counts and len(counts) == _HELD:
                    yield from (sums(k, *part) for k, c in counts.items() for part in c.parts())
                    counts.clear()
                counts.setdefault(lang, Counts()).add(text, place)
    yield from (sums(k, *part) for k, c in counts.items() for part in c.parts())
    yield sums(-1, 3, place)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Learns from docs (doc_id, text, lang); rows without language, id or text don't count."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    found = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect())
    rates = spark.createDataFrame([(i, lang, int(_CELLS * min(1.0, per_language / n))) for i, (lang, n) in enumerate(found)], "i int, lang string, rate int")
    chosen = known.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(_CELLS)) < F.col("rate"))
    sums = chosen.select(F.col("i").alias("lang"), "text").mapInArrow(_count, "lang int, kind int, at int, n bigint")
    sums = sums.groupBy("lang", "kind", "at").agg(F.when(F.col("kind") == 3, F.max("n")).otherwise(F.sum("n")).alias("n")).toPandas()
    counts, place = [Counts() for _ in found], np.zeros(_TABLE, np.int64)
    for (lang, kind), part in sums.groupby(["lang", "kind"]):
        into = place if kind == 3 else counts[lang].parts()[kind][1]
        into[part["at"].to_numpy()] = part["n"].to_numpy()
    seen = [i for i, c in enumerate(counts) if c.scripts.any()]
    return model_of([found[i][0] for i in seen], [counts[i] for i in seen], place)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and n_spans of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict
        return lambda keys, texts: [keys, *map(list, zip(*map(predict, texts), strict=True))]

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, lang_pred string, score double, n_spans int")


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the language spans of every row of docs, as `start:end:language` joined by commas."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        spans = shared.value.spans
        return lambda keys, texts: [keys, [",".join(f"{a}:{b}:{lang}" for a, b, lang in spans(t or "")) for t in texts]]

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, spans string")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = train(docs.where(fold("doc_id", 5) != 0))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")
