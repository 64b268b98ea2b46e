"""Personal data (operator 7): patterns propose, checksums confirm, context adjusts.

Base spans (email, ip, card, phone) follow fixed rules and always stay. Beside them the method
proposes spans that those rules miss: cards and phones inside a longer run of digits, IBANs,
social security numbers and credentials. Each proposal starts from its kind's prior; a validator
(Luhn, mod 97, number ranges, a fixed form) raises or rejects it, and words near it raise it further; it is
accepted from ``ACCEPT``. Checksums, whole international phone numbers and access key ids suffice alone;
social security numbers, phones without + and opaque words need a context word. A credential that is
assigned to a name like password has that name as its context word. A proposal that only context lifts gives
way to the spans it overlaps. Offsets count code points, ends are exclusive.

Nulls count as empty texts, which have no spans. Very long runs cost time in proportion to their length. Repeated rows are searched alike and
each gives a row; other columns don't count where spans are told and stay where texts are redacted. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.common import map_rows, table

Span = tuple[str, int, int]
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}
ACCEPT, NEAR = 0.5, 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile("[0-9]+")
_NUMBER = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\x20?[=:]\x20?[\"']?([A-Za-z0-9+/_.-]{8,})")
_ACCESS = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/.-]|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![\w-])|(?<![\w+.-])[0-9]{10,11}(?![\w-])")
_NINE = re.compile(r"(?<![\w-])([0-9]{3})(\x20?)([0-9]{2})\2([0-9]{4})(?![\w-])")
_OPAQUE = re.compile(r"(?<![\w+/.=@:-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}+(?![\w+/=@:]|\.\w)")
#: Words that raise a proposal of a kind when they stand near it.
CONTEXT = {
    "card": re.compile(r"(?i)\b(?:card|visa|credit|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|call|tel|mobile|telefon|appelez|llame)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|taxpayer)\b"),
    "secret": re.compile(r"(?i)\b(?:password|secret|token|key|login|credentials?)\b"),
}
_PRIOR = {"card": 0.3, "phone": 0.4, "iban": 0.3, "ssn": 0.3, "secret": 0.4}
_LIFT = 0.2


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += int(d) * 2 - 9 * (d > "4")
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The remainder of a bank account number with its country and check digits moved to the end is 1."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> list[Span]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans in order, and the matches of card and phone that their checks drop."""
    spans, dropped = emails(text) if "@" in text else [], []
    if _DIGIT.search(text):
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            (spans if 12 <= len(digits) <= 19 and luhn(digits) else dropped).append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = sum(map(len, _TOKEN.findall(m[0])))
                (spans if 9 <= n <= 15 else dropped).append(("phone", m.start(), m.end()))
    return sorted(spans, key=_place), dropped


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], _RANK[span[0]], span[2]


def _assigned(area: str, group: str, serial: str) -> bool:
    """Whether the parts of a social security number are in the ranges that are given out."""
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _proposals(text: str, dropped: list[Span]):
    """(kind, start, end, what its validator adds, whether its own name is a context word)."""
    for kind, start, end in dropped:
        if kind == "phone":
            if m := _NUMBER.match(text, start, end):
                yield "phone", m.start(), m.end(), 0.2, False
        else:
            tokens = [(m.start() + start, m.end() + start) for m in _TOKEN.finditer(text[start:end])]
            sizes = [0, *accumulate(b - a for a, b in tokens)]
            i = 0
            while i < len(tokens):  # the longest group of whole tokens that starts here
                best = next((j for j in range(min(len(tokens), bisect_left(sizes, sizes[i] + 20) - 1), i, -1) if 13 <= sizes[j] - sizes[i] <= 19 and luhn("".join(text[a:b] for a, b in tokens[i:j]))), None)
                if best:
                    yield "card", tokens[i][0], tokens[best - 1][1], 0.3, False
                i = best or i + 1
    if _DIGIT.search(text):
        for m in _IBAN.finditer(text):
            if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0]):
                yield "iban", m.start(), m.end(), 0.5, False
        for m in _SSN.finditer(text):
            if _assigned(*m.groups()):
                yield "ssn", m.start(), m.end(), 0.15, False
        if CONTEXT["phone"].search(text):
            for m in _NATIONAL.finditer(text):
                if 9 <= sum(map(len, _TOKEN.findall(m[0]))) <= 12:
                    yield "phone", m.start(), m.end(), 0.0, False
        if CONTEXT["ssn"].search(text):
            for m in _NINE.finditer(text):
                if _assigned(m[1], m[3], m[4]):
                    yield "ssn", m.start(), m.end(), 0.05, False
        if CONTEXT["secret"].search(text):
            for m in _OPAQUE.finditer(text):
                yield "secret", m.start(), m.end(), 0.0, False
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if _DIGIT.search(m[1]):
                yield "secret", m.start(1), m.end(1), 0.0, True
    for m in _ACCESS.finditer(text) if "AKIA" in text else ():
        yield "secret", m.start(), m.end(), 0.4, False


def scored(text: str) -> tuple[list[Span], dict[Span, float]]:
    """Base spans in order, and the score of each other span that is accepted."""
    base, dropped = base_spans(text)
    sure, lifted = {}, {}
    for kind, start, end, evidence, named in _proposals(text, dropped):
        around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
        own = _PRIOR[kind] + evidence
        score = round(own + (_LIFT if named or CONTEXT[kind].search(around) else 0), 2)
        if score >= ACCEPT:
            (sure if own >= ACCEPT or named else lifted)[kind, start, end] = score
    if lifted:
        taken = sorted({(a, b) for _, a, b in [*base, *sure]})
        last = [0, *accumulate((b for _, b in taken), max)]  # where the first i of them have ended
        sure |= {x: score for x, score in lifted.items() if last[bisect_left(taken, (x[2],))] <= x[1]}
    return base, sure


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each in order of place."""
    base, more = scored(text)
    return base, sorted({*base, *more}, key=_place) if more else base


def redact(text: str, spans: list[Span]) -> str:
    """Puts <kind> in place of each run of overlapping spans, named after the first of them."""
    out, last = [], 0
    for kind, start, end in spans:
        if start >= last:
            out += [text[last:start], f"<{kind}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def written(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: counts and a hash of the base spans, all spans, and their scores (1 for base spans)."""

    def make():
        def run(keys, texts):
            found = []
            for base, more in (scored(t or "") for t in texts):
                scores = dict.fromkeys(base, 1.0)
                found.append((base, {s: scores.get(s) or more[s] for s in sorted({*base, *more}, key=_place)} if more else scores))
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in BASE]
            return [keys, *counts, [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], [written(every) for _, every in found], [",".join(map(str, every.values())) for _, every in found]]

        return run

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs.select(id_column, text_column), make, f"{id_column} {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs with their personal data replaced in text, and n_chars counted anew; a null text stays null."""
    names = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]

    def make():
        at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

        def run(*columns):
            columns = list(columns)
            columns[at] = [t and redact(t, find(t)[1]) for t in columns[at]]
            if count is not None:
                columns[count] = [None if t is None else len(t) for t in columns[at]]
            return columns

        return run

    return map_rows(docs.select(*names), make, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
