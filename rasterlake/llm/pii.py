"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds, in the order that breaks ties; the method's own kind follows.
KINDS = ("email", "ip", "card", "phone", "iban")
#: Words that make a span likelier when they stand within CONTEXT code points before or after it.
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = 40

# Possessive quantifiers and look-behinds only spare retries that cannot match: each pattern finds
# what the plain one finds, in time linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_WORD = re.compile(r"[A-Za-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN: letters as 10 to 35, first four characters last, remainder 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @: a run of local characters has one @ after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1  # a later run cannot cross an @
            at = text.find("@", at + 1)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, matches that fail their check left out."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _iban_end(text: str, start: int, last: int) -> int | None:
    """The longest end of an IBAN with no ASCII letter or digit after it, or else with a small letter after it."""
    glued = None
    for end in range(last, start + 14, -1):
        after = text[end : end + 1]
        if text[end - 1] == " " or (after.isascii() and (after.isupper() or after.isdigit())):
            continue
        iban = text[start:end].replace(" ", "")
        if len(iban) >= 15 and mod97(iban):
            if not (after.isascii() and after.islower()):
                return end
            glued = glued or end
    return glued


def method_spans(text: str) -> list[tuple[int, int, int]]:
    """IBANs of 15 to 34 characters that pass mod-97.

    A run of capitals and digits may go on into the next word, so that every end is tried; the
    search goes on after the span, or else after the run's first character.
    """
    out, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        if end := _iban_end(text, m.start(), m.end()):
            out.append((m.start(), 4, end))
            at = end
    return out


def score(text: str, span: tuple[int, int, int]) -> float:
    """The kind's prior, raised half of the way to 1 where a context word stands near."""
    start, kind, end = span
    name = KINDS[kind]
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    found = {w.lower() for w in _WORD.findall(near)}
    prior = PRIOR[name]
    return (1 + prior) / 2 if not found.isdisjoint(CONTEXT_WORDS[name]) else prior


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text, one row per input row, by a map without a shuffle.

    `n_email`, `n_ip`, `n_card`, `n_phone` and `base_sha256` are of the base kinds; `spans` has all
    kinds, `scores` the score of each, `n_iban` the method's own count. Offsets are code points,
    ends exclusive. Null and empty texts have no spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, joined, scores = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + method_spans(text))
                kinds = [k for _, k, _ in spans]
                counts.append([kinds.count(k) for k in range(len(KINDS))])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(spans))
                scores.append([score(text, s) for s in spans])
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(scores, pa.list_(pa.float64()))], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "scores"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, scores array<double>").withColumnRenamed("id", id_col)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """`docs` with spans of at least that score replaced by their kind in square brackets; other columns unchanged."""
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for span in sorted(base_spans(text) + method_spans(text)):
            if span[0] >= done and score(text, span) >= least:
                out += [text[done : span[0]], f"[{KINDS[span[1]]}]"]
                done = span[2]
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
