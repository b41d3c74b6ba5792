"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, scheme marks and the words
that announce an identifier. A local parser for each kind expands an anchor to both sides,
stops at the end of the span before it, and validates what it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shared import documents_text, lean, small_batches

#: Kinds with a fixed grammar, in the order in which they are listed at one start; then the method's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
CUES = ("token", "api_key", "apikey", "secret", "password", "account", "acct", "iban", "ssn", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LINK = re.compile(r"[^\s\"'<>]+")
_VALUE = re.compile(r"[ \t]*[:=#][ \t]*[\"']?([A-Za-z0-9](?:[A-Za-z0-9_-]*[A-Za-z0-9])?)")

#: Behind a cue of _NUMBERED: what may stand before the value, and values of digits in groups, with few letters first, and of an IBAN in groups.
_NUMBERED = frozenset({"account", "acct", "iban", "ssn", "passport"})
_LEAD = re.compile(r"(?:[ \t]+(?:number|no|nr|num)\b\.?)?(?:(?:[ \t]*[:=#]){1,2}[ \t]*|[ \t]+(?:is[ \t]+)?)[\"']?", re.I)
_FILLED = re.compile(r"[ \t]+(?:number|no|nr|num)\b\.?[ \t]*[:=#]", re.I)
_GROUPED = re.compile(r"[A-Za-z]{0,3}[0-9]+(?:[ -][0-9]{2,}(?![A-Za-z0-9_]|[.,][0-9]))*(?![A-Za-z0-9_]|[.,][0-9])")
_RUN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_-]*[A-Za-z0-9])?")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
_DATE = re.compile(r"[0-9]{4}[ -][0-9]{2}[ -][0-9]{2}")


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, marks in (("@", "@"), ("+", "+"), ("0", "0123456789")):
        for mark in marks:
            found.add_word(mark, (kind, 1))
    found.add_word("://", (":", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_end(text: str, start: int) -> int:
    """The end of the longest IBAN at start whose check digits are right, or 0."""
    m = _IBAN.match(text, start)
    end = m.end() if m else 0
    while end > start:
        only = text[start:end].replace(" ", "").replace("-", "").upper()
        if len(only) < 15:
            return 0
        if text[end - 1].isalnum() and not text[end : end + 1].isalnum() and int("".join(str(int(c, 36)) for c in only[4:] + only[:4])) % 97 == 1:
            return end
        end -= 1
    return 0


def _numbered(text: str, at: int) -> tuple[int, int] | None:
    """The value behind a cue of _NUMBERED that ends at at."""
    lead = _LEAD.match(text, at)
    if not lead:
        return None
    start = lead.end()
    if end := _iban_end(text, start):
        return start, end
    m = _VALUE.match(text, at) or (_RUN.match(text, start) if _FILLED.match(text, at) else None)
    if m:
        value = m[m.re.groups]
        if len(value) >= 6 and any("0" <= c <= "9" for c in value):
            return m.span(m.re.groups)
    m = _GROUPED.match(text, start)
    if m and 6 <= sum("0" <= c <= "9" for c in m.group()) <= 34 and not _DATE.fullmatch(m.group()):
        return m.span()
    return None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    out: list[tuple[str, int, int]] = []
    email = dotted = digits = phone = url = account = 0  # where the last one of a kind ended
    for at, (kind, size) in _automaton().iter(text):
        if kind == "0":
            if at >= dotted:
                m = _DOTTED.match(text, at)
                dotted = m.end()
                if m.group().count(".") >= 3:
                    start, groups = at, m.group().split(".")
                    for i in range(0, len(groups) - 3, 4):
                        four = groups[i : i + 4]
                        end = start + sum(map(len, four)) + 3
                        if all(len(x := g.lstrip("0")) <= 3 and int(x or 0) <= 255 for g in four):
                            out.append(("ip", start, end))
                        start = end + 1
            if at >= digits:
                m = _DIGITS.match(text, at)
                digits = m.end()
                if 14 <= digits - at:
                    only = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(only) <= 19 and _luhn(only):
                        out.append(("card", at, digits))
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append(("email", start, email))
        elif kind == "+":
            if at >= phone and (m := _CALL.match(text, at)):
                phone = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append(("phone", at, phone))
        elif kind == ":":
            mark = start = at - 2
            while start > url and text[start - 1] in _SCHEME:
                start -= 1
            while start < mark and not text[start].isalpha():
                start += 1
            if start < mark and (m := _LINK.match(text, at + 1)):
                end = at + 1 + len(m.group().rstrip(".,;:!?)]}*|"))
                if end > at + 1:
                    url = end
                    out.append(("url", start, end))
        elif at >= account:
            before = at - size
            if before >= 0 and (text[before].isalnum() or text[before] == "_"):
                continue
            if text[before + 1 : at + 1].lower() in _NUMBERED:
                if held := _numbered(text, at + 1):
                    account = held[1]
                    out.append(("account", *held))
                continue
            m = _VALUE.match(text, at + 1)
            if m and len(m[1]) >= 6 and any("0" <= c <= "9" for c in m[1]):
                account = m.end(1)
                out.append(("account", m.start(1), account))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(_SPAN))], ["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id and spans (kind, start, end; code points, by start and kind). A null
    text is the empty one and has none. Only doc_id and text are read; rows may repeat."""
    return documents_text(docs).mapInArrow(lean(_spans), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as text."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact_text(text: str) -> str:
    """Puts <kind> for every span; spans that overlap become one, named after the first."""
    parts, last = [], 0
    for kind, start, end in find_spans(text):
        if start >= last:
            parts += [text[last:start], f"<{kind}>"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the personal data of text replaced, row by row; a null text stays null; all other columns stay."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = [None if t is None else redact_text(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(lean(run), docs.schema)
