"""Personal data in texts: patterns propose spans, check digits confirm them, words near by adjust the score.

1. Each kind's pattern proposes its leftmost non-overlapping matches over the whole text.
2. A validator drops proposals that cannot be what they look like: Luhn for cards, mod 97 for account
   numbers, ranges for addresses, numbers of digits for telephones, barred areas for social security numbers.
3. A kind's score in percent rises where one of its words stands before or after the span, and falls where
   one of its opposite words does (an order number, a release).

The *base* kinds stay whatever their score is. The *further* kinds stay at ``LEAST`` percent or more, and
only where they share no character with a base span.

Offsets are code points, ends exclusive. A null text is an empty one; rows with null or repeated ids are rows
of their own; extra columns are not read. A text of any length is searched whole: every pattern is linear in
it, since no pattern can start again within what it has rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fresh, keyed, slices

#: Percent from which a span of a further kind stays.
LEAST = 50
#: Code points before and after a span in which its words are looked for.
BEFORE, AFTER = 40, 20
#: Percent that a word near by adds, or takes for an opposite one.
NEAR = 30


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether the check digit at the end of a number is right: every second digit from the right counts double."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(s: str) -> bool:
    if len(s) > 38:  # 19 digits with a mark between any two are 37
        return False
    number = digits(s)
    return 12 <= len(number) <= 19 and luhn(number)


def is_phone(s: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in s) <= 15


def is_address(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def is_account(s: str) -> bool:
    """An international account number: 15 to 34 characters, and 1 as its rest by 97 with the first four at the end."""
    code = s.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def is_social(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # without the marks that only bound the engine's work
    valid: Callable[[str], bool]
    percent: int
    words: str  # alternatives that speak for the kind
    against: str  # and against it
    base: bool = True
    #: The same language and the same leftmost matches in a form that never goes back over digits.
    fast: str = ""


KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True, 90, "e-?mail|mail|contact|write", "example"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", is_address, 60, "ip|address|host|server|login|client", "version|release|section|chapter",
         fast=r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", is_card, 70, "card|visa|credit|debit|payment|cvv", "order|invoice|tracking|isbn|serial",
         fast=r"[0-9](?:[\x20-]?[0-9])++"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone, 70, "tel|telephone|phone|mobile|call|fax|whatsapp", "order|invoice|score"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", is_account, 90, "iban|account|bank|transfer", "", base=False),
    Kind("social", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", is_social, 40, "ssn|social|security|taxpayer", "order|invoice|part", base=False),
    Kind("local_phone", r"\b[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b", lambda s: True, 30, "tel|telephone|phone|mobile|call|fax|whatsapp", "order|invoice|isbn", base=False),
)

ANCHOR = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
COMPILED = {k.name: re.compile(k.fast or k.pattern, re.ASCII) for k in KINDS}
_word = lambda words: re.compile(rf"\b(?:{words})\b", re.ASCII | re.IGNORECASE) if words else None
WORDS = {k.name: (_word(k.words), _word(k.against)) for k in KINDS}


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @: before it all characters that may stand there, as far as the last match."""
    out, last = [], 0
    for m in ANCHOR.finditer(text):
        start = m.start()
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def proposed(kind: Kind, text: str) -> list[tuple[int, int]]:
    if kind.name == "email":
        return emails(text)
    out = [m.span() for m in COMPILED[kind.name].finditer(text)]
    return [(a, confirmed_end(text, a, b)) for a, b in out] if kind.name == "iban" else out


def confirmed_end(text: str, start: int, end: int) -> int:
    """The end of the longest part of a proposed account number that is one, whole words of it; ``end`` where none is."""
    at = end
    while at > start + 14:
        if is_account(text[start:at]):
            return at
        at = text.rfind(" ", start, at)
    return end


def scored(kind: Kind, text: str, start: int, end: int) -> int:
    """A span's score in percent, 0 to 100."""
    pro, con = WORDS[kind.name]
    sides = (text[max(0, start - BEFORE) : start], text[end : end + AFTER])
    near = lambda p: p is not None and any(p.search(s) for s in sides)
    return max(0, min(100, kind.percent + NEAR * near(pro) - NEAR * near(con)))


def spans(text: str) -> list[tuple[str, int, int, int, bool]]:
    """(kind, start, end, percent, base) by start, then kind in the order of ``KINDS``."""
    found = []
    for at, kind in enumerate(KINDS):
        if kind.base:
            for a, b in proposed(kind, text):
                if kind.valid(text[a:b]):
                    found.append((a, at, b, scored(kind, text, a, b)))
    taken = sorted((a, b) for a, _, b, _ in found)
    free = gaps(taken, len(text))
    for at, kind in enumerate(KINDS):
        if not kind.base:
            inside = 0
            for a, b in proposed(kind, text):
                while inside < len(free) and free[inside][1] < b:
                    inside += 1
                if inside < len(free) and free[inside][0] <= a and kind.valid(text[a:b]) and (p := scored(kind, text, a, b)) >= LEAST:
                    found.append((a, at, b, p))
    return [(KINDS[at].name, a, b, p, KINDS[at].base) for a, at, b, p in sorted(found)]


def gaps(taken: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """What sorted, perhaps overlapping ``taken`` spans leave of 0 to ``size``."""
    out, at = [], 0
    for a, b in taken:
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, size)]


def masked(text: str, found: list[tuple[str, int, int, int, bool]]) -> str:
    """``text`` with every run of overlapping spans replaced by the first one's kind, as in ``[email]``."""
    out, at, k = [], 0, 0
    while k < len(found):
        name, a, b = found[k][:3]
        while k + 1 < len(found) and found[k + 1][1] < b:
            k += 1
            b = max(b, found[k][2])
        out += [text[at:a], f"[{name}]"]
        at, k = b, k + 1
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("percent", pa.int32()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end, percent, base)) of every row, with no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[tuple]] = []
        for texts in slices(batch.column(1)):
            out += [spans(t) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPANS)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,percent:int,base:boolean>>"
    return by_batch(keyed(docs, id_col, text_col), run, schema, "pii")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` masked; null texts stay null, other columns as they are."""
    own = fresh(docs, "masked")[0]
    wide = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{text_col}`").cast("string").alias(own))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[str | None] = []
        for texts in slices(batch.column(batch.num_columns - 1)):
            out += [None if t is None else masked(t, spans(t)) for t in texts]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=batch.schema.names)

    mended = by_batch(wide, run, wide.schema, "pii")
    return mended.select(*[(F.col(f"`{own}`") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
