"""Numbers, money, dates and patterns in the forms of a locale pack, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import checksums, hashing


def number(value: Column, pack: dict, places: int = 2) -> Column:
    """A decimal with the pack's grouping and point; exact, half-up."""
    d = F.round(value.cast(f"decimal(38,{places})"), places)
    text = F.abs(d).cast("string")
    whole, part = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    if pack.get("grouping") == "indian":
        # the last three digits, then pairs
        head = F.when(F.length(whole) > 3, F.regexp_replace(F.left(whole, F.length(whole) - 3), r"(?<=\d)(?=(?:\d{2})+$)", pack["group"])).otherwise(F.lit(""))
        whole = F.when(F.length(whole) > 3, F.concat(head, F.lit(pack["group"]), F.right(whole, F.lit(3)))).otherwise(whole)
    else:
        whole = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", pack["group"])
    body = F.concat(whole, F.lit(pack["point"]), part) if places else whole
    return F.when(d < 0, F.concat(F.lit("-"), body)).otherwise(body)


def money(value: Column, pack: dict, places: int = 2) -> Column:
    body, symbol = number(F.abs(value), pack, places), F.lit(pack["symbol"])
    gap = F.lit(pack.get("symbol_gap", ""))
    made = F.concat(symbol, gap, body) if pack.get("symbol_first", True) else F.concat(body, gap, symbol)
    return F.when(value < 0, F.concat(F.lit("-"), made)).otherwise(made)


def parse_money(text: Column, pack: dict, places: int = 2) -> Column:
    """The decimal of a formatted amount; NULL for anything else."""
    bare = F.regexp_replace(F.replace(text, F.lit(pack["symbol"]), F.lit("")), r"[\s  ]", "")
    plain = F.replace(F.replace(bare, F.lit(pack["group"]), F.lit("")), F.lit(pack["point"]), F.lit("."))
    return F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain.try_cast(f"decimal(38,{places})"))


def date(value: Column, pack: dict) -> Column:
    return F.date_format(value, pack["date"])


def parse_date(text: Column, pack: dict) -> Column:
    return F.try_to_date(text, pack["date"])


def localized(text: Column, pack: dict) -> Column:
    """ASCII digits as the pack's own."""
    return F.translate(text, "0123456789", pack["digits"]) if pack.get("digits") else text


def in_script(text: Column, script: str) -> Column:
    """Whether all letters are of a script; marks, digits and punctuation do not matter."""
    return text.rlike(rf"^[\P{{L}}\p{{Is{script}}}]*$")


def phone_valid(text: Column, pack: dict) -> Column:
    return F.coalesce(text.rlike(f"^(?:{pack['phone_regex']})$"), F.lit(False))


def id_valid(text: Column, pack: dict) -> Column:
    """The pack's pattern, then its check digit."""
    ok = F.coalesce(text.rlike(f"^(?:{pack['id_regex']})$"), F.lit(False))
    return ok & checksums.valid(pack["id_check"], text) if pack.get("id_check") else ok


def expanded(pattern: str, seed: int, stream: str, row_id: Column, check: str | None = None) -> Column:
    """A value of a pattern: each place from a hash of its own."""
    parts: list[Column] = []
    for i, piece in enumerate(re.findall(r"\{check\}|\[[^\]]+\]|.", pattern)):
        if piece == "{check}":
            parts.append(checksums.COMPUTE[check](F.concat(*parts)))
        elif piece == "#" or piece[0] == "[" and len(piece) > 1:
            chars = "0123456789" if piece == "#" else re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), piece[1:-1])
            at = hashing.integer(seed, f"{stream}/{i}", row_id, 1, len(chars))
            parts.append(F.substr(F.lit(chars), at.cast("int"), F.lit(1)))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def tax_rate(region: Column, category: Column, rates: dict[str, dict[str, float]]) -> Column:
    """The category's rate in a region, else the region's, else zero."""
    out = F.lit(0.0)
    for name, table in rates.items():
        own = F.lit(float(table.get("default", 0.0)))
        for c, r in table.items():
            if c != "default":
                own = F.when(category == c, F.lit(float(r))).otherwise(own)
        out = F.when(region == name, own).otherwise(out)
    return out


def bracket_tax(amount: Column, table: list[tuple[float | None, float]]) -> Column:
    """Progressive tax: (upper end or None, rate) in rising order; decimal, not rounded."""
    out, low = F.lit(0).cast("decimal(38,10)"), 0.0
    value = amount.cast("decimal(28,6)")
    for high, rate in table:
        top = value if high is None else F.least(value, F.lit(high).cast("decimal(28,6)"))
        part = F.greatest(top - F.lit(low).cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
        out = out + part * F.lit(rate).cast("decimal(8,6)")
        low = high or low
    return out
