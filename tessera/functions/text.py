"""Unicode text functions. Normal forms have no Spark built-in, so these run as Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of writing direction, and signs used as apostrophes.
BIDI = "‎‏‪‫‬‭‮⁦⁧⁨⁩"
APOSTROPHES = "’‘ʼ´`ʹ"


def _series(fn, kind: str):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(v))

    return run


def strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def key(text: str) -> str:
    """The form under which names are compared."""
    out = unicodedata.normalize("NFC", text)
    out = "".join("'" if c in APOSTROPHES else c for c in out if c not in BIDI)
    return " ".join(out.split()).casefold()


def scripts(text: str) -> list[str]:
    """Scripts of the letters, by the first word of their Unicode names."""
    return sorted({unicodedata.name(c, "UNKNOWN").split()[0].title() for c in text if c.isalpha()})


def nfc(c: Column) -> Column:
    return _series(lambda v: unicodedata.normalize("NFC", v), "string")(c)


def nfd(c: Column) -> Column:
    return _series(lambda v: unicodedata.normalize("NFD", v), "string")(c)


def is_nfc(c: Column) -> Column:
    return _series(lambda v: unicodedata.is_normalized("NFC", v), "boolean")(c)


def without_diacritics(c: Column) -> Column:
    return _series(strip_marks, "string")(c)


def comparison_key(c: Column) -> Column:
    return _series(key, "string")(c)


PROFILE = "scripts array<string>, nfc boolean, combining int, bidi boolean, native_digits boolean, bytes int, code_points int"


def profile(c: Column) -> Column:
    """What a string is made of."""
    @F.pandas_udf(PROFILE)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            v = v or ""
            rows.append((scripts(v), unicodedata.is_normalized("NFC", v), sum(1 for x in v if unicodedata.combining(x)), any(x in BIDI or unicodedata.bidirectional(x) in ("R", "AL") for x in v), any(x.isdigit() and not x.isascii() for x in v), len(v.encode()), len(v)))
        return pd.DataFrame(rows, columns=["scripts", "nfc", "combining", "bidi", "native_digits", "bytes", "code_points"])

    return run(c)


def alike(c: Column, value: str) -> Column:
    """Equality without regard to case, marks and outer blanks."""
    return F.collate(F.trim(c), "UNICODE_CI_AI") == F.collate(F.lit(value.strip()), "UNICODE_CI_AI")


def email(first: Column, last: Column, row_id: Column) -> Column:
    """One of three local parts, ASCII only; input is Latin text."""
    a = F.lower(F.regexp_replace(without_diacritics(first), r"[^A-Za-z]", ""))
    b = F.lower(F.regexp_replace(without_diacritics(last), r"[^A-Za-z]", ""))
    local = F.when(row_id % 3 == 0, F.concat(a, F.lit("."), b)).when(row_id % 3 == 1, F.concat(F.left(a, F.lit(1)), b)).otherwise(F.concat(a, row_id.cast("string")))
    return F.concat(local, F.lit("@example.com"))
