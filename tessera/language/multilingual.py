"""Requests in other languages as English ones: folding, language choice and longest-match words, as Columns over a table of texts.

Digits of other scripts, full-width forms and signs become ASCII ones, and forms of a letter one letter. The script, and
among languages of one script the number of known words, tells the language. A text is then cut from left to right into the
longest known words, numbers and single characters; known words become English, stop words go. Where a language is written
with blanks, a word is known only as a whole. Numbers before a numeral word of a power of ten get its zeros.

The same tables serve single texts on the driver (``canonical``, ``language_of``).
"""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of requests and their English; "" for words that say nothing here.
WORDS: dict[str, dict[str, str]] = {
    "es": {"clientes": "customers", "banco": "bank", "fraude": "fraud", "meses": "months", "tienda": "shop", "mil": "thousand", "en": "in", "de": "of", "con": "with", "españa": "spain", "historial": "history"},
    "fr": {"clients": "customers", "banque": "bank", "fraude": "fraud", "mois": "months", "boutique": "shop", "mille": "thousand", "en": "in", "de": "of", "avec": "with", "historique": "history"},
    "de": {"kunden": "customers", "bank": "bank", "betrug": "fraud", "monate": "months", "monaten": "months", "laden": "shop", "tausend": "thousand", "in": "in", "mit": "with", "verlauf": "history"},
    "ur": {"صارفین": "customers", "گاہک": "customers", "بینک": "bank", "دکان": "shop", "دھوکہ دہی": "fraud", "فراڈ": "fraud", "ماہ": "months", "مہینے": "months", "تاریخ": "history", "بنائیں": "generate", "اور": "and", "پاکستان": "pakistan", "کے ساتھ": "with", "کے": "", "کی": "", "کا": "", "میں": "in"},
    "ar": {"عملاء": "customers", "عميل": "customers", "بنك": "bank", "متجر": "shop", "احتيال": "fraud", "أشهر": "months", "شهر": "months", "شهرا": "months", "سجل": "history", "أنشئ": "generate", "مع": "with", "من": "of", "في": "in", "الإمارات": "uae"},
    "hi": {"ग्राहक": "customers", "ग्राहकों": "customers", "बैंक": "bank", "दुकान": "shop", "धोखाधड़ी": "fraud", "महीने": "months", "महीनों": "months", "इतिहास": "history", "बनाओ": "generate", "और": "and", "भारत": "india", "के साथ": "with", "के": "", "की": "", "का": "", "में": "in"},
    "zh": {"客户": "customers", "顾客": "customers", "银行": "bank", "商店": "shop", "欺诈": "fraud", "个月": "months", "月": "months", "历史": "history", "生成": "generate", "中国": "china", "包含": "with", "和": "and", "个": "", "名": "", "的": "", "在": "in"},
}
#: Powers of ten.
POWERS: dict[str, dict[str, int]] = {
    "ur": {"ہزار": 3, "لاکھ": 5, "ملین": 6, "کروڑ": 7},
    "ar": {"ألف": 3, "آلاف": 3, "مليون": 6, "ملايين": 6},
    "hi": {"हज़ार": 3, "हजार": 3, "लाख": 5, "मिलियन": 6, "करोड़": 7},
    "zh": {"百": 2, "千": 3, "万": 4, "十万": 5, "百万": 6},
}
#: Digits and signs of other scripts beside ASCII ones, and forms of Arabic letters beside the one they count as.
SIGNS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९０１２３４５６７８９٬٫٪％،，。؛", "0123456789" * 4 + ",.%%,,.;")
LETTERS = ("أإآٱىیېکہھةےں", "ااااييي" + "كهههين")
MARKS = "[ً-ٰٟـ़]"
SCRIPTS = {"zh": "[一-鿿]", "hi": "[ऀ-ॿ]", "ar": "[؀-ۿ]"}
URDU = "[ٹڈڑںےگچپھژہی]"
LETTER = "A-Za-zÀ-ɏؠ-ٟٮ-ۓऀ-ॣ॰-ॿ"


def fold(text: str) -> str:
    """One form of digits, signs and letters, lower case, no marks."""
    return re.sub(MARKS, "", text.translate(str.maketrans(*SIGNS)).translate(str.maketrans(*LETTERS))).lower()


def folded(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(F.translate(c, *SIGNS), *LETTERS), MARKS, ""))


@cache
def table(lang: str) -> dict[str, str]:
    return {fold(k): v for k, v in WORDS[lang].items()}


@cache
def pattern(lang: str) -> str:
    """Known words, longest first, then numbers, other words and single characters."""
    known = sorted(table(lang), key=lambda w: (-len(w), w))
    words = "|".join(map(re.escape, known))
    if lang != "zh":
        words = f"(?<![{LETTER}])(?:{words})(?![{LETTER}])"
    return f"(?:{words})|[0-9]+(?:[.,][0-9]+)*|[{LETTER}]+|(?s:.)"


@cache
def powers(lang: str) -> list[tuple[str, int, int]]:
    """(pattern of a number before a power of ten, its decimals, zeros to add), longest words first."""
    out = []
    for word, zeros in sorted(POWERS.get(lang, {}).items(), key=lambda x: (-len(fold(x[0])), x[0])):
        end = "" if lang == "zh" else f"(?![{LETTER}])"
        out += [(rf"([0-9]+)\.([0-9]{{{d}}})\s*{re.escape(fold(word))}{end}", d, zeros - d) for d in range(1, zeros + 1)]
        out.append((rf"([0-9]+)()\s*{re.escape(fold(word))}{end}", 0, zeros))
    return out


def _hits(lang: str, text: str) -> int:
    return sum(1 for t in re.findall(pattern(lang), text) if table(lang).get(t, t) != t)


def hits(lang: str, c: Column) -> Column:
    known = F.array(*[F.lit(w) for w, v in table(lang).items() if v != w])
    return F.size(F.filter(F.regexp_extract_all(c, F.lit(pattern(lang)), F.lit(0)), lambda t: F.array_contains(known, t)))


LATIN = ("es", "fr", "de")


def language_of(text: str) -> str:
    """The language of a request; English where nothing tells another."""
    for lang, script in SCRIPTS.items():
        if re.search(script, text):
            return ("ur" if re.search(URDU, text) else "ar") if lang == "ar" else lang
    best = max(LATIN, key=lambda lang: _hits(lang, fold(text)))
    return best if _hits(best, fold(text)) else "en"


def language(c: Column) -> Column:
    """``language_of`` of a column; NULL for NULL."""
    by_script = F.when(c.rlike(SCRIPTS["zh"]), "zh").when(c.rlike(SCRIPTS["hi"]), "hi").when(c.rlike(SCRIPTS["ar"]), F.when(c.rlike(URDU), "ur").otherwise("ar"))
    counts = [F.struct(hits(lang, folded(c)).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, lang in enumerate(LATIN)]
    best = F.greatest(*counts)
    return F.when(c.isNotNull(), F.coalesce(by_script, F.when(best["n"] > 0, best["lang"]).otherwise("en")))


def canonical(text: str) -> str:
    """The text in English, as far as its words are known; English texts with ASCII digits and signs only."""
    lang = language_of(text)
    if lang == "en":
        return text.translate(str.maketrans(*SIGNS))
    t = fold(text)
    for p, _, zeros in powers(lang):
        t = re.sub(p, lambda m, zeros=zeros: m[1] + m[2] + "0" * zeros, t)
    t = "".join(f" {table(lang)[x]} " if x in table(lang) else x for x in re.findall(pattern(lang), t))
    return tidy(t)


def tidy(text: str) -> str:
    return re.sub(r"([^0-9]),(?=\S)", r"\1, ", re.sub(r"\s+([,.;%])", r"\1", re.sub(r"\s+", " ", text))).strip()


def _looked_up(known: Column):
    return lambda x: F.coalesce(F.try_element_at(known, x), x)


def english(c: Column) -> Column:
    """``canonical`` of a column; NULL for NULL."""
    lang, t = language(c), folded(c)
    out = F.when(lang == "en", F.translate(c, *SIGNS))
    for name in WORDS:
        grown = reduce(lambda x, p: F.regexp_replace(x, p[0], "$1$2" + "0" * p[2]), powers(name), t)
        known = F.create_map(*[F.lit(x) for w, v in table(name).items() for x in (w, f" {v} ")])
        joined = F.array_join(F.transform(F.regexp_extract_all(grown, F.lit(pattern(name)), F.lit(0)), _looked_up(known)), "")
        out = out.when(lang == name, F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"\s+", " "), r"\s+([,.;%])", "$1"), r"([^0-9]),(?=\S)", "$1, ")))
    return out
