"""Locale packs: names, places, formats and identity numbers, as data.

A pack is a dictionary; ``load`` also takes packs from JSON files of a folder, so that a locale can be
added without code. Patterns: ``#`` a digit, ``[abc]`` one of the characters, ``{check}`` the check
digit of what stands before it, anything else as it is.

Names and cities are in ``names``.
"""

from __future__ import annotations

import json
from pathlib import Path

from tessera.sources.names import names

#: Digits of other scripts, in order.
ARABIC, PERSIAN, DEVANAGARI = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "०१२३४५६७८९"

FORMATS: dict[str, dict] = {
    "en-US": {
        "script": "Latin", "phone": "+1 [2-9]##-[2-9]##-####", "phone_regex": r"\+1 [2-9]\d{2}-[2-9]\d{2}-\d{4}", "id": "###-##-####", "id_regex": r"\d{3}-\d{2}-\d{4}", "id_check": None,
        "date": "MM/dd/yyyy", "currency": "USD", "symbol": "$", "symbol_first": True, "symbol_gap": "", "group": ",", "point": ".", "grouping": "western", "income": 4800, "family_first": False, "tax": {"default": 0.0825, "food": 0.0},
    },
    "en-GB": {
        "script": "Latin", "phone": "+44 7### ######", "phone_regex": r"\+44 7\d{3} \d{6}", "id": "[ABCEGHJ][ABCEGHJ]######[ABCD]", "id_regex": r"[A-Z]{2}\d{6}[A-D]", "id_check": None,
        "date": "dd/MM/yyyy", "currency": "GBP", "symbol": "£", "symbol_first": True, "symbol_gap": "", "group": ",", "point": ".", "grouping": "western", "income": 2900, "family_first": False, "tax": {"default": 0.20, "food": 0.0},
    },
    "es-ES": {
        "script": "Latin", "phone": "+34 6## ### ###", "phone_regex": r"\+34 6\d{2} \d{3} \d{3}", "id": "########{check}", "id_regex": r"\d{8}[A-Z]", "id_check": "dni",
        "date": "dd/MM/yyyy", "currency": "EUR", "symbol": "€", "symbol_first": False, "symbol_gap": " ", "group": ".", "point": ",", "grouping": "western", "income": 2100, "family_first": False, "tax": {"default": 0.21, "food": 0.10},
    },
    "fr-FR": {
        "script": "Latin", "phone": "+33 6 ## ## ## ##", "phone_regex": r"\+33 6( \d{2}){4}", "id": "[12]##############", "id_regex": r"[12]\d{14}", "id_check": None,
        "date": "dd/MM/yyyy", "currency": "EUR", "symbol": "€", "symbol_first": False, "symbol_gap": " ", "group": " ", "point": ",", "grouping": "western", "income": 2500, "family_first": False, "tax": {"default": 0.20, "food": 0.055},
    },
    "ur-PK": {
        "script": "Arabic",
        "phone": "+92 3## #######", "phone_regex": r"\+92 3\d{2} \d{7}", "id": "#####-#######-#", "id_regex": r"\d{5}-\d{7}-\d", "id_check": None,
        "date": "dd/MM/yyyy", "currency": "PKR", "symbol": "Rs", "symbol_first": True, "symbol_gap": " ", "group": ",", "point": ".", "grouping": "indian", "income": 90000, "family_first": False, "tax": {"default": 0.18}, "digits": PERSIAN,
    },
    "ar-AE": {
        "script": "Arabic",
        "phone": "+971 5# ### ####", "phone_regex": r"\+971 5\d \d{3} \d{4}", "id": "784-####-#######-#", "id_regex": r"784-\d{4}-\d{7}-\d", "id_check": None,
        "date": "dd/MM/yyyy", "currency": "AED", "symbol": "د.إ", "symbol_first": False, "symbol_gap": " ", "group": ",", "point": ".", "grouping": "western", "income": 12000, "family_first": False, "tax": {"default": 0.05}, "digits": ARABIC,
    },
    "hi-IN": {
        "script": "Devanagari",
        "phone": "+91 9#########", "phone_regex": r"\+91 9\d{9}", "id": "[2-9]##########{check}", "id_regex": r"[2-9]\d{11}", "id_check": "verhoeff",
        "date": "dd-MM-yyyy", "currency": "INR", "symbol": "₹", "symbol_first": True, "symbol_gap": "", "group": ",", "point": ".", "grouping": "indian", "income": 45000, "family_first": False, "tax": {"default": 0.18, "food": 0.05}, "digits": DEVANAGARI,
    },
    "zh-CN": {
        "script": "Han",
        "phone": "+86 1[3-9]# #### ####", "phone_regex": r"\+86 1[3-9]\d \d{4} \d{4}", "id": "#################{check}", "id_regex": r"\d{17}[\dX]", "id_check": "iso7064",
        "date": "yyyy-MM-dd", "currency": "CNY", "symbol": "¥", "symbol_first": True, "symbol_gap": "", "group": ",", "point": ".", "grouping": "western", "income": 9000, "family_first": True, "tax": {"default": 0.13, "food": 0.09},
    },
}

PACKS: dict[str, dict] = {locale: pack | names(locale) for locale, pack in FORMATS.items()}

REQUIRED = {"script", "first", "last", "cities", "phone", "phone_regex", "id", "id_regex", "date", "currency", "symbol", "group", "point", "income"}
ALIASES = {"us": "en-US", "uk": "en-GB", "gb": "en-GB", "spain": "es-ES", "es": "es-ES", "france": "fr-FR", "fr": "fr-FR", "pakistan": "ur-PK", "ur": "ur-PK", "uae": "ar-AE", "ar": "ar-AE", "india": "hi-IN", "hi": "hi-IN", "china": "zh-CN", "zh": "zh-CN"}


def load(folder: str | None = None) -> dict[str, dict]:
    """The packs, with those of JSON files in ``folder`` added or replaced; a file's stem names its locale."""
    packs = dict(PACKS)
    for path in sorted(Path(folder).glob("*.json")) if folder else []:
        pack = json.loads(path.read_text(encoding="utf-8"))
        if missing := REQUIRED - pack.keys():
            raise ValueError(f"{path.name} lacks {', '.join(sorted(missing))}")
        packs[path.stem] = pack
    return packs


def parse_mix(text: str, packs: dict[str, dict] | None = None) -> dict[str, float]:
    """"en-US:2, fr" as shares: {"en-US": 0.6667, "fr-FR": 0.3333}."""
    packs, out = packs or PACKS, {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, weight = part.partition(":")
        name = name.strip()
        name = name if name in packs else ALIASES.get(name.lower(), name)
        if name not in packs:
            raise ValueError(f"unknown locale {name}")
        out[name] = out.get(name, 0.0) + (float(weight) if weight.strip() else 1.0)
    total = sum(out.values())
    if total <= 0:
        raise ValueError("a mix has a positive weight")
    return {k: v / total for k, v in out.items()}
