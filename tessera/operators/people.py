"""People whose columns agree with one locale, entities with name variants, code-mixed text, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import formats, hashing, text
from tessera.sources.locales import PACKS


def _by_locale(fn, packs: dict[str, dict], locale: Column) -> Column:
    out = None
    for name, pack in packs.items():
        value = fn(pack)
        out = F.when(locale == name, value) if out is None else out.when(locale == name, value)
    return out


def generate(spark: SparkSession, n: int, mix: dict[str, float], seed: int = 0, packs: dict[str, dict] | None = None) -> DataFrame:
    """``n`` people; one narrow projection, all values by hash."""
    packs = {k: (packs or PACKS)[k] for k in mix}
    i = F.col("id")
    df = spark.range(n).select(i, hashing.pick(seed, "locale", i, list(mix), list(mix.values())).alias("locale"), hashing.pick(seed, "gender", i, ["f", "m"]).alias("gender"))
    loc = F.col("locale")
    first = _by_locale(lambda p: F.when(F.col("gender") == "f", hashing.pick(seed, "first", i, p["first"]["f"])).otherwise(hashing.pick(seed, "first", i, p["first"]["m"])), packs, loc)
    df = df.withColumns({"first_name": first, "last_name": _by_locale(lambda p: hashing.pick(seed, "last", i, p["last"]), packs, loc), "city": _by_locale(lambda p: hashing.pick(seed, "city", i, p["cities"]), packs, loc)})
    latin = {k: v for p in packs.values() for k, v in p.get("latin", {}).items()}
    table = F.create_map(*[F.lit(x) for kv in latin.items() for x in kv]) if latin else F.create_map().cast("map<string,string>")
    as_latin = lambda c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c))
    order = _by_locale(lambda p: F.concat("last_name", "first_name") if p.get("family_first") else F.concat_ws(" ", "first_name", "last_name"), packs, loc)
    born = F.date_add(F.lit("1950-01-01").cast("date"), hashing.integer(seed, "born", i, 0, 19_700).cast("int"))
    money = F.exp(hashing.gaussian(seed, "income", i) * 0.4)
    return df.withColumns({
        "full_name": order, "full_name_latin": F.concat_ws(" ", as_latin("first_name"), as_latin("last_name")),
        "phone": _by_locale(lambda p: formats.expanded(p["phone"], seed, "phone", i), packs, loc),
        "email": text.email(as_latin("first_name"), as_latin("last_name"), i),
        "national_id": _by_locale(lambda p: formats.expanded(p["id"], seed, "id", i, p.get("id_check")), packs, loc),
        "date_of_birth": _by_locale(lambda p: formats.date(born, p), packs, loc),
        "currency": _by_locale(lambda p: F.lit(p["currency"]), packs, loc),
        "monthly_income": F.round(_by_locale(lambda p: F.lit(float(p["income"])), packs, loc) * money, 2),
    })


def checks(df: DataFrame, packs: dict[str, dict] | None = None) -> DataFrame:
    """``df`` with a boolean for each check against the row's own locale; unknown locales fail."""
    packs, loc = packs or PACKS, F.col("locale")
    rules = {
        "ok_script": lambda p: formats.in_script(F.col("full_name"), p["script"]),
        "ok_city": lambda p: F.col("city").isin(*p["cities"]),
        "ok_phone": lambda p: formats.phone_valid(F.col("phone"), p),
        "ok_id": lambda p: formats.id_valid(F.col("national_id"), p),
        "ok_date": lambda p: formats.parse_date(F.col("date_of_birth"), p).isNotNull(),
        "ok_currency": lambda p: F.col("currency") == p["currency"],
    }
    return df.withColumns({name: F.coalesce(_by_locale(rule, packs, loc), F.lit(False)) for name, rule in rules.items()})


def coherence(df: DataFrame, packs: dict[str, dict] | None = None) -> DataFrame:
    """check, rows, failures, pass_pct; one aggregation."""
    marked = checks(df, packs)
    names = [c for c in marked.columns if c.startswith("ok_")]
    counts = marked.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.col(c)).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c[3:]).alias("check"), F.col("rows"), F.col(c).alias("failures")) for c in names])
    return counts.select(F.inline(rows)).withColumn("pass_pct", F.round(100 * (1 - F.col("failures") / F.col("rows")), 4))


def entities(spark: SparkSession, n: int, locale: str, seed: int = 0) -> DataFrame:
    """entity_id, record_id, name, style, canonical: native and Latin names, and reordered, shortened and mistyped variants."""
    people = generate(spark, n, {locale: 1.0}, seed)
    first, last = F.substring_index("full_name_latin", " ", 1), F.regexp_replace("full_name_latin", r"^\S+ ", "")
    at = F.greatest(F.lit(2), F.floor(F.length("full_name_latin") / 2)).cast("int")
    typo = F.concat(F.substr(F.col("full_name_latin"), F.lit(1), at - 1), F.substr(F.col("full_name_latin"), at + 1, F.length("full_name_latin")))
    variants = F.array(*[F.struct(v.alias("name"), F.lit(s).alias("style")) for v, s in ((F.col("full_name"), "native"), (F.col("full_name_latin"), "latin"), (F.concat(last, F.lit(", "), first), "reordered"), (F.concat(F.left(first, F.lit(1)), F.lit(". "), last), "initial"), (typo, "typo"))])
    rows = people.select(F.col("id").alias("entity_id"), F.posexplode(variants).alias("k", "v"))
    return rows.select("entity_id", (F.col("entity_id") * 5 + F.col("k")).alias("record_id"), "v.name", "v.style", (F.col("k") == 0).alias("canonical"))


#: Code-mixed templates by pair: base words, with slots that hold a base and an English word.
MIXED = {
    "es-en": [("voy a la {0} para la {1}", [("tienda", "store"), ("reunión", "meeting")]), ("el {0} está en la {1}", [("archivo", "file"), ("pantalla", "screen")])],
    "hi-en": [("मेरा {0} बहुत {1} है", [("दिन", "day"), ("व्यस्त", "busy")]), ("कल {0} में {1} है", [("कार्यालय", "office"), ("बैठक", "meeting")])],
}


def code_mixed(spark: SparkSession, n: int, pair: str, level: float, seed: int = 0) -> DataFrame:
    """text, english_slots, slots, tokens array<struct<token,lang>>: each slot is English with probability ``level``."""
    i = F.col("id")
    which = hashing.integer(seed, "template", i, 0, len(MIXED[pair]) - 1)
    df = spark.range(n)
    out = english = None
    slots = len(MIXED[pair][0][1])
    flags = [hashing.uniform(seed, f"slot/{k}", i) < level for k in range(slots)]
    for t, (pattern, words) in enumerate(MIXED[pair]):
        pieces = []
        for word in pattern.split(" "):
            if word.startswith("{"):
                k = int(word[1:-1])
                pieces.append(F.when(flags[k], F.struct(F.lit(words[k][1]).alias("token"), F.lit("en").alias("lang"))).otherwise(F.struct(F.lit(words[k][0]).alias("token"), F.lit(pair[:2]).alias("lang"))))
            else:
                pieces.append(F.struct(F.lit(word).alias("token"), F.lit(pair[:2]).alias("lang")))
        made = F.array(*pieces)
        out = F.when(which == t, made) if out is None else out.when(which == t, made)
    english = sum((f.cast("int") for f in flags), F.lit(0))
    df = df.select("id", out.alias("tokens"), english.alias("english_slots"), F.lit(slots).alias("slots"))
    return df.select("id", F.array_join(F.transform("tokens", lambda x: x["token"]), " ").alias("text"), "english_slots", "slots", "tokens")


#: Language edge cases by pack: case -> value.
LANGUAGE_CASES = {
    "diacritics": {"combined": "José Ñandú", "many": "Phạm Thị Ánh", "stacked": "Z̤̈a̱l"},
    "normal_forms": {"composed": "Café", "decomposed": "Café", "ligature": "ﬁne"},
    "apostrophes": {"straight": "O'Neil", "curly": "O’Neil", "modifier": "Oʼneil"},
    "long_names": {"long": "Wolfeschlegel" * 6, "single": "X", "many_parts": "Ana María de los Ángeles García y Pérez"},
    "mixed_scripts": {"latin_cyrillic": "Аnna Smith", "latin_arabic": "Ali علی", "latin_han": "Li 李"},
    "rtl_digits": {"arabic": "٠١٢٣ محمد", "marks": "‏محمد‎ 12", "persian": "۱۲۳"},
}


def language_cases(spark: SparkSession, packs: list[str] | None = None) -> DataFrame:
    """pack, case, value and what the value is made of."""
    rows = [(p, c, v) for p in packs or LANGUAGE_CASES for c, v in LANGUAGE_CASES[p].items()]
    df = spark.createDataFrame(rows, "pack string, case string, value string")
    return df.withColumn("p", text.profile(F.col("value"))).select("pack", "case", "value", "p.*")
