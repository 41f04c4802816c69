"""A sentence as a dataset configuration: "50k bank customers in Spain, 2% fraud, 12 months of history"."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.language.multilingual import canonical, language_of
from tessera.operators import people, rows
from tessera.sources.locales import ALIASES, PACKS

#: Words of domains.
DOMAINS = {
    "bank": {"words": ("bank", "banking", "account", "fraud"), "flag": "is_fraud", "flag_words": ("fraud", "fraudulent"), "history": "monthly_activity", "value": "txn_amount"},
    "shop": {"words": ("shop", "store", "ecommerce", "e-commerce", "retail", "order"), "flag": "is_fraud", "flag_words": ("fraud", "return", "churn"), "history": "monthly_orders", "value": "order_amount"},
}
#: English numerals: ``ONES`` by value from zero, ``TENS`` from twenty; factors, with their short forms.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SMALL = {w: float(i) for i, w in enumerate(ONES)} | {w: 20.0 + 10 * i for i, w in enumerate(TENS)}
FACTORS = {"hundred": 1e2, "thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6}
TOKEN = re.compile(r"\d[\d,]*(?:\.\d+)?|[^\W\d_]+|%")
MOST_ROWS = 1_000_000
#: Factors of edits that are verbs.
SCALES = {"double": 2.0, "halve": 0.5, "triple": 3.0}


@dataclass(frozen=True)
class Config:
    domain: str = "bank"
    rows: int = 1_000
    locales: dict[str, float] = field(default_factory=lambda: {"en-US": 1.0})
    flag_rate: float = 0.02
    months: int = 6
    seed: int = 0


@dataclass
class Parsed:
    config: Config
    notes: list[str] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Quantity:
    """A number of a sentence and the word after it, which tells what it counts."""

    value: float
    of: str

    @property
    def kind(self) -> str:
        if self.of in {"%", "percent"}:
            return "share"
        if self.of.rstrip("s") in {"month", "year"}:
            return "period"
        return "times" if self.of in {"x", "times"} else "count"

    @property
    def months(self) -> int:
        return int(self.value) * (12 if self.of.startswith("year") else 1)


def quantities(text: str) -> list[Quantity]:
    """All numbers of ``text`` in order, in digits or words: "1.5k rows", "two hundred thousand", "3 %"."""
    words = TOKEN.findall(text.lower())
    out, i = [], 0
    while i < len(words):
        total, part = 0.0, None  # what is complete, and what a factor may still multiply
        start = i
        while i < len(words):
            w = words[i]
            if w[0].isdigit() and part is None and i == start:
                part = float(w.replace(",", ""))
            elif w in SMALL:
                part = (part or 0.0) + SMALL[w]
            elif w == "hundred" and i > start:
                part = (part or 1.0) * FACTORS[w]
            elif w in FACTORS and i > start:
                total, part = total + (part or 1.0) * FACTORS[w], None
            elif not (w == "and" and i > start and i + 1 < len(words) and words[i + 1] in SMALL):
                break
            i += 1
        if i == start:
            i += 1
        else:
            out.append(Quantity(total + (part or 0.0), words[i] if i < len(words) else ""))
    return out


def first(text: str, kind: str) -> Quantity | None:
    return next((q for q in quantities(text) if q.kind == kind), None)


def parse(text: str, seed: int = 0) -> Parsed:
    """Never generates anything; what was not said keeps its default and is noted."""
    low = canonical(text).lower()
    out = Parsed(Config(seed=seed))
    config = out.config
    scores = {d: sum(w in low for w in spec["words"]) for d, spec in DOMAINS.items()}
    if max(scores.values()):
        config = replace(config, domain=max(scores, key=scores.get))
    else:
        out.issues.append("no_domain")
    said = {kind: first(low, kind) for kind in ("count", "share", "period")}
    if said["count"] is None:
        out.issues.append("no_rows")
    else:
        n = int(said["count"].value)
        if n > MOST_ROWS:
            out.issues.append("too_many_rows")
        config = replace(config, rows=min(n, MOST_ROWS))
    if said["share"]:
        if said["share"].value <= 50:
            config = replace(config, flag_rate=said["share"].value / 100)
        else:
            out.issues.append("rate_out_of_range")
    if said["period"]:
        config = replace(config, months=min(said["period"].months, 60))
    found = [code for word, code in ALIASES.items() if len(word) > 2 and re.search(rf"\b{word}\b", low)] + [code for code in PACKS if code.lower() in low]
    if found:
        config = replace(config, locales={c: 1 / len(set(found)) for c in dict.fromkeys(found)})
    out.config = config
    out.notes = [f"{config.rows} {config.domain} customers", f"locales {', '.join(config.locales)}", f"{100 * config.flag_rate:g} % flagged", f"{config.months} months of history"]
    return out


def build(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """customers with an exact number of flagged rows, and one history row per customer and month."""
    spec = DOMAINS[config.domain]
    c = people.generate(spark, config.rows, config.locales, config.seed).withColumn("customer_id", F.col("id") + 1).drop("id")
    key = F.col("customer_id")
    c = c.withColumn("account_balance", F.round(F.col("monthly_income") * F.exp(0.6 * hashing.gaussian(config.seed, "balance", key) + 0.5), 2))
    c = c.withColumn("segment", hashing.pick(config.seed, "segment", key, ["retail", "business", "vip"], [6, 3, 1]))
    risk = hashing.gaussian(config.seed, "risk", key) + 0.5 * F.log1p("account_balance") / 10
    c = rows.flag_top(c, risk, config.flag_rate, "customer_id", spec["flag"])
    h = c.select("customer_id", spec["flag"], "monthly_income", F.explode(F.sequence(F.lit(1), F.lit(config.months))).alias("month")) if config.months else c.select("customer_id", spec["flag"], "monthly_income", F.lit(1).alias("month")).limit(0)
    hk = F.concat_ws("/", F.col("customer_id").cast("string"), F.col("month").cast("string"))
    spike = F.when(F.col(spec["flag"]) & (hashing.uniform(config.seed, "spike", hk) < 0.3), 6.0).otherwise(1.0)
    h = h.select("customer_id", "month", hashing.poisson(hashing.uniform(config.seed, "count", hk), 8.0).alias("txn_count"), F.round(F.col("monthly_income") * 0.3 * spike * F.exp(0.4 * hashing.gaussian(config.seed, "amount", hk)), 2).alias(spec["value"]))
    return {"customers": c, spec["history"]: h}


# edits

def interpret(message: str, config: Config, segments: list[str] = ("retail", "business", "vip")) -> tuple[list[dict], list[str]]:
    """(operations, questions) of a message; what is ambiguous becomes a question."""
    ops, questions, low = [], [], message.lower()
    for clause in re.split(r"\s*(?:;|,\s*(?:and|then)\s+|\band then\b|\.\s+)\s*", low):
        if not clause.strip():
            continue
        share, period, number = (first(clause, kind) for kind in ("share", "period", "count"))
        factor = next((SCALES[w] for w in re.findall(r"\w+", clause) if w in SCALES), None) or (times.value if (times := first(clause, "times")) else None)
        segment = next((s for s in segments if s in clause), None)
        if period:
            ops.append({"op": "set_history_months", "months": period.months})
        elif share and re.search(r"fraud|flag", clause):
            ops.append({"op": "set_flag_rate", "rate": share.value / 100})
        elif share and "outlier" in clause:
            column = re.search(r"(?:in|of|for)\s+(\w+)\s*$", clause)
            if column:
                ops.append({"op": "set_outlier_rate", "rate": share.value / 100, "column": column[1]})
            else:
                questions.append("In which column should the outliers be?")
        elif factor:
            ops.append({"op": "scale_segment", "segment": segment, "factor": factor} if segment else {"op": "scale_rows", "factor": factor})
        elif number and re.search(r"rows|customers|records", clause):
            ops.append({"op": "set_rows", "rows": int(number.value)})
        else:
            questions.append(f"What should change in: {clause.strip()!r}?")
    return ops, questions


def apply(spark: SparkSession, config: Config, op: dict, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], Config]:
    """The tables and configuration after one operation; rows that it does not touch stay as they are."""
    spec, kind = DOMAINS[config.domain], op["op"]
    history = spec["history"]
    if kind in {"set_rows", "scale_rows"}:
        n = op["rows"] if kind == "set_rows" else int(config.rows * op["factor"])
        config = replace(config, rows=n)
        return build(spark, config), config  # by hash, old rows keep their values
    if kind == "set_history_months":
        config = replace(config, months=op["months"])
        return tables | {history: build(spark, config)[history]}, config
    if kind == "set_flag_rate":
        config = replace(config, flag_rate=op["rate"])
        return build(spark, config), config
    if kind == "set_outlier_rate":
        from tessera.operators.generate import outliers_injected

        return tables | {"customers": outliers_injected(tables["customers"], op["column"], op["rate"], config.seed, "customer_id")}, config
    if kind == "scale_segment":
        mine = tables["customers"].where(F.col("segment") == op["segment"])
        n = mine.count()
        if op["factor"] <= 1:
            gone = hashing.exactly(mine, n - int(n * op["factor"]), config.seed, "drop", "customer_id")
            return rows.drop_with_children(tables, "customers", gone, "customer_id", {history: "customer_id"}), config
        top = tables["customers"].agg(F.max("customer_id")).first()[0]
        out, hist = tables["customers"], tables[history]
        for i in range(1, int(op["factor"])):
            shift = F.col("customer_id") + F.lit(i * top)
            out = out.unionByName(mine.withColumn("customer_id", shift))
            hist = hist.unionByName(tables[history].join(mine.select("customer_id"), "customer_id", "left_semi").withColumn("customer_id", shift))
        return tables | {"customers": out, history: hist}, config
    raise ValueError(f"unknown operation {kind}")


def replay(spark: SparkSession, config: Config, ops: list[dict]) -> tuple[dict[str, DataFrame], Config]:
    """Base configuration and operations, in order: the whole state of an editing session."""
    tables = build(spark, config)
    for op in ops:
        tables, config = apply(spark, config, op, tables)
    return tables, config
