"""Samples that keep rules: repaired, rejected until enough are left, or both; and free text by template."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import generate, repair, stats
from tessera.operators.rules import plans
from tessera.operators.rules.language import Call
from tessera.schema import Graph, Table, family
from tessera.session import checkpoints

#: Most rounds of oversampling; each draws by the acceptance rate measured so far.
ROUNDS = 12


def _graph() -> Graph:
    return Graph([Table("t", key=("__id",))])


def keeps_all(df: DataFrame, rules: list[str]) -> Column:
    """Whether a row keeps every row rule; rules over other rows cannot be used here."""
    compiled = plans.compile_rules(rules, {"t": df}, _graph())
    frames = plans.Frames({"t": df}, _graph())
    return reduce(lambda a, b: a & b, [F.coalesce(plans.expression(_bare(r.tree), frames.types, {}).cast("boolean"), F.lit(True)) for r in compiled])


def _bare(tree):
    if isinstance(tree, Call) and tree.op == "UNIQUE":
        raise ValueError("UNIQUE is no rule of a single row")
    return tree


def accepted(df: DataFrame, rules: list[str]) -> DataFrame:
    """The rows that keep every rule."""
    wide = df.select(*[F.col(f"`{c}`").alias(f"t.{c}") for c in df.columns])
    return wide.where(keeps_all(df, rules)).select(*[F.col(f"`t.{c}`").alias(c) for c in df.columns])


def with_rules(spark: SparkSession, model: generate.Copula, n: int, rules: list[str], mode: str = "hybrid", seed: int = 0) -> tuple[DataFrame, dict]:
    """Exactly ``n`` rows that keep ``rules``, and how they came about.

    ``repair`` rewrites columns; ``reject`` oversamples by the measured acceptance and keeps what fits;
    ``hybrid`` repairs first and then rejects what is still broken. Row ids run on over the rounds, so the
    result depends on the seed alone. Raises if the rounds do not bring enough rows.
    """
    if mode not in {"repair", "reject", "hybrid"}:
        raise ValueError(f"unknown mode {mode}")

    def batch(start: int, size: int) -> DataFrame:
        made = generate.sample(spark, model, start + size, seed).where(F.col("__id") >= start)
        if mode == "reject":
            # cut here: a filter pushed through the generator would compute each value again for each rule
            return made.checkpoint()
        return repair.enforce({"t": made}, _graph(), rules, {"t": "__id"}, seed)[0]["t"]

    if mode == "repair":
        out = batch(0, n)
        left = accepted(out, rules).count()
        return out, {"mode": mode, "rounds": 1, "sampled": n, "kept": left}
    parts: list[DataFrame] = []
    have = sampled = 0
    rate = 1.0
    for k in range(ROUNDS):
        size = int((n - have) / max(rate, 0.02) * 1.1) + 16
        part = accepted(batch(sampled, size), rules)
        got = part.count()
        parts.append(part)
        have, sampled = have + got, sampled + size
        rate = have / sampled
        if have >= n:
            break
    if have < n:
        raise ValueError(f"only {have} of {n} rows keep the rules after {sampled} samples")
    out = reduce(DataFrame.unionByName, parts)
    if n:
        last, _ = stats.kth_smallest(out, "__id", n)
        out = out.where(F.col("__id") <= F.lit(last))
    else:
        out = out.limit(0)
    return out, {"mode": mode, "rounds": k + 1, "sampled": sampled, "kept": min(have, n)}


def compare(spark: SparkSession, model: generate.Copula, real: DataFrame, n: int, rules: list[str], seed: int = 0) -> DataFrame:
    """sample, pass_pct, mean_ks: a sample as it comes and one with the rules enforced."""
    rows = []
    numeric = [p.name for p in model.profiles if p.kind == "numeric" and family(p.type) != "datetime"]
    for name, df in (("naive", generate.sample(spark, model, n, seed)), ("enforced", with_rules(spark, model, n, rules, "hybrid", seed)[0])):
        ok = accepted(df, rules).count()
        ks = [stats.ks(real, df, c).first()["statistic"] or 0.0 for c in numeric]
        rows.append((name, 100.0 * ok / n if n else 100.0, float(sum(ks) / len(ks)) if ks else 0.0))
    return spark.createDataFrame(rows, "sample string, pass_pct double, mean_ks double")


def stratified_counts(child: DataFrame, parent: DataFrame, key, attributes: list[str], least_effect: float = 0.03, least_parents: int = 5) -> tuple[str | None, dict]:
    """The parent attribute that tells most about the number of children (by eta squared), and the counts' shares by its values."""
    from tessera.operators.inference import children

    counts = children(child, parent, key)
    on = list(key.parent_columns)
    wide = parent.join(counts, on)
    best: tuple[float, str] | None = None
    for a in attributes:
        e = stats.eta2(wide, a, "children").first()["eta2"]
        if e is not None and e >= least_effect and (best is None or e > best[0]):
            best = e, a
    if best is None:
        return None, {}
    a = best[1]
    rows = wide.where(F.col(a).isNotNull()).groupBy(F.col(a).cast("string").alias("g"), "children").count().collect()
    by: dict[str, list[tuple[int, float]]] = {}
    for r in rows:
        by.setdefault(r["g"], []).append((r["children"], r["count"]))
    sizes = {g: sum(n for _, n in v) for g, v in by.items()}
    return a, {g: sorted((c, n / sizes[g]) for c, n in v) for g, v in by.items() if sizes[g] >= least_parents}


def child_counts_by(parents: DataFrame, parent_id: str, attribute: str, learned: dict[str, list[tuple[int, float]]], seed: int, stream: str) -> DataFrame:
    """``parents`` with ``children`` drawn from their group's counts; other groups get all groups' counts together."""
    key = F.col(parent_id)
    pool: dict[int, float] = {}
    for pairs in learned.values():
        for c, s in pairs:
            pool[c] = pool.get(c, 0.0) + s / len(learned)
    out = None
    for g, pairs in learned.items():
        value = hashing.pick(seed, f"children/{stream}", key, [c for c, _ in pairs], [s for _, s in pairs])
        hit = F.col(attribute).cast("string") == g
        out = F.when(hit, value) if out is None else out.when(hit, value)
    rest = hashing.pick(seed, f"children/{stream}", key, list(pool), list(pool.values()))
    return parents.withColumn("children", out.otherwise(rest).cast("int"))


def encoded_context(children: DataFrame, parent: DataFrame, on: list[tuple[str, str]], categories: list[str], target: str) -> DataFrame:
    """``children`` with each parent category replaced by the mean percent rank of ``target`` among its children."""
    up = parent.select(*[F.col(p).alias(f"__k{i}") for i, (_, p) in enumerate(on)], *[F.col(c).alias(f"__c_{c}") for c in categories])
    wide = children.join(up, [F.col(c) == F.col(f"__k{i}") for i, (c, _) in enumerate(on)], "left")
    n = wide.agg(F.count(target).alias("n")).first()["n"] or 1
    ranks = stats.ranked(wide.select(F.col(target).cast("double").alias(target)), target, "__v").withColumn("__pct", F.col("rank") / n)
    wide = wide.join(ranks.select("__v", "__pct"), F.col(target).cast("double") == F.col("__v"), "left")
    for c in categories:
        means = wide.groupBy(F.col(f"__c_{c}").alias("__g")).agg(F.avg("__pct").alias(f"ctx_{c}"))
        wide = wide.join(means, F.col(f"__c_{c}").eqNullSafe(F.col("__g")), "left").drop("__g")
    return wide.select(*children.columns, *[f"ctx_{c}" for c in categories])


#: Free text by kind and mood; ``{0}`` is the subject.
CONTENT = {
    "review": {"positive": ["I am very happy with {0}.", "{0} works better than I hoped.", "Great {0}, I would buy it again."], "neutral": ["{0} is as described.", "{0} does its work."], "negative": ["{0} broke after two days.", "I would not buy {0} again."]},
    "ticket": {"positive": ["Thanks, {0} works now."], "neutral": ["How do I set up {0}?", "Where do I find {0}?"], "negative": ["{0} does not start any more.", "I was charged twice for {0}."]},
}


def content(df: DataFrame, kind: str, subject: str, rating: str, row_id: str, seed: int = 0) -> DataFrame:
    """``df`` with ``text``: mood from a rating (4 and more positive, 2 and less negative), wording by hash."""
    made = None
    mood = F.when(F.col(rating) >= 4, "positive").when(F.col(rating) <= 2, "negative").otherwise("neutral")
    for name, patterns in CONTENT[kind].items():
        value = hashing.pick(seed, f"content/{kind}", F.col(row_id), patterns)
        made = F.when(mood == name, value) if made is None else made.when(mood == name, value)
    return df.withColumn("text", F.replace(made, F.lit("{0}"), F.col(subject).cast("string")))


#: What a generated text must not hold.
PERSONAL = r"[\w.+-]+@[\w-]+\.\w+|\+?\d[\d ().-]{7,}\d"


def content_faults(df: DataFrame, text: str = "text", least: int = 5, most: int = 2_000) -> DataFrame:
    """fault, n: too short or long, personal data, and texts that another row has too."""
    c = F.col(text)
    counts = df.groupBy(c.alias("__t")).agg(F.count(F.lit(1)).alias("n"))
    bad_length = (F.length("__t") < least) | (F.length("__t") > most) | F.col("__t").isNull()
    made = counts.agg(F.coalesce(F.sum(F.when(bad_length, F.col("n"))), F.lit(0)).alias("length"), F.coalesce(F.sum(F.when(F.col("__t").rlike(PERSONAL), F.col("n"))), F.lit(0)).alias("personal"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return made.select(F.inline(F.array(*[F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in ("length", "personal", "repeated")])))


def candidate_search(df: DataFrame, column: str, rules: list[str], first: int = 20) -> DataFrame:
    """``df`` with ``column`` of rows that break a rule set to the most frequent observed value under which all rules hold.

    All observed values are candidates, by falling frequency. Rows that are still broken meet the next ``first`` of
    them, then twice as many, and so on: the work is at most twice the place of the value that mends a row, and only
    rows that nothing mends meet all. These stay as they are, as do rows that break no rule.
    """
    checkpoints(df.sparkSession)
    kind = dict(df.dtypes)[column]
    compiled = plans.compile_rules(rules, {"t": df}, _graph())
    types = plans.Frames({"t": df}, _graph()).types
    target = f"t.{column}"
    wide = df.select(*[F.col(f"`{c}`").alias(f"t.{c}") for c in df.columns])
    holds = reduce(lambda a, b: a & b, [F.coalesce(plans.expression(r.tree, types, {}).cast("boolean"), F.lit(True)) for r in compiled])
    marked = wide.withColumn("__ok", holds)
    left = marked.where(~F.col("__ok")).drop("__ok").withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    broken, mended = left, None
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    donors = stats.numbered(counts, [F.desc("__n"), F.asc("__v")], "__place").select("__v", "__place").checkpoint()
    n, at, size = donors.count(), 0, first
    while at < n and left.limit(1).count():
        until = min(at + size, n)
        some = donors.where(F.col("__place").between(at, until - 1))
        met = left.withColumn("__place", F.explode(F.sequence(F.lit(at).cast("long"), F.lit(until - 1).cast("long")))).join(some, "__place")
        tried = met.select("__row", "__place", "__v", *[(F.col("__v").cast(kind) if f"t.{c}" == target else F.col(f"`t.{c}`")).alias(f"t.{c}") for c in df.columns])
        found = tried.where(holds).groupBy("__row").agg(F.min(F.struct("__place", "__v")).alias("m")).select("__row", F.col("m.__v").alias("__v")).checkpoint()
        mended = found if mended is None else mended.unionByName(found)
        left = left.join(found, "__row", "left_anti").checkpoint()
        at, size = until, 2 * size
    names = lambda new: [(new if c == column else F.col(f"`t.{c}`")).alias(c) for c in df.columns]
    good = marked.where("__ok").select(*names(F.col(f"`{target}`")))
    if mended is None:
        return good.unionByName(broken.select(*names(F.col(f"`{target}`"))))
    return good.unionByName(broken.join(mended, "__row", "left").select(*names(F.coalesce(F.col("__v").cast(kind), F.col(f"`{target}`")))))
