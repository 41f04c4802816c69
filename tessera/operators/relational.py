"""Whole relational datasets in the shape of real ones: child counts, popularity, junctions, dependence on ancestors.

Tables are made from the top of the foreign-key graph. A table's rows hang on its *driver*, the foreign key to
its largest parent: each parent row gets as many children as learned, by the parent attribute that tells most
about their number where one does. Its other references go to parents by popularity. Where the key of the table
spans the driver and another reference (a junction), each parent's partners are distinct. Columns that are no
keys come from a copula that also holds the attributes of ancestors, given the attributes of the row's own
ancestors.

Every draw is a function of seed, stream and row number. Draws by weight meet their weights by position: the
weights' running sums cut 0 to their total into parts, and a position meets the part that holds it over an equal
cell of positions, of which there are as many as weights. A popular parent fills many cells, so that no cell
gets more rows than its share of the positions, whatever the weights.

Orders of magnitude: nothing but profiles, correlations, at most ``STRATA_VALUES`` strata and the numbers of rows
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import generate, inference, integrity, repair, stats
from tessera.schema import ForeignKey, Graph, family
from tessera.session import checkpoints

#: A parent's weight is ten times its learned number of children plus one: parents without children can be met too.
POPULAR, FLOOR = 10, 1
#: An attribute stratifies counts if it has 2 to so many values, of so many parents each, and tells so much of the variance.
STRATA_VALUES, STRATA_PARENTS, STRATA_EFFECT = 12, 5, 0.03
#: Ancestors looked at, in hops, and attributes of theirs a child depends on, nearest first.
DEPTH, CONTEXT = 2, 10
#: Rounds of redrawing repeated partners. Parents that need more than a ``DENSE``th of all partners are weighed one by one.
ROUNDS, DENSE = 100, 4

ID = "__id"


# draws by weight


def parts(weighted: DataFrame, order: str, weight: str) -> tuple[DataFrame, int, int]:
    """``weighted`` with ``__before`` (running sum of the whole ``weight`` in ``order``, its own left out), the total and the number of parts.

    ``order`` is numeric and distinct; rows without weight are left out.
    """
    kept = weighted.where(F.col(weight) > 0)
    n, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    return stats.cumulative(kept, order, {"__before": weight}, strict=True), int(total), n


def located(df: DataFrame, position: str, placed: DataFrame, weight: str, total: int, cells: int, on: Iterable[str] = ()) -> DataFrame:
    """``df`` with the columns of the part of ``placed`` (``__before``, ``weight``, others) that holds the long ``position``, of 0 to ``total`` - 1.

    Rows outside all parts get NULLs. ``on``: columns that must be equal too.
    """
    on = list(on)
    size = max(1, -(-total // max(1, cells)))
    last = F.col("__before") + F.col(weight) - 1
    spread = placed.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__before") / size).cast("long"), F.floor(last / size).cast("long"))))
    spread = spread.select("__cell", F.col("__before").cast("long").alias("__from"), last.cast("long").alias("__to"), *[c for c in placed.columns if c not in ("__before", weight)])
    for c in on:
        spread = spread.withColumnRenamed(c, f"__on_{c}")
    keyed = df.withColumn("__at", F.floor(F.col(position) / size).cast("long"))
    same = [F.col(c) == F.col(f"__on_{c}") for c in on]
    met = keyed.join(spread, reduce(lambda a, b: a & b, [F.col("__at") == F.col("__cell"), *same, F.col(position).between(F.col("__from"), F.col("__to"))]), "left")
    return met.drop("__at", "__cell", "__from", "__to", *[f"__on_{c}" for c in on])


def at(seed: int, stream: str, row: Column, total: Column | int) -> Column:
    """A position of 0 to ``total`` - 1."""
    return F.floor(hashing.uniform(seed, stream, row) * total).cast("long")


def popularity(parents: DataFrame, learned: tuple[DataFrame, int, int], seed: int, stream: str) -> DataFrame:
    """``__id`` and ``__w`` of each parent: a weight by a learned number of children, drawn for each."""
    placed, total, n = learned
    drawn = located(parents.select(ID, at(seed, f"popular/{stream}", F.col(ID), total).alias("__pos")), "__pos", placed, "n", total, n)
    return drawn.select(ID, (F.coalesce(F.col("v"), F.lit(0)) * POPULAR + FLOOR).cast("long").alias("__w"))


def counts_of(children: DataFrame) -> DataFrame:
    """v, n: how many parents have v children."""
    return children.groupBy(F.col("children").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def by_popularity(children: DataFrame, weights: DataFrame, seed: int, stream: str, name: str = "__ref") -> DataFrame:
    """``children`` (with ``__id``) with ``name``: the ``__id`` of a parent, by the ``__w`` of ``weights``."""
    placed, total, n = parts(weights.withColumnRenamed(ID, name), name, "__w")
    return located(children.withColumn("__pos", at(seed, f"ref/{stream}", F.col(ID), total)), "__pos", placed, "__w", total, n).drop("__pos")


def distinct_partners(slots: DataFrame, weights: DataFrame, seed: int, stream: str) -> DataFrame:
    """``slots`` (``__id``, ``__parent``, ``__k``) with ``__ref``: partners drawn by weight without replacement within each parent.

    ``__k``, the parent's number of slots, is at most the number of partners. A partner that a parent has already
    is drawn again, which is the same as leaving it out of the next draw. Parents that need a large part of all
    partners take those of the smallest exponential keys instead; of these there are at most ``DENSE`` times as many
    pairs as slots.
    """
    placed, total, m = parts(weights.withColumnRenamed(ID, "__ref"), "__ref", "__w")
    placed = placed.checkpoint()
    dense = F.col("__k") * DENSE > m
    kept = weighed(slots.where(dense), weights, m, seed, stream, None)
    left = slots.where(~dense)
    done: DataFrame | None = None
    for r in range(ROUNDS):
        drawn = located(left.withColumn("__pos", at(seed, f"partner/{stream}/{r}", F.col(ID), total)), "__pos", placed, "__w", total, m).drop("__pos")
        # of a parent's slots with one partner the first keeps it, and none if an earlier round gave it
        first = Window.partitionBy("__parent", "__ref").orderBy("__round", ID)
        both = drawn.withColumn("__round", F.lit(r))
        both = both if done is None else both.unionByName(done)
        ruled = both.withColumn("__good", F.row_number().over(first) == 1).checkpoint()
        done = ruled.where("__good").drop("__good")
        left = ruled.where("NOT __good").drop("__good", "__round", "__ref")
        open_slots, open_parents = left.agg(F.count(F.lit(1)), F.count_distinct("__parent")).first()
        if not open_slots:
            break
        if r >= 4 and open_parents * m <= 1_000_000 + DENSE * open_slots:  # few parents are left: weigh all their partners
            done = done.drop("__round").unionByName(weighed(left, weights, m, seed, stream, done)).withColumn("__round", F.lit(r))
            break
    else:
        raise RuntimeError(f"{open_slots} partners are still repeated after {ROUNDS} rounds")
    return kept.unionByName(done.drop("__round"))


def weighed(slots: DataFrame, weights: DataFrame, m: int, seed: int, stream: str, taken: DataFrame | None) -> DataFrame:
    """``slots`` with partners of the smallest exponential keys of each parent, which none of ``taken`` has.

    Every parent of a slot meets every partner, by number.
    """
    needed = slots.withColumn("__n", F.row_number().over(Window.partitionBy("__parent").orderBy(ID)))
    wanted = needed.groupBy("__parent").agg(F.count(F.lit(1)).alias("__open"))
    met = wanted.withColumn("__number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))).join(weights.select(F.col(ID).alias("__number"), "__w"), "__number")
    if taken is not None:
        met = met.join(taken.select("__parent", F.col("__ref").alias("__number")), ["__parent", "__number"], "left_anti")
    u = F.greatest(hashing.uniform(seed, f"weighed/{stream}", F.concat_ws("/", F.col("__parent").cast("string"), F.col("__number").cast("string"))), F.lit(2.0**-53))
    order = Window.partitionBy("__parent").orderBy(-F.log(u) / F.col("__w"), "__number")
    best = met.withColumn("__n", F.row_number().over(order)).where("__n <= __open").select("__parent", "__n", F.col("__number").alias("__ref"))
    return needed.join(best, ["__parent", "__n"]).select(*slots.columns, "__ref")


# what is learned


@dataclass
class Strata:
    """Numbers of children by the values of one attribute of the parent or an ancestor of it."""

    table: str
    column: str
    effect: float
    placed: DataFrame  # g, v, n, __before
    totals: dict[str, int]


@dataclass
class Context:
    """An ancestor's attribute that a child's columns depend on, and the numbers its categories stand for."""

    table: str
    column: str
    codes: DataFrame | None = None  # value, code

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}"


@dataclass
class Model:
    graph: Graph
    rows: dict[str, int]
    types: dict[str, list[tuple[str, str]]]
    models: dict[str, generate.Copula] = field(default_factory=dict)
    contexts: dict[str, list[Context]] = field(default_factory=dict)
    counts: dict[str, tuple[DataFrame, int, int]] = field(default_factory=dict)
    strata: dict[str, Strata] = field(default_factory=dict)
    null_rates: dict[str, float] = field(default_factory=dict)


def keys_of(graph: Graph, table: str) -> set[str]:
    return {*graph.tables[table].key, *(c for k in graph.parents(table) for c in k.columns)}


def attributes(graph: Graph, table: str, df: DataFrame, most: int = STRATA_VALUES) -> dict[str, int]:
    """Columns of ``table`` that tell something, with their numbers of values (``most`` + 1 stands for more): no keys, two values
    at least, numbers and times of any number of values, others of ``most`` at most."""
    plain = [c for c in df.columns if c not in keys_of(graph, table)]
    if not plain:
        return {}
    # a bounded set of values for each column tells 1, few and many apart in one pass
    seen = df.agg(*[F.approx_count_distinct(f"`{c}`", 0.05).alias(f"a{i}") for i, c in enumerate(plain)]).first()
    few = [c for i, c in enumerate(plain) if seen[f"a{i}"] <= 2 * most]
    exact = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(few)]).first() if few else ()
    found = {c: most + 1 for c in plain} | {c: min(exact[f"d{i}"], most + 1) for i, c in enumerate(few)}
    kinds = {c: family(t) for c, t in df.dtypes}
    return {c: n for c, n in found.items() if n >= 2 and (n <= most or kinds[c] in {"int", "float", "datetime"})}


def lifted(rows: DataFrame, base: str, wanted: dict[str, list[str]], tables: dict[str, DataFrame], graph: Graph) -> DataFrame:
    """``rows`` of ``base`` with the ``wanted`` columns of ancestors as ``table.column``, along the shortest paths; NULL where a reference is."""
    out = rows
    for n, (table, columns) in enumerate(wanted.items()):
        if table == base:
            out = out.select("*", *[F.col(f"`{c}`").alias(f"{table}.{c}") for c in columns])
            continue
        path = graph.path(base, table)
        for hop, k in enumerate(path):
            own = [F.col(f"`{c}`") if hop == 0 else F.col(f"`__{n}_{hop}_{c}`") for c in k.columns]
            onward = path[hop + 1].columns if hop + 1 < len(path) else ()
            up = tables[k.parent].dropDuplicates(list(k.parent_columns)).select(
                *[F.col(f"`{c}`").alias(f"__{n}_k{hop}_{i}") for i, c in enumerate(k.parent_columns)], *[F.col(f"`{c}`").alias(f"__{n}_{hop + 1}_{c}") for c in onward], *([F.col(f"`{c}`").alias(f"{table}.{c}") for c in columns] if not onward else [])
            )
            out = out.join(up, reduce(lambda a, b: a & b, [o == F.col(f"`__{n}_k{hop}_{i}`") for i, o in enumerate(own)]), "left")
    return out.drop(*[c for c in out.columns if c.startswith("__") and c[2:3].isdigit()])


def stratify(k: ForeignKey, tables: dict[str, DataFrame], graph: Graph, known: dict[str, dict[str, int]], least: float = STRATA_EFFECT) -> Strata | None:
    """The attribute of the parent or an ancestor that tells most about the number of children, measured for all of them in one pass."""
    wanted = {t: cs for t in (k.parent, *graph.ancestors(k.parent, DEPTH)) if (cs := [c for c, n in known[t].items() if n <= STRATA_VALUES])}
    if not wanted:
        return None
    counted = tables[k.parent].join(inference.children(tables[k.child], tables[k.parent], k), list(k.parent_columns)).select(*tables[k.parent].columns, F.col("children").cast("double").alias("__y"))
    wide = lifted(counted, k.parent, wanted, tables, graph)
    names = [(t, c) for t, cs in wanted.items() for c in cs]
    melted = wide.select("__y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{t}.{c}`").cast("string").alias("g")) for i, (t, c) in enumerate(names)])).alias("s")).select("__y", "s.*")
    rows = melted.groupBy("i", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("q")).collect()  # few values a column
    best: tuple[float, int] | None = None
    for i in range(len(names)):
        mine = [r for r in rows if r.i == i]
        n, s, q = (sum(r[x] for r in mine) for x in ("n", "s", "q"))
        groups = [r for r in mine if r.g is not None]
        spread = q - s * s / n if n else 0.0
        if spread <= 0 or not 2 <= len(groups) <= STRATA_VALUES or min(r.n for r in groups) < STRATA_PARENTS:
            continue
        effect = sum(r.n * (r.s / r.n - s / n) ** 2 for r in groups) / spread
        if effect >= least and (best is None or effect > best[0]):
            best = effect, i
    if best is None:
        return None
    table, column = names[best[1]]
    counts = wide.where(F.col(f"`{table}.{column}`").isNotNull()).groupBy(F.col(f"`{table}.{column}`").cast("string").alias("g"), F.col("__y").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # a group has few different numbers of children: n of them need n^2 / 2 children
    placed = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).checkpoint()
    totals = {r.g: r.n for r in placed.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    return Strata(table, column, best[0], placed, totals)


def coded(frame: DataFrame, context: list[Context], feats: list[str], kinds: dict[str, str], known: dict[str, dict[str, int]]) -> None:
    """Give categories of the context the mean percent rank of the child's numbers and times in their rows.

    A copula holds monotone dependence only; so ordered, a category's effect is monotone.
    """
    numbers = [c for c in feats if family(kinds[c]) in {"int", "float", "datetime"}]
    plain = [x for x in context if not (family(kinds[x.name]) in {"int", "float", "datetime"} and known[x.table][x.column] > STRATA_VALUES) and family(kinds[x.name]) != "datetime"]
    if not numbers or not plain:
        return
    y = lambda c: (F.unix_micros(F.col(f"`{c}`").cast("timestamp")) if family(kinds[c]) == "datetime" else F.col(f"`{c}`")).cast("double")
    wide = frame.select(*[F.col(f"`{x.name}`").cast("string").alias(f"g{i}") for i, x in enumerate(plain)], *[y(c).alias(f"y{i}") for i, c in enumerate(numbers)])
    for i in range(len(numbers)):
        n = wide.agg(F.count(f"y{i}")).first()[0] or 1
        ranks = stats.ranked(wide.select(f"y{i}"), f"y{i}", f"y{i}").select(f"y{i}", (F.col("rank") / n).alias(f"p{i}"))
        wide = wide.join(ranks, f"y{i}", "left")
    known_ranks = [F.col(f"p{i}") for i in range(len(numbers))]
    mean = sum((F.coalesce(p, F.lit(0.0)) for p in known_ranks), F.lit(0.0)) / F.nullif(sum((F.when(p.isNotNull(), 1).otherwise(0) for p in known_ranks), F.lit(0)), F.lit(0))
    melted = wide.select(mean.alias("m"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"g{i}").alias("value")) for i in range(len(plain))])).alias("s")).select("m", "s.*")
    codes = melted.where("value is not null").groupBy("i", "value").agg(F.avg("m").alias("code")).checkpoint()
    for i, x in enumerate(plain):
        x.codes = codes.where(F.col("i") == i).select("value", "code")


def with_context(rows: DataFrame, base: str, context: list[Context], tables: dict[str, DataFrame], graph: Graph) -> DataFrame:
    """``rows`` with the context as doubles named ``table.column``."""
    wanted: dict[str, list[str]] = {}
    for x in context:
        wanted.setdefault(x.table, []).append(x.column)
    out = lifted(rows, base, wanted, tables, graph)
    kinds = {c: t for c, t in out.dtypes}
    for x in context:
        c = F.col(f"`{x.name}`")
        if x.codes is not None:
            codes = x.codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
            out = out.join(codes, c.cast("string") == F.col("__value"), "left").withColumn(x.name, F.col("__code")).drop("__value", "__code")
        elif family(kinds[x.name]) == "datetime":
            out = out.withColumn(x.name, F.unix_micros(c.cast("timestamp")).cast("double"))
        else:
            out = out.withColumn(x.name, c.cast("double"))
    return out


def fit(tables: dict[str, DataFrame], graph: Graph, depend: bool = True) -> Model:
    """Learn a dataset: row counts, copulas with ancestors' attributes, children per parent, null rates. ``depend``: with ancestors at all."""
    if faults := graph.faults():
        raise ValueError("; ".join(faults))
    spark = next(iter(tables.values())).sparkSession
    checkpoints(spark)
    known = {t: attributes(graph, t, tables[t]) for t in graph.tables}
    m = Model(graph, {t: tables[t].count() for t in graph.tables}, {t: tables[t].dtypes for t in graph.tables})
    for t in graph.order():
        df = tables[t]
        feats = [c for c in df.columns if c not in keys_of(graph, t)]
        context = [Context(a, c) for a in graph.ancestors(t, DEPTH) for c in known[a]][:CONTEXT] if depend and feats else []
        frame = df
        if context:
            wanted: dict[str, list[str]] = {}
            for x in context:
                wanted.setdefault(x.table, []).append(x.column)
            raw = lifted(df, t, wanted, tables, graph).checkpoint()
            coded(raw, context, feats, dict(raw.dtypes), known)
            # a category without codes (a child without numbers) has no order to depend on
            context = [x for x in context if x.codes is not None or family(dict(raw.dtypes)[x.name]) in {"int", "float", "datetime"}]
            frame = with_context(df, t, context, tables, graph).checkpoint()
            m.contexts[t] = context
        if feats:
            m.models[t] = generate.fit(frame.select(*[F.col(f"`{c}`") for c in feats], *[F.col(f"`{x.name}`") for x in context]))
        for k in graph.parents(t):
            counts = counts_of(inference.children(df, tables[k.parent], k)).checkpoint()
            m.counts[k.name] = parts(counts, "v", "n")
            empty = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in k.columns])
            m.null_rates[k.name] = df.agg(F.avg(empty.cast("double"))).first()[0] or 0.0
            if depend and k.parent != t and (found := stratify(k, tables, graph, known)):
                m.strata[k.name] = found
    return m


# generation


def child_counts(m: Model, k: ForeignKey, out: dict[str, DataFrame], seed: int) -> DataFrame:
    """``__id`` of each parent with ``children``, by strata where there are some."""
    parents, strata = out[k.parent], m.strata.get(k.name)
    placed, total, n = m.counts[k.name]
    plain = located(parents.withColumn("__pos", at(seed, f"children/{k.name}", F.col(ID), total)), "__pos", placed, "n", total, n).withColumn("children", F.coalesce("v", F.lit(0))).drop("v", "__pos")
    if strata is None:
        return plain.select(ID, F.col("children").cast("int").alias("children"))
    wide = lifted(plain, k.parent, {strata.table: [strata.column]}, out, m.graph).withColumn("g", F.col(f"`{strata.table}.{strata.column}`").cast("string"))
    size = F.element_at(F.create_map(*[F.lit(x) for pair in strata.totals.items() for x in pair]), F.col("g"))
    wide = wide.withColumn("__pos", at(seed, f"children/{k.name}", F.col(ID), F.when(F.col("g").isin(*strata.totals), size)))
    most = max(strata.totals.values())
    drawn = located(wide, "__pos", strata.placed, "n", most, most, on=["g"])
    return drawn.select(ID, F.coalesce("v", "children").cast("int").alias("children"))


def made_keys(m: Model, t: str, out: dict[str, DataFrame], rows: dict[str, int], scale: float, seed: int, cardinality: dict[str, dict]) -> DataFrame:
    """``__id`` and the key columns of a table. Ids run from 0 without gaps."""
    graph, table = m.graph, m.graph.tables[t]
    types = dict(m.types[t])
    spark = SparkSession.getActiveSession()
    ups = [k for k in graph.parents(t) if k.parent != t]
    sizes = {k.parent: out[k.parent].count() for k in ups}
    if not ups:
        made = spark.range(rows.get(t) or max(1, int(m.rows[t] * scale + 0.5))).withColumnRenamed("id", ID)
    else:
        driver = max(ups, key=lambda k: sizes[k.parent])
        joint = [k for k in ups if k is not driver and set(table.key) >= {*driver.columns, *k.columns}]
        cap = min((sizes[k.parent] for k in joint), default=None)
        spec = cardinality.get(driver.name)
        counted = generate.child_counts(out[driver.parent].select(ID), ID, seed=seed, stream=driver.name, **spec) if spec else child_counts(m, driver, out, seed)
        capped = lambda df: df if cap is None else df.withColumn("children", F.least(F.col("children"), F.lit(cap)))
        counted = capped(counted).checkpoint()
        if rows.get(t):
            counted = capped(generate.fit_to_total(counted, ID, rows[t], seed)).checkpoint()
        placed = stats.cumulative(counted, ID, {"__before": "children"}, strict=True).where("children > 0")
        made = placed.select(F.col(ID).alias("__parent"), F.col("children").alias("__k"), "__before", F.posexplode(F.sequence(F.lit(1), F.col("children"))).alias("__line", "__one"))
        made = made.select((F.col("__before") + F.col("__line")).cast("long").alias(ID), "__parent", "__k", (F.col("__line") + 1).alias("__line"))
        made = referred(made, driver, out, "__parent", types)
        for k in ups:
            if k is driver:
                continue
            weights = popularity(out[k.parent], m.counts[k.name], seed, k.name)
            if k in joint:
                drawn = distinct_partners(made.select(ID, "__parent", "__k"), weights, seed, k.name).select(ID, "__ref")
                made = made.join(drawn, ID, "left")
            else:
                made = by_popularity(made, weights, seed, k.name)
            made = referred(made, k, out, "__ref", types).drop("__ref")
            rate = m.null_rates[k.name] if k.nullable and not set(k.columns) & set(table.key) else 0.0
            if rate:
                none = hashing.uniform(seed, f"ref-null/{k.name}", F.col(ID)) < rate
                made = made.withColumns({c: F.when(~none, F.col(f"`{c}`")) for c in k.columns})
    for c in table.key:
        if c not in made.columns:
            number = F.col("__line") if len(table.key) > 1 and "__line" in made.columns else F.col(ID) + 1
            named = F.format_string(f"{t[:3].upper()}-%06d", number) if types[c] == "string" else number.cast(types[c])
            made = made.withColumn(c, named)
    for k in graph.parents(t):
        if k.parent == t:
            made = self_referred(made, k, m, seed)
    return made.drop("__parent", "__k", "__line")


def referred(made: DataFrame, k: ForeignKey, out: dict[str, DataFrame], ref: str, types: dict[str, str]) -> DataFrame:
    """``made`` with the columns of reference ``k``, from the parent row whose ``__id`` is in ``ref``. A column that an earlier reference filled stays."""
    new = [(c, p) for c, p in zip(k.columns, k.parent_columns, strict=True) if c not in made.columns]
    up = out[k.parent].select(F.col(ID).alias("__up"), *[F.col(f"`{p}`").cast(types[c]).alias(c) for c, p in new])
    return made.join(up, F.col(ref) == F.col("__up"), "left").drop("__up")


def self_referred(made: DataFrame, k: ForeignKey, m: Model, seed: int) -> DataFrame:
    """A reference to a strictly earlier row, by popularity; the first row and a learned share are roots: NULL, or themselves if that may not be."""
    weights = popularity(made.select(ID), m.counts[k.name], seed, k.name)
    placed, total, n = parts(weights, ID, "__w")
    placed = placed.checkpoint()
    drawn = located(placed.select(ID, at(seed, f"self/{k.name}", F.col(ID), F.col("__before")).alias("__pos")), "__pos", placed.withColumnRenamed(ID, "__ref"), "__w", total, n).select(ID, "__ref")
    root = (F.col(ID) == 0) | (hashing.uniform(seed, f"self-root/{k.name}", F.col(ID)) < m.null_rates[k.name])
    up = made.select(F.col(ID).alias("__up"), *[F.col(f"`{p}`").alias(f"__v{i}") for i, p in enumerate(k.parent_columns)])
    met = made.join(drawn, ID, "left").join(up, F.col("__ref") == F.col("__up"), "left")
    for i, (c, p) in enumerate(zip(k.columns, k.parent_columns, strict=True)):
        met = met.withColumn(c, F.when(~root, F.col(f"__v{i}")).otherwise(F.lit(None) if k.nullable else F.col(f"`{p}`")))
    return met.drop("__ref", "__up", *[f"__v{i}" for i in range(len(k.columns))])


@dataclass
class Dataset:
    tables: dict[str, DataFrame]
    notes: list[str]
    graph: Graph
    rules: repair.Report | None = None

    def integrity(self) -> DataFrame:
        return integrity.report(self.tables, self.graph)


def generate_all(m: Model, rows: dict[str, int] | None = None, scale: float = 1.0, seed: int = 0, cardinality: dict[str, dict] | None = None, rules: list[str] | None = None) -> Dataset:
    """A dataset as learned. ``rows`` fixes numbers of rows; where a cap of distinct partners forbids them, a note says so.

    ``cardinality``: for a reference's name, the arguments of ``generate.child_counts`` instead of what was learned.
    ``rules`` are enforced over all tables at the end. Rows that repeat a key which references alone make up go, with a note.
    """
    rows, out, notes = rows or {}, {}, []
    for n, t in enumerate(m.graph.order()):
        own = seed * 1_000 + n
        made = made_keys(m, t, out, rows, scale, own, cardinality or {})
        key = list(m.graph.tables[t].key)
        if key and set(key) <= {c for k in m.graph.parents(t) for c in k.columns}:
            before = made.count()
            made = made.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(ID))).where("__n = 1").drop("__n").checkpoint()
            if (left := made.count()) < before:
                notes.append(f"{t}: {before - left} rows that repeated the key went")
        model, context = m.models.get(t), m.contexts.get(t) or []
        if model is not None:
            if context:
                given = with_context(made, t, context, out, m.graph)
                made = generate.sample_given(model, given, ID, [x.name for x in context], own)
            else:
                made = generate.sample_given(model, made, ID, [], own)
            for p in model.profiles:
                if p.null_rate and p.name in dict(m.types[t]):
                    none = hashing.uniform(own, f"null/{t}.{p.name}", F.col(ID)) < p.null_rate
                    made = made.withColumn(p.name, F.when(~none, F.col(f"`{p.name}`")))
        columns = [c for c, _ in m.types[t]]
        out[t] = made.select(ID, *[F.col(f"`{c}`").cast(k).alias(c) for c, k in m.types[t]]).checkpoint()
        if rows.get(t) and (got := out[t].count()) != rows[t]:
            notes.append(f"{t}: {got} rows, not {rows[t]}")
        assert out[t].columns == [ID, *columns]
    report = None
    if rules:
        out, report = repair.enforce(out, m.graph, rules, {t: ID for t in out}, seed)
    return Dataset({t: df.drop(ID) for t, df in out.items()}, notes, m.graph, report)
