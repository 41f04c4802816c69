"""Built-in datasets, made by hash on ``spark.range``: the same rows for a seed on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.schema import ForeignKey, Graph, Table

def _id() -> Column:
    return F.col("id")


def _n(seed: int, stream: str, mean: float, std: float, low: float | None = None, high: float | None = None) -> Column:
    v = F.lit(mean) + hashing.gaussian(seed, stream, _id()) * std
    v = F.greatest(v, F.lit(float(low))) if low is not None else v
    return F.least(v, F.lit(float(high))) if high is not None else v


def _day(seed: int, stream: str, start: str, days: int) -> Column:
    return F.date_add(F.lit(start).cast("date"), hashing.integer(seed, stream, _id(), 0, days).cast("int")).cast("timestamp_ntz")


def customers(spark: SparkSession, n: int, seed: int = 0) -> dict[str, DataFrame]:
    """Eight correlated columns with a binary target."""
    df = spark.range(n).select(_id(), F.round(_n(seed, "age", 42, 12, 18, 90)).cast("int").alias("age"), hashing.pick(seed, "plan", _id(), ["basic", "pro", "enterprise"], [5, 3, 1]).alias("plan"), hashing.pick(seed, "region", _id(), ["north", "south", "east", "west"]).alias("region"), _day(seed, "signup", "2019-01-01", 1800).alias("signup_date"))
    income = F.round(18_000 + F.col("age") * 650 + F.when(F.col("plan") == "enterprise", 30_000).when(F.col("plan") == "pro", 9_000).otherwise(0) + hashing.gaussian(seed, "income", _id()) * 9_000, 2)
    tenure = F.greatest(F.lit(0), F.round(30 + hashing.gaussian(seed, "tenure", _id()) * 18)).cast("int")
    df = df.withColumns({"income": income, "tenure_months": tenure, "is_active": hashing.uniform(seed, "active", _id()) < 0.8})
    risk = 1 / (1 + F.exp(F.col("tenure_months") / 12 - 1 + F.when(F.col("plan") == "basic", -0.7).otherwise(0.4)))
    df = df.withColumn("churned", (hashing.uniform(seed, "churn", _id()) < risk).cast("int"))
    return {"customers": df.select("age", "income", "tenure_months", "plan", "region", "signup_date", "is_active", "churned")}


def students(spark: SparkSession, n: int, seed: int = 0) -> dict[str, DataFrame]:
    df = spark.range(n).select(_id(), F.round(_n(seed, "age", 21, 2.5, 17, 40)).cast("int").alias("age"), hashing.pick(seed, "major", _id(), ["maths", "biology", "history", "economics"]).alias("major"), hashing.integer(seed, "year", _id(), 1, 4).cast("int").alias("year_of_study"), F.round(_n(seed, "gpa", 3.0, 0.5, 0, 4), 2).alias("prior_gpa"), F.round(_n(seed, "study", 14, 5, 0, 60), 1).alias("study_hours_week"), F.round(_n(seed, "attendance", 82, 12, 0, 100), 1).alias("attendance_pct"), (hashing.uniform(seed, "job", _id()) < 0.35).alias("part_time_job"), (hashing.uniform(seed, "scholar", _id()) < 0.2).alias("scholarship"), _day(seed, "enrolled", "2020-09-01", 1200).alias("enrolled_date"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 12 * F.col("prior_gpa") + F.col("study_hours_week") + 0.3 * F.col("attendance_pct") + hashing.gaussian(seed, "score", _id()) * 7)), 1)
    df = df.withColumn("final_score", score).withColumn("passed", (F.col("final_score") >= 60).cast("int"))
    return {"students": df.drop("id")}


def employees(spark: SparkSession, n: int, seed: int = 0) -> dict[str, DataFrame]:
    df = spark.range(n).select(_id(), F.round(_n(seed, "age", 40, 11, 18, 70)).cast("int").alias("age"), hashing.pick(seed, "dept", _id(), ["engineering", "sales", "finance", "support"]).alias("department"), F.round(_n(seed, "years", 6, 4, 0, 40), 1).alias("years_at_company"), hashing.integer(seed, "rating", _id(), 1, 5).cast("int").alias("performance_rating"), (hashing.uniform(seed, "remote", _id()) < 0.4).alias("works_remotely"), _day(seed, "hired", "2005-01-01", 6500).alias("hire_date"))
    df = df.withColumn("salary", F.round(30_000 + 900 * F.col("age") + 2_500 * F.col("performance_rating") + hashing.gaussian(seed, "salary", _id()) * 6_000, 2))
    df = df.withColumn("left_company", (hashing.uniform(seed, "left", _id()) < 1 / (1 + F.exp(F.col("years_at_company") / 4 + F.col("performance_rating") / 3 - 1.5))).cast("int"))
    return {"employees": df.drop("id")}


SHOP_RULES = [
    "order_items.quantity >= 1", "order_items.unit_price > 0", "orders.discount between 0 and 30%", "orders.total = SUM(order_items.quantity * order_items.unit_price)",
    "shipments.shipped_date >= orders.order_date", "shipments.delivered_date >= shipments.shipped_date", "orders.status in ('placed', 'shipped', 'delivered', 'cancelled')", "UNIQUE(customers.customer_id)",
]


def shop(spark: SparkSession, n_customers: int, seed: int = 0, full: bool = False) -> dict[str, DataFrame]:
    """customers, products, orders and order_items; ``full`` adds totals, discounts and shipments."""
    c = spark.range(n_customers).select((_id() + 1).alias("customer_id"), F.format_string("Customer %06d", _id() + 1).alias("name"), hashing.pick(seed, "country", _id(), ["DE", "FR", "ES", "US"]).alias("country"), hashing.pick(seed, "segment", _id(), ["retail", "business", "vip"], [6, 3, 1]).alias("segment"))
    n_products = max(10, n_customers // 20)
    p = spark.range(n_products).select((_id() + 1).alias("product_id"), hashing.pick(seed, "category", _id(), ["books", "food", "tools", "toys"]).alias("category"), F.round(F.exp(2.5 + 0.8 * hashing.gaussian(seed, "price", _id())), 2).alias("price"))
    weight = F.when(F.col("segment") == "vip", 5).when(F.col("segment") == "business", 3).otherwise(2)
    u = hashing.uniform(seed, "orders", F.col("customer_id"))
    n_orders = F.floor(-F.log(1 - u) * weight).cast("int")
    o = c.where(n_orders > 0).select("customer_id", "segment", F.explode(F.sequence(F.lit(1), n_orders)).alias("k"))
    o = o.select((F.col("customer_id") * 1000 + F.col("k")).alias("order_id"), "customer_id", "segment")
    key = F.col("order_id")
    o = o.select("order_id", "customer_id", "segment", F.date_add(F.lit("2022-01-01").cast("date"), hashing.integer(seed, "date", key, 0, 900).cast("int")).cast("timestamp_ntz").alias("order_date"), hashing.pick(seed, "status", key, ["placed", "shipped", "delivered", "cancelled"], [2, 2, 5, 1]).alias("status"))
    items = o.select("order_id", F.explode(F.sequence(F.lit(1), hashing.integer(seed, "items", key, 1, 4).cast("int"))).alias("k")).select((F.col("order_id") * 10 + F.col("k")).alias("item_id"), "order_id")
    i = F.col("item_id")
    popular = F.pow(hashing.uniform(seed, "product", i), F.lit(2.0))
    items = items.select("item_id", "order_id", (F.floor(popular * n_products) + 1).cast("long").alias("product_id"), hashing.integer(seed, "quantity", i, 1, 5).cast("int").alias("quantity"))
    items = items.join(F.broadcast(p.select("product_id", F.col("price").alias("unit_price"))) if n_products <= 100_000 else p.select("product_id", F.col("price").alias("unit_price")), "product_id").select("item_id", "order_id", "product_id", "quantity", "unit_price")
    if not full:
        return {"customers": c, "products": p, "orders": o.drop("segment"), "order_items": items}
    totals = items.groupBy("order_id").agg(F.round(F.sum(F.col("quantity") * F.col("unit_price")), 2).alias("total"))
    discount = F.round(hashing.uniform(seed, "discount", key) * F.when(F.col("segment") == "vip", 0.3).otherwise(0.1), 2)
    orders = o.join(totals, "order_id", "left").select("order_id", "customer_id", "order_date", "status", discount.alias("discount"), F.coalesce("total", F.lit(0.0)).alias("total"))
    sent = orders.where("status in ('shipped', 'delivered')")
    shipped = F.col("order_date") + F.make_dt_interval(hashing.integer(seed, "ship", key, 0, 5).cast("int"))
    s = sent.select(F.col("order_id").alias("shipment_id"), "order_id", "status", shipped.alias("shipped_date"), hashing.pick(seed, "carrier", key, ["north post", "fast line"]).alias("carrier"))
    arrived = F.when(F.col("status") == "delivered", F.col("shipped_date") + F.make_dt_interval(hashing.integer(seed, "arrive", F.col("order_id"), 1, 9).cast("int")))
    s = s.select("shipment_id", "order_id", "shipped_date", arrived.alias("delivered_date"), "carrier")
    return {"customers": c, "products": p, "orders": orders, "order_items": items, "shipments": s}


def shop_graph(full: bool = False) -> Graph:
    t = [Table("customers", key=("customer_id",)), Table("products", key=("product_id",)), Table("orders", key=("order_id",)), Table("order_items", key=("item_id",))]
    k = [ForeignKey("orders", ("customer_id",), "customers", ("customer_id",)), ForeignKey("order_items", ("order_id",), "orders", ("order_id",)), ForeignKey("order_items", ("product_id",), "products", ("product_id",))]
    if full:
        t.append(Table("shipments", key=("shipment_id",)))
        k.append(ForeignKey("shipments", ("order_id",), "orders", ("order_id",)))
    return Graph(t, k)


def healthcare(spark: SparkSession, patients: int, seed: int = 0) -> dict[str, DataFrame]:
    """patients, encounters and claims; encounters follow births, pending claims have no approved amount."""
    p = spark.range(patients).select((_id() + 1).alias("patient_id"), F.format_string("Patient %06d", _id() + 1).alias("name"), hashing.pick(seed, "sex", _id(), ["F", "M"]).alias("sex"), _day(seed, "born", "1940-01-01", 28_000).alias("date_of_birth"), hashing.pick(seed, "blood", _id(), ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"]).alias("blood_type"), F.format_string("+1 555 %07d", _id()).alias("phone"))
    e = p.select("patient_id", "date_of_birth", F.explode(F.sequence(F.lit(1), hashing.integer(seed, "visits", F.col("patient_id"), 1, 4).cast("int"))).alias("k")).withColumn("encounter_id", F.col("patient_id") * 10 + F.col("k"))
    key = F.col("encounter_id")
    e = e.select("encounter_id", "patient_id", F.greatest(F.col("date_of_birth"), F.date_add(F.lit("2019-01-01").cast("date"), hashing.integer(seed, "seen", key, 0, 1500).cast("int")).cast("timestamp_ntz")).alias("encounter_date"), hashing.pick(seed, "type", key, ["outpatient", "emergency", "inpatient"], [6, 2, 2]).alias("encounter_type"), hashing.pick(seed, "code", key, ["J06", "I10", "E11", "M54"]).alias("diagnosis_code"))
    e = e.withColumn("length_of_stay_days", F.when(F.col("encounter_type") == "inpatient", hashing.integer(seed, "stay", key, 1, 12)).otherwise(0).cast("int"))
    e = e.withColumn("charge", F.round(150 * F.exp(0.5 * hashing.gaussian(seed, "charge", key)) + 420 * F.col("length_of_stay_days"), 2))
    status = hashing.pick(seed, "claim", key, ["approved", "denied", "pending"], [7, 2, 1])
    c = e.select(key.alias("claim_id"), "encounter_id", (F.col("encounter_date") + F.make_dt_interval(hashing.integer(seed, "submitted", key, 1, 20).cast("int"))).alias("submitted_date"), status.alias("status"), F.col("charge").alias("billed_amount"))
    c = c.withColumn("approved_amount", F.when(F.col("status") == "approved", F.round(F.col("billed_amount") * (0.6 + 0.4 * hashing.uniform(seed, "share", F.col("claim_id"))), 2)).when(F.col("status") == "denied", F.lit(0.0)))
    return {"patients": p, "encounters": e, "claims": c}


PACKS = {"customers": customers, "students": students, "employees": employees, "shop": shop, "shop_full": lambda s, n, seed=0: shop(s, n, seed, True), "healthcare": healthcare}


def source(spark: SparkSession, name: str, rows: int = 1_000, seed: int = 0) -> dict[str, DataFrame]:
    """The tables of a built-in dataset by name."""
    if name not in PACKS:
        raise ValueError(f"unknown dataset {name}; there are {', '.join(sorted(PACKS))}")
    return PACKS[name](spark, rows, seed)


def promoted(df: DataFrame) -> DataFrame:
    """Text columns of which every value is an ISO 8601 time become timestamps; one pass decides."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    iso = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?$"
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~(F.col(f"`{c}`").rlike(iso) & F.col(f"`{c}`").try_cast("timestamp").isNotNull())).alias(f"b{i}") for i, c in enumerate(texts)], *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(texts)]).first()
    good = [c for i, c in enumerate(texts) if row[f"n{i}"] and not row[f"b{i}"]]
    return df.withColumns({c: F.col(f"`{c}`").try_cast("timestamp_ntz") for c in good})


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema everything is text first, and times are recovered."""
    reader = spark.read.option("header", True)
    return promoted(reader.schema(schema).csv(path) if schema else reader.csv(path))


def first_rows(spark: SparkSession, path: str, schema: str | None = None, rows: int = 20_000) -> DataFrame:
    """The first ``rows`` rows of a CSV file, for scores of a large run that need a bounded look only.

    Only the leading part of the file is read: the limit stops the scan.
    """
    reader = spark.read.option("header", True)
    return promoted((reader.schema(schema) if schema else reader).csv(path).limit(rows))


def records(spark: SparkSession, rows: list[dict], most: int = 200_000) -> DataFrame:
    """Row objects as a table."""
    if len(rows) > most:
        raise ValueError(f"at most {most} inline rows")
    return promoted(spark.createDataFrame(rows))
