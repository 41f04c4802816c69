"""Formats, people, documents and statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formats, text
from tessera.operators import documents, people
from tessera.sources.locales import PACKS
from tessera.sources.tables import read

from .registry import example, query


@query("format_money_us", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(CAST(c_acctbal * 1000 AS DECIMAL(18,2)))::DOUBLE) AS v FROM customer")
def format_money_us(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", formats.money((F.col("c_acctbal") * 1000).cast("decimal(18,2)"), PACKS["en-US"]).alias("v"))


@query("format_indian_groups", "SELECT c_custkey, CASE WHEN length(n) > 3 THEN regexp_replace(reverse(regexp_replace(reverse(n[:-4]), '(\\d\\d)', '\\1,', 'g')), '^,', '') || ',' || n[-3:] ELSE n END AS v FROM (SELECT c_custkey, CAST(c_custkey * 12345 AS VARCHAR) AS n FROM customer)")
def format_indian_groups(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", formats.number(F.col("c_custkey") * 12345, PACKS["hi-IN"], 0).alias("v"))


@query("format_round_trip", "SELECT l AS locale, count(*) AS n, count(*) AS same FROM customer, (SELECT unnest(['en-US', 'en-GB', 'es-ES', 'fr-FR', 'ur-PK', 'ar-AE', 'hi-IN', 'zh-CN']) AS l) GROUP BY 1")
def format_round_trip(spark, sf_dir):
    value = (F.col("c_acctbal") * 1234).cast("decimal(18,2)")
    out = None
    for name, pack in PACKS.items():
        back = formats.parse_money(formats.money(value, pack), pack)
        part = read(spark, sf_dir, "customer").agg(F.lit(name).alias("locale"), F.count(F.lit(1)).alias("n"), F.count_if(back == value).alias("same"))
        out = part if out is None else out.unionByName(part)
    return out


@query("format_dates", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d-%m-%Y') AS hi FROM orders")
def format_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", formats.date(d, PACKS["en-US"]).alias("us"), formats.date(d, PACKS["hi-IN"]).alias("hi"))


@query("native_digits", "SELECT c_custkey, translate(CAST(c_custkey AS VARCHAR), '0123456789', '०१२३४५६७८९') AS v FROM customer")
def native_digits(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", formats.localized(F.col("c_custkey").cast("string"), PACKS["hi-IN"]).alias("v"))


@example("people_coherence", "SELECT c AS \"check\", CAST(400 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS failures, CAST(100 AS DOUBLE) AS pass_pct FROM (SELECT unnest(['script', 'city', 'phone', 'id', 'date', 'currency']) AS c)")
def people_coherence(spark, sf_dir):
    return people.coherence(people.generate(spark, 400, {k: 1 / len(PACKS) for k in PACKS}, seed=5))


@example("people_faults_found", "SELECT CAST(200 AS BIGINT) AS rows, CAST(200 AS BIGINT) AS bad_currency")
def people_faults_found(spark, sf_dir):
    df = people.generate(spark, 200, {"hi-IN": 1.0}, seed=5).withColumn("currency", F.lit("USD"))
    return people.checks(df).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("ok_currency")).alias("bad_currency"))


@example("entity_variants")
def entity_variants(spark, sf_dir):
    return people.entities(spark, 50, "ur-PK", seed=2)


@example("code_mixed_text")
def code_mixed_text(spark, sf_dir):
    return people.code_mixed(spark, 200, "es-en", 0.5, seed=2)


@example("language_cases")
def language_cases(spark, sf_dir):
    return people.language_cases(spark)


@query("script_of_documents", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(text, '[\\p{Cyrillic}\\p{Greek}\\p{Arabic}\\p{Han}\\p{Devanagari}]')) AS latin_only FROM documents GROUP BY 1")
def script_of_documents(spark, sf_dir):
    other = F.col("text").rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsHan}\p{IsDevanagari}]")
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~other).alias("latin_only"))


@query("diacritics_stripped")
def diacritics_stripped(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_diacritics(F.col("text")).cast("binary")).alias("v"))


@query("alike_filter", "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) = 'building'")
def alike_filter(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(text.alike(F.col("c_mktsegment"), " Buílding ")).select("c_custkey")


def _lines(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("unit_price"), F.col("l_returnflag").alias("tax_label"), F.col("l_tax").alias("tax_rate"))
    return documents.line_totals(lines)


_LINES_SQL = "(SELECT l_orderkey AS doc, CAST(round(CAST(l_quantity AS DECIMAL(18,6)) * CAST(l_extendedprice AS DECIMAL(18,2)), 2) AS DECIMAL(38,6)) AS line_total, l_returnflag AS tax_label, CAST(l_tax AS DECIMAL(8,6)) AS tax_rate FROM lineitem)"


@query("tax_by_rate", f"SELECT doc, tax_label, CAST(any_value(tax_rate) AS DOUBLE) AS tax_rate, CAST(sum(line_total) AS DOUBLE) AS taxable, CAST(round(CAST(sum(line_total) AS DECIMAL(18,2)) * CAST(any_value(tax_rate) AS DECIMAL(6,2)), 2) AS DOUBLE) AS tax FROM {_LINES_SQL} GROUP BY doc, tax_label, tax_rate")
def tax_by_rate(spark, sf_dir):
    found = documents.tax_summary(_lines(spark, sf_dir), "doc")
    return found.select("doc", "tax_label", *[F.col(c).cast("double").alias(c) for c in ("tax_rate", "taxable", "tax")])


@query("invoice_totals", f"SELECT doc, CAST(sum(g) AS DOUBLE) AS subtotal, CAST(sum(t) AS DOUBLE) AS tax_total, CAST(sum(g) + sum(t) AS DOUBLE) AS total FROM (SELECT doc, sum(line_total) AS g, round(CAST(sum(line_total) AS DECIMAL(18,2)) * CAST(tax_rate AS DECIMAL(6,2)), 2) AS t FROM {_LINES_SQL} GROUP BY doc, tax_label, tax_rate) GROUP BY doc")
def invoice_totals(spark, sf_dir):
    return documents.invoices(_lines(spark, sf_dir), "doc").select("doc", *[F.col(c).cast("double").alias(c) for c in ("subtotal", "tax_total", "total")])


@query("invoice_reconcile", "SELECT doc, problem FROM (SELECT DISTINCT l_orderkey AS doc FROM lineitem WHERE l_orderkey % 50 = 0), (SELECT unnest(['subtotal', 'total']) AS problem)")
def invoice_reconcile(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    off = F.when(F.col("doc") % 50 == 0, F.lit(1)).otherwise(F.lit(0))
    heads = documents.invoices(lines, "doc").withColumns({c: F.col(c) + off for c in ("subtotal", "total")})
    return documents.reconcile(heads, lines, "doc")


@query("receipt_tendered", "SELECT o_orderkey, CAST(ceil(o_totalprice / 5) * 5 AS DOUBLE) AS tendered, round(CAST(ceil(o_totalprice / 5) * 5 AS DOUBLE) - o_totalprice, 2) AS change FROM orders")
def receipt_tendered(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("t"))
    return documents.receipts(df, "t").select("o_orderkey", F.col("tendered").cast("double").alias("tendered"), F.round(F.col("change").cast("double"), 2).alias("change"))


@query("bracket_tax", "SELECT c_custkey, CAST(round(CAST(least(a, 1000) * 0.1 + greatest(least(a, 5000) - 1000, 0) * 0.2 + greatest(a - 5000, 0) * 0.4 AS DECIMAL(18,6)), 2) AS DOUBLE) AS tax FROM (SELECT c_custkey, CAST(greatest(c_acctbal, 0) AS DECIMAL(12,2)) AS a FROM customer)")
def bracket_tax(spark, sf_dir):
    a = F.greatest("c_acctbal", F.lit(0.0)).cast("decimal(12,2)")
    tax = documents.money(formats.bracket_tax(a, [(1000.0, 0.1), (5000.0, 0.2), (None, 0.4)]))
    return read(spark, sf_dir, "customer").select("c_custkey", tax.cast("double").alias("tax"))


_TX_SQL = "(SELECT user_id AS account, event_id AS seq, CAST(ts AS DATE) AS date, event_type AS category, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS debit, CASE WHEN event_type <> 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS credit FROM events)"


@query("statement_filter", f"""
WITH s AS (SELECT *, sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY account ORDER BY seq) AS balance FROM {_TX_SQL})
SELECT account, CAST(arg_min(balance - coalesce(credit, 0) + coalesce(debit, 0), seq) AS DOUBLE) AS opening, CAST(arg_max(balance, seq) AS DOUBLE) AS closing, CAST(coalesce(sum(debit), 0) AS DOUBLE) AS debits, CAST(coalesce(sum(credit), 0) AS DOUBLE) AS credits, count(*) AS rows
FROM s WHERE coalesce(debit, 0) > 0 AND greatest(coalesce(debit, 0), coalesce(credit, 0)) >= 20.01 AND date >= (SELECT max(CAST(ts AS DATE)) FROM events) - 20 GROUP BY 1
""")
def statement_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    buy, value = F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)")
    tx = e.select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("category"), F.when(buy, value).alias("debit"), F.when(~buy, value).alias("credit"))
    last = e.agg(F.max(F.col("ts").cast("date")).alias("d")).first()["d"]
    wanted = documents.parse_statement_query("debits over 20 in the last 20 days")
    kept = documents.statements(tx, "account", "seq").where(wanted.condition(F.lit(last)))
    return documents.summary(kept, "account", "seq").select("account", *[F.col(c).cast("double").alias(c) for c in ("opening", "closing", "debits", "credits")], "rows")
