"""Template documents, batches and chart payloads."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import batches, documents, templates, views
from tessera.sources import datasets


def test_expressions_are_compiled_or_refused(spark):
    df = spark.createDataFrame([(10.0, 3.0)], "a double, b double")
    fields = {c: F.col(c).cast(templates.DECIMAL) for c in df.columns}
    value = lambda text: float(df.select(templates.compile_expression(text, fields, {"t": [(5.0, 0.1), (None, 0.5)]})).first()[0])
    assert value("a / b if b != 0 else 0") == pytest.approx(10 / 3, abs=1e-6)
    assert value("ceil_to(a + b, 5)") == 15 and value("bracket(a, 't')") == 3.0 and value("round(a / 3, 1)") == 3.3
    for bad in ("__import__('os')", "a.b", "x", "[1]", "f(a)", "a +", "lambda: 1", "min(*a)"):
        with pytest.raises(templates.TemplateError):
            templates.compile_expression(bad, fields)


def test_payslips_add_up(spark):
    docs = templates.build(spark.range(200), templates.PAYSLIP, seed=1)
    assert templates.broken_rules(docs, templates.PAYSLIP).count() == 0
    assert templates.broken_rules(docs.withColumn("net", F.col("net") + 1), templates.PAYSLIP).count() == 200


def test_batches_isolate_failures_and_resume(spark):
    raw = [json.dumps({"n": i}) for i in range(30)] + ["not json", None, json.dumps({"n": 1})]
    specs = spark.createDataFrame([(r,) for r in raw], "spec string")

    def generate(spec):
        if spec["n"] % 5 == 0:
            raise batches.Transient("busy")
        return {"n": spec["n"]}

    run = lambda done=None: batches.run(specs, lambda s: [] if s["n"] < 25 else ["too large"], generate, lambda d: ["odd"] if d["n"] == 7 else [], done, retry=batches.Retry(2, 0.0))
    found = run()
    counts = {(r.status, r.stage): r.documents for r in batches.tally(found).collect()}
    assert counts == {("ok", "done"): 19, ("failed", "validate"): 6, ("failed", "generate"): 5, ("failed", "check"): 1}
    assert run(found.where("status = 'ok'")).where("status = 'ok'").count() == 0


def test_retries_are_for_transient_failures_only():
    calls = []

    def fn():
        calls.append(1)
        if len(calls) < 3:
            raise batches.Transient
        return "x"

    assert batches.Retry(3, 0.0).run(fn) == ("x", 3)
    with pytest.raises(KeyError):
        batches.Retry(3, 0.0).run(lambda: {}["a"])


def test_payloads_are_small(spark):
    a, b = (datasets.customers(spark, 300, s)["customers"] for s in (1, 2))
    for p in (views.distribution(a, b, "income"), views.categorical(a, b, "plan"), views.correlation(a, b), views.missing(a, b), views.scores(a, b), views.overview({"c": a})):
        assert len(json.dumps(p)) < views.CEILING
    assert views.chartable(a) == ["age", "income", "tenure_months"] or "income" in views.chartable(a)


def test_lines_are_summed_in_parts_of_bounded_size(spark, monkeypatch):
    """More lines, more parts; a document of very many lines meets itself in all splits; equal totals in any number of parts."""
    monkeypatch.setattr(documents, "LINES", 50)
    monkeypatch.setattr(documents, "FEWEST", 500)
    rows = [(i % 7 if i % 2 else None if i % 10 == 4 else 99, Decimal(i % 13), Decimal("1.25") * (i % 9), "AB"[i % 2], [0.05, None, 0.21][i % 3]) for i in range(600)]
    lines = documents.line_totals(spark.createDataFrame(rows, "doc long, quantity decimal(18,6), unit_price decimal(18,2), tax_label string, tax_rate double").repartition(5))
    found = documents.tax_summary(lines, "doc")
    assert found.rdd.getNumPartitions() == documents.parts(lines) == 12
    wanted = {}
    for doc, quantity, price, label, rate in rows:
        key = (doc, label, None if rate is None else Decimal(str(rate)))
        wanted[key] = wanted.get(key, 0) + (quantity * price).quantize(Decimal("0.01"), "ROUND_HALF_UP")
    assert {(r.doc, r.tax_label, r.tax_rate): r.taxable for r in found.collect()} == wanted
    heads = {r.doc: (r.subtotal, r.tax_total) for r in documents.invoices(lines, "doc").collect()}
    for doc, (subtotal, tax) in heads.items():
        mine = {k: g for k, g in wanted.items() if k[0] == doc}
        assert subtotal == sum(mine.values()) and tax == sum((g * k[2]).quantize(Decimal("0.01"), "ROUND_HALF_UP") for k, g in mine.items() if k[2] is not None)
    assert set(heads) == {r[0] for r in rows}
