"""Contract suites of the built-in datasets; each dataset meets its own suite."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import contracts


def _e(table: str, expect: str, column: str | None = None, **more) -> dict:
    return {"expect": expect, "table": table} | ({"column": column} if column else {}) | more


SUITES: dict[str, list[dict]] = {
    "shop_full": [
        _e("customers", "row_count_between", min=1), _e("customers", "unique", "customer_id"), _e("customers", "not_null", "name"), _e("customers", "in_set", "segment", values=["retail", "business", "vip"]), _e("customers", "regex", "name", regex=r"Customer \d{6,}"),
        _e("products", "unique", "product_id"), _e("products", "between", "price", min=0, strict_min=True), _e("products", "in_set", "category", values=["books", "food", "tools", "toys"]),
        _e("orders", "unique", "order_id"), _e("orders", "in_other_table", "customer_id", other="customers", other_column="customer_id"), _e("orders", "between", "discount", min=0, max=0.3), _e("orders", "of_type", "order_date", type="datetime"),
        _e("orders", "equals_child_sum", "total", key="order_id", child="order_items", child_key="order_id", child_value="quantity * unit_price", tolerance=0.01), _e("orders", "columns_match_set", columns=["order_id", "customer_id", "order_date", "status", "discount", "total"]),
        _e("order_items", "unique", "item_id"), _e("order_items", "between", "quantity", min=1, max=5), _e("order_items", "in_other_table", "product_id", other="products", other_column="product_id"), _e("order_items", "mean_between", "quantity", min=2, max=4),
        _e("shipments", "in_other_table", "order_id", other="orders", other_column="order_id"), _e("shipments", "pair_greater", a="delivered_date", b="shipped_date"), _e("shipments", "column_exists", "carrier"),
    ],
    "healthcare": [
        _e("patients", "unique", "patient_id"), _e("patients", "in_set", "sex", values=["F", "M"]), _e("patients", "regex", "blood_type", regex=r"(A|B|AB|O)[+-]"), _e("patients", "not_null", "date_of_birth"),
        _e("encounters", "unique", "encounter_id"), _e("encounters", "in_other_table", "patient_id", other="patients", other_column="patient_id"), _e("encounters", "between", "length_of_stay_days", min=0, max=12), _e("encounters", "between", "charge", min=0),
        _e("claims", "unique", "claim_id"), _e("claims", "in_other_table", "encounter_id", other="encounters", other_column="encounter_id"), _e("claims", "in_set", "status", values=["approved", "denied", "pending"]), _e("claims", "pair_greater", a="billed_amount", b="approved_amount", or_equal=True),
    ],
    "customers": [
        _e("customers", "between", "age", min=18, max=90), _e("customers", "in_set", "plan", values=["basic", "pro", "enterprise"]), _e("customers", "between", "tenure_months", min=0), _e("customers", "proportion_true", "churned", min=0.02, max=0.9), _e("customers", "of_type", "income", type="float"),
    ],
}


def validate(name: str, tables: dict[str, DataFrame]) -> list[dict]:
    """Results of a dataset's own suite."""
    if name not in SUITES:
        raise ValueError(f"no suite for {name}; there are {', '.join(sorted(SUITES))}")
    return contracts.run(tables, SUITES[name])


def exchange(name: str) -> dict[str, dict]:
    return contracts.to_great_expectations(SUITES[name], name)
