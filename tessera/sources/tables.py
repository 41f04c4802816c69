"""Readers of the driver tables and their shop-style views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import ForeignKey, Graph, Table, family

TPC = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TPC_KEYS = [
    ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
]
TPC_PRIMARY = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}

#: Shop-style names for the same tables: view -> (table, {column: name}).
SHOP = {
    "customers": ("customer", {"c_custkey": "customer_id", "c_name": "name", "c_nationkey": "nation_id", "c_acctbal": "balance", "c_mktsegment": "segment"}),
    "orders": ("orders", {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderdate": "order_date", "o_orderstatus": "status", "o_totalprice": "total", "o_orderpriority": "priority"}),
    "order_items": ("lineitem", {"l_orderkey": "order_id", "l_partkey": "product_id", "l_suppkey": "supplier_id", "l_linenumber": "line_number", "l_quantity": "quantity", "l_extendedprice": "unit_price", "l_discount": "discount", "l_tax": "tax", "l_returnflag": "return_flag", "l_shipdate": "shipped_date"}),
    "products": ("part", {"p_partkey": "product_id", "p_name": "name", "p_brand": "brand", "p_type": "category", "p_retailprice": "price"}),
    "suppliers": ("supplier", {"s_suppkey": "supplier_id", "s_name": "name", "s_nationkey": "nation_id"}),
    "nations": ("nation", {"n_nationkey": "nation_id", "n_name": "name", "n_regionkey": "region_id"}),
    "regions": ("region", {"r_regionkey": "region_id", "r_name": "name"}),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tpc(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: read(spark, sf_dir, n) for n in names or TPC}


def tpc_graph(*names: str) -> Graph:
    names = names or TPC
    return Graph([Table(n, {}, (TPC_PRIMARY[n],) if n in TPC_PRIMARY else ()) for n in names], [k for k in TPC_KEYS if k.child in names and k.parent in names])


def shop(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    out = {}
    for view in names or SHOP:
        table, columns = SHOP[view]
        out[view] = read(spark, sf_dir, table).select(*[F.col(a).alias(b) for a, b in columns.items()])
    return out


def shop_sql(view: str) -> str:
    """The view as SQL over the driver table."""
    table, columns = SHOP[view]
    return f"(SELECT {', '.join(f'{a} AS {b}' for a, b in columns.items())} FROM {table})"


def described(tables: dict[str, DataFrame]) -> list[Table]:
    return [Table(n, {c: family(t) for c, t in df.dtypes}) for n, df in tables.items()]
