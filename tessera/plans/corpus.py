"""The test tables as lakes, and the matching SQL building blocks.

* ``star``: the eight star-schema tables as one lake; row ids are file positions.
* ``orders``: one table per order (rows = line items), one lake per order priority.
* ``chats``: one table per conversation (rows = turns), ten lakes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import hashed_text
from tessera.operators.embedding import Embedder
from tessera.operators.positions import group_positions
from tessera.operators.provenance import Block
from tessera.sources.lake import Lake, cells_of_rows
from tessera.sources.tables import read_table

STAR_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
STAR = list(STAR_COLUMNS)
DIM = 8
EMBEDDER = Embedder(model=hashed_text(DIM), dim=DIM)
TOKEN = r"(\w+|[^\w\s])"

BLOCKS = [
    Block("asia-nations", "nation", "n_regionkey IN (SELECT r_regionkey FROM {region} WHERE r_name = 'ASIA')", ("n_name", "n_regionkey")),
    Block("asia-nations", "region", "r_name = 'ASIA'", ("r_name", "r_regionkey")),
    Block("builders", "customer", "c_mktsegment = 'BUILDING'", ("c_name", "c_mktsegment")),
    Block("debtors", "customer", "c_acctbal < 0", ("c_name", "c_acctbal")),
    Block("rich-or-building", "customer", "c_acctbal > 9000", ("c_custkey", "c_acctbal")),
    Block("rich-or-building", "customer", "c_mktsegment = 'BUILDING'", ("c_mktsegment",)),
    Block("large-parts", "part", "p_size > 45", ("p_name", "p_size")),
    Block("rich-suppliers", "supplier", "s_acctbal > 9000", ("*",)),
    Block("large-orders", "orders", "o_totalprice > 400000", ("o_orderkey", "o_totalprice")),
    Block("machinery-orders", "orders", "o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'MACHINERY')", ("o_orderkey", "o_custkey")),
    Block("machinery-orders", "customer", "c_mktsegment = 'MACHINERY'", ("c_custkey", "c_mktsegment")),
    Block("returned", "lineitem", "l_returnflag = 'R' AND l_quantity > 40", ("l_orderkey", "l_quantity", "l_returnflag")),
    Block("errors", "events", "event_type = 'error'", ("event_id", "event_type")),
    Block("no-such-parts", "part", "p_size < 0", ("p_size",)),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LAKES: dict[tuple, Lake] = {}


def star_lake(spark: SparkSession, sf_dir: str, names: list[str] = STAR, lake: str = "star") -> Lake:
    """One lake object per session, so that files are listed and counted once."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, tuple(names), lake)
    if key not in _LAKES:
        _LAKES[key] = Lake(lake, {n: read_table(spark, f"{sf_dir}/{n}.parquet") for n in names})
    return _LAKES[key]


ORDER_COLUMNS = STAR_COLUMNS["lineitem"]


def order_rows(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Rows of the ``orders`` lakes with the names and values of their cells; with ``together``, all rows of an order are in
    one partition, which they are moved to as stored, before there are texts."""
    from tessera.functions.text import value_text

    lines = table(spark, sf_dir, "lineitem").select(*ORDER_COLUMNS)
    numbered = group_positions(lines, ORDER_COLUMNS, ["l_orderkey"])
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("lake")
    )
    types = {f.name: f.dataType for f in lines.schema.fields}
    values = F.array(*[value_text(F.col(c), types[c]) for c in ORDER_COLUMNS])
    names = F.array(*[F.lit(c) for c in ORDER_COLUMNS])
    joined = numbered.join(heads, "l_orderkey")
    if together:
        # a window needs the rows of its key in one partition, whatever the join before it does; it is read, so it stays
        joined = joined.withColumn("_nth", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_orderkey"))).filter("_nth > 0")
    return joined.select(
        "lake", F.concat(F.lit("order-"), F.col("l_orderkey")).alias("table_name"), "row_id", names.alias("names"), values.alias("values"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the ``orders`` lakes."""
    return cells_of_rows(order_rows(spark, sf_dir))


def chat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their lake, table and row id."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("chats-"), F.col("conv_id") % 10).alias("lake"),
        F.concat(F.lit("conv-"), F.col("conv_id")).alias("table_name"),
        F.col("turn").alias("row_id"), "role", "text",
    )


def chat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("role"), F.lit("text"))
    return (
        chat_tables(spark, sf_dir)
        .select("lake", "table_name", "row_id", F.posexplode(F.array("role", "text")).alias("col_pos", "value"))
        .select("lake", "table_name", "row_id", "col_pos", F.element_at(names, F.col("col_pos") + 1).alias("col_name"), "value")
    )


# ---- SQL building blocks -------------------------------------------------------------------------


def sql_tables(names: list[str] = STAR) -> str:
    """``t_<name>``: each table with its file position as row_id."""
    return ",\n".join(f"t_{n} as (select *, row_number() over () - 1 as row_id from {n})" for n in names)


def sql_catalog(names: list[str] = STAR, lake: str = "star") -> str:
    parts = [
        f"select '{lake}' as lake, '{n}' as table_name, count(*) as n_rows, {len(STAR_COLUMNS[n])} as n_cols,"
        f" count(*) * {len(STAR_COLUMNS[n])} as num_cells from {n}"
        for n in names
    ]
    return "tables as (" + " union all ".join(parts) + ")"


def sql_cells(names: list[str] = STAR, lake: str = "star") -> str:
    parts = [
        f"select '{lake}' as lake, '{n}' as table_name, row_id, {i} as col_pos, '{c}' as col_name,"
        f" cast({c} as varchar) as value from t_{n}"
        for n in names
        for i, c in enumerate(STAR_COLUMNS[n])
    ]
    return "cells as (" + "\nunion all ".join(parts) + ")"


def sql_truth_rows(blocks: list[Block] = BLOCKS, lake: str = "star") -> str:
    plain = {n: n for n in STAR}
    parts = [
        f"select '{lake}' as lake, '{b.gt_name}' as gt_name, '{b.table}' as table_name, row_id"
        f" from t_{b.table} where {b.predicate.format(**plain)}"
        for b in blocks
    ]
    return "truth_rows as (" + "\nunion ".join(parts) + ")"


def truth_columns(blocks: list[Block] = BLOCKS) -> dict[tuple[str, str], list[int]]:
    found: dict[tuple[str, str], set[int]] = {}
    for b in blocks:
        names = STAR_COLUMNS[b.table]
        found.setdefault((b.gt_name, b.table), set()).update(
            range(len(names)) if "*" in b.columns else [names.index(c) for c in b.columns]
        )
    return {key: sorted(cols) for key, cols in found.items()}


def sql_truth_cols(blocks: list[Block] = BLOCKS, lake: str = "star") -> str:
    rows = [
        f"('{lake}', '{gt}', '{t}', {c})" for (gt, t), cols in truth_columns(blocks).items() for c in cols
    ]
    return "truth_cols(lake, gt_name, table_name, col_pos) as (values " + ", ".join(rows) + ")"


def sql_order_cells() -> str:
    parts = [
        f"select o_orderpriority as lake, 'order-' || l_orderkey as table_name, row_id, {i} as col_pos,"
        f" '{c}' as col_name, cast({c} as varchar) as value from lines"
        for i, c in enumerate(ORDER_COLUMNS)
    ]
    order = ", ".join(ORDER_COLUMNS)
    return (
        f"lines as (select *, row_number() over (partition by l_orderkey order by {order}) - 1 as row_id"
        " from lineitem join orders on l_orderkey = o_orderkey),\ncells as (" + " union all ".join(parts) + ")"
    )


SQL_CHAT_CELLS = (
    "cells as (select 'chats-' || (conv_id % 10) as lake, 'conv-' || conv_id as table_name, turn as row_id, 0 as col_pos,"
    " 'role' as col_name, role as value from conversations union all select 'chats-' || (conv_id % 10), 'conv-' || conv_id,"
    " turn, 1, 'text', text from conversations)"
)


def sql_hash(text: str, i: int) -> str:
    return f"(2 * (strpos('0123456789abcdef', substr(md5({text}), {i + 1}, 1)) - 1) - 15)::double"


def sql_name(text: str) -> str:
    return f"replace(replace({text}, '-', ' '), '_', ' ')"


def sql_round(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"
