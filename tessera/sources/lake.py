"""Lakes: sets of differently shaped tables."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import value_text
from tessera.session import local_frame
from tessera.sources.tables import ROW_ID, number_rows, read_table, rows_of_files, table_name_of

CELLS = ["lake", "table_name", "row_id", "col_pos", "col_name", "value"]
CATALOG = ["lake", "table_name", "n_rows", "n_cols", "num_cells"]


@dataclass(frozen=True)
class Lake:
    """Named wide tables, each with ``row_id`` first. Nothing is read until a DataFrame is used."""

    name: str
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    _known: dict = field(default_factory=dict, compare=False, repr=False)  # catalog, once it has been read

    def columns(self, table: str) -> list[str]:
        return [c for c in self.tables[table].columns if c != ROW_ID]

    def with_table(self, name: str, df: DataFrame) -> Lake:
        if name in self.tables:
            raise KeyError(f"lake {self.name} already has a table {name}")
        return Lake(self.name, {**self.tables, name: df})

    def only(self, names: Sequence[str]) -> Lake:
        return Lake(self.name, {n: self.tables[n] for n in names})

    def any_session(self) -> SparkSession:
        return next(iter(self.tables.values())).sparkSession


def lake_from_directory(spark: SparkSession, name: str, path: str) -> Lake:
    """Every ``*.parquet``, then every ``*.csv`` of a folder (not its subfolders), sorted by name."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    lake = Lake(name)
    for suffix in (".parquet", ".csv"):
        for file_name in names:
            if file_name.endswith(suffix):
                lake = lake.with_table(table_name_of(file_name), read_table(spark, posixpath.join(path, file_name)))
    return lake


def lake_from_catalog(spark: SparkSession, name: str, database: str | None = None) -> Lake:
    """Every table of a catalog database (or every temporary view). Rows of parquet tables are numbered by their place in
    the files, those of other tables and of views by all columns."""
    lake = Lake(name)
    for entry in spark.catalog.listTables(database):
        full = entry.name if entry.isTemporary or not database else f"{database}.{entry.name}"
        df = spark.table(full)
        in_files = entry.tableType in ("MANAGED", "EXTERNAL") and _provider(spark, full) == "parquet"
        lake = lake.with_table(entry.name, rows_of_files(df) if in_files else number_rows(df, df.columns))
    return lake


def _provider(spark: SparkSession, table: str) -> str | None:
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Provider'").first()
    return found["data_type"].lower() if found else None


def catalog(lake: Lake) -> DataFrame:
    """(lake, table_name, n_rows, n_cols, num_cells), one row per table.

    The row counts come from one job over the file footers; the result is a local relation, so
    the planner knows its size in every later join. It is read once per lake object; after a
    change of the files call ``refresh``.
    """
    if "catalog" in lake._known:
        return lake._known["catalog"]
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        for t, df in lake.tables.items()
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    rows = []
    for r in counts.collect():
        n_cols = len(lake.columns(r["table_name"]))
        rows.append((lake.name, r["table_name"], r["n_rows"], n_cols, r["n_rows"] * n_cols))
    schema = "lake string, table_name string, n_rows long, n_cols int, num_cells long"
    lake._known["catalog"] = local_frame(lake.any_session(), rows, schema)
    return lake._known["catalog"]


def refresh(lake: Lake) -> None:
    """Forget the catalog, so that the next use reads it again."""
    lake._known.clear()


def column_catalog(lake: Lake) -> DataFrame:
    """(lake, table_name, col_pos, col_name), one row per column."""
    rows = [(lake.name, t, i, c) for t in lake.tables for i, c in enumerate(lake.columns(t))]
    return local_frame(lake.any_session(), rows, "lake string, table_name string, col_pos int, col_name string")


def catalog_of_cells(cells: DataFrame) -> DataFrame:
    """The catalog of a lake that only exists as cells (dense rows, so the last row id gives the count)."""
    shape = cells.groupBy("lake", "table_name").agg(
        (F.max("row_id") + 1).alias("n_rows"), (F.max("col_pos") + 1).alias("n_cols")
    )
    return shape.withColumn("num_cells", F.col("n_rows") * F.col("n_cols"))


def catalog_of_rows(rows: DataFrame) -> DataFrame:
    """The catalog of a lake that only exists as rows ``(lake, table_name, row_id, names, values)``; neither the ids nor
    the values are worked out for it."""
    shape = rows.groupBy("lake", "table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("names")).alias("n_cols"))
    return shape.withColumn("num_cells", F.col("n_rows") * F.col("n_cols"))


def cells_of_rows(rows: DataFrame) -> DataFrame:
    """Rows ``(lake, table_name, row_id, names, values)`` as cells, in their order; other columns are carried."""
    others = [c for c in rows.columns if c not in (*CELLS, "names", "values")]
    # "outer": else a filter on the size of the values is put before all moves, which works out every value once more
    unrolled = rows.select("lake", "table_name", "row_id", *others, "names", F.posexplode_outer("values").alias("col_pos", "value"))
    return unrolled.filter("col_pos IS NOT NULL").select(
        "lake", "table_name", "row_id", "col_pos", F.element_at("names", F.col("col_pos") + 1).alias("col_name"), "value", *others)


def melt_table(df: DataFrame, lake_name: str, table: str, carried: Sequence[str] = ()) -> DataFrame:
    """One wide table as cells: a projection and an explode, no shuffle. ``carried`` columns are no cells and stay beside them."""
    names = [c for c in df.columns if c != ROW_ID and c not in carried]
    types = {f.name: f.dataType for f in df.schema.fields}
    values = F.array(*[value_text(F.col(c), types[c]) for c in names])
    # a step of its own: values worked out inside of the unrolling would be compiled together with all that follows
    return df.select(ROW_ID, *carried, values.alias("_values")).select(ROW_ID, *carried, F.posexplode("_values").alias("col_pos", "value")).select(
        F.lit(lake_name).alias("lake"),
        F.lit(table).alias("table_name"),
        ROW_ID,
        "col_pos",
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("col_pos") + 1).alias("col_name"),
        "value",
        *carried,
    )


def melt(lake: Lake) -> DataFrame:
    """All tables of a lake in the long form (lake, table_name, row_id, col_pos, col_name, value)."""
    parts = [melt_table(df, lake.name, t) for t, df in lake.tables.items()]
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    return cells


def unmelt(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells of one table back to a wide frame; the column list keeps the pivot to one pass."""
    wide = [F.max(F.when(F.col("col_name") == c, F.col("value"))).alias(c) for c in columns]
    return cells.groupBy("lake", "table_name", "row_id").agg(*wide)


def corpus_to_cells(
    corpus: DataFrame, lake_name: str, table_name: str = "table_name", first_row: str | None = None
) -> DataFrame:
    """Records with ``header ARRAY<STRING>`` and ``rows ARRAY<ARRAY<STRING>>`` as cells.

    A table may be one record, or several that name their ``first_row``.
    """
    start = F.col(first_row) if first_row else F.lit(0)
    rows = corpus.select(
        F.lit(lake_name).alias("lake"),
        F.col(table_name).alias("table_name"),
        "header",
        start.cast("long").alias("_start"),
        F.posexplode("rows").alias("_row", "values"),
    )
    return rows.select(
        "lake",
        "table_name",
        (F.col("_start") + F.col("_row")).alias("row_id"),
        "header",
        F.posexplode("values").alias("col_pos", "value"),
    ).select("lake", "table_name", "row_id", "col_pos", F.element_at("header", F.col("col_pos") + 1).alias("col_name"), "value")


def corpus_catalog(corpus: DataFrame, lake, table_name: str = "table_name") -> DataFrame:
    """The catalog of a corpus, tables without rows or without columns included, which leave no cells behind.

    ``lake`` is a name or a column. A table may be several records; all have its header.
    """
    name = F.lit(lake) if isinstance(lake, str) else lake
    n_rows = F.coalesce(F.size("rows"), F.lit(0))
    sized = corpus.groupBy(name.alias("lake"), F.col(table_name).alias("table_name")).agg(
        F.sum(F.greatest(n_rows, F.lit(0))).alias("n_rows"), F.max(F.greatest(F.coalesce(F.size("header"), F.lit(0)), F.lit(0))).alias("n_cols"))
    return sized.withColumn("num_cells", F.col("n_rows") * F.col("n_cols"))


def composed_name(page_title: str, section_title: str, caption: str):
    """The table name of a corpus record, from its three titles."""
    return F.concat(
        F.lit("page title: "), F.col(page_title), F.lit(", section title: "), F.col(section_title), F.lit(", caption: "), F.col(caption)
    )


def disambiguate_names(tables: DataFrame, name: str, order_by: str, suffix: str) -> DataFrame:
    """The first record of a name keeps it; later ones get ``" <suffix>"``.

    Only the first position per name matters, so a minimum (combined map-side) replaces a window
    over all records of a name. ``order_by`` must be unique.
    """
    first = tables.groupBy(name).agg(F.min(order_by).alias("_first"))
    joined = tables.join(first, name)
    renamed = F.when(F.col(order_by) == F.col("_first"), F.col(name)).otherwise(
        F.concat(F.col(name), F.lit(" "), F.col(suffix).cast("string"))
    )
    return joined.withColumn("table_name", renamed).drop("_first")


def largest_tables(tables: DataFrame, n: int | None, tie: str = "table_name") -> DataFrame:
    """The ``n`` tables with the most cells (all for None); a top-n, not a sort."""
    return tables if n is None else tables.orderBy(F.desc("num_cells"), tie).limit(n)


def drop_lakes_with_empty_table(tables: DataFrame) -> DataFrame:
    empty = tables.filter("num_cells = 0").select("lake").distinct()
    return tables.join(empty, "lake", "left_anti")


def lake_sizes(tables: DataFrame) -> DataFrame:
    return tables.groupBy("lake").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("num_cells").alias("lake_cells"))


def skip_large_lakes(tables: DataFrame, max_cells: int | None) -> DataFrame:
    """Tables of the lakes with at most ``max_cells`` cells."""
    if max_cells is None:
        return tables
    small = lake_sizes(tables).filter(F.col("lake_cells") <= max_cells).select("lake")
    return tables.join(small, "lake", "left_semi")


def remove_tables(frames: Mapping[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Drop tables (by lake, table_name) from the catalog and everything that hangs on them."""
    keys = removed.select("lake", "table_name").distinct()
    return {name: df.join(keys, ["lake", "table_name"], "left_anti") for name, df in frames.items()}


def require_cells(df: DataFrame) -> DataFrame:
    """Fail on a table or tile without cells."""
    checked = F.when(F.col("num_cells") > 0, F.col("num_cells")).otherwise(
        F.raise_error(F.lit("empty table or tile")).cast("long")
    )
    return df.withColumn("num_cells", checked)
