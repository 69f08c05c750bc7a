"""Ground-truth tiles: which rows and columns a question's query reads.

A query is given as blocks, one per SELECT: its table, its WHERE predicate and the columns it
mentions. Projection, grouping, ordering and limits of the query do not matter for provenance.
Predicates are Spark SQL; ``{name}`` stands for a table of the lake, which allows subqueries. All other braces are
text.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.positions import dense_positions
from tessera.operators.rectangles import rows_to_spans
from tessera.session import local_frame
from tessera.sources.ground_truth import GT_PREFIX
from tessera.sources.lake import Lake
from tessera.sources.tables import ROW_ID


@dataclass(frozen=True)
class Block:
    """One SELECT of a ground-truth query."""

    gt_name: str
    table: str
    predicate: str
    columns: tuple[str, ...]


def _tables(lake: Lake, text: str) -> dict[str, DataFrame]:
    return {name: df for name, df in lake.tables.items() if "{" + name + "}" in text}


def has_subquery(lake: Lake, block: Block) -> bool:
    return bool(_tables(lake, block.predicate))


def _query(lake: Lake, text: str) -> DataFrame:
    """Run a query in which ``{name}`` stands for a table of the lake and any other brace for itself."""
    tables = _tables(lake, text)
    escaped = text.replace("{", "{{").replace("}", "}}")
    for name in tables:
        escaped = escaped.replace("{{" + name + "}}", "{" + name + "}")
    return lake.any_session().sql(escaped, **tables)


def provenance_rows(lake: Lake, blocks: Sequence[Block]) -> DataFrame:
    """(lake, gt_name, table_name, row_id), every row once per ground truth.

    All plain predicates of a table are tested in one scan of that table; a predicate with a
    subquery gets its own filter, which the optimizer turns into a semi-join. Rows are shuffled only
    for ground truths that read a table through more than one such part.
    """
    parts = []
    sources: list[tuple[str, str]] = []  # (ground truth, table) of every part
    plain: dict[str, list[Block]] = {}
    for block in blocks:
        if has_subquery(lake, block):
            part = _query(lake, "SELECT row_id FROM {" + block.table + "} WHERE " + block.predicate)
            parts.append(part.select(F.lit(block.gt_name).alias("gt_name"), F.lit(block.table).alias("table_name"), ROW_ID))
            sources.append((block.gt_name, block.table))
        else:
            plain.setdefault(block.table, []).append(block)
    for table, group in plain.items():
        hits = F.array(*[F.when(F.expr(b.predicate), F.lit(b.gt_name)) for b in group])
        any_hit = " OR ".join(f"({b.predicate})" for b in group)
        names = F.array_distinct(F.array_compact(hits))  # several blocks of one ground truth: the row counts once
        part = lake.tables[table].filter(any_hit).select(ROW_ID, F.explode(names).alias("gt_name"))
        sources += [(gt, table) for gt in {b.gt_name for b in group}]
        parts.append(part.select("gt_name", F.lit(table).alias("table_name"), ROW_ID))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    repeated = sorted({s for s in sources if sources.count(s) > 1})
    if repeated:
        twice = F.struct("gt_name", "table_name").isin([F.struct(F.lit(g), F.lit(t)) for g, t in repeated])
        united = united.filter(~twice).unionByName(united.filter(twice).distinct())
    return united.select(F.lit(lake.name).alias("lake"), "gt_name", "table_name", ROW_ID)


def provenance_columns(lake: Lake, blocks: Sequence[Block]) -> DataFrame:
    """(lake, gt_name, table_name, cols): union of the mentioned columns in table order; ``*`` means all."""
    found: dict[tuple[str, str], set[int]] = {}
    for block in blocks:
        names = lake.columns(block.table)
        mentioned = names if "*" in block.columns else block.columns
        found.setdefault((block.gt_name, block.table), set()).update(names.index(c) for c in mentioned)
    rows = [(lake.name, gt, table, sorted(cols)) for (gt, table), cols in found.items()]
    return local_frame(lake.any_session(), rows, "lake string, gt_name string, table_name string, cols array<int>")


def ground_truth_tiles(lake: Lake, blocks: Sequence[Block]) -> DataFrame:
    """One tile per (ground truth, table) as a span frame with ``gt_name`` and ``kind``."""
    rows = provenance_rows(lake, blocks)
    cols = provenance_columns(lake, blocks)
    spans = rows_to_spans(rows.join(cols, ["lake", "gt_name", "table_name"]))
    return spans.withColumn("kind", F.concat(F.lit(GT_PREFIX), F.col("gt_name"))).withColumn(
        "tile_id", F.concat_ws("/", "kind", "table_name")
    )


def answer_table(lake: Lake, answers: dict[str, str], ordered: Collection[str] = ()) -> DataFrame:
    """Answers of the original queries, in long form: (gt_name, col_pos, col_name, pos, value).

    Answers named in ``ordered`` keep the order of their query, which then should have an ORDER BY; the rows of all
    others are numbered in the order of their columns.
    """
    parts = []
    for gt_name, query in answers.items():
        answer = _query(lake, query)
        if gt_name in ordered:
            # partitions of a sorted result follow each other, so arrival is the query's order
            numbered = dense_positions(answer.withColumn("_at", F.monotonically_increasing_id()), ["_at"], out="pos").drop("_at")
        else:
            numbered = dense_positions(answer, answer.columns, out="pos")
        values = F.array(*[F.col(c).cast("string") for c in answer.columns])
        names = F.array(*[F.lit(c) for c in answer.columns])
        parts.append(
            numbered.select(F.lit(gt_name).alias("gt_name"), "pos", F.posexplode(values).alias("col_pos", "value")).select(
                "gt_name", "col_pos", F.element_at(names, F.col("col_pos") + 1).alias("col_name"), "pos", "value"
            )
        )
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def answer_maps(answers: DataFrame) -> DataFrame:
    """``answer_table`` in map form: (gt_name, answer_table ``MAP<column name, ARRAY<value>>``), columns in query order.

    Of columns with one name the first is kept. An answer is one value here, as it is in a request.
    """
    columns = answers.groupBy("gt_name", "col_pos", "col_name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_rows"))
    listed = columns.groupBy("gt_name").agg(F.array_sort(F.collect_list(F.struct("col_pos", "col_name", "_rows"))).alias("_c"))
    names = F.transform("_c", lambda c: c["col_name"])
    first = F.filter("_c", lambda c, i: F.array_position(names, c["col_name"]) == i + 1)
    entries = F.transform(first, lambda c: F.struct(c["col_name"], F.transform(c["_rows"], lambda r: r["value"])))
    return listed.select("gt_name", F.map_from_entries(entries).alias("answer_table"))


def first_failing_check(checks: Sequence[tuple[str, str]]):
    """Name of the first check (reason, SQL condition) that holds, null if the ground truth is usable."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(checks):
        reason = F.when(F.expr(condition), F.lit(name)).otherwise(reason)
    return reason


def count_reasons(df: DataFrame, reason: str = "skip_reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
