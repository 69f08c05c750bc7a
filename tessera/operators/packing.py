"""Fit ranked tiles into a token budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import csv_field, csv_line_of_array, tile_text, token_count, truncate_tokens, value_text
from tessera.operators.rectangles import TABLE, expand_rows, rows_to_spans
from tessera.session import materialize
from tessera.sources.lake import Lake, column_catalog

QUESTION = ["lake", "gt_name"]
NEAR_END, SECOND = 10, 2


def table_rows(cells: DataFrame) -> DataFrame:
    """Cells as one row per table row: ``names`` and ``values`` in column order (never wider than the table)."""
    packed = cells.groupBy(*TABLE, "row_id").agg(F.array_sort(F.collect_list(F.struct("col_pos", "col_name", "value"))).alias("_c"))
    return packed.select(*TABLE, "row_id", F.col("_c.col_name").alias("names"), F.col("_c.value").alias("values"))


def wide_rows(lake: Lake) -> DataFrame:
    """The same straight from wide tables: a projection, no shuffle."""
    parts = []
    for name, df in lake.tables.items():
        types = {f.name: f.dataType for f in df.schema.fields}
        columns = lake.columns(name)
        parts.append(
            df.select(
                F.lit(lake.name).alias("lake"), F.lit(name).alias("table_name"), "row_id",
                F.array(*[F.lit(c) for c in columns]).alias("names"),
                F.array(*[value_text(F.col(c), types[c]) for c in columns]).alias("values"),
            )
        )
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def csv_headers(lake: Lake) -> DataFrame:
    """The header line of every table, as row -1."""
    named = column_catalog(lake).groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("col_pos", "col_name"))).alias("_c"))
    return named.select(*TABLE, F.lit(-1).cast("long").alias("row_id"), csv_line_of_array(F.col("_c.col_name")).alias("line"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """One CSV line per table row; a table of any size stays spread over the cluster."""
    return rows.select(*TABLE, "row_id", csv_line_of_array(F.col("values")).alias("line"))


def _pick(values: Column, cols: Column) -> Column:
    return F.transform(cols, lambda c: F.element_at(values, c + 1))


def linearize_tiles(spans: DataFrame, rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of cells and text (header, CSV rows) of each tile, whatever its size.

    A text is one value, so a tile must fit into one.
    """
    group = list(dict.fromkeys([*keys, *TABLE, "tile_id"]))
    members = expand_rows(spans.select(*group, "row_lo", "row_hi", "cols"))
    lines = members.join(rows, [*TABLE, "row_id"]).select(
        *group, "row_id", csv_line_of_array(_pick(F.col("names"), F.col("cols"))).alias("header"),
        csv_line_of_array(_pick(F.col("values"), F.col("cols"))).alias("line"))
    text = lines.groupBy(*group).agg(
        F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("row_id", "line"))).alias("_lines")
    )
    csv = F.concat("header", F.lit("\n"), F.array_join(F.col("_lines.line"), "\n"), F.lit("\n"))
    done = text.select(*group, tile_text(F.col("table_name"), csv).alias("text"))
    sizes = spans.groupBy(*group).agg(F.sum((F.col("row_hi") - F.col("row_lo")) * F.size("cols")).alias("num_cells"))
    return sizes.join(done, group, "left")


def running_tokens(ranked: DataFrame) -> DataFrame:
    """Tokens used down the ranking of each question (the ranking is cut to its limit before)."""
    window = Window.partitionBy(*QUESTION).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("running", F.sum("tokens").over(window))


def pack_greedy(ranked: DataFrame, budget: int, second_tile: bool = False) -> DataFrame:
    """Walk each ranking and take every tile that still fits; a tile that does not is passed over.

    ``ranked (lake, gt_name, rank, tile_id, tokens)``, at most the retrieval limit per question. Per question: the ranks
    taken, tokens used, whether one of the last ten candidates fitted, and ``cut``. With ``second_tile``, a second
    candidate that does not fit ends the walk: it is taken, and the text is to be cut at the budget.
    """
    start = F.struct(
        F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ranks"), F.lit(False).alias("cut"))

    def step(state: Column, tile: Column) -> Column:
        fits = state["used"] + tile["tokens"] <= budget
        ends = F.lit(second_tile) & (tile["rank"] == SECOND) & ~fits
        return F.when(state["cut"], state).otherwise(F.struct(
            F.when(fits, state["used"] + tile["tokens"]).when(ends, F.lit(budget).cast("long")).otherwise(state["used"]).alias("used"),
            F.when(fits | ends, F.array_append(state["ranks"], tile["rank"])).otherwise(state["ranks"]).alias("ranks"),
            ends.alias("cut"),
        ))

    item = F.struct(F.col("rank").cast("int").alias("rank"), F.col("tokens").cast("long").alias("tokens"))
    # a tile above the budget never fits, and leaving it out changes nothing for the others
    matters = (F.col("tokens") <= budget) | (F.lit(second_tile) & (F.col("rank") == SECOND))
    lists = ranked.groupBy(*QUESTION).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.array_sort(F.collect_list(F.when(matters, item))).alias("_items"),
        F.max("rank").alias("_last"),
    )
    packed = lists.withColumn("_p", F.aggregate("_items", start, step))
    return packed.select(
        *QUESTION, "n_candidates", F.col("_p.used").alias("used"), F.col("_p.ranks").alias("ranks"),
        _near_end(F.col("_last"), F.col("_p.ranks"), F.col("_p.cut")).alias("near_end"), F.col("_p.cut").alias("cut"),
    )


def _near_end(last: Column, ranks: Column, cut: Column) -> Column:
    return (last - F.coalesce(F.array_max(ranks), F.lit(0)) <= NEAR_END) & ~cut


def picked(packed: DataFrame, ranked: DataFrame) -> DataFrame:
    """The ranked tiles that were taken."""
    return ranked.join(packed.select(*QUESTION, F.explode("ranks").alias("rank")), [*QUESTION, "rank"])


def row_tokens(rows: DataFrame, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """Tokens of every field of a row and of its header as CSV writes it among others (``tokens``, ``header_tokens``:
    none for an empty field) and alone on its line (``lone``, ``header_lone``: an empty field is a pair of quotes)."""
    quotes = count(F.lit('""')).cast("int")
    among = lambda x: count(csv_field(x)).cast("int")
    alone = lambda x: F.when(csv_field(x) == "", quotes).otherwise(among(x))
    return rows.select(
        *TABLE, "row_id", F.transform("values", among).alias("tokens"), F.transform("values", alone).alias("lone"),
        F.transform("names", among).alias("header_tokens"), F.transform("names", alone).alias("header_lone"),
    )


def _line_tokens(tokens: str, lone: str) -> Column:
    """Tokens of one line over ``cols``: fields and commas, or the only field."""
    total = F.aggregate(_pick(F.col(tokens), F.col("cols")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size("cols") == 1, F.element_at(F.col(lone), F.element_at("cols", 1) + 1)).otherwise(total + F.size("cols") - 1)


def _prefix_tokens() -> Column:
    return token_count(tile_text(F.col("table_name"), F.lit("")))


def tile_tokens(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """(lake, table_name, tile_id, tokens): what each tile's text costs, line by line as it is written."""
    tile = [*TABLE, "tile_id"]
    members = materialize(expand_rows(spans.select(*tile, "row_lo", "row_hi", "cols")), "tile-rows")
    lines = members.join(tokens_of(tokens, members), [*TABLE, "row_id"]).select(
        *tile, _line_tokens("tokens", "lone").alias("_line"), _line_tokens("header_tokens", "header_lone").alias("_header"))
    costs = lines.groupBy(*tile).agg((F.sum("_line") + F.max("_header")).alias("_cost"))
    return costs.select(*tile, (F.col("_cost") + _prefix_tokens()).cast("long").alias("tokens"))


def least_tokens(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """(lake, table_name, tile_id, tokens): what any rectangle that holds the tile costs at least.

    That is the tile's own cost, but that an empty field alone on its line costs one comma once a column joins it.
    """
    comma = lambda lone, kept: F.transform(F.arrays_zip(F.col(lone).alias("l"), F.col(kept).alias("t")), lambda x: F.least(x["l"], x["t"] + 1))
    lowered = tokens.select(
        *TABLE, "row_id", "tokens", "header_tokens", comma("lone", "tokens").alias("lone"),
        comma("header_lone", "header_tokens").alias("header_lone"))
    return tile_tokens(spans, lowered)


def _first_rows(spans: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each tile, one span each; ranking stops at ``n`` inside every task."""
    order = Window.partitionBy(*keys).orderBy("row_id")
    numbered = expand_rows(spans).withColumn("_n", F.row_number().over(order))
    return rows_to_spans(numbered.filter(F.col("_n") <= n).drop("_n"))


def contexts(spans: DataFrame, rows: DataFrame, budget: int, order: str, cut: DataFrame | None = None) -> DataFrame:
    """(lake, gt_name, context): the texts of a question's tiles, a blank line between them, in ``order``.

    The tiles of a question were packed into ``budget`` tokens before, which bounds its text. Questions in
    ``cut (lake, gt_name)`` hold a tile that did not fit: their text is cut after ``budget`` tokens, and only as many
    rows of their tiles are written as can matter (a line has a token or more, unless its only field is white space).
    """
    whole = spans
    if cut is not None:
        part = spans.join(cut.select(*QUESTION), QUESTION, "left_semi")
        heads = _first_rows(part, [*QUESTION, *TABLE[1:], "tile_id"], budget + 1)
        whole = heads.unionByName(expanded_to_spans(spans.join(cut.select(*QUESTION), QUESTION, "left_anti")))
    texts = linearize_tiles(whole, rows, QUESTION)
    placed = texts.join(spans.groupBy(*QUESTION, *TABLE[1:], "tile_id").agg(F.min(order).alias("_at")), [*QUESTION, *TABLE[1:], "tile_id"])
    parts = F.array_sort(F.collect_list(F.struct("_at", "tile_id", "text")))
    text = placed.groupBy(*QUESTION).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("context"))
    if cut is None:
        return text
    marked = text.join(cut.select(*QUESTION, F.lit(True).alias("_cut")), QUESTION, "left")
    return marked.select(*QUESTION, F.when(F.col("_cut"), truncate_tokens(F.col("context"), budget)).otherwise(F.col("context")).alias("context"))


def expanded_to_spans(spans: DataFrame) -> DataFrame:
    """The same tiles with one span per row."""
    return rows_to_spans(expand_rows(spans))


def _affordable(spans: DataFrame, budget: int) -> DataFrame:
    """(lake, table_name, tile_id) of tiles whose commas alone do not cost more than the budget.

    A line of n > 1 columns has n - 1 commas, whatever its fields hold, so most tiles of large tables are ruled out by
    their shape, before any text is read.
    """
    shape = spans.groupBy(*TABLE, "tile_id").agg(F.sum(F.col("row_hi") - F.col("row_lo")).alias("_rows"), F.max(F.size("cols")).alias("_cols"))
    return shape.filter((F.col("_rows") + 1) * (F.col("_cols") - 1) <= budget).select(*TABLE, "tile_id")


def tokens_of(tokens: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``tokens`` that are in ``members``; tables without any are passed over. Members are written before, as
    unrolled spans are many times what the planner takes them for, and would be sent to all tasks through the driver."""
    return tokens.join(members.select(*TABLE, "row_id").distinct(), [*TABLE, "row_id"], "left_semi")


def pack_closure(ranked: DataFrame, spans: DataFrame, tokens: DataFrame, budget: int, second_tile: bool = False) -> DataFrame:
    """The same walk, but tiles of one table are merged to their closure before the fit is tested.

    ``ranked (lake, gt_name, rank, tile_id)`` is cut to the retrieval limit, ``spans`` are the tiles, ``tokens`` is
    :func:`row_tokens`. The fit is tested by the cost of the text as it would be written. Candidates whose
    :func:`least_tokens` are above the budget can never fit and are left out before, so a question holds at most
    (limit x budget) lines, whatever the table sizes (lines whose only field is white space cost nothing and come on top).
    """
    asked = spans.join(ranked.select("lake", "tile_id").distinct(), ["lake", "tile_id"], "left_semi")
    possible = asked.join(_affordable(asked, budget), [*TABLE, "tile_id"], "left_semi")
    small = materialize(least_tokens(possible, tokens).filter(F.col("tokens") <= budget).select(*TABLE, "tile_id"), "small")
    last = ranked.groupBy(*QUESTION).agg(F.max("rank").alias("_last"))
    candidates = ranked.select(*QUESTION, "rank", "tile_id").join(last, QUESTION).join(
        spans.join(small, [*TABLE, "tile_id"], "left_semi").select(*TABLE, "tile_id", "row_lo", "row_hi", "cols"), ["lake", "tile_id"])
    members = materialize(expand_rows(candidates), "members")
    needed = members.select(*QUESTION, "table_name", "row_id").distinct().join(tokens_of(tokens, members), [*TABLE, "row_id"])
    needed = needed.select(
        *QUESTION, "table_name", "row_id", "tokens", "lone", "header_tokens", "header_lone", _prefix_tokens().alias("prefix"))

    def walk(tiles: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _walk_closure(tiles, rows, budget, second_tile)

    schema = "lake string, gt_name string, used long, ranks array<int>, cut boolean, n_tables int, n_cells long"
    needed = needed.toDF(*needed.columns)  # fresh column identities: both sides come from the candidates
    packed = members.groupBy(*QUESTION).cogroup(needed.groupBy(*QUESTION)).applyInPandas(walk, schema)
    # a question none of whose tiles can fit still gets its result: nothing, or the second tile
    known = ranked.groupBy(*QUESTION).agg(F.count(F.lit(1)).alias("n_candidates"), F.max("rank").alias("_last"))
    nothing = F.array().cast("array<int>")
    found = known.join(packed, QUESTION, "left").withColumn(
        "cut", F.coalesce("cut", F.lit(False)) | (F.lit(second_tile) & F.col("ranks").isNull() & (F.col("_last") >= SECOND)))
    ranks = F.coalesce("ranks", F.when(F.col("cut"), F.array(F.lit(SECOND))).otherwise(nothing))
    return found.withColumn("ranks", ranks).select(
        *QUESTION, "n_candidates", F.when(F.col("cut"), F.lit(budget).cast("long")).otherwise(F.coalesce("used", F.lit(0).cast("long"))).alias("used"),
        "ranks", _near_end(F.col("_last"), F.col("ranks"), F.col("cut")).alias("near_end"), "cut",
        F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.coalesce("n_cells", F.lit(0).cast("long")).alias("n_cells"),
    )


class _Rectangle:
    """Rows and columns of one table taken so far. The header is one more row, taken with the first tile.

    ``row_sums`` holds the tokens of every row over the columns taken and ``col_sums`` those of every column over the
    rows taken, so a candidate is charged by its new cells only.
    """

    def __init__(self, rows: pd.DataFrame):
        first = rows.iloc[0]
        self.number = {row: k for k, row in enumerate(rows["row_id"])}
        self.tokens = np.stack([*rows["tokens"], first["header_tokens"]]).astype(np.int64)
        self.lone = np.stack([*rows["lone"], first["header_lone"]]).astype(np.int64)
        self.prefix = int(first["prefix"])
        n, m = self.tokens.shape
        self.rows, self.cols = np.zeros(n, bool), np.zeros(m, bool)
        self.row_sums, self.col_sums, self.total, self.cost = np.zeros(n, np.int64), np.zeros(m, np.int64), 0, 0

    def with_tile(self, row_ids, cols) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Cost and sum of tokens once the tile is in, and the rows and columns that are new."""
        rows = np.array([self.number[r] for r in row_ids] + [len(self.rows) - 1])
        cols = np.asarray(cols, np.int64)
        rows, cols = rows[~self.rows[rows]], cols[~self.cols[cols]]
        total = self.total + int(self.row_sums[rows].sum() + self.col_sums[cols].sum() + self.tokens[np.ix_(rows, cols)].sum())
        n_rows, n_cols = int(self.rows.sum()) + len(rows), int(self.cols.sum()) + len(cols)
        if n_cols > 1:
            return self.prefix + total + n_rows * (n_cols - 1), total, rows, cols
        only = cols[0] if len(cols) else int(np.flatnonzero(self.cols)[0])
        return self.prefix + int(self.lone[self.rows, only].sum() + self.lone[rows, only].sum()), total, rows, cols

    def take(self, cost: int, total: int, rows: np.ndarray, cols: np.ndarray) -> None:
        self.row_sums += self.tokens[:, cols].sum(axis=1)
        self.col_sums += self.tokens[rows].sum(axis=0)
        self.rows[rows], self.cols[cols] = True, True
        self.cost, self.total = cost, total


def _walk_closure(tiles: pd.DataFrame, rows: pd.DataFrame, budget: int, second_tile: bool) -> pd.DataFrame:
    tables = {table: _Rectangle(part.drop_duplicates("row_id")) for table, part in rows.groupby("table_name")}
    ranks, used, cut, taken = [], 0, False, set()
    for rank_no, group in tiles.sort_values("rank", kind="stable").groupby("rank", sort=True):
        if second_tile and rank_no > SECOND and not taken & {SECOND}:
            break  # the second candidate was left out before: it ends the walk
        table = tables[group["table_name"].iloc[0]]
        cost, *rest = table.with_tile(group["row_id"], group["cols"].iloc[0])
        if used - table.cost + cost <= budget:
            used += cost - table.cost
            table.take(cost, *rest)
            ranks.append(int(rank_no))
            taken.add(int(rank_no))
        elif second_tile and rank_no == SECOND:
            break
    first = tiles.iloc[0] if len(tiles) else rows.iloc[0]
    if second_tile and SECOND not in taken and int(first["_last"]) >= SECOND:
        ranks, used, cut = [r for r in ranks if r < SECOND] + [SECOND], budget, True
    held = [t for t in tables.values() if t.cost]
    cells = sum((int(t.rows.sum()) - 1) * int(t.cols.sum()) for t in held)
    return pd.DataFrame(
        {"lake": [first["lake"]], "gt_name": [first["gt_name"]], "used": [used], "ranks": [ranks], "cut": [cut],
         "n_tables": [len(held)], "n_cells": [cells]}
    )
