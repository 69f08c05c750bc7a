"""Tables that come as rows: numbered, embedded and split in the task that gets them, like the paths over cells."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import hashed_text, l2_normalize
from tessera.operators import divisive, packing
from tessera.operators.embedding import Embedder, embed_rows, embed_table
from tessera.operators.positions import dense_positions, group_positions
from tessera.sources.lake import catalog_of_rows, cells_of_rows

DIM = 4
EMBEDDER = Embedder(model=hashed_text(DIM), dim=DIM)
NAMES = ["a_x", "b", "c-y"]


def embed(rows):
    return embed_rows(rows, EMBEDDER, NAMES)


@pytest.fixture(scope="module")
def rows(spark):
    held = [("l", f"t{t}", r, NAMES, [f"{t * 7 + r}", None if r % 5 == 3 else f"v{(r * r + t) % 4}", "same"]) for t in range(4) for r in range(1 + 2 * t)]
    return spark.createDataFrame(held, "lake string, table_name string, row_id long, names array<string>, values array<string>").repartition(5)


def same(a, b):
    plain = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    return plain(a.select(*sorted(a.columns))) == plain(b.select(*sorted(a.columns)))


def frontier(rows):
    vectors = embed_table(cells_of_rows(rows), "table-cells", EMBEDDER)
    return vectors.select("lake", "table_name", F.lit("r").alias("node"), "row_id", "col_pos", l2_normalize(F.col("vec")).alias("vec"))


@pytest.mark.parametrize("small_cells", [12, 10_000])
def test_whole_tables_like_the_path_over_cells(rows, small_cells):
    means = divisive.member_means(frontier(rows), DIM)
    vector = lambda df: df.select("table_name", "axis", "member", *[F.col("vec")[i].alias(f"v{i}") for i in range(DIM)])
    assert same(vector(divisive.table_means(rows, embed, DIM, small_cells)), vector(means))
    rule = divisive.SplitRule(row_penalty_base=10.0, col_penalty_base=2.0)
    spread = divisive.axis_spread(means, rule)
    nodes = divisive.split_priority(spread, rule)
    assert same(divisive.table_priority(rows, embed, DIM, rule, small_cells), nodes)
    split = divisive.split_members(nodes.filter("n >= 2"), spread, means, rule, DIM)
    assert same(divisive.table_splits(rows, embed, DIM, rule, small_cells), split)


@pytest.mark.parametrize("k", [2, 3])
def test_all_at_once_like_best_first(k):
    """Where the budget allows every split, the order of splits changes nothing."""
    rng = np.random.default_rng(k)
    cells = [("l", f"t{t}", r, c, rng.integers(-3, 3, size=4).astype(float)) for t, (n, m) in enumerate([(1, 1), (1, 5), (6, 2), (4, 3), (4, 3)])
             for r in range(n) for c in range(m)]
    columns = dict(zip(("lake", "table_name", "row_id", "col_pos", "vec"), map(list, zip(*cells)), strict=True))
    held = divisive._Tables(pa.table({**columns, "max_splits": np.full(len(cells), 100)}), divisive.SplitRule(clusters_per_step=k))
    found = lambda tiles: sorted(
        (t, node, *map(tuple, (rows, cols))) for x in tiles
        for t, node, rows, cols in zip(x.table.tolist(), x.node.to_pylist(), *(m.tolist() for m in held.members(x)), strict=True))
    every = np.arange(5)
    assert found(held.split_freely(every)) == found(held.split_best_first(every))


def test_buckets_end_between_tables(rows, monkeypatch):
    """The tiles do not depend on how many tables a task holds."""
    tables = catalog_of_rows(rows)
    budgets = tables.select("lake", "table_name", F.lit(4).cast("long").alias("budget"))
    whole = divisive.divisive_tiles(tables, rows, budgets, embed, DIM).collect()
    monkeypatch.setattr(divisive, "BUCKET_CELLS", 1)
    assert sorted(divisive.divisive_tiles(tables, rows, budgets, embed, DIM).collect()) == sorted(whole)


def test_no_cells_are_written_for_small_tables(rows, monkeypatch):
    written, plain = [], divisive.materialize
    monkeypatch.setattr(divisive, "materialize", lambda df, name: written.append(name) or plain(df, name))
    tables = catalog_of_rows(rows)
    budgets = tables.select("lake", "table_name", F.lit(9).cast("long").alias("budget"))
    divisive.divisive_tiles(tables, rows, budgets, embed, DIM).count()
    divisive.table_priority(rows, embed, DIM, divisive.SplitRule()).count()
    assert set(written) == {"large-tables"}


@pytest.mark.parametrize("most", [0, 3, 100])
def test_positions_in_small_and_large_groups(spark, most):
    rows = spark.createDataFrame([(None if g == 4 else g, (i * 7) % 11) for g in range(6) for i in range(g + 1)], "g int, x int")
    assert same(group_positions(rows, ["x"], ["g"], "at", most), dense_positions(rows, ["x"], ["g"], "at"))


def test_text_of_tiles_from_rows(spark):
    rows = spark.createDataFrame([("l", "t", 0, ["a", "b,c"], ["1", None]), ("l", "t", 1, ["a", "b,c"], ['x"y', "p,q"])],
                                 "lake string, table_name string, row_id long, names array<string>, values array<string>")
    spans = spark.createDataFrame([("l", "t", "t/0", 0, 2, [0, 1])], "lake string, table_name string, tile_id string, row_lo long, row_hi long, cols array<int>")
    text = packing.linearize_tiles(spans, rows).first()["text"]
    assert text == 'table: "t"\n\na,"b,c"\n1,\n"x""y","p,q"\n\n'
