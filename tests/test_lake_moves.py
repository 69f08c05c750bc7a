"""Bounded retrieval, shuffled lakes, corpora with empty tables, versions of a lake, answers, cached responses, costly texts."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import hashed_text
from tessera.operators import embedding, provenance, requests, retrieval, tiles
from tessera.operators.rectangles import expand_rows
from tessera.sources import lake as lakes, stages


def lake_of(spark, n=40):
    a = spark.range(n).select(F.col("id").alias("row_id"), *[F.concat(F.lit(f"a{c}-"), "id").alias(f"a{c}") for c in range(4)])
    b = spark.range(3).select(F.col("id").alias("row_id"), F.concat(F.lit("b-"), "id").alias("b0"))
    return lakes.Lake("l", {"a": a, "b": b})


def spans_of(spark):
    return spark.createDataFrame(
        [("l", "a", "t1", 3, 17, [1, 3], "x"), ("l", "a", "t1", 20, 22, [1, 3], "x"), ("l", "a", "t2", 0, 40, [0], "y"), ("l", "b", "t3", 1, 2, [0], "z")],
        "lake string, table_name string, tile_id string, row_lo long, row_hi long, cols array<int>, kind string")


def values_in(cells, spans):
    rows = expand_rows(spans.select("lake", "table_name", "tile_id", "row_lo", "row_hi", "cols"))
    found = rows.join(cells, ["lake", "table_name", "row_id"]).filter(F.array_contains("cols", F.col("col_pos")))
    return sorted((r["tile_id"], r["value"]) for r in found.collect())


@pytest.mark.parametrize("block", [65_536, 4])
def test_truths_are_found_again_in_a_shuffled_lake(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "RUN_BLOCK", block)
    lake, spans = lake_of(spark), spans_of(spark)
    cells = lakes.melt(lake)
    rows, cols = tiles.shuffle_maps(lakes.catalog(lake), 5)
    moved, moved_spans = tiles.shuffle_cells(cells, rows, cols), tiles.shuffle_spans(spans, rows, cols)
    assert moved_spans.columns == spans.columns
    assert values_in(moved, moved_spans) == values_in(cells, spans)
    assert {tuple(r) for r in moved.select("row_id", "col_pos", "value").collect()} != {tuple(r) for r in cells.select("row_id", "col_pos", "value").collect()}
    orders = {t: [r["new_col"] for r in cols.filter(F.col("table_name") == t).orderBy("col_pos").collect()] for t in ("a", "b")}
    assert sorted(orders["a"]) == [0, 1, 2, 3] and orders["b"] == [0]
    whole = moved_spans.filter("tile_id = 't2'").collect()
    assert len(whole) == (1 if block > 40 else 10) and sum(r["row_hi"] - r["row_lo"] for r in whole) == 40
    back = tiles.shuffle_cells(moved, tiles.inverse_map(rows), tiles.inverse_map(cols))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_empty_corpus_tables_are_in_the_catalog(spark):
    schema = "db string, name string, header array<string>, rows array<array<string>>"
    corpus = spark.createDataFrame(
        [("p", "t1", ["a", "b"], [["1", "2"], ["3", "4"]]), ("p", "t1", ["a", "b"], [["5", "6"]]), ("p", "t2", ["a"], []),
         ("q", "t3", ["a"], [["1"]]), ("r", "t4", ["a", "b"], None), ("s", "t5", None, [[]])], schema)
    tables = lakes.corpus_catalog(corpus, F.col("db"), "name")
    got = {(r["lake"], r["table_name"]): (r["n_rows"], r["n_cols"], r["num_cells"]) for r in tables.collect()}
    assert got == {("p", "t1"): (3, 2, 6), ("p", "t2"): (0, 1, 0), ("q", "t3"): (1, 1, 1), ("r", "t4"): (0, 2, 0), ("s", "t5"): (1, 0, 0)}
    assert {r["lake"] for r in lakes.drop_lakes_with_empty_table(tables).collect()} == {"q"}
    assert {r["lake"] for r in lakes.corpus_catalog(corpus, "one", "name").collect()} == {"one"}


def test_versions_of_a_lake(spark, tmp_path):
    root = str(tmp_path / "lake")
    with pytest.raises(FileNotFoundError):
        stages.load_version(spark, root)
    lake, spans = lake_of(spark), spans_of(spark)
    first = stages.save_version({"cells": lakes.melt(lake), "tiles": spans, "none": spans.limit(0)}, root)
    read = stages.load_version(spark, root)
    assert sorted(map(tuple, read["tiles"].collect())) == sorted(map(tuple, spans.collect()))
    assert read["cells"].schema.simpleString() == lakes.melt(lake).schema.simpleString() and read["none"].count() == 0
    second = stages.save_version({"tiles": spans.filter("tile_id = 't3'")}, root)
    assert set(stages.load_version(spark, root)) == {"tiles"} and stages.load_version(spark, root)["tiles"].count() == 1
    assert stages.load_version(spark, root, first)["tiles"].count() == 4
    (tmp_path / "lake" / "manifests" / second / "_SUCCESS").unlink()  # a write that broke off
    assert set(stages.load_version(spark, root)) == {"cells", "tiles", "none"}


def test_answers_as_maps(spark):
    lake = lakes.Lake("l", {"t": spark.createDataFrame([(0, "x,y", 2), (1, None, 1)], "row_id long, n string, v int")})
    long = provenance.answer_table(lake, {"q": "SELECT v, n, v AS v2 FROM {t}", "p": "SELECT n FROM {t} WHERE v > 5"}, [])
    got = {r["gt_name"]: r["answer_table"] for r in provenance.answer_maps(long).collect()}
    assert got == {"q": {"v": ["1", "2"], "n": [None, "x,y"], "v2": ["1", "2"]}}
    assert provenance.answer_maps(long).select(F.map_keys("answer_table")).first()[0] == ["v", "n", "v2"]


def test_newest_entries(spark):
    cache = spark.createDataFrame([(t, f"h{k}", "r" * 10) for k, t in enumerate([5, 3, 9, 9, 1])], "ts long, request_hash string, response string")
    assert {r["request_hash"] for r in requests.retain_cache(cache, 3).collect()} == {"h0", "h2", "h3"}
    assert requests.retain_cache(cache, 1).first()["request_hash"] == "h3"
    assert requests.retain_cache(cache, 99).count() == 5 and requests.retain_cache(cache.limit(0), 2).count() == 0


def test_predictions_from_responses(spark):
    df = spark.createDataFrame([('{"choices":[{"message":{"content":"```csv\\n\\"a\\"\\n1\\n```"}}]}',), ('{"error":1}',), (None,)], "response string")
    assert [r[0] for r in df.select(requests.prediction(F.col("response"))).collect()] == ['```csv\n"a"\n1\n```', None, None]
    assert [r[0] for r in df.select(requests.prediction(F.col("response"), "table")).collect()] == ["a\n1\n", None, None]


def test_names_are_embedded_per_column(spark):
    lake = lake_of(spark)
    embedder = embedding.Embedder(model=hashed_text(4), dim=4)
    names = embedding.name_vectors(lake, embedder)
    for component in embedding.TABLE_KEYS:
        plain = embedding.embed_table(lakes.melt(lake), component, embedder)
        assert sorted(map(str, plain.collect())) == sorted(map(str, embedding.embed_table(lakes.melt(lake), component, embedder, names).select(plain.columns).collect()))
    costly = embedding.Embedder(model=hashed_text(4), dim=4, costly=True)
    texts = spark.createDataFrame([("x",), ("x",), (None,), ("",), ("y",)], "t string")
    got = sorted((str(r["t"]), r["v"]) for r in embedding.embed_texts(texts, F.col("t"), "v", costly).collect() if r["t"] is not None)
    assert got == sorted((str(r["t"]), r["v"]) for r in embedding.embed_texts(texts, F.col("t"), "v", embedder).collect() if r["t"] is not None)


@pytest.mark.parametrize("metric", [retrieval.COSINE, retrieval.INNER_PRODUCT])
@pytest.mark.parametrize("misled", [False, True])
def test_bounded_retrieval_equals_all_distances(spark, monkeypatch, metric, misled):
    """With a bound from a sample, and with a sample of other questions that rules out too much."""
    import numpy as np

    monkeypatch.setattr(retrieval, "TILES_PER_BLOCK", 64)
    rng = np.random.default_rng(2)
    vectors = [("l", f"t{i:04d}", rng.normal(size=4).round(2).tolist()) for i in range(900)] + [("m", f"t{i}", rng.normal(size=4).tolist()) for i in range(9)]
    tiles_df = spark.createDataFrame(vectors, "lake string, tile_id string, vec array<double>")
    asked = spark.createDataFrame([(lake, f"q{i}", rng.normal(size=4).tolist()) for lake in "lm" for i in range(6)], "lake string, gt_name string, vec array<double>")
    if misled:
        true_bounds = retrieval._with_bounds
        monkeypatch.setattr(retrieval, "_with_bounds", lambda *a: true_bounds(*a).withColumn("bound", F.when(F.col("gt_name") < "q3", F.col("bound") - 5).otherwise(F.col("bound"))))
    handed = retrieval._best(asked, tiles_df, metric, 20, None).filter("tile_id IS NOT NULL")
    if not misled:
        assert handed.filter("lake = 'l'").count() < 6 * 15 * 20 / 2  # half of what 15 blocks hand on without a bound
    got = sorted(map(tuple, retrieval.retrieve(asked, tiles_df, metric, 20).select("lake", "gt_name", "tile_id", "rank").collect()))
    every = retrieval.rank(retrieval.retrieve(asked, tiles_df, metric, None), 20)
    assert got == sorted(map(tuple, every.select("lake", "gt_name", "tile_id", "rank").collect()))


def test_questions_that_name_their_table(spark, tmp_path):
    from tessera.sources.ground_truth import load_table_questions

    (tmp_path / "q.json").write_text('{"original_table_id":"a","question":"q0","sql":"s","answer":["x","y"]}\n{"original_table_id":"gone","question":"q1","sql":"s","answer":[]}\n'
                                     '{"original_table_id":"b","question":"q2","sql":"s","answer":null}\n')
    tables = spark.createDataFrame([("a", "l", "t a"), ("b", "l", "t b")], "original_table_id string, lake string, table_name string")
    rows = {r["gt_name"]: r for r in load_table_questions(spark, {"val": str(tmp_path / "q.json")}, tables).collect()}
    assert set(rows) == {"ground-truth-0", "ground-truth-2"}
    assert (rows["ground-truth-0"]["table_name"], rows["ground-truth-0"]["answer_list"], rows["ground-truth-2"]["answer_list"]) == ("t a", ["x", "y"], None)
    assert '"question":"q2"' in rows["ground-truth-2"]["data"]


def test_empty_tables_fail_and_counters_are_kept(spark, tmp_path):
    from tessera.workflows import AnswerConfig, DivisiveSlicer, GridSlicer, slice_lake

    lake = lakes.Lake("l", {"t": spark.range(0).select(F.col("id").alias("row_id"), F.lit("x").alias("c"))})
    for slicer in (GridSlicer(), DivisiveSlicer()):
        with pytest.raises(Exception, match="empty table"):
            slice_lake(lake, AnswerConfig(slicer=slicer)).spans.collect()
    counted = provenance.count_reasons(spark.createDataFrame([("a",), ("a",), (None,)], "skip_reason string"))
    stages.save_statistics(counted, str(tmp_path / "stats"))
    assert {(r["skip_reason"], r["n"]) for r in spark.read.json(str(tmp_path / "stats")).collect()} == {("a", 2), (None, 1)}


def test_rows_meet_their_places_before_they_are_cells(spark):
    """Cells at new places equal cells joined to them one by one, and rows are not unrolled before the join."""
    from pyspark.sql import functions as F
    from tessera.operators.tiles import cells_at
    from tessera.sources.lake import Lake, melt

    a = spark.createDataFrame([(i, f"a{i}", None if i % 3 else 1.5 * i) for i in range(9)], "row_id long, _new_row string, y double")
    b = spark.createDataFrame([(i, i * i) for i in range(4)], "row_id long, _at_row int")
    lake = Lake("l", {"a": a, "b": b})
    rows = spark.createDataFrame([("l", t, i, n - 1 - i) for t, n in (("a", 9), ("b", 4)) for i in range(n)], "lake string, table_name string, row_id long, new_row long")
    cols = spark.createDataFrame([("l", "a", 0, 1), ("l", "a", 1, 0), ("l", "b", 0, 0)], "lake string, table_name string, col_pos int, new_col long")
    moved = cells_at(lake, rows, cols)
    want = melt(lake).join(rows, ["lake", "table_name", "row_id"]).join(cols, ["lake", "table_name", "col_pos"]).select(*moved.columns)
    assert sorted(map(str, moved.collect())) == sorted(map(str, want.collect())) and want.count() == 22
    plan = [line.strip(" +-:") for line in moved._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    assert sum(line.startswith("Generate") for line in plan) == 2
    for i, line in enumerate(plan):
        if line.startswith("Generate"):
            assert next(x for x in plan[i + 1:] if x.startswith(("Join", "Union", "Generate"))).startswith("Join")
