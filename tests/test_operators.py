"""Scale paths forced on small data, streaming, stages and packing against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import packing, provenance, requests, retrieval, tiles
from tessera.operators.positions import dense_positions
from tessera.plans.corpus import BLOCKS, star_lake
from tessera.session import local_frame, materialize
from tessera.sources import lake as lakes, stages
from tessera.sources.ground_truth import load_ground_truths
from tessera.sources.lake import catalog
from tessera.sources.tables import read_table
from tessera.streaming.rates import start_rate_stream, windowed_rate

SF = "/root/testdata/sf0.001"


def test_distributed_positions_equal_the_window(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(v), i) for i, (g, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 400), rng.integers(0, 50, 400)))]
    df = spark.createDataFrame(rows, "g long, v long, i long")
    small = dense_positions(df, ["v", "i"], ["g"])
    large = dense_positions(df, ["v", "i"], ["g"])
    key = lambda d: sorted((r["i"], r["row_id"]) for r in d.collect())
    assert key(small) == key(large)
    total = dense_positions(df, ["v"])  # ties: any order, but dense and sorted
    got = sorted((r["row_id"], r["v"]) for r in total.collect())
    assert [p for p, _ in got] == list(range(400)) and [v for _, v in got] == sorted(v for _, v, _ in rows)


def test_row_ids_follow_file_order(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 1000, 1, 5).withColumn("x", F.col("id") * 2).write.parquet(path)
    df = read_table(spark, path)
    assert [r["id"] for r in df.orderBy("row_id").collect()] == list(range(1000))
    csv = str(tmp_path / "t.csv")
    spark.range(0, 500, 1, 3).withColumn("x", F.lit('a,"b')).write.option("header", True).option("escape", '"').csv(csv)
    rows = read_table(spark, csv).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(500)) and [r["id"] for r in rows] == list(range(500)) and rows[0]["x"] == 'a,"b'
    with pytest.raises(TypeError):
        read_table(spark, "t.xls")


def test_lake_from_directory(spark, tmp_path):
    spark.range(3).toPandas().to_parquet(tmp_path / "b.parquet")
    spark.range(2).toPandas().to_csv(tmp_path / "a.csv", index=False)
    lake = lakes.lake_from_directory(spark, "dir", str(tmp_path))
    assert list(lake.tables) == ["b", "a"]
    assert {r["table_name"]: r["n_rows"] for r in lakes.catalog(lake).collect()} == {"b": 3, "a": 2}


def test_ground_truths_from_json(spark, tmp_path):
    (tmp_path / "dev.json").write_text('{"db_id":"d","question":"q0","query":"s"}\n{"db_id":"d","question":"q1","query":"s"}\n')
    rows = load_ground_truths(spark, {"test": str(tmp_path / "dev.json")}).orderBy("gt_name").collect()
    assert [(r["gt_name"], r["partition"], r["information_need"]) for r in rows] == [("ground-truth-0", "test", "q0"), ("ground-truth-1", "test", "q1")]


def test_stage_is_computed_once_and_keyed_by_config(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("007", 1)], "lake string, x int")

    a = stages.stage_path(str(tmp_path), "sliced", {"tpt": 1})
    assert a != stages.stage_path(str(tmp_path), "sliced", {"tpt": 2})
    for _ in range(2):
        assert stages.read_or_compute(spark, a, compute).collect()[0]["lake"] == "007"
    assert len(calls) == 1


def test_blocked_retrieval_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUESTIONS_PER_BLOCK", 3)
    monkeypatch.setattr(retrieval, "TILES_PER_BLOCK", 7)
    rng = np.random.default_rng(2)
    q, t = rng.normal(size=(8, 5)), rng.normal(size=(60, 5))
    questions = spark.createDataFrame([("l", f"q{i}", v.tolist()) for i, v in enumerate(q)], "lake string, gt_name string, vec array<double>")
    tile = spark.createDataFrame([("l", f"t{i:02}", v.tolist()) for i, v in enumerate(t)], "lake string, tile_id string, vec array<double>")
    dist = 1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (t / np.linalg.norm(t, axis=1)[:, None]).T
    got = {(r["gt_name"], r["rank"]): r["tile_id"] for r in retrieval.retrieve(questions, tile, k=10).collect()}
    for i in range(8):
        for rank, j in enumerate(np.argsort(dist[i])[:10]):
            assert got[(f"q{i}", rank + 1)] == f"t{j:02}"
    assert retrieval.retrieve(questions, tile, k=None).count() == 480
    ip = q @ t.T
    rel = 1 - ((ip - ip.mean(axis=1)[:, None]) / np.abs(ip - ip.mean(axis=1)[:, None]).max(axis=1)[:, None] / 2 + 0.5)
    for r in retrieval.retrieve(questions, tile, retrieval.INNER_PRODUCT, k=None).collect():
        assert abs(r["distance"] - rel[int(r["gt_name"][1:]), int(r["tile_id"][1:])]) < 1e-8
    with pytest.raises(Exception, match="components"):
        retrieval.retrieve(questions, tile.withColumn("vec", F.slice("vec", 1, 3))).collect()


def _text_tokens(name, header, lines, cols):
    """Tokens of a tile's text, counted on the text itself."""
    import csv
    import io
    import re

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for line in [header, *lines]:
        writer.writerow([line[c] for c in sorted(cols)])
    return len(re.findall(r"\w+|[^\w\s]", f'table: "{name}"\n\n{out.getvalue()}\n', re.ASCII))


def _brute_closure(ranked, spans, table, budget, second_tile=False):
    """Greedy closure packing by writing and counting every context."""
    def tokens(state):
        return sum(_text_tokens(name, table[name][0], [table[name][1][r] for r in sorted(rows)], cols) for name, (rows, cols) in state.items())

    state, picked = {}, []
    for rank, tile in ranked:
        name, rows, cols = spans[tile]
        old = state.get(name, (set(), set()))
        trial = {**state, name: (old[0] | rows, old[1] | cols)}
        if tokens(trial) <= budget:
            state, picked = trial, picked + [rank]
        elif second_tile and rank == 2:
            return picked + [rank], budget, True
    return picked, tokens(state), False


def _packing_input(spark, seed, n=20):
    rng = np.random.default_rng(seed)
    words = ["x", "two words", "a-b", "", "", 'say "semi;colon", here', None, " "]
    table = {n: ([f"{n}_c{c}" if c else "" for c in range(4)], [[words[rng.integers(len(words))] for _ in range(4)] for _ in range(12)]) for n in ("a", "b")}
    spans, rows = {}, []
    for i in range(n):
        name, lo = str(rng.choice(["a", "b"])), int(rng.integers(0, 10))
        hi, cols = lo + int(rng.integers(1, 3)), sorted(int(c) for c in rng.choice(4, rng.integers(1, 4), replace=False))
        spans[f"t{i}"] = (name, set(range(lo, hi)), set(cols))
        rows.append(("l", name, f"t{i}", lo, hi, cols))
    ranked = [(i + 1, f"t{i}") for i in range(n)]
    ranked_df = spark.createDataFrame([("l", "q", r, t) for r, t in ranked], "lake string, gt_name string, rank int, tile_id string")
    span_df = spark.createDataFrame(rows, "lake string, table_name string, tile_id string, row_lo long, row_hi long, cols array<int>")
    row_df = spark.createDataFrame(
        [("l", n, r, h, v) for n, (h, body) in table.items() for r, v in enumerate(body)],
        "lake string, table_name string, row_id long, names array<string>, values array<string>",
    )
    return ranked, spans, table, ranked_df, span_df, row_df


@pytest.mark.parametrize("budget,second", [(10, False), (14, True), (30, True), (60, False), (150, True), (400, False)])
def test_closure_packing_equals_brute_force(spark, budget, second):
    for seed in range(3):
        ranked, spans, table, ranked_df, span_df, row_df = _packing_input(spark, budget + seed)
        got = packing.pack_closure(ranked_df, span_df, packing.row_tokens(row_df), budget, second).first()
        assert (got["ranks"], got["used"], got["cut"]) == _brute_closure(ranked, spans, table, budget, second)
        assert got["used"] <= budget and got["n_candidates"] == 20


def test_tile_costs_are_those_of_the_text(spark):
    _, spans, table, _, span_df, row_df = _packing_input(spark, 5, 60)
    got = {r["tile_id"]: r["tokens"] for r in packing.tile_tokens(span_df, packing.row_tokens(row_df)).collect()}
    assert got == {t: _text_tokens(n, table[n][0], [table[n][1][r] for r in sorted(rows)], cols) for t, (n, rows, cols) in spans.items()}
    texts = packing.linearize_tiles(span_df, row_df).withColumn("n", F.regexp_count("text", F.lit(r"(\w+|[^\w\s])")))
    assert {r["tile_id"]: r["n"] for r in texts.collect()} == got


def test_sparse_tiles_above_the_budget_in_cells_fit(spark):
    """600 cells in 400 tokens: empty fields cost their commas only."""
    rows = spark.range(200).select(
        F.lit("l").alias("lake"), F.lit("t").alias("table_name"), F.col("id").alias("row_id"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("names"),
        F.array(*[F.lit("")] * 3).alias("values"))
    span = spark.createDataFrame([("l", "t", "t1", 0, 190, [0, 1, 2])], "lake string, table_name string, tile_id string, row_lo long, row_hi long, cols array<int>")
    ranked = spark.createDataFrame([("l", "q", 1, "t1")], "lake string, gt_name string, rank int, tile_id string")
    got = packing.pack_closure(ranked, span, packing.row_tokens(rows), 400).first()
    assert (got["ranks"], got["used"], got["n_cells"]) == ([1], 190 * 2 + 5 + 5, 570)


def test_second_tile_is_cut(spark):
    ranked = spark.createDataFrame([("l", "q", i + 1, f"t{i}", n) for i, n in enumerate([5, 70, 2])] + [("l", "p", 1, "t0", 99), ("l", "p", 2, "t2", 3)],
                                   "lake string, gt_name string, rank int, tile_id string, tokens long")
    got = {r["gt_name"]: r for r in packing.pack_greedy(ranked, 9, second_tile=True).collect()}
    assert (got["q"]["ranks"], got["q"]["used"], got["q"]["cut"], got["q"]["near_end"]) == ([1, 2], 9, True, False)
    assert (got["p"]["ranks"], got["p"]["used"], got["p"]["cut"]) == ([2], 3, False)
    rows = spark.range(500).select(
        F.lit("l").alias("lake"), F.lit("t").alias("table_name"), F.col("id").alias("row_id"), F.array(F.lit("a"), F.lit("b")).alias("names"),
        F.array(F.lit("x"), F.col("id").cast("string")).alias("values"))
    spans = spark.createDataFrame([("l", "q", "t", "t1", 0, 500, [0, 1], 1), ("l", "p", "t", "t2", 7, 9, [1], 1)],
                                  "lake string, gt_name string, table_name string, tile_id string, row_lo long, row_hi long, cols array<int>, rank int")
    cut = spark.createDataFrame([("l", "q")], "lake string, gt_name string")
    got = {r["gt_name"]: r["context"] for r in packing.contexts(spans, rows, 14, "rank", cut).collect()}
    assert got == {"q": 'table: "t"\n\na,b\nx,0\nx,1', "p": 'table: "t"\n\nb\n7\n8\n\n'}
    huge = packing.pack_closure(
        ranked.filter("gt_name = 'q'").drop("tokens"), spans.filter("gt_name = 'q'").drop("gt_name", "rank").withColumn("tile_id", F.lit("t1")),
        packing.row_tokens(rows), 14, second_tile=True).first()
    assert (huge["ranks"], huge["cut"], huge["used"]) == ([2], True, 14)


def test_rolling_rate_across_slots(spark):
    times = [0, 30, 3590, 3599, 3601, 3660, 3671, 7300]
    log = spark.createDataFrame([("m", t, 1) for t in times], "model string, s long, tokens long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["s"]: r["n_requests"] for r in requests.rolling_rate(log, 70).collect()}
    assert got == {t: sum(1 for u in times if t - 70 <= u <= t) for t in times}


def test_stream_equals_batch(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("tokens")
    )
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    log.repartition(3).write.parquet(source)
    # a late sentinel closes all windows of the real data
    last = spark.sql("SELECT 'view' AS model, timestamp'2100-01-01' AS ts, 0L AS tokens")
    last.write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    start_rate_stream(stream, out, str(tmp_path / "checkpoint")).awaitTermination(120)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(windowed_rate(log))


def test_materialize_uses_the_configured_folder(spark):
    df = materialize(spark.range(5), "x")
    assert df.inputFiles()[0].replace("file://", "").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert os.path.isdir(spark.conf.get("spark.checkpoint.dir")) and df.count() == 5


def test_remove_cascades(spark):
    catalog = spark.createDataFrame([("l", "a"), ("l", "b")], "lake string, table_name string")
    spans = spark.createDataFrame([("l", "a", "t1"), ("l", "b", "t2")], "lake string, table_name string, tile_id string")
    left = lakes.remove_tables({"tables": catalog, "tiles": spans}, catalog.filter("table_name = 'a'"))
    assert [r["tile_id"] for r in left["tiles"].collect()] == ["t2"]
    assert tiles.remove_tiles(spans, spans.limit(0)).count() == 2


def test_unknown_models_fail(spark):
    from tessera.streaming import rates

    log = spark.createDataFrame([("gpt-4-1106-preview", "2024-01-01 00:00:00", 5), ("other", "2024-01-01 00:00:01", 5)], "model string, ts string, tokens long")
    response = spark.createDataFrame([('{"model":"other","usage":{"prompt_tokens":1,"completion_tokens":1}}',), ("{}",)], "response string")
    for rows in (rates.flag_limits(rates.windowed_rate(log)), requests.rolling_rate(log, 70, 0.3), requests.response_costs(response)):
        with pytest.raises(Exception, match="unknown model other"):
            rows.collect()
    known = log.filter("model <> 'other'")
    assert rates.flag_limits(rates.windowed_rate(known)).count() == 7
    assert [r["cost"] for r in requests.response_costs(response.filter("response = '{}'")).collect()] == [0.0]


def test_runs_are_united_by_name(spark, tmp_path):
    stages.save_run(spark.createDataFrame([("g0", 1)], "gt_name string, n long"), str(tmp_path), "slicer=a_TpT=1")
    stages.save_run(spark.createDataFrame([(2, "g1", "x")], "n long, gt_name string, more string"), str(tmp_path), "TpT=2_slicer=b")
    rows = {r["gt_name"]: r.asDict() for r in stages.load_runs(spark, str(tmp_path), "gt_name string, n long").collect()}
    assert rows["g0"] == {"gt_name": "g0", "n": 1, "slicer": "a", "TpT": "1", "more": None}
    assert rows["g1"] == {"gt_name": "g1", "n": 2, "slicer": "b", "TpT": "2", "more": "x"}


def test_ground_truths_from_an_array_keep_their_records(spark, tmp_path):
    (tmp_path / "dev.json").write_text('[{"db_id":"d","question":"q0","query":"s",\n"extra":[1]},\n {"db_id":"d","question":"q1","query":"s"}]')
    rows = load_ground_truths(spark, {"test": str(tmp_path / "dev.json")}, multi_line=True).orderBy("gt_name").collect()
    assert [r["information_need"] for r in rows] == ["q0", "q1"] and '"extra":[1]' in rows[0]["data"]


def test_braces_and_order_of_queries(spark):
    from tessera.operators.provenance import Block, answer_table, provenance_rows
    from tessera.sources.lake import Lake

    lake = Lake("l", {"t": spark.createDataFrame([(0, "aa", 1), (1, "b", 3), (2, "c", 2)], "row_id long, n string, v int")})
    blocks = [Block("g", "t", "n RLIKE 'a{2}'", ("n",)), Block("h", "t", "n RLIKE 'a{2}' OR v IN (SELECT max(v) FROM {t})", ("n",))]
    assert sorted((r["gt_name"], r["row_id"]) for r in provenance_rows(lake, blocks).collect()) == [("g", 0), ("h", 0), ("h", 1)]
    answer = answer_table(lake, {"q": "SELECT n FROM {t} ORDER BY v DESC LIMIT 2"}, ["q"]).orderBy("pos").collect()
    assert [r["value"] for r in answer] == ["b", "c"]


def test_positions_within_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    assert sorted((str(r["g"]), r["v"], r["row_id"]) for r in dense_positions(df, ["v"], ["g"]).collect()) == [("None", 1, 0), ("None", 2, 1), ("a", 5, 0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_of_the_driver_do_not_spread_large_ones_by_their_keys(spark):
    """Eleven keys of a catalog would put all rows of the largest table into one sorted partition."""
    from tessera.operators.tiles import invalid_tiles

    frame = local_frame(spark, [("a", 1, [2]), ("b", None, [])], "name string, n long, cols array<int>")
    assert [tuple(r) for r in frame.collect()] == [("a", 1, [2]), ("b", None, [])]
    assert local_frame(spark, [], "name string, cols array<int>").collect() == []
    lake = star_lake(spark, "/root/testdata/sf0.001")
    tiles = provenance.ground_truth_tiles(lake, BLOCKS)
    spans = spark.range(1000).selectExpr("'star' AS lake", "'part' AS table_name", "id AS tile_id", "id AS row_lo", "id + 1 AS row_hi", "array(0) AS cols")
    for df in (tiles, invalid_tiles(spans, catalog(lake))):
        assert "SortMergeJoin" not in _plan(df) and "ExistingRDD" not in _plan(df)


def test_covers_of_two_sets_need_no_join(spark):
    from tessera.operators.rectangles import paired_covers, tile_set_overlap

    columns = "lake string, gt_name string, table_name string, tile_id string, row_lo long, row_hi long, cols array<int>"
    a = spark.createDataFrame([("l", "g", "t", "x", 0, 4, [0, 1]), ("l", "g", "t", "y", 2, 6, [1, 70]), ("l", "h", "t", "z", 0, 1, [0])], columns)
    b = spark.createDataFrame([("l", "g", "t", "u", 3, 9, [1, 2, 70]), ("l", "only-b", "t", "v", 0, 5, [0])], columns)
    got = {r["gt_name"]: (r["num_in"], r["num_out"]) for r in tile_set_overlap(a, b, ["gt_name"]).collect()}
    assert got == {"g": (6, 8), "h": (0, 1)}
    assert "Join" not in _plan(paired_covers(a, b, ["gt_name"]))


def test_text_vectors_share_one_digest(spark):
    """All components of a text come from one digest, and rare numbers do not blow up the code of a table."""
    import hashlib

    from tessera.functions.text import value_text
    from tessera.functions.vectors import hashed_text

    texts = ["", "a", "wörd", "12.5"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for dim in (1, 8, 13, 32):
        got = {r["text"]: list(r["v"]) for r in df.select("text", hashed_text(dim)(F.col("text")).alias("v")).collect()}
        want = {t: [2.0 * int(c, 16) - 15.0 for c in hashlib.md5(t.encode()).hexdigest()[:dim]] for t in texts}
        assert got == want
    numbers = [0.0, 1e-3, 9.99e-4, 1e-5, 9999999.5, 12345678.5, 1.5e16, float("nan"), float("inf"), None, -2.5]
    cells = spark.createDataFrame([(x,) for x in numbers], "x double")
    shown = [r[0] for r in cells.coalesce(1).select(value_text(F.col("x"), cells.schema["x"].dataType)).collect()]
    assert shown == ["0.0", "0.001", "0.000999", "1e-05", "9999999.5", "12345678.5", "1.5e+16", "NaN", "Infinity", None, "-2.5"]
    plan = df.select(hashed_text(8)(F.col("text")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" in plan and "instr(" not in plan


def test_tile_vectors_read_the_cells_once(spark, monkeypatch):
    from tessera.operators import embedding, slicing
    from tessera.plans.corpus import EMBEDDER

    lake = star_lake(spark, SF)
    strides = slicing.grid(catalog(lake), [("cell", 1), ("rowwise", 5)]).filter("table_name = 'region' OR slicer = 'rowwise'")
    cells = lakes.melt(lake.only(["region", "nation"]))
    names = embedding.name_vectors(lake, EMBEDDER)
    got = {r["tile_id"] + r["slicer"]: r["vec"] for r in embedding.embed_grid_tiles(cells, strides, EMBEDDER, names).collect()}
    spans = slicing.grid_tiles(strides.filter("table_name IN ('region', 'nation')")).withColumn("tile_id", F.concat("tile_id", "slicer"))
    want = {r["tile_id"]: r["vec"] for r in embedding.embed_tiles(cells, spans, "tile", EMBEDDER, names).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want if k.endswith("rowwise"))
    plan = embedding.embed_grid_tiles(cells, strides, EMBEDDER, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan  # the means are written


def test_tiles_of_too_many_commas_are_not_read(spark):
    """A tile that its commas alone rule out is left out by shape; one column has no commas and is counted."""
    columns = "lake string, table_name string, tile_id string, row_lo long, row_hi long, cols array<int>"
    spans = spark.createDataFrame(
        [("l", "t", "fits", 0, 9, [0, 1]), ("l", "t", "long", 0, 10, [0, 1]), ("l", "t", "long", 20, 21, [0, 1]), ("l", "t", "single", 0, 99, [3])], columns)
    assert {r["tile_id"] for r in packing._affordable(spans, 10).collect()} == {"fits", "single"}
    rows = spark.range(100).selectExpr("'l' AS lake", "'t' AS table_name", "id AS row_id", "array('a') AS values", "array('n') AS names")
    counted = packing.tokens_of(packing.row_tokens(rows), spans.selectExpr("lake", "table_name", "row_lo AS row_id"))
    assert sorted(r["row_id"] for r in counted.collect()) == [0, 20]


def test_sums_of_hashed_texts_are_those_of_their_vectors(spark):
    """Up to 17 digits share a byte; more texts take several sums, and very many a lambda. Rows of a lake take no lambda."""
    from tessera.functions.vectors import hashed_text
    from tessera.operators.embedding import Embedder, embed_wide_rows
    from tessera.sources.lake import Lake

    model = hashed_text(11)
    rows = spark.createDataFrame([(i, f"t{i}" if i % 3 else None) for i in range(40)], "id long, text string")
    for n in (1, 2, 17, 18, 40, 70):
        texts = [F.concat(F.coalesce("text", F.lit("nan")), F.lit(str(k))) for k in range(n)]
        each = F.array(*[model(t) for t in texts])
        got = rows.select(model.total(texts).alias("sum"), each.alias("each")).collect()
        assert all(r["sum"] == [sum(v[i] for v in r["each"]) for i in range(11)] for r in got), n
    lake = Lake("l", {"t": rows.withColumnRenamed("id", "row_id")})
    plan = embed_wide_rows(lake, Embedder(model=model, dim=11))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "md5" in plan
