"""Both evaluations end to end on the toy lake."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import hashed_text
from tessera.operators.embedding import Embedder
from tessera.operators.provenance import Block, ground_truth_tiles
from tessera.sources.lake import Lake
from tessera.workflows import (
    AnswerConfig, ClosureMerger, DivisiveSlicer, GridSlicer, NoMerger, TruthIndex, evaluate_slicing, prepare_requests, score_requests,
)

BLOCKS = [Block("g0", "cities", "pop > 2", ("city", "pop")), Block("g1", "codes", "code = 39", ("country", "code"))]


@pytest.fixture(scope="module")
def toy(spark):
    cities = spark.createDataFrame(
        [(0, "Rome", "IT", 2), (1, "Berlin", "DE", 4), (2, "Paris", "FR", 3), (3, "Bern", "CH", 1)],
        "row_id long, city string, country string, pop int",
    )
    codes = spark.createDataFrame([(0, "IT", 39), (1, "DE", 49)], "row_id long, country string, code int")
    return Lake("toy", {"cities": cities, "codes": codes})


def test_slicing(toy):
    rows = {(r["gt_name"], r["slicer"], r["tpt"]): r for r in evaluate_slicing(toy, BLOCKS, [("cell", 1), ("none", 1), ("rowwise", 100)]).collect()}
    assert rows[("g0", "cell", 1)]["precision"] == 1 and rows[("g0", "none", 1)]["precision"] == pytest.approx(1 / 3)
    assert rows[("g1", "rowwise", 100)]["precision"] == 1
    assert all(r["TP"] + r["FP"] + r["TN"] + r["FN"] == 16 for r in rows.values())


def questions_of(spark):
    return spark.createDataFrame(
        [("toy", "g0", "Which cities are large?", "Berlin,Paris", "q0"), ("toy", "g1", "Which country has code 39?", "IT", "q1")],
        "lake string, gt_name string, information_need string, answer string, sql_query string",
    )


def raw(content):
    choice = F.array(F.struct(F.struct(content.alias("content")).alias("message")))
    return F.to_json(F.struct(F.lit("m").alias("model"), choice.alias("choices")))


EMBEDDER = Embedder(model=hashed_text(16), dim=16)


@pytest.mark.parametrize("merger", [ClosureMerger(), NoMerger()])
@pytest.mark.parametrize("slicer", [GridSlicer("rowwise", 100), DivisiveSlicer(100)])
def test_question_answering(toy, spark, merger, slicer):
    questions, merge = questions_of(spark), merger == ClosureMerger()
    config = AnswerConfig(slicer=slicer, merger=merger, context_tokens=2000, embedder=EMBEDDER)
    prepared, result = prepare_requests(toy, questions, config)
    row = prepared.filter("gt_name = 'g0'").first()
    # the budget holds the whole lake
    n_tiles = 6 if slicer.name == "rowwise" else 16
    assert row["num_retrieved_tiles"] == n_tiles and row["near_end"] and not row["cut"]
    assert row["user_message"].count("table:") == (2 if merge else n_tiles)
    if merge:
        assert 'table: "cities"\n\ncity,country,pop\n' in row["user_message"] and "Berlin,DE,4\n" in row["user_message"]
    responses = prepared.select("request_hash", raw(F.when(F.col("gt_name") == "g1", "IT").otherwise("?")).alias("response"))
    scores = {r["gt_name"]: r for r in score_requests(toy, prepared, responses, result, ground_truth_tiles(toy, BLOCKS), config).collect()}
    assert scores["g1"]["accuracy"] == 1 and scores["g0"]["accuracy"] == 0 and scores["g0"]["prediction"] == "?"
    assert scores["g0"]["recall"] == 1 and scores["g0"]["TP"] == 4 and scores["g0"]["FP"] == 12
    assert scores["g0"]["num_result_tiles"] == (2 if merge else n_tiles)
    assert (scores["g0"]["num_result_cells"], scores["g0"]["num_ground_truth_cells"], scores["g0"]["sql_query"], scores["g0"]["total"]) == (16, 4, "q0", 1)
    assert {k: scores["g0"][k] for k in config.columns()} == {
        "embedder": "hashed", "slicer": slicer.name, "index": "vectors-cosine", "merger": merger.name, "TpT": "100", "tok": "2000"}
    small = AnswerConfig(slicer=slicer, merger=merger, context_tokens=20, embedder=EMBEDDER)
    _, few = prepare_requests(toy, questions, small)
    assert few.filter("gt_name = 'g0'").select("tile_id", "row_lo").distinct().count() < n_tiles


def test_truth_index_and_table_layout(toy, spark):
    """The best tiles first: only they fit, and the answer is a quoted CSV table in a fence."""
    config = AnswerConfig(slicer=GridSlicer("cell", 1), index=TruthIndex(), context_tokens=14, embedder=EMBEDDER, layout="table")
    truth = ground_truth_tiles(toy, BLOCKS)
    questions = questions_of(spark).withColumn("answer", F.lit("a,b\n1,2\n")).withColumn("answer_columns", F.lit("a, b"))
    prepared, result = prepare_requests(toy, questions, config, truth)
    responses = prepared.select("request_hash", raw(F.lit('```csv\r\n"a","b"\r\n\r\n"1","2"\r\n```')).alias("response"))
    scores = {r["gt_name"]: r for r in score_requests(toy, prepared, responses, result, truth, config).collect()}
    assert all(r["accuracy"] == 1 for r in scores.values())
    assert (scores["g0"]["TP"], scores["g0"]["precision"], scores["g0"]["recall"]) == (4, 1, 1)
    failed = prepared.select("request_hash", F.lit('{"error": 1}').alias("response"))
    assert {r["accuracy"] for r in score_requests(toy, prepared, failed, result, truth, config).collect()} == {0.0}
    with pytest.raises(ValueError):
        prepare_requests(toy, questions, config)


def test_second_tile_ends_in_a_cut_context(toy, spark):
    config = AnswerConfig(slicer=GridSlicer("none", 1), context_tokens=10, embedder=EMBEDDER, second_tile=True)
    prepared, result = prepare_requests(toy, questions_of(spark), config)
    for row in prepared.collect():
        assert row["cut"] and not row["near_end"]
        assert len(__import__("re").findall(r"\w+|[^\w\s]", row["context"])) == 10


def test_limits_of_lakes_and_questions(toy, spark):
    assert prepare_requests(toy, questions_of(spark), AnswerConfig(embedder=EMBEDDER, skip_large_lakes=15))[0].count() == 0
    assert prepare_requests(toy, questions_of(spark), AnswerConfig(embedder=EMBEDDER, skip_large_lakes=16, limit_ground_truths=1))[0].count() == 1


@dataclass(frozen=True)
class CountingSlicer(DivisiveSlicer):
    """Says how often it was asked for tiles and for their vectors."""

    def tiles(self, lake, cell_vectors, dim):
        CALLS.append("tiles")
        return super().tiles(lake, cell_vectors, dim)

    def tile_vectors(self, lake, spans, embedder):
        CALLS.append("vectors")
        return super().tile_vectors(lake, spans, embedder)


CALLS = []


def test_stages_are_read_by_the_next_run(toy, spark, tmp_path):
    def run(**settings):
        CALLS.clear()
        config = AnswerConfig(**({"slicer": CountingSlicer(3), "context_tokens": 60, "embedder": EMBEDDER} | settings))
        rows = prepare_requests(toy, questions_of(spark), config, root=str(tmp_path / "stages"))[0].select("gt_name", "request").collect()
        return sorted(tuple(r) for r in rows), list(CALLS)

    first, made = run()
    assert made == ["tiles", "vectors"]
    assert run() == (first, [])
    assert run(context_tokens=30)[1] == [] and run(merger=NoMerger())[1] == []  # later settings
    assert run(embedder=Embedder("other", hashed_text(16), 16), table_embedder=EMBEDDER)[1] == ["vectors"]
    assert run(slicer=CountingSlicer(2))[1] == ["tiles", "vectors"]
    assert sorted(p.name for p in (tmp_path / "stages").iterdir()) == ["embedded", "sliced", "tile-embedded"]
    assert len(list((tmp_path / "stages" / "embedded").iterdir())) == 1
