"""The hand-computed toy lake: 4 x 3 cities, 2 x 2 codes, one ground truth."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text, vectors
from tessera.operators import evaluation, packing, profiling, rectangles, requests, resolution, retrieval, slicing, tiles
from tessera.operators.provenance import Block, ground_truth_tiles, provenance_columns, provenance_rows
from tessera.sources import lake as lakes
from tessera.sources.lake import Lake

SPANS = "lake string, table_name string, tile_id string, row_lo long, row_hi long, cols array<int>, gt_name string"
G0 = [Block("g0", "cities", "pop > 2", ("city", "pop"))]


@pytest.fixture(scope="module")
def toy(spark):
    cities = spark.createDataFrame(
        [(0, "Rome", "IT", 2), (1, "Berlin", "DE", 4), (2, "Paris", "FR", 3), (3, "Bern", "CH", 1)],
        "row_id long, city string, country string, pop int",
    )
    codes = spark.createDataFrame([(0, "IT", 39), (1, "DE", 49)], "row_id long, country string, code int")
    return Lake("toy", {"cities": cities, "codes": codes})


@pytest.fixture(scope="module")
def unions(spark):
    """Two overlapping tiles of the cities."""
    return spark.createDataFrame(
        [("toy", "cities", "u1", 0, 2, [0], "g0"), ("toy", "cities", "u2", 1, 3, [0, 1], "g0")], SPANS
    )


def one(df):
    return df.first().asDict()


def test_catalog_and_duplicate_names(toy):
    rows = {r["table_name"]: r["num_cells"] for r in lakes.catalog(toy).collect()}
    assert rows == {"cities": 12, "codes": 4}
    with pytest.raises(KeyError):
        toy.with_table("cities", toy.tables["codes"])


def test_melt_and_back(toy):
    cells = lakes.melt(toy.only(["cities"]))
    assert cells.count() == 12
    wide = {r["row_id"]: (r["city"], r["pop"]) for r in lakes.unmelt(cells, ["city", "country", "pop"]).collect()}
    assert wide[2] == ("Paris", "3")


def test_tile_budget(toy):
    tables = lakes.catalog(toy)
    cell = {r["table_name"]: r["budget"] for r in slicing.tile_budget(tables, F.lit(10)).collect()}
    assert cell == {"cities": 14, "codes": 5}
    per_table = slicing.tile_budget(tables, F.lit(10), "table-based")
    assert {r["budget"] for r in per_table.collect()} == {10}


@pytest.mark.parametrize("n_rows,budget,per_tile,count", [(10, 4, 3, 4), (10, 3, 4, 3), (4, 10, 1, 4), (60000, 7, 8572, 7)])
def test_rowwise(spark, n_rows, budget, per_tile, count):
    table = spark.createDataFrame([("l", "t", n_rows, 1, n_rows)], "lake string, table_name string, n_rows long, n_cols int, num_cells long")
    strides = slicing.grid(table, [("rowwise", budget)], "table-based")
    assert strides.first()["row_stride"] == per_tile
    found = slicing.grid_tiles(strides).collect()
    assert len(found) == count and sum(r["num_cells"] for r in found) == n_rows


@pytest.mark.parametrize(
    "slicer,tpt,expected",
    [("none", 1, (4, 8, 4)), ("rowwise", 4, (4, 2, 10)), ("colwise", 3, (4, 4, 8)), ("cell", 1, (4, 0, 12))],
)
def test_slicing_confusion(toy, slicer, tpt, expected):
    strides = slicing.grid(lakes.catalog(toy), [(slicer, tpt)], "table-based")
    counts = slicing.grid_confusion(strides, provenance_rows(toy, G0), provenance_columns(toy, G0))
    row = one(scores.add_confusion_scores(counts))
    assert (row["TP"], row["FP"], row["TN"], row["FN"]) == (*expected, 0)
    assert row["recall"] == 1 and row["precision"] == 4 / (4 + expected[1])
    # the same from explicit tiles
    spans = slicing.grid_tiles(strides)
    hits = rectangles.tile_hits(spans, ground_truth_tiles(toy, G0), ["tile_id"], ["gt_name"])
    explicit = one(slicing.tile_confusion(spans.select("lake", "tile_id", "num_cells"), hits, strides.select("lake", "lake_cells").distinct(), provenance_columns(toy, G0)))
    assert (explicit["TP"], explicit["FP"], explicit["TN"]) == expected


def test_overlap_closure_and_retrieval(toy, unions, spark):
    truth = ground_truth_tiles(toy, G0)
    assert one(rectangles.covered_cells(unions, ["gt_name"]))["num_cells"] == 5
    overlap = one(rectangles.tile_set_overlap(unions, truth, ["gt_name"]))
    assert (overlap["num_in"], overlap["num_out"]) == (2, 3)
    merged = rectangles.merge_closure(unions, ["gt_name"]).collect()
    assert sorted(r["row_lo"] for r in merged) == [0, 1, 2] and {tuple(r["cols"]) for r in merged} == {(0, 1)}
    result = spark.createDataFrame([("toy", "cities", "r", 0, 2, [0, 1, 2], "g0")], SPANS)
    sizes = lakes.lake_sizes(lakes.catalog(toy)).select("lake", "lake_cells")
    row = one(evaluation.retrieval_confusion(result, truth, sizes))
    assert (row["TP"], row["FP"], row["FN"], row["TN"]) == (2, 4, 2, 8)


def test_wide_column_sets_use_several_words(spark):
    cols = list(range(0, 200, 3))
    a = spark.createDataFrame([("l", "t", "a", 0, 5, cols, "g")], SPANS)
    b = spark.createDataFrame([("l", "t", "b", 3, 9, list(range(0, 200, 2)), "g")], SPANS)
    assert one(rectangles.covered_cells(a, ["gt_name"]))["num_cells"] == 5 * len(cols)
    both = len(set(cols) & set(range(0, 200, 2)))
    assert one(rectangles.tile_set_overlap(a, b, ["gt_name"]))["num_in"] == 2 * both
    assert one(rectangles.rect_overlap(a, b, ["gt_name"]))["num_in"] == 2 * both


def test_long_ranges_are_blocked(spark):
    df = spark.createDataFrame([("a", 10), ("b", 3), ("c", 0)], "k string, n long")
    found = rectangles.explode_range(df, F.col("n"), "i", block=4)
    assert sorted((r["k"], r["i"]) for r in rectangles.explode_range(df, F.col("n"), "i", spread=False).collect()) == sorted(
        (r["k"], r["i"]) for r in found.collect()
    )
    assert sorted((r["k"], r["i"]) for r in found.collect()) == sorted([("a", i) for i in range(10)] + [("b", i) for i in range(3)])


def test_perfect_ranking(toy, spark):
    tiles_ = spark.createDataFrame(
        [("toy", "cities", "row0", 0, 1, [0, 1, 2], ""), ("toy", "cities", "row1", 1, 2, [0, 1, 2], ""), ("toy", "cities", "whole", 0, 4, [0, 1, 2], "")], SPANS
    ).drop("gt_name")
    truth = ground_truth_tiles(toy, G0)
    hits = rectangles.tile_hits(tiles_, truth, ["tile_id"], ["gt_name"])
    found = retrieval.retrieve_perfect(hits, tiles.tile_sizes(tiles_, ["lake", "tile_id"]), truth)
    got = {r["tile_id"]: (round(r["distance"], 6), r["rank"]) for r in found.collect()}
    assert got == {"row1": (round(1 / 3, 6), 1), "whole": (round(2 / 3, 6), 2), "row0": (1.0, 3)}


def test_cosine_and_inner_product(spark):
    vec = "lake string, {} string, vec array<double>"
    question = spark.createDataFrame([("l", "q", [1.0, 2.0]), ("l", "zero", [0.0, 0.0])], vec.format("gt_name"))
    tile = spark.createDataFrame([("l", "t", [2.0, 1.0])], vec.format("tile_id"))
    got = {r["gt_name"]: round(r["distance"], 9) for r in retrieval.retrieve(question, tile).collect()}
    assert got == {"q": 0.2, "zero": 1.0}
    axis = spark.createDataFrame([("l", "q", [1.0])], vec.format("gt_name"))
    values = spark.createDataFrame([("l", "a", [3.0]), ("l", "b", [1.0]), ("l", "c", [-1.0])], vec.format("tile_id"))
    got = {r["tile_id"]: r["distance"] for r in retrieval.retrieve(axis, values, retrieval.INNER_PRODUCT).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 1.0}
    row = spark.range(1).select(vectors.cosine_distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0))).alias("d")).first()
    assert abs(row["d"] - 0.2) < 1e-12


def test_weighted_mean(spark):
    parts = [([1.0, 0.0], 4), ([0.0, 1.0], 1), ([1.0, 1.0], 1), ([0.0, 0.0], 2)]
    columns = [(F.array(*[F.lit(x) for x in v]), w) for v, w in parts]
    for dim in (None, 2):
        assert spark.range(1).select(vectors.weighted_mean(columns, dim).alias("v")).first()["v"] == [0.625, 0.25]
    with pytest.raises(ValueError):
        vectors.weighted_mean([])


def test_greedy_packing(spark):
    ranked = spark.createDataFrame([("l", "q", i + 1, f"t{i}", n) for i, n in enumerate([5, 7, 2, 9, 1])], "lake string, gt_name string, rank int, tile_id string, tokens long")
    row = one(packing.pack_greedy(ranked, 9))
    assert (row["used"], row["ranks"], row["near_end"]) == (8, [1, 3, 5], True)
    row = one(packing.pack_greedy(ranked, 0))
    assert (row["used"], row["ranks"]) == (0, [])


def test_scores_of_empty_and_half(spark):
    df = spark.createDataFrame([("half", 1, 1, 0, 1), ("none", 0, 0, 0, 0)], "k string, TP long, FP long, TN long, FN long")
    got = {r["k"]: (r["total"], r["precision"], r["recall"], r["f1_score"]) for r in scores.add_confusion_scores(df).collect()}
    assert got == {"half": (3, 0.5, 0.5, 0.5), "none": (0, 1.0, 0.0, 0.0)}
    answers = spark.createDataFrame([(True,), (False,)], "is_correct boolean")
    assert one(evaluation.answer_accuracy(answers)) == {"correct": 1, "incorrect": 1, "total": 2, "accuracy": 0.5}


def test_texts(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    line = text.csv_line([F.lit(None).cast("string"), F.lit('q"r')])
    assert value(line) == ',"q""r"'
    assert value(text.csv_line([F.lit("1.0"), F.lit("x,y")])) == '1.0,"x,y"'
    assert value(text.clean_prediction(F.lit("```csv\na,b\n1,2\n```"))) == "a,b\n1,2\n"
    assert value(text.clean_prediction(F.lit("a\n1,2"))) == "a\n1,2"
    quoted = '```csv\r\n"name","note, long"\r\n\r\n"Ann","said ""hi"",\r\n\r\nleft"\r\n  \nBob,"x"\r\n"C"\r\n```'
    assert value(text.clean_prediction(F.lit(quoted))) == 'name,"note, long"\nAnn,"said ""hi"",\r\n\r\nleft"\nBob,x\nC,\n'
    for given, want in [("a,b\n1,2", "a,b\n1,2\n"), ("a\n\"\"\nx", 'a\n""\nx\n'), ('a,a,\n1,2,3\n', "a,a.1,Unnamed: 2\n1,2,3\n"),
                        ('a\n"open, and never closed\n', 'a\n"open, and never closed\n'), ("", ""), ("\n\n", "\n\n"), ("x", "x\n"),
                        ('a,b\n"q"r,s"t\n', 'a,b\nqr,"s""t"\n'), ("a,b\n,\n", "a,b\n,\n"), (" a , b \n 1 , 2 ", " a , b \n 1 , 2 \n")]:
        assert value(text.clean_prediction(F.lit(given))) == want
    assert value(text.clean_prediction(F.lit(None).cast("string"))) is None
    table = F.create_map(F.lit("n"), F.array(F.lit("a,b"), F.lit(None)), F.lit("m"), F.array(F.lit("1"), F.lit("2")))
    assert value(text.answer_text(table)) == 'n,m\n"a,b",1\n,2\n' and value(text.answer_columns(table)) == "n, m"
    assert value(text.normalize_name(F.lit("state-name_x"))) == "state name x"
    assert value(text.config_map(F.lit("runs/slicer=lib.slice.X_TpT=10"))) == {"slicer": "lib.slice.X", "TpT": "10"}
    assert value(text.token_count(F.lit("Hello, wörld 1.5"))) == 8
    assert value(text.truncate_tokens(F.lit("a  b, c"), 3)) == "a  b,"
    for number, shown in [(1863.84, "1863.84"), (900.0, "900.0"), (12345678.5, "12345678.5"), (1e9, "1000000000.0"), (-2e7, "-20000000.0"),
                          (0.0005, "0.0005"), (-0.00012345, "-0.00012345"), (1e-5, "1e-05"), (-1.5e-7, "-1.5e-07"), (1e16, "1e+16"), (2.5e120, "2.5e+120"),
                          (0.0, "0.0"), (0.001, "0.001")]:
        assert value(text.value_text(F.lit(number), spark.range(1).select(F.lit(1.0)).schema[0].dataType)) == shown


def test_histograms(spark):
    def bins(values, log):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        return [(r["bin_lo"], r["bin_hi"], r["n"]) for r in profiling.histogram(df, "v", log).orderBy("bin_lo").collect()]

    assert bins([1, 1, 2, 5, 5], False) == [(1, 2, 2), (2, 3, 1), (3, 4, 0), (4, 5, 2)]
    assert bins([3, 10, 99, 1000], True) == [(0, 1, 0), (1, 10, 1), (10, 100, 2), (100, 1000, 0), (1000, 10000, 1), (10000, 100000, 0)]
    assert bins([7, 7], False) == [(6.9, 7.1, 2)]


def test_request_cost_and_unknown_model(spark):
    df = spark.createDataFrame([("gpt-4-1106-preview", 1000, 100)], "model string, tokens_in long, max_tokens long")
    assert abs(one(requests.request_costs(df))["max_cost"] - 0.013) < 1e-12
    with pytest.raises(Exception, match="unknown model"):
        requests.request_costs(df.withColumn("model", F.lit("nope"))).collect()


def test_name_resolution(spark):
    columns = spark.createDataFrame(
        [("toy", "cities", c) for c in ("city", "country", "pop")] + [("toy", "codes", c) for c in ("country", "code")],
        "lake string, table_name string, col_name string",
    )
    refs = "lake string, gt_name string, ref string"
    tables = spark.createDataFrame([("toy", "a", "Cities"), ("toy", "b", "cities"), ("toy", "b", "CODES"), ("toy", "b", "zip")], refs)
    names = spark.createDataFrame([("toy", "a", "pop"), ("toy", "b", "country"), ("toy", "b", "CODES.Code"), ("toy", "a", "zip"), ("toy", "a", "x.y.z"), ("toy", "a", "codes.code")], refs)
    resolved = resolution.resolve_tables(tables, columns.select("lake", "table_name").distinct())
    assert {(r["ref"], r["n_matches"]) for r in resolved.collect()} == {("Cities", 1), ("cities", 1), ("CODES", 1), ("zip", 0)}
    got = {(r["gt_name"], r["ref"]): (r["status"], r["table_name"], r["col_name"]) for r in resolution.resolve_columns(names, resolved, columns).collect()}
    assert got[("a", "pop")] == ("ok", "cities", "pop")
    assert got[("b", "country")] == ("ambiguous", None, None)
    assert got[("b", "CODES.Code")] == ("ok", "codes", "code")
    assert got[("a", "zip")][0] == "no-match" and got[("a", "x.y.z")][0] == "bad-name" and got[("a", "codes.code")][0] == "no-table"
