"""The two evaluations end to end, as compositions of the operators.

Question answering takes its slicer, index and merger as arguments: any object with the methods of ``GridSlicer``,
``VectorIndex`` or ``ClosureMerger`` will do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scores import accuracy_aggregates, add_confusion_scores
from tessera.operators import divisive, evaluation, packing, provenance, rectangles, requests, retrieval, slicing
from tessera.operators.embedding import Embedder, embed_grid_tiles, embed_questions, embed_table, embed_tiles, name_vectors
from tessera.operators.provenance import Block
from tessera.operators.tiles import limit_per_lake, tile_sizes
from tessera.session import materialize
from tessera.sources.lake import Lake, catalog, lake_sizes, melt, require_cells
from tessera.sources.stages import read_or_compute, stage_path

QUESTION = ["lake", "gt_name"]
SPANS = ["lake", "table_name", "tile_id", "row_lo", "row_hi", "cols"]


def evaluate_slicing(lake: Lake, blocks: Sequence[Block], configs: Sequence[tuple[str, int]]) -> DataFrame:
    """Scores per ground truth and (slicer, tiles per table) of returning every tile that touches the truth."""
    strides = slicing.grid(catalog(lake), configs)
    counts = slicing.grid_confusion(
        strides, provenance.provenance_rows(lake, blocks), provenance.provenance_columns(lake, blocks)
    )
    return add_confusion_scores(counts)


def _names(lake: Lake, embedder: Embedder) -> DataFrame | None:
    return None if embedder.costly else name_vectors(lake, embedder)


# ---- slicers ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class GridSlicer:
    """Tiles from two strides per table; they need no cell vectors, and their own vectors no membership join. A table
    without cells fails the run, as it does with every slicer."""

    name: str = slicing.ROWWISE
    tiles_per_table: int = 10
    distribution: str = "cell-based"

    def settings(self) -> dict:
        return asdict(self)

    def _strides(self, lake: Lake) -> DataFrame:
        return slicing.grid(require_cells(catalog(lake)), [(self.name, self.tiles_per_table)], self.distribution)

    def tiles(self, lake: Lake, cell_vectors: Callable[[], DataFrame], dim: int) -> DataFrame:
        return slicing.grid_tiles(self._strides(lake)).select(*SPANS)

    def tile_vectors(self, lake: Lake, spans: DataFrame, embedder: Embedder) -> DataFrame:
        return embed_grid_tiles(melt(lake), self._strides(lake), embedder, _names(lake, embedder)).select("lake", "tile_id", "vec")


@dataclass(frozen=True)
class DivisiveSlicer:
    """Tiles split off where cell vectors differ most."""

    tiles_per_table: int = 10
    rule: divisive.SplitRule = field(default_factory=divisive.SplitRule)
    distribution: str = "cell-based"
    name: str = "divisive"

    def settings(self) -> dict:
        return asdict(self)

    def tiles(self, lake: Lake, cell_vectors: Callable[[], DataFrame], dim: int) -> DataFrame:
        tables = require_cells(catalog(lake))
        budgets = slicing.tile_budget(tables, F.lit(self.tiles_per_table), self.distribution).select("lake", "table_name", "budget")
        _, members = divisive.slice_divisive(tables, cell_vectors(), budgets, dim, self.rule)
        named = members.withColumn("tile_id", F.concat_ws("/", "table_name", "tile_id"))
        return divisive.tile_spans(named).select(*SPANS)

    def tile_vectors(self, lake: Lake, spans: DataFrame, embedder: Embedder) -> DataFrame:
        return embed_tiles(melt(lake), spans, "tile", embedder, _names(lake, embedder)).select("lake", "tile_id", "vec")


# ---- indexes ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """Tiles by the distance of their vectors to the question's."""

    metric: str = retrieval.COSINE
    threshold: float | None = None

    @property
    def name(self) -> str:
        return f"vectors-{self.metric}"

    def rank(self, questions: DataFrame, embedder: Embedder, spans: DataFrame, vectors: Callable[[], DataFrame],
             truth: DataFrame | None, k: int) -> DataFrame:
        return retrieval.retrieve(embed_questions(questions, embedder), vectors(), self.metric, k, self.threshold)


@dataclass(frozen=True)
class TruthIndex:
    """Tiles by the share of their cells inside the ground truth: the best any index can do. No vectors are made."""

    threshold: float | None = None
    name: str = "ground-truth"

    def rank(self, questions: DataFrame, embedder: Embedder, spans: DataFrame, vectors: Callable[[], DataFrame],
             truth: DataFrame | None, k: int) -> DataFrame:
        if truth is None:
            raise ValueError("the ground-truth index needs the ground-truth tiles")
        hits = rectangles.tile_hits(spans, truth, ["lake", "tile_id"], ["gt_name"])
        sizes = materialize(tile_sizes(spans, ["lake", "tile_id"]), "tile-sizes")
        return retrieval.retrieve_perfect(materialize(hits, "hits"), sizes, questions, k, self.threshold)


# ---- mergers ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ClosureMerger:
    """Tiles of one table become the smallest rectangle that holds them."""

    name: str = "closure"

    def pack(self, ranked: DataFrame, spans: DataFrame, tokens: DataFrame, budget: int, second_tile: bool) -> DataFrame:
        return packing.pack_closure(ranked, spans, tokens, budget, second_tile)

    def merge(self, chosen: DataFrame) -> DataFrame:
        first = chosen.groupBy(*QUESTION, "table_name").agg(F.min("rank").alias("rank"))
        return rectangles.merge_closure(chosen, QUESTION).join(first, [*QUESTION, "table_name"])


@dataclass(frozen=True)
class NoMerger:
    """Tiles stay as they are."""

    name: str = "none"

    def pack(self, ranked: DataFrame, spans: DataFrame, tokens: DataFrame, budget: int, second_tile: bool) -> DataFrame:
        asked = spans.join(ranked.select("lake", "tile_id").distinct(), ["lake", "tile_id"], "left_semi")
        costs = packing.tile_tokens(asked, tokens).select("lake", "tile_id", "tokens")
        return packing.pack_greedy(ranked.join(costs, ["lake", "tile_id"]), budget, second_tile)

    def merge(self, chosen: DataFrame) -> DataFrame:
        return chosen


# ---- question answering ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class AnswerConfig:
    """Settings of table question answering. ``table_embedder`` makes the cell vectors that slicers may need, ``embedder``
    those of tiles and questions. ``second_tile``: see :func:`packing.pack_greedy`."""

    slicer: GridSlicer | DivisiveSlicer = field(default_factory=GridSlicer)
    index: VectorIndex | TruthIndex = field(default_factory=VectorIndex)
    merger: ClosureMerger | NoMerger = field(default_factory=ClosureMerger)
    embedder: Embedder = field(default_factory=Embedder)
    table_embedder: Embedder | None = None
    context_tokens: int = 1000
    retrieved_tiles: int = retrieval.LIMIT
    second_tile: bool = False
    layout: str = "list"
    model: str = requests.DEFAULT_MODEL
    limit_ground_truths: int | None = None
    skip_large_lakes: int | None = None
    seed: int = 0

    def columns(self) -> dict[str, str]:
        """The configuration as the columns of a result row."""
        return {"embedder": self.embedder.name, "slicer": self.slicer.name, "index": self.index.name, "merger": self.merger.name,
                "TpT": str(self.slicer.tiles_per_table), "tok": str(self.context_tokens)}


def _embedder_settings(embedder: Embedder) -> dict:
    return {"name": embedder.name, "dim": embedder.dim, "weights": embedder.weights, "preprocess_names": embedder.preprocess_names}


@dataclass(frozen=True)
class Sliced:
    """Tiles of a lake and a way to their vectors."""

    spans: DataFrame
    vectors: Callable[[], DataFrame]


def slice_lake(lake: Lake, config: AnswerConfig, root: str | None = None) -> Sliced:
    """Embed cells, slice, embed tiles. With ``root`` each of the three is a written stage under it, in a folder named
    after every setting that led to it: a run starts from the newest stage that is there, and settings of later steps do
    not touch earlier ones. A root belongs to one state of the tables."""
    spark, slicer = lake.any_session(), config.slicer
    cells_by = config.table_embedder or config.embedder
    embedded = {"lake": lake.name, "cells": _embedder_settings(cells_by)}
    sliced = {**embedded, "slicer": slicer.settings()}
    tiled = {**sliced, "tiles": _embedder_settings(config.embedder)}

    def stage(name: str, settings: dict, compute: Callable[[], DataFrame]) -> DataFrame:
        return materialize(compute(), name) if root is None else read_or_compute(spark, stage_path(root, name, settings), compute)

    def cell_vectors() -> DataFrame:
        return stage("embedded", embedded, lambda: embed_table(melt(lake), "table-cells", cells_by, _names(lake, cells_by)))

    spans = stage("sliced", sliced, lambda: slicer.tiles(lake, cell_vectors, cells_by.dim)).select(*SPANS)
    return Sliced(spans, lambda: stage("tile-embedded", tiled, lambda: slicer.tile_vectors(lake, spans, config.embedder)).select("lake", "tile_id", "vec"))


def select_context(
    lake: Lake, questions: DataFrame, config: AnswerConfig, truth: DataFrame | None = None, root: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Retrieve, pack and merge tiles for ``questions (lake, gt_name, information_need)``.

    Returns per question ``(context, num_retrieved_tiles, near_end, cut)``, and the result tiles as a span frame with
    ``gt_name`` and ``rank``. Rankings and packings are written once, as later steps read them several times.
    """
    sliced = slice_lake(lake, config, root)
    ranked = materialize(
        config.index.rank(questions, config.embedder, sliced.spans, sliced.vectors, truth, config.retrieved_tiles), "ranked")
    rows = packing.wide_rows(lake)
    packed = materialize(
        config.merger.pack(ranked, sliced.spans, packing.row_tokens(rows), config.context_tokens, config.second_tile), "packed")
    taken = packing.picked(packed, ranked).select(*QUESTION, "rank", "tile_id")
    result = materialize(config.merger.merge(taken.join(sliced.spans, ["lake", "tile_id"])), "result")
    cut = packed.filter("cut") if config.second_tile else None
    text = packing.contexts(result, rows, config.context_tokens, "rank", cut)
    return packed.select(*QUESTION, F.size("ranks").alias("num_retrieved_tiles"), "near_end", "cut").join(text, QUESTION, "left"), result


def prepare_requests(
    lake: Lake, questions: DataFrame, config: AnswerConfig, truth: DataFrame | None = None, root: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Requests for ``questions (lake, gt_name, information_need, answer[, answer_columns])``, and the result tiles.

    With ``limit_ground_truths`` a seeded sample of questions is asked; a lake above ``skip_large_lakes`` cells is asked
    nothing.
    """
    asked = limit_per_lake(questions, config.limit_ground_truths, config.seed, "gt_name")
    if config.skip_large_lakes is not None:
        small = lake_sizes(catalog(lake)).filter(F.col("lake_cells") <= config.skip_large_lakes).select("lake")
        asked = asked.join(small, "lake", "left_semi")
    asked = materialize(asked, "asked")
    context, result = select_context(lake, asked, config, truth, root)
    instances = asked.join(context, QUESTION, "left").withColumns(
        {"context": F.coalesce("context", F.lit("")), "num_retrieved_tiles": F.coalesce("num_retrieved_tiles", F.lit(0))})
    return requests.build_requests(instances, config.layout, config.model), result


def score_requests(
    lake: Lake, prepared: DataFrame, responses: DataFrame, result: DataFrame, truth: DataFrame, config: AnswerConfig
) -> DataFrame:
    """One result row per question: request, answer, prediction, tile and cell counts, confusion, accuracy, configuration.

    ``responses (request_hash, response)`` are the raw response texts; ``result`` and ``truth`` are span frames with
    ``gt_name``. The prediction is taken out of the response and, in the ``table`` layout, brought to one CSV form.
    ``total`` is the number of answers, one; the cells of a lake are TP + FP + TN + FN.
    """
    predictions = responses.select("request_hash", requests.prediction(F.col("response"), config.layout).alias("prediction"))
    scored = evaluation.score_answers(prepared, predictions)
    confusion = evaluation.retrieval_confusion(result, truth, lake_sizes(catalog(lake)).select("lake", "lake_cells"))
    tiles = result.groupBy(*QUESTION).agg(F.countDistinct("table_name", "tile_id").alias("num_result_tiles"))
    kept = [c for c in ("information_need", "sql_query", "request", "answer", "prediction", "num_retrieved_tiles", "near_end", "cut") if c in scored.columns]
    accuracy = scored.groupBy(*QUESTION, *kept).agg(*accuracy_aggregates(F.col("is_correct")))
    cells = confusion.withColumns({"num_result_cells": F.col("TP") + F.col("FP"), "num_ground_truth_cells": F.col("TP") + F.col("FN")}).drop("total")
    rows = accuracy.join(tiles, QUESTION, "left").join(cells, QUESTION, "left").fillna(0, ["num_result_tiles", "num_result_cells", "num_ground_truth_cells"])
    return rows.withColumns({k: F.lit(v) for k, v in config.columns().items()})
