"""Exact ranking of tiles per question.

Questions and tiles of a lake meet block by block: a block of tiles and a block of questions form
one co-group, are compared as two matrices, and of the best ``k`` tiles per question only those leave it that a sample of
the tiles does not rule out. The number of blocks per lake follows from its size, so a hot lake is spread over many tasks and no
(question, tile) pair becomes a row unless it is part of the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

COSINE, INNER_PRODUCT = "cosine", "inner-product"
QUESTIONS_PER_BLOCK = 512
TILES_PER_BLOCK = 8_192
LIMIT = 2_000
_DIGITS = 10  # distances are rounded, so that they do not depend on how the blocks were cut
_KEY = ["lake", "_q", "_t"]


def _blocks(df: DataFrame, size: int, id_col: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(df with a block number per lake, (lake, number of blocks))."""
    n = df.groupBy("lake").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("_blocks"))
    tagged = df.join(n, "lake").withColumn(out, F.pmod(F.xxhash64(id_col), F.col("_blocks"))).drop("_blocks")
    return tagged, n


def _paired(questions: DataFrame, tiles: DataFrame):
    known = [c for c in ("lake", "gt_name", "vec", "bound") if c in questions.columns]
    q, n_q = _blocks(questions.select(*known), QUESTIONS_PER_BLOCK, "gt_name", "_q")
    t, n_t = _blocks(tiles.select("lake", "tile_id", "vec"), TILES_PER_BLOCK, "tile_id", "_t")

    def every(df, n, out):
        numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
        return df.join(n, "lake").withColumn(out, numbers).drop("_blocks")

    return every(q, n_t, "_t").groupBy(*_KEY).cogroup(every(t, n_q, "_q").groupBy(*_KEY))


def _scores(q: pd.DataFrame, t: pd.DataFrame, metric: str) -> np.ndarray:
    """Score matrix questions x tiles: cosine distance or inner product."""
    a, b = np.stack(q["vec"].to_numpy()), np.stack(t["vec"].to_numpy())
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"question vectors have {a.shape[1]} components, tile vectors {b.shape[1]}")
    if metric == INNER_PRODUCT:
        return a @ b.T
    a_len, b_len = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    a = a / np.where(a_len == 0, 1, a_len)[:, None]
    b = b / np.where(b_len == 0, 1, b_len)[:, None]
    return np.clip(1 - a @ b.T, 0, 2)


_FOUND = "lake string, gt_name string, tile_id string, score double, n long, total double, low double, high double"


def _block_scores(
    questions: DataFrame, tiles: DataFrame, metric: str, k: int | None, threshold: float | None, stats: bool = False
) -> DataFrame:
    """The best ``k`` tiles of each block per question, up to ``threshold`` and up to the question's own ``bound`` if it has
    one. With ``stats`` also a row per block and question without a tile: number, sum and limits of all its scores."""
    bounded = "bound" in questions.columns

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})
        t = t.sort_values("tile_id", kind="stable")
        scores = np.round(_scores(q, t, metric), _DIGITS)
        cost = -scores if metric == INNER_PRODUCT else scores
        names, ids = q["gt_name"].to_numpy(), t["tile_id"].to_numpy()
        bounds = q["bound"].to_numpy(float) if bounded else np.full(len(q), np.nan)
        parts = []
        for i in range(len(q)):
            keep = np.arange(len(ids)) if np.isnan(bounds[i]) else np.flatnonzero(cost[i] <= bounds[i])
            keep = keep[np.argsort(cost[i][keep], kind="stable")[:k]]
            if threshold is not None:
                keep = keep[cost[i][keep] <= threshold]
            parts.append(pd.DataFrame({"gt_name": names[i], "tile_id": ids[keep], "score": scores[i][keep]}))
        if stats:
            parts.append(pd.DataFrame({
                "gt_name": names, "n": scores.shape[1], "total": scores.sum(axis=1), "low": scores.min(axis=1), "high": scores.max(axis=1)}))
        out = pd.concat(parts).reindex(columns=[c.split()[0] for c in _FOUND.split(", ")])
        out["lake"], out["n"] = q["lake"].iloc[0], out["n"].astype("Int64")
        return out

    return _paired(questions, tiles).applyInPandas(best, _FOUND)


#: Of so many tiles one is looked at first for a bound, where a lake has more than ``BOUNDED_FROM`` times ``k`` tiles.
SAMPLED, BOUNDED_FROM = 16, 8


def _with_bounds(questions: DataFrame, tiles: DataFrame, metric: str, k: int) -> DataFrame:
    """``questions`` with ``bound``: a cost that, going by one of ``SAMPLED`` tiles, somewhat more than ``k`` tiles reach.
    Null in small lakes."""
    large = tiles.groupBy("lake").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BOUNDED_FROM * k).select("lake")
    some = tiles.join(large, "lake", "left_semi").filter(F.pmod(F.xxhash64(F.lit(3), "tile_id"), F.lit(SAMPLED)) == 0)
    place = int(1.25 * k / SAMPLED) + 8
    sampled = _block_scores(questions, some, metric, place, None)
    cost = -F.col("score") if metric == INNER_PRODUCT else F.col("score")
    order = Window.partitionBy("lake", "gt_name").orderBy("_c", "tile_id")
    numbered = sampled.select("lake", "gt_name", "tile_id", cost.alias("_c")).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= place)
    bounds = numbered.groupBy("lake", "gt_name").agg(F.max("_c").alias("bound"), F.count(F.lit(1)).alias("_m")).filter(F.col("_m") == place)
    return questions.join(bounds.drop("_m"), ["lake", "gt_name"], "left")


def _best(questions: DataFrame, tiles: DataFrame, metric: str, k: int, threshold: float | None, stats: bool = False) -> DataFrame:
    """``_block_scores`` with few more than ``k`` tiles per question in all, written.

    Blocks hand on what is below the question's bound only. A question that finds fewer than ``k`` tiles below a bound
    (and no threshold that explains it) is asked once more without one, so the result does not rest on the sample.
    """
    bounded = materialize(_with_bounds(questions, tiles, metric, k), "bounds")
    found = materialize(_block_scores(bounded, tiles, metric, k, threshold, stats), "found")
    reached = found.filter("tile_id IS NOT NULL").groupBy("lake", "gt_name").agg(F.count(F.lit(1)).alias("_n"))
    sizes = bounded.filter("bound IS NOT NULL").join(reached, ["lake", "gt_name"], "left")
    limit = F.lit(False) if threshold is None else F.col("bound") >= threshold
    short = materialize(sizes.filter((F.coalesce("_n", F.lit(0)) < k) & ~limit).select("lake", "gt_name"), "short")
    if short.isEmpty():
        return found
    again = questions.join(short, ["lake", "gt_name"], "left_semi")
    return found.join(short, ["lake", "gt_name"], "left_anti").unionByName(_block_scores(again, tiles, metric, k, threshold, stats))


def retrieve(
    questions: DataFrame,
    tiles: DataFrame,
    metric: str = COSINE,
    k: int | None = LIMIT,
    threshold: float | None = None,
) -> DataFrame:
    """Distances of ``tiles (lake, tile_id, vec)`` to ``questions (lake, gt_name, vec)`` of the same lake.

    With ``k``: the ``k`` nearest per question with their 1-based ``rank``. With ``k=None``: all
    distances (up to ``threshold``), unranked. Inner products are turned into distances relative
    to the lake: centred on their mean, scaled by the largest deviation to 0..1; equal products
    for all tiles have no scale and give null.
    """
    if metric == COSINE:
        scored = _block_scores(questions, tiles, metric, None, threshold) if k is None else _best(questions, tiles, metric, k, threshold)
        found = scored.select("lake", "gt_name", "tile_id", F.col("score").alias("distance"))
    elif metric == INNER_PRODUCT:
        scored = _block_scores(questions, tiles, metric, None, None, True) if k is None else _best(questions, tiles, metric, k, None, True)
        scored = materialize(scored, "products")
        mean = F.sum("total") / F.sum("n")
        spread = F.greatest(F.max("high") - mean, mean - F.min("low"))
        stats = scored.filter("tile_id IS NULL").groupBy("lake", "gt_name").agg(mean.alias("mean"), spread.alias("spread"))
        relative = F.try_divide(F.col("score") - F.col("mean"), F.col("spread")) / 2 + 0.5
        found = scored.filter("tile_id IS NOT NULL").select("lake", "gt_name", "tile_id", "score").join(stats, ["lake", "gt_name"]).select(
            "lake", "gt_name", "tile_id", (1 - relative).alias("distance")
        )
        if threshold is not None:
            found = found.filter(F.col("distance") <= threshold)
    else:
        raise KeyError(f"unknown distance function {metric}")
    return found if k is None else rank(found, k)


def rank(distances: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest per question; every task cuts to ``k`` before the shuffle."""
    window = Window.partitionBy("lake", "gt_name").orderBy(F.asc_nulls_last("distance"), "tile_id")
    return distances.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def retrieve_perfect(hits: DataFrame, sizes: DataFrame, questions: DataFrame, k: int = LIMIT, threshold: float | None = None) -> DataFrame:
    """Rank tiles by the share of their cells outside the ground truth.

    ``hits (lake, gt_name, tile_id, num_in)`` has the touching pairs only. All other tiles have
    distance 1 and follow in tile order, so the first ``k`` tiles of each lake are all the
    candidates that can be needed to fill up.
    """
    touching = hits.join(sizes, ["lake", "tile_id"]).select(
        "lake", "gt_name", "tile_id", (F.lit(1.0) - F.col("num_in") / F.col("num_cells")).alias("distance")
    )
    window = Window.partitionBy("lake").orderBy("tile_id")
    first = sizes.select("lake", "tile_id").withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= k).drop("_r")
    filler = (
        questions.select("lake", "gt_name").distinct().join(first, "lake")
        .join(hits.select("lake", "gt_name", "tile_id"), ["lake", "gt_name", "tile_id"], "left_anti")
        .withColumn("distance", F.lit(1.0))
    )
    found = touching.unionByName(filler.select("lake", "gt_name", "tile_id", "distance"))
    if threshold is not None:
        found = found.filter(F.col("distance") <= threshold)
    return rank(found, k)
