"""Connected components, and components of rows that meet in shared keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import forget, materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


#: Bytes of a written table up to which it is sent to all executors instead of shuffling the large side of a join.
SENT_BYTES = 16 << 20


def with_few(large: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``large.join(few, on, how)`` for a written ``few``, broadcast if Spark's estimate from its files is small."""
    size = int(str(few._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return large.join(F.broadcast(few) if size <= SENT_BYTES else few, on, how)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps, each an aggregation and a join on one end of an edge; every step is
    written to the shared checkpoint folder. Loops and repeated edges are ignored; without edges the result is empty.
    Both sides of each join are plain tables, so that hubs are split by adaptive execution.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        step, at_nodes = _large_star(now)
        large = materialize(step, "large")
        forget(now, at_nodes)
        step, at_nodes = _small_star(large)
        now = materialize(step, "small")
        forget(large, at_nodes)
        after = _signature(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _shared_postings(postings: DataFrame, slices: int) -> list[DataFrame]:
    """The different ``postings`` of keys with several nodes, one written table for each slice of the keys: one slice at a
    time is shuffled."""
    out = []
    for k in range(slices):
        own = postings.where(F.pmod("key", F.lit(slices)) == k) if slices > 1 else postings
        met = own.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        keys = materialize(met.where("low < high").select("key"), "keys")
        out.append(materialize(with_few(own, keys, "key").distinct(), "shared"))
        forget(keys)
    return out


def bucket_components(
    postings: DataFrame, close: Callable[[Column, Column], Column],
    verify: Callable[[DataFrame], DataFrame] | None = None, slices: int = 1, source: DataFrame | None = None,
) -> DataFrame:
    """``(node, component)`` of the nodes linked within the buckets of ``postings(key, node, print)``.

    Two nodes are linked if they share a key, ``close`` holds for their prints, and ``verify`` (pairs ``(a, b)`` in,
    the true ones out) keeps the pair. The components are those of *all* such links, but only as many pairs are looked
    at as can join components: first each node with the smallest node of its buckets; then, in buckets that still hold
    several components, the nodes outside the bucket's largest component with the nodes of other components. Pairs
    inside one component are never formed, so large groups of near copies stay linear.

    Where most keys have one node, ``slices`` of the keys (numbers) keep the shuffled postings small beside the rest.
    ``source``, a written table that only ``postings`` are made from, is deleted after they were read.
    """
    check = verify or (lambda pairs: pairs)
    parts = _shared_postings(postings, slices)
    shared = reduce(DataFrame.unionByName, parts)
    if source is not None:
        forget(source)
    reps = materialize(shared.groupBy("key").agg(F.min(F.struct("node", "print")).alias("rep")), "reps")
    near = shared.join(reps, "key").where((F.col("node") != F.col("rep.node")) & close(F.col("print"), F.col("rep.print")))
    star = near.groupBy(F.col("rep.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("keys"))
    if verify is None:
        first = materialize(components(star.select("a", "b")), "first")
    else:
        # a pair is costly: each node is tried with the node it shares most keys with, and only then, if that has not
        # joined them, with the smallest nodes of its other buckets
        star = materialize(star, "star")
        likely = star.groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a"))
        found = check(likely.select("a", "b"))
        joined = materialize(components(found), "joined")
        label = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        apart = star.join(label("a"), "a", "left").join(label("b"), "b", "left").where(
            F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b").join(likely.select("a", "b"), ["a", "b"], "left_anti")
        more = check(apart)
        first = materialize(components(found.unionByName(more)), "first")
        forget(star, joined, found, more)

    labelled = materialize(
        shared.join(first, "node", "left")
        .select("key", "node", "print", F.coalesce("component", "node").alias("component")), "labelled")
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = materialize(
        sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"),
                                 F.count("*").alias("parts")).where("parts > 1").select("key", "largest"), "mixed")
    open_ = materialize(labelled.join(mixed, "key"), "open")
    left = open_.where("component <> largest").select(
        "key", F.col("node").alias("a"), F.col("print").alias("pa"), F.col("component").alias("ca"))
    right = open_.select(
        "key", F.col("node").alias("b"), F.col("print").alias("pb"), F.col("component").alias("cb"), "largest")
    met = left.join(
        right,
        (left["key"] == right["key"]) & (F.col("ca") != F.col("cb"))
        & ((F.col("cb") == F.col("largest")) | (F.col("a") < F.col("b"))) & close(F.col("pa"), F.col("pb")),
    )
    second = check(met.select("a", "b").distinct())
    stars = first.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    found = components(stars.unionByName(second))
    forget(*parts, reps, first, labelled, mixed, open_)
    return found
