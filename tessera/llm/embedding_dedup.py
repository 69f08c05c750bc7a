"""Near-duplicate vectors through robust-pruned flat graphs on overlapping shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.graphs import components
from tessera.llm.registry import query, table
from tessera.session import materialize

LEAST_COSINE = 0.95
#: Members of a shard on average and at most, and queries searched together.
SHARD, SHARD_MOST, BLOCK = 1_024, 4_096, 1_024
#: Shards a vector belongs to, and nearest shards it is searched in.
OVERLAP, ROUTES = 2, 4
#: A vector is searched in all shards whose centre is at least so near, however many.
NEAR_CENTRE = 0.7
#: Centres are a sample of at most so many vectors; shards that outgrow ``SHARD_MOST`` are split by hash.
CENTRES = 65_536
DEGREE, CANDIDATES, ALPHA, BEAM = 32, 64, 1.2, 48
#: Search goes on from every vector at least so near, below the threshold.
EXPAND_FROM = LEAST_COSINE - 0.03
AUDITED, LEAST_RECALL = 256, 0.9


# ---- one shard -------------------------------------------------------------------------------------------------------

def _prune(unit: np.ndarray, order: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of candidate lists (nearest first, -1 for none), all nodes at once.

    A node keeps its nearest candidate and drops those that are ``alpha`` times nearer to it than to the node, again
    and again.
    """
    n = len(unit)
    safe = np.maximum(order, 0)
    far = 1 - np.einsum("nd,ncd->nc", unit, unit[safe], optimize=True)
    alive = order >= 0
    kept = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        pick = safe[rows, first]
        kept[some, k] = pick[some]
        between = 1 - np.einsum("nd,ncd->nc", unit[pick], unit[safe], optimize=True)
        alive &= (alpha * between > far) & (order != pick[:, None])
    return kept


def build_graph(unit: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbour lists (``-1`` fills) of a robust-pruned graph over unit vectors, reachable from the medoid."""
    n = len(unit)
    if n == 1:
        return np.full((1, degree), -1, np.int64)
    like = unit @ unit.T
    np.fill_diagonal(like, -2)
    near = min(candidates, n - 1)
    order = np.argpartition(-like, near - 1, axis=1)[:, :near] if near < n - 1 else np.argsort(-like, axis=1)[:, :near]
    drawn = np.random.default_rng(n).integers(0, n, (n, min(16, n - 1)))
    order = np.concatenate([order, drawn], axis=1)
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(like, order, 1), axis=1, kind="stable"), 1)
    order[order == np.arange(n)[:, None]] = -1
    order = np.take_along_axis(order, np.argsort(order < 0, axis=1, kind="stable"), 1)
    out = _prune(unit, order, degree, alpha)
    heads, tails = np.repeat(np.arange(n), degree), out.ravel()
    pairs = np.unique(np.concatenate([np.stack([heads, tails], 1), np.stack([tails, heads], 1)])[np.tile(tails >= 0, 2)], axis=0)
    starts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
    slots = np.arange(len(pairs)) - np.repeat(starts, np.diff(np.append(starts, len(pairs))))
    both = np.full((n, int(slots.max()) + 1), -1, np.int64)
    both[pairs[:, 0], slots] = pairs[:, 1]
    value = np.where(both >= 0, np.take_along_axis(like, np.maximum(both, 0), 1), -3)
    both = np.take_along_axis(both, np.argsort(-value, axis=1, kind="stable"), 1)
    kept = _prune(unit, both, degree, alpha) if both.shape[1] > degree else both
    return _reachable(kept, like, medoid(unit))


def medoid(unit: np.ndarray) -> int:
    return int((unit @ unit.mean(axis=0)).argmax())


def _reachable(lists: np.ndarray, like: np.ndarray, start: int) -> np.ndarray:
    """Add an edge from the nearest reached node to each part that cannot be reached from ``start``."""
    n = len(lists)
    lists = np.concatenate([lists, np.full((n, 1), -1, np.int64)], axis=1)
    seen, front = np.zeros(n, bool), np.array([start])
    seen[start] = True
    while True:
        while len(front):
            front = np.unique(lists[front])
            front = front[front >= 0]
            front = front[~seen[front]]
            seen[front] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return lists
        reached = np.flatnonzero(seen)
        part = like[np.ix_(lost, reached)]
        at = int(part.argmax())
        u, v = lost[at // len(reached)], reached[at % len(reached)]
        free = np.flatnonzero(lists[v] < 0)
        if not len(free):
            lists = np.concatenate([lists, np.full((n, 1), -1, np.int64)], axis=1)
            free = [lists.shape[1] - 1]
        lists[v, free[0]] = u
        seen[u] = True
        front = np.array([u])


def search(unit: np.ndarray, lists: np.ndarray, start: int, asked: np.ndarray, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, member)`` with a product of at least ``reach``: greedy beam search from ``start``, then expansion
    from everything in reach until nothing new comes into reach. Four nodes of each query are expanded at a time."""
    b, n, each = len(asked), len(unit), 4
    visited, expanded, inside = (np.zeros((b, n), bool) for _ in range(3))
    ids, near = np.full((b, beam), -1, np.int64), np.full((b, beam), -2, np.float32)
    ids[:, 0], near[:, 0], visited[:, start] = start, asked @ unit[start], True
    inside[:, start] = near[:, 0] >= reach
    closed = np.zeros((b, beam), bool)
    active = np.arange(b)
    while len(active):
        value = np.where(closed[active] | (ids[active] < 0), -3, near[active])
        take = np.argsort(-value, axis=1)[:, :each]
        ok = np.take_along_axis(value, take, 1) > -3
        active, take, ok = active[ok.any(axis=1)], take[ok.any(axis=1)], ok[ok.any(axis=1)]
        if not len(active):
            break
        nodes = np.where(ok, np.take_along_axis(ids[active], take, 1), -1)
        closed[active[:, None], take] |= ok
        expanded[np.repeat(active, each)[ok.ravel()], nodes[ok]] = True
        found = np.where(nodes[..., None] >= 0, lists[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        fresh = (found >= 0) & ~visited[active[:, None], np.maximum(found, 0)]
        width = int(fresh.sum(axis=1).max())
        if not width:
            continue
        left = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        found = np.where(np.take_along_axis(fresh, left, 1), np.take_along_axis(found, left, 1), -1)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        value = np.einsum("bd,bwd->bw", asked[active], unit[np.maximum(found, 0)], optimize=True)
        value[found < 0] = -3
        r, c = np.nonzero(found >= 0)
        visited[active[r], found[r, c]] = True
        inside[active[r], found[r, c]] |= value[r, c] >= reach
        all_ids, all_near = np.concatenate([ids[active], found], 1), np.concatenate([near[active], value], 1)
        all_closed = np.concatenate([closed[active], np.zeros_like(found, bool)], 1)
        best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        ids[active], near[active], closed[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_near, all_closed))
    while True:
        q, x = np.nonzero(inside & ~expanded)
        if not len(q):
            return np.nonzero(inside)
        expanded[q, x] = True
        codes = []
        for at in range(0, len(q), 1 << 16):
            y = lists[x[at:at + (1 << 16)]]
            own = np.repeat(q[at:at + (1 << 16)], y.shape[1])
            y = y.ravel()
            new = (y >= 0) & ~visited[own, np.maximum(y, 0)]
            codes.append(np.unique(own[new] * n + y[new]))
        codes = np.unique(np.concatenate(codes))
        for at in range(0, len(codes), 1 << 16):
            q, y = np.divmod(codes[at:at + (1 << 16)], n)
            visited[q, y] = True
            inside[q, y] = np.einsum("ij,ij->i", asked[q], unit[y]) >= reach


def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position connected with each of ``n`` positions by pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


# ---- all shards ------------------------------------------------------------------------------------------------------

def _is_usable():
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _units(column, size: int) -> np.ndarray:
    """Unit vectors in double precision, shorter vectors filled with zeros."""
    rows = [np.asarray(v, np.float64) for v in column]
    out = np.zeros((len(rows), size))
    for r, v in zip(out, rows, strict=True):
        r[:len(v)] = v / np.abs(v).max()
    return out / np.linalg.norm(out, axis=1)[:, None]


def _sizes(column) -> np.ndarray:
    return np.array([len(v) for v in column])


def _assign(nodes: DataFrame, centres: np.ndarray, routes: int) -> DataFrame:
    """``(node, embedding, cluster, place)`` for each shard a vector is searched in; it is a member of those with the
    first ``OVERLAP`` places."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)
    schema = "node long, embedding array<double>, cluster int, place int"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                like = _units(part.column(1).to_pylist(), shared.value.shape[1]).astype(np.float32) @ shared.value.T
                order = np.argsort(-like, axis=1, kind="stable")
                place = np.argsort(order, axis=1, kind="stable")
                r, c = np.nonzero((place < routes) | (like >= NEAR_CENTRE))
                some = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(c, pa.int32()), pa.array(place[r, c], pa.int32())],
                    names=["node", "embedding", "cluster", "place"])

    return nodes.select("node", "embedding").mapInArrow(run, schema)


def _counts(df: DataFrame) -> dict[int, int]:
    return {r["cluster"]: r["n"] for r in df.groupBy("cluster").agg(F.count("*").alias("n")).collect()}


def _searched(nodes: DataFrame, size: int, n: int, routes: int, beam: int) -> DataFrame:
    """``(node, links, root)``: found links of a node, both ways, and a node connected with it; several rows a node."""
    k = min(CENTRES, max(1, -(-n * OVERLAP // SHARD)))
    centres = nodes.orderBy(F.xxhash64("embedding"), "node").limit(k).select("embedding").collect()
    placed = materialize(
        _assign(nodes, _units([r["embedding"] for r in centres], size).astype(np.float32), min(routes, k)), "placed")
    members = placed.where(F.col("place") < OVERLAP)
    parts = {c: -(-m // SHARD_MOST) for c, m in _counts(members).items()}
    blocks = {c: -(-m // BLOCK) for c, m in _counts(placed).items()}
    table_ = placed.sparkSession.createDataFrame(
        [(c, parts.get(c, 0), b) for c, b in blocks.items()], "cluster int, parts int, blocks int")
    sized = members.join(table_, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        lists = build_graph(_units(pdf["embedding"], size).astype(np.float32))
        names = pdf["node"].to_numpy()
        return pd.DataFrame({"node": names, "neighbours": [names[row[row >= 0]] for row in lists]})

    own = sized.groupBy("cluster", "part").applyInPandas(build, "node long, neighbours array<long>")
    union = materialize(own.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "graph")
    empty = F.array().cast("array<long>")
    in_shard = sized.join(union, "node").select(
        "cluster", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "embedding", "neighbours",
        F.lit(True).alias("member"))
    asking = placed.join(table_, "cluster").where("parts > 0").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "node", "embedding",
        empty.alias("neighbours"), F.lit(False).alias("member"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        of, by = (pdf[pdf["member"] == m].sort_values("node", ignore_index=True) for m in (True, False))
        none = pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype=object), "root": pd.Series(dtype="int64")})
        if of.empty or by.empty:
            return none
        unit, asked = _units(of["embedding"], size), _units(by["embedding"], size)
        names, askers = of["node"].to_numpy(), by["node"].to_numpy()
        width = max(map(len, of["neighbours"]), default=0)
        lists = np.full((len(of), max(1, width)), -1, np.int64)
        for row, others in zip(lists, of["neighbours"], strict=True):
            at = np.minimum(np.searchsorted(names, others), len(names) - 1)
            here = at[names[at] == others]  # neighbours of the other shards' graphs are walked there
            row[:len(here)] = here
        q, x = [], []
        for at in range(0, len(by), BLOCK):
            qs, xs = search(unit.astype(np.float32), lists, medoid(unit.astype(np.float32)), asked[at:at + BLOCK].astype(np.float32), beam, EXPAND_FROM)
            q.append(qs + at)
            x.append(xs)
        q, x = np.concatenate(q), np.concatenate(x)
        exact = np.concatenate([np.einsum("ij,ij->i", asked[q[at:at + 65_536]], unit[x[at:at + 65_536]])
                                for at in range(0, len(q), 65_536)]) if len(q) else np.zeros(0)
        same = _sizes(by["embedding"])[q] == _sizes(of["embedding"])[x]
        true = (exact >= LEAST_COSINE) & same & (askers[q] != names[x])
        a, b = askers[q[true]], names[x[true]]
        if not len(a):
            return none
        pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
        heads, starts = np.unique(pairs[:, 0], return_index=True)
        position = np.searchsorted(heads, pairs)
        root = heads[_local_roots(position[:, 0], position[:, 1], len(heads))]
        return pd.DataFrame({"node": heads, "links": np.split(pairs[:, 1], starts[1:]), "root": root})

    rows = in_shard.unionByName(asking)
    return rows.groupBy("cluster", "part", "block").applyInPandas(find, "node long, links array<long>, root long")


def audit_recall(nodes: DataFrame, links: DataFrame, size: int, audited: int = AUDITED) -> float:
    """Share of true links of at most ``audited`` sampled vectors (those of the smallest id hashes) that were found.

    The sample is compared with all vectors, block by block, and only counts leave the tasks.
    """
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(audited).select("node", "embedding").collect()
    if not sample:
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast(
        (np.array([r["node"] for r in sample]), _units([r["embedding"] for r in sample], size), _sizes([r["embedding"] for r in sample])))

    def run(batches):
        names, asked, sizes = shared.value
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                vectors = batch.column(1)[at:at + 2_048].to_pylist()
                near = (asked @ _units(vectors, size).T >= LEAST_COSINE) & (sizes[:, None] == _sizes(vectors))
                near &= names[:, None] != batch.column(0)[at:at + 2_048].to_numpy(zero_copy_only=False)
                total += near.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["node", "n"])

    true = nodes.select("node", "embedding").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    asked = true.join(links, "node", "left").agg(F.sum("n").alias("n"), F.sum(F.coalesce(F.size("links"), F.lit(0))).alias("found")).first()
    return 1.0 if not asked["n"] else asked["found"] / asked["n"]


def embedding_links(vectors: DataFrame) -> tuple[DataFrame, float]:
    """``(vec_id, n_links, component_id)`` of every row of ``vectors(vec_id, embedding)``, and the audited recall.

    Equal vectors are one node. A bounded sample of nodes serves as centres; every node joins the shards of its two
    nearest centres, each shard builds a robust-pruned graph, and the neighbour lists of a node from all its shards are
    united. Every node is then searched in the shards of its four nearest centres and of all centres with a cosine of
    ``NEAR_CENTRE`` or more, from the shard's medoid with expansion around everything near the threshold. Found pairs
    are verified in double precision and count both ways. If the audited recall is below 0.9, the search is repeated
    with twice the shards and beam, up to all shards.

    Vectors that are null, zero or hold null or non-finite components link with nothing and are their own component; so
    do rows without ``vec_id`` (component null). Vectors of different lengths never link. Repeated rows link with each
    other. Other columns are ignored; an empty table gives no rows.
    """
    typed = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    usable = typed.where(_is_usable())
    nodes = materialize(
        usable.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    n, size = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    routes, beam, recall = ROUTES, BEAM, 1.0
    found = vectors.sparkSession.createDataFrame([], "node long, links array<long>, root long")
    links = found.select("node", "links")
    while n:
        found = materialize(_searched(nodes, size, n, routes, beam), "found")
        links = materialize(found.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")), "links")
        recall = audit_recall(nodes, links, size)
        if recall >= LEAST_RECALL or routes >= n:
            break
        routes, beam = 2 * routes, 2 * beam
    linked = materialize(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()), "linked")
    # a link to a node counts once for each copy of it; only nodes with copies are taken apart for that
    more = (
        nodes.where("copies > 1").select("node", "copies").join(links, "node")
        .select(F.explode("links").alias("node"), (F.col("copies") - 1).alias("extra"))
        .groupBy("node").agg(F.sum("extra").alias("extra"))
    )
    zero = F.lit(0).cast("long")
    counted = materialize(
        nodes.select("node", "embedding", "copies", "least").join(links.select("node", F.size("links").alias("n")), "node", "left")
        .join(materialize(more, "more"), "node", "left").join(linked, "node", "left")
        .select("embedding", "least", F.coalesce("component", "node").alias("component"),
                (F.coalesce("n", zero) + F.coalesce("extra", zero) + F.col("copies") - 1).alias("n_links")), "counted")
    ids = materialize(counted.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    named = materialize(counted.join(ids, "component").select("embedding", "n_links", "component_id"), "named")
    alone = typed.where(~_is_usable()).select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.join(named, "embedding").select("vec_id", "n_links", "component_id").unionByName(alone), recall


@query("op7_embedding_dedup")
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector; no SQL: the search is approximate, tests measure its recall against all pairs."""
    rows, recall = embedding_links(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "n_links", "component_id",
                       F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).alias("recall"))
