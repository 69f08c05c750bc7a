"""Embeddings of cells, rows, columns, tables and tiles.

All pooling here is a mean, and means are linear. So a row, column, table or tile embedding equals
the mean, over its cells, of the weighted combination of what each cell carries (its value, its
column's name, its table's name, its parent's vectors). That turns every component into one
projection plus at most one partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import embedding_text, normalize_name, value_text
from tessera.functions.vectors import TextModel, divided, hashed_text, mean_vector, weighted_mean, weighted_sum, zero_vector
from tessera.operators.rectangles import TABLE
from tessera.operators.slicing import CONFIG, assign_to_grid
from tessera.operators.tiles import tile_cells
from tessera.session import materialize
from tessera.sources.lake import CELLS, Lake, cells_of_rows, column_catalog, melt

# Default weights of the parts of each component.
DEFAULT_WEIGHTS: dict[str, dict[str, float]] = {
    "table": {"table-name": 2, "col-names": 1, "cell-values": 1},
    "table-rows": {"cell-values": 1},
    "table-cols": {"col-names": 1, "cell-values": 1},
    "table-cells": {"col-names": 1, "cell-values": 1},
    "tile": {"table-name": 4, "col-names": 1, "cell-values": 1, "table-rows": 2},
    "tile-rows": {"cell-values": 1},
    "tile-cols": {"col-names": 1, "cell-values": 1},
    "tile-cells": {"table-name": 1, "col-names": 1, "cell-values": 2},
}

_ROW = [*TABLE, "row_id"]
_COL = [*TABLE, "col_pos"]
TABLE_KEYS = {"table": TABLE, "table-rows": _ROW, "table-cols": _COL, "table-cells": [*TABLE, "row_id", "col_pos"]}
TILE_KEYS = {
    "tile": [*TABLE, "tile_id"],
    "tile-rows": [*TABLE, "tile_id", "row_id"],
    "tile-cols": [*TABLE, "tile_id", "col_pos"],
    "tile-cells": [*TABLE, "tile_id", "row_id", "col_pos"],
}


@dataclass(frozen=True)
class Embedder:
    """A text model plus the weights that combine its vectors.

    ``model`` is any ``Column -> Column``: built-in expressions or a pandas UDF around a sentence
    model. With ``costly=True`` each distinct text is embedded once and joined back.
    """

    name: str = "hashed"
    model: TextModel = field(default_factory=lambda: hashed_text(16))
    dim: int = 16
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: DEFAULT_WEIGHTS)
    preprocess_names: bool = True
    costly: bool = False


def embed_texts(df: DataFrame, text: Column, out: str, embedder: Embedder) -> DataFrame:
    """Add the vector of ``text``."""
    if not embedder.costly:
        return df.withColumn(out, embedder.model(text))
    # 128 bits stand for a text, so that texts are moved once for each different one and not joined on
    parts = F.struct(F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(1), F.col("_text")).alias("b"))
    keyed = df.withColumn("_text", text).withColumn("_key", F.when(F.col("_text").isNotNull(), parts))
    different = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.first("_text").alias("_text"))
    vectors = different.select("_key", embedder.model(F.col("_text")).alias(out))
    return keyed.drop("_text").join(vectors, "_key", "left").drop("_key")


def embed_questions(ground_truths: DataFrame, embedder: Embedder, text: str = "information_need") -> DataFrame:
    return embed_texts(ground_truths, F.col(text), "vec", embedder)


def component_texts(cells: DataFrame, preprocess_names: bool = True) -> DataFrame:
    """Every cell with the three texts that are embedded for it."""
    return cells.select(
        *TABLE, "row_id", "col_pos",
        embedding_text(F.col("value")).alias("cell_text"),
        normalize_name(F.col("col_name"), preprocess_names).alias("col_text"),
        normalize_name(F.col("table_name"), preprocess_names).alias("table_text"),
    )


def _check(component: str, embedder: Embedder, known: Mapping[str, Sequence[str]]) -> Mapping[str, float]:
    if component not in known:
        raise ValueError(f"unknown component {component}")
    weights = embedder.weights.get(component, {})
    if not weights:
        raise ValueError(f"no parts to embed for {component}")
    return weights


def _divided(vec: Column, n: float) -> Column:
    return vec if n == 1 else F.transform(vec, lambda x: x / F.lit(float(n)))


#: Columns of a lake up to which the vectors of their names are sent to all tasks.
NAMES_SENT = 100_000


def name_vectors(lake: Lake, embedder: Embedder) -> DataFrame:
    """Vectors of the column and table names of a lake, one row per column: a name is embedded once and not per cell."""
    named = column_catalog(lake).select(
        *TABLE, "col_pos", embedder.model(normalize_name(F.col("col_name"), embedder.preprocess_names)).alias("_col_name"),
        embedder.model(normalize_name(F.col("table_name"), embedder.preprocess_names)).alias("_table_name"))
    return F.broadcast(named) if sum(len(lake.columns(t)) for t in lake.tables) <= NAMES_SENT else named


def _with_parts(
    cells: DataFrame, weights: Mapping[str, float], embedder: Embedder, ready: Mapping[str, str], names: DataFrame | None = None
) -> tuple[DataFrame, float]:
    """Add ``_vec``, the weighted sum of the parts of each cell; returns also the sum of the weights.

    ``ready`` names parts that are columns already; ``names`` are :func:`name_vectors`. The division is left to after the
    pooling.
    """
    if names is not None and {"col-names", "table-name"} & set(weights) - set(ready):
        cells = cells.join(names, [*TABLE, "col_pos"])
        ready = {"col-names": "_col_name", "table-name": "_table_name", **ready}
    texts = {
        "cell-values": embedding_text(F.col("value")),
        "col-names": normalize_name(F.col("col_name"), embedder.preprocess_names),
        "table-name": normalize_name(F.col("table_name"), embedder.preprocess_names),
    }
    parts = []
    df = cells
    for i, (part, weight) in enumerate(weights.items()):
        column = ready.get(part)
        if column is None:
            column = f"_part{i}"
            df = embed_texts(df, texts[part], column, embedder)
        parts.append((F.col(column), float(weight)))
    if len(parts) == 1:
        return df.withColumn("_vec", parts[0][0]), 1.0
    return df.withColumn("_vec", weighted_sum(parts, embedder.dim)), float(sum(w for _, w in parts))


def _pooled(summed: tuple[DataFrame, float], keys: Sequence[str], finest: bool, dim: int) -> DataFrame:
    df, total = summed
    pooled = df.select(*keys, F.col("_vec").alias("vec")) if finest else mean_vector(df, keys, "_vec", dim)
    if total == 1:
        return pooled
    return pooled.withColumn("vec", divided(F.col("vec"), total, dim))


def embed_rows(rows: DataFrame, embedder: Embedder, names: Sequence[str] | None = None) -> DataFrame:
    """``table-cells`` vectors of rows ``(lake, table_name, row_id, names, values)``, in their order; other columns are
    carried. With a model that is not costly this is a projection. Column names that all rows share can be given as
    ``names``: their vectors are then worked out once."""
    cells = cells_of_rows(rows)
    others = [c for c in cells.columns if c not in CELLS]
    ready = {}
    if names is not None and not embedder.costly:
        known = F.array(*[embedder.model(normalize_name(F.lit(n), embedder.preprocess_names)) for n in names])
        cells, ready = cells.withColumn("_col_name", F.element_at(known, F.col("col_pos") + 1)), {"col-names": "_col_name"}
    combined = _with_parts(cells, _check("table-cells", embedder, TABLE_KEYS), embedder, ready)
    return _pooled(combined, [*TABLE_KEYS["table-cells"], *others], True, embedder.dim)


def embed_table(cells: DataFrame, component: str, embedder: Embedder, names: DataFrame | None = None) -> DataFrame:
    """``table``, ``table-rows``, ``table-cols`` or ``table-cells`` vectors of all tables in ``cells``."""
    weights = _check(component, embedder, TABLE_KEYS)
    combined = _with_parts(cells, weights, embedder, {}, names)
    return _pooled(combined, TABLE_KEYS[component], component == "table-cells", embedder.dim)


def embed_wide_rows(lake: Lake, embedder: Embedder) -> DataFrame:
    """``table-rows`` vectors straight from wide tables: a projection per row, nothing is shuffled."""
    weights = _check("table-rows", embedder, TABLE_KEYS)
    if embedder.costly:
        return embed_table(melt(lake), "table-rows", embedder)

    def name_vector(name: str) -> Column:
        return embedder.model(normalize_name(F.lit(name), embedder.preprocess_names))

    def total(vectors: Column) -> Column:
        zero = F.array(*[F.lit(0.0)] * embedder.dim)
        return F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))

    def value_total(texts: list[Column]) -> Column:
        of_texts = getattr(embedder.model, "total", None)  # a model may add up texts by itself
        return of_texts(texts) if of_texts else total(F.transform(F.array(*texts), embedder.model))

    parts = []
    for table, df in lake.tables.items():
        columns = lake.columns(table)
        types = {f.name: f.dataType for f in df.schema.fields}
        sources = {
            "cell-values": lambda: value_total([embedding_text(value_text(F.col(c), types[c])) for c in columns]),
            "col-names": lambda: total(F.array(*[name_vector(c) for c in columns])),
            "table-name": lambda: name_vector(table),
        }
        sizes = {"cell-values": len(columns), "col-names": len(columns), "table-name": 1}
        # written out by component: inside of a lambda the same digest would be worked out for each
        means = [(divided(sources[part](), sizes[part], embedder.dim), float(w)) for part, w in weights.items()]
        parts.append(
            df.select(F.lit(lake.name).alias("lake"), F.lit(table).alias("table_name"), "row_id", weighted_mean(means, embedder.dim).alias("vec"))
        )
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def embed_tiles(
    cells: DataFrame, spans: DataFrame, component: str, embedder: Embedder, names: DataFrame | None = None
) -> DataFrame:
    """``tile``, ``tile-rows``, ``tile-cols`` or ``tile-cells`` vectors of arbitrary tiles.

    Parent vectors are joined on the key they belong to; the parent rows use the same key as the
    tile membership join, so the cells are not shuffled again for them.
    """
    weights = _check(component, embedder, TILE_KEYS)
    inside = tile_cells(spans, cells)
    ready = {}
    for part, keys in TABLE_KEYS.items():
        if part in weights:
            parent = embed_table(cells, part, embedder, names).withColumnRenamed("vec", f"_{part}")
            inside = inside.join(parent, list(keys))
            ready[part] = f"_{part}"
    combined = _with_parts(inside, weights, embedder, ready, names)
    return _pooled(combined, TILE_KEYS[component], component == "tile-cells", embedder.dim)


def embed_grid_tiles(cells: DataFrame, strides: DataFrame, embedder: Embedder, names: DataFrame | None = None) -> DataFrame:
    """Tile vectors of grid slicings, all configurations at once, without a membership join.

    The mean of the parent's row vectors over a row block is the mean over all cells of the block
    (rows are equally wide), so row vectors are never built. Cells are read once: sums per tile are combined
    map-side and written, and the row blocks are added up from them.
    """
    weights = dict(_check("tile", embedder, TILE_KEYS))
    row_weight = weights.pop("table-rows", None)
    if set(weights) & set(TABLE_KEYS):
        raise ValueError("only table-rows may be pooled from the parent table here; use embed_tiles")
    tile_key = [*TABLE, *CONFIG, "row_block", "col_block"]
    assigned = assign_to_grid(cells, strides)
    cells_sum, own_weight = _with_parts(assigned, weights, embedder, {}, names)
    tile_id = F.concat_ws("/", "table_name", "row_block", "col_block").alias("tile_id")
    if row_weight is None:
        own = mean_vector(cells_sum, tile_key, "_vec", embedder.dim, "own")
        return own.select(*tile_key, tile_id, _divided(F.col("own"), own_weight).alias("vec"))
    row_weights = _check("table-rows", embedder, TABLE_KEYS)
    block_key = [*TABLE, *CONFIG, "row_block"]
    # the vector of a value is worked out once for both
    values = {"cell-values": "_values"} if "cell-values" in weights else {}
    held = [F.col(f"_part{list(weights).index(part)}").alias(column) for part, column in values.items()]
    kept = cells_sum.select(*assigned.columns, F.col("_vec").alias("_own"), *held)
    rows_sum, rows_weight = _with_parts(kept, row_weights, embedder, values, names)
    both = rows_sum.select(*tile_key, F.concat("_own", "_vec").alias("_both"))
    pooled = mean_vector(both, tile_key, "_both", 2 * embedder.dim, "_both", count="_n")
    tiles = materialize(pooled, "tile-means")
    own = tiles.select(*tile_key, F.slice("_both", 1, embedder.dim).alias("own"))
    sums = F.transform(F.slice("_both", embedder.dim + 1, embedder.dim), lambda x: x * F.col("_n"))
    per_tile = tiles.select(*block_key, "_n", sums.alias("_sums"))
    cells_of = per_tile.groupBy(*block_key).agg(F.sum("_n").alias("_cells"), F.count(F.lit(1)).alias("_tiles"))
    blocks = mean_vector(per_tile, block_key, "_sums", embedder.dim, "_mean").join(cells_of, block_key).select(
        *block_key, F.transform("_mean", lambda x: x * F.col("_tiles") / F.col("_cells")).alias("rows"))
    if len(weights) == 1:  # a single part comes without its weight
        own_weight = float(sum(weights.values()))
        own = own.withColumn("own", F.transform("own", lambda x: x * F.lit(own_weight)))
    both = F.zip_with("own", "rows", lambda x, y: x + y * F.lit(float(row_weight) / rows_weight))
    vec = _divided(both, own_weight + float(row_weight))
    return own.join(blocks, block_key).select(*tile_key, tile_id, vec.alias("vec"))


def embed_zero(components: DataFrame, keys: Sequence[str], dim: int = 10) -> DataFrame:
    """The baseline that embeds everything as zeros."""
    return components.select(*keys, zero_vector(dim).alias("vec"))


def missing_embeddings(components: DataFrame, done: DataFrame, keys: Sequence[str], embedder: Embedder) -> DataFrame:
    """Components this embedder has not embedded yet (``done`` holds the keys and ``embedder_id``)."""
    own = done.filter(F.col("embedder_id") == embedder.name).select(*keys)
    return components.join(own, list(keys), "left_anti")
