"""Source divergence audit: how far the terms of a source are from its language and from other sources, ranked by cells
of equal counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.registry import query, table
from tessera.session import materialize

#: Documents of a language that a kept term is in at least, added to each count, parts of a whole, and ranks of terms.
LEAST_DOCS, ADDED, SCALE, TOP = 10, 2, 1_000_000_000, 10
#: Words that a task counts together, and rows that it hands on at a time; they bound memory, not content.
HELD_WORDS, BATCH = 2_000_000, 50_000
#: ASCII other than letters ends a term; A-Z are lower-cased; all other bytes of UTF-8 belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by (lang, source), for ``HELD_WORDS`` words at a time: words are numbered,
    counted by document and then by group."""
    groups: dict[tuple[str, str], int] = {}
    words: list[bytes] = []
    lengths: list[int] = []
    group_of: list[int] = []

    def handed_on() -> Iterator[pa.RecordBatch]:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        by_doc = pa.table({"doc": doc, "term": coded.indices}).group_by(["doc", "term"], use_threads=False).aggregate([("term", "count")])
        group = np.array(group_of, np.int32)[by_doc["doc"].to_numpy()]
        summed = pa.table({"group": group, "term": by_doc["term"], "n": by_doc["term_count"]}).group_by(
            ["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
        lang, source = (pa.array([name[k] for name in groups], pa.string()).take(summed["group"]) for k in (0, 1))
        term = coded.dictionary.cast(pa.string()).take(summed["term"])
        out = pa.table([lang, source, term, summed["n_sum"], summed["n_count"]], names=["lang", "source", "term", "n", "docs"])
        yield from out.to_batches(max_chunksize=BATCH)

    for batch in batches:
        langs, sources = (batch.column(k).to_pylist() for k in (0, 1))
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            own = text.as_py().translate(_FOLD).split()
            words += own
            lengths.append(len(own))
            group_of.append(groups.setdefault((lang, source), len(groups)))
            if len(words) > HELD_WORDS:
                yield from handed_on()
                words, lengths, group_of = [], [], []
    if words:
        yield from handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``, written: occurrences and documents of every term in every (lang, source)."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    partial = given.mapInArrow(_counted, COUNTS)
    return materialize(
        partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + ADDED) / (n + ADDED * v))``, exact: decimals, since the product can outgrow a long."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")
    return F.call_function("div", top, (n + ADDED * v).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``, exact: shares are at most ``SCALE + 1``, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def ranked_terms(counts: DataFrame, langs: DataFrame, groups: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each group whose share is above the language's, by distance and then by term.

    Terms of a group with the same count there and in the language form a cell and share one value, worked out once.
    Cells of equal value are merged; values are ranked, each standing for as many terms as its cells hold, until ``top``
    terms are reached, and only the cells of these values are expanded into terms.
    """
    joined = counts.join(langs, ["lang", "term"])
    cells = joined.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms"))
    p, q = share(F.col("n"), F.col("group_total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    valued = materialize(
        cells.join(groups, ["lang", "source"]).join(sizes, "lang").select("*", p.alias("p"), q.alias("q")).where("p > q")
        .select("lang", "source", "n", "lang_n", "terms", distance(F.col("p"), F.col("q")).alias("value")), "cells")
    group = ["lang", "source"]
    merged = valued.groupBy(*group, "value").agg(F.sum("terms").alias("terms"))
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"))
    best = merged.withColumn("k", F.row_number().over(by_value)).where(F.col("k") <= top)
    before = F.coalesce(F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = materialize(best.withColumn("before", before).where(F.col("before") < top).select(*group, "value", "before"), "reached")
    wanted = materialize(valued.join(reached, [*group, "value"]).select(*group, "n", "lang_n", "value", "before"), "wanted-cells")
    inside = Window.partitionBy(*group, "value").orderBy("term")
    return (
        joined.join(wanted, [*group, "n", "lang_n"])
        .withColumn("place", F.row_number().over(inside)).where(F.col("place") <= top)
        .withColumn("rank", (F.col("before") + F.col("place")).cast("int")).where(F.col("rank") <= top)
        .select(*group, F.col("term").alias("item"), "value", "rank"))


def ranked_pairs(counts: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each group with every other source of its language, by the sum of distances over all kept terms.

    The sum is taken over cells of equal count pairs, each with its number of terms. Cells with both counts above zero
    come from terms that both sources hold; what they leave of a source's terms has the count zero in the other one, and
    the terms of the language that neither holds are the rest. Distances are symmetric: each pair is met once.
    """
    left = counts.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("na"))
    right = counts.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("nb"))
    pair = ["lang", "a", "b"]
    both = materialize(
        left.join(right, ["lang", "term"]).where("a < b").groupBy(*pair, "na", "nb").agg(F.count("*").alias("terms")), "pair-cells")
    one = lambda x: groups.select("lang", F.col("source").alias(x), F.col("group_total").alias(f"total_{x}"), F.col("held").alias(f"held_{x}"))
    pairs = materialize(one("a").join(one("b"), "lang").where("a < b").join(sizes, "lang"), "pairs")
    marginal = materialize(counts.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "count-cells")
    alone = []
    for x, y in (("a", "b"), ("b", "a")):
        every = pairs.select(*pair).join(marginal.withColumnRenamed("source", x), ["lang", x]).select(*pair, F.col("n").alias(f"n{x}"), "terms")
        met = both.groupBy(*pair, f"n{x}").agg((-F.sum("terms")).alias("terms"))
        rest = every.unionByName(met).groupBy(*pair, f"n{x}").agg(F.sum("terms").alias("terms")).where("terms > 0")
        alone.append(rest.withColumn(f"n{y}", F.lit(0).cast("long")).select(*pair, "na", "nb", "terms"))
    shared = both.groupBy(*pair).agg(F.sum("terms").alias("shared"))
    neither = pairs.join(shared, pair, "left").select(
        *pair, F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"),
        (F.col("v") - F.col("held_a") - F.col("held_b") + F.coalesce("shared", F.lit(0))).alias("terms"))
    cells = both.unionByName(alone[0]).unionByName(alone[1]).unionByName(neither).join(pairs, pair)
    # a language without kept terms has no shares: its pairs have one cell of no terms
    p, q = share(F.col("na"), F.col("total_a"), F.greatest("v", F.lit(1))), share(F.col("nb"), F.col("total_b"), F.greatest("v", F.lit(1)))
    sums = materialize(
        cells.select(*pair, "terms", p.alias("p"), q.alias("q")).groupBy(*pair)
        .agg(F.sum(F.col("terms") * distance(F.col("p"), F.col("q"))).alias("value")), "pair-sums")
    ways = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return ways.withColumn("rank", F.row_number().over(order)).select("lang", "source", "item", "value", "rank")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every (lang, source) of ``docs``: part ``pair`` ranks the other
    sources of the language, part ``term`` the ``top`` terms that set the source apart from its language.

    Terms are runs of letters and of code points above ASCII, A-Z lower-cased; those in at least ``least_docs`` documents
    of the language are kept. Null text, lang and source are empty strings, which are a language and a source like any
    other. Rows are documents, also where they repeat. Groups without terms take part with counts of zero; a language
    without kept terms gives pairs of value 0. Very long texts are counted whole in one task. Other columns are ignored.
    An empty table gives no rows.
    """
    counts = term_counts(docs)
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    langs = materialize(by_lang.where(F.col("docs") >= least_docs).drop("docs"), "lang-terms")
    kept = materialize(counts.drop("docs").join(langs.select("lang", "term"), ["lang", "term"]), "kept-counts")
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"), F.count("*").alias("held"))
    groups = materialize(every.join(totals, ["lang", "source"], "left").na.fill(0, ["group_total", "held"]), "groups")
    size = langs.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    sizes = materialize(groups.select("lang").distinct().join(size, "lang", "left").na.fill(0, ["lang_total", "v"]), "lang-sizes")
    pairs = ranked_pairs(kept, groups, sizes).withColumn("part", F.lit("pair"))
    terms = ranked_terms(kept, langs, groups, sizes, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


SQL_TEXT = r"""
with docs as (
    select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents
), words as (
    select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
    select lang, term, count(*)::hugeint as c from words group by lang, term having count(distinct row) >= 10
), groups as (select distinct lang, source from docs
), sizes as (
    select g.lang, coalesce(sum(c), 0)::hugeint as total, count(c)::hugeint as v
    from (select distinct lang from groups) g left join kept using (lang) group by g.lang
), counted as (
    select w.lang, w.source, w.term, count(*)::hugeint as c from words w join kept using (lang, term) group by all
), totals as (
    select g.lang, g.source, coalesce(sum(c), 0)::hugeint as total
    from groups g left join counted using (lang, source) group by all
), p as (
    select t.lang, t.source, k.term, coalesce(n.c, 0) as c, 1 + 1000000000 * (coalesce(n.c, 0) + 2) // (t.total + 2 * z.v) as p,
        1 + 1000000000 * (k.c + 2) // (z.total + 2 * z.v) as q
    from totals t join kept k using (lang) join sizes z using (lang)
    left join counted n on n.lang = t.lang and n.source = t.source and n.term = k.term
), sums as (
    select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
), pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
    select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where c > 0 and p > q
), ranked as (
    select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
    from (select * from pairs union all select * from terms)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""


@query("op13_source_divergence", SQL_TEXT)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other sources and outstanding terms of every source of ``documents``."""
    return source_divergence(table(spark, sf_dir, "documents"))
