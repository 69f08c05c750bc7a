"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, posteriors decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.registry import query, table
from tessera.session import materialize

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30

# Frequent function words of English, German, French and Spanish
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "with", "for", "as", "was", "on", "are", "be", "this", "by",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "nicht", "ein", "eine", "dem", "ist",
    "le", "la", "les", "et", "un", "une", "du", "que", "qui", "dans", "pour", "par", "sur", "au", "avec", "elle", "il",
    "el", "los", "las", "y", "que", "de", "en", "por", "con", "no", "se", "del", "una", "su", "lo", "como", "es",
)

#: Rule -> (condition of a good vote, condition of a bad vote); where neither holds the rule abstains.
RULES = {
    "length": ("n_words >= 50", "n_words < 20"),
    "symbols": ("20 * n_symbols <= n_words", "4 * n_symbols > n_words"),
    "repeats": ("20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "lines": ("n_dup_lines = 0", "4 * n_dup_lines > n_lines"),
    "capitals": ("10 * n_upper <= word_chars", "3 * n_upper > word_chars"),
    "function_words": ("10 * n_function >= n_words", "50 * n_function < n_words"),
    "variety": ("3 * n_distinct >= n_words", "10 * n_distinct < n_words and cast(n_distinct as bigint) * n_distinct < 20 * n_words"),
    "exclamations": ("50 * n_bangs <= n_words", "4 * n_bangs > n_words"),
    "word_length": ("word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
}

ROUNDS = 25
#: Prior belief in a rule: share of good documents it calls good, of bad ones it calls bad, and its weight in documents.
GOOD_CALLED_GOOD, BAD_CALLED_BAD, PRIOR_WEIGHT = 0.98, 0.3, 20.0
#: Prior share of good documents, with the same weight.
GOOD_SHARE = 0.9
#: Limits of the estimates: a bad vote always speaks against a document, and no vote decides for certain.
GOOD_LIMITS, BAD_LIMITS, SHARE_LIMITS = (0.92, 0.999), (0.1, 0.95), (0.05, 0.99)
KEEP_FROM = 0.5


def bound_to(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where a lambda inside ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``size`` words found twice or more in the text.

    Windows are told apart by their 64-bit hash. Equal ones become neighbours when sorted; words of repeated windows
    are counted once by the distances of their sorted starts. Texts without a repeated window are not sorted.
    """

    def starts_to_words(starts: Column) -> Column:
        lengths = F.transform(starts, lambda s, k: F.least(F.lit(size), F.coalesce(F.get(starts, k + 1) - s, F.lit(size))))
        return F.aggregate(lengths, F.lit(0), lambda total, n: total + n)

    def repeated(pairs: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return bound_to(F.sort_array(F.transform(twice, lambda x: x["s"])), starts_to_words)

    def of_windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("s")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bound_to(F.sort_array(pairs), repeated))

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - size + 1)
        return F.when(F.size(w) <= size, F.lit(0)).otherwise(
            bound_to(F.transform(starts, lambda s: F.xxhash64(F.slice(w, s, F.lit(size)))), of_windows))

    return bound_to(words, of_words)


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with counts of words, lines and characters (long). A null text has no words, lines or characters."""
    read = F.coalesce(F.col("text"), F.lit(""))
    with_word = F.filter(F.split(read, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    split = docs.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", with_word)
    count = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.length(F.regexp_replace(read, SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_lines": F.size("_lines"),
        "n_upper": F.length(F.regexp_replace(read, "\\P{Lu}+", "")),
        "n_function": F.size(F.filter("_words", lambda w: F.lower(w).isin(*dict.fromkeys(FUNCTION_WORDS)))),
        "n_distinct": F.size(F.array_distinct("_words")),
        "n_bangs": F.length(F.regexp_replace(read, "[^!]+", "")),
    }
    return split.select(*docs.columns, *[c.cast("long").alias(n) for n, c in count.items()])


def votes() -> Column:
    """One vote for each rule: 1 good, 0 bad, -1 none."""
    return F.array(*[F.when(F.expr(bad), 0).when(F.expr(good), 1).otherwise(-1) for good, bad in RULES.values()])


def log_odds(vote: Column, weights: Column) -> Column:
    """Log odds of a good document, given ``weights(share, good, bad)``."""
    total = F.ln(weights["share"] / (1 - weights["share"]))
    for r in range(len(RULES)):
        good, bad = weights["good"][r], weights["bad"][r]
        total += F.when(vote[r] == 1, F.ln(good / (1 - bad))).when(vote[r] == 0, F.ln((1 - good) / bad)).otherwise(0.0)
    return total


def _within(value: Column, limits: tuple[float, float]) -> Column:
    return F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), value))


def _round(patterns: Column, weights: Column) -> Column:
    """One round: posteriors of all patterns, then new estimates from them."""

    def estimate(shared: Column) -> Column:
        total = lambda term: F.aggregate(F.transform(shared, term), F.lit(0.0), lambda x, y: x + y)
        count = lambda r, kind, *calls: total(lambda x: F.when(x["votes"][r].isin(*calls), x[kind]).otherwise(0.0))
        rate = lambda r, kind, call, prior: (count(r, kind, call) + PRIOR_WEIGHT * prior) / (count(r, kind, 0, 1) + PRIOR_WEIGHT)
        good, bad = total(lambda x: x["good"]), total(lambda x: x["bad"])
        return F.struct(
            _within((good + PRIOR_WEIGHT * GOOD_SHARE) / (good + bad + PRIOR_WEIGHT), SHARE_LIMITS).alias("share"),
            F.array(*[_within(rate(r, "good", 1, GOOD_CALLED_GOOD), GOOD_LIMITS) for r in range(len(RULES))]).alias("good"),
            F.array(*[_within(rate(r, "bad", 0, BAD_CALLED_BAD), BAD_LIMITS) for r in range(len(RULES))]).alias("bad"))

    def split(x: Column) -> Column:
        return bound_to(1 / (1 + F.exp(-log_odds(x["votes"], weights))), lambda p: F.struct(
            x["votes"].alias("votes"), (x["n"] * p).alias("good"), (x["n"] * (1 - p)).alias("bad")))

    return bound_to(F.transform(patterns, split), estimate)


def estimated(voted: DataFrame) -> DataFrame:
    """One row ``weights``: what expectation-maximisation finds for ``voted(votes)``.

    Documents are counted by their votes first, so that its input has at most three to the number of rules rows,
    whatever the corpus; all rounds are one expression over these. Without documents the priors come out.
    """
    counted = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    flat = lambda value: F.array(*[F.lit(value)] * len(RULES))
    start = F.struct(F.lit(GOOD_SHARE).alias("share"), flat(GOOD_CALLED_GOOD).alias("good"), flat(BAD_CALLED_BAD).alias("bad"))
    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda w, _: _round(F.col("patterns"), w)).alias("weights"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _with_posterior(voted: DataFrame, weights: DataFrame) -> DataFrame:
    """Estimates are one row of numbers, so they become literals."""
    found = weights.first()["weights"]
    as_column = F.struct(F.lit(found["share"]).alias("share"), F.array(*map(F.lit, found["good"])).alias("good"),
                         F.array(*map(F.lit, found["bad"])).alias("bad"))
    return voted.withColumn("quality", 1 / (1 + F.exp(-log_odds(F.col("votes"), as_column))))


def assess(docs: DataFrame) -> DataFrame:
    """Counts, votes, ``quality`` (posterior of being good), ``base_failed`` and ``kept`` for each row of
    ``docs(doc_id, text)``.

    A null or empty text has zero words and fails the base. Rows that repeat or lack ``doc_id`` are judged like others;
    other columns are ignored. An empty table gives no rows. Two rows with equal votes have equal quality.
    """
    voted = materialize(features(docs.select("doc_id", "text")).drop("text").withColumn("votes", votes()), "votes")
    judged = _with_posterior(voted, estimated(voted))
    return judged.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def good_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without those that fail the base or are more likely bad than good, estimated on the same documents."""
    voted = features(docs.select(F.struct(*docs.columns).alias("doc"), "text")).drop("text").withColumn("votes", votes())
    voted = materialize(voted, "votes")  # with all counts: a count that is not written is worked out where it is used
    judged = _with_posterior(voted, estimated(voted.select("votes")))
    return judged.where(~base_failed() & (F.col("quality") >= KEEP_FROM)).select("doc.*")


def _sql() -> str:
    """The same in DuckDB: windows unnested and grouped, estimation as a recursive query."""
    rules = range(1, len(RULES) + 1)
    vote = ", ".join(f"case when {bad} then 0 when {good} then 1 else -1 end" for good, bad in RULES.values())
    odds = "ln(share / (1 - share))" + "".join(
        f" + case votes[{r}] when 1 then ln(good[{r}] / (1 - bad[{r}])) when 0 then ln((1 - good[{r}]) / bad[{r}]) else 0 end" for r in rules)
    within = lambda value, limits: f"greatest({limits[0]}, least({limits[1]}, {value}))"
    rate = lambda r, call, weight, prior: (
        f"(sum(case when votes[{r}] = {call} then {weight} else 0 end) + {PRIOR_WEIGHT} * {prior}) / "
        f"(sum(case when votes[{r}] >= 0 then {weight} else 0 end) + {PRIOR_WEIGHT})")
    flat = lambda value: f"[{', '.join([str(value) + '::double'] * len(RULES))}]"
    known = ", ".join(f"'{w}'" for w in dict.fromkeys(FUNCTION_WORDS))
    return f"""
with recursive split as materialized (
  select doc_id, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as s from split where len(words) >= {WINDOW}),
windows as (select doc_id, s, array_to_string(words[s:s + {WINDOW - 1}], ' ') as w from starts),
twice as (select doc_id, s from windows qualify count(*) over (partition by doc_id, w) > 1),
gaps as (select doc_id, least({WINDOW}, coalesce(lead(s) over (partition by doc_id order by s) - s, {WINDOW})) as n from twice),
repeats as (select doc_id, sum(n)::bigint as n from gaps group by 1),
counted as materialized (
  select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(text, '{SYMBOLS}', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words,
         len(lines) as n_lines, length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) as n_upper,
         len(list_filter(words, lambda w: lower(w) in ({known}))) as n_function, len(list_distinct(words)) as n_distinct,
         length(regexp_replace(text, '[^!]+', '', 'g')) as n_bangs
  from split left join repeats using (doc_id)),
voted as materialized (select *, [{vote}] as votes from counted),
patterns as materialized (select votes, count(*)::double as n from voted group by votes),
rounds(k, share, good, bad) as (
  select 0, {GOOD_SHARE}::double, {flat(GOOD_CALLED_GOOD)}, {flat(BAD_CALLED_BAD)}
  union all
  select k + 1, {within(f"(sum(g) + {PRIOR_WEIGHT} * {GOOD_SHARE}) / (sum(g) + sum(b) + {PRIOR_WEIGHT})", SHARE_LIMITS)},
         [{", ".join(within(rate(r, 1, "g", GOOD_CALLED_GOOD), GOOD_LIMITS) for r in rules)}],
         [{", ".join(within(rate(r, 0, "b", BAD_CALLED_BAD), BAD_LIMITS) for r in rules)}]
  from (select k, votes, n * p as g, n * (1 - p) as b
        from (select k, votes, n, 1 / (1 + exp(-({odds}))) as p from rounds, patterns where k < {ROUNDS}))
  group by k),
judged as (
  select voted.*, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
         1 / (1 + exp(-({odds}))) as quality
  from voted, (select share, good, bad from rounds where k = {ROUNDS}) as last)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and quality >= {KEEP_FROM} as kept
from judged
"""


@query("op1_quality_rules", _sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
