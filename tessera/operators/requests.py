"""Question answering requests: build, look up, price and score them.

Requests and responses are DataFrames. Nothing here talks to a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_prediction, message_tokens, token_count

# Model limits and prices per 1000 tokens.
# name, kind, requests per minute, tokens per minute, input price, output price, context length, longest output
MODELS = [
    ("gpt-3.5-turbo-1106", "chat", 10000, 2000000, 0.001, 0.002, 16385, 4096),
    ("gpt-3.5-turbo-0125", "chat", 3000, 250000, 0.0005, 0.0015, 16385, 4096),
    ("gpt-3.5-turbo-instruct-0914", "completion", 3000, 250000, 0.0015, 0.002, 4096, None),
    ("gpt-4-0613", "chat", 10000, 300000, 0.03, 0.06, 8192, None),
    ("gpt-4-1106-preview", "chat", 10000, 600000, 0.01, 0.03, 128000, 4096),
    ("gpt-4-0125-preview", "chat", 10000, 600000, 0.01, 0.03, 128000, 4096),
]
# System messages of the two prompt layouts.
LIST_SYSTEM = (
    "You are a chatbot that answers questions based on the provided context tables. Provide just the answer value and"
    " no explanation! If the answer comprises multiple values, state them as a CSV string."
)
TABLE_SYSTEM = (
    "You are a chatbot that answers questions based on the provided context tables. Provide no explanations! State the"
    " answer as a CSV table! The column headers of the answer table are also provided below."
)
DEFAULT_MODEL = "gpt-4-1106-preview"
EXTRA_ANSWER_TOKENS = 20
CACHE_SIZE = 100_000


def models(spark: SparkSession) -> DataFrame:
    schema = (
        "model string, kind string, max_rpm long, max_tpm long, input_price double, output_price double,"
        " max_context long, max_output long"
    )
    return spark.createDataFrame(MODELS, schema)


def with_model(df: DataFrame) -> DataFrame:
    """Add limits and prices. A model without an entry fails the query (six fixed rows: a broadcast is safe)."""
    limits = models(df.sparkSession)
    joined = df.join(F.broadcast(limits.withColumn("_known", F.lit(True))), "model", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown model "), F.col("model")))
    # on every column: whichever of them a query keeps, the check stays with it
    checked = {
        f.name: F.when(F.col("_known"), F.col(f.name)).otherwise(unknown.cast(f.dataType))
        for f in limits.schema.fields
        if f.name != "model"
    }
    return joined.withColumns(checked).drop("_known")


def build_requests(
    instances: DataFrame, layout: str = "list", model: str = DEFAULT_MODEL, temperature: int = 0
) -> DataFrame:
    """Add system and user message, max_tokens, the request JSON and its SHA-256.

    ``instances``: ``information_need``, ``context``, ``answer`` (linearised) and, for the
    ``table`` layout, ``answer_columns``.
    """
    if layout == "list":
        system = LIST_SYSTEM
        user = F.concat(F.col("information_need"), F.lit("\n\n"), F.col("context"))
    elif layout == "table":
        system = TABLE_SYSTEM
        user = F.concat(
            F.col("information_need"), F.lit("\n\nThe result table must have the following columns: "),
            F.col("answer_columns"), F.lit("\n\nContext tables:\n\n"), F.col("context"),
        )
    else:
        raise ValueError(f"unknown prompt layout {layout}")
    wanted = token_count(F.col("answer")).cast("long") + EXTRA_ANSWER_TOKENS
    base = with_model(instances.withColumn("model", F.lit(model)))
    # least() skips nulls: models without an output limit keep the wanted length
    filled = (
        base.withColumn("system_message", F.lit(system))
        .withColumn("user_message", user)
        .withColumn("max_tokens", F.least(wanted, F.col("max_output")))
        .withColumn("output_capped", F.coalesce(wanted > F.col("max_output"), F.lit(False)))
    )

    def message(role: str, content: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))

    body = F.struct(
        "model", "max_tokens", F.lit(temperature).alias("temperature"),
        F.array(message("system", "system_message"), message("user", "user_message")).alias("messages"),
    )
    kept = [c for c in instances.columns if c != "model"]
    return (
        filled.withColumn("request", F.to_json(body))
        .withColumn("request_hash", F.sha2("request", 256))
        .select(*kept, "model", "system_message", "user_message", "max_tokens", "output_capped", "request", "request_hash")
    )


def input_tokens(messages: list[Column] | None = None, prompt: Column | None = None) -> Column:
    """Approximate input length: chat messages carry a surcharge each, a plain prompt does not."""
    if messages:
        total = message_tokens(messages[0])
        for m in messages[1:]:
            total = total + message_tokens(m)
        return total
    if prompt is None:
        raise ValueError("a request has messages or a prompt")
    return token_count(prompt)


def output_tokens(max_tokens: Column, tokens_in: Column) -> Column:
    """Longest possible output: the requested limit, else what context and model leave."""
    left = F.greatest(F.lit(0), F.col("max_context") - tokens_in)
    return F.coalesce(max_tokens, F.least(left, F.col("max_output")))


def limit_flags(requests: DataFrame) -> DataFrame:
    """Warnings of a request (``model``, ``tokens_in``, ``max_tokens``) against its model's limits."""
    r = with_model(requests)
    no = F.lit(False)
    return r.select(
        *requests.columns,
        (F.col("max_context") < F.col("tokens_in")).alias("input_too_long"),
        (F.col("max_context") == F.col("tokens_in")).alias("no_room_for_output"),
        F.coalesce(F.col("max_output") < F.col("max_tokens"), no).alias("output_limit_exceeded"),
        F.coalesce(F.col("max_context") < F.col("tokens_in") + F.col("max_tokens"), no).alias("context_exceeded"),
        output_tokens(F.col("max_tokens"), F.col("tokens_in")).alias("tokens_out"),
        (F.col("tokens_in") + output_tokens(F.col("max_tokens"), F.col("tokens_in"))).alias("tokens_total"),
    )


def request_costs(requests: DataFrame, choices: Column | None = None) -> DataFrame:
    """Upper cost bound of each request; ``choices`` is the number of completions (best_of, else n, else 1)."""
    r = with_model(requests)
    out = output_tokens(F.col("max_tokens"), F.col("tokens_in"))
    per = F.col("tokens_in") * (F.col("input_price") / 1000) + out * (F.col("output_price") / 1000)
    n = choices if choices is not None else F.lit(1)
    return r.select(*requests.columns, (n * per).alias("max_cost"))


def number_of_choices(best_of: Column, n: Column) -> Column:
    return F.coalesce(best_of, n, F.lit(1))


def response_costs(responses: DataFrame) -> DataFrame:
    """Cost and total tokens of each response JSON; one without usage costs nothing, an unknown model fails the query.

    A failed response names no model and has no usage.
    """
    usage = responses.withColumn("model", F.get_json_object("response", "$.model"))
    p = F.get_json_object("response", "$.usage.prompt_tokens").cast("long")
    c = F.get_json_object("response", "$.usage.completion_tokens").cast("long")
    joined = with_model(usage)
    cost = p * (F.col("input_price") / 1000) + c * (F.col("output_price") / 1000)
    return joined.select(
        *responses.columns, F.coalesce(p + c, F.lit(0)).alias("tokens_total"), F.when(p.isNull() | c.isNull(), F.lit(0.0)).otherwise(cost).alias("cost")
    )


def prediction(response: Column, layout: str = "list") -> Column:
    """What a response predicts: the text of its first choice, as canonical CSV in the ``table`` layout; null if it failed."""
    content = F.get_json_object(response, "$.choices[0].message.content")
    return clean_prediction(content) if layout == "table" else content


def is_failed(response: Column) -> Column:
    return F.get_json_object(response, "$.choices").isNull()


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their cached ``response``, requests to send).

    ``cache (request_hash, request, ts, response)`` may hold a request several times; the oldest
    entry of a hash answers, and only if the stored request equals the asked one.
    """
    oldest = cache.groupBy("request_hash").agg(F.min_by(F.struct("request", "response"), F.struct("ts", "request")).alias("_c"))
    joined = requests.join(oldest, "request_hash", "left").withColumn(
        "response", F.when(F.col("_c.request") == F.col("request"), F.col("_c.response"))
    ).drop("_c")
    return joined.filter("response IS NOT NULL"), joined.filter("response IS NULL").drop("response")


def retain_cache(cache: DataFrame, n: int = CACHE_SIZE) -> DataFrame:
    """The ``n`` newest entries. The oldest one to keep is found by time and hash alone, ``n`` narrow rows; responses are
    only filtered by it and never meet in one task."""
    keys = ["ts", "request_hash"]
    newest = cache.select(*keys).orderBy(*[F.desc(k) for k in keys]).limit(n)
    return cache.filter(F.struct(*keys) >= newest.agg(F.min(F.struct(*keys)).alias("oldest")).scalar())


def rolling_rate(log: DataFrame, seconds: int, share: float | None = None) -> DataFrame:
    """Requests and tokens of the same model in the trailing window of every request.

    ``log (model, ts, tokens)``. The time axis of a model is cut into slots; a slot also receives
    the rows of the ``seconds`` before it, so each window is complete inside its slot. Slots are three
    windows long: a third more rows, and a busy model is worked on by as many tasks as it has slots.
    With ``share``, an unknown model fails the query.
    """
    slot = 3 * seconds
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    width, span = slot * 1_000_000, seconds * 1_000_000
    own = F.floor(at / width).cast("long")
    also = F.floor((at + span) / width).cast("long")
    slots = F.when(also > own, F.array(own, also)).otherwise(F.array(own))
    spread = log.withColumn("_at", at).withColumn("_own", own).withColumn("_slot", F.explode(slots))
    window = Window.partitionBy("model", "_slot").orderBy("_at").rangeBetween(-span, 0)
    rated = spread.withColumn("n_requests", F.count(F.lit(1)).over(window)).withColumn(
        "n_tokens", F.sum("tokens").over(window)
    )
    kept = rated.filter(F.col("_slot") == F.col("_own")).drop("_at", "_own", "_slot")
    if share is None:
        return kept
    return with_model(kept).select(
        *kept.columns,
        (F.col("n_requests") > F.col("max_rpm") * share).alias("over_rpm"),
        (F.col("n_tokens") > F.col("max_tpm") * share).alias("over_tpm"),
    )
