"""Linearising, packing, requests and responses."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions.text import answer_text, clean_prediction as clean, list_answer, token_count, truncate_tokens as truncate
from tessera.operators import evaluation, packing, provenance, requests, retrieval, slicing
from tessera.plans.corpus import (
    BLOCKS, DIM, EMBEDDER, ORDER_COLUMNS, STAR, STAR_COLUMNS, TOKEN, order_rows, sql_cells, sql_hash, sql_order_cells, sql_tables, star_lake, table,
)
from tessera.plans.embeddings import sql_grid_tiles
from tessera.plans.ranking import SQL_RANKED, document_tiles, ranked_documents, sql_perfect
from tessera.plans.registry import query
from tessera.session import checkpoint_dir, materialize
from tessera.sources.lake import catalog, catalog_of_rows
from tessera.streaming.rates import flag_limits, windowed_rate
from tessera.workflows import AnswerConfig, GridSlicer, TruthIndex, prepare_requests, score_requests, select_context


def _sql_field(expr: str) -> str:
    return (
        f"case when {expr} is null then '' when regexp_matches({expr}, '[\",\\r\\n]') then '\"' || replace({expr}, '\"', '\"\"') || '\"' else {expr} end"
    )


def _sql_tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))"


@query(
    "linearize_csv",
    f"with {sql_tables()} "
    + " union all ".join(
        f"select '{t}' as table_name, row_id, " + " || ',' || ".join(_sql_field(f"{c}::varchar") for c in STAR_COLUMNS[t]) + f" as line from t_{t}" for t in STAR
    )
    + "".join(f" union all select '{t}', -1, '{','.join(STAR_COLUMNS[t])}'" for t in STAR),
)
def linearize_csv(spark, sf_dir):
    lake = star_lake(spark, sf_dir)
    return packing.csv_headers(lake).unionByName(packing.csv_lines(packing.wide_rows(lake))).drop("lake")


@query(
    "linearize_tiles",
    f"with {sql_order_cells()}, line as (select table_name, row_id, string_agg({_sql_field('value')}, ',' order by col_pos) as line, string_agg(col_name, ',' order by col_pos) as header from cells group by all),"
    f" tile as (select table_name, count(*) * {len(ORDER_COLUMNS)} as num_cells, any_value(header) as header, string_agg(line, chr(10) order by row_id) as body from line group by table_name)"
    " select table_name, num_cells, 'table: \"' || table_name || '\"' || chr(10) || chr(10) || header || chr(10) || body || chr(10) || chr(10) as text from tile",
)
def linearize_tiles(spark, sf_dir):
    rows = order_rows(spark, sf_dir)
    tables = materialize(catalog_of_rows(rows), "tables")
    spans = slicing.grid_tiles(slicing.grid(tables, [("none", 1)])).select("lake", "table_name", "tile_id", "row_lo", "row_hi", "cols")
    return packing.linearize_tiles(spans, rows).select("table_name", "num_cells", "text")


@query("linearize_list", "select doc_id, lang || ',' || source || ',' || n_chars as answer from documents")
def linearize_list(spark, sf_dir):
    values = F.array("lang", "source", F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", list_answer(values).alias("answer"))


_SAID = "role || ' said: \"' || text || '\"' || chr(10) || chr(10) || 'end, of turn ' || turn"


@query(
    "clean_prediction",
    f"with t as (select conv_id, turn, {_sql_field(f'({_SAID})')} as said, role from conversations)"
    " select conv_id, md5('who,\"what, exactly\",more' || chr(10) || string_agg(role || ',' || said || ',', chr(10) order by turn) || chr(10)) as prediction_md5 from t group by conv_id",
)
def clean_prediction(spark, sf_dir):
    """Conversations as a model might write them (every field quoted, ``\\r\\n``, blank lines, a fence, short lines); the
    check writes the expected text from the turns and parses nothing."""
    said = F.concat("role", F.lit(' said: "'), "text", F.lit('"\n\nend, of turn '), "turn")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(",", quoted(F.col("role")), quoted(said)).alias("line"))
    listed = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    body = F.concat(F.lit('who,"what, exactly","more"\r\n'), F.array_join("lines.line", "\r\n \t\r\n\r\n"), F.lit("\r\n"))
    prediction = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("```csv\n"), body, F.lit("```"))).otherwise(body)
    return listed.select("conv_id", F.md5(clean(prediction)).alias("prediction_md5"))


@query("token_counts", f"select doc_id, {_sql_tokens('text')} as tokens, {_sql_tokens('text')} + 10 as message_tokens from documents")
def token_counts(spark, sf_dir):
    tokens = token_count(F.col("text")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), (tokens + 10).alias("message_tokens"))


@query(
    "truncate_tokens",
    r"select doc_id, md5(array_to_string(regexp_extract_all(text, '\s*(?:\w+|[^\w\s])')[1:100], '')) as text_md5 from documents",
)
def truncate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(truncate(F.col("text"), 100)).alias("text_md5"))


_SQL_RANKED_TOKENS = (
    f"{SQL_RANKED}, tok as (select 'doc-' || doc_id as tile_id, {_sql_tokens('text')} as tokens from documents),"
    " rt as (select lake, gt_name, rank, tile_id, tokens from ranked join tok using (tile_id) where rank <= 2000)"
)


def _ranked_tokens(spark, sf_dir):
    tokens = document_tiles(spark, sf_dir).select("lake", "tile_id", token_count(F.col("text")).cast("long").alias("tokens"))
    return ranked_documents(spark, sf_dir).join(tokens, ["lake", "tile_id"])


@query(
    "running_tokens",
    f"with {_SQL_RANKED_TOKENS} select lake, gt_name, rank, cast(sum(tokens) over (partition by lake, gt_name order by rank) as bigint) as running from rt",
)
def running_tokens(spark, sf_dir):
    return packing.running_tokens(_ranked_tokens(spark, sf_dir)).select("lake", "gt_name", "rank", "running")


@query(
    "pack_greedy",
    f"with recursive {_SQL_RANKED_TOKENS}, lim as (select lake, gt_name, count(*) as n_candidates from rt group by all),"
    " walk as (select lake, gt_name, 0 as rank, 0::bigint as used, ''::varchar as ranks, 0 as last from lim"
    " union all select w.lake, w.gt_name, rt.rank::int, case when w.used + rt.tokens <= 1000 then w.used + rt.tokens else w.used end,"
    " case when w.used + rt.tokens <= 1000 then w.ranks || ',' || rt.rank else w.ranks end, case when w.used + rt.tokens <= 1000 then rt.rank::int else w.last end"
    " from walk w join rt on rt.lake = w.lake and rt.gt_name = w.gt_name and rt.rank = w.rank + 1)"
    " select lake, gt_name, n_candidates, used, substr(ranks, 2) as ranks, n_candidates - last <= 10 as near_end from walk join lim using (lake, gt_name) where rank = n_candidates",
)
def pack_greedy(spark, sf_dir):
    packed = packing.pack_greedy(_ranked_tokens(spark, sf_dir), 1000)
    return packed.select("lake", "gt_name", "n_candidates", "used", F.array_join("ranks", ",").alias("ranks"), "near_end")


_TILES, _BUDGET = 1000, 3000


def _sql_costs(lake: str = "star") -> str:
    """``lines``, ``tile_cost`` and ``head``: text and tokens of every line, of row-wise tiles and of what stands before.

    Needs the tables and ``g (table_name, s)``, the rows of a tile.
    """
    field = _sql_field("value")
    return (
        f"{sql_cells(STAR, lake)}, lines as (select table_name, row_id, string_agg({field}, ',' order by col_pos) as line,"
        f" sum({_sql_tokens(field)}) + count(*) - 1 as n from cells group by all),"
        " tile_cost as (select table_name, table_name || '/' || (row_id // s) || '/0' as tile_id, cast(sum(n) as bigint) as body, count(*) as n_rows from lines join g using (table_name) group by all),"
        " names as (select table_name, col_pos, any_value(col_name) as col_name from cells group by all),"
        f" head as (select table_name, string_agg(col_name, ',' order by col_pos) as header, count(*) as n_cols, cast(sum({_sql_tokens('col_name')}) + count(*) - 1"
        f" + {_sql_tokens(chr(39) + 'table: ' + chr(34) + chr(39) + ' || table_name || ' + chr(39) + chr(34) + chr(39))} as bigint) as head from names group by table_name)"
    )


# row-wise tiles are as wide as their table, so merging two of them adds their rows and saves one header
_SQL_WALK = (
    "rt as (select gt_name, rank, tile_id, table_name, body, n_rows * n_cols as cells, head from ranked join tile_cost using (tile_id) join head using (table_name) where rank <= 2000),"
    " lim as (select gt_name, count(*) as n_candidates from rt group by all),"
    " walk as (select gt_name, 0::bigint as rank, 0::bigint as used, []::bigint[] as ranks, []::varchar[] as tables, 0::bigint as n_cells from lim"
    " union all select gt_name, rank, case when fits then cost else used end, case when fits then list_append(ranks, rank) else ranks end,"
    " case when fits and not held then list_append(tables, table_name) else tables end, case when fits then n_cells + cells else n_cells end"
    " from (select w.gt_name, rt.rank, w.used, w.ranks, w.tables, w.n_cells, rt.cells, rt.table_name, list_contains(w.tables, rt.table_name) as held,"
    " w.used + rt.body + case when list_contains(w.tables, rt.table_name) then 0 else rt.head end as cost,"
    f" w.used + rt.body + case when list_contains(w.tables, rt.table_name) then 0 else rt.head end <= {_BUDGET} as fits"
    " from walk w join rt on rt.gt_name = w.gt_name and rt.rank = w.rank + 1)),"
    " packed as (select gt_name, n_candidates, used, ranks, len(tables) as n_tables, n_cells, n_candidates - coalesce(list_max(ranks), 0) <= 10 as near_end"
    " from walk join lim using (gt_name) where rank = n_candidates)"
)
_SQL_PERFECT_RANKED = (
    f"{sql_perfect(_TILES)}, {_sql_costs()}, ranked as (select gt_name, tile_id, row_number() over (partition by gt_name order by distance, tile_id) as rank from d)"
).replace(", names as (select distinct gt_name", ", truth_names as (select distinct gt_name").replace("from names cross join sizes", "from truth_names cross join sizes")


def closure_input(spark, sf_dir):
    lake = star_lake(spark, sf_dir)
    strides = slicing.grid(catalog(lake), [("rowwise", _TILES)])
    tiles = slicing.grid_tiles(strides)
    truth_cols = provenance.provenance_columns(lake, BLOCKS)
    hits = materialize(slicing.grid_hits(strides, provenance.provenance_rows(lake, BLOCKS), truth_cols), "hits")
    ranked = materialize(retrieval.retrieve_perfect(hits, tiles.select("lake", "tile_id", "num_cells"), truth_cols), "ranked")
    spans = tiles.select("lake", "table_name", "tile_id", "row_lo", "row_hi", "cols")
    return ranked, spans, packing.row_tokens(packing.wide_rows(lake))


@query(
    "pack_closure",
    f"with recursive {_SQL_PERFECT_RANKED}, {_SQL_WALK} select gt_name, n_candidates, used, array_to_string(ranks, ',') as ranks, n_tables::int as n_tables, n_cells, near_end from packed",
)
def pack_closure(spark, sf_dir):
    packed = packing.pack_closure(*closure_input(spark, sf_dir), budget=_BUDGET)
    return packed.select("gt_name", "n_candidates", "used", F.array_join("ranks", ",").alias("ranks"), "n_tables", "n_cells", "near_end")


@query(
    "answer_run",
    f"with recursive {_SQL_PERFECT_RANKED}, {_SQL_WALK}, widths as (select gt_name, table_name, count(*) as w from truth_cols group by all),"
    " truth as (select gt_name, cast(sum(w) as bigint) as wanted, count(*) as n from truth_rows join widths using (gt_name, table_name) group by gt_name),"
    " got as (select gt_name, cast(sum(coalesce(num_in, 0)) as bigint) as tp from (select gt_name, unnest(ranks) as rank from packed) p join rt using (gt_name, rank) left join hits using (gt_name, tile_id) group by gt_name),"
    " r as (select gt_name, coalesce(n, 0) as n, coalesce(wanted, 0) as wanted, coalesce(tp, 0) as tp, len(ranks) as taken, n_tables, n_cells, near_end, (select cast(sum(num_cells) as bigint) from tables) as lake_cells"
    " from packed left join truth using (gt_name) left join got using (gt_name))"
    " select gt_name, 'n' || chr(10) || n || chr(10) as answer, 'n' || chr(10) || case when n % 2 = 0 then n::varchar else '\"about, ' || n || '\"' end || chr(10) as prediction,"
    " (n % 2 = 0)::int::bigint as correct, taken::int as num_retrieved_tiles, n_tables::bigint as num_result_tiles, n_cells as num_result_cells, wanted as num_ground_truth_cells,"
    " tp as \"TP\", n_cells - tp as \"FP\", wanted - tp as \"FN\", lake_cells - n_cells - wanted + tp as \"TN\", near_end,"
    f" 'rowwise' as slicer, 'ground-truth' as \"index\", 'closure' as merger, '{_TILES}' as \"TpT\", '{_BUDGET}' as tok from r",
)
def answer_run(spark, sf_dir):
    """A whole run: every ground truth is asked for its number of rows, the best tiles are packed, responses come back as
    fenced and quoted CSV (half of them wrong), and result rows are scored. Stages are written under a root of the run."""
    lake = star_lake(spark, sf_dir)
    truth = materialize(provenance.ground_truth_tiles(lake, BLOCKS), "truth")
    names = provenance.provenance_columns(lake, BLOCKS).select("lake", "gt_name").distinct()
    counted = provenance.provenance_rows(lake, BLOCKS).groupBy("lake", "gt_name").agg(F.count(F.lit(1)).alias("n"))
    asked = names.join(counted, ["lake", "gt_name"], "left").fillna(0, ["n"])
    questions = asked.select(
        "lake", "gt_name", F.concat(F.lit("How many rows has "), "gt_name", F.lit("?")).alias("information_need"), "n",
        answer_text(F.create_map(F.lit("n"), F.array(F.col("n").cast("string")))).alias("answer"), F.lit("n").alias("answer_columns"))
    config = AnswerConfig(slicer=GridSlicer("rowwise", _TILES), index=TruthIndex(), context_tokens=_BUDGET, embedder=EMBEDDER, layout="table")
    root = os.path.join(checkpoint_dir(spark), f"run-{uuid.uuid4().hex}")
    prepared, result = prepare_requests(lake, questions, config, truth, root)
    prepared = materialize(prepared, "prepared")
    said = F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).otherwise(F.concat(F.lit("about, "), "n"))
    content = F.concat(F.lit('```csv\r\n"n"\r\n\r\n"'), said, F.lit('"\r\n```'))
    responses = prepared.select("request_hash", F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))).alias("response"))
    rows = score_requests(lake, prepared, responses, result, truth, config)
    return rows.select(
        "gt_name", "answer", "prediction", "correct", "num_retrieved_tiles", "num_result_tiles", "num_result_cells", "num_ground_truth_cells",
        "TP", "FP", "FN", "TN", "near_end", "slicer", "index", "merger", "TpT", "tok")


_SQL_ASKED = (
    f"{sql_grid_tiles(_TILES, 'star')}, {_sql_costs().replace(sql_cells(STAR, 'star') + ', ', '')},"
    f" tv as (select table_name || '/' || b || '/0' as tile_id, " + ", ".join(f"(o{i} + 2 * r{i}) / 8 as v{i}" for i in range(DIM)) + " from cellmean),"
    " asked as (select 'question-' || item_id as gt_name, " + ", ".join(f"{sql_hash('text', i)} as w{i}" for i in range(DIM)) + " from benchmark),"
    " dist as (select gt_name, tile_id, round(1 - (" + " + ".join(f"v{i} * w{i}" for i in range(DIM)) + ") / (sqrt(" + " + ".join(f"v{i} * v{i}" for i in range(DIM))
    + ") * sqrt(" + " + ".join(f"w{i} * w{i}" for i in range(DIM)) + ")), 10) as distance from tv, asked),"
    " ranked as (select gt_name, tile_id, row_number() over (partition by gt_name order by distance, tile_id) as rank from dist)"
)


@query(
    "answer_contexts",
    f"with recursive {_SQL_ASKED}, {_SQL_WALK}, picked as (select gt_name, unnest(ranks) as rank from packed),"
    " taken as (select gt_name, table_name, rank, tile_id from picked join rt using (gt_name, rank)),"
    " tabs as (select gt_name, table_name, min(rank) as place, string_agg(line, chr(10) order by row_id) as body from taken"
    " join (select table_name, row_id, line, table_name || '/' || (row_id // s) || '/0' as tile_id from lines join g using (table_name)) using (table_name, tile_id) group by all),"
    " texts as (select gt_name, string_agg('table: \"' || table_name || '\"' || chr(10) || chr(10) || header || chr(10) || body || chr(10) || chr(10), chr(10) || chr(10) order by place) as context from tabs join head using (table_name) group by gt_name)"
    f" select gt_name, {_sql_tokens('context')} as tokens, md5(context) as context_md5 from texts",
)
def answer_contexts(spark, sf_dir):
    """Every benchmark text asked of the star lake: retrieve, pack, merge, linearise."""
    questions = table(spark, sf_dir, "benchmark").select(
        F.lit("star").alias("lake"), F.concat(F.lit("question-"), F.col("item_id")).alias("gt_name"), F.col("text").alias("information_need")
    )
    config = AnswerConfig(slicer=GridSlicer("rowwise", _TILES), context_tokens=_BUDGET, embedder=EMBEDDER)
    context, _ = select_context(star_lake(spark, sf_dir), questions, config)
    return context.filter("context IS NOT NULL").select("gt_name", token_count(F.col("context")).cast("long").alias("tokens"), F.md5("context").alias("context_md5"))


_SQL_QUESTIONS = (
    f"{SQL_RANKED}, inst as (select r.lake, r.gt_name, b.text as need, d.text as context, d.lang || ' ' || d.n_chars as answer from ranked r"
    " join benchmark b on 'question-' || b.item_id = r.gt_name join documents d on 'doc-' || d.doc_id = r.tile_id where rank = 1)"
)


def _qa_instances(spark, sf_dir):
    top = retrieval.rank(ranked_documents(spark, sf_dir, 1), 1)
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("tile_id"), F.col("text").alias("context"), F.concat_ws(" ", "lang", "n_chars").alias("answer")
    )
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("question-"), F.col("item_id")).alias("gt_name"), F.col("text").alias("information_need"))
    return top.join(docs, "tile_id").join(asked, "gt_name").withColumn("answer_columns", F.lit("lang, n_chars"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _request_sql(layout: str) -> str:
    if layout == "list":
        user, system = "need || chr(10) || chr(10) || context", requests.LIST_SYSTEM
    else:
        user = "need || chr(10) || chr(10) || 'The result table must have the following columns: lang, n_chars' || chr(10) || chr(10) || 'Context tables:' || chr(10) || chr(10) || context"
        system = requests.TABLE_SYSTEM
    return (
        f"select '{layout}' as layout, lake, gt_name, least(4096, {_sql_tokens('answer')} + 20) as max_tokens, md5({user}) as user_md5, sha256(to_json({{'model': 'gpt-4-1106-preview',"
        f" 'max_tokens': least(4096, {_sql_tokens('answer')} + 20), 'temperature': 0, 'messages': [{{'role': 'system', 'content': {_sql_text(system)}}},"
        f" {{'role': 'user', 'content': {user}}}]}})::varchar) as request_hash from inst"
    )


@query("build_requests", f"with {_SQL_QUESTIONS} {_request_sql('list')} union all {_request_sql('table')}")
def build_requests(spark, sf_dir):
    instances = _qa_instances(spark, sf_dir)
    parts = [
        requests.build_requests(instances, layout).select(
            F.lit(layout).alias("layout"), "lake", "gt_name", "max_tokens", F.md5("user_message").alias("user_md5"), "request_hash"
        )
        for layout in ("list", "table")
    ]
    return parts[0].unionByName(parts[1])


# the texts of labelled documents have been asked before; copies of them are hits
def _asked(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("text").alias("request"), F.sha2("text", 256).alias("request_hash"))


def _answered(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _asked(spark, sf_dir).join(labels, "doc_id")


@query(
    "request_cache_hits",
    "with c as (select text, min_by(lang || '-' || doc_id, doc_id) as response from documents join labels using (doc_id) group by text)"
    " select doc_id, c.text is not null as hit, response from documents d left join c on c.text = d.text",
)
def request_cache_hits(spark, sf_dir):
    cache = _answered(spark, sf_dir).select("request_hash", "request", F.col("doc_id").alias("ts"), F.concat_ws("-", "lang", "doc_id").alias("response"))
    hits, misses = requests.cache_lookup(_asked(spark, sf_dir), cache)
    found = hits.select("doc_id", F.lit(True).alias("hit"), "response")
    return found.unionByName(misses.select("doc_id", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("response")))


@query(
    "score_predictions",
    "with r as (select text, min(case when quality = 1 then lang else 'unknown' end) as prediction from documents join labels using (doc_id) group by text),"
    " s as (select source, coalesce(lang = prediction, false) as ok from documents left join r using (text))"
    " select source, count(*) filter (where ok) as correct, count(*) filter (where not ok) as incorrect, count(*) as total, count(*) filter (where ok) / count(*) as accuracy from s group by source",
)
def score_predictions(spark, sf_dir):
    prediction = F.when(F.col("quality") == 1, F.col("lang")).otherwise("unknown")
    responses = _answered(spark, sf_dir).groupBy("request_hash").agg(F.min(prediction).alias("prediction"))
    instances = _asked(spark, sf_dir).withColumnRenamed("lang", "answer")
    return evaluation.answer_accuracy(evaluation.score_answers(instances, responses), ["source"])


_MODEL_NAMES = [m[0] for m in requests.MODELS]
_SQL_MODELS = "models(model, max_context, max_output, ip, op) as (values " + ", ".join(
    f"('{m[0]}', {m[6]}, {'null' if m[7] is None else m[7]}, {m[4]}::double, {m[5]}::double)" for m in requests.MODELS
) + ")"
_SQL_REQUESTS = (
    f"{_SQL_MODELS}, req as (select conv_id, turn, [{', '.join(repr(n) for n in _MODEL_NAMES)}][conv_id % 6 + 1] as model, {_sql_tokens('text')} + 10 as tokens_in,"
    " case when turn % 3 = 0 then null else 100 + turn * 1000 end as max_tokens, case when turn % 2 = 1 then turn end as n from conversations),"
    " r as (select req.*, max_context, max_output, ip, op, coalesce(max_tokens, least(greatest(0, max_context - tokens_in), max_output)) as tokens_out from req join models using (model))"
)


def _requests(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _MODEL_NAMES])
    max_tokens = F.when(F.col("turn") % 3 != 0, 100 + F.col("turn") * 1000)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.element_at(names, (F.col("conv_id") % 6 + 1).cast("int")).alias("model"),
        requests.input_tokens(messages=[F.col("text")]).cast("long").alias("tokens_in"), max_tokens.alias("max_tokens"),
        F.when(F.col("turn") % 2 == 1, F.col("turn")).alias("n"),
    )


@query("request_cost", f"with {_SQL_REQUESTS} select model, count(*) as n_requests, round(sum(coalesce(n, 1) * (tokens_in * (ip / 1000) + tokens_out * (op / 1000))), 6) as max_cost from r group by model")
def request_cost(spark, sf_dir):
    costs = requests.request_costs(_requests(spark, sf_dir), requests.number_of_choices(F.lit(None).cast("long"), F.col("n")))
    return costs.groupBy("model").agg(F.count(F.lit(1)).alias("n_requests"), F.round(F.sum("max_cost"), 6).alias("max_cost"))


@query(
    "request_limit_flags",
    f"with {_SQL_REQUESTS} select conv_id, turn, max_context < tokens_in as input_too_long, max_context = tokens_in as no_room_for_output, coalesce(max_output < max_tokens, false) as output_limit_exceeded,"
    " coalesce(max_context < tokens_in + max_tokens, false) as context_exceeded, tokens_out, tokens_in + tokens_out as tokens_total from r",
)
def request_limit_flags(spark, sf_dir):
    return requests.limit_flags(_requests(spark, sf_dir)).drop("model", "tokens_in", "max_tokens", "n")


def _responses(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _MODEL_NAMES])
    model = F.element_at(names, (F.col("conv_id") % 6 + 1).cast("int"))
    usage = F.when(F.col("turn") % 4 != 0, F.struct(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens")))
    choices = F.when(F.col("turn") % 4 != 0, F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))))
    body = F.to_json(F.struct(model.alias("model"), usage.alias("usage"), choices.alias("choices")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", body.alias("response"))


@query(
    "response_cost",
    f"with {_SQL_MODELS} select conv_id, turn, case when turn % 4 = 0 then 0 else length(text) + turn end as tokens_total,"
    f" round(case when turn % 4 = 0 then 0 else length(text) * (ip / 1000) + turn * (op / 1000) end, 9) as cost from conversations join models on model = [{', '.join(repr(n) for n in _MODEL_NAMES)}][conv_id % 6 + 1]",
)
def response_cost(spark, sf_dir):
    costs = requests.response_costs(_responses(spark, sf_dir))
    return costs.select("conv_id", "turn", "tokens_total", F.round("cost", 9).alias("cost"))


@query("failed_responses", "select role, count(*) filter (where turn % 4 = 0) as failed, count(*) as n from conversations group by role")
def failed_responses(spark, sf_dir):
    return _responses(spark, sf_dir).groupBy("role").agg(
        F.count_if(requests.is_failed(F.col("response"))).alias("failed"), F.count(F.lit(1)).alias("n")
    )


@query("cache_retention", "select request_hash, ts from (select md5(event_id::varchar) as request_hash, ts from events) order by ts desc, request_hash desc limit 5000")
def cache_retention(spark, sf_dir):
    cache = table(spark, sf_dir, "events").select(F.md5(F.col("event_id").cast("string")).alias("request_hash"), "ts")
    return requests.retain_cache(cache, 5000)


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), "ts", F.floor("value").cast("long").alias("tokens"))


@query(
    "rolling_rate",
    "select event_id, count(*) over w as n_requests, cast(sum(floor(value)::bigint) over w as bigint) as n_tokens from events"
    " window w as (partition by event_type order by ts range between interval 600 seconds preceding and current row)",
)
def rolling_rate(spark, sf_dir):
    return requests.rolling_rate(_log(spark, sf_dir), 600).select("event_id", "n_requests", "n_tokens")


_SQL_WINDOWS = (
    "w as (select {m} as model, to_timestamp((epoch(ts)::bigint // 10) * 10 - k * 10)::timestamp as window_start, count(*) as n_requests, cast(sum(floor(value)::bigint) as bigint) as n_tokens"
    " from (select *, unnest(range(0, 7)) as k from (select *, date_trunc('second', ts) as sec from events)) group by all)"
)


@query("rolling_rate_windows", "with " + _SQL_WINDOWS.replace("{m}", "event_type").replace("epoch(ts)", "epoch(sec)") + " select model, strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start, n_requests, n_tokens from w")
def rolling_rate_windows(spark, sf_dir):
    rates = windowed_rate(_log(spark, sf_dir))
    return rates.select("model", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_requests", "n_tokens")


_MODEL_OF_TYPE = "['gpt-3.5-turbo-1106', 'gpt-4-0613'][(event_type = 'error')::int + 1]"


@query(
    "rolling_rate_flags",
    "with " + _SQL_WINDOWS.replace("{m}", _MODEL_OF_TYPE).replace("epoch(ts)", "epoch(sec)")
    + " select model, count(*) as n_windows, count(*) filter (where n_tokens > 0.0001 * case model when 'gpt-4-0613' then 300000 else 2000000 end) as over_tpm from w group by model",
)
def rolling_rate_flags(spark, sf_dir):
    model = F.when(F.col("model") == "error", "gpt-4-0613").otherwise("gpt-3.5-turbo-1106")
    flagged = flag_limits(windowed_rate(_log(spark, sf_dir).withColumn("model", model)), share=0.0001)
    return flagged.groupBy("model").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("over_tpm").alias("over_tpm"))
