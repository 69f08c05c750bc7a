"""Scores and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F


from tessera.operators import evaluation
from tessera.plans.corpus import sql_catalog, star_lake, table
from tessera.plans.registry import query
from tessera.plans.tiles import SQL_RESULTS, SQL_TRUTH, result_spans, truth_spans
from tessera.sources.lake import catalog, lake_sizes
from tessera.sources.stages import add_config_columns, load_runs, save_run
from tessera.session import checkpoint_dir

_SCORES = (
    "case when \"TP\" + \"FP\" = 0 then 1 else \"TP\" / (\"TP\" + \"FP\") end as precision, case when \"TP\" + \"FN\" = 0 then 0 else \"TP\" / (\"TP\" + \"FN\") end as recall"
)
_F1 = "case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1_score"

_SQL_RETRIEVAL = (
    f"{SQL_RESULTS}, {SQL_TRUTH}, {sql_catalog()}, hit as (select gt_name, count(t.row_id) as tp, count(*) - count(t.row_id) as fp from result_cells r"
    " left join truth_cells t using (gt_name, table_name, row_id, col_pos) group by gt_name), rel as (select gt_name, count(*) as n from truth_cells group by gt_name),"
    " counts as (select gt_name, coalesce(tp, 0) as \"TP\", coalesce(fp, 0) as \"FP\", coalesce(n, 0) - coalesce(tp, 0) as \"FN\","
    " cast((select sum(num_cells) from tables) - coalesce(fp, 0) - coalesce(n, 0) as bigint) as \"TN\" from hit full join rel using (gt_name)),"
    f" scored as (select *, {_SCORES} from counts)"
)


def _retrieval(spark, sf_dir):
    sizes = lake_sizes(catalog(star_lake(spark, sf_dir))).select("lake", "lake_cells")
    return evaluation.retrieval_confusion(result_spans(spark, sf_dir), truth_spans(spark, sf_dir), sizes)


@query("retrieval_confusion", f"with {_SQL_RETRIEVAL} select gt_name, \"TP\", \"FP\", \"FN\", \"TN\", precision::double as precision, recall::double as recall, round({_F1[:-12]}, 9) as f1_score from scored")
def retrieval_confusion(spark, sf_dir):
    return _retrieval(spark, sf_dir).select("gt_name", "TP", "FP", "FN", "TN", "precision", "recall", F.round("f1_score", 9).alias("f1_score"))


# line items as QA instances: the ordered quantity class is the answer, the tax class the prediction
_SQL_INSTANCES = (
    "inst as (select l_orderkey, l_suppkey, o_orderpriority, floor(l_quantity / 10)::int as answer, round(l_tax * 100)::int as prediction, l_returnflag, l_linestatus"
    " from lineitem join orders on l_orderkey = o_orderkey)"
)


def _instances(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_suppkey", "o_orderpriority", F.floor(F.col("l_quantity") / 10).cast("int").alias("answer"),
        F.round(F.col("l_tax") * 100).cast("int").alias("prediction"), "l_returnflag", "l_linestatus",
    )


@query(
    "answer_accuracy",
    f"with {_SQL_INSTANCES} select o_orderpriority, count(*) filter (where answer = prediction) as correct, count(*) - count(*) filter (where answer = prediction) as incorrect,"
    " count(*) as total, count(*) filter (where answer = prediction) / count(*) as accuracy from inst group by o_orderpriority",
)
def answer_accuracy(spark, sf_dir):
    scored = _instances(spark, sf_dir).withColumn("is_correct", F.col("answer") == F.col("prediction"))
    return evaluation.answer_accuracy(scored, ["o_orderpriority"])


@query(
    "confusion_scores",
    f"with {_SQL_INSTANCES}, c as (select l_suppkey, count(*) filter (where answer = 3 and prediction = 3) as \"TP\", count(*) filter (where answer <> 3 and prediction = 3) as \"FP\","
    " count(*) filter (where answer <> 3 and prediction <> 3) as \"TN\", count(*) filter (where answer = 3 and prediction <> 3) as \"FN\" from inst group by l_suppkey),"
    f" s as (select *, {_SCORES} from c) select l_suppkey, \"TP\", \"FP\", \"TN\", \"FN\", round(precision, 9) as precision, round(recall, 9) as recall, round({_F1[:-12]}, 9) as f1_score,"
    " \"TP\" + \"FP\" + \"TN\" + \"FN\" as total from s",
)
def confusion_scores(spark, sf_dir):
    a, p = F.col("answer") == 3, F.col("prediction") == 3
    single = _instances(spark, sf_dir).select(
        "l_suppkey", (a & p).cast("long").alias("TP"), (~a & p).cast("long").alias("FP"), (~a & ~p).cast("long").alias("TN"), (a & ~p).cast("long").alias("FN")
    )
    scored = evaluation.sum_confusion(single, ["l_suppkey"])
    return scored.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1_score")})


_SQL_CONFIG = (
    "conf as (select 'slicer=' || l_returnflag || '_merger=' || l_linestatus || '_TpT=' || (l_orderkey % 5) || '_tok=' || (l_suppkey % 3)"
    " || '_embedder=e' || (l_orderkey % 2) || '_index=i' as config_name, l_orderkey, answer, prediction, l_returnflag, l_linestatus, l_suppkey from inst)"
)


def _configured(spark, sf_dir):
    name = F.concat(
        F.lit("slicer="), F.col("l_returnflag"), F.lit("_merger="), F.col("l_linestatus"), F.lit("_TpT="), F.col("l_orderkey") % 5,
        F.lit("_tok="), F.col("l_suppkey") % 3, F.lit("_embedder=e"), F.col("l_orderkey") % 2, F.lit("_index=i"),
    )
    named = _instances(spark, sf_dir).withColumn("config_name", name)
    return add_config_columns(named, evaluation.QA_CONFIG)


@query(
    "parse_config_name",
    f"with {_SQL_INSTANCES}, {_SQL_CONFIG} select config_name, l_returnflag as slicer, l_linestatus as merger, (l_orderkey % 5)::varchar as \"TpT\", (l_suppkey % 3)::varchar as tok, count(*) as n from conf group by all",
)
def parse_config_name(spark, sf_dir):
    return _configured(spark, sf_dir).groupBy("config_name", "slicer", "merger", "TpT", "tok").agg(F.count(F.lit(1)).alias("n"))


@query(
    "qa_mean",
    f"with {_SQL_INSTANCES}, {_SQL_CONFIG} select 'e' || (l_orderkey % 2) as embedder, l_returnflag as slicer, 'i' as index, l_linestatus as merger, (l_orderkey % 5)::varchar as \"TpT\", (l_suppkey % 3)::varchar as tok,"
    " avg(case when answer = prediction then 1.0 else 0.0 end) as accuracy, avg(answer) as num_result_tiles from conf group by all",
)
def qa_mean(spark, sf_dir):
    results = _configured(spark, sf_dir).select(
        *evaluation.QA_CONFIG, F.when(F.col("answer") == F.col("prediction"), 1.0).otherwise(0.0).alias("accuracy"), F.col("answer").alias("num_result_tiles")
    )
    return evaluation.mean_by_config(results, evaluation.QA_CONFIG, ["accuracy", "num_result_tiles"])


# one run per line status; the runs of an order's question are strung together
@query(
    "prediction_rollup",
    f"with {_SQL_INSTANCES}, runs as (select l_orderkey, l_returnflag, l_linestatus as run, min(answer)::varchar as answer, max(prediction)::varchar as prediction, count(*) as num_result_tiles from inst group by all)"
    " select l_orderkey, l_returnflag, string_agg(answer, '' order by run) as answer, string_agg(prediction, '' order by run) as prediction, cast(sum(num_result_tiles) as bigint) as num_result_tiles from runs group by all",
)
def prediction_rollup(spark, sf_dir):
    runs = _instances(spark, sf_dir).groupBy("l_orderkey", "l_returnflag", F.col("l_linestatus").alias("run")).agg(
        F.min("answer").cast("string").alias("answer"), F.max("prediction").cast("string").alias("prediction"), F.count(F.lit(1)).alias("num_result_tiles")
    )
    return evaluation.prediction_rollup(runs, ["l_orderkey", "l_returnflag"], "run", ["answer", "prediction"], ["num_result_tiles"])


@query(
    "run_results",
    f"with {_SQL_INSTANCES} select l_returnflag as gt_name, 'R' as slicer, '10' as \"TpT\", count(*) as n from inst group by all"
    f" union all select l_linestatus, 'S', '20', count(*) from inst group by all",
)
def run_results(spark, sf_dir):
    import os
    import uuid

    root = os.path.join(checkpoint_dir(spark), f"runs-{uuid.uuid4().hex}")
    inst = _instances(spark, sf_dir)
    for column, config in (("l_returnflag", "slicer=R_TpT=10"), ("l_linestatus", "slicer=S_TpT=20")):
        save_run(inst.groupBy(F.col(column).alias("gt_name")).agg(F.count(F.lit(1)).alias("n")), root, config)
    return load_runs(spark, root, "gt_name string, n long, slicer string, TpT string")


