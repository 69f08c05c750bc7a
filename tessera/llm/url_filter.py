"""URL filter: explicit rules, and path templates per host rejected by their smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.registry import query, table
from tessera.session import materialize

Rule = tuple[str, str]

#: (verdict, host and path); a rule holds for its host and all subdomains.
RULES: tuple[Rule, ...] = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)

#: A segment of a node with more children than this becomes a wildcard if it has less than this share of its pages.
MANY_CHILDREN, RARE_SHARE = 20, 0.05
#: Labelled pages a branch needs to be compared with its siblings, and the squared normal deviate of similarity.
LEAST_LABELLED, SIMILAR = 5, 3.84
#: Weight, in pages, of the parent's purity in a branch's, and the purity from which a template is rejected.
SMOOTHING, REJECT_FROM = 10.0, 0.8
WILDCARD, MERGED = "*", "~"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return empty(lowered), empty(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _by_length(rules: tuple[Rule, ...]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path), longest first."""
    return [(v, r, r.split("/", 1)[0], "/" + r.split("/", 1)[1]) for v, r in sorted(rules, key=lambda x: -len(x[1]))]


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct ``(rule, verdict)``; null fields without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, name, own, start in reversed(_by_length(rules)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return F.struct(rule.alias("rule"), verdict.alias("verdict"))


def segments(path: Column) -> Column:
    """The segments of a path, digits generalised."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/"), lambda s: s != "")


KEY = ["host", "shape"]
COUNTS = ("n", "labelled", "bad")


def _smoothed(bad: Column, labelled: Column, above: Column) -> Column:
    return (bad + SMOOTHING * above) / (labelled + SMOOTHING)


def _branches(shapes: DataFrame, level: int) -> DataFrame:
    """``(prefix, segment, to)``: the branch that each child of a node belongs to."""
    children = shapes.groupBy("prefix", F.coalesce(F.get("cut", F.lit(level)), F.lit("")).alias("segment")).agg(*[F.sum(c).alias(c) for c in COUNTS])
    children = materialize(children, "children")
    nodes = materialize(children.groupBy("prefix").agg(
        F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")), "nodes")
    rare = (F.col("children") > MANY_CHILDREN) & (F.col("n") < RARE_SHARE * F.col("all_n"))
    here, there = F.col("labelled").cast("double"), (F.col("all_labelled") - F.col("labelled")).cast("double")
    bad, other = F.col("bad").cast("double"), (F.col("all_bad") - F.col("bad")).cast("double")
    both, bad_both = here + there, bad + other
    apart = (bad * there - other * here) * (bad * there - other * here) * both
    similar = (here >= LEAST_LABELLED) & (there >= LEAST_LABELLED) & (apart <= SIMILAR * here * there * bad_both * (both - bad_both))
    to = F.when(F.col("segment") == "", "").when(rare, WILDCARD).when(similar, MERGED).otherwise(F.col("segment"))
    return materialize(children.join(nodes, "prefix").select("prefix", "segment", to.alias("to")), "named")


def template_verdicts(labelled: DataFrame) -> DataFrame:
    """``(host, shape, template, purity, rejected)`` for the path shapes of ``labelled(host, cut, bad)``, where ``bad`` is
    null for pages without label.

    Pages are counted by path shape first; the tree is then built of these counts, level by level, as long as a node has
    several shapes. Below one node, segments that are rare among many become one wildcard; branches whose share of bad
    pages does not differ significantly from that of their labelled siblings are merged. The purity of a branch is its
    share of bad pages among the labelled ones, smoothed towards its parent's (a host's towards the overall share; an only
    branch has its parent's), so pages without labels take after what lies beside them. Templates of high purity are
    rejected.
    """
    shapes = labelled.groupBy("host", "cut").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    shapes = materialize(shapes.withColumn("shape", F.array_join("cut", "/")), "shapes")
    overall = shapes.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    prior = F.lit(overall["bad"] / overall["labelled"] if overall["labelled"] else 0.0)
    hosts = shapes.groupBy("host").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
    hosts = materialize(hosts.select("host", _smoothed(F.col("b"), F.col("l"), prior).alias("purity")), "hosts")
    shapes = materialize(shapes.join(hosts, "host").withColumn("prefix", F.col("host")), "shapes")
    level = 0
    while True:
        several = shapes.groupBy("prefix").agg(F.count("*").alias("shapes"), F.max(F.size("cut")).alias("depth")).where("shapes > 1")
        if (several.agg(F.max("depth")).first()[0] or 0) <= level:
            break
        named = _branches(shapes, level)
        moved = materialize(
            shapes.withColumn("segment", F.coalesce(F.get("cut", F.lit(level)), F.lit(""))).join(named, ["prefix", "segment"])
            .withColumn("next", F.concat("prefix", F.lit("/"), "to")).drop("segment", "to"), "moved")
        sums = moved.groupBy("prefix", "next").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"), F.first("purity").alias("above"))
        sums = materialize(sums, "branch-sums")
        only = sums.groupBy("prefix").agg((F.count("*") == 1).alias("only"))
        purity = F.when(F.col("only"), F.col("above")).otherwise(_smoothed(F.col("b"), F.col("l"), F.col("above")))
        rated = materialize(sums.join(only, "prefix").select("next", purity.alias("purity")), "rated")
        shapes = materialize(moved.drop("purity", "prefix").join(rated, "next").withColumnRenamed("next", "prefix"), "shapes")
        level += 1
    rest = F.array_join(F.slice("cut", level + 1, F.greatest(F.size("cut") - level, F.lit(0))), "/")
    return shapes.select(*KEY, F.concat_ws("/", "prefix", rest).alias("template"), "purity", (F.col("purity") >= REJECT_FROM).alias("rejected"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` of every row of ``pages(page_id, url)``.

    The longest fitting rule decides and labels the page; all others follow their template. Null urls and urls without
    ``://`` have an empty host and path, which are judged like any other. Of rules of equal length that fit the first given
    one holds. Very long urls are read whole, to any depth. Repeated rows and rows without ``page_id`` stay and count; other
    columns are ignored. An empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = read.withColumn("fit", fitting(rules, F.col("host"), F.col("path")))
    shaped = ruled.select("page_id", "host", "path", "fit.rule", "fit.verdict", segments(F.col("path")).alias("cut"))
    verdicts = materialize(template_verdicts(shaped.select("host", "cut", (F.col("verdict") == "block").alias("bad"))), "url-templates")
    shaped = shaped.withColumn("shape", F.array_join("cut", "/")).drop("cut")
    found = F.when(F.col("rejected"), "block").otherwise("allow")
    return shaped.join(verdicts, KEY).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", found).alias("verdict"), "template", "purity")


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB: a recursive query goes down one level at a time."""
    cases = lambda what: "case " + " ".join(
        f"when (host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '{start}') then '{what(v, name)}'"
        for v, name, own, start in _by_length(rules)) + " end"
    return f"""
with recursive rest as (select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
ruled as (select *, {cases(lambda v, r: r)} as rule, {cases(lambda v, r: v)} as by_rule,
                 list_filter(string_split(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/'), lambda s: s <> '') as cut from split),
shapes as (select host, cut, array_to_string(cut, '/') as shape, count(*) as n, count(by_rule) as labelled, count(*) filter (by_rule = 'block') as bad from ruled group by host, cut),
prior as (select coalesce(sum(bad) / nullif(sum(labelled), 0), 0) as p from shapes),
deepest as (select max(len(cut)) as depth from shapes),
tree(level, host, cut, shape, n, labelled, bad, prefix, purity) as (
  select 0, host, cut, shape, n, labelled, bad, host,
         (sum(bad) over (partition by host) + {SMOOTHING}::double * p) / (sum(labelled) over (partition by host) + {SMOOTHING}::double)
  from shapes, prior
  union all
  select level + 1, host, cut, shape, n, labelled, bad, next,
         case when branches = 1 then purity else (sum(bad) over (partition by next) + {SMOOTHING}::double * purity) / (sum(labelled) over (partition by next) + {SMOOTHING}::double) end
  from (
    select *, count(distinct next) over (partition by prefix) as branches
    from (
      select *, prefix || '/' || case when segment = '' then '' when children > {MANY_CHILDREN} and here_n < {RARE_SHARE}::double * all_n then '{WILDCARD}'
         when here >= {LEAST_LABELLED} and there >= {LEAST_LABELLED} and (b * there - o * here) * (b * there - o * here) * (here + there)
              <= {SIMILAR}::double * here * there * (b + o) * (here + there - b - o) then '{MERGED}' else segment end as next
      from (
        select *, count(distinct segment) over (partition by prefix) as children, sum(n) over own as here_n, sum(n) over node as all_n,
               (sum(labelled) over own)::double as here, (sum(labelled) over node - sum(labelled) over own)::double as there,
               (sum(bad) over own)::double as b, (sum(bad) over node - sum(bad) over own)::double as o
        from (select *, coalesce(cut[level + 1], '') as segment from tree where level < (select depth from deepest))
        window own as (partition by prefix, segment), node as (partition by prefix)))))
select page_id, r.host, path, rule, coalesce(by_rule, case when purity >= {REJECT_FROM} then 'block' else 'allow' end) as verdict
from ruled r join tree t on t.host = r.host and t.cut = r.cut and level = (select depth from deepest)
"""


@query("op3_url_filter", _sql())
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
