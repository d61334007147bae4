"""URL filters: rules by host and path, and trust that spreads over the link graph of hosts.

Rules judge pages directly: a rule fits its host and all hosts below it where the page's path starts
with the rule's, and the longest wins. Pages without a rule get the verdict of their host:

* host edges come from the absolute links in the pages (links within a host are left out), weighted
  by the number of pages that hold them;
* trust is a personalised PageRank that restarts at hosts with allowed pages and follows links;
  distrust restarts at hosts with blocked pages and follows links backwards, since who links to
  a bad host is suspect, not who is linked from it;
* both start with mass 1, dealt by the number of pages. Each is set against the rank that a host has anyway: a walk over the same
  edges that restarts at all hosts by their pages. A host is blocked where its distrust is more than ``FACTOR`` times its
  trust, each as a multiple of that rank; without distrust it is allowed. Repeating the table or adding hosts that have no part in this changes no verdict.

Mass at hosts without links leaves the graph, as no host earned it. Each step adds up mass by
target host before it moves; the ranks are written to the shared folder every few steps, until they move by less than ``TOLERANCE``. Pages of a
frequent host are spread wherever they meet facts of their host.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and takes part
in no edge; its verdict is allow. A null html has no links. Rows that repeat are judged alike. Of two rules of one length the
one that comes first by verdict wins. A url or page of any length is read whole. An empty table gives an empty table. ``judged`` keeps further columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm.common import fresh, kept
from talentloom.operators.joins import skew_join

DAMPING = 0.85
FACTOR = 1.0
TOLERANCE = 1e-6
KEEP_EVERY = 5
#: host, path, verdict
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)(?:href|src|action)\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s<>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules that fit a host, the longest first."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = hosts.select("host", F.explode(above).alias("rule_host")).join(rules, "rule_host")
    whole = F.concat("rule_host", "rule_path")
    row = F.struct((-F.length(whole)).alias("order"), whole.alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    return fit.groupBy("host").agg(F.sort_array(F.collect_list(row)).alias("rules"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): distinct pages of one host that link to another; ``pages(host, html)``."""
    link = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("x:"), u)).otherwise(u))))).alias("dst")
    linked = pages.filter("host != ''").select(F.col("host").alias("src"), link).filter("dst != '' and dst != src")
    return linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank for several walks at once: ``edges(walk, src, dst, weight)``, ``seeds(walk, host, mass)`` → (walk, host, rank).

    What is left to move shrinks by ``DAMPING`` a step, so the ranks settle after a hundred steps at most.
    """
    spark = edges.sparkSession
    out = edges.groupBy("walk", "src").agg(F.sum("weight").alias("total"))
    step = kept(spark, edges.join(out, ["walk", "src"]).select("walk", "src", "dst", (DAMPING * F.col("weight") / F.col("total")).alias("share")), "edges")
    start = kept(spark, seeds.select("walk", "host", ((1 - DAMPING) * F.col("mass")).alias("rank")), "seeds")
    if step.isEmpty():
        return start
    rank = start
    while True:
        new = rank
        for _ in range(KEEP_EVERY):
            at = new.select("walk", F.col("host").alias("src"), "rank")
            moved = step.join(at, ["walk", "src"]).select("walk", F.col("dst").alias("host"), (F.col("share") * F.col("rank")).alias("rank"))
            new = moved.unionByName(start).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        new = kept(spark, new, "ranks")
        old = rank.withColumn("rank", -F.col("rank"))
        change = new.unionByName(old).groupBy("walk", "host").agg(F.abs(F.sum("rank")).alias("change")).groupBy("walk").agg(F.sum("change").alias("change")).agg(F.max("change")).first()[0]
        rank = new
        if (change or 0.0) < TOLERANCE:
            return rank


def judged(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust``; a clashing input column gives way."""
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    rest = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict", "trust", "distrust"}]
    pages = pages.select(*[f"`{c}`" for c in rest]).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    row, held = (fresh(pages, n) for n in ("row_", "hit_"))
    pages = pages.withColumn(row, F.monotonically_increasing_id())
    counts = kept(spark, pages.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    by_host = kept(spark, rules_by_host(counts, rules), "host_rules")
    with_rules = F.coalesce(F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)), F.lit(None))
    ruled = skew_join(pages.select("host", "path", row), by_host, "host", row).withColumn("hit", with_rules).drop("rules")

    marked = ruled.filter("hit is not null").groupBy("host", F.col("hit.verdict").alias("verdict")).agg(F.count("*").alias("n"))
    marked = kept(spark, marked, "marked")
    kinds = marked.select(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("walk"), "host", "n")
    real = counts.filter("host != ''")
    every = [real.select(F.lit(w).alias("walk"), "host", F.col("pages").alias("n")) for w in ("forth", "back")]
    masses = kinds.unionByName(every[0]).unionByName(every[1])
    seeds = masses.join(masses.groupBy("walk").agg(F.sum("n").alias("all")), "walk").select("walk", "host", (F.col("n") / F.col("all")).alias("mass"))
    edges = kept(spark, host_edges(pages.select("host", "html")), "links") if "html" in pages.columns else spark.createDataFrame([], "src string, dst string, weight double")
    along = edges.select(F.explode(F.array(F.lit("trust"), F.lit("forth"))).alias("walk"), "src", "dst", "weight")
    against = edges.select(F.explode(F.array(F.lit("distrust"), F.lit("back"))).alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    ranks = propagated(along.unionByName(against), seeds)
    scores = ranks.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("walk") == w, F.col("rank"))), F.lit(0.0)).alias(w) for w in ("trust", "distrust", "forth", "back")])
    # both sides times both baselines: a host without a rank of its own divides by nothing; sums in another order change no verdict
    bad = F.col("distrust") * F.col("forth") > FACTOR * (1 + 1e-9) * F.col("trust") * F.col("back")
    scores = scores.select("host", "trust", "distrust", bad.alias("bad"))

    facts = counts.select("host").join(by_host, "host", "left").join(scores, "host", "left")
    out = skew_join(pages, facts, "host", row).withColumn(held, with_rules)
    hit = F.col(held)
    verdict = F.when(hit.isNotNull(), hit["verdict"]).when(F.coalesce("bad", F.lit(False)) & (F.col("host") != ""), "block").otherwise("allow")
    zero = F.lit(0.0)
    return out.select(*[f"`{c}`" for c in rest], "host", "path", hit["rule"].alias("rule"), verdict.alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))


def verdict_rows(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url", "html")).drop("url", "html")
