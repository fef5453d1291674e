"""URL rules by a sort-merge range join (DataFrame functions only).

A rule is (host, path). In canonical form its host is reversed by label (``example.com`` becomes ``com.example.``), so
the hosts that it covers, itself and all subdomains, are one interval of sorted keys; the paths that start with its path
are an interval too. Intervals of prefixes nest or are disjoint. Sorting the interval ends together with the urls' keys
and sweeping over them keeps a stack of the active rules: an interval's start pushes its rule, its end pops it. The stack
after each end depends on the rules alone, so it is attached to the end, and a url takes the stack of the last end before it.

Two sweeps: over hosts (the stack holds one entry for each covering host, at most one a label), then, for each of these
hosts, over paths (the top of the stack is the longest fitting rule of that host). Keys are hex digits, whose order is that
of the bytes, and ``G`` ends an interval, as it follows every hex digit.

The sorted runs are cut by a hash of the url, not by its host, so that a host that holds a third of all urls is spread over
all tasks; each run gets a copy of the interval ends. Rules are a list given by the user, far fewer than the urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import partitions

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.hex(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit(".")))


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in rules], "verdict string, rule_host string, rule_path string")


def _ends(intervals: DataFrame, group: list[str], key: str, keep: list[str]) -> DataFrame:
    """The sorted ends of nested intervals, each with the stack that is active after it.

    intervals: one row for each distinct (group, key); the interval is [key, key + "G"). The covering intervals of a key are
    those of its prefixes, found by an equi-join on the prefixes of its own length.
    """
    entry = F.struct(F.length(key).alias("depth"), *keep)
    outer = intervals.select(*group, F.col(key).alias("prefix"), entry.alias("entry"))
    inner = intervals.select(*group, F.col(key).alias("of"), F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"length({key}) div 2")), lambda i: F.substring(F.col(key), F.lit(1), i * 2))).alias("prefix"))
    stacks = inner.join(outer, [*group, "prefix"]).groupBy(*group, "of").agg(F.sort_array(F.collect_list("entry")).alias("stack"))
    start = stacks.select(*group, F.col("of").alias("at"), F.lit(1).alias("kind"), "stack")
    end = stacks.select(*group, F.concat("of", F.lit("G")).alias("at"), F.lit(0).alias("kind"), F.expr("slice(stack, 1, size(stack) - 1)").alias("stack"))
    # two intervals may end at one place only if they start there too, and keys are distinct; an end sorts before a start
    return start.unionByName(end)


def _sweep(points: DataFrame, ends: DataFrame, group: list[str], key: str, runs: int) -> DataFrame:
    """points with the column ``stack`` that is active at their key (null before the first end)."""
    copies = ends.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    # at one place: an end, then a start, then the points
    both = points.withColumns({"at": F.col(key), "kind": F.lit(2), "run": F.pmod(F.xxhash64(*points.columns), F.lit(runs)).cast("int")}).unionByName(copies, allowMissingColumns=True)
    seen = Window.partitionBy("run", *group).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("stack", F.last("stack", ignorenulls=True).over(seen)).filter("kind = 2").drop("at", "kind", "run")


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """urls with host, path, rule (host and path of the longest fitting rule) and verdict.

    Null urls and urls without ``://`` have an empty host and path, which a rule with an empty host could fit; no such rule
    is taken (rules with a null or empty host are ignored). Of rules with the same host and path ``block`` wins. Of fitting
    rules the one of most characters wins, of these the one with the longer host. Rows are kept as they are, repeated ones
    included; columns of the input named host, path, rule or verdict are replaced. Empty inputs give no rows or the default.
    """
    spark = urls.sparkSession
    runs = partitions(spark)
    rules = (
        rules.filter("length(rule_host) > 0")
        .select(F.translate("rule_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
    )
    out = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    # first the distinct (host, path): copies of a url are judged once
    named = out.filter("host <> ''")
    todo = named.select("host", "path").distinct().withColumn("hk", host_key(F.col("host")))
    host_ends = _ends(rules.select("rule_host").distinct().withColumn("hk", host_key(F.col("rule_host"))), [], "hk", ["rule_host"])
    todo = _sweep(todo, host_ends, [], "hk", runs).drop("hk").select("host", "path", F.explode("stack.rule_host").alias("rule_host")).withColumn("pk", F.hex("path"))
    path_ends = _ends(rules.withColumn("pk", F.hex("rule_path")), ["rule_host"], "pk", ["rule_path", "rule_verdict"])
    top = F.expr("element_at(filter(stack, x -> true), -1)")
    fits = _sweep(todo, path_ends, ["rule_host"], "pk", runs).filter("size(stack) > 0").withColumn("top", top)
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.length("rule_host") + F.length("top.rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "top.rule_path").alias("rule"), F.col("top.rule_verdict").alias("verdict"))).alias("b"))
    judged = named.join(best, ["host", "path"], "left").withColumns({"rule": F.col("b.rule"), "verdict": F.coalesce("b.verdict", F.lit(default))}).drop("b")
    # urls without a host, which no rule fits, would all meet in one group of that join
    return judged.unionByName(out.filter("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END AS h,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT v.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM v JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT v.page_id, v.host, v.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM v LEFT JOIN m ON m.page_id = v.page_id AND m.host = v.host AND m.path = v.path AND m.k = 1
"""
