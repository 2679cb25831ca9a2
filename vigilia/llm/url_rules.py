"""Verdicts on urls by a sort-merge range join with nested rules on hosts and paths.

A host is written with its labels in reverse, each closed by a point (``www.example.com`` is ``com.example.www.``), so that a
host and all its subdomains are one interval of the sorted keys, and all urls of a rule's host that begin with its path are one interval
of the sorted (host of the rule, path). Intervals of prefixes are nested or apart. Every rule contributes two marks, one where its
interval begins and one after its end, and a mark carries the stack of rules that are open from there on. Urls and marks
are sorted together over the cluster, and the last mark at or before a url tells its stack: the sweep runs in ranges
of equal size, and a summary of one row a range carries the stack over from one range to the next. A first sweep finds the rule
hosts around each host (the whole stack, a few labels deep), a second one, for each of these, the longest path rule around the path
(the top of the stack). Of these the longest rule, host and path together, is the url's.

Urls are swept once for each distinct pair of host and path, whatever the number of pages that share it, and ranges split between
pairs, so a host that holds a third of the pages fills as many ranges as it needs. Pairs come back to their pages by a plain join, which
adaptive execution splits. Only DataFrame functions are used. A rule costs rows in proportion to its labels and to the length of its path.

A null url, or one without ``://``, has an empty host and an empty path. A path is empty where the url ends after its host, and then no rule
with a path fits. A rule without host fits every host; equal rules with different verdicts block; of fitting rules of equal length the one
with the longer host counts; rules with a null or with ``/``, ``?`` or ``#`` in the host fit nothing. Pages keep all their rows
and columns; columns named like the result's are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import configure, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
#: The rules of the registered query (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
VALUES = ", ".join(str(r) for r in RULES)
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RESULT = ["host", "path", "rule", "verdict"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    given = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(given, SPLIT, 1), UPPER, LOWER), F.regexp_extract(given, SPLIT, 2)


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a point after it; nothing for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _begin(prefix: Column) -> Column:
    return prefix.cast("binary")


def _after(prefix: Column) -> Column:
    """A key above all that begin with the prefix: no text holds the byte FF."""
    return F.concat(prefix.cast("binary"), F.lit(b"\xff"))


def sweep(points: DataFrame, marks: DataFrame, order: list[str], value: str) -> DataFrame:
    """``points`` with ``value``: that of the last of ``marks`` at or before them in ``order``, null before the first.

    Both have the columns ``order``, no two marks are equal in it, and ``marks`` has ``value`` besides.
    """
    nothing = F.lit(None).cast(marks.select(F.struct(value).alias("_mark")).schema["_mark"].dataType)
    rows = points.withColumn("_mark", nothing).withColumn("_point", F.lit(True)).unionByName(
        marks.select(*order, F.struct(value).alias("_mark"), F.lit(False).alias("_point")), allowMissingColumns=True)
    rest = [c for c in points.columns if c not in order]
    # Stored, so that a range keeps its number whatever is computed again; the rest of the columns splits a run of equal keys.
    stored = materialize(rows.repartitionByRange(*order, "_point", *rest).withColumn("_range", F.spark_partition_id()), "sweep")
    last = stored.groupBy("_range").agg(F.max_by("_mark", F.when(~F.col("_point"), F.struct(*order))).alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = last.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    so_far = Window.partitionBy("_range").orderBy(*order, "_point").rowsBetween(Window.unboundedPreceding, 0)
    open_now = F.coalesce(F.last("_mark", ignorenulls=True).over(so_far), F.col("_carried"))
    return stored.join(carried, "_range").withColumn("_open", open_now).where("_point").select(*points.columns, F.col(f"_open.{value}").alias(value))


def host_marks(rules: DataFrame) -> DataFrame:
    """``at``, ``stack``: where the stack of rule hosts (their keys, outermost first) changes."""
    hosts = rules.select("node").distinct()
    labels = F.split(F.col("node"), r"\.", -1)
    around = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.when(n > 0, ".").otherwise("")))
    outer = hosts.select("node", F.explode(F.array_distinct(around)).alias("outer"))
    known = outer.join(hosts.withColumnRenamed("node", "outer"), "outer")
    stacks = known.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.octet_length("outer"), "outer")))["outer"].alias("stack"))  # no more than labels
    begin = stacks.select(_begin(F.col("node")).alias("at"), "stack")
    return begin.unionByName(stacks.select(_after(F.col("node")).alias("at"), F.slice("stack", 1, F.size("stack") - 1).alias("stack")))


def path_marks(rules: DataFrame) -> DataFrame:
    """``node``, ``at``, ``top``: where the longest open path rule of a host changes; ``top`` has the node and, where one is open, the rule."""
    top = lambda at: F.struct("node", F.col(at).alias("rule"))
    shorter = rules.select("node", "path", F.explode(F.sequence(F.lit(0), F.char_length("path"))).alias("n")).where("n < char_length(path)").select(
        "node", F.col("path").alias("inner"), F.expr("left(path, n)").alias("path"))
    parents = shorter.join(rules.select("node", "path", "rule"), ["node", "path"]).groupBy("node", "inner").agg(F.max_by("rule", F.char_length("path")).alias("parent"))
    nested = rules.join(parents.withColumnRenamed("inner", "path"), ["node", "path"], "left")
    begin = nested.select("node", _begin(F.col("path")).alias("at"), top("rule").alias("top"))
    return begin.unionByName(nested.select("node", _after(F.col("path")).alias("at"), top("parent").alias("top")))


def clean_rules(rules: DataFrame) -> DataFrame:
    """``node`` (key of the host), ``path`` and ``rule`` (text, verdict, length) of each rule, once."""
    host = F.translate("host", UPPER, LOWER)
    given = rules.where("verdict IS NOT NULL AND path IS NOT NULL").where(~host.rlike("[/?#]")).select(host.alias("host"), "path", "verdict")
    once = given.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    verdict = F.when(F.col("blocks"), "block").otherwise("allow")
    size = F.struct(F.char_length("host") + F.char_length("path"), F.char_length("host"))
    return once.select(host_key(F.col("host")).alias("node"), "path", F.struct(F.concat("host", "path").alias("text"), verdict.alias("verdict"), size.alias("size")).alias("rule"))


def url_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path``, ``rule`` (its text) and ``verdict`` of the distinct (host, path) pairs in ``urls`` that a rule fits."""
    rules = materialize(clean_rules(rules), "url-rules")
    pairs = urls.select("host", "path").distinct().withColumn("at", _begin(host_key(F.col("host"))))
    inside = sweep(pairs, host_marks(rules), ["at"], "stack")
    asked = inside.select("host", "path", F.explode("stack").alias("node"), _begin(F.col("path")).alias("at"))
    found = sweep(asked, path_marks(rules), ["node", "at"], "top").where((F.col("top.node") == F.col("node")) & F.col("top.rule").isNotNull())
    best = found.groupBy("host", "path").agg(F.max_by("top.rule", "top.rule.size").alias("best"))
    return best.select("host", "path", F.col("best.text").alias("rule"), "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``; ``rules`` has ``host``, ``path``, ``verdict`` (allow or block)."""
    host, path = url_parts(F.col(url))
    parted = pages.select(host.alias("_url_host"), path.alias("_url_path"), *pages.columns)
    found = url_verdicts(parted.select(F.col("_url_host").alias("host"), F.col("_url_path").alias("path")), rules)
    found = found.select(*[F.col(c).alias(f"_found_{c}") for c in RESULT])
    same = reduce(lambda a, b: a & b, [F.col(f"_url_{c}") == F.col(f"_found_{c}") for c in ("host", "path")])
    return parted.join(found, same, "left").select(
        *[c for c in pages.columns if c not in RESULT], F.col("_url_host").alias("host"), F.col("_url_path").alias("path"),
        F.col("_found_rule").alias("rule"), F.coalesce("_found_verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page."""
    pages = configure(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql(f"SELECT * FROM VALUES {VALUES} AS rules(verdict, host, path)")
    return judge(pages, rules).select("page_id", *RESULT)


ORACLE_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {VALUES}),
parts AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '{SPLIT}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{SPLIT}', 2) AS path
  FROM pages),
fits AS (
  SELECT p.r, max_by(u, length(u.host) + length(u.path)) AS best
  FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY p.r)
SELECT page_id, host, path, best.host || best.path AS rule, coalesce(best.verdict, '{DEFAULT}') AS verdict
FROM parts LEFT JOIN fits USING (r)
"""
