"""URL rules by a sort-merge range join.

A host's key is its labels in reverse, each followed by a dot: ``a.example.net`` is
``net.example.a.``.  All hosts under a rule's host then lie in one interval of the
sorted keys, and rule intervals are nested or apart, never crossing.  Rules and
distinct hosts are sorted together; a sweep hands each host the last rule host before
it.  The stack of rule hosts open at that point is that rule host's own stack, less
those that have ended, so the stack travels with the rule and no row needs to look back further.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

Rule = tuple[str, str, str]


def host_and_path(urls: DataFrame) -> DataFrame:
    """Column url replaced by host (after the first ``://``, A-Z in lower case) and path (up to ``?`` or ``#``)."""
    start = F.instr("url", "://")
    place = F.when(start > 0, F.regexp_replace(F.expr("substring(url, instr(url, '://') + 3)"), r"(?s)[?#].*", "")).otherwise("")
    host = F.translate(F.substring_index("place", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (urls.withColumn("place", place).withColumn("host", host)
            .withColumn("path", F.expr("substring(place, length(host) + 1)")).drop("url", "place"))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark, rules: Iterable[Rule]) -> DataFrame:
    """(host, path, verdict) rules as rows host, path, verdict; a host matches itself and its subdomains."""
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def stacks(rules: DataFrame) -> DataFrame:
    """key and stack: for every distinct rule host, the rules of all rule hosts around it and of itself.

    A host of n labels lies in at most n rule hosts, so a stack is found by n equality
    lookups.  Of rules that are the same but for the verdict, "block" stands.
    """
    one = (rules.where("host is not null and host != '' and path is not null and verdict is not null")
           .groupBy(F.lower("host").alias("host"), "path").agg(F.max("verdict").alias("verdict")))
    own = (one.withColumn("key", key_of(F.col("host")))
           .groupBy("key").agg(F.collect_list(F.struct("key", "host", "path", "verdict")).alias("rules")))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    around = own.select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("outer_key"))
    outer = own.select(F.col("key").alias("outer_key"), "rules")
    return around.join(outer, "outer_key").groupBy("key").agg(F.flatten(F.collect_list("rules")).alias("stack"))


def sweep(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, stack: the rules whose host holds ``host``; hosts without any are left out.

    The sorted keys are cut into ranges of equal size.  A range starts from the last
    rule of the ranges before it: one row per range, the only thing that is carried over.
    """
    spark = hosts.sparkSession
    points = hosts.select(key_of(F.col("host")).alias("key"), F.lit(1).alias("point"), "host", F.lit(None).cast(
        "array<struct<key:string,host:string,path:string,verdict:string>>").alias("stack"))
    starts = stacks(rules).select("key", F.lit(0).alias("point"), F.lit(None).cast("string").alias("host"), "stack")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(points.unionByName(starts).repartitionByRange(parts, "key", "point")
                     .withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max_by("stack", F.when(F.col("point") == 0, F.col("key"))).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = ends.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("part").orderBy("key", "point").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("stack", F.last("stack", ignorenulls=True).over(so_far)).where("point = 1")
    opened = swept.join(F.broadcast(carried), "part").select(
        "host", F.filter(F.coalesce("stack", "carried"), lambda r: F.startswith(F.col("key"), r["key"])).alias("stack"))
    return opened.where("size(stack) > 0")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    Of the rules whose host is the page's or a parent of it and whose path starts the
    page's, the longest wins (then the longer host, then the greater text); without
    one, rule is null and verdict is ``default``.  A url that is missing or has no
    ``://`` has empty host and path.  Repeated rows come back as they are; other
    columns are left out.  Rules without host, path or verdict are passed over.
    """
    parted = host_and_path(pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")))
    opened = sweep(parted.select("host").where("host != ''").distinct(), rules)
    best = F.array_max(F.transform(
        F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])),
        lambda r: F.struct(F.length(F.concat(r["host"], r["path"])).alias("size"), F.length(r["host"]).alias("host_size"),
                           F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return (parted.join(opened, "host", "left").withColumn("best", best)
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
