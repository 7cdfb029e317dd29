"""Counts and summaries.  Every aggregate combines map-side; none needs one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Severities, and the file extensions of each evidence category.
SEVERITIES = ("critical", "high", "medium", "low", "info")
CATEGORIES = {
    "Disk Images": ("e01", "dd", "iso", "raw", "img", "ova", "001"),
    "Memory Dumps": ("mem", "vmem", "dmp"),
    "Documents": ("pdf", "docx", "txt", "csv", "xlsx", "doc", "rtf", "msg"),
    "Logs & Network": ("pcap", "pcapng", "log", "evtx", "evt", "json"),
}


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row per known severity, zeros included."""
    spark = findings.sparkSession
    known = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return known.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def evidence_category(extension: Column) -> Column:
    plain = F.replace(F.lower(F.coalesce(extension, F.lit(""))), F.lit("."), F.lit(""))
    out = None
    for name, members in CATEGORIES.items():
        out = F.when(plain.isin(*members), name) if out is None else out.when(plain.isin(*members), name)
    return out.otherwise("Other")


def category_histogram(evidence: DataFrame) -> DataFrame:
    """Evidence files per category; a single placeholder row when there are none."""
    counts = evidence.groupBy(evidence_category(F.col("extension")).alias("category")).agg(F.count("*").alias("n"))
    none = (counts.agg(F.count("*").alias("k")).filter("k = 0")
            .select(F.lit("No Evidence").alias("category"), F.lit(1).cast("long").alias("n")))
    return counts.unionByName(none)


def dashboard(evidence: DataFrame, findings: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per case (and for all cases, case_id NULL): files, bytes, critical alerts, detections, jobs."""
    zero = F.lit(0).cast("long")
    names = ("n_evidence", "evidence_bytes", "n_detections", "n_critical", "n_jobs")

    def fact(df, **given):
        return df.select("case_id", *[given.get(n, zero).cast("long").alias(n) for n in names])
    one = F.lit(1)
    facts = (fact(evidence, n_evidence=one, evidence_bytes=F.coalesce(F.col("file_size"), zero))
             .unionByName(fact(findings, n_detections=one, n_critical=(F.col("severity") == "critical").cast("long")))
             .unionByName(fact(jobs, n_jobs=one)))
    return facts.rollup("case_id").agg(*[F.sum(n).alias(n) for n in names])


def events_per_day(events: DataFrame, at: str = "ts", days: int = 7) -> DataFrame:
    """Daily counts over the days that end at the newest event; quiet days are 0."""
    day = F.to_date(at)
    counts = events.filter(F.col(at).isNotNull()).groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    calendar = counts.agg(F.max("day").alias("last")).select(
        F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return calendar.join(counts, "day", "left").select(
        "day", F.date_format("day", "E").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def review_summary(reviews: DataFrame, *group: str) -> DataFrame:
    status = F.col("review_status")
    return reviews.groupBy(*group).agg(
        F.count("*").alias("total"),
        *[F.count_if(status == s).alias(s) for s in ("pending", "approved", "rejected", "escalated")],
        F.coalesce(F.bool_and(status != "pending"), F.lit(True)).alias("all_reviewed"),
        F.count_if(status == "approved").alias("review_ready_for_report"))


def stuck_jobs(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Jobs that have been running longer than the threshold."""
    return jobs.filter((F.col("status") == "PROCESSING")
                       & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes))))


def stuck_summary(stuck: DataFrame) -> DataFrame:
    """Stuck jobs per stage, and over all stages (stage NULL), with the oldest start."""
    return stuck.rollup("current_stage").agg(F.count("*").alias("n_stuck"), F.min("started_at").alias("oldest_stuck"))


def fail_stuck(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """The job table after clean-up: stuck jobs are failed, with a message."""
    late = (F.col("status") == "PROCESSING") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    late = F.coalesce(late, F.lit(False))
    message = F.concat(F.lit("Job timed out while processing at stage '"), F.col("current_stage"), F.lit("'."))
    return jobs.withColumns({"stage_message": F.when(late, message), "completed_at": F.when(late, now),
                             "status": F.when(late, "FAILED").otherwise(F.col("status"))})


def latest(df: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (partial maxima, no sort of a group)."""
    best = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("_b")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in keep])


def top_per_group(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group; Spark trims to k per task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values per column for pickers, as (column, value)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                         for c in columns])).alias("e")).select("e.*")
    return long.distinct()


def exact_quantile(df: DataFrame, column: str, q: float, bins: int = 1024, small: int = 4096) -> float | None:
    """Linear-interpolated quantile of a whole column without sorting it in one task.

    Each round counts the values in equal bins of the current range and keeps the
    bin that holds the wanted rank, until few distinct values are left; what comes
    to the driver is one row per bin or per remaining distinct value.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    position = q * (n - 1)
    wanted = [int(position), min(int(position) + 1, n - 1)]

    def order_statistic(rank: int) -> float:
        lo, hi, before = low, high, 0
        while True:
            inside = values.filter((F.col("x") >= lo) & (F.col("x") <= hi))
            few = inside.groupBy("x").agg(F.count("*").alias("n")).orderBy("x").limit(small + 1).collect()
            if len(few) <= small or hi <= lo:
                for row in few:
                    before += row["n"]
                    if before > rank:
                        return row["x"]
                return hi
            bin_no = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / ((hi - lo) / bins)))
            counts = inside.groupBy(bin_no.alias("b")).agg(
                F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()
            for row in counts:
                if before + row["n"] > rank:
                    lo, hi = row["lo"], row["hi"]
                    break
                before += row["n"]

    first, second = order_statistic(wanted[0]), order_statistic(wanted[1])
    return first + (second - first) * (position - wanted[0])
