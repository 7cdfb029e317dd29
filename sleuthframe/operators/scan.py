"""Ordered scans over (key, microsecond) points that never need one task per hot key.

Keys of at most 10^6 points are scanned by one window each: one exchange for all of
them.  A window partitioned by the key alone would put a hot key into one task, so for
these time is cut twice: a second holds at most 10^6 distinct microseconds and a block
of 10^6 seconds at most 10^6 seconds, so every window group is bounded by
construction however the rows are spread over keys or over time.  The three
partial results (inside the second, earlier seconds of the block, earlier blocks
of the key) are put together by equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import TASK_ROWS

_STEP = 1_000_000
_BUCKETS = 1 << 16
# Frames only ever grow from the front, which Spark evaluates in one pass over a group; a frame that
# shrinks towards the end would be evaluated anew for every row.  "after" looks at negated positions.
_UPTO, _BEFORE = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


def _floor_div(name: str) -> Column:
    return F.expr(f"({name} - pmod({name}, {_STEP})) div {_STEP}")


def _combine(how: str, parts: list[Column]) -> Column:
    if how == "sum":
        return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])
    if len(parts) == 1:
        return parts[0]
    return F.greatest(*parts) if how == "max" else F.least(*parts)


def hot_split(rows: DataFrame, place: list[str], limit: int = _STEP) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary places, rows of hot places); None where there are none.

    A place is hot if its hash bucket holds over ``limit`` rows, so an ordinary place never
    has more.  All rows are counted; what is shuffled and collected is a number a bucket.
    """
    bucket = F.pmod(F.xxhash64(*place), F.lit(_BUCKETS))
    hot = [r[0] for r in rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).collect()]
    return (rows.filter(~bucket.isin(hot)), rows.filter(bucket.isin(hot))) if hot else (rows, None)


def ordered_scan(points: DataFrame, keys: list[str], at: str, measures: dict[str, tuple[str, Column]], frame: str = "upto",
                 spread=None, place: list[str] | None = None, limit: int = _STEP, hot: bool | None = None) -> DataFrame:
    """Add running aggregates over ``at`` inside each key.

    ``spread`` makes the points out of the given rows; it keeps ``place``, the columns (the
    keys, or some that they contain) by which rows are dealt out before, so that what it
    multiplies is not shuffled.  ``hot`` says which way to go if the caller has split the
    rows already.  The rest is as in ``_cut_scan``.
    """
    place, make = place or keys, spread or (lambda df: df)
    points = points.dropna(subset=place)  # a missing key is no key
    light, crowded = hot_split(points, place, limit) if hot is None else (None, points) if hot else (points, None)
    if light is None:
        return _cut_scan(make(crowded), keys, at, measures, frame)
    inner = _UPTO if frame == "upto" else _BEFORE
    w = Window.partitionBy(*keys).orderBy(-F.col(at) if frame == "after" else F.col(at)).rangeBetween(*inner)
    light = make(light.repartition(*place))
    out = light.select(*light.columns, *[_combine(how, [_AGGREGATE[how](c).over(w)]).alias(n) for n, (how, c) in measures.items()])
    return out if crowded is None else out.unionByName(_cut_scan(make(crowded), keys, at, measures, frame))


def _cut_scan(points: DataFrame, keys: list[str], at: str,
              measures: dict[str, tuple[str, Column]], frame: str = "upto") -> DataFrame:
    """Running aggregates over ``at`` inside each key, in seconds, blocks and keys.

    ``measures`` maps an output name to ("sum" | "max" | "min", column).  ``frame``
    is "upto" (ties included), "before" or "after" (ties excluded).  The caller
    gives points that are distinct on (keys, at) up to a small constant.  Key
    columns must not be NULL.
    """
    inner = _UPTO if frame == "upto" else _BEFORE
    position = (lambda c: -F.col(c)) if frame == "after" else F.col
    cols = points.columns
    src = points.select("*", _floor_div(at).alias("_sec"),
                        *[c.alias(f"_m_{n}") for n, (_, c) in measures.items()])
    src = src.withColumn("_blk", _floor_div("_sec"))

    def totals(df, group):
        return df.groupBy(*group).agg(*[_AGGREGATE[how](f"_m_{n}").alias(f"_m_{n}")
                                        for n, (how, _) in measures.items()])

    def running(df, group, order, bounds, tag):
        w = Window.partitionBy(*group).orderBy(position(order)).rangeBetween(*bounds)
        return df.withColumns({f"_{tag}_{n}": _AGGREGATE[how](f"_m_{n}").over(w)
                               for n, (how, _) in measures.items()})

    seconds = totals(src, [*keys, "_blk", "_sec"])
    blocks = totals(seconds, [*keys, "_blk"])
    drop = [f"_m_{n}" for n in measures]
    blocks = running(blocks, keys, "_blk", _BEFORE, "b").drop(*drop)
    seconds = running(seconds, [*keys, "_blk"], "_sec", _BEFORE, "s").drop(*drop)
    seconds = seconds.join(blocks, [*keys, "_blk"]).drop("_blk")
    rows = running(src, [*keys, "_sec"], at, inner, "r").drop("_blk")
    rows = rows.join(seconds, [*keys, "_sec"])
    return rows.select(*cols, *[
        _combine(how, [F.col(f"_r_{n}"), F.col(f"_s_{n}"), F.col(f"_b_{n}")]).alias(n)
        for n, (how, _) in measures.items()
    ])


def band_counts(rows: DataFrame, keys: list[str], at: str, width: int, out: str = "n_near") -> DataFrame:
    """For each distinct (keys, at): how many rows of the key lie closer than ``width`` microseconds.

    The row itself is counted.  No pair is formed: the answer is the difference of
    two running totals, read at ``at + width - 1`` and at ``at - width``.
    """
    data = rows.groupBy(*keys, at).agg(F.count("*").alias("_n"))
    probe = F.explode(F.array(
        F.struct(F.col(at).alias("_at"), F.col("_n").alias("_w"), F.lit(0).alias("_sign")),
        F.struct((F.col(at) + (width - 1)).alias("_at"), F.lit(0).cast("long").alias("_w"), F.lit(1).alias("_sign")),
        F.struct((F.col(at) - width).alias("_at"), F.lit(0).cast("long").alias("_w"), F.lit(-1).alias("_sign")),
    ))
    points = data.select(*keys, F.col(at).alias("_origin"), probe.alias("_p")).select(*keys, "_origin", "_p.*")
    scanned = ordered_scan(points, keys, "_at", {"_total": ("sum", F.col("_w"))}, "upto", limit=TASK_ROWS)
    return (scanned.groupBy(*keys, F.col("_origin").alias(at))
            .agg(F.sum(F.col("_sign") * F.col("_total")).alias(out)))


def next_after(points: DataFrame, keys: list[str], at: str, gap: int, out: str = "next_at") -> DataFrame:
    """For each distinct (keys, at): the smallest ``at`` of the key that is more than ``gap`` later."""
    data = points.select(*keys, at).distinct()
    probe = F.explode(F.array(
        F.struct(F.col(at).alias("_at"), F.col(at).alias("_data"), F.lit(False).alias("_ask")),
        F.struct((F.col(at) + gap).alias("_at"), F.lit(None).cast("long").alias("_data"), F.lit(True).alias("_ask")),
    ))
    both = data.select(*keys, F.col(at).alias("_origin"), probe.alias("_p")).select(*keys, "_origin", "_p.*")
    scanned = ordered_scan(both, keys, "_at", {out: ("min", F.col("_data"))}, "after")
    return scanned.filter("_ask").select(*keys, F.col("_origin").alias(at), out)


def last_mark(points: DataFrame, marks: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """For each distinct (keys, at) of ``points``: the latest mark at or before it."""
    both = (points.select(*keys, at).distinct().withColumns({"_data": F.lit(None).cast("long"), "_ask": F.lit(True)})
            .unionByName(marks.select(*keys, at).distinct().withColumns({"_data": F.col(at), "_ask": F.lit(False)})))
    scanned = ordered_scan(both, keys, at, {out: ("max", F.col("_data"))}, "upto")
    return scanned.filter("_ask").select(*keys, at, out)
