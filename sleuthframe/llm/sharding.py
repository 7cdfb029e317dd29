"""A uniform shuffle into shards of exact size.

Rows lie in blocks (neighbouring partitions of the written row list) and go to cells
(equal parts of a shard).  How many rows of each block go to each cell is drawn first:
the matrix of counts that a uniform random order of all rows would give follows
multivariate hypergeometric laws, with the block sizes as row sums and the cell sizes
as column sums.  A block is then put in random order and dealt out by its counts, and
a cell is put in random order again.  Every order of all rows is equally likely, and
no step looks at more than one block or one cell.

The matrix is drawn by halving: the root has all blocks and the sizes of all cells; a
node gives its left half's share of each cell by one hypergeometric draw per cell, the
rest goes right.  Levels are the logarithm of the number of blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

#: Rows of a block or a cell, about: what one task sorts.
CELL_ROWS = 250_000


def log_factorial(n: Column) -> Column:
    """ln n!: Stirling's series at n + 8, brought back by the product of the factors between."""
    x = n.cast("double") + 8.0
    series = ((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
              + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))
    y = n.cast("double")
    return series - F.log((y + 1) * (y + 2) * (y + 3) * (y + 4) * (y + 5) * (y + 6) * (y + 7) * (y + 8))


def hypergeometric(u: Column, total: Column, good: Column, drawn: Column) -> Column:
    """How many of ``drawn`` things out of ``total`` are among the ``good`` ones, for a uniform u in [0, 1).

    Inversion outwards from the mode: the probabilities above and below it follow from
    it by ratios, so that the steps grow with the spread of the law, not with the counts.
    """
    def steps(t: Column) -> Column:
        low, high = F.greatest(F.lit(0).cast("long"), t["n"] + t["g"] - t["t"]), F.least(t["n"], t["g"])
        mode = F.least(F.greatest(F.floor((t["n"] + 1.0) * (t["g"] + 1.0) / (t["t"] + 2.0)), low), high)
        spread = F.sqrt(F.greatest(t["n"] * 1.0 * t["g"] / F.greatest(t["t"], F.lit(1)), F.lit(1.0)))
        return F.struct(t["u"].alias("u"), t["t"].alias("t"), t["g"].alias("g"), t["n"].alias("n"), low.alias("low"),
                        high.alias("high"), mode.alias("mode"), F.ceil(12 * spread + 40).alias("reach"))

    def search(s: Column) -> Column:
        def pmf(k: Column) -> Column:
            f = log_factorial
            return F.exp(f(s["g"]) - f(k) - f(s["g"] - k) + f(s["t"] - s["g"]) - f(s["n"] - k)
                         - f(s["t"] - s["g"] - s["n"] + k) - f(s["t"]) + f(s["n"]) + f(s["t"] - s["n"]))

        def step(a: Column, i: Column) -> Column:
            up, down = s["mode"] + i, s["mode"] - i  # the next value on either side
            k = up - 1
            above = F.when(up <= s["high"], a["above"] * (s["g"] - k) * (s["n"] - k)
                           / ((k + 1.0) * (s["t"] - s["g"] - s["n"] + k + 1.0))).otherwise(0.0)
            k = down + 1
            below = F.when(down >= s["low"], a["below"] * k * (s["t"] - s["g"] - s["n"] + k)
                           / ((s["g"] - k + 1.0) * (s["n"] - k + 1.0))).otherwise(0.0)
            found = F.when(a["found"].isNotNull(), a["found"]).when(a["left"] < above, up).when(a["left"] - above < below, down)
            return F.struct(above.alias("above"), below.alias("below"), (a["left"] - above - below).alias("left"), found.alias("found"))

        at_mode = pmf(s["mode"])
        start = F.struct(at_mode.alias("above"), at_mode.alias("below"), (s["u"] - at_mode).alias("left"),
                         F.when(s["u"] < at_mode, s["mode"]).alias("found"))
        last = F.least(s["reach"], F.greatest(s["high"] - s["mode"], s["mode"] - s["low"]))
        tried = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), last), lambda i: i > 0), start, step, lambda a: a["found"])
        return F.coalesce(tried, s["mode"])

    given = F.struct(u.alias("u"), total.cast("long").alias("t"), good.cast("long").alias("g"), drawn.cast("long").alias("n"))
    return F.transform(F.transform(F.array(given), steps), search)[0]


def uniform(seed: int, *what: Column) -> Column:
    """A number in [0, 1) fixed by seed and values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *what), 11) / F.lit(float(2 ** 53))


def split_counts(cells: Column, drawn: Column, seed: int, *what: Column) -> Column:
    """The share of each cell that ``drawn`` of the rows take: one draw after the other, out of what is left."""
    def step(a: Column, size: Column) -> Column:
        k = hypergeometric(uniform(seed, *what, F.size(a["took"])), a["total"], size, a["drawn"])
        return F.transform(F.array(k), lambda k: F.struct(
            (a["total"] - size).alias("total"), (a["drawn"] - k).alias("drawn"), F.concat(a["took"], F.array(k)).alias("took")))[0]

    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("total"), drawn.cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("took"))
    return F.aggregate(cells, start, step, lambda a: a["took"])


def count_matrix(sizes: DataFrame, cells: Column, blocks: int, seed: int) -> DataFrame:
    """block, counts: rows of each block for each cell.  sizes: block (0 to blocks - 1) and n."""
    node = sizes.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "n"))), lambda x: x["n"]).alias("n")).select(
        F.lit(0).alias("first"), "n", cells.alias("cells"))
    for level in range(max(0, (blocks - 1).bit_length())):
        half = F.expr("cast(ceil(size(n) / 2) as int)")
        left = F.aggregate(F.slice("n", 1, half), F.lit(0).cast("long"), lambda a, x: a + x)
        taken = split_counts(F.col("cells"), left, seed, F.lit(level), F.col("first"))
        node = node.withColumn("half", half).withColumn("took", F.when(F.size("n") > 1, taken).otherwise(F.col("cells")))
        node = node.select(F.explode(F.filter(F.array(
            F.struct(F.col("first"), F.slice("n", 1, F.col("half")).alias("n"), F.col("took").alias("cells")),
            F.struct((F.col("first") + F.col("half")).alias("first"), F.expr("slice(n, half + 1, greatest(size(n) - half, 0))").alias("n"),
                     F.zip_with("cells", "took", lambda c, t: c - t).alias("cells"))),
            lambda x: F.size(x["n"]) > 0)).alias("x")).select("x.*")
        if level % 4 == 3:
            node = durable(node.repartition(2 ** (level + 1), "first"))
    return node.select(F.col("first").alias("block"), F.col("cells").alias("counts"))


def shards(docs: DataFrame, count: int = 40, seed: int = 7, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to count - 1), slot (0 to the shard's rows - 1) for every row.

    Shard sizes differ by one row at most (the first ones are larger); each order of all
    rows is equally likely.  size: UTF-8 bytes of the text plus 16; a missing text has no
    bytes and the checksum of empty text.  Rows without a doc_id and repeated rows are
    rows like any others; other columns are left out.  The same seed gives the same
    shuffle of the same input partitions.
    """
    listed = durable(docs.select(
        F.col("doc_id"), (F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part")))
    parts = [(r["part"], r["n"]) for r in listed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    total = sum(n for _, n in parts)
    if not total:
        return listed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    per_shard = max(1, math.ceil(total / count / cell_rows))
    fine = count * per_shard
    per_block = max(1, (parts[-1][0] + 1) * cell_rows // max(total, cell_rows))  # neighbouring partitions in a block
    blocks = parts[-1][0] // per_block + 1
    spark = docs.sparkSession
    cell = spark.range(count).select(
        F.col("id").cast("int").alias("shard"), F.expr(f"{total // count} + if(id < {total % count}, 1, 0)").alias("rows"),
        F.explode(F.expr(f"sequence(0L, {per_shard - 1}L)")).alias("c")).select(
        "shard", (F.col("shard") * per_shard + F.col("c")).cast("int").alias("cell"),
        F.expr(f"rows div {per_shard} + if(c < rows % {per_shard}, 1, 0)").alias("n"),
        F.expr(f"c * (rows div {per_shard}) + least(c, rows % {per_shard})").alias("offset"))
    rows = listed.withColumn("block", F.expr(f"part div {per_block}").cast("int"))
    sizes = (spark.range(blocks).select(F.col("id").cast("int").alias("block"))
             .join(rows.groupBy("block").agg(F.count("*").alias("n")), "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("n")))
    cell_sizes = F.transform(F.sequence(F.lit(0), F.lit(fine - 1)), lambda i: F.transform(
        F.array(F.lit(total // count) + F.when(F.floor(i / F.lit(per_shard)) < total % count, 1).otherwise(0)),
        lambda r: (F.floor(r / F.lit(per_shard)) + F.when(i % per_shard < r % per_shard, 1).otherwise(0)).cast("long"))[0])
    matrix = durable(count_matrix(sizes, cell_sizes, blocks, seed))
    ordered = rows.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "row"), "row")))
    # markers: the place in the block's random order at which each cell's rows begin
    begins = F.aggregate("counts", F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("at")),
                         lambda a, n: F.struct((a["end"] + n).alias("end"), F.concat(a["at"], F.array(a["end"] + 1)).alias("at")),
                         lambda a: a["at"])
    markers = (matrix.select("block", F.posexplode(F.arrays_zip(F.col("counts").alias("n"), begins.alias("at"))).alias("cell", "x"))
               .where("x.n > 0").select("block", F.col("x.at").alias("at"), "cell"))
    both = ordered.select("doc_id", "size", "text_crc32", "row", "block", F.col("at").cast("long").alias("at"), F.lit(None).cast("int").alias("cell"))
    both = both.unionByName(markers, allowMissingColumns=True)
    so_far = Window.partitionBy("block").orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.withColumn("cell", F.last("cell", ignorenulls=True).over(so_far)).where("row is not null")
    again = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row")
    placed = dealt.withColumn("rank", F.row_number().over(again) - 1)
    return placed.join(F.broadcast(cell), "cell").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))
