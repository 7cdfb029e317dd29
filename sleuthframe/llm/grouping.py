"""Exact groups of similar sets out of candidates, without listing the pairs of a group.

Candidate links (each key's members linked by members - 1 links) are verified on whole
sets.  What verified links connect is a label; what candidates connect, similar or not,
is a cluster.  Only clusters of two labels or more are looked at again: there every
member outside the largest label meets all members of other labels inside a task, over an
inverted index of the sets, and only links that join two labels come out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import connected

#: Members, and bytes of their sets, that one task holds of a cluster on either side.
MEMBERS, BYTES = 1024, 16 << 20


def similar_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows a, b of ``pairs`` whose sets (node, shingles: sorted distinct uint64) share ``percent`` of their union or more."""
    def run(batches):
        for b in batches:
            kept = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(np.count_nonzero(y[at] == x)) if len(y) else 0
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    size = F.octet_length
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    near = both.where(F.least(size("x"), size("y")) * 100 >= F.greatest(size("x"), size("y")) * percent)
    return durable(near.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _settler(percent: int):
    """Group function: links between members of different labels whose sets are similar, as few as join the labels."""
    def run(table: pa.Table) -> pa.Table:
        node, label, asks = (table.column(c).to_numpy() for c in ("node", "label", "asks"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
        labels, own = np.unique(label, return_inverse=True)
        root = np.arange(len(labels))
        held, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        size = np.array([len(sets[i]) for i in held], np.int64)
        codes = np.concatenate([sets[i] for i in held]) if len(held) else np.zeros(0, "<u8")
        owner = np.repeat(np.arange(len(held)), size)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        a, b = [], []
        for i in asking:
            n = len(sets[i])
            other = (root[own[held]] != root[own[i]]) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))
            if not other.any():
                continue
            low, high = np.searchsorted(codes, sets[i], "left"), np.searchsorted(codes, sets[i], "right")
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(held))
            for j in np.flatnonzero(other & (100 * both >= percent * (size + n - both))):
                x, y = root[own[i]], root[own[held[j]]]
                if x != y:
                    root[root == y] = x
                    a.append(node[i])
                    b.append(node[held[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def settle(groups: DataFrame, sets: DataFrame, percent: int, members: int = MEMBERS, size: int = BYTES) -> DataFrame:
    """a, b: links between similar members of different labels in one cluster, enough to join all labels that such pairs join.

    groups: node, cluster, label of every node in a cluster; sets: node, shingles.  A cluster
    is cut into blocks by its members and the bytes of their sets; the members outside its
    largest label are dealt to every block, so that a group of very many copies beside a few
    others costs as much as its own size.
    """
    kinds = groups.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    mixed = durable(kinds.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).where("n > most.n")
                    .select("cluster", "n", F.col("most.label").alias("top"), (F.col("n") - F.col("most.n")).alias("rest")))
    spark = groups.sparkSession
    if mixed.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    left = groups.join(mixed.hint("merge"), "cluster").join(sets.hint("merge"), "node")
    left = durable(left.select("node", "cluster", "label", (F.col("label") != F.col("top")).alias("other"), "shingles"))
    blocks = left.groupBy("cluster").agg(*[F.greatest(F.ceil(F.sum(F.when(own, 1)) / members), F.ceil(F.sum(F.when(own, F.octet_length("shingles"))) / size))
                                           .alias(c) for c, own in (("parts", F.lit(True)), ("asking", F.col("other")))])
    own = left.join(blocks.hint("merge"), "cluster")
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    held = own.select("cluster", F.explode(F.expr("sequence(0L, asking - 1)")).alias("i"), place("parts", 1).alias("j"), "node", "label",
                      F.lit(False).alias("asks"), "shingles")
    asks = own.where("other").select("cluster", place("asking", 2).alias("i"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("j"),
                                     "node", "label", F.lit(True).alias("asks"), "shingles")
    return durable(held.unionByName(asks).groupBy("cluster", "i", "j").applyInArrow(_settler(percent), "a long, b long"))


def stars(filed: DataFrame) -> DataFrame:
    """a, b: the distinct links of every key's least node with its others; filed: key, node."""
    heads = filed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("members")).where("members > 1").select("key", "a")
    return durable(filed.join(heads.hint("merge"), "key").where("node != a").select("a", F.col("node").alias("b")).distinct())


def groups_of(early: DataFrame, sets: DataFrame, percent: int, late=None) -> DataFrame:
    """node, label: the least node reachable over similar pairs among the nodes that candidates connect.

    early: candidate links, verified first; late: function of the labels they give that
    returns further candidate links, which need to join different labels only, and the sets
    of all nodes.  Copies of one text meet under nearly every key: most of their links are
    spared in this way.  sets: node, shingles of the nodes of the early links.
    """
    pairs, sure = early, similar_links(early, sets, percent)
    if late is not None:
        more, sets = late(connected(sure))
        pairs, sure = early.unionByName(more), sure.unionByName(similar_links(more, sets, percent))
    clusters = connected(pairs).withColumnRenamed("label", "cluster")
    groups = durable(clusters.join(connected(sure).hint("merge"), "node", "left").select("node", "cluster", F.coalesce("label", "node").alias("label")))
    last = settle(groups, sets, percent)
    return groups.select("node", "label") if last.isEmpty() else connected(sure.unionByName(last))
