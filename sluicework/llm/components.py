"""Connected components of links: forests within tasks, then alternating stars, or one forest where what is left is small."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, emit

_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Links (two numbers each), counted, that a single task joins; beyond, stars alternate over all tasks. The result is the same.
LOCAL = 250_000


class Forest:
    """Sets of numbers, each named by its least."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars of the sets that they make."""
    forest = Forest()
    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            forest.join(u, v)
    return emit(((x, root) for x in list(forest.up) if (root := forest.find(x)) != x), _LINKS)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links."""
    forest = Forest()
    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            forest.join(u, v)
    return emit(((x, forest.find(x)) for x in list(forest.up)), pa.schema([("node", pa.int64()), ("component", pa.int64())]))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of it and its neighbours: one link for each.

    Least neighbours are cut from their lineage, so that both sides of the join are dealt anew and a node with very many links can be split over tasks.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them. links: u > v."""
    least = checkpoint(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u")
    return moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, component): the least node reachable from each node of `links` (u, v); nodes without links are not listed.

    Loops and repeated links do no harm; links with a null end are left out. Each round's lineage is cut by a checkpoint; rounds grow as the logarithm of the longest chain.
    """
    thin = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v").mapInArrow(_thinned, "u long, v long")
    state = checkpoint(thin)
    if state.count() <= local:
        return state.coalesce(1).mapInArrow(_closed, "node long, component long")
    state = checkpoint(state.distinct())
    summary = lambda s: s.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    before = summary(state)
    for _ in range(rounds):
        if not before[0]:
            break
        state = checkpoint(_small_star(_large_star(state)))
        now = summary(state)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
