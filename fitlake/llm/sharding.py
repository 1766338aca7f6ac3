"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard. At each level the children draw exponential times from hashes
of (key, child name), divided by their weights, and the first one wins. A draw depends on the key and the child
alone, so a changed weight moves rows only into or out of that child, and rows move only within the subtrees
whose weights change. A shard added as a region of its own takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlake.llm import common as K

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Tree:
    """Shards and weights by region and rack: {region: {rack: {shard: weight}}}."""
    regions: dict[str, dict[str, dict[int, float]]]

    @staticmethod
    def even(shards: int, per_rack: int = 2, per_region: int = 8) -> Tree:
        """Shards 0 to ``shards`` - 1 with weight one, dealt to racks and regions in order."""
        regions: dict[str, dict[str, dict[int, float]]] = {}
        for s in range(shards):
            region, rack = f"r{s // per_region}", f"r{s // per_region}/k{s // per_rack}"
            regions.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
        return Tree(regions)

    def with_shard(self, shard: int, weight: float = 1.0, region: str | None = None,
                   rack: str | None = None) -> Tree:
        """The tree with one more shard: in the named rack, or else as a region of its own."""
        region = region or f"s{shard}"
        rack = rack or f"{region}/k{shard}"
        regions = {r: {k: dict(s) for k, s in racks.items()} for r, racks in self.regions.items()}
        if any(shard in s for racks in regions.values() for s in racks.values()):
            raise ValueError(f"shard {shard} is in the tree")
        regions.setdefault(region, {}).setdefault(rack, {})[shard] = weight
        return Tree(regions)

    def levels(self) -> tuple[list, list, list]:
        """(name, weight, number) of the regions; of each region's racks; of each rack's shards."""
        top, racks, leaves = [], [], []
        for r, (region, own) in enumerate(self.regions.items()):
            top.append((region, sum(w for s in own.values() for w in s.values()), r))
            racks.append([])
            for rack, shards in own.items():
                racks[-1].append((rack, sum(shards.values()), len(leaves)))
                leaves.append([(f"{rack}/s{s}", w, s) for s, w in shards.items()])
        if not top or any(w <= 0 for leaf in leaves for _, w, _ in leaf):
            raise ValueError("a tree needs shards, and each shard a weight above 0")
        return top, racks, leaves


def _children(nodes: list[tuple[str, float, int]]) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("number"))
                     for n, w, i in nodes))


def _first(key: Column, children: Column) -> Column:
    """Number of the child whose weighted exponential draw for the key is the smallest."""
    def draw(c: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 12) + 0.5) / F.lit(float(1 << 52))
        return F.struct((-F.ln(uniform) / c["weight"]).alias("time"), c["number"].alias("number"))

    return F.array_min(F.transform(children, draw))["number"]


def place(docs: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """``docs`` with the key's shard in the tree as column ``name``; all null keys share one shard."""
    top, racks, leaves = tree.levels()
    own = F.coalesce(key.cast("string"), F.lit(""))
    return (docs.withColumn("__region", _first(own, _children(top)))
            .withColumn("__rack", _first(own, F.element_at(F.array(*map(_children, racks)), F.col("__region") + 1)))
            .withColumn(name, _first(own, F.element_at(F.array(*map(_children, leaves)), F.col("__rack") + 1)))
            .drop("__region", "__rack"))


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, carry: list[str] | None = None) -> DataFrame:
    """Put every document into a shard of the tree by its doc_id.

    Returns the columns ``carry`` of ``docs`` (all by default; those named like an added one are replaced) with
    ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``law`` ('key'), ``shard``, ``slot`` (0, 1, ...
    within the shard, by part and doc_id) and ``grown_shard``, the shard in the grown tree (null without one).

    A null text has no bytes (size 16, checksum 0); null ids share a shard, and their slots are
    spread by text. Repeated rows get slots of their own. An empty table gives no rows.
    """
    names = [c for c in (carry or docs.columns) if c.lower() not in ADDED]
    counts = {r[0]: r[1] for r in place(docs.select("doc_id"), F.col("doc_id"), tree, "shard")
              .groupBy("shard").count().collect()}  # a row per shard of the tree
    # slots are numbered in some sqrt(n) / 8 parts of a shard of n rows, so that no task takes a whole shard
    parts = [int(-(-counts.get(s, 0) ** 0.5 // 8)) or 1 for s in range(max([*counts, 0]) + 1)]
    rows = docs.select(*names, F.col("doc_id").alias("__id"),
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                       F.lit("key").alias("law"))
    rows = place(rows, F.col("__id"), tree, "shard")
    rows = place(rows, F.col("__id"), grown, "grown_shard") if grown else \
        rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = rows.withColumn("__part", F.pmod(
        F.xxhash64("__id", "text_crc32"), F.element_at(F.lit(parts), F.col("shard") + 1)).cast("int"))
    sums = (place(docs.select(F.col("doc_id").alias("__id"),
                              F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")),
                  F.col("__id"), tree, "shard")
            .groupBy("shard", F.pmod(F.xxhash64("__id", "text_crc32"), F.element_at(
                F.lit(parts), F.col("shard") + 1)).cast("int").alias("__part")).count())
    by_shard = Window.partitionBy("shard").orderBy("__part")
    before = sums.select("shard", "__part", (F.sum("count").over(by_shard) - F.col("count")).alias("__before"))
    inside = Window.partitionBy("shard", "__part").orderBy("__id", "text_crc32", "size")
    return (rows.join(before, ["shard", "__part"])
            .withColumn("slot", (F.col("__before") + F.row_number().over(inside) - 1).cast("long"))
            .select(*names, *ADDED))
