"""Connections between the histories of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.session import written


def parse_connections(df: DataFrame, text: str) -> DataFrame:
    """``lower.hist -> upper.hist`` as four columns."""
    sides = F.split(text, "->")
    out = df
    for i, side in enumerate(("src", "dst")):
        part = F.trim(sides[i])
        out = out.withColumns({f"{side}_name": F.regexp_extract(part, r"^(.*)\.[^.]*$", 1),
                               f"{side}_hist": F.regexp_extract(part, r"\.([^.]*)$", 1)})
    return out


def resolve_connections(df: DataFrame, models: DataFrame) -> DataFrame:
    """Model behind each side: by attribute name, else by class name.

    A class name shared by several models names the first attribute. Unknown sides stay null.
    """
    by_attr = models.select(F.col("attr").alias("_name"), F.col("attr").alias("_a")).distinct()
    by_class = models.groupBy(F.col("class").alias("_name")).agg(F.min("attr").alias("_c"))
    names = by_attr.join(by_class, "_name", "full").select("_name", F.coalesce("_a", "_c").alias("_m"))
    for side in ("src", "dst"):
        df = df.join(names.withColumnsRenamed({"_name": f"{side}_name", "_m": f"{side}_model"}),
                     f"{side}_name", "left")
    return df


def is_acyclic(edges: DataFrame) -> bool:
    """Whether the edges ``src, dst`` admit an order; edges with an unknown side are left out.

    The graph is peeled: each round keeps the edges whose source still has an input, one round per
    level of the graph, until none is left or none goes. Each round's edges are written to the shared
    folder, so a lost executor costs one round.
    """
    left = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "edges")
    n = left.count()
    while n:
        fed = left.select(F.col("dst").alias("src")).distinct()
        left = written(left.join(fed, "src", "left_semi"), "edges")
        n, before = left.count(), n
        if n == before:
            return False
    return True
