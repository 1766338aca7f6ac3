"""Collections of tagged items: a table ``id, tags array<string>``."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions import tags as G


def universe(items: DataFrame) -> DataFrame:
    return items.select(F.explode("tags").alias("tag")).distinct()


def check_known(items: DataFrame, selector: Iterable[str]) -> None:
    """Selecting by a tag no item carries is an error."""
    asked = list(selector)
    if not asked:
        return
    seen = items.agg(*[F.bool_or(F.array_contains("tags", t.lstrip("!"))) for t in asked]).first()
    for tag, found in zip(asked, seen):
        if not found:
            raise ValueError(f"unknown tag {tag!r}")


def select(items: DataFrame, selector: Iterable[str], remove: bool = False,
           check: bool = True) -> DataFrame:
    selector = list(selector)
    if check:
        check_known(items, selector)
    found = items.where(G.matches(F.col("tags"), selector))
    if remove:
        found = found.withColumn("tags", G.remaining(F.col("tags"), [
            t for t in selector if not t.startswith("!")]))
    return found


def squeeze(found: DataFrame) -> DataFrame:
    """Mark whether the selection is a single item and whether tags are left on it."""
    single = len(found.select("id").take(2)) == 1
    return found.withColumns({"is_unique": F.lit(single), "has_tags": F.size("tags") > 0})


def by_tag_set(items: DataFrame, order: str) -> DataFrame:
    """The last item of each exact tag set."""
    return (items.groupBy(F.array_sort("tags").alias("tags"))
            .agg(F.max_by("id", order).alias("id"), F.count("*").alias("n")))


def deduplicate(items: DataFrame) -> DataFrame:
    """One row per item, and whether it came with different tag sets (an error)."""
    text = G.tag_text(F.col("tags"))
    return items.groupBy("id").agg(F.min(text).alias("tags"),
                                   (F.min(text) != F.max(text)).alias("conflict"))


def normalise(items: DataFrame, defaults: Sequence[str], synonyms: Mapping[str, str],
              disallowed: Sequence[str], exclusive: Sequence[Sequence[str]]) -> DataFrame:
    error = G.tag_error(F.col("tags"), disallowed, exclusive)
    full = G.with_synonyms(F.array_union("tags", G.words(defaults)), synonyms)
    return items.withColumn("error", error).withColumn("tags", full)


def merge_identical(items: DataFrame, digest: Column) -> DataFrame:
    """Identical items become one, carrying the tags of all.

    Tags meet one by one, so the state per digest is the set of distinct tags, not the copies.
    """
    return (items.select(digest.alias("digest"), F.explode("tags").alias("tag")).distinct()
            .groupBy("digest").agg(F.concat_ws(",", F.sort_array(F.collect_set("tag")))
                                   .alias("tags"), F.count("*").alias("n_tags")))


def resolve(items: DataFrame, selectors: Mapping[str, Sequence[str]]) -> DataFrame:
    """Items of each selector; a selector path ``sub.inner`` prefixes the name of the item.

    The selectors are a short parameter list tested inside the row, so nothing is joined.
    """
    tests = F.array_compact(F.array(*[
        F.when(G.matches(F.col("tags"), tags), F.lit(path)) for path, tags in selectors.items()]))
    hits = items.withColumn("selector", F.explode(tests))
    return hits.withColumn("name", F.concat_ws(".", F.nullif("selector", F.lit("")),
                                               F.col("id").cast("string")))


def collect_tagged(items: DataFrame, digest: Column, skipped: Iterable[str] = ()) -> DataFrame:
    """Tagged items of a source tree: ``items`` has path, kind, name and own tags (``tags``, null: none).

    Origins become tags; identical parameter sets (by ``digest``) become one with the tags of all, under the smallest name.
    Returns kind, name, digest and sorted tags.
    """
    kept = items.where(G.is_collected(F.col("path"), F.col("kind"), F.col("tags"), skipped)).select(
        "kind", "name", digest.alias("digest"),
        G.origin_tags(F.col("path"), F.col("kind"), F.col("name"), F.col("tags")).alias("tags"))
    # only parameter sets are told apart by what they hold, all others by their name
    group = F.when(F.col("kind") == "paramset", F.col("digest")).otherwise(F.col("name"))
    pairs = kept.select("kind", group.alias("_group"), "name", "digest", F.explode("tags").alias("tag"))
    return (pairs.groupBy("kind", "_group", "tag").agg(F.min("name").alias("name"), F.min("digest").alias("digest"))
            .groupBy("kind", "_group").agg(F.min("name").alias("name"), F.min("digest").alias("digest"),
                                           F.sort_array(F.collect_set("tag")).alias("tags")).drop("_group"))


def flat_selectors(selectors, submodel: str = "") -> list[tuple[str, list[str], dict]]:
    """(submodel path, tags, keywords) of nested selectors, in their order.

    A selector is a tuple or set of tags, in which dictionaries are keyword arguments; a dictionary names submodels, whose
    selectors are nested in it; a list holds several selectors.
    """
    if isinstance(selectors, list):
        return [found for one in selectors for found in flat_selectors(one, submodel)]
    if isinstance(selectors, dict):
        return [found for name, below in selectors.items()
                for found in flat_selectors(below, f"{submodel}.{name}" if submodel else name)]
    if isinstance(selectors, str):
        selectors = (selectors,)
    keywords = {k: v for part in selectors if isinstance(part, dict) for k, v in part.items()}
    return [(submodel, sorted(t for t in selectors if not isinstance(t, dict)), keywords)]


def resolve_nested(items: DataFrame, selectors) -> DataFrame:
    """Items of nested selectors as a flat list: ``nr`` (place of the selector), ``submodel``, the prefixed ``name``, ``n_found``
    (items of that selector) and ``keywords``, which ride along as a map of JSON texts; all columns of ``items`` stay.

    An item whose own column ``submodel`` is set keeps it behind the prefix. The selectors are a short parameter list
    tested inside the row.
    """
    flat = flat_selectors(selectors)
    own = F.col("submodel") if "submodel" in items.columns else F.lit(None).cast("string")
    hits = F.array_compact(F.array(*[F.when(G.matches(F.col("tags"), tags), F.struct(
        F.lit(nr).alias("nr"), F.lit(path).alias("path"),
        F.from_json(F.lit(json.dumps({k: json.dumps(v) for k, v in words.items()})), "map<string,string>").alias("keywords")))
        for nr, (path, tags, words) in enumerate(flat)]))
    found = items.withColumn("_hit", F.explode(hits))
    path = F.concat_ws(".", F.nullif(F.col("_hit.path"), F.lit("")), F.nullif(own, F.lit("")))
    found = found.withColumns({"nr": F.col("_hit.nr"), "submodel": path, "keywords": F.col("_hit.keywords")}).drop("_hit")
    found = found.withColumn("name", F.concat_ws(".", F.nullif("submodel", F.lit("")), F.col("id").cast("string")))
    counts = found.groupBy("nr").agg(F.count("*").alias("n_found"))  # a row per selector
    return found.join(F.broadcast(counts), "nr")
