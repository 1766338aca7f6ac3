"""Tag selection as Column expressions over ``array<string>`` tags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(tags: Iterable[str]) -> Column:
    return F.array(*[F.lit(t) for t in tags]).cast("array<string>")


def has_all(tags: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, tags)) == 0


def has_none(tags: Column, unwanted: Column) -> Column:
    return ~F.arrays_overlap(tags, unwanted)


def matches(tags: Column, selector: Iterable[str]) -> Column:
    """A selector names the tags an item must have; ``!tag`` names one it must not have."""
    wanted = [t for t in selector if not t.startswith("!")]
    unwanted = [t[1:] for t in selector if t.startswith("!")]
    test = has_all(tags, words(wanted))
    return test & has_none(tags, words(unwanted)) if unwanted else test


def remaining(tags: Column, removed: Iterable[str]) -> Column:
    return F.array_except(tags, words(removed))


def with_synonyms(tags: Column, synonyms: Mapping[str, str]) -> Column:
    """Replace synonyms until nothing changes; a cycle is an error."""
    resolved: dict[str, str] = {}
    for tag in synonyms:
        end, seen = tag, {tag}
        while end in synonyms:
            end = synonyms[end]
            if end in seen:
                raise ValueError(f"synonyms of {tag!r} form a cycle")
            seen.add(end)
        resolved[tag] = end
    table = F.create_map(*[F.lit(x) for pair in resolved.items() for x in pair])
    return F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), t)))


def tag_error(tags: Column, disallowed: Sequence[str],
              exclusive: Sequence[Sequence[str]]) -> Column:
    """Text of what is wrong with a tag set, null where nothing is."""
    bad = F.array_sort(F.array_intersect(tags, words(disallowed)))
    error = F.when(F.size(bad) > 0, F.concat(F.lit("disallowed: "), F.concat_ws(",", bad)))
    for group in exclusive:
        both = F.array_sort(F.array_intersect(tags, words(group)))
        error = F.coalesce(error, F.when(F.size(both) > 1, F.concat(
            F.lit("exclusive: "), F.concat_ws(",", both))))
    return error


def tag_text(tags: Column) -> Column:
    return F.concat_ws(",", F.array_sort(tags))


def origin_tags(path: Column, kind: Column, name: Column, own: Column) -> Column:
    """Tags of an item with those of its origin: the folder of its file, then by kind.

    A model also gets the name of its class; a parameter set the name of its file without ending, or its own name where it
    stands in a source file. Objectives and priors get the folder alone.
    """
    folder = F.try_element_at(F.split(path, "/"), F.lit(-2))
    file = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    extra = F.when(kind == "model", name).when(
        kind == "paramset", F.when(F.endswith(path, F.lit(".paramset")), file).otherwise(name))
    return F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")),
                                     F.array_compact(F.array(folder, extra))))


def is_collected(path: Column, kind: Column, own: Column, skipped: Iterable[str] = ()) -> Column:
    """Whether an item is collected: not from a hidden, private or skipped folder; priors only with tags of their own."""
    folder = F.try_element_at(F.split(path, "/"), F.lit(-2))
    seen = ~folder.rlike("^[_.]") & ~folder.isin(list(skipped)) if skipped else ~folder.rlike("^[_.]")
    return F.coalesce(seen, F.lit(False)) & ((kind != "prior") | own.isNotNull())
