"""Parameter sets as flat tables ``set_id, path, value``: flatten, compare, update, sweep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions.labels import digest

# SI prefixed units and their factor to the reference unit.
UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "min": 60.0, "h": 3600.0, "V": 1.0, "mV": 1e-3,
         "Hz": 1.0, "kHz": 1e3, "m": 1.0, "cm": 1e-2, "mm": 1e-3, "1": 1.0}


def flatten_json(df: DataFrame, keys: Sequence[str], column: str, depth: int) -> DataFrame:
    """Dotted leaf paths of nested JSON objects; nesting beyond ``depth`` is an error.

    An empty object, and a text that begins like an object but is none, are leaves.
    """
    flat = df.select(*keys, F.lit("").alias("path"), F.col(column).alias("value"))
    for _ in range(depth):
        parsed = F.from_json("value", "map<string,string>")
        nested = F.startswith("value", F.lit("{")) & (F.size(parsed) > 0)
        parts = F.transform(
            F.map_entries(parsed),
            lambda e: F.struct(F.concat_ws(".", F.nullif("path", F.lit("")), e["key"]).alias("path"),
                               e["value"].alias("value")))
        leaf = F.array(F.struct(F.col("path"), F.col("value")))
        flat = flat.select(*keys, F.inline(F.when(nested, parts).otherwise(leaf)))
    inner = F.from_json("value", "map<string,string>")
    deep = F.when(F.startswith("value", F.lit("{")) & (F.size(inner) > 0), F.raise_error(F.concat(
        F.lit(f"parameters nested deeper than {depth}: "), "path"))).otherwise(F.col("value"))
    return flat.withColumn("value", deep)


def search(flat: DataFrame, *texts: str) -> DataFrame:
    """Leaves whose path or value contains one of the texts."""
    hits = [F.contains("path", F.lit(t)) | F.contains("value", F.lit(t)) for t in texts]
    return flat.where(reduce(lambda a, b: a | b, hits))


def subparams(flat: DataFrame, submodel: str, check: bool = True) -> DataFrame:
    """Parameters of one submodel, its prefix stripped; none at all is an error."""
    own = flat.where(F.startswith("path", F.lit(submodel + ".")))
    if check and own.isEmpty():
        raise ValueError(f"no parameters for submodel {submodel!r}")
    return own.withColumn("path", F.substr(F.col("path"), F.lit(len(submodel) + 2)))


def lookup_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Shown name of a dotted key: the full key, then without its leading parts, else itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = F.split("name", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hits = F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)),
                    lambda x: x.isNotNull())
    return df.withColumn("shown", F.coalesce(F.get(hits, 0), "name"))


def join_keys(left: DataFrame, right: DataFrame, on: Sequence[str],
              shared: Sequence[str] = ()) -> DataFrame:
    """Merge two key tables; identical duplicates collapse, unequal shared fields conflict."""
    other = right.distinct().select(*on, *[
        F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns
        if c not in on])
    joined = left.distinct().join(other, list(on))
    differ = [~F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in shared]
    return joined.withColumn("conflict", reduce(lambda a, b: a | b, differ, F.lit(False))).drop(
        *[f"_r_{c}" for c in shared])


def flat_params(df: DataFrame, set_id: str, paths: Mapping[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(p).alias("path"), c.cast("string").alias("value"))
                      for p, c in paths.items()])
    return df.select(F.col(set_id).alias("set_id"), F.inline(cells)).where("value IS NOT NULL")


def diff(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Paths whose values differ, or that only one of the two sets has."""
    a = left.select(*on, "path", F.col("value").alias("left_value"))
    b = right.select(*on, "path", F.col("value").alias("right_value"))
    return a.join(b, [*on, "path"], "full").where(
        ~F.col("left_value").eqNullSafe(F.col("right_value")))


def update(base: DataFrame, changes: DataFrame, allow_new: bool = False) -> DataFrame:
    """Base sets with the changed values; a path unknown to the set is an error unless allowed."""
    on = ["set_id", "path"]
    if not allow_new:
        unknown = changes.join(base, on, "left_anti").take(5)
        if unknown:
            raise KeyError(f"unknown parameters: {[(r.set_id, r.path) for r in unknown]}")
    new = changes.select(*on, F.col("value").alias("_new"))
    return base.join(new, on, "full" if allow_new else "left").select(
        *on, F.coalesce("_new", "value").alias("value"))


def differing(flat: DataFrame, group: str, depth: int | None = None) -> DataFrame:
    """Paths that tell the sets of a group apart: more than one value, or missing in some set."""
    sets = flat.groupBy(group).agg(F.count_distinct("set_id").alias("_sets"))
    stats = flat.groupBy(group, "path").agg(
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.count("*").alias("n_sets"))
    kept = stats.join(sets, group).where((F.col("lowest") != F.col("highest"))
                                         | (F.col("n_sets") < F.col("_sets")))
    if depth is None:
        return kept.drop("_sets")
    short = F.array_join(F.slice(F.split("path", "\\."), 1, depth), ".")
    return kept.select(group, short.alias("path")).distinct()


def outer_sweep(df: DataFrame, ranges: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the range values, per row; ranges unfold in the given order."""
    for name, values in ranges.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def inner_sweep(df: DataFrame, ranges: Mapping[str, Sequence]) -> DataFrame:
    """Ranges advanced together up to the shortest one; no range gives the row itself."""
    if not ranges:
        return df.withColumns({"sweep": F.lit(0), "uneven": F.lit(False)})
    n = min(len(v) for v in ranges.values())
    uneven = len({len(v) for v in ranges.values()}) > 1
    points = F.array(*[F.struct(F.lit(i).alias("sweep"), *[
        F.lit(v[i]).alias(name) for name, v in ranges.items()]) for i in range(n)])
    return df.select("*", F.inline(points)).withColumn("uneven", F.lit(uneven))


def named_tasks(sweep: DataFrame, fields: Sequence[str], prefix: str) -> DataFrame:
    """One task per distinct parameter row, named by its digest, with the number of repeats."""
    params = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    return (sweep.withColumn("digest", digest(params)).groupBy("digest", *fields)
            .agg(F.count("*").alias("n_rows"))
            .withColumn("task", F.concat(F.lit(prefix + "__"), "digest")))


def unit_factor(unit: Column, units: Mapping[str, float] = UNITS) -> Column:
    """Factor of a compound unit such as ``mV*s^2/ms`` to its reference units."""
    table = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])

    def product(text: Column) -> Column:
        def power(term: Column) -> Column:
            base = F.element_at(table, F.substring_index(term, "^", 1))
            exponent = F.when(F.contains(term, F.lit("^")), F.substring_index(term, "^", -1)
                              .cast("double")).otherwise(1.0)
            return F.pow(base, exponent)
        return F.aggregate(F.split(text, "\\*"), F.lit(1.0), lambda acc, t: acc * power(t))

    parts = F.split(unit, "/")
    below = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(1.0),
                        lambda acc, p: acc * product(p))
    return product(parts[0]) / below


def magnitudes(flat: DataFrame) -> DataFrame:
    """Values written as ``number unit`` in reference units; ``units.*`` paths stay as they are."""
    pattern = r"^\s*([-+0-9.eE]+)\s+([A-Za-z1][A-Za-z0-9*/^]*)\s*$"
    number = F.regexp_extract("value", pattern, 1)
    is_quantity = ~F.startswith("path", F.lit("units.")) & (number != "")
    return flat.withColumn("magnitude", F.when(
        is_quantity, number.cast("double") * unit_factor(F.regexp_extract("value", pattern, 2))))
