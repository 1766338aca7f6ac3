"""Catalogues of recorded trials: scanning, extending, describing and loading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.functions.labels import extract

SLOT, RANGE = "_slot", "_range"
DESC_SCHEMA = "project string, accessor string, trial map<string,string>"


def scan_directory(spark: SparkSession, folder: str, extension: str,
                   fields: Mapping[str, str]) -> DataFrame:
    """Catalogue of the files below a folder; only names are read, not the contents."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}")
             .option("recursiveFileLookup", "true").load(folder).select("path"))
    return parse_files(files, extension, fields)


def parse_files(files: DataFrame, extension: str, fields: Mapping[str, str]) -> DataFrame:
    """Key fields by one pattern each from the file name; sorted by key."""
    name = F.substring_index("path", "/", -1)
    named = files.withColumn("filename", name).where(F.endswith("filename", F.lit(extension)))
    return named.withColumns({f: extract(F.col("path"), p) for f, p in fields.items()}).orderBy(
        *fields, "path")


def add_trials(catalogue: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append trials; a key that is already catalogued is an error."""
    clash = new.join(catalogue, list(keys), "left_semi").select(*keys).take(5)
    if clash:
        raise ValueError(f"trials already present: {[tuple(r) for r in clash]}")
    return catalogue.unionByName(new)


def load(series: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series of the wanted trials only."""
    return series.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def _slot(by: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(slots)).cast("int")


def write_series(series: DataFrame, path: str, by: str, order: str = "k", span: int = 1_000_000,
                 slots: int = 64, mode: str = "overwrite") -> None:
    """Store series in folders of (slot of the trial, range of the order column).

    A trial has one of ``slots`` folders per ``span`` of the order column. Rows are dealt by their place in (slot, range,
    trial, order), cut by a sample, so a long trial is spread over tasks and files and short ones share them; inside a file
    rows are sorted, which makes its statistics of trial and order narrow. The layout is kept with the column ``order``.
    """
    place = [SLOT, RANGE, by, order]
    spread = series.withColumns({SLOT: _slot(F.col(by), slots), RANGE: F.floor(F.col(order) / span).cast("long")})
    kept = spread.withMetadata(order, {"series_by": by, "series_span": span, "series_slots": slots})
    kept.repartitionByRange(*place).sortWithinPartitions(*place).write.mode(mode).partitionBy(
        SLOT, RANGE).parquet(path)


def read_series(spark: SparkSession, path: str, wanted: DataFrame | None = None, first: float | None = None,
                last: float | None = None) -> DataFrame:
    """Stored series: of the wanted trials only, and between two places of the order column, both included.

    The range and the slots of the wanted trials choose folders before a file is opened; the statistics inside the files do
    the rest.
    """
    store = spark.read.parquet(path)
    found = [f for f in store.schema.fields if "series_by" in (f.metadata or {})]
    if len(found) != 1:
        raise ValueError(f"{path} is no store of series")
    order, layout = found[0].name, found[0].metadata
    by, span = layout["series_by"], layout["series_span"]
    for edge, above in ((first, True), (last, False)):
        if edge is not None:
            at, cell = F.col(order), F.col(RANGE)
            store = store.where((at >= edge) & (cell >= edge // span) if above else (at <= edge) & (cell <= edge // span))
    if wanted is not None:
        keys = wanted.select(by).distinct().withColumn(SLOT, _slot(F.col(by), layout["series_slots"]))
        chosen = keys.select(SLOT).distinct().limit(layout["series_slots"]).collect()  # a slot at most once each
        store = store.where(F.col(SLOT).isin([r[0] for r in chosen])).join(keys, [SLOT, by], "left_semi")
    return store.drop(SLOT, RANGE)


def get_trial(catalogue: DataFrame, wanted: DataFrame, keys: Sequence[str],
              label: str = "label") -> DataFrame:
    """Requests given by key or by label, with the full catalogue row."""
    by_key = wanted.where(F.col(label).isNull()).drop(label).join(catalogue, list(keys))
    by_label = wanted.where(F.col(label).isNotNull()).drop(*keys).join(catalogue, label)
    return by_key.unionByName(by_label)


def common_folders(files: DataFrame, group: Sequence[str], folder: str) -> DataFrame:
    """Deepest folder common to a group: the shared prefix of its smallest and largest path."""
    parts = F.split(folder, "/")
    ends = files.groupBy(*group).agg(F.min(parts).alias("_a"), F.max(parts).alias("_b"),
                                     F.count("*").alias("n_files"))
    same = F.zip_with("_a", "_b", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_break = F.array_position(same, False)
    keep = F.when(first_break == 0, F.size("_a").cast("long")).otherwise(first_break - 1)
    return ends.select(*group, "n_files",
                       F.concat_ws("/", F.slice("_a", F.lit(1), keep.cast("int"))).alias("folder"))


def metadata_files(files: DataFrame, group: Sequence[str], folder: str, name: Column,
                   listing: DataFrame, required: bool = False) -> DataFrame:
    """Metadata file per group, in the folder common to it, and whether it exists."""
    found = common_folders(files, group, folder).withColumn(
        "metadata", F.concat_ws("/", "folder", name))
    found = found.join(listing.select(F.col("path").alias("metadata"), F.lit(True).alias("exists"))
                       .distinct(), "metadata", "left")
    found = found.withColumn("exists", F.coalesce("exists", F.lit(False)))
    if required:
        missing = found.where("NOT exists").take(5)
        if missing:
            raise FileNotFoundError(f"no metadata file: {[r['metadata'] for r in missing]}")
    return found


def nearest_format(files: DataFrame, listing: DataFrame, key: str, path: str) -> DataFrame:
    """Format file in the nearest ancestor folder of each file, never above the first part.

    ``listing`` is ``folder, name``. Several files in one folder are tried in name order.
    """
    parts = F.split(path, "/")
    depths = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    above = files.where(F.size(parts) > 1).select(key, parts.alias("_p"),
                                                  F.explode(depths).alias("depth"))
    above = above.withColumn("folder", F.concat_ws("/", F.slice("_p", F.lit(1), F.col("depth"))))
    formats = listing.groupBy("folder").agg(F.min("name").alias("format"),
                                            F.count("*").alias("n_formats"))
    hits = above.join(formats, "folder").groupBy(key).agg(
        F.max_by(F.struct("folder", "format", "n_formats"), "depth").alias("h"))
    return hits.select(key, "h.folder", "h.format", (F.col("h.n_formats") > 1).alias("ambiguous"))


def to_desc(trials: DataFrame, project: str, accessor: str, fields: Sequence[str]) -> DataFrame:
    trial = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    return trials.select(F.to_json(F.struct(
        F.lit(project).alias("project"), F.lit(accessor).alias("accessor"),
        trial.alias("trial"))).alias("desc"))


def from_desc(desc: DataFrame, project: str, fields: Sequence[str],
              files: DataFrame | None = None, file_field: str | None = None) -> DataFrame:
    """Trials of a description; another project, wrong fields or missing files are errors."""
    rows = desc.select(F.from_json("desc", DESC_SCHEMA).alias("d")).select("d.*")
    wrong = rows.where((F.col("project") != project) | F.col("project").isNull()
                       | (F.array_sort(F.map_keys("trial")) != F.array_sort(
                           F.array(*[F.lit(f) for f in fields])))).take(1)
    if wrong:
        raise ValueError(f"description does not fit project {project!r}: {wrong[0]}")
    trials = rows.select(*[F.col("trial")[f].alias(f) for f in fields])
    if files is not None:
        gone = trials.join(files, file_field, "left_anti").take(3)
        if gone:
            raise FileNotFoundError(f"files of the description are missing: {gone}")
    return trials


def save_points(points: DataFrame, path: str, replace: bool = True) -> None:
    points.write.mode("overwrite" if replace else "append").parquet(path)


def load_points(spark: SparkSession, path: str, current: DataFrame | None = None) -> DataFrame:
    """Stored points, replacing the current ones or appended to them."""
    stored = spark.read.parquet(path)
    return stored if current is None else current.unionByName(stored)


def compare_names(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Names of two sets with where they occur: both, left or right."""
    marked = left.select(*on, F.lit(1).alias("_w")).unionByName(
        right.select(*on, F.lit(2).alias("_w")))
    return marked.groupBy(*on).agg(F.bit_or("_w").alias("_w")).select(
        *on, F.when(F.col("_w") == 3, "both").when(F.col("_w") == 1, "left").otherwise("right")
        .alias("side"))


def missing_inputs(wanted: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    return wanted.select(*on).exceptAll(present.select(*on)).distinct()
