"""Sources and sinks: JSON-lines manifests, CSV, label files, arrays; every sink is an atomic Spark write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from skylattice.contracts import ContractError, duplicates, failing, require


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a malformed line is an error. Rows have no order of their
    own: operators that need positions take a column of the manifest."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_checked(spark: SparkSession, path: str, schema: str, **checks: Column) -> DataFrame:
    """JSON lines whose rows pass all checks; an error names the first rows and what they fail."""
    rows = read_manifest(spark, path, schema)
    require(failing(rows, **checks), "a row breaks a rule")
    return rows


def read_arrays(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row for each name of a map name -> samples in Parquet: the columns beside it, name, samples. Samples must be
    there and finite."""
    df = spark.read.parquet(path)
    out = df.select(*[c for c in df.columns if c != column], F.explode(column).alias("name", "samples"))
    good = (F.size("samples") > 0) & F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    require(failing(out, samples=good).select("name", "failed"), "an array is empty or not finite")
    return out


def binary_mask(df: DataFrame, column: str) -> DataFrame:
    """A mask of numbers from 0 to 1 as 0/1, from 0.5 on 1; other numbers are an error."""
    require(failing(df, mask=F.forall(column, lambda x: x.between(0, 1))).select("failed"), "a mask has values beyond 0 and 1")
    return df.withColumn(column, F.transform(column, lambda x: (x >= 0.5).cast("int")))


def concatenate_shards(spark: SparkSession, paths: list[str], schema: str, path: str, key: str) -> None:
    """JSON lines of several shards as one output, read and written in one pass; a key in two shards is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    require(duplicates(rows, key), "a row is in two shards")
    rows.write.mode("errorifexists").json(path)


def read_manifest_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line, text: the lines that don't parse, with their numbers (from 1, blank lines count), instead of an error.

    A file is read in blocks by many tasks, none of which knows how many lines come before its own: lines are numbered
    within their block, and the sizes of the blocks before it, one row for each block, give the rest.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start")]
    lines = spark.read.text(path).select(*block, F.col("value").alias("text"), F.monotonically_increasing_id().alias("__at"))
    blocks = lines.groupBy("file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "__start", (F.coalesce(before, F.lit(0)) + 1 - F.col("__first")).alias("__shift"))
    parsed = F.from_json("text", f"{schema}, __bad STRING", {"columnNameOfCorruptRecord": "__bad"})["__bad"]
    bad = lines.where((F.trim("text") != "") & parsed.isNotNull())
    return bad.join(blocks, ["file", "__start"]).select("file", (F.col("__at") + F.col("__shift")).alias("line"), "text")


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header; missing required columns are an error."""
    header = spark.read.option("header", True).csv(path).columns
    if lacking := set(required) - set(header):
        raise ContractError(f"columns are missing: {sorted(lacking)}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def select_split(df: DataFrame, split: str, ids: tuple[str, ...] = ("window_id", "injection_id", "sample_id", "id")) -> DataFrame:
    """Rows of a split with `row_id`, the first id column that is in all of them; it must be unique."""
    rows = df.where(F.col("split") == split)
    there = [c for c in ids if c in df.columns]
    counts = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in there]).first()
    name = next((c for c in there if counts[c] == counts["n"]), None)
    if name is None:
        raise ContractError("no id column is in all rows")
    out = rows.withColumn("row_id", F.col(name).cast("string"))
    require(duplicates(out, "row_id"), "ids repeat")
    return out


def read_labelled_images(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """Image files with their label files, joined by file stem: sizes, digests, polygons and errors. A label file may be
    empty (no polygons). An image without a label, a label without an image, and a stem that is there twice are errors."""
    stem = lambda: F.regexp_extract(F.col("path"), r"([^/]+)\.[^./]+$", 1)
    a = spark.read.format("binaryFile").load(images).select(stem().alias("sample_id"), F.col("path").alias("image"), F.sha2("content", 256).alias("image_sha256"), F.col("length").alias("image_bytes"))
    # Spark's file sources leave empty files out, and an image without objects has one
    files = spark.createDataFrame(spark.sparkContext.binaryFiles(labels).mapValues(bytearray), "path string, content binary")
    b = files.select(stem().alias("sample_id"), F.col("path").alias("label"), F.sha2("content", 256).alias("label_sha256"), F.decode("content", "UTF-8").alias("__text"))
    for side in (a, b):
        require(duplicates(side, "sample_id"), "a stem is there twice")
    joined = a.join(b, "sample_id", "full_outer")
    require(joined.where("image is null or label is null").select("sample_id", "image", "label"), "an image or a label is alone")
    return parse_polygons(joined, "__text").drop("__text")


def parse_polygons(df: DataFrame, text: str) -> DataFrame:
    """Lines `class x y x y ...` as polygons (class, points) and the numbers of lines that break the format."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: F.trim(s) != "")
    numbers = F.transform(lines, lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.try_cast("double")))
    good = lambda v: (F.size(v) >= 7) & (F.size(v) % 2 == 1) & F.forall(v, lambda x: x.isNotNull()) & F.forall(F.slice(v, 2, F.size(v)), lambda x: x.between(0, 1))
    return (
        df.withColumn("__v", numbers)
        .withColumn("polygons", F.transform(F.filter("__v", good), lambda v: F.struct(v[0].cast("int").alias("class"), F.slice(v, 2, F.size(v)).alias("points"))))
        .withColumn("bad_lines", F.filter(F.transform("__v", lambda v, i: F.when(~good(v), i + 1)), lambda x: x.isNotNull()))
        .drop("__v")
    )


def series_segment(df: DataFrame, start: str, rate: str, values: str, centre: float, duration: float) -> DataFrame:
    """The samples of [centre - duration / 2, centre + duration / 2) of each series that holds all of them."""
    first = F.round((F.lit(centre - duration / 2) - F.col(start)) * F.col(rate)).cast("int")
    n = F.round(F.lit(duration) * F.col(rate)).cast("int")
    inside = (first >= 0) & (first + n <= F.size(values))
    return df.where(inside).withColumn(values, F.slice(values, first + 1, n)).withColumn(start, F.lit(centre - duration / 2))


def quality_seconds(df: DataFrame) -> DataFrame:
    """One row for each second of per-second masks; a missing injection mask has all bits."""
    injections = F.coalesce(F.col("injmask"), F.array_repeat(F.lit(-1).cast("bigint"), F.size("dqmask")))
    return df.select("ifo", "gps_start", F.posexplode(F.arrays_zip(F.col("dqmask").alias("dq"), injections.alias("inj"))).alias("second", "m")).select("ifo", (F.col("gps_start") + F.col("second")).alias("gps"), F.col("m.dq").alias("dq"), F.col("m.inj").alias("inj"))


def write_manifest(df: DataFrame, path: str, once: bool = False) -> None:
    """JSON lines; `once` refuses to replace an earlier output."""
    df.write.mode("errorifexists" if once else "overwrite").json(path)


def _finite(field: Column, kind: DataType) -> Column:
    """Whether all numbers of a field are finite, nested ones too; nulls are."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.coalesce(~F.isnan(field) & (F.abs(field) < float("inf")), F.lit(True))
    if isinstance(kind, StructType):
        parts = [_finite(field[f.name], f.dataType) for f in kind.fields]
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.forall(field, lambda x: _finite(x, kind.elementType)), F.lit(True))
    if isinstance(kind, MapType):
        return F.coalesce(F.forall(F.map_values(field), lambda x: _finite(x, kind.valueType)), F.lit(True))
    return F.lit(True)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report with its fields in order of their names; NaN and infinities are refused wherever they stand."""
    require(failing(df, **{f.name: _finite(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}).select("failed"), "a report holds a number that isn't finite")
    df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: str) -> None:
    """CSV with a header, files in order of a column."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("header", True).csv(path)


def write_split_layout(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet in a folder for each split, so that readers of one split list no other files."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
