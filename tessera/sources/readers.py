"""Readers with explicit rules for bad rows; any path that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera.sources.json_arrays import CHUNK, json_texts, parsed
from tessera.sources.ranges import readable

FORMATS = {".jsonl": "json", ".json": "json", ".parquet": "parquet", ".csv": "csv", ".orc": "orc", ".txt": "text"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def strict_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, others that aren't objects of the schema fail the job."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    bad = ~F.coalesce(F.ltrim("value").startswith("{"), F.lit(False))
    value = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))).otherwise(F.col("value"))
    return rows.select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def lenient_lines(spark: SparkSession, path: str, schema: StructType, bad: str = "_bad") -> DataFrame:
    """JSON lines; those that can't be parsed have their text in the column named by bad."""
    full = StructType([*schema.fields]).add(bad, "string")
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


def lines_or_nothing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return strict_lines(spark, path, schema) if _exists(spark, path) else spark.createDataFrame([], schema)


def wrapped(spark: SparkSession, path: str, schema: StructType, names: tuple[str, ...] = ("data", "annotations", "samples"), chunk: int = CHUNK, joined: bool = False) -> DataFrame:
    """JSON files that are a list of rows, or an object that holds one under one of the names; read in chunks by many tasks.

    joined: the files of a folder are parts of one document. Where tasks can't open the path themselves, each document is one task's.
    """
    if readable(path):
        return parsed(json_texts(spark, path, names, chunk, joined), F.from_json("value", schema))
    rows = spark.read.option("wholetext", True).text(path)
    if joined:
        files = rows.select(F.struct(F.input_file_name().alias("name"), "value").alias("f"))
        rows = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["value"]), "").alias("value"))
    kind = ArrayType(schema)
    listed = F.from_json("value", kind)
    held = [F.from_json(F.get_json_object("value", f"$.{n}"), kind) for n in names]
    return rows.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(*held))).alias("r")).select("r.*")


def load(spark: SparkSession, paths: str, schema: StructType | None = None) -> DataFrame:
    """Files of a comma-separated list, by suffix, united by name; NaN is null."""
    out = None
    for path in (p.strip() for p in paths.split(",") if p.strip()):
        kind = FORMATS.get(suffix(path))
        if not kind:
            raise ValueError(f"no reader for {path}")
        if kind == "json" and schema is not None:
            df = wrapped(spark, path, schema) if suffix(path) == ".json" else strict_lines(spark, path, schema)
        else:
            reader = spark.read if schema is None else spark.read.schema(schema)
            df = reader.format(kind).option("header", True).option("multiLine", suffix(path) == ".json").load(path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    floats = [c for c, t in out.dtypes if t in ("double", "float")]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def select_samples(
    df: DataFrame, order: list[str], tasks: list[str] | None = None, ids: list[str] | None = None, task: str = "task", key: str = "sample_id", offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Rows of some tasks and ids (any case), then a slice of them in order."""
    if tasks:
        df = df.where(F.lower(F.trim(task)).isin([x.strip().lower() for x in tasks]))
    if ids:
        df = df.where(F.col(key).cast("string").isin(ids))
    if offset or limit is not None:
        df = df.orderBy(*order)
        df = df.offset(offset) if offset else df
        df = df.limit(limit) if limit is not None else df
    return df


def frame_gaps(frames: DataFrame, video: str, index: str, manifest: DataFrame, count: str) -> DataFrame:
    """Videos of the manifest with why their frames aren't complete: missing, short, gap, or none."""
    found = frames.groupBy(video).agg(F.count_distinct(index).alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    rows = manifest.join(found, video, "left")
    why = F.when(F.col("n").isNull(), "missing").when(F.col("hi") - F.col("lo") + 1 != F.col("n"), "gap").when(F.col("n") < F.col(count), "short")
    return rows.select(*manifest.columns, why.alias("fault"))
