"""Scans: labelled matrices, sidecars, results, rules, sensors, series, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from outlyer.functions.ranking import row_numbers

#: The univariate series that come with the engine's examples, and their (seasonal) AR orders.
SERIES = {
    "airline": (0, 1, 1, 12), "aus_beer": (3, 1, 0, 4), "lynx": (4, 1, 1, 12), "fisher_temp": (4, 1, 0),
    "shampoo": (5, 1, 0), "us_accident": (4, 1, 0, 12), "wolf_sunspot": (4, 1, 1, 12),
}


def read_csv(spark: SparkSession, path: str | list[str], header: bool = True, sep: str = ",", schema: str | StructType | None = None, encoding: str = "UTF-8", columns: list[str] | None = None) -> DataFrame:
    """A CSV file; with ``columns`` only those are parsed."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def with_ids(rows: DataFrame, order: list[str], out: str = "id", first: int = 0) -> DataFrame:
    """Contiguous ids in the given order."""
    return row_numbers(rows, order, out).withColumn(out, F.col(out) + first)


def with_line_numbers(lines: DataFrame, out: str = "line") -> DataFrame:
    """0-based numbers of the rows as they lie in the files: two passes, no sort."""
    tagged = lines.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    from pyspark.sql import Window

    w = Window.partitionBy().orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).withColumn("__f", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    return tagged.join(F.broadcast(counts), "__p").withColumn(out, F.col("__f") + F.col("__i")).drop("__p", "__i", "__f")


def labelled_matrix(rows: DataFrame, label: str, features: list[str], anomaly: str = "anomaly") -> DataFrame:
    """``rows`` with ``y`` (1 for the anomaly label) and ``x``, an array of doubles."""
    return rows.withColumns({"y": (F.col(label) == anomaly).cast("int"), "x": F.array(*(F.col(f).cast("double") for f in features))})


def read_dataset(spark: SparkSession, root: str, name: str, fid: int = 1) -> DataFrame:
    """``id, y, x`` and the features of an anomaly CSV: label first, features after."""
    df = with_line_numbers(read_csv(spark, f"{root}/anomaly/{name}/fullsamples/{name}_{fid}.csv"), "id")
    label, *features = [c for c in df.columns if c != "id"]
    return labelled_matrix(df, label, features)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Several sample files with ``fid`` from the file name."""
    df = read_csv(spark, pattern)
    return df.withColumn("fid", F.regexp_extract(F.input_file_name(), r"_(\d+)\.csv$", 1).cast("int"))


def with_sidecar(rows: DataFrame, sidecar: DataFrame, id_col: str = "id") -> DataFrame:
    """Columns of a file with the same rows in the same order, joined by row number."""
    return rows.join(with_line_numbers(sidecar, id_col), id_col)


def precomputed_scores(rows: DataFrame, scores: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` with ``scores``: all columns of the score file but the first; row counts must agree."""
    if rows.count() != scores.count():
        raise ValueError("scores and rows differ in number")
    numbered = with_line_numbers(scores, id_col)
    return rows.join(numbered.select(id_col, F.array(*(F.col(c).cast("double") for c in scores.columns[1:])).alias("scores")), id_col)


def results_long(rows: DataFrame) -> DataFrame:
    """``fid, run, iter, value`` from rows of fid, run and values; 1-based ids become 0-based, padding goes."""
    fid, run, *values = rows.columns
    long = rows.select(F.col(fid).alias("fid"), F.col(run).alias("run"), F.posexplode(F.array(*(F.col(v).cast("double") for v in values))).alias("iter", "value"))
    return long.where("value is not null and value >= 0").withColumn("value", F.col("value") - 1)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``rule``: the trimmed lines that are not empty."""
    return spark.read.text(path).select(F.trim("value").alias("rule")).where(F.length("rule") > 0)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """``line, value``: what follows the line ``@data``."""
    lines = with_line_numbers(spark.read.text(path))
    start = lines.where(F.lower(F.trim("value")) == "@data").agg(F.min("line").alias("start"))
    return lines.crossJoin(F.broadcast(start)).where("line > start and trim(value) <> ''").select((F.col("line") - F.col("start") - 1).alias("line"), "value")


def sensors(rows: DataFrame, sensor: str, prefix: str = "M") -> DataFrame:
    """Rows of sensors whose name starts with the prefix."""
    return rows.where(F.col(sensor).startswith(prefix))


def read_series(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``t, value`` of a series file in file order."""
    return with_line_numbers(read_csv(spark, path), "t").select("t", F.col(value).cast("double").alias("value"))


def stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """An unbounded scan of Parquet files, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
