"""Side tables, listings and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def side_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated table with its line numbers; ``#`` lines and blank ones are skipped, lines are stripped.

    Read whole, so that a file that isn't UTF-8 can be read as Latin-1; side tables are small.
    """
    raw = spark.read.format("binaryFile").load(path)
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    lines = raw.select(F.posexplode(F.split(utf8, "\r\n|\n|\r")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    cells = F.split("line", "\t", -1)
    return lines.select("line_no", *[F.trim(F.coalesce(F.get(cells, F.lit(k)), F.lit(""))).alias(c) for k, c in enumerate(columns)])


def listing(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """The first row of a comma-separated listing of six or more fields whose sixth is ``wanted``."""
    rows = spark.read.text(path, wholetext=False).withColumn("f", F.split("value", ","))
    return rows.filter((F.size("f") >= 6) & (F.trim(F.get("f", F.lit(5))) == wanted)).select(*[F.trim(F.get("f", F.lit(k))).alias(f"f{k}") for k in range(6)]).limit(1)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and those that begin with ``#`` are skipped."""
    lines = spark.read.text(path).withColumn("value", F.trim("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def release_asset(assets: DataFrame, prefix: str, suffix: str = ".tar.gz", name: str = "name") -> DataFrame:
    """The first asset by place whose name has a prefix and suffix."""
    return assets.filter(F.col(name).startswith(prefix) & F.col(name).endswith(suffix)).orderBy("position").limit(1)
