"""Versioned Parquet tables: a fresh folder for each release, a pointer that is swapped, retention, bundles."""

from __future__ import annotations

import json
import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("chapters", "passages", "vectors")
POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[str]:
    _, p, fs = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def next_version(taken: list[str], day: date) -> str:
    """The day, or the day with the next free ``-rN`` (N from 2)."""
    base, n = day.isoformat(), 2
    if base not in taken:
        return base
    while f"{base}-r{n}" in taken:
        n += 1
    return f"{base}-r{n}"


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], day: date) -> str:
    """Write all tables under a new version with its manifest, then point at it; readers see the old or the new one whole."""
    version = next_version(versions(spark, root), day)
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    point_at(spark, root, version, sorted(tables))
    return version


def point_at(spark: SparkSession, root: str, version: str, tables: list[str]) -> None:
    """Write the manifest of a version whose tables are there, and let the pointer name it."""
    _write(spark, f"{root}/{version}/manifest.json", json.dumps({"version": version, "tables": sorted(tables)}))
    _write(spark, f"{root}/{POINTER}.new", version)
    jvm, new, _ = _fs(spark, f"{root}/{POINTER}.new")
    # A rename over the old pointer is one step of the file system: readers find the old or the new one, never none.
    fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fc.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), options)


def _write(spark: SparkSession, path: str, text: str) -> None:
    _, p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def current(spark: SparkSession, root: str) -> str:
    row = spark.read.text(f"{root}/{POINTER}").first()
    if row is None or not re.fullmatch(r"\d{4}-\d{2}-\d{2}(-r\d+)?", row[0]):
        raise ValueError("no version is published")
    return row[0]


def open_corpus(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version, also as temporary views."""
    at = f"{root}/{current(spark, root)}"
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{at}/manifest.json").collect()))
    out = {name: spark.read.parquet(f"{at}/{name}") for name in manifest["tables"]}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def retire(spark: SparkSession, root: str, retain: int = 2) -> list[str]:
    """Drop all but the newest ``retain`` versions besides the current one; returns what went."""
    now = current(spark, root)
    gone = sorted((v for v in versions(spark, root) if v != now), key=_age, reverse=True)[retain:]
    for v in gone:
        _, p, fs = _fs(spark, f"{root}/{v}")
        fs.delete(p, True)
    return gone


def _age(version: str) -> tuple[str, int]:
    day, _, n = version.partition("-r")
    return day, int(n or 1)


def asset_name(release: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}-r\d+", release):
        raise ValueError("a release is named YYYY-MM-DD-rN")
    return f"corpus-{release}.tar.gz"


def checked_identifier(name: str) -> str:
    """A quoted SQL identifier."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name):
        raise ValueError("not an identifier")
    return f"`{name}`"


def kept_versions(log: DataFrame, retain: int = 2, name: str = "version") -> DataFrame:
    """A log of versions with ``keep``: the newest ``retain`` by name."""
    from pyspark.sql import Window

    return log.withColumn("keep", F.row_number().over(Window.partitionBy().orderBy(F.desc(name))) <= retain)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(member, size, sha256) of the files under a folder, for manifests; a member is named by its place in the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.element_at(F.split("path", F.lit(f"/{path.rstrip('/').rpartition('/')[2]}/"), 2), -1)
    return files.select(inside.alias("member"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_bundle(spark: SparkSession, root: str, version: str) -> str:
    """A manifest of all files of a version beside its folder, and the manifest's own digest beside that; returns the digest.

    A manifest has a line for each file, which are as many as tasks have written.
    """
    digests(spark, f"{root}/{version}").orderBy("member").coalesce(1).write.mode("overwrite").json(f"{root}/{version}.manifest")
    whole = _manifest_digest(spark, root, version)
    _write(spark, f"{root}/{version}.manifest.sha256", whole)
    return whole


def _manifest_digest(spark: SparkSession, root: str, version: str) -> str:
    """SHA-256 of the sorted SHA-256 digests of a manifest's entries, which are as many as files."""
    d = spark.read.schema("member string, size long, sha256 string").json(f"{root}/{version}.manifest")
    entry = F.sha2(F.to_json(F.struct("member", "size", "sha256")), 256)
    return d.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("d")).first().d


def bundle_faults(spark: SparkSession, root: str, version: str) -> DataFrame:
    """What is wrong with a version's files: members that are missing, not declared, or of another size or digest; none if it is whole.

    A manifest that was changed since it was written is an error before any file is looked at.
    """
    said = "".join(r[0] for r in spark.read.text(f"{root}/{version}.manifest.sha256").collect())
    if said != _manifest_digest(spark, root, version):
        raise ValueError("the manifest isn't the one that was written")
    declared = spark.read.schema("member string, size long, sha256 string").json(f"{root}/{version}.manifest")
    found = digests(spark, f"{root}/{version}").select("member", F.col("size").alias("found_size"), F.col("sha256").alias("found_sha256"))
    return declared.join(found, "member", "full_outer").filter(~(F.col("size").eqNullSafe(F.col("found_size")) & F.col("sha256").eqNullSafe(F.col("found_sha256"))))
