"""Sessions, and making this package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Rows of a small key and value up to which a table is sent to every task: a few MB.
FEW = 100_000


def session(name: str = "tessella", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and adaptive plans."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for an application; those that have it installed use the same code."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="tessella-", suffix=".zip")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"{root.name}/{source.relative_to(root)}")
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def few(values: DataFrame) -> DataFrame:
    """A table that holds each join key once, marked to be sent to every task if counting shows that it is small."""
    return F.broadcast(values) if values.limit(FEW + 1).count() <= FEW else values


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared folder that the cluster names (spark.checkpoint.dir); only a local session without one gets a temporary folder."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessella-")
    return f"{at.rstrip('/')}/tessella-{uuid4().hex}"
