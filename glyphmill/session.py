"""Session helpers: a local session for tests and benches, and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Arrow batches of texts: rows and bytes that a Python worker is handed at once, where the session does
#: not say. Spark's own defaults let one batch of long texts take hundreds of megabytes on both sides.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}

#: Bytes of files that are one task's, where the session does not say.
SPLIT = {"spark.sql.files.maxPartitionBytes": ("134217728b", "32m")}


def local_session(name: str = "glyphmill", cpus: int | str = "*", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session gets a folder made for it when the setting is absent, and has the setting from
    then on; a cluster without the setting is an error rather than a silent local path.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="glyphmill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/glyphmill/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again: lineage ends there, and an executor
    that is lost costs only a reread. Returns the frame and its path."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, once an application: Python workers import it by name.

    Arrow batches and splits of files that have their default size are made small (ARROW_BATCH, SPLIT), for
    the session as a whole: set the three settings yourself, to any other value, to keep it."""
    for key, (usual, small) in (ARROW_BATCH | SPLIT).items():
        try:
            now = spark.conf.get(key)
        except Exception:  # a version of Spark without the setting
            continue
        if usual is None and int(str(now).rstrip("bB") or 0) > int(small) or now == usual:
            spark.conf.set(key, small)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="glyphmill-"), "glyphmill_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, os.path.join(root.name, p.relative_to(root)))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
    return spark
