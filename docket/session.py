"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Large texts: keep Arrow batches handed to Python small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Paid, non-deterministic calls must not run twice on purpose.
    "spark.speculation": "false",
}


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def build_session(master: str = "local[*]", app: str = "docket", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    if is_local(master):  # the driver JVM is the executor; a cluster keeps its own sizes
        conf.update({"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"})
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The location is read from ``spark.checkpoint.dir`` (or the context's
    checkpoint dir). Only when neither is set -- local runs and tests -- a
    temporary folder is created and registered as the checkpoint dir.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            sc.setCheckpointDir(base)  # so Dataset.checkpoint() uses the same location
            base = sc.getCheckpointDir() or base
    if not base and not is_local(sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="docket-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    path = base.rstrip("/") + "/" + name + "-" + uuid.uuid4().hex[:12]
    if path.startswith("file:") or path.startswith("/") and is_local(sc.master):
        os.makedirs(path.replace("file:", "", 1), exist_ok=True)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docket`` importable in the Python workers of this application.

    Python stages (``mapInPandas``) pickle functions by module reference, so the
    workers must import this package. It is zipped once on the driver and
    distributed with ``addPyFile`` (Spark copies it to every executor).
    """
    import zipfile

    import docket

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(docket.__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="docket-pyfiles-"), "docket.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
