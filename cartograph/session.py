"""Session and checkpoint helpers."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cartograph") -> SparkSession:
    """Local/test session. On a cluster, use the session the platform gives you."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. A scratch folder of this machine is created only when nothing is
    configured and the master is local; elsewhere that raises, because other
    machines could not read what is written there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="cartograph-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cartograph`` importable in Python workers (``addPyFile``).

    Python tasks (batch inference, report formatting, per-partition scans)
    unpickle functions that live in this package; executors started elsewhere
    cannot import it otherwise. The zip is built in memory and written to the
    shared checkpoint folder through Hadoop's FileSystem API, so it works with
    any cluster store. Done once per SparkContext.
    """
    import io

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    files = sorted(
        os.path.join(root, f) for root, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    digest = hashlib.sha256()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            with open(f, "rb") as fh:
                data = fh.read()
            digest.update(f.encode() + data)
            z.writestr(os.path.relpath(f, os.path.dirname(pkg)), data)
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{folder}/_pyfiles/cartograph-{digest.hexdigest()[:12]}.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        out = fs.create(hpath, True)
        try:
            out.write(bytearray(buf.getvalue()))
        finally:
            out.close()
    sc.addPyFile(path)
    _SHIPPED.add(key)


def prepare_session(spark: SparkSession) -> str:
    """Checkpoint directory and package shipping; call before running queries."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)
