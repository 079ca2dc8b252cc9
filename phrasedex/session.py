"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(
    master: str | None = None,
    app: str = "phrasedex",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with AQE on; on a cluster pass ``master=None`` and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # No broadcast from plan-time size estimates (wrong after explode);
        # explicit broadcasts are size-checked, and AQE may still broadcast a
        # side whose measured shuffle output is small.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder is read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Only when neither is set and the master is ``local``, as in
    tests, a local folder is created and registered as the checkpoint dir; on a
    cluster this is an error, for executors would write to disks of their own.
    """
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            spark.sparkContext.setCheckpointDir(base)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="phrasedex-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/") + "/" + f"{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for code that needs a plain path (tests only)."""
    return path[len("file:"):] if path.startswith("file:") else path


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size of ``df`` in bytes, from file sizes; used for sizing only, never for results.

    Where Catalyst has no size (rows that come from Python), 4 KB a row are assumed.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 57 else 4096 * df.count()


def parts_for(n_bytes: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(n_bytes / per_part))


_SHIPPED: set[str] = set()

#: Rows per Arrow batch between Spark and its Python workers; texts may be long.
ARROW_ROWS = 1000


def ship_package(spark) -> None:
    """Send this package to the session's Python workers, once per application, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[0]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


__all__ = ["get_session", "shared_dir", "local_path", "plan_bytes", "parts_for", "ship_package", "ARROW_ROWS"]
