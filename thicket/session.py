"""What a session gives: the package on the executors, the folder that all of them share, and how many tasks rows are dealt to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once an application, so that Python stages run without an installed copy."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="thicket-src-"), "thicket-src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


#: Bytes of the files read for which there is a task: a few hundred thousand rows.
SHARE = 4 << 20


def shares(df: DataFrame) -> int:
    """Tasks for the rows of a frame: one for each ``SHARE`` of its files, as many as there are cores at least.

    A shuffle into so many stays as it is. Others are merged by compressed bytes, which for short rows are millions in one task.
    """
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = [n for n in sizes if n < 1 << 60]  # rows from elsewhere than files count as 2^63 - 1
    least = spark.sparkContext.defaultParallelism if len(known) == len(sizes) else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sum(known) // SHARE))


_LOCAL_SHARED: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session does not name one and runs in one process (tests) a fresh local folder is used, one per application; on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = "file://" + tempfile.mkdtemp(prefix="thicket-")
    return _LOCAL_SHARED[app]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/thicket-{name}-{uuid.uuid4().hex[:12]}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return at.toString()
