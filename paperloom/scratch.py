"""Intermediate tables in a folder that the driver and all executors see; writing one cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, seen by the driver and all executors.

    It is ``spark.checkpoint.dir`` where that is set.  Where it isn't, a single
    local JVM (tests) gets a temporary folder, and a cluster its warehouse folder
    if that was set to one that all machines see; else nothing is written.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _scratch:
        base = sc.getConf().get("spark.checkpoint.dir", None)
        if not base:
            single = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            if single:
                base = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
                atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
            else:
                base = sc.getConf().get("spark.sql.warehouse.dir", None)
                if not base or base.startswith("file:"):
                    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}"
        _scratch[sc.applicationId] = root
        atexit.register(_remove, sc, root)
    return _scratch[sc.applicationId]


def _remove(sc, path: str) -> None:
    try:
        jvm = sc._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its scratch folder stays for the cluster's own clean-up
        return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the scratch folder and read it again.

    The result depends on files only: an executor that is lost later takes no
    earlier stage with it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    root = scratch_root(df.sparkSession)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith(root) or f"/{root.rsplit('/', 1)[-1]}/" in path:
            _remove(sc, path)
