"""Session helpers: checkpoint folder, parallelism of a scan, and materialisation that survives lost executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: A table of so many partitions is never dealt out anew.
ENOUGH_PARTITIONS = 64


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``; one is set only where none is (local tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "archiveloom-checkpoints")
    sc.setCheckpointDir(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder (never a local one)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors once, so that Python stages find it wherever it was imported from.

    Functions that see only columns leave out the session; it is the active one then.
    """
    sc = (spark or SparkSession.active()).sparkContext
    if getattr(sc, "_archiveloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="archiveloom-")) / "archiveloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._archiveloom_shipped = True


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Give a scan enough partitions to use all cores.

    A large table arrives in many partitions and is left alone, so that nothing is shuffled; only a table of few files (tests,
    small inputs) is dealt out evenly, over ENOUGH_PARTITIONS at most. What isn't a plain scan keeps its partitions.
    """
    ship(df.sparkSession)
    least = least or min(df.sparkSession.sparkContext.defaultParallelism, ENOUGH_PARTITIONS)
    try:
        n = df._jdf.queryExecution().sparkPlan().execute().getNumPartitions()
    except Exception:  # noqa: BLE001 - a plan with joins has no partitions before it is prepared
        return df
    return df if n >= least else df.repartition(least)
