"""Session helpers: tables, code shipping and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_scratch: list[tuple[SparkSession, str]] = []


#: Tables whose rows are texts, so that each costs more to read than to move.
TEXTS = ("documents",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder; any path that Spark's readers open will do."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """Deals out a table that is read by fewer tasks than there are cores, as one file of a single row group is; any larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def columns(df: DataFrame) -> list[Column]:
    return [column(df, c) for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with a number: one that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    tries = (f"{name}{i or ''}" for i in range(len(taken) + 1))
    return next(c for c in tries if c.lower() not in taken)


def size_of(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` reads, as the planner knows them; None where it doesn't."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else None


#: Bytes of rows that go to Python at once. Texts are long: Spark's default of 64 MB is held twice in the JVM and again in Python, for each core.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that their Python can import it; and keep what goes to Python small."""
    sc = spark.sparkContext
    if not 0 < _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    archive = os.path.join(tempfile.mkdtemp(prefix="siltstone-"), "siltstone-code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    sc.addPyFile(archive)


def _bytes(size: str) -> int:
    """Of a size as Spark writes them."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}[unit]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, a local one serves a local master; on a cluster it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one; what is written there goes when the driver ends."""
    if not _scratch:
        atexit.register(_drop_scratch)
    path = f"{shared_dir(spark).rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a table which survives the loss of executors; unlike a plain checkpoint the
    files are columnar and compressed, and their size is known to the planner. The files go when the
    driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
