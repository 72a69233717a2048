"""What the operators of this subpackage share: the shared folder, table reads, code shipping, range dealing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists that take the paths of tables as stored() writes them, the innermost last.
_NOTES: ContextVar[tuple[list[str], ...]] = ContextVar("notes", default=())
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="filemeta-ship-"))
    target = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset and all runs in one process on one machine, as in
    tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="filemeta-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, outlives executors."""
    path = f"{shared_dir(spark)}/filemeta-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    for paths in _NOTES.get():
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def noted() -> Iterator[list[str]]:
    """Gives a list of the paths that stored() writes within."""
    paths: list[str] = []
    token = _NOTES.set((*_NOTES.get(), paths))
    try:
        yield paths
    finally:
        _NOTES.reset(token)


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables that stored() wrote, given as such or by path, once no result that needs them is read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for t in tables:
        p = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.stored_at)
        p.getFileSystem(conf).delete(p, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounds_of(df: DataFrame, key: str, n: int) -> list[int]:
    """Up to n - 1 ascending values of an integer key that cut it into n ranges of about as many rows."""
    row = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n + 1000).alias("q")).first() if n > 1 else None
    return sorted(set(row.q)) if row and row.q else []


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of ascending bounds that are <= key, by a binary search: range 0 holds what lies before the first."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    cut = F.array(*(F.lit(b).cast("long") for b in bounds))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(cut, at + step - 1) <= key, at + step).otherwise(at))
