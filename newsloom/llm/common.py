"""What the operators of this subpackage share: tables, checkpoints, batches balanced by bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its texts dealt over all cores where they come as few splits."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors that don't share the driver's PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_newsloom_shipped", False):
        return
    import zipfile

    top = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="newsloom-")) / "newsloom_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((top / "newsloom").rglob("*.py")):
            z.write(p, p.relative_to(top))
    sc.addPyFile(str(out))
    sc._newsloom_shipped = True


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run in here go as soon as it has run; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut and the shuffle files that it took removed.

    The folder is the one the session names in spark.checkpoint.dir; one of our own is set only where it is unset.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, so that no other run of df has its files in use


def free_name(base: str, taken: list[str]) -> str:
    """base, or base with underscores where a column has that name already (names that differ in case only are one to Spark)."""
    known = {c.lower() for c in taken}
    while base.lower() in known:
        base += "_"
    return base


def text_of(name: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices_by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `limit` bytes; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = 0
    ends = np.cumsum(sizes)
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[s : s + n] over starts and lengths."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    out_starts = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - out_starts, lengths) + np.arange(total)]


def stage_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder, for tables that stages hand on."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(spark))
    return f"{sc.getCheckpointDir()}/stages-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of this run on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def publish(spark: SparkSession, name: str, data: bytes) -> str:
    """Write some bytes to the shared folder and let every executor fetch them from there; the name SparkFiles knows them by."""
    known = f"{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{stage_folder(spark)}/{known}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return known
