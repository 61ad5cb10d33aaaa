"""What the corpus operators share: table access, scratch tables, word splitting and Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that end a word: the complement of [^\x20\x09-\x0D].
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"

_own_folder: list[str] = []
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """One folder for each application in the shared folder that the cluster names in spark.checkpoint.dir.

    In local mode, where driver and executors are one process, a temporary folder will do if that is unset; on a
    cluster it has to be set, as executors don't see each other's disks."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/corpus-{context.applicationId}"
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: the corpus operators need a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="corpus-scratch-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back.

    What a lost executor had computed before this point is never needed again."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    _made.append(path)
    return table


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        of = spark._jvm.org.apache.hadoop.fs.Path(path)
        of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)
        _made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [t.scratch_path])


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes all scratch tables, or those made after the first `since`, once what reads them has been written.

    Operators return plans over their scratch tables, so only who writes a result knows when they may go."""
    _delete(spark, [p for p in _made[since:] if keep is None or p != keep.scratch_path])


def scratch_tables() -> int:
    """How many there are."""
    return len(_made)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs, whose results are tables by now.

    Spark deletes them once the driver's garbage collector finds that nothing refers to them, which a driver with
    little else to do may not do for an hour: a job of several large shuffles would hold all of them on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; a null or blank text has none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES))


def count_words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACES))).cast("long")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, so that memory follows bytes and not rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if len(sizes) > start:
            yield batch.slice(start)
