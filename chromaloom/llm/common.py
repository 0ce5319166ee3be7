"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Separators between words: every ASCII character but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: Iterable[str], wanted: Iterable[str]) -> list[str]:
    """The ``wanted`` names, with underscores in front of those that are taken (letter case apart)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` would also fold other scripts, so it serves all-ASCII texts alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words (runs of lower-case letters, digits and non-ASCII characters); null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names.

    One is set up only for a local master, where driver and executors are one
    process; on a cluster a folder of one machine would lose data, so that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="corpus-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders written by ``cut`` in each scope that is open, the innermost last.
_scopes: list[list[str]] = []


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders, wherever Spark can reach them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)


class Keep:
    """Materialises frames that outlive a scope; ``folders`` are theirs."""

    def __init__(self) -> None:
        self.folders: list[str] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        out, folder = _written(df, False, {})
        self.folders.append(folder)
        return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[Keep]:
    """Folders that ``cut`` writes within it go at its end; only frames passed through what it yields may be used afterwards.

    Those go with the scope around it, if there is one.
    """
    keep = Keep()
    _scopes.append([])
    try:
        yield keep
    finally:
        remove(spark, _scopes.pop())
        if _scopes:
            _scopes[-1].extend(keep.folders)


#: Bounds of what a Python worker is handed at once while ``cut`` runs.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, what is computed hands Python workers small batches; the session's own settings come back."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, gather: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that neither a lost executor nor a second use recomputes it.

    ``gather`` is for narrow tables behind a shuffle: they are written as fewer
    files, two for each core or one for 16 shuffle partitions, whichever is more.
    Each file costs a process start on some file systems, and a read later.
    """
    out, folder = _written(df, gather, options or {})
    if _scopes:
        _scopes[-1].append(folder)
    return out


def _written(df: DataFrame, gather: bool, options: dict[str, str]) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if gather:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    with small_batches(spark):
        df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def batches_of(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that ``column`` holds about ``max_bytes`` at a time (one long row may exceed it)."""
    for batch in batches:
        sizes = batch.column(column)
        size = max(1, sizes.nbytes)
        rows = batch.num_rows
        step = max(1, int(rows * max_bytes / size)) if size > max_bytes else rows
        for at in range(0, rows, max(1, step)):
            yield batch.slice(at, step)
