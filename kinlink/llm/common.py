"""Shared helpers: table access, staging in the cluster's shared folder, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a new local one, on a local master alone (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="kinlink-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths of staged tables of the innermost scratch().
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Staged tables of the block are deleted at its end: what was made from them must be written by then."""
    mark = _SCRATCH.set([])
    try:
        yield
    finally:
        held = _SCRATCH.get()
        _SCRATCH.reset(mark)
        discard(*held)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if (held := _SCRATCH.get()) is not None:
        held.append(out)
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives the memory that it has freed back to the system: Spark keeps it, beside the executor's heap, for later tasks."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone keeps it
                trim(0)

    return freed


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(*cols: str) -> Column:
    """128 bits of a row's content, equal for repeated rows, also with nulls."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")) for c in cols])))


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The named columns, or all, as one struct, so that no name of a caller's column meets one of an operator's; ``row.*`` unpacks it."""
    return F.struct(*[df[f"`{c}`"] for c in (df.columns if columns is None else columns)]).alias("row")


def free(name: str, taken: list[str]) -> str:
    """name, with as many underscores behind it as it takes to differ from all taken names, also in lower case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
