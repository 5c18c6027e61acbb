"""What the training-data operators share: tables, the shared folder, hashed sampling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch to Python and of what is worked on at once. Spark bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch).
ARROW_ROWS = 256
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes for each core below which a table may be dealt out to all cores.
SMALL_PART = 16 << 20
#: Files of an intermediate table for each core, at most.
FILES_PER_CORE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches of ARROW_ROWS rows for this session, unless it has a setting of its own: results are lazy, so the setting has to last as long as they do."""
    if spark.conf.get(ROWS_SETTING) == "10000":  # Spark's default
        spark.conf.set(ROWS_SETTING, str(ARROW_ROWS))


#: How to forget what this Python worker remembers from one task to the next, by operator.
_remembered: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Of what operators remember in this worker, only owner's stays; forget will clear that. Spark uses a worker again for other stages, whose memory it would take."""
    others = [k for k in _remembered if k != owner]
    for k in others:
        _remembered.pop(k)()
    if others:
        pa.default_memory_pool().release_unused()
    if forget:
        _remembered[owner] = forget


def slices(batches: Iterator[pa.RecordBatch], owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ARROW_ROWS rows: bounds what a Python worker makes of a column of texts at once. What operators other than owner remember goes."""
    remembers(owner)
    for b in batches:
        for at in range(0, len(b), ARROW_ROWS):
            yield b.slice(at, ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if all runs in one process on one machine, as in tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Of each scratch() around the running code, outermost first, the tables made in it; threads have their own.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def materialize(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, and outlives executors.

    It has at most FILES_PER_CORE files for each core, or files: tables of many tiny files cost a process each on some file systems.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.coalesce(files or FILES_PER_CORE * spark.sparkContext.defaultParallelism).write.parquet(path)
    if around := _scratch.get():
        around[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tesserae_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder, whatever file system that is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized inside are removed at the end, but for those passed to what this yields: nothing that is returned may need the others."""
    paths: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.tesserae_path)
        return df

    around = _scratch.get()
    token = _scratch.set((*around, paths))
    try:
        yield keep
    finally:
        _scratch.reset(token)
        for p in paths:
            if p not in kept:
                discard(spark, p)
        if around:
            around[-1].extend(kept)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores as it takes to be none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(key: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def unit_hash(*cols: Column, seed: int = 7) -> Column:
    """A number in [0, 1) from the columns, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def spread(df: DataFrame) -> DataFrame:
    """df for a Python worker: over all cores, if it is so small that it lies in fewer files than there are cores; else as it is, without a shuffle."""
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    # From the plan's statistics alone: nothing runs.
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_PART and len(df.inputFiles()) < cores else df


def append(df: DataFrame, column: str, compute: Callable[[list], list], fields: list[tuple[str, str, pa.DataType]], keep: list[str] | None = None) -> DataFrame:
    """df (all columns, or keep) with what compute makes of a batch of column's values: a list for each of fields (name, DDL, Arrow type)."""
    from pyspark.sql.pandas.types import to_arrow_type

    keep = df.columns if keep is None else keep
    kinds = dict(df.dtypes)
    if taken := {f[0] for f in fields} & set(keep):
        raise ValueError(f"columns exist already: {sorted(taken)}")
    schema = pa.schema([pa.field(c, to_arrow_type(df.schema[c].dataType)) for c in keep] + [pa.field(n, t) for n, _, t in fields])
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{n} {d}" for n, d, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = compute(b.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, f[2]) for x, f in zip(made, fields, strict=True))], schema=schema)

    return spread(df.select(*dict.fromkeys([*keep, column]))).mapInArrow(run, ddl)
