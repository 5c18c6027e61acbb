"""Writers: partitioned parts, resume by anti join, columns added or labels remade in place by writing anew."""

from __future__ import annotations

import json
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; without that setting a temporary folder, if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, whatever file system it is on."""
    _Folders(spark, path).remove(path)


def free_gb(spark: SparkSession, path: str) -> float:
    """Room in the file system that a path is on."""
    return _Folders(spark, path).fs.getStatus().getRemaining() / 1e9


def exists(spark: SparkSession, path: str) -> bool:
    folders = _Folders(spark, path)
    return folders.fs.exists(folders.at(path))


def append_parts(rows: DataFrame, path: str, by: str = "valid_date") -> None:
    """Appends to a dataset partitioned by a date column; a failed task leaves nothing behind."""
    rows.write.mode("append").partitionBy(by).parquet(path)


def clustered(rows: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """rows as the table name at path, dealt by hash of keys to so many buckets and sorted in each: tables of the same keys and buckets, joined or grouped by them, meet without a shuffle.

    Each bucket is one file, whatever wrote it: rows are dealt out before they are written. The table is known to the session's catalogue; it is replaced, if it is there.
    """
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def not_done(samples: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Samples whose keys aren't among those done."""
    return samples.join(done.select(*keys).distinct(), keys, "left_anti")


def augmented(rows: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of added instead of any of the same names; rows without a match get nulls. Doing it twice changes nothing."""
    new = [c for c in added.columns if c not in keys]
    return rows.drop(*new).join(added, keys, "left")


def relabelled(rows: DataFrame, labels: DataFrame, keys: list[str], default: int = 0) -> DataFrame:
    """rows with their labels recomputed; cells without a label get the default."""
    new = [c for c in labels.columns if c not in keys]
    return augmented(rows, labels, keys).fillna(dict.fromkeys(new, default))


def overwrite(rows: DataFrame, path: str, by: str | list[str] | None = None, cleared: list[dict[str, str]] | None = None) -> None:
    """Replaces just the partitions that rows have (by: one column or several, nested), or all; rows may be read from path itself.

    They are written beside it and counted first, then the folders change places by renaming: until that, path is as it was. A run that
    dies between two renames leaves the old rows in a folder that ends in .old, which the next call puts back. cleared names partitions (values by column)
    that rows may have left: those which rows don't have go.
    """
    spark = rows.sparkSession
    by = [by] if isinstance(by, str) else by or []
    fs = _Folders(spark, path)
    fs.put_back(path, len(by))
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new"
    observed = Observation()
    written = rows.observe(observed, F.count(F.lit(1)).alias("n")).write
    (written.partitionBy(*by) if by else written).parquet(new)
    if (there := spark.read.schema(rows.schema).parquet(new).count()) != observed.get["n"]:
        raise RuntimeError(f"{new} has {there} rows of {observed.get['n']}; {path} is unchanged")
    if not by:
        fs.swap(new, path)
    else:
        made = fs.partitions(new, len(by))
        for name in made:
            fs.swap(f"{new}/{name}", f"{path.rstrip('/')}/{name}")
        for name in fs.partitions(path, len(by)) if cleared else []:
            values = dict(unquote(x).split("=", 1) for x in name.split("/"))
            if name not in made and values in cleared:
                fs.remove(f"{path.rstrip('/')}/{name}")
        fs.remove(new)
    spark.catalog.refreshByPath(path)


class _Folders:
    """Renaming in whatever file system a path is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.at(a), self.at(b)):
            raise OSError(f"{a} could not be renamed to {b}")

    def swap(self, new: str, path: str) -> None:
        old = f"{path.rstrip('/')}.old"
        if self.fs.exists(self.at(path)):
            self._rename(path, old)
        else:
            self.fs.mkdirs(self.at(path).getParent())
        self._rename(new, path)
        self.remove(old)

    def put_back(self, path: str, depth: int = 1) -> None:
        """What a swap that died has left: of the folder, and of partitions in it."""
        base = path.rstrip("/")
        if self.fs.exists(self.at(base)):
            level = [base]
            for _ in range(depth):
                level = [f"{at}/{n}" for at in level for n in self._names(at) if "=" in n]
                for p in [x[:-4] for x in level if x.endswith(".old")]:
                    self._put_back(p)
                level = [x for x in level if not x.endswith(".old")]
        self._put_back(base)

    def _put_back(self, p: str) -> None:
        if self.fs.exists(self.at(f"{p}.old")):
            if self.fs.exists(self.at(p)):
                self.remove(f"{p}.old")
            else:
                self._rename(f"{p}.old", p)

    def _names(self, path: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.at(path))]

    def partitions(self, path: str, depth: int = 1) -> list[str]:
        """Names of the partition folders, nested ones joined by slashes."""
        found = [n for n in self._names(path) if "=" in n]
        return found if depth == 1 else [f"{n}/{x}" for n in found for x in self.partitions(f"{path}/{n}", depth - 1)]

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def contract(df: DataFrame, features: list[str]) -> str:
    """The feature columns with their types, in order, as JSON."""
    kinds = dict(df.dtypes)
    return json.dumps([{"name": f, "type": kinds[f]} for f in features])


def aligned(df: DataFrame, features: list[str]) -> DataFrame:
    """The columns of a contract in its order, NaN for those that df lacks."""
    return df.select(*(F.col(f) if f in df.columns else F.lit(float("nan")).alias(f) for f in features))


def prediction_rows(predictions: DataFrame, run: str = "run", hazards: tuple[str, ...] = C.HAZARDS) -> DataFrame:
    """Predictions (run, fxx, iy, ix, hazard, p, dist) with what is derived from them, ready to be partitioned by run: cig, category, modal bin.

    A run's rows are dealt to tasks by lead time, hazard and rows of the grid, so that none holds a whole run.
    """
    from ..operators import products

    derived = products.with_category(products.with_cig(predictions, hazards=hazards), hazards=hazards).withColumn("modal_bin", columns.modal_bin(F.col("dist")))
    return derived.repartition(run, "fxx", "hazard", F.floor(F.col("iy") / 32)).sortWithinPartitions(run, "hazard", "fxx", "iy", "ix")


def append_metrics(spark: SparkSession, path: str, metrics: list[tuple[str, str, str, float]]) -> None:
    """Appends rows (model, split, name, value) to the metrics table at path."""
    spark.createDataFrame(metrics, "model string, split string, name string, value double").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
