"""Tables in the shared checkpoint folder, so that lineage is cut where every executor can read it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A written table needs its shuffles no more; without this they stay until the driver's collector finds them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this library to the application's Python workers, once; they need not find it on a path of their own."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app in _SHIPPED or not root.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sondage-code-"), "sondage.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a local one, for a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="sondage-")
    return _LOCAL[context.applicationId]


class Scratch:
    """Parquet tables of one operator run. ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/sondage/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._path: dict[int, str] = {}

    def write(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """Runs df once and returns a reader of the written rows."""
        path = f"{self.root}/{self._n}"
        self._n += 1
        schema = df.schema
        with self.settings({SHUFFLE_CLEANUP: "true"}):
            df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._path[id(out)] = path
        return out

    @contextmanager
    def settings(self, values: dict[str, str]) -> Iterator[None]:
        """Session settings that hold for what is written inside."""
        before = {k: self.spark.conf.get(k, None) for k in values}
        try:
            for k, v in values.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def drop(self, df: DataFrame) -> None:
        path = self._path.pop(id(df), None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs whose id is not in ``gone`` (one column); null ids stay. The ids are broadcast if they are few."""
    gone = Scratch(docs.sparkSession, "gone").write(gone.where(gone[id_col].isNotNull()).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, id_col, "left_anti").select(docs.columns)
