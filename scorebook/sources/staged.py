"""Several tables that change together: new parts are written beside the old ones and appear with one small file.

Rows are dealt to a fixed number of buckets by a key; a change rewrites the buckets that it touches. A manifest names the
folder of each table's bucket, so its size does not grow with the rows. Readers see the manifest of the highest number; a
job that dies before it is written has changed nothing, and its parts are never read. One writer at a time.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. On one machine a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{found}/tables-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write the rows of a step to the shared folder and read them back: later steps neither work them out again nor replan them."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Staged:
    """Tables (name: schema) under a root, dealt to buckets by the column ``key``, which all of them have."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], key: str, buckets: int = 16):
        self.spark, self.root, self.schemas, self.key, self.buckets = spark, root, schemas, key, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def keep(self, df: DataFrame) -> DataFrame:
        """Write rows of a job beside the tables and read them back, so that later steps do not work them out again."""
        folder = f"{self.root}/work/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def manifest(self) -> tuple[int, dict[str, dict[str, str]]]:
        """The number of the last change, and the folder of each bucket that has rows, by table."""
        if not self._fs.exists(self._path(f"{self.root}/manifests")):
            return 0, {name: {} for name in self.schemas}
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.root}/manifests")) if s.getPath().getName().isdigit()]
        if not numbers:
            return 0, {name: {} for name in self.schemas}
        last = max(numbers)
        text = self.spark.read.text(f"{self.root}/manifests/{last}", wholetext=True).first()["value"]
        return last, json.loads(text)

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """The rows of a table as of now, or of some buckets."""
        held: dict[str, list[int]] = {}
        for b, folder in self.manifest()[1][name].items():
            if only is None or int(b) in only:
                held.setdefault(folder, []).append(int(b))
        # a folder may still hold buckets that a later change wrote elsewhere
        rows = [self.spark.read.schema(f"{self.schemas[name]}, _bucket int").parquet(f).where(F.col("_bucket").isin(own)) for f, own in sorted(held.items())]
        return reduce(DataFrame.unionByName, rows).drop("_bucket") if rows else self.spark.createDataFrame([], self.schemas[name])

    def replace(self, tables: dict[str, DataFrame], touched: list[int]) -> int:
        """The touched buckets of the tables now hold these rows and no others; the number of the change."""
        number, now = self.manifest()
        for name, rows in tables.items():
            folder = f"{self.root}/{name}/{number + 1}-{uuid.uuid4().hex}"
            dealt = rows.withColumn("_bucket", self.bucket())
            dealt.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(folder)
            now[name] = {b: f for b, f in now[name].items() if int(b) not in touched} | {str(b): folder for b in touched}
        self._commit(number + 1, now)
        return number + 1

    def _commit(self, number: int, manifest: dict) -> None:
        """Write the manifest under another name, then give it its own; the only step that readers notice."""
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        if not self._fs.rename(draft, self._path(f"{self.root}/manifests/{number}")):
            raise RuntimeError("another writer has made this change")
