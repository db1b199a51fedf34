"""Sizing and packing shared by the operators that move arrays between tasks."""

from __future__ import annotations

import pickle
import uuid

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def text_bytes(docs: DataFrame, column: str) -> int:
    """Bytes of all texts: one narrow pass with one number per task."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def parts(n_bytes: int, each: int, least: int = 64) -> int:
    """How many groups of about ``each`` bytes hold ``n_bytes``."""
    return max(least, -(-n_bytes // each))


def pack(value) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


class Shelf:
    """Tables written under the cluster's checkpoint folder, so that later steps do not depend on the tasks that made them; each can be dropped."""

    def __init__(self, spark, name: str):
        self.spark, self.folder, self.count = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, rows: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this shelf. Nothing that is still to be computed may read them."""
        for held in tables:
            for file in held.inputFiles()[:1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
