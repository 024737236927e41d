"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, V = TypeVar("K", bound=Hashable), TypeVar("V")


class Memo(dict[K, V]):
    """What ``make`` gives for words, in a worker: at most ``most`` words of at most ``longest`` characters
    are kept, so that its memory is bounded whatever the texts hold; other words are made anew each time."""

    def __init__(self, make: Callable[[K], V], most: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word: K) -> V:
        found = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, giving back at its end the memory that Arrow holds for reuse: Spark keeps the worker, idle or
    for tasks of other stages, beside the executor's heap."""

    @functools.wraps(run)
    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return task


#: The folders that this process has asked for and not removed.
made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    A local session without such a folder (tests) gets a temporary one; a cluster's must have one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-lexigrain-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/lexigrain-{uuid.uuid4().hex}"
    made.append(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``scratch``."""
    if path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that ``keep`` gave, once nothing reads them any more; others stay."""
    for df in tables:
        names = {file.rpartition("/")[0].rpartition("/")[2] for file in df.inputFiles()}
        for path in [p for p in made if p.rpartition("/")[2] in names]:
            remove(df.sparkSession, path)


def keep_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` kept; the folders that came into being on its way are removed."""
    before = set(made)
    out = keep(make())
    for path in [p for p in made[:-1] if p not in before]:
        remove(spark, path)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (null counts as empty); other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
