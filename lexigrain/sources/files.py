"""Files as documents, and case files as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions.encodings import detect_encoding, encoded, to_text
from lexigrain.functions.strings import is_binary
from lexigrain.operators.routing import lexer_spec, route

SECTIONS = ("TEST", "LEXER", "FORMATTER", "SOURCE", "EXPECT")


def read_sources(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(path, encoding, text) of the files under ``path``: binary ones are left out, others are decoded.
    A file is one row, as a language can only be told of a whole file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).where(~is_binary(F.col("content")))
    files = files.withColumn("encoding", detect_encoding(F.col("content"))["encoding"])
    return files.select("path", "encoding", to_text(F.col("content"), F.coalesce("encoding", F.lit("UTF-8"))).alias("text"))


def read_routed(spark: SparkSession, path: str, forced: str | None = None, **options) -> DataFrame:
    """(path, encoding, text, lexer): as ``read_sources``, with the language of each file."""
    return route(read_sources(spark, path, **options), "text", "path", forced)


def written(df: DataFrame, text_col: str, encoding: str) -> DataFrameWriter:
    """A writer of a column's bytes in ``encoding``, each row with a line end behind it; characters that ``encoding`` lacks
    become ``?``. The text writer writes strings as the bytes that they hold."""
    data = encoded(F.coalesce(F.col(text_col), F.lit("")), encoding)
    return df.select(data.cast("string").alias("value")).write.option("lineSep", "\n".encode(encoding).decode("latin-1"))


def write_rendered(df: DataFrame, path: str, text_col: str = "rendered", encoding: str = "UTF-8") -> None:
    """The results one after the other, in ``encoding``."""
    written(df, text_col, encoding).text(path)


def write_documents(df: DataFrame, path: str, text_col: str = "text", encoding: str = "UTF-8") -> None:
    """One file for each row, so that results of many lines stay apart; added to what is there. Spark's commit makes the
    files whole. Files take time one by one, so rows of fewer partitions than there are cores are dealt to all cores, and
    tasks move their files themselves: a write that fails may leave those of finished tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    dealt = df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
    written(dealt, text_col, encoding).option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).mode("append").text(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; a local session without one gets a
    temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-lexigrain-")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def read_cases(spark: SparkSession, path: str, glob: str = "*.ssc") -> DataFrame:
    """(path, test, lexer, formatter, source, expect) of case files: sections begin with ``--NAME--``
    lines, their text loses one line end. ``lexer`` has name and options, which stand on lines of their own."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    section = lambda name: F.regexp_extract("value", rf"(?s)(?:^|\n)--{name}--\r?\n(.*?)(?=\r?\n--(?:{'|'.join(SECTIONS)})--\r?\n|(?:\r?\n)?\z)", 1)
    cases = files.select(F.col("_metadata.file_path").alias("path"), *(section(name).alias(name.lower()) for name in SECTIONS))
    spec = F.concat(F.regexp_extract("lexer", "^[^\n]*", 0), F.lit("?"), F.replace(F.regexp_extract("lexer", r"(?s)^[^\n]*\n(.*)$", 1), F.lit("\n"), F.lit(";")))
    return cases.withColumn("lexer", lexer_spec(spec))
