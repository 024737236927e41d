"""The same operators over streams.

Lexing, routing and rendering look at one row at a time, so they are the batch functions applied to a
streaming DataFrame, without state. Counts over time keep a state for each window and type, which the
watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrain.operators.render import render
from lexigrain.operators.tokens import tokens


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rendered_stream(stream: DataFrame, lexer: str, formatter: str = "HTML", text_col: str = "text", **options) -> DataFrame:
    """The stream with ``rendered``; works in append mode."""
    return stream.withColumn("rendered", render(tokens(F.col(text_col), lexer), formatter, **options))


def windowed_type_counts(stream: DataFrame, lexer: str, time_col: str, text_col: str = "text", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, lexer, type, tokens): tokens by type and window of event time. Rows that come more
    than ``late`` after the latest time seen are left out, as their window is closed."""
    rows = stream.withWatermark(time_col, late).select(F.col(time_col).alias("at"), F.explode(tokens(F.col(text_col), lexer)).alias("t"))
    counts = rows.groupBy(F.window("at", window), F.col("t.lexer").alias("lexer"), F.col("t.type").alias("type")).agg(F.count("*").alias("tokens"))
    return counts.select(F.col("window.start").alias("window_start"), "lexer", "type", "tokens")
