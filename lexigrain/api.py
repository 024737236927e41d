"""The public functions: documents in, coloured text out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.operators import routing
from lexigrain.operators.languages import rule_set
from lexigrain.operators.lexing import RuleSet
from lexigrain.operators.options import OptionError, checked, lexer_of
from lexigrain.operators.render import FORMATTERS, Formatter, render
from lexigrain.operators.tokens import sample_tokens, tokenize_by, tokens
from lexigrain.plans import catalog
from lexigrain.sources.files import read_routed


def formatter_of(formatter: str | Formatter, options: dict) -> tuple[str | Formatter, dict]:
    """A formatter and its checked options, a theme's under the name that ``render`` takes."""
    if isinstance(formatter, Formatter):
        return formatter, {}
    name = next((n for n in [*FORMATTERS, "Plain"] if n.upper() == formatter.upper()), None)
    if name is None:
        raise OptionError(f"no formatter {formatter!r}")
    found = checked("formatter", name, options)
    if "theme" in found:
        found["theme_name"] = found.pop("theme")
    return name, {} if name == "Plain" else found


def chained(specs: Sequence[str]) -> RuleSet:
    """The rule set of the first of ``specs``, with the others outside its tags."""
    name, rules, found = lexer_of(specs[0])
    return rules if len(specs) == 1 else rule_set(name, **found, **checked("lexer", name, {"secondary": chained(specs[1:])}))


def highlight(df: DataFrame, lexers: str | Sequence[str], formatter: str | Formatter = "HTML", text_col: str = "text", out_col: str = "rendered", **options) -> DataFrame:
    """``df`` with each text rendered. ``lexers`` are specs; of several, each handles what is outside the
    tags of the one before it."""
    chain = [lexers] if isinstance(lexers, str) else list(lexers)
    name, _, found = lexer_of(chain[0])
    if len(chain) > 1:
        found |= checked("lexer", name, {"secondary": chained(chain[1:])})
    made, settings = formatter_of(formatter, options)
    return df.withColumn(out_col, render(tokens(F.col(text_col), name, **found), made, **settings))


def highlight_files(spark: SparkSession, path: str, lexers: Iterable[str] = catalog.LEXER_NAMES, formatter: str | Formatter = "HTML", forced: str | None = None, **options) -> DataFrame:
    """(path, lexer, rendered) of the files under ``path``, each in its own language."""
    made, settings = formatter_of(formatter, options)
    rows = tokenize_by(read_routed(spark, path, forced), "lexer", lexers)
    return rows.select("path", "lexer", render(F.col("tokens"), made, **settings).alias("rendered"))


def lexer_guess(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("lexer", routing.guess(F.col(text_col)))


def lexer_for_filename(df: DataFrame, path_col: str = "path") -> DataFrame:
    return df.withColumn("lexer", routing.by_filename(F.col(path_col)))


def lexer_by_name(df: DataFrame, name_col: str = "name") -> DataFrame:
    return routing.by_name(df, name_col)


def sample(spark: SparkSession, formatter: str | Formatter = "HTML", **options) -> DataFrame:
    """One row: a line for each token type in its style."""
    made, settings = formatter_of(formatter, options)
    return catalog.token_types(spark).agg(sample_tokens(catalog.token_types(spark)).alias("t")).select(render(F.col("t"), made, **settings).alias("rendered"))
