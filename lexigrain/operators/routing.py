"""Which language is a document in? Joins with the catalog and scores as column expressions.

The catalog's keys are a few dozen rows, so the joins are broadcast (their size is known) and no document
is shuffled. Ties go to the lexer that comes first in the registry.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.operators.lexing import let
from lexigrain.plans import catalog


def basename(path: Column) -> Column:
    """The last part of a path: ``.`` for an empty one, ``/`` for slashes alone."""
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", ".").when(bare == "", "/").otherwise(F.regexp_extract(bare, "[^/]*$", 0))


def glob_pattern(glob: str, fold: bool) -> str:
    """A file name pattern with ``*``, ``?`` and ``[…]`` as a regular expression for whole names."""
    parts = re.findall(r"\[!?\]?[^\]]*\]|.", glob, re.DOTALL)
    out = "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(p, p.replace("[!", "[^") if len(p) > 1 else re.escape(p)) for p in parts)
    return ("(?i)" if fold else "") + f"^{out}$"


def first_match(name: Column, kind: str, fold: bool) -> Column:
    """The first lexer, in registry order, with a pattern of ``kind`` that ``name`` matches; else null."""
    out = F.lit(None).cast("string")
    for row in reversed(catalog.fields(catalog.LEXERS)):
        patterns = row[{"glob": 2, "interpreter": 4}[kind]].split()
        if patterns:
            out = F.when(name.rlike("|".join(f"(?:{glob_pattern(g, fold)})" for g in patterns)), F.lit(row[0])).otherwise(out)
    return out


def by_filename(path: Column) -> Column:
    return first_match(basename(path), "glob", fold=True)


def by_interpreter(path: Column) -> Column:
    return first_match(basename(path), "interpreter", fold=False)


def upper_ascii(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def key_name(df: DataFrame) -> str:
    """A name that no column of ``df`` has."""
    return "_" * max([1, *(len(c) + 1 for c in df.columns)])


def by_name(df: DataFrame, name_col: str, out_col: str = "lexer") -> DataFrame:
    """Adds the lexer with that name or alias, without regard to ASCII case; null for none."""
    spark, key = df.sparkSession, key_name(df)
    names = catalog.lexers(spark).select("ord", F.col("name").alias(out_col), F.col("name").alias(key))
    aliases = catalog.lexer_keys(spark).where("kind = 'alias'").select("ord", F.col("lexer").alias(out_col), F.col("value").alias(key))
    keys = names.unionByName(aliases).groupBy(upper_ascii(F.col(key)).alias(key)).agg(F.min_by(out_col, "ord").alias(out_col))
    return df.join(F.broadcast(keys), upper_ascii(F.col(name_col)) == F.col(key), "left").drop(key)


def by_mime(df: DataFrame, mime_col: str, out_col: str = "lexer") -> DataFrame:
    """Adds the first lexer of a MIME type, compared with regard to case; null for none."""
    key = key_name(df)
    keys = catalog.lexer_keys(df.sparkSession).where("kind = 'mime'").groupBy(F.col("value").alias(key)).agg(F.min_by("lexer", "ord").alias(out_col))
    return df.join(F.broadcast(keys), F.col(mime_col) == F.col(key), "left").drop(key)


def by_shebang(text: Column) -> Column:
    """The lexer of a ``#!`` line: of its interpreter, or with ``/usr/bin/env`` of the first argument that
    isn't an option and names one."""
    line = F.regexp_extract(text, "^#![ \t]*([^\r\n]*)", 1)
    words = F.filter(F.split(line, "[ \t]+"), lambda w: w != "")
    later = F.filter(F.transform(F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: ~w.startswith("-")), by_interpreter), lambda x: x.isNotNull())
    return F.when(line == "", F.lit(None)).when(F.get(words, F.lit(0)) == "/usr/bin/env", F.get(later, F.lit(0))).otherwise(by_interpreter(F.get(words, F.lit(0))))


def content_scores(text: Column) -> list[tuple[str, Column]]:
    """(lexer, score) of the languages that can be told by their content, in registry order."""
    # Scores and marks.
    diff = F.when(text.rlike("^(?:Index: |diff )"), 999).when(text.startswith("--- "), 600)
    mysql = F.when(F.regexp_extract(text, "(?is)ENGINE=(.{6})", 1).rlike("(?i)^(?:InnoDB|MyISAM)$"), 100)
    php = F.when(text.rlike(r"(?i)<\?php"), 999).when(text.rlike(r"(?i)<\?(?!xml)") & (F.length(text) >= 6), 999)
    varnish = F.when(text.startswith("vcl"), 100)
    xml = F.when(text.startswith("<?xml"), 999).when(text.startswith("<!DOCTYPE"), 300)
    return [(name, F.coalesce(score, F.lit(0))) for name, score in (("Diff", diff), ("MySQL", mysql), ("PHP", php), ("Varnish", varnish), ("XML", xml))]


def guess(text: Column) -> Column:
    """The lexer of a text by its content: the ``#!`` line, else the highest score above 0, the first in
    the registry of equal ones; null if nothing tells."""
    bare = F.regexp_replace(text, "^\ufeff", "")
    names, scores = zip(*content_scores(bare), strict=True)

    def first(found: Column) -> Column:
        best = F.array_max(found)
        return F.when(best > 0, F.element_at(F.array(*map(F.lit, names)), F.array_position(found, best).cast("int")))

    return F.coalesce(by_shebang(bare), let(F.array(*scores), first))


def route(df: DataFrame, text_col: str = "text", path_col: str | None = None, forced: str | None = None, out_col: str = "lexer") -> DataFrame:
    """Adds the lexer of each document: by its file name, else its content, else ``forced``, else Text."""
    choices = ([by_filename(F.col(path_col))] if path_col else []) + [guess(F.col(text_col)), F.lit(forced or "Text")]
    return df.withColumn(out_col, F.coalesce(*choices))


def lexer_spec(spec: Column) -> Column:
    """``name?option=value;flag&other=1`` as (name, options): pairs are parted by ``;`` or ``&``, a missing
    value is empty."""
    parts = F.filter(F.split(F.regexp_extract(spec, r"(?s)^[^?]*\?(.*)$", 1), "[;&]"), lambda p: p != "")
    pairs = F.map_from_entries(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "(?s)^([^=]*)", 1), F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1))))
    return F.struct(F.regexp_extract(spec, r"(?s)^[^?]*", 0).alias("name"), pairs.alias("options"))


def lexer_group(specs: Column) -> Column:
    """A chain of specs, ``,``-separated, in order."""
    return F.transform(F.filter(F.split(specs, ","), lambda s: s != ""), lexer_spec)


def find_formatter(name: str) -> str | None:
    return next((n for n in catalog.FORMATTERS if n.upper() == name.upper()), None)


def find_theme(name: str) -> str | None:
    return next((n for n in catalog.THEMES if n.upper() == name.upper()), None)


