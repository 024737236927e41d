"""Documents to tokens, and tokens as rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.operators.languages import rule_set
from lexigrain.operators.lexing import TOKEN, RuleSet, bound, lex, uppercased
from lexigrain.operators.options import OptionError, checked, lexer_of
from lexigrain.operators.retag import retagged


def tokens(text: Column, lexer: str, secondary: str | RuleSet | None = None, words: Mapping[str, Iterable[str]] | None = None, **options) -> Column:
    """The tokens of ``text`` in the language ``lexer``; ``secondary`` names the language of what is
    outside a template's tags."""
    if secondary is not None:
        options["secondary"] = rule_set(secondary) if isinstance(secondary, str) else secondary
    out = lex(text, rule_set(lexer, words, **options), lexer)
    out = retagged(out) if lexer == "PHP" else out
    return uppercased(out) if options.get("uppercase_keywords") else out


def tokenize(df: DataFrame, lexer: str, text_col: str = "text", out_col: str = "tokens", **options) -> DataFrame:
    """``df`` with an array of tokens for each row; row by row, so it works on streams too."""
    return df.withColumn(out_col, tokens(F.col(text_col), lexer, **options))


def tokenize_by(df: DataFrame, lexer_col: str, lexers: Iterable[str], text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """Each row in the language that ``lexer_col`` names, of those in ``lexers``; others get one token."""
    text = F.col(text_col)
    rest = tokens(text, "Text")
    chosen = reduce(lambda out, name: F.when(F.col(lexer_col) == name, tokens(text, name)).otherwise(out), lexers, rest)
    return df.withColumn(out_col, chosen)


def tokenize_specs(df: DataFrame, spec_col: str, specs: Iterable[str] | None = None, text_col: str = "text", out_col: str = "tokens", error_col: str = "error", most: int = 200) -> DataFrame:
    """Each row by its own lexer spec (``PHP?start_inline=1``, or a chain of specs between commas, each for what is outside
    the tags of the one before), of those in ``specs``; without these, of the distinct ones of the column, which are looked
    up first and may be ``most`` at most, as their number bounds the plan. A spec that can't be used, or isn't listed,
    gives null tokens and says why in ``error_col``."""
    if specs is None:
        specs = [r[0] for r in df.select(spec_col).where(F.col(spec_col).isNotNull()).distinct().limit(most + 1).collect()]
        if len(specs) > most:
            raise ValueError(f"{spec_col} has more than {most} different specs")
    text, chosen, why = F.col(text_col), F.lit(None).cast(TOKEN), F.when(F.col(spec_col).isNotNull(), F.concat(F.lit("not among the specs: "), F.col(spec_col)))
    for spec in dict.fromkeys(specs):
        mine = F.col(spec_col) == spec
        try:
            name, found = spec_options(spec)
        except OptionError as e:
            why = F.when(mine, F.lit(str(e))).otherwise(why)
        else:
            chosen, why = F.when(mine, tokens(text, name, **found)).otherwise(chosen), F.when(mine, F.lit(None)).otherwise(why)
    return df.withColumns({out_col: chosen, error_col: why})


def spec_options(spec: str) -> tuple[str, dict]:
    """The lexer of a spec or a chain of specs, and its checked options."""
    first, *rest = [s for s in spec.split(",") if s] or [""]
    name, _, found = lexer_of(first)
    if rest:
        inner, options = spec_options(",".join(rest))
        found |= checked("lexer", name, {"secondary": rule_set(inner, **options)})
    return name, found


def once(tokens_col: str) -> Column:
    """The tokens, for a generator. Of a bare column Spark would infer a filter on its size and push that, with
    the whole lexing in it, below the projection: each text would be lexed three times."""
    return F.coalesce(F.col(tokens_col), F.array().cast(TOKEN))


def explode_tokens(df: DataFrame, *keys: str, tokens_col: str = "tokens") -> DataFrame:
    """A row for each token: keys, seq from 0, lexer, depth, type, text, path. Rows without tokens vanish."""
    return df.select(*keys, F.posexplode(once(tokens_col)).alias("seq", "token")).select(*keys, "seq", "token.*")


def with_spans(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``start`` and ``end`` in characters, from 0, end exclusive. Keys name one document."""
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("text").cast("long")).over(before)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def placed_sql(stretch: int = 256) -> str:
    """A function of tokens, as SQL: the tokens with their places, in stretches, so that a text of any length takes nearly
    linear time."""
    fields = ("lexer", "depth", "type", "text", "path")
    span = f"named_struct({', '.join(f"'{f}', t.{f}" for f in fields)}, 'start', a.at, 'end', a.at + length(t.text))"
    type_ = TOKEN.removesuffix(">>") + ",start:bigint,end:bigint>>"
    lengths = "aggregate(b, 0L, (n, t) -> n + length(t.text))"
    starts = f"aggregate(blocks, named_struct('at', 0L, 'all', cast(array() as array<bigint>)), (a, b) -> named_struct('at', a.at + {lengths}, 'all', concat(a.all, array(a.at))), a -> a.all)"
    inside = f"aggregate(b, named_struct('at', starts[i], 'out', cast(array() as {type_})), (a, t) -> named_struct('at', a.at + length(t.text), 'out', concat(a.out, array({span}))), a -> a.out)"
    blocks = f"transform(sequence(1, size(ts), {stretch}), k -> slice(ts, k, {stretch}))"
    return f"ts -> if(size(ts) > 0, {bound('blocks', blocks, bound('starts', starts, f'flatten(transform(blocks, (b, i) -> {inside}))'))}, cast(array() as {type_}))"


def explode_spans(df: DataFrame, *keys: str, tokens_col: str = "tokens") -> DataFrame:
    """As ``explode_tokens``, with ``start`` and ``end`` in characters, from 0, end exclusive; without a shuffle, as
    places are found within the row."""
    placed = F.call_function("transform", F.array(once(tokens_col)), F.expr(placed_sql()))[0]
    return df.select(*keys, F.posexplode(placed).alias("seq", "token")).select(*keys, "seq", "token.*")


def coalesce_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Neighbours of one type, lexer and depth as one row (gaps and islands); ``seq`` is the first one's."""
    order = Window.partitionBy(*keys).orderBy("seq")
    now = F.struct("type", "lexer", "depth")
    new = F.when(now.eqNullSafe(F.lag(now).over(order)), 0).otherwise(1)
    islands = rows.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order))
    joined = islands.groupBy(*keys, "__island").agg(F.min("seq").alias("seq"), F.first("lexer").alias("lexer"), F.first("depth").alias("depth"), F.first("type").alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    return joined.drop("__island")


def type_counts(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(lexer, type, tokens, chars) over all rows; partial sums are made before the shuffle."""
    rows = df.select(F.explode(once(tokens_col)).alias("t")).select("t.lexer", "t.type", F.length("t.text").cast("long").alias("n"))
    return rows.groupBy("lexer", "type").agg(F.count("*").alias("tokens"), F.sum("n").alias("chars"))


def sample_tokens(types: DataFrame) -> Column:
    """One token of each type that shows its name: the sample document."""
    listed = F.array_sort(F.collect_list(F.struct("id", "name", "description")))
    return F.flatten(F.transform(listed, lambda t: F.array(F.struct(F.lit("Sample").alias("lexer"), F.lit(0).alias("depth"), t["name"].alias("type"), F.concat(t["name"], F.lit(": "), t["description"]).alias("text"), F.array(F.lit("Sample")).alias("path")), F.struct(F.lit("Sample").alias("lexer"), F.lit(0).alias("depth"), F.lit("IGNORABLE").alias("type"), F.lit("\n").alias("text"), F.array(F.lit("Sample")).alias("path"))))).cast(TOKEN)
