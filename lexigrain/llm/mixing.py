"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

A budget of tokens goes down a domain-language-source tree. At each node the children get shares in
proportion to their weights; a child that can't use its share (it has ``max_epochs`` times its tokens
at most) leaves the shortage to its siblings, and only what a whole subtree can't use goes to the
siblings of the subtree. A leaf is then read for as many whole epochs as its budget covers, and of one
more epoch, in an order seeded by the epoch, the longest prefix that the budget covers. The prefix is
found from token sums by leaf and hash bucket, 256 buckets at a time: the bucket in which it ends is cut into
256 again until it has few rows, and only these are sorted. So no task's rows grow with a leaf.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import free_name, keep

LEAF = ["domain", "lang", "source"]
#: The production tree: weights by name, and for names that aren't listed.
DOMAINS, OTHER_DOMAIN = {"web": 5, "reference": 3, "community": 2}, 1
LANGS, OTHER_LANG = {"en": 4, "de": 2, "fr": 2, "es": 2}, 1
SOURCES, OTHER_SOURCE = {}, 1


def domain_of(source: Column) -> Column:
    """The domain of ``src<k>``: web below 7, reference below 14, else community; others: other."""
    k = F.when(source.rlike("^src[0-9]{1,9}$"), F.expr("substr(source, 4)").cast("int"))
    return F.when(k < 7, "web").when(k < 14, "reference").when(k.isNotNull(), "community").otherwise("other")


def weight(name: Column, weights: Mapping[str, int], other: int) -> Column:
    if not weights:
        return F.lit(other).cast("long")
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(table[name], F.lit(other)).cast("long")


def share_out(children: DataFrame, parents: list[str], name: str, budget: str, share: str) -> DataFrame:
    """Adds ``share``: the part of the parents' ``budget`` for each child, by ``w`` and ``cap``.

    In the order of cap / w, a child is full if its cap is at most its share of what the children
    before it leave; the others divide the rest by weight, rounded down.
    """
    of = Window.partitionBy(*parents)
    order = of.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).asc_nulls_last(), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = children.withColumn("c_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(of) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    left = (F.col(budget) - F.col("c_before")).cast("decimal(20,0)")
    out = out.withColumn("is_full", (F.col("w") > 0) & ((F.col("cap").cast("decimal(20,0)") * F.col("w_left").cast("decimal(18,0)")) <= left * F.col("w").cast("decimal(18,0)")))
    out = out.withColumn("c_full", F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0)).over(of)).withColumn("w_open", F.sum(F.when(F.col("is_full"), 0).otherwise(F.col("w"))).over(of))
    rest = F.greatest(F.col(budget) - F.col("c_full"), F.lit(0))
    out = out.withColumn("num", rest.cast("decimal(20,0)") * F.col("w").cast("decimal(17,0)"))
    part = F.when(F.col("w_open") > 0, F.expr("num div cast(w_open as decimal(18,0))")).otherwise(F.lit(0))
    return out.withColumn(share, F.when(F.col("is_full"), F.col("cap")).otherwise(part)).drop("c_before", "w_left", "is_full", "c_full", "w_open", "num", "w", "cap")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """LEAF, leaf_tokens, leaf_budget from LEAF, leaf_tokens."""
    leaves = leaves.withColumn("leaf_cap", F.col("leaf_tokens") * max_epochs)
    by_lang = leaves.groupBy("domain", "lang").agg(F.sum("leaf_cap").alias("cap"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg(budget.cast("long").alias("budget"))
    top = by_domain.crossJoin(F.broadcast(total)).withColumn("w", weight(F.col("domain"), DOMAINS, OTHER_DOMAIN)).withColumn("root", F.lit(0))
    top = share_out(top, ["root"], "domain", "budget", "for_domain").select("domain", "for_domain")
    mid = by_lang.join(top, "domain").withColumn("w", weight(F.col("lang"), LANGS, OTHER_LANG))
    mid = share_out(mid, ["domain"], "lang", "for_domain", "for_lang").select("domain", "lang", "for_lang")
    low = leaves.withColumnRenamed("leaf_cap", "cap").join(mid, ["domain", "lang"]).withColumn("w", weight(F.col("source"), SOURCES, OTHER_SOURCE))
    return share_out(low, ["domain", "lang"], "source", "for_lang", "leaf_budget").select(*LEAF, "leaf_tokens", "leaf_budget")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", budget: Column | None = None, max_epochs: int = 4, seed: int = 17, bucket_rows: int = 1_000) -> DataFrame:
    """One row per input row: doc_id, domain, lang, source, tokens, leaf_budget, times.

    ``tokens`` are runs of characters other than space, tab, CR and LF (null text: none); ``budget`` is
    an aggregate over the leaves' ``leaf_tokens``, their sum by default; ``times`` says how often the
    row is used. Buckets are cut until one has about ``bucket_rows`` rows at most, which changes no result.
    A text of any length is counted whole. Edge cases: null language or source are leaves named ``unknown``; a row without tokens
    costs nothing and is used where the prefix ends after its bucket; rows repeated with one identifier
    stand and fall together; an empty table gives no rows.
    """
    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("unknown")).alias("lang"), F.coalesce(F.col(source_col), F.lit("unknown")).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^ \\t\\r\\n]+")).cast("long").alias("tokens"))
    rows = keep(named.withColumn("domain", domain_of(F.col("source"))))
    totals = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("leaf_tokens"))
    leaves = leaf_budgets(totals, F.coalesce(F.sum("leaf_tokens"), F.lit(0)) if budget is None else budget, max_epochs)
    leaves = leaves.withColumn("whole", F.when(F.col("leaf_tokens") > 0, F.least(F.lit(max_epochs).cast("long"), F.expr("leaf_budget div leaf_tokens"))).otherwise(F.lit(1).cast("long")))
    leaves = keep(leaves.withColumn("prefix", F.when(F.col("whole") < max_epochs, F.col("leaf_budget") - F.col("whole") * F.col("leaf_tokens")).otherwise(F.lit(0))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    digits, ends = 0, leaves.select(*LEAF, F.lit("").alias("end_bucket"), F.lit(0).cast("long").alias("ahead"))
    largest = rows.groupBy(*LEAF).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while digits == 0 or largest > bucket_rows * 16**digits:
        inside = rows.join(leaves.join(ends, LEAF), LEAF).withColumn("place", order).where(F.substring("place", 1, digits) == F.col("end_bucket"))
        digits += 2
        sums = inside.groupBy(*LEAF, F.substring("place", 1, digits).alias("bucket"), "prefix", "ahead").agg(F.sum("tokens").alias("n"))
        sums = sums.withColumn("upto", F.col("ahead") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket")))
        ends = keep(sums.where("upto > prefix").groupBy(*LEAF).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("ahead")), "bucket").alias("end")).select(*LEAF, F.col("end.bucket").alias("end_bucket"), F.col("end.ahead").alias("ahead")))
    out = ["doc_id", *LEAF, "tokens", "leaf_budget"]
    placed = rows.join(leaves.join(ends, LEAF, "left"), LEAF).withColumn("place", order).withColumn("bucket", F.substring("place", 1, digits))
    clear = placed.where("end_bucket is null or bucket <> end_bucket").select(*out, (F.col("whole") + F.when(F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")), F.when(F.col("leaf_tokens") > 0, F.lit(1)).otherwise(0)).otherwise(0)).alias("times"))
    upto = F.col("ahead") + F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("place"))
    last = placed.where("bucket = end_bucket").withColumn("upto", upto).select(*out, (F.col("whole") + F.when(F.col("upto") <= F.col("prefix"), 1).otherwise(0)).alias("times"))
    return clear.unionByName(last)


def select_mixture(df: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", max_epochs: int = 1, **options) -> DataFrame:
    """The rows of ``df`` that the mixture uses, with all their columns, each as often as its epochs say."""
    times = mix(df, id_col=id_col, lang_col=lang_col, source_col=source_col, max_epochs=max_epochs, **options).where("times > 0").select("doc_id", "lang", "source", "times").distinct()
    names = {c: free_name(df, c) for c in times.columns}
    times = times.select(*(F.col(c).alias(name) for c, name in names.items()))
    leaf = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(names["doc_id"])) & (leaf(lang_col) == F.col(names["lang"])) & (leaf(source_col) == F.col(names["source"]))
    return df.join(times, same).withColumn(names["times"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["times"])))).drop(*names.values())
