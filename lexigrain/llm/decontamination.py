"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

Index: every row of the training table has a number; the positions of its words are stored as postings (term,
doc, pos), in the order of terms within each partition, where the rows are read: the build shuffles nothing. Terms are the words of the
benchmark, since only their lists are ever asked for; a posting of the term ``HEAD`` for each row carries its
identifier and length.

Phrases: the words of a window are ranked by the length of their lists. The list of the rarest, moved by its
offset in the window, gives candidate starts; the list of the second rarest, moved likewise, is intersected
with them; what is left is intersected with all other lists at once, of which only the documents that still
have candidates are fetched. Windows with a word that no document has are dropped before. Intersections are
joins on (term, doc, pos), so a word or document that is very frequent is no hot key. Proximity matches
take the same order, with stretches of positions in place of single ones.

Tables made from the benchmark (words, one column of the windows' ranked words) and lists of documents with
candidates are broadcast if they have at most ``MOST`` rows of some ten bytes, which is counted first; larger ones are
joined by shuffle.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import discard, keep

#: What is between words; upper case letters are lowered word by word.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HEAD = -1
MOST = 300_000
PLACE = ["term", "doc", "pos"]


def checked(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= MOST else table


def words_of(text: Column) -> Column:
    """Runs of digits, ASCII letters and characters beyond ASCII, in the case of the text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, ascii_uppercase, ascii_lowercase)).otherwise(word)


def benchmark_items(df: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item, words: ``item`` names the words, so that copies of an item are searched once. Items without
    words are left out."""
    words = F.transform(words_of(F.col(text_col)), lowered)
    rows = df.select(F.col(id_col).cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    return rows.select("item_id", F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("item"), "words")


def vocabulary(items: DataFrame) -> DataFrame:
    """(word, term): a number for each word of the benchmark."""
    found = items.select(F.explode("words").alias("word")).distinct()
    return keep(found.select("word", F.monotonically_increasing_id().alias("term")).unionByName(items.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(HEAD).cast("long").alias("term"))))


def build_index(df: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of the vocabulary ``terms`` in ``df``, stored: term, doc, pos (from 1), and for the term HEAD
    (pos 0) doc_id and n_words."""
    rows = df.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("doc", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
    rows = rows.withColumn("word", lowered(F.col("word"))).join(checked(terms), "word")
    head = lambda c: F.when(F.col("term") == HEAD, F.col(c)).alias(c)
    return keep(rows.select(*PLACE, head("doc_id"), head("n_words")).sortWithinPartitions("term"))


def windows_of(items: DataFrame, terms: DataFrame, postings: DataFrame, length: int = 10) -> DataFrame:
    """The windows that can occur, stored: win, item, at (of the window in the item), n (words), ranked: (count, term, offset),
    the rarest first."""
    n = F.least(F.lit(length), F.size("words"))
    rows = items.select("item", "words").dropDuplicates(["item"]).select("item", "words", n.alias("n"))
    rows = rows.select("item", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    rows = rows.select("item", "at", "n", F.posexplode(F.slice("words", F.col("at"), F.col("n"))).alias("offset", "word")).join(checked(terms), "word")
    counts = keep(postings.groupBy("term").agg(F.count("*").alias("count")))
    ranked = rows.join(checked(counts), "term").groupBy("item", "at", "n").agg(F.array_sort(F.collect_list(F.struct("count", "term", "offset"))).alias("ranked"))
    return keep(ranked.where(F.size("ranked") == F.col("n")).select(F.monotonically_increasing_id().alias("win"), "item", "at", "n", "ranked"))


def lists_of(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The lists of some terms; a filter only, so that it isn't worth a shuffle."""
    wanted = keep(terms.select("term").distinct())
    return postings.select(*PLACE).join(F.broadcast(wanted), "term", "left_semi") if wanted.count() <= MOST else postings.select(*PLACE)


def ranked_term(windows: DataFrame, rank: int) -> DataFrame:
    """win, term, offset of the windows' words of a rank, from 0."""
    return windows.where(F.col("n") > rank).select("win", F.col("ranked")[rank]["term"].alias("term"), F.col("ranked")[rank]["offset"].alias("offset"))


def phrases(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """win, doc, start: every place at which a window's words stand one after the other, stored."""
    rarest = checked(ranked_term(windows, 0))
    begun = postings.select(*PLACE).join(rarest, "term").select("win", "doc", (F.col("pos") - F.col("offset")).alias("start")).where("start > 0")
    begun = keep(begun)
    second = ranked_term(windows, 1)
    asked = begun.join(checked(second), "win").select("win", "doc", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    met = asked.hint("merge").join(lists_of(postings, second), PLACE).select("win", "doc", "start")
    alone = begun.join(windows.where("n = 1"), "win", "left_semi")
    met = keep(met.unionByName(alone))
    discard(begun)
    docs = keep(met.select("doc").distinct())
    more = windows.where("n > 2").select("win", F.explode(F.slice("ranked", 3, F.greatest(F.col("n") - 2, F.lit(1)))).alias("r")).select("win", "r.term", "r.offset")
    asked = met.join(more, "win").select("win", "doc", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    there = lists_of(postings, more)
    if docs.count() <= MOST:  # a filter only
        there = there.join(F.broadcast(docs), "doc", "left_semi")
    counts = asked.hint("merge").join(there, PLACE).groupBy("win", "doc", "start").agg(F.count("*").alias("hits"))
    whole = counts.join(windows.select("win", "n"), "win").where("hits = n - 2").select("win", "doc", "start")
    out = keep(whole.unionByName(met.join(windows.where("n <= 2"), "win", "left_semi")))
    discard(met, docs)
    return out


def proximity(postings: DataFrame, windows: DataFrame, within: int) -> DataFrame:
    """win, doc, pos, start: the places ``pos`` of a window's rarest word that lie in a stretch of ``within`` words
    with all words of the window, in any order; ``start`` of the first such stretch. A stretch may begin before
    the document."""
    distinct = F.array_sort(F.transform(F.array_distinct(F.transform("ranked", lambda r: r["term"])), lambda t: F.struct(F.filter("ranked", lambda r: r["term"] == t)[0]["count"].alias("count"), t.alias("term"), F.lit(0).alias("offset"))))
    sets = windows.select("win", distinct.alias("ranked")).withColumn("n", F.size("ranked"))
    rarest, second = ranked_term(sets, 0), ranked_term(sets, 1)
    cell = (F.col("pos") / within).cast("int")
    begun = keep(postings.select(*PLACE).join(checked(rarest), "term").select("win", "doc", F.col("pos").alias("p")))
    around = lambda c, words: c.join(words, "win").select("win", "doc", "p", "term", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: (F.col("p") / within).cast("int") + k)).alias("cell"))
    near = F.abs(F.col("pos") - F.col("p")) < within
    key = ["term", "doc", "cell"]
    met = around(begun, second).hint("merge").join(lists_of(postings, second).withColumn("cell", cell), key).where(near).select("win", "doc", "p").distinct()
    met = keep(met.unionByName(begun.join(sets.where("n = 1"), "win", "left_semi")))
    discard(begun)
    docs = keep(met.select("doc").distinct())
    more = sets.select("win", F.explode("ranked").alias("r")).select("win", "r.term")
    there = lists_of(postings, more).join(checked(docs), "doc", "left_semi").withColumn("cell", cell)
    found = around(met, more).hint("merge").join(there, key).where(near).groupBy("win", "doc", "p").agg(F.collect_list(F.struct("term", "pos")).alias("found"))  # at most 2 * within
    found = found.join(sets.select("win", "n"), "win")
    full = lambda x: F.size(F.array_distinct(F.transform(F.filter("found", lambda f: f["pos"].between(x, x + within - 1)), lambda f: f["term"]))) == F.col("n")
    starts = F.filter(F.sequence(F.col("p") - within + 1, F.col("p")), full)
    return found.select("win", "doc", F.col("p").alias("pos"), starts.alias("s")).where(F.size("s") > 0).select("win", "doc", "pos", F.col("s")[0].alias("start"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", length: int = 10) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII; a window is ``length``
    consecutive words of an item, or all of a shorter one. ``n_hit`` counts the words inside any occurrence of a
    window, ``n_items`` the items (by identifier) with one; ``items_sha256`` is the hash of their identifiers as
    strings, sorted and joined with commas. Edge cases: a null text has no words; an item without words has no
    window; an item without an identifier hits words but isn't counted or listed; rows repeated with one
    identifier are documents of their own; items repeated with one identifier are one item with the windows of
    all; an empty table gives no rows, an empty benchmark hits nothing. Texts of any length are indexed whole;
    other columns play no part.
    """
    items = keep(benchmark_items(benchmark, item_id_col, item_text_col))
    terms = vocabulary(items)
    postings = build_index(df, terms, id_col, text_col)
    windows = windows_of(items, terms, postings, length)
    places = keep(phrases(postings, windows).join(windows.select("win", "item", "n"), "win").select("doc", "item", "start", "n"))
    spans = places.select("doc", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    earlier = Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(earlier), F.lit(0))), F.lit(0))
    hits = spans.select("doc", covered.alias("new")).groupBy("doc").agg(F.sum("new").cast("long").alias("n_hit"))
    named = items.where("item_id is not null").select("item", "item_id").distinct()
    listed = places.select("doc", "item").distinct().join(named, "item").groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    rows = postings.where(F.col("term") == HEAD).select("doc", "doc_id", "n_words")
    out = rows.join(hits, "doc", "left").join(listed, "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
