"""Near duplicates: fast similarity sketches, banding, verification on full shingle sets.

Sketch: in round i every shingle is thrown into one of ``t`` bins with the value ``i + hash``; a bin
keeps its least value. The first t rounds throw at random, rounds t to 2t - 1 aim at one bin each, so
every coordinate is filled, and after about ``t log t`` throws in all the sketch is done. Coordinates
agree with the probability of the Jaccard similarity, with Chernoff-type concentration. 30 bands of 5
coordinates miss a pair of similarity 0.8 with a probability under 1e-5.

Texts with equal shingle sets are one class before banding. Within a bucket no pairs are emitted at
first: every member is compared with the least member, the bucket's hub; the links that hold give
components. Most groups are one component then. The members of the other groups are searched exactly by
prefixes: of two texts similar enough, the rarest shingles of one that make up a little over a fifth of it
have one in common with those of the other, in any order of rareness that is the same for all. Rareness
comes from a table of counts of fixed size. So texts that share a template share nothing here, and what is
compared are members of one list and different components: pairs where a list is short; members of long
lists are searched in their hubs' groups, those outside the largest component block against block, at most
one link for each outlier and component. Every candidate pair that could join two components is decided on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import Memo, discard, free_name, id_and_text, keep, lean

M1, M2, STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15
S33, LOW = np.uint64(33), np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S33)) * M2
    return x ^ (x >> S33)


class WordHashes(Memo[bytes, int]):
    """64-bit hashes of words, kept for ``most`` words of at most 64 bytes."""

    def __init__(self, most: int = 400_000):
        super().__init__(xxhash.xxh3_64_intdigest, most)


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 9 to 13, with A-Z lower-cased."""
    return text.lower().split()


def shingles(words: list[bytes], size: int, hashes: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of ``size`` words, sorted; a shorter text is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(each))
    out = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out + each[k : len(each) - size + 1 + k])
    return np.unique(out)


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates, each ``round << 32 | hash``; ``items`` are distinct and at least one."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, empty)
    at, block = 0, max(1, 2048 // len(items))
    while at < t:
        rounds = np.arange(at, min(t, at + block), dtype=np.uint64)
        thrown = mix(items[None, :] ^ mix((rounds + np.uint64(1)) * np.uint64(STEP))[:, None])
        bins = ((thrown >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, bins.astype(np.int64).ravel(), ((rounds << np.uint64(32))[:, None] | (thrown & LOW)).ravel())
        at += len(rounds)
        if not (out == empty).any():
            return out
    for b in np.flatnonzero(out == empty):
        aimed = np.array([t + b], np.uint64)
        out[b] = ((aimed << np.uint64(32)) | (mix(items ^ mix((aimed + np.uint64(1)) * np.uint64(STEP))) & LOW)).min()
    return out


def bands_of(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band; the band's number is part of it."""
    grid = coordinates.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(STEP)
    for k in range(grid.shape[1]):
        key = mix(key + grid[:, k])
    return key.view(np.int64)


def sketched(size: int, bands: int, rows: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, key, keys, seen = [], [], [], {}
            for text in batch.column("text").cast(pa.binary()):
                items = shingles(words_of(text.as_py()), size, hashes)
                n.append(len(items))
                digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None
                key.append(digest)
                if digest is not None and digest not in seen:
                    seen[digest] = bands_of(sketch(items, bands * rows), bands)
                keys.append(seen.get(digest))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return run


def shingle_set(text: bytes, size: int) -> set:
    words = words_of(text)
    size = min(size, len(words))
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if size else set()


def verified(size: int, percent: int):
    """Pairs whose full shingle sets (of words, not hashes) are similar enough."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            good = []
            for k, (text, other) in enumerate(zip(batch.column("a_text").cast(pa.binary()), batch.column("b_text").cast(pa.binary()), strict=True)):
                text, other = text.as_py(), other.as_py()
                if last[0] != other:
                    last = (other, shingle_set(other, size))
                one, two = shingle_set(text, size), last[1]
                both = len(one & two)
                if both and 100 * both >= percent * (len(one) + len(two) - both):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that hold. Texts travel, not sets: they compress better."""
    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(verified(size, percent), "a long, b long")


BLOCK = "hub long, left long, right long, query boolean, doc_id long, component long, text string"


def block_links(rows: list[tuple[bool, int, int, bytes]], size: int, percent: int, hashes: dict) -> set[tuple[int, int]]:
    """(component, component) of the links between the queries and the members of one pair of blocks; one
    link for each query and component is enough."""
    members = [(doc, comp, text, shingles(words_of(text), size, hashes)) for query, doc, comp, text in rows if not query]
    if not members:
        return set()
    postings = np.concatenate([m[3] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(m[3]) for m in members])
    order = np.argsort(postings, kind="stable")
    postings, owner = postings[order], owner[order]
    sizes, comps = np.array([len(m[3]) for m in members]), np.array([m[1] for m in members])
    out = set()
    for query, doc, comp, text in rows:
        if not query:
            continue
        items = shingles(words_of(text), size, hashes)
        low, high = np.searchsorted(postings, items, "left"), np.searchsorted(postings, items, "right")
        counts = high - low
        first = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        both = np.bincount(owner[first + np.arange(counts.sum())], minlength=len(members))
        near = np.flatnonzero((comps != comp) & (both > 0) & (100 * both >= percent * (len(items) + sizes - both)))
        found, own = set(), None
        for k in near:
            if comps[k] in found:
                continue
            own = shingle_set(text, size) if own is None else own
            other = shingle_set(members[k][2], size)
            common = len(own & other)
            if 100 * common >= percent * (len(own) + len(other) - common):
                found.add(comps[k])
                out.add((int(comp), int(comps[k])))
    return out


def searched(size: int, percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, rows = WordHashes(), None, []

        def result() -> pa.RecordBatch:
            found = sorted(block_links(rows, size, percent, hashes)) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("hub", "left", "right", "query", "doc_id", "component")]
            for hub, left, right, query, doc, comp, text in zip(*columns, batch.column("text").cast(pa.binary()), strict=True):
                if (hub, left, right) != key:
                    yield result()
                    key, rows = (hub, left, right), []
                rows.append((query, doc, comp, text.as_py()))
        yield result()

    return run


def outlier_links(placed: DataFrame, texts: DataFrame, size: int, percent: int, block: int = 256) -> DataFrame:
    """Pairs (a, b) of components that a link joins, from ``placed`` (hub, doc_id, component).

    The members of a hub's group that aren't in its largest component are searched in all its members.
    Both are cut into blocks of about ``block``; a member goes to each block of outliers and an outlier to
    each block of members.
    """
    counts = placed.groupBy("hub", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("hub").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main")).where("parts > 1")
    blocks = lambda n: F.ceil(n / block).cast("long")
    mixed = keep(mixed.select("hub", "main", blocks(F.col("all")).alias("lefts"), blocks(F.col("all") - F.col("most")).alias("rights")))
    rows = placed.join(mixed, "hub")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = rows.where("component <> main").select("hub", each("lefts").alias("left"), own("rights").alias("right"), F.lit(True).alias("query"), "doc_id", "component")
    held = rows.select("hub", own("lefts").alias("left"), each("rights").alias("right"), F.lit(False).alias("query"), "doc_id", "component")
    both = asked.unionByName(held).join(texts.select("doc_id", "text"), "doc_id")
    names = [c.split()[0] for c in BLOCK.split(", ")]
    dealt = both.select(*names).repartition("hub", "left", "right").sortWithinPartitions("hub", "left", "right")
    return dealt.mapInArrow(searched(size, percent), "a long, b long").distinct()


#: Counts of shingles by the first bits of their hashes: the table that orders them by rareness, 1 MB.
COUNT_BITS = 18
PREFIX = "shingle long, doc_id long, component long, n long"


def counted(size: int):
    """(part, n): how many shingles of a batch have a beginning."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                items = shingles(words_of(text.as_py()), size, hashes)
                total += np.bincount((items >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        parts = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(total[parts], pa.int64())], names=["part", "n"])

    return run


def prefixes(size: int, percent: int, counts: Broadcast):
    """The rarest shingles of each text: all but ``percent`` hundredths of it, rounded up, and one more."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rareness = WordHashes(), np.frombuffer(counts.value, np.uint32)
        for batch in batches:
            rare, n = [], []
            for text in batch.column("text").cast(pa.binary()):
                items = shingles(words_of(text.as_py()), size, hashes)
                order = np.lexsort((items, rareness[(items >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
                rare.append(items[order[: len(items) - -(-percent * len(items) // 100) + 1]])
                n.append(len(items))
            lengths = list(map(len, rare))
            shingle = np.concatenate(rare).view(np.int64) if rare else np.empty(0, np.int64)
            each = [np.repeat(np.asarray(c, np.int64), lengths) for c in (batch.column("doc_id").to_numpy(), batch.column("component").to_numpy(), n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (shingle, *each)], names=[c.split()[0] for c in PREFIX.split(", ")])

    return run


def prefix_lists(members: DataFrame, size: int, percent: int) -> DataFrame:
    """(shingle, doc_id, component, n, listed) of ``members`` (doc_id, component, text): the lists of
    shingles, by their members' prefixes, in which several components meet."""
    spark = members.sparkSession
    found = members.select("text").mapInArrow(counted(size), "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.uint32)
    counts[found.column("part").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**32 - 1)
    rows = keep(members.mapInArrow(prefixes(size, percent, spark.sparkContext.broadcast(counts.tobytes())), PREFIX))
    mixed = rows.groupBy("shingle").agg(F.count("*").alias("listed"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle", "listed")
    return rows.join(mixed, "shingle")


def group_links(placed: DataFrame, texts: DataFrame, size: int, percent: int, short: int = 32) -> DataFrame | None:
    """Pairs (a, b) that join components, of documents or of components (which are documents too), from
    ``placed`` (hub, doc_id, component); None where no hub's group has several components."""
    mixed = placed.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("hub")
    members = keep(placed.join(mixed, "hub").select("doc_id", "component").distinct())
    if members.isEmpty():
        return None
    lists = keep(prefix_lists(keep(members.join(texts.select("doc_id", "text"), "doc_id")), size, percent))
    few = lists.where(F.col("listed") <= short).select("shingle", "doc_id", "component", "n")
    other = few.select("shingle", *(F.col(c).alias(c + "_b") for c in ("doc_id", "component", "n")))
    alike = f"doc_id < doc_id_b and component <> component_b and 100 * least(n, n_b) >= {percent} * greatest(n, n_b)"
    pairs = keep(few.join(other, "shingle").where(alike).select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b")).distinct())
    out = links(pairs, texts, size, percent)
    many = keep(lists.where(F.col("listed") > short).select("doc_id").distinct())
    return out if many.isEmpty() else out.unionByName(outlier_links(keep(placed.join(many, "doc_id")), texts, size, percent))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches, without those that are
    their own.

    Large-star and small-star turns on the edge table, which never grows, until nothing changes; each
    turn is a table in the shared folder.
    """
    edges = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, keep(small)
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        state = now


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 30, band_rows: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A text's words are runs of bytes other than space and 9 to 13, A-Z lower-cased; its set has the
    distinct shingles of ``shingle_words`` words (a shorter text is one shingle; null or without words:
    empty, linked with nothing). Texts are linked if the intersection is at least ``percent`` hundredths
    of the union; ``component_id`` is the least identifier reachable over links. Edge cases: an empty
    table gives no rows; rows repeated with one identifier get the same result; rows with a null
    identifier take part in nothing and come out with a null component and kept.
    """
    docs = id_and_text(df, id_col, text_col)
    sketches = keep(docs.mapInArrow(sketched(shingle_words, bands, band_rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    classes = keep(sketches.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x")).select("set_key", "x.*"))
    spread = classes.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = keep(spread.groupBy("bucket").agg(F.count("*").alias("members"), F.min("doc_id").alias("least")).where("members > 1").select("bucket", "least"))
    members = keep(spread.join(shared, "bucket"))
    texts = keep(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = classes.select(F.col("doc_id").alias("least"), F.col("n_shingles").alias("n_least"))
    stars = members.where("doc_id <> least").select("doc_id", "n_shingles", "least").distinct().join(sizes, "least")
    stars = stars.where(f"100 * least(n_shingles, n_least) >= {percent} * greatest(n_shingles, n_least)").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    first = keep(links(stars, texts, shingle_words, percent))
    groups = keep(components(first))
    placed = members.select(F.col("least").alias("hub"), "doc_id").distinct().join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = group_links(keep(placed), texts, shingle_words, percent)
    groups = groups if more is None else keep(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    named = classes.select("set_key", "doc_id").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose document stands for its component, with all their columns. Rows of one identifier
    with different texts are judged by all of them: they go together if one of the texts is a copy that goes."""
    found = near_dedup(df, id_col, text_col, **options)
    ident = free_name(df, "dropped")
    dropped = found.where("not kept").select(F.col("doc_id").alias(ident)).distinct()
    return df.join(dropped, F.col(id_col).cast("long").eqNullSafe(F.col(ident)), "left_anti")
