"""Hard negatives by k-means inverted lists with stored radii.

Index: k-means centroids are fitted on a bounded sample; every row goes to the list of its nearest centroid,
and each list stores its radius, the largest distance of a row from the centroid. For an anchor ``a`` and a
list with centroid ``c`` and radius ``r``, Cauchy-Schwarz puts all scores of the list between
``a.c - |a| r`` and ``a.c + |a| r``.

Search: an anchor visits lists by falling upper bound, a few in the first turn and four times as many in
each turn after it. Between turns its kth best score so far is fixed; a list whose upper bound is strictly
below it is never visited, nor one that lies outside all windows in which the anchor still looks. The search
for the anchors' positives has one open window; that for negatives has one for each positive. So results are
exact, whatever the centroids are: they only save visits.

Scale: lists are cut into blocks of bounded rows (a vector that fills a third of the table fills many
blocks), anchors into chunks; a task scores one chunk against one block. The best of each block are at most
k for each window, and Spark limits them before the shuffle. Nothing is broadcast but the centroids and radii.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import discard, keep

LEAST, MOST = -(1 << 62), 1 << 62
#: Stands for a missing identifier, which comes last among equals.
NONE = (1 << 63) - 1
INDEXED = "vec_id long, label long, vec array<long>, list int, far double"
VISIT = "list int, block int, chunk int, anchor long, vec_id long, label long, vec array<long>, windows array<struct<w:int,hi:long,need:long>>"
FOUND = "anchor long, w int, vec_id long, score long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label, vec: floor(scale * x) of each component, for the rows that take part. Rows repeated with
    identifier, label and vector count once."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    vec = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("vec_id"), label.cast("long").alias("label"), F.when(whole, vec).alias("vec"))
    return rows.where("label is not null and vec is not null").distinct()


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where every partial sum is exact there."""
    norm = lambda x: float(np.sqrt(np.square(x, dtype=float).sum(1)).max(initial=0))
    if norm(rows) * norm(anchors) < 2**52:
        return (rows.astype(float) @ anchors.astype(float).T).astype(np.int64)
    return rows @ anchors.T


def assign(centers: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column("vec"), centers.shape[1]).astype(float)
            nearest = (np.square(centers).sum(1) - 2 * x @ centers.T).argmin(1)
            far = np.sqrt(np.square(x - centers[nearest]).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(far)], names=["vec_id", "label", "vec", "list", "far"])

    return run


def bounds(anchors: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible scores of each list for each anchor, with room for rounding."""
    norms = np.sqrt(np.square(anchors).sum(1))[:, None]
    middle, reach = anchors @ centers.T, norms * radii
    room = 1e-9 * norms * (np.sqrt(np.square(centers).sum(1)) + radii) + 1e-6
    return middle - reach - room, middle + reach + room


class Index:
    """The rows by list (kept in the shared folder), and the lists' centroids, radii and numbers of blocks."""

    def __init__(self, rows: DataFrame, max_fit_rows: int, rows_per_list: int, max_lists: int, block_rows: int):
        rows = keep(rows)
        n, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
        self.size, self.dim = n, max(dim or 0, 1)
        if n == 0:
            return
        padded = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(self.dim) - F.size("vec")))
        wide = rows.withColumn("vec", padded)
        chance = min(1.0, max_fit_rows / n)
        sample = wide.where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 20)) < chance * (1 << 20)) if chance < 1 else wide
        sample = sample.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
        model = KMeans(k=int(np.clip(n // rows_per_list, 8, max_lists)), maxIter=8, seed=11).fit(sample)
        centers = np.array(model.clusterCenters())
        self.rows = keep(wide.mapInArrow(assign(centers), INDEXED))
        discard(rows)
        lists = self.rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("r")).orderBy("list").collect()  # at most max_lists
        self.numbers = [x.list for x in lists]
        self.centers, self.radii = centers[self.numbers], np.array([x.r for x in lists])
        self.blocks = [-(-x.n // block_rows) for x in lists]

    def turns(self) -> Iterator[tuple[int, int]]:
        first, width = 0, 2
        while first < len(self.numbers):
            yield first, first + width
            first, width = first + width, width * 4

    def visits(self, state: DataFrame, first: int, last: int, chunks: int) -> DataFrame:
        """The lists from place ``first`` to ``last`` that each anchor visits, a row for each block."""
        dim, numbers, blocks, centers, radii = self.dim, self.numbers, self.blocks, self.centers, self.radii
        types = [pa.int32(), pa.int32(), pa.int32()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low, high = bounds(vectors(batch.column("vec"), dim).astype(float), centers, radii)
                order = np.argsort(-high, axis=1, kind="stable")[:, first:last]
                at, to = [], [[], [], []]
                for k, (windows, anchor) in enumerate(zip(batch.column("windows").to_pylist(), batch.column("anchor").to_pylist(), strict=True)):
                    for j in order[k]:
                        if any(low[k, j] <= w["hi"] and high[k, j] >= w["need"] for w in windows):
                            for b in range(blocks[j]):
                                at.append(k)
                                for column, value in zip(to, (numbers[j], b, anchor % chunks), strict=True):
                                    column.append(value)
                        elif all(high[k, j] < w["need"] for w in windows):
                            break
                rows = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*map(pa.array, to, types), *rows.columns], names=[c.split()[0] for c in VISIT.split(", ")])

        return state.select("anchor", "vec_id", "label", "vec", "windows").mapInArrow(run, VISIT)

    def search(self, anchors: DataFrame, same: bool, k: int, chunks: int) -> DataFrame:
        """FOUND and rank: for each window of each anchor (anchor, vec_id, label, vec, windows) the ``k`` best
        rows of its own label (``same``) or of others, scores falling, equal ones by identifier."""
        blocks = F.array(*(F.lit(b) for b in self._by_number()))
        rows = self.rows.select("list", F.pmod(F.xxhash64("vec_id"), blocks[F.col("list")]).cast("int").alias("block"), "vec_id", "label", "vec")
        rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))) if chunks > 1 else F.lit(0))
        key = ["list", "block", "chunk"]
        best = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "vec_id")
        state, found = anchors, None
        for first, last in self.turns():
            visits = self.visits(state, first, last, chunks)
            new = rows.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(scores(self.dim, same, k), FOUND)
            both = new if found is None else found.drop("rank").unionByName(new)
            before, found = found, keep(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
            if before is not None:
                discard(before)
            full = found.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
            need = F.transform("windows", lambda x: x.withField("need", F.greatest(x["need"], F.coalesce(F.col("kth")[x["w"]], x["need"]))))
            state = anchors.join(full, "anchor", "left").withColumn("windows", need).drop("kth")
        return found

    def _by_number(self) -> list[int]:
        by_number = [1] * (max(self.numbers) + 1)
        for number, b in zip(self.numbers, self.blocks, strict=True):
            by_number[number] = b
        return by_number


def scores(dim: int, same: bool, k: int, step: int = 256) -> Callable:
    """The best rows of one block for the anchors of one chunk that visit it."""

    def run(block: pa.Table, visitors: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if block.num_rows and visitors.num_rows:
            ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
            rows = vectors(block.column("vec").combine_chunks(), dim)
            for start in range(0, visitors.num_rows, step):
                part = visitors.slice(start, step)
                table = products(rows, vectors(part.column("vec").combine_chunks(), dim))
                for j, a in enumerate(part.select(["anchor", "vec_id", "label", "windows"]).to_pylist()):
                    score = table[:, j]
                    wanted = (labels == a["label"]) & (ids != a["vec_id"]) if same else labels != a["label"]
                    wanted &= (score >= min(w["need"] for w in a["windows"])) & (score <= max(w["hi"] for w in a["windows"]))
                    near = np.flatnonzero(wanted)
                    near = near[np.lexsort((ids[near], -score[near]))]
                    falling = -score[near]
                    for w in a["windows"]:
                        at = np.searchsorted(falling, -w["hi"])
                        took = near[at : min(at + k, np.searchsorted(falling, -w["need"], "right"))]
                        for column, values in zip(out, ([a["anchor"]] * len(took), [w["w"]] * len(took), ids[took], score[took]), strict=True):
                            column.extend(values)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["anchor", "w", "vec_id", "score"])

    return run


def mine(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: str | Column = "label", is_anchor: Column | None = None, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, scale: int = 256, max_fit_rows: int = 50_000, rows_per_list: int = 2_000, max_lists: int = 256, block_rows: int = 16_384, chunk_anchors: int = 32_768) -> DataFrame:
    """One row for each anchor, positive and negative: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    A score is the inner product of the vectors with each component x taken as floor(scale * x). An
    anchor's positives are its ``positives`` best other rows of its label; the negatives of a positive are the
    ``negatives`` best rows of other labels with low_percent * positive_score <= 100 * negative_score <=
    high_percent * positive_score (none where the positive's score is negative). Equal scores: the smaller
    identifier first. ``is_anchor`` is a condition on ``id_col`` and other columns of ``df`` (by default: the
    identifier is divisible by 100). Labels are integers.

    The centroids are fitted on about ``max_fit_rows`` rows at most; every row is indexed. Edge cases: rows
    with a null label or vector, or a component that is null or not finite, take no part; a missing identifier
    is never an anchor and comes last among equals; shorter vectors count as filled with zeros, so an empty
    one scores 0; rows repeated with identifier, label and vector count once, and another row with an anchor's
    identifier is no positive of it; anchors without positives and positives without negatives give no rows, as
    does an empty table. Scores must be below 2^60. Other columns play no part.
    """
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    asked = F.coalesce((F.col(id_col) % 100 == 0) if is_anchor is None else is_anchor, F.lit(False)) & F.col(id_col).isNotNull()
    index = Index(quantised(df, id_col, vec_col, label, scale), max_fit_rows, rows_per_list, max_lists, block_rows)
    if index.size == 0:
        return spark.createDataFrame([], OUT)
    names = df.where(asked).select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    anchors = keep(index.rows.join(names, "vec_id", "left_semi").select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "vec"))
    chunks = -(-anchors.count() // chunk_anchors) or 1
    window = lambda w, hi, need: F.struct(w.cast("int").alias("w"), hi.cast("long").alias("hi"), need.cast("long").alias("need"))
    start = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(MOST), F.lit(LEAST))))
    found = index.search(start, True, positives, chunks).select("anchor", F.col("rank").cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    open_ = found.where("positive_score >= 0")
    hi, need = F.expr(f"{high_percent} * positive_score div 100"), F.expr(f"({low_percent} * positive_score + 99) div 100")
    windows = open_.groupBy("anchor").agg(F.collect_list(window(F.col("w"), hi, need)).alias("windows"))  # at most ``positives``
    taken = index.search(keep(anchors.join(windows, "anchor")), False, negatives, chunks)
    rows = taken.join(found, ["anchor", "w"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    named = lambda c: F.nullif(F.col(c), F.lit(NONE))
    return rows.select("anchor_id", named("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
