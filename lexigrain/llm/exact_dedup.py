"""Exact duplicates by Patricia-trie owners.

Plan: (1) every task inserts the rows of one Arrow batch into a compressed radix trie and so folds
copies before anything is shuffled: one row of each text carries the bytes, the others only a
reference to it. (2) The texts that are left are dealt by length and content hash; every partition
inserts the full byte strings into a trie whose terminal nodes hold the owner and the count. (3) Rows
meet their owner by the reference. A text that fills a third of the table reaches the trie partition
once for each batch, so no task gets its rows, and the last join has no hot key.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import free_name, id_and_text, keep, lean


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: References of a spilled string that come in one part.
PART = 1 << 20


class Node:
    __slots__ = ("count", "edge", "kids", "owner", "refs", "spilled")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.owner, self.count, self.refs, self.spilled = edge, {}, None, 0, None, None


class PatriciaTrie:
    """Byte strings with their owner, count and references.

    ``largest`` says which identifier owns a text. When edges and references hold more than ``max_bytes``, the
    heaviest subtree below the root path moves to a task-local file; later strings of that subtree
    follow it there, and ``groups`` rebuilds each such file in a trie of its own.
    """

    def __init__(self, largest: bool = True, max_bytes: int = 256 << 20):
        self.largest, self.max_bytes, self.held, self.root = largest, max_bytes, 0, Node(b"")

    def insert(self, key: bytes, ident: int | None, count: int, refs: list) -> Node | None:
        """The terminal node of ``key``, or None if its subtree has been spilled."""
        node, at = self.root, 0
        while at < len(key):
            if node.spilled is not None:
                break
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.held += len(kid.edge)
                node = kid
                break
            if not key.startswith(kid.edge, at):
                n = shared_prefix(kid.edge, key[at : at + len(kid.edge)])
                fork = node.kids[key[at]] = Node(kid.edge[:n])
                kid.edge = kid.edge[n:]
                fork.kids[kid.edge[0]] = kid
                kid = fork
            at += len(kid.edge)
            node = kid
        if node.spilled is not None:
            pickle.dump((key[at:], ident, count, refs), node.spilled)
            return None
        if ident is not None and (node.owner is None or (ident > node.owner) == self.largest):
            node.owner = ident
        node.count += count
        if node.refs is None:
            node.refs = array("q")
        node.refs.extend(refs)
        self.held += 8 * len(refs)
        if self.held > self.max_bytes:
            self.spill()
        return node

    def weight(self, node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.edge) + 8 * len(x.refs or ())
            todo += x.kids.values()
        return total

    def spill(self) -> None:
        """Moves the heaviest subtree to a file; a lone path is followed down to where it forks."""
        node = self.root
        while len(node.kids) == 1 and node.count == 0 and (only := next(iter(node.kids.values()))).kids:
            node = only
        open_kids = [x for x in node.kids.values() if x.spilled is None]
        if not open_kids:
            return
        top = max(open_kids, key=self.weight)
        self.held -= self.weight(top) - len(top.edge)
        out, todo = tempfile.TemporaryFile(), [(b"", top)]
        while todo:
            path, x = todo.pop()
            if x.spilled is not None:
                x.spilled.seek(0)
                for suffix, *rest in records(x.spilled):
                    pickle.dump((path + suffix, *rest), out)
            elif x.count:
                pickle.dump((path, x.owner, x.count, x.refs), out)
            todo += [(path + kid.edge, kid) for kid in x.kids.values()]
        top.kids, top.owner, top.count, top.refs, top.spilled = {}, None, 0, None, out

    def groups(self) -> Iterator[tuple[int | None, int, array]]:
        """(owner, count, references) of every distinct string; a string of very many references comes in several
        parts, each with its owner and whole count."""
        todo, files = [self.root], []
        while todo:
            x = todo.pop()
            if x.spilled is not None:
                files.append(x.spilled)
            elif x.count:
                yield x.owner, x.count, x.refs
            todo += x.kids.values()
        self.root = Node(b"")
        for file in files:
            file.seek(0)
            suffixes, best, count = set(), None, 0
            for suffix, ident, n, _ in records(file):
                suffixes = suffixes if len(suffixes) > 1 else suffixes | {suffix}
                count += n
                if ident is not None and (best is None or (ident > best) == self.largest):
                    best = ident
            file.seek(0)
            if len(suffixes) == 1:  # one string: its references needn't be in memory together
                some = array("q")
                for *_, refs in records(file):
                    some.extend(refs)
                    if len(some) >= PART:
                        yield best, count, some
                        some = array("q")
                if some:
                    yield best, count, some
                continue
            below = PatriciaTrie(self.largest, self.max_bytes)
            for record in records(file):
                below.insert(*record)
            yield from below.groups()


def records(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


FOLDED = "doc_id long, ref long, best long, copies long, n_bytes long, text_sha256 string, body binary"


def fold(largest: bool):
    """Copies within a batch share one reference; the first row of each text carries its bytes, the
    batch's owner and the number of copies."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 36
        for batch in batches:
            trie, first, of = PatriciaTrie(largest, 1 << 62), {}, []
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            for k, (ident, text) in enumerate(zip(ids, texts, strict=True)):
                node = trie.insert(text, ident, 1, [])
                if id(node) not in first:
                    first[id(node)] = (made, k, node, hashlib.sha256(text).hexdigest())
                    made += 1
                of.append(first[id(node)])
            leads = [x[2] if x[1] == k else None for k, x in enumerate(of)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([x[0] for x in of], pa.int64()),
                    pa.array([x and x.owner for x in leads], pa.int64()),
                    pa.array([x and x.count for x in leads], pa.int64()),
                    pa.array(list(map(len, texts)), pa.int64()),
                    pa.array([x[3] for x in of], pa.string()),
                    pa.array([x and t for x, t in zip(leads, texts, strict=True)], pa.binary()),
                ],
                names=["doc_id", "ref", "best", "copies", "n_bytes", "text_sha256", "body"],
            )

    return run


def own(largest: bool, max_bytes: int):
    """The owner and size of every group of a length-and-hash partition, for each reference."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest, max_bytes)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("body", "best", "copies", "ref")), strict=True):
                trie.insert(row[0], row[1], row[2], [row[3]])
        refs, owners, sizes = [], [], []
        for owner, count, of in trie.groups():
            refs += of
            owners += [owner] * len(of)
            sizes += [count] * len(of)
            if len(refs) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(owners, pa.int64()), pa.array(sizes, pa.int64())], names=["ref", "keep_id", "group_size"])
                refs, owners, sizes = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(owners, pa.int64()), pa.array(sizes, pa.int64())], names=["ref", "keep_id", "group_size"])

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_largest: bool = True, max_trie_bytes: int = 256 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when their UTF-8 bytes are; null counts as empty. The row with the largest
    identifier stays (the smallest if ``keep_largest`` is false). Edge cases: an empty table gives no
    rows; rows repeated with one identifier are all ``kept`` if it owns the text; a null identifier
    never owns a text that another row has (a text with null identifiers alone has keep_id null and
    its rows are kept).
    """
    folded = keep(id_and_text(df, id_col, text_col).mapInArrow(fold(keep_largest), FOLDED))
    texts = folded.where("body is not null").select("n_bytes", "text_sha256", "body", "best", "copies", "ref")
    owners = texts.repartition("n_bytes", "text_sha256").mapInArrow(own(keep_largest, max_trie_bytes), "ref long, keep_id long, group_size long")
    rows = folded.select("doc_id", "ref", "n_bytes", "text_sha256").join(owners, "ref")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_largest: bool = True) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; of rows repeated with one identifier and text,
    all."""
    found = exact_dedup(df, id_col, text_col, keep_largest)
    ident, content = free_name(df, "dropped"), free_name(df, "sha256")
    dropped = found.where("not kept").select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(content)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(ident)) & (F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256) == F.col(content))
    return df.join(dropped, same, "left_anti")
