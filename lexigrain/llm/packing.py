"""Harmonic packing of token sequences.

A piece of length l belongs to class ``k = capacity // l`` and k pieces of a class fill a sequence, so
where a piece goes depends on its number within its class alone and all workers place pieces
independently. Documents may be cut, so they are cut to lengths just at the top of a class
(``capacity // k``): full pieces first, then the largest class length that fits what remains, and a
last piece of at most ``tail`` tokens. A class then holds one length, its sequences miss fewer than k
tokens, and offsets need no further shuffle. Numbers within a class come from counts by class and
bucket. What is left are fewer than k pieces of each class, at most about 20,000 whatever the input:
these go into sequences together, longest first, best fit.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import id_and_text, keep, lean

#: Characters on which the tokenizer's normalization is Python's: printable ASCII, Latin-1, Latin Extended-A.
_PLAIN = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA0, 0x180)] if c != 0x130]
UNUSUAL = re.compile("[^" + re.escape("".join(_PLAIN)) + "]")


#: The same as bytes of Latin-1, for a quick look at a text.
_PLAIN_LATIN1 = bytes(ord(c) for c in _PLAIN if ord(c) < 256)


class WordTokenizer:
    """The token ids of a text, as the tokenizer file gives them, as little-endian 32-bit bytes.

    The tokenizer lower-cases a text, cuts it into words (letters, single digits, punctuation) and treats each on its
    own, so the ids of words are looked up once and kept until ``forget``: up to ``most`` new ones and as many of
    before, of which those met again become new ones; those longer than ``longest`` characters only while their text is
    tokenized. A text's new words are encoded in one call, by the file's model without the steps that they have
    been through; a word ends with the token that has the vocabulary's mark of a word's end. Texts with unusual
    characters or with special tokens' marks go through the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 200_000, longest: int = 64):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.of_words = Tokenizer(self.tokenizer.model)  # one model in memory
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.last = {k for token, k in self.tokenizer.get_vocab().items() if token.endswith("</w>")}
        kind = {c: unicodedata.category(c)[0] for c in _PLAIN}
        letters = re.escape("".join(c for c in _PLAIN if kind[c] == "L"))
        digits = re.escape("".join(c for c in _PLAIN if kind[c] == "N"))
        self.cut = re.compile(rf"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{digits}]|[^\s{letters}{digits}]+")

    @property
    def chunks(self) -> dict[str, bytes]:
        """The older words, by the name of what was kept beside the words before."""
        return self.older

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def forget(self) -> None:
        self.words.clear()
        self.older.clear()

    def learn(self, words: list[str]) -> None:
        ids = self.of_words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ends = [4 * at for at, k in enumerate(ids, 1) if k in self.last]
        if len(ends) == len(words) and ends[-1] == 4 * len(ids):
            joined = array("I", ids).tobytes()
            found = [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        else:
            found = map(self.whole, words)
        self.words.update(zip(words, found, strict=True))

    def usual(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, _PLAIN_LATIN1)
        except UnicodeEncodeError:
            return UNUSUAL.search(text) is None

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not self.usual(text):
            return self.whole(text)
        words = self.cut.findall(text.lower())
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > self.most:  # all words of this text must be there at once
            self.older, self.words = self.words, {}
            new = set(words)
        again = self.older.keys() & new
        self.words.update((word, self.older[word]) for word in again)
        new -= again
        if new:
            self.learn(list(new))
        ids = b"".join(map(self.words.__getitem__, words))
        if len(self.words) > self.most:  # one text's words
            self.words.clear()
        else:
            for word in new:
                if len(word) > self.longest:
                    del self.words[word]
        return ids


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker, from task to task; its words are kept for a task only, as the worker then runs
    other stages."""
    return WordTokenizer(path)


def cuts(n: int, capacity: int, tail: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest > tail:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return [*out, rest] if rest else out


def pieces(path: str, capacity: int, tail: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = tokenizer(path)
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    ids, start = tokenize(text.as_py()) + end, 0
                    for length in cuts(len(ids) // 4, capacity, tail):
                        rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4))
                        start += length
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            tokenize.forget()

    return run


def best_fit(capacity: int):
    """Sequences of the bounded rest: longest pieces first, each where least room stays."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        rooms: list[tuple[int, int]] = []
        made, sequence, offset = 0, [], []
        for length in rows["length"]:
            k = bisect.bisect_left(rooms, (length, -1))
            room, number = rooms.pop(k) if k < len(rooms) else (capacity, made)
            made += number == made
            sequence.append(number)
            offset.append(capacity - room)
            if room > length:
                bisect.insort(rooms, (room - length, number))
        return rows.assign(sequence_id=rows["bins"] + sequence, offset=offset).drop(columns=["bins", "all"])

    return run


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, tail: int = 64, end_id: int = 2, buckets: int = 512) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and then ``end_id``; null text counts as empty, so every row has a token.
    Every token lies in exactly one piece; pieces of a sequence lie end to end from 0. Sequences are
    numbered from 0 without gaps. Rows repeated with one identifier are packed each; an empty table
    gives no rows; a null identifier is kept as it is.
    """
    cut = keep(id_and_text(df, id_col, text_col).mapInArrow(pieces(tokenizer_path, capacity, tail, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    buckets = max(buckets, cut.count() // 100_000)  # so that no bucket of a class grows with the input
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = keep(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    classes = counts.groupBy("length").agg(F.sum("n").alias("pieces"))
    classes = classes.withColumn("per", F.expr(f"{capacity} div length")).withColumn("full", F.expr("pieces div per"))
    before = Window.orderBy("length")  # at most about two classes for each of ``tail`` lengths
    classes = classes.withColumn("base", F.sum("full").over(before) - F.col("full")).withColumn("bins", F.sum("full").over(Window.partitionBy()))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    places = counts.withColumn("ahead", ahead).drop("n").join(F.broadcast(classes), "length")
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    numbered = keep(cut.withColumn("rank", number).join(places, ["length", "bucket"]).withColumn("number", F.col("ahead") + F.col("rank") - 1))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    filled = numbered.where("number < full * per").select(*out, F.expr("base + number div per").alias("sequence_id"), F.expr("number % per * length").alias("offset"))
    rest = numbered.where("number >= full * per").select(*out, "bins", F.lit(0).alias("all")).groupBy("all").applyInPandas(best_fit(capacity), ", ".join(f"{c} long" for c in [*out, "sequence_id", "offset"]))
    return filled.unionByName(rest)
