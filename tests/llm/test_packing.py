import random
import zlib
from array import array
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from conftest import SF
from lexigrain.llm.packing import _PLAIN, WordTokenizer, cuts, pack, pieces, tokenizer
from lexigrain.llm.queries import op7_packing, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def check(rows, texts, capacity):
    """Every id lies in one piece; pieces lie end to end. Gives the share of padding."""
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(array("I", ids[at : at + p.length]).tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        total += at
    return 1 - total / (capacity * len(by_sequence))


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check(op7_packing(spark, SF).collect(), texts, 4096) < 0.05


@pytest.mark.parametrize("capacity", [64, 100])
def test_small_capacity(spark, capacity):
    rng = random.Random(2)
    texts = {k: rng.choice([None, "", "a b c ", "word " * rng.randrange(300), "naïve 東京 <|endoftext|> İ " * rng.randrange(9)]) for k in range(300)}
    texts |= {1000 + k: "hot text " * 7 for k in range(200)}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, length int").repartition(5)
    check(pack(df, PATH, capacity=capacity, tail=8, buckets=7).collect(), texts, capacity)


def test_tokenizer_is_exact():
    whole, fast = Tokenizer.from_file(PATH), WordTokenizer(PATH, most=50)
    rng = random.Random(4)
    alphabet = "abcDE'sté İßœ12 .,!?-_\n\t\x00\x85\xa0東𝒳<|>$²½"
    for _ in range(800):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        assert list(array("I", fast(text))) == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1_000, 4_095, 4_096, 4_097, 100_001])
def test_cuts(n):
    lengths = cuts(n, 4096, 64)
    assert sum(lengths) == n and min(lengths) > 0 and lengths[: n // 4096] == [4096] * (n // 4096)
    assert all(x <= 64 or 4096 % x < 4096 // x for x in lengths)


def test_edges(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = pack(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 2), (1, 2)] and {r.sequence_id for r in rows} == {0}


def test_long_words_are_not_kept():
    whole, fast = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    rng = random.Random(8)
    for _ in range(40):
        text = "".join(rng.choices("abcdefghij0-", k=20_000)) + " short words"
        assert list(array("I", fast(text))) == whole.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*fast.chunks, *fast.words])) <= 64


def test_a_task_leaves_no_words(monkeypatch):
    """Workers stay for other stages, beside the executor's heap: what a task has looked up and what Arrow holds
    for reuse goes with it."""
    released = []
    pool = type("Pool", (), {"release_unused": lambda self: released.append(1)})()
    monkeypatch.setattr("pyarrow.default_memory_pool", lambda: pool)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["One two, three's", "four"]})
    first, again = ([b.to_pylist() for b in pieces(PATH, 4096, 64, 2)(iter([batch]))] for _ in range(2))
    assert first == again and [r["doc_tokens"] for r in first[0]] == [len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids) + 1 for t in ("One two, three's", "four")]
    assert not tokenizer(PATH).chunks and not tokenizer(PATH).words and len(released) == 2


def test_words_in_use_are_encoded_once():
    """Whatever many words come once, those that come again are neither encoded again nor kept without bound."""
    fast, encoded = WordTokenizer(PATH, most=50), Counter()

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            encoded.update(w for t in texts for w in t.split())
            return self.inner.encode_batch_fast(texts, **options)

    for name, inner in list(vars(fast).items()):
        if isinstance(inner, Tokenizer):
            setattr(fast, name, Counting(inner))
    hot = [chr(ord("a") + k) * 3 for k in range(10)]
    once = iter(f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "klmnpqrstvwxz")
    for _ in range(30):
        fast(" ".join([*hot, *(next(once) for _ in range(5))]))
        assert len(fast.words) <= 50 and len(fast.chunks) <= 50
    assert set(encoded.values()) == {1} and len(encoded) == 160
    fast(" ".join(f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "klmnpqrstvwxz"))
    assert len(fast.words) <= 50 and len(fast.chunks) <= 50


def test_every_plain_character_is_exact():
    whole, fast = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    around = ["", "a", "É", "7", "'", "'s", "'LL", ".", " ", "<"]
    for c in _PLAIN:
        text = "\n".join(f"{a}{c}{b}" for a in around for b in around)
        assert list(array("I", fast(text))) == whole.encode(text, add_special_tokens=False).ids, repr(c)
