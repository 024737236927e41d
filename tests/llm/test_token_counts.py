import functools
import random
import tracemalloc

import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from conftest import SF
from lexigrain.llm.queries import op5_token_counts, tokenizer_path
from lexigrain.llm.token_counts import SPACE, Counter, Vocabulary, count_tokens, load_vocabulary


@functools.cache
def vocabulary():
    return load_vocabulary(tokenizer_path("piece_bpe_32k.model"))


def exact_tokenizer(v):
    """The tokenizer library's own unigram model over the same pieces."""
    pieces = [("<unk>", 0.0), *v.pieces.items()]
    if v.byte_fallback:  # byte pieces that no text can match
        pieces += [(f"<0x{k:02X}>", min(v.pieces.values())) for k in range(256)]
    return Tokenizer(Unigram(pieces, unk_id=0, byte_fallback=v.byte_fallback))


TEXTS = ["a", "The quick brown fox", "  two  spaces ", "naïve café 東京 𝒳𝒳 x", "\n\t\x00", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789" * 30, "ééééé ïïï", "word " * 2_000]


def test_counts_are_the_tokenizers(spark):
    tokenizer, counter = exact_tokenizer(vocabulary()), Counter(vocabulary())
    rng = random.Random(5)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += ["".join(rng.choice("abc tion ed é東 ") for _ in range(60)) for _ in range(200)]
    for text in texts:
        ids = tokenizer.encode(SPACE + text.replace(" ", SPACE), add_special_tokens=False).ids
        assert counter.text(text)[0] == len(ids), text[:80]


def plain_viterbi(text, v):
    """All ways by dynamic programming over the whole text, piece lengths from long to short."""
    text = SPACE + text.replace(" ", SPACE)
    longest, best = max(map(len, v.pieces)), [(0.0, 0, False)]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(max(0, end - longest), end):
            if (score := v.pieces.get(text[start:end])) is not None and (found is None or best[start][0] + score > found[0]):
                found = (best[start][0] + score, best[start][1] + 1, False)
        if text[end - 1] not in v.pieces:
            score, n, unknown = best[end - 1]
            if found is None or score + v.unknown_score > found[0]:
                found = (score + v.unknown_score, n + (len(text[end - 1].encode()) if v.byte_fallback else not unknown), True)
        best.append(found)
    return best[-1][1], best[-1][0]


@pytest.mark.parametrize("fallback", [True, False])
def test_ties_and_unknown_runs(fallback):
    v = Vocabulary({"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, SPACE: -1.0, SPACE + "a": -2.0}, fallback)
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("aab é?") for _ in range(rng.randrange(1, 12)))
        assert Counter(v, most=3).text(text) == plain_viterbi(text, v), text
    assert Counter(Vocabulary({}, False)).text("xyz") == (1, -40.0)


def test_query_and_edges(spark):
    counter = Counter(vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_tokens, r.score) for r in op5_token_counts(spark, SF).collect()} == {i: counter.text(t) for i, t in texts.items()}
    df = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "a b", 9), (2, "x" * 300_000, 9)], "doc_id long, text string, n_tokens int")
    path = tokenizer_path("piece_bpe_32k.model")
    got = sorted((tuple(r) for r in count_tokens(df, path).collect()), key=repr)
    assert [r[:2] for r in got[:2]] == [(1, 0), (1, 0)] and len(got) == 4
    assert count_tokens(df.limit(0), path).collect() == []


def test_memory_does_not_grow_with_long_words():
    """Of a thousand distinct long words none is kept."""
    counter = Counter(Vocabulary({c: -1.0 for c in "abcdefghij"} | {SPACE: -1.0}, True), most=500)
    tracemalloc.start()
    for k in range(1_000):
        word = (f"{k:03d}".translate(str.maketrans("0123456789", "abcdefghij")) + "aj") * 40_000
        assert counter[word if k % 20 == 0 else word[:65]][0] > 0  # each 20th in full, for time
    assert tracemalloc.get_traced_memory()[0] < 5_000_000
    tracemalloc.stop()
    assert max(map(len, counter), default=0) <= 64
    for k in range(2_000):
        counter.text(f"w{k}")
    assert len(counter) <= 500
