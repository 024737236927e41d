import pytest

from lexigrain.functions.encodings import CODE_PAGES, ESCAPES, WIDE, confidences, decoded, detect_encoding, encoded, likeliest, ranges, to_bytes, to_text, upper_half
from pyspark.sql import functions as F

TEXTS = {
    "ISO-8859-1": "Les élèves français déjà à l'école, où ça va être; señor, größer",
    "windows-1252": "“Größe” – naïve café…",
    "ISO-8859-2": "Zażółć gęślą jaźń; Příliš žluťoučký kůň",
    "windows-1250": "Příliš žluťoučký kůň úpěl ďábelské ódy",
    "windows-1251": "Привет, мир. Как дела? ЭТО ЗАГОЛОВОК",
    "KOI8-R": "привет, мир. Как дела? Ёлка",
    "ISO-8859-5": "Привет, мир. Как дела? ЭТО",
    "ISO-8859-7": "Καλημέρα κόσμε, τι κάνεις σήμερα; Η Αθήνα",
    "windows-1253": "Καλημέρα κόσμε… τι κάνεις σήμερα; Άλλο",
    "ISO-8859-8": "שלום עולם, מה שלומך היום",
    "windows-1255": "שָׁלוֹם עולם… מה שלומך",
    "ISO-8859-6": "مرحبا بالعالم، كيف حالك اليوم",
    "windows-1256": "مرحبا بالعالم، كيف حالك اليوم… گپ",
    "ISO-8859-9": "Günaydın dünya, bugün nasılsınız? İyi akşamlar",
    "windows-1254": "“Günaydın” dünya… nasılsınız? şöyle iğne",
    "EUC-KR": "안녕하세요 세계. 오늘은 날씨가 좋습니다",
    "EUC-JP": "こんにちは世界。今日は天気がいいです",
    "Shift_JIS": "こんにちは世界。今日は天気がいいです",
    "Big5": "你好世界。今天天氣很好，我們去公園吧",
    "GB18030": "你好世界。今天天气很好，我们去公园吧",
    "ISO-2022-JP": "こんにちは",
    "ISO-2022-KR": "안녕하세요",
}


@pytest.mark.parametrize("name", CODE_PAGES)
def test_code_pages(spark, name):
    """As Python's codecs have them, there and back; what a page lacks is a question mark."""
    every = bytes(range(256))
    row = spark.createDataFrame([(every, "a€ł日б\U0001f600é")], "d binary, t string").select(decoded(F.col("d"), name).alias("text"), encoded(F.col("t"), name).alias("data"), encoded(decoded(F.col("d"), name), name).alias("back")).first()
    assert row.text == bytes(range(128)).decode() + upper_half(name)
    assert bytes(row.data) == "a€ł日б\U0001f600é".encode(CODE_PAGES[name], "replace")
    assert all(b == c or upper_half(name)[b - 128] == "�" for b, c in zip(every, bytes(row.back), strict=True))


def test_detection(spark):
    rows = [(name, text, text.encode(CODE_PAGES.get(name, name))) for name, text in TEXTS.items()] + [("UTF-8", "é" * 9, ("é" * 9).encode()), ("UTF-8", "", b""), ("UTF-16LE", "﻿ab", "﻿ab".encode("utf-16-le")), (None, None, b"\x81\x8d\x8f" * 9), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, text string, data binary")
    for r in df.select("*", detect_encoding(F.col("data")).alias("told"), to_text(F.col("data"), F.col("name")).alias("back")).collect():
        if r.data is not None:
            assert (r.told and r.told.encoding) == r.name and (r.told is None or r.told.confidence >= 40), (r.name, r.told)
            assert r.name is None or r.back == r.text.lstrip("﻿")


def test_bytes_by_row(spark):
    """As Python's codecs write them; what an encoding lacks is a question mark, an unknown encoding gives null."""
    text = "aé日€б\U0001f600"
    names = [*CODE_PAGES, *WIDE, *ESCAPES, "UTF-8", "UTF-16LE", "EBCDIC", None]
    df = spark.createDataFrame([(n, t) for n in names for t in (text, "", None)], "name string, text string")
    for r in df.select("*", to_bytes(F.col("text"), F.col("name")).alias("data")).collect():
        known = r.name not in ("EBCDIC", None) and r.text is not None
        assert (r.data and bytes(r.data)) == (r.text.encode(CODE_PAGES.get(r.name, r.name), "replace") if known else None) or r.data == b"", (r.name, r.data)
        assert known == (r.data is not None)


@pytest.mark.parametrize("name", ["cp437", "johab", "cp1258"])
def test_encodings_that_python_knows(spark, name):
    row = spark.createDataFrame([("aé語가\u0301",)], "t string").select(encoded(F.col("t"), name).alias("data"), decoded(encoded(F.col("t"), name), name).alias("text")).first()
    assert bytes(row.data) == "aé語가\u0301".encode(name, "replace") and row.text == bytes(row.data).decode(name)
    with pytest.raises(LookupError):
        encoded(F.col("t"), "no-such")


def test_characters_are_read_from_their_first_byte():
    """A character's second byte is no beginning of another: EUC-JP of one kana kind, and bytes that break off."""
    found = dict(confidences("ひらがな".encode("euc_jp") * 20))
    assert found["EUC-JP"] == 95 and found["EUC-KR"] == 0
    assert "EUC-JP" not in dict(confidences("ひらがな".encode("euc_jp")[:-1]))
    assert all(c == 0 for _, c in confidences(b""))


def test_long_words_take_linear_time(spark):
    import time

    began = time.monotonic()
    df = spark.createDataFrame([(b"a" * 2_000_000 + b"\xe9",), (b"\xe9" * 1_000_000,)], "data binary")
    assert [r[0] and r[0].encoding for r in df.select(detect_encoding(F.col("data"))).collect()] == ["ISO-8859-1", "windows-1251"]
    assert time.monotonic() - began < 60


def test_scores_count_characters_in_numbers():
    """Characters of one, three and four bytes, half width, and letters behind second bytes of ASCII, as read one by one; the
    likeliest is the first of the largest, whatever isn't scored; a long text of many characters takes a few milliseconds."""
    import random
    import re
    import time
    from collections import Counter

    chars = {
        "EUC-KR": (rb"[\xa1-\xfe]{2}", rb"([\xb0-\xc8][\xa1-\xfe])", [1.0]),
        "EUC-JP": (rb"\x8e[\xa1-\xdf]|\x8f?[\xa1-\xfe]{2}", rb"([\xa4\xa5][\xa1-\xf6])|([\xb0-\xcf][\xa1-\xfe])", [1.0, 0.85]),
        "Shift_JIS": (rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf]", rb"(\x82[\x9f-\xf1]|\x83[\x40-\x7e\x80-\x96])|([\x88-\x97][\x40-\x7e\x80-\xfc])", [1.0, 0.85]),
        "Big5": (rb"[\xa1-\xf9][\x40-\x7e\xa1-\xfe]", rb"([\xa4-\xc6][\x40-\x7e](?![A-Za-z]))|([\xa4-\xc6][\xa1-\xfe])", [1.0, 0.9]),
        "GB18030": (rb"[\x81-\xfe](?:[\x40-\x7e\x80-\xfe]|[0-9][\x81-\xfe][0-9])", rb"([\xb0-\xd7][\xa1-\xfe])", [0.99]),
    }
    rnd = random.Random(4)
    pools = [[0x8E, 0x8F, 0xA1, 0xA4, 0xB0, 0xDF, 0xE0, 0xFE, 0x20, 0x41], [0x81, 0x30, 0x39, 0x80, 0xA1, 0xB0, 0xFE, 0x41, 0x7E, 0x7F], [0x82, 0x9F, 0xA1, 0xDF, 0xE0, 0xFC, 0xFD, 0x40, 0x83, 0x41], [0xA4, 0xC6, 0x41, 0x7E, 0xF9, 0xFA, 0x61]]
    texts = [bytes(rnd.choices(pools[k % 4], k=rnd.randrange(1, 12))) for k in range(4_000)]
    texts += ["".join(rnd.choices(["한글", "ひらがな", "ｶﾅ", "漢字", "㐀𠀀", "abc", " ", "中國"], k=9)).encode(rnd.choice(list(chars)), "ignore") for _ in range(500)]
    held = Counter()
    for data in texts:
        found = list(confidences(data))
        for name, (char, usual, worths) in chars.items():
            if re.fullmatch(rb"(?:[\x00-\x7f]|" + char + rb")*+", data):
                kinds = Counter(m.lastindex for m in re.finditer(rb"[\x00-\x7f]++|" + usual + rb"|(" + char + rb")", data))
                del kinds[None]
                assert dict(found)[name] == int(100 * sum([*worths, 0.0][k - 1] * n for k, n in kinds.items()) / (kinds.total() + 4)), (name, data)
                held[name] += 1
            else:
                assert name not in dict(found), (name, data)
        best = max(found, key=lambda x: x[1])
        assert likeliest(data) == (best if best[1] >= 40 else None), data
    assert min(held.values()) > 200
    long = ("안녕하세요 세계 " * 100_000).encode("EUC-KR")
    began = time.process_time()
    assert likeliest(long) == ("EUC-KR", 99)
    assert time.process_time() - began < 2


def test_lacking_characters_are_told_by_few_ranges():
    """A class of 128 single characters was asked for each character of a text, one after the other."""
    assert ranges("cabz") == r"\x{61}-\x{63}\x{7a}-\x{7a}"
    assert ranges(upper_half("windows-1251")).count("-") < 40
