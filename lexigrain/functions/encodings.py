"""Decoding, encoding, and telling encodings apart by what the bytes would say.

A code page is its upper half of 128 characters, made from Python's codec of that name; text of ISO-8859-1 is mapped to it and
back by ``translate``. Encodings that Spark has no function for, of several bytes a character most of all, are decoded
in Arrow batches.

To tell encodings apart, each is scored on the bytes beyond ASCII. A code page is as likely as the share of its non-ASCII characters that stand as letters of its script do: small letters
between letters of their own kind, the usual ones first, capitals that don't follow small letters, no words of two scripts,
no long runs of accented letters. An encoding of several bytes a character must hold throughout, and is as likely as the share
of its characters that are in its script's usual rows. Only what no mark and no valid UTF-8 tells goes to the workers,
which count bytes with numpy: patterns in the JVM took several times as long.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.strings import guess_encoding, to_utf8

#: Code pages in the order in which equal scores are decided.
CODE_PAGES = {
    "ISO-8859-1": "latin-1", "windows-1252": "cp1252", "ISO-8859-2": "iso8859_2", "windows-1250": "cp1250", "windows-1251": "cp1251", "KOI8-R": "koi8_r",
    "ISO-8859-5": "iso8859_5", "ISO-8859-7": "iso8859_7", "windows-1253": "cp1253", "ISO-8859-8": "iso8859_8", "windows-1255": "cp1255",
    "ISO-8859-6": "iso8859_6", "windows-1256": "cp1256", "ISO-8859-9": "iso8859_9", "windows-1254": "cp1254",
}
HIGH = "".join(map(chr, range(0x80, 0x100)))
#: Letters that languages of the Latin pages write often, and others that they write now and then.
WESTERN, WESTERN_RARE = "àáâäçèéêëíîïñóôöùúûüßœ", "ãåæìòõøýÿ"
CENTRAL, CENTRAL_RARE = "áäąčćęéěíłńóöőřśšúůüűýžźż", "âăçďđëîňôťşţ"
TURKISH, TURKISH_RARE = "çğıöşü", "âîû"
#: Letters of other scripts: usual ones, the others.
CYRILLIC, CYRILLIC_RARE = "авеиклмнорст", "бгдёжзйуфхцчшщъыьэюяђѓєѕіїјљњћќўџґ"
GREEK, GREEK_RARE = "αεηικλνοπρςστυάέήίό", "βγδζθμξφχψωϊϋΐΰύώ"
HEBREW, HEBREW_RARE = "אבהוילמנרשת", "גדזחטכסעפצק"
HEBREW_FINAL, HEBREW_POINTS = "ךםןףץ", "".join(map(chr, range(0x5B0, 0x5C3)))
ARABIC, ARABIC_RARE = "ابةتدرعفقكلمنهوي", "ءآأؤإئثجحخذزسشصضطظغىًٌٍَُِّْ"
QUOTES = "«»“”„‘’‚‹›–—…€©®°§¿¡·\xa0"
#: For each code page the letters that it is told by, and whether they stand apart in Latin words.
LETTERS = {
    "ISO-8859-1": (WESTERN, WESTERN_RARE), "windows-1252": (WESTERN, WESTERN_RARE), "ISO-8859-2": (CENTRAL, CENTRAL_RARE), "windows-1250": (CENTRAL, CENTRAL_RARE),
    "windows-1251": (CYRILLIC, CYRILLIC_RARE), "KOI8-R": (CYRILLIC, CYRILLIC_RARE), "ISO-8859-5": (CYRILLIC, CYRILLIC_RARE), "ISO-8859-7": (GREEK, GREEK_RARE),
    "windows-1253": (GREEK, GREEK_RARE), "ISO-8859-8": (HEBREW, HEBREW_RARE), "windows-1255": (HEBREW, HEBREW_RARE), "ISO-8859-6": (ARABIC, ARABIC_RARE),
    "windows-1256": (ARABIC, ARABIC_RARE), "ISO-8859-9": (TURKISH, TURKISH_RARE), "windows-1254": (TURKISH, TURKISH_RARE),
}
LATIN = {"ISO-8859-1", "windows-1252", "ISO-8859-2", "windows-1250", "ISO-8859-9", "windows-1254"}
#: Code pages that are told by a few letters; the others need several different ones.
USUAL = LATIN | {"windows-1251", "KOI8-R"}
#: Encodings of several bytes a character: first and second bytes of characters of two, and the rows that texts of the script
#: mostly use with what their characters are worth (syllables of Korean; the first level of Chinese; kana, then the first level
#: of kanji). What else an encoding has is in ``wide_confidence``.
WIDE = {
    "EUC-KR": (r"\xa1-\xfe", r"\xa1-\xfe", [(r"\xb0-\xc8", r"\xa1-\xfe", 1.0)]),
    "EUC-JP": (r"\xa1-\xfe", r"\xa1-\xfe", [(r"\xa4\xa5", r"\xa1-\xf6", 1.0), (r"\xb0-\xcf", r"\xa1-\xfe", 0.85)]),
    "Shift_JIS": (r"\x81-\x9f\xe0-\xfc", r"\x40-\x7e\x80-\xfc", [(r"\x82", r"\x9f-\xf1", 1.0), (r"\x83", r"\x40-\x7e\x80-\x96", 1.0), (r"\x88-\x97", r"\x40-\x7e\x80-\xfc", 0.85)]),
    "Big5": (r"\xa1-\xf9", r"\x40-\x7e\xa1-\xfe", [(r"\xa4-\xc6", r"\x40-\x7e", 1.0), (r"\xa4-\xc6", r"\xa1-\xfe", 0.9)]),
    "GB18030": (r"\x81-\xfe", r"0-9\x40-\x7e\x80-\xfe", [(r"\xb0-\xd7", r"\xa1-\xfe", 0.99)]),
}
#: Marks of encodings that switch by escapes.
ESCAPES = {"ISO-2022-JP": r"\x1b\$[@B]", "ISO-2022-KR": r"\x1b\$\)C"}
#: Encodings that Spark decodes and encodes itself.
SPARK = {"UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32", "US-ASCII"}
#: A reading that is less likely, in hundredths, tells nothing.
LEAST = 40


def upper_half(name: str) -> str:
    return "".join(bytes([b]).decode(CODE_PAGES[name], "replace") for b in range(0x80, 0x100))


def ranges(chars: str) -> str:
    """Characters as ranges of a pattern's class: a class of single ones would be asked one after the other."""
    found: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if found and found[-1][1] == code - 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in found)


def by_codec(value: Column, kind: str, convert: Callable) -> Column:
    """``convert`` of each value that isn't null, in Arrow batches."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else convert(x) for x in values.to_pylist()], pa.string() if kind == "string" else pa.binary())

    return F.arrow_udf(run, kind)(value)


def decoded(data: Column, name: str) -> Column:
    """Text of bytes in an encoding that Spark, this module or Python knows (LookupError for others); bytes that it has no
    character for become U+FFFD."""
    if name in CODE_PAGES:
        text = F.decode(data, "ISO-8859-1")
        return text if name == "ISO-8859-1" else F.translate(text, HIGH, upper_half(name))
    if name in SPARK:
        return F.decode(data, name)
    codec = codecs.lookup(name).name
    return by_codec(data, "string", lambda x: bytes(x).decode(codec, "replace"))


def encoded(text: Column, name: str) -> Column:
    """Bytes of a text in such an encoding; characters that it lacks become ``?``."""
    if name in CODE_PAGES:
        page = [(c, b) for c, b in zip(upper_half(name), HIGH, strict=True) if c != "�"]
        lacking = rf"(?![\x00-\x7f])[^{ranges(''.join(c for c, _ in page))}]"
        return F.encode(F.translate(F.regexp_replace(text, lacking, "?"), "".join(c for c, _ in page), "".join(b for _, b in page)), "ISO-8859-1")
    if name in SPARK:
        return F.encode(text, name)
    codec = codecs.lookup(name).name
    return by_codec(text, "binary", lambda x: x.encode(codec, "replace"))


@dataclass
class Page:
    """What bytes are worth in a code page, by byte: letters, capitals (not behind small letters), letters that end words,
    and quotation marks; ``most`` is what a byte can be worth at best."""

    name: str
    latin: bool
    small: np.ndarray
    letter: np.ndarray
    letters: np.ndarray
    capitals: np.ndarray
    finals: np.ndarray
    quotes: np.ndarray
    apostrophe: np.ndarray

    @property
    def most(self) -> np.ndarray:
        return self.letters + self.capitals + self.finals + self.quotes


def page_of(name: str) -> Page:
    chars = [*map(chr, range(0x80)), *upper_half(name)]
    common, rare = LETTERS[name]
    latin = name in LATIN
    capitals = [c for c in (common + rare).upper() if c not in common + rare + "SŸ"] + ["İ"] * (common == TURKISH)

    def worth(wanted: list[tuple[str | list[str], float]]) -> np.ndarray:
        return np.array([0.0] * 0x80 + [next((w for some, w in wanted if c in some), 0.0) for c in chars[0x80:]])

    return Page(
        name, latin, np.array([c.islower() for c in chars]), np.array([c.isalpha() for c in chars]),
        worth([(common, 1.0), (rare, 0.5 if latin else 0.65 if common == ARABIC else 0.75), (HEBREW_POINTS if common == HEBREW else "", 0.3)]), worth([([c for c in capitals if latin or c.lower() in common], 0.8 if latin else 0.7), (capitals, 0.35)]),
        worth([(HEBREW_FINAL, 1.0)] if common == HEBREW else []), worth([(QUOTES, 0.8)] if latin else [(QUOTES + "№", 0.4)]), np.array([c == "’" for c in chars]),
    )


def bytes_of(some: str) -> np.ndarray:
    """Whether each byte is one of a class."""
    return np.array([re.match(f"[{some}]".encode(), bytes([b])) is not None for b in range(256)])


@dataclass
class Wide:
    """First and second bytes of an encoding's characters of two, what a character is worth by first and second byte, those
    worths, and a pattern that a text's beginning must match."""

    name: str
    first: np.ndarray
    second: np.ndarray
    worth: np.ndarray
    worths: list[float]
    head: re.Pattern


def wide_of(name: str) -> Wide:
    first, second, usual = WIDE[name]
    worth = np.zeros((256, 256))
    for row, cell, w in usual:
        worth[np.ix_(bytes_of(row), bytes_of(cell))] = w
    other = {"EUC-JP": r"|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}", "Shift_JIS": r"|[\xa1-\xdf]"}.get(name, "")
    return Wide(name, bytes_of(first), bytes_of(second), worth.ravel(), sorted({w for *_, w in usual}), re.compile(rf"(?:[\x00-\x7f]|[{first}][{second}]{other})*+".encode()))


HIGH_BYTES, KANA, DIGITS, ASCII_LETTERS = bytes_of(r"\x80-\xff"), bytes_of(r"\xa1-\xdf"), bytes_of("0-9"), bytes_of("A-Za-z")


@functools.cache
def tables() -> tuple[list[Page], list[Wide], np.ndarray, np.ndarray]:
    """Code pages, encodings of several bytes, what each byte can be worth at best in each code page, and which pages need
    several different letters."""
    pages = [page_of(name) for name in CODE_PAGES]
    return pages, [wide_of(name) for name in WIDE], np.stack([page.most for page in pages]), np.array([page.name not in USUAL for page in pages])


def alternate(at: np.ndarray, step: int) -> np.ndarray:
    """Of places in order the first, third, … of each run in which they are ``step`` apart."""
    if not len(at):
        return at
    begun = np.concatenate(([0], np.flatnonzero(at[1:] - at[:-1] != step) + 1))
    return at[(np.arange(len(at)) - np.repeat(begun, np.diff(begun, append=len(at)))) & 1 == 0]


def codes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First and second byte of characters as one number."""
    return raw[at].astype(np.uint16) << 8 | raw[at + 1]


class Pairs:
    """Characters of two bytes, if the bytes of ``first`` can be first ones: one at the beginning of a run of them is, the next byte is
    second, and so on."""

    def __init__(self, raw: np.ndarray, first: np.ndarray) -> None:
        self.at = alternate(np.flatnonzero(first[raw]), 1)
        self.second = raw[self.at + 1]
        self.code, self.counts = np.unique(codes(raw, self.at), return_counts=True)
        self.ends = self.code & 0xFF

    def of_second(self, some: np.ndarray) -> int:
        """How many have such a second byte."""
        return int(self.counts @ some[self.ends])


class Reading:
    """The bytes of a text beyond ASCII with those beside them, and how likely they are in each encoding."""

    def __init__(self, data: bytes) -> None:
        self.raw = np.frombuffer(b"    " + data + b"    ", np.uint8)
        self.head = data[: data.find(b" ", 200) if b" " in data[200:] else None]
        self.high = self.raw >= 0x80
        self.at = np.flatnonzero(self.high)
        self.this, self.before, self.after = self.raw[self.at], self.raw[self.at - 1], self.raw[self.at + 1]
        self.every = np.bincount(self.this, minlength=256)
        self.c1 = bool(self.every[:0xA0].any())
        self.pairs: dict[bytes, Pairs] = {}

    def pairs_of(self, wide: Wide) -> Pairs:
        """Encodings whose first bytes are the same ones here share them."""
        key = (wide.first & (self.every > 0)).tobytes()
        if key not in self.pairs:
            self.pairs[key] = Pairs(self.raw, wide.first)
        return self.pairs[key]

    def wide(self, wide: Wide) -> int | None:
        """How likely the bytes are in an encoding of several bytes a character; None if it doesn't hold throughout."""
        if not wide.head.fullmatch(self.head):  # no character goes on behind a blank
            return None
        beyond, others, lost = len(self.at), 0, self.raw[:0].astype(np.uint16)
        if wide.name == "EUC-JP" and self.every[0x8E:0x90].any():  # 0x8e before one byte of half width, 0x8f before two of another table
            half, third = np.flatnonzero(self.raw == 0x8E), np.flatnonzero(self.raw == 0x8F)
            if not (KANA[self.raw[half + 1]].all() and wide.first[self.raw[third + 1]].all()):
                return None
            raw = self.raw.copy()
            raw[half] = raw[half + 1] = raw[third] = 0x20
            pairs = Pairs(raw, wide.first)
            others, beyond = len(half), beyond - 2 * len(half) - len(third)
            lost = codes(raw, third + 1)
        else:
            pairs = self.pairs_of(wide)
        if not wide.second[pairs.ends].all():
            return None
        beyond -= len(pairs.at) + pairs.of_second(HIGH_BYTES)
        if wide.name == "Shift_JIS":
            others = int(self.every @ KANA) - pairs.of_second(KANA) - int(pairs.counts @ KANA[pairs.code >> 8])
            beyond -= others
        elif wide.name == "Big5" and pairs.ends.min(initial=0x80) < 0x80:  # no letter stands behind a second byte of ASCII
            odd = pairs.at[(pairs.second < 0x80) & ASCII_LETTERS[self.raw[pairs.at + 2]]]
            lost = codes(self.raw, odd)
        elif wide.name == "GB18030" and pairs.ends.min(initial=0x80) < 0x40:  # characters of four bytes are two of these pairs
            halves = pairs.at[DIGITS[pairs.second]]
            if 2 * len(alternate(halves, 2)) != len(halves):
                return None
            others = -len(halves) // 2
        if beyond:
            return None
        worth, less = wide.worth[pairs.code], wide.worth[lost]
        usual = sum(w * (int(pairs.counts @ (worth == w)) - np.count_nonzero(less == w)) for w in wide.worths)
        return int(100 * usual / (len(pairs.at) + others + 4))

    @functools.cached_property
    def alone(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.stands(~(ASCII_LETTERS[self.before] | ASCII_LETTERS[self.after]))

    @functools.cached_property
    def apart(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, high = self.at, self.high
        return self.stands(~(high[at - 1] & high[at - 2] & high[at - 3]) & ~(high[at + 1] & high[at + 2] & high[at + 3]))

    def stands(self, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.this[ok], self.before[ok], self.after[ok], np.bincount(self.this[ok], minlength=256)

    def doubt(self) -> float:
        """What a page that needs several different letters is worth."""
        return 1 - 0.35 / (0.35 + np.count_nonzero(self.every))

    def lacking(self, page: Page) -> bool:
        """Whether a page has no characters for some bytes."""
        return self.c1 and page.name.startswith("ISO-")

    def page(self, page: Page) -> int:
        """How likely the bytes are in a code page."""
        byte, left, right, counts = self.apart if page.latin else self.alone
        worth = counts @ page.letters + page.capitals[byte] @ ~page.small[left] + (page.finals[byte] @ ~page.letter[right] if page.finals.any() else 0)
        worth += page.quotes[self.this] @ (~page.letter[self.before] | ~page.letter[self.after] | page.apostrophe[self.this]) if page.latin else self.every @ page.quotes
        if page.name not in USUAL:
            worth *= self.doubt()
        return round(100 * worth / max(1, len(self.at)))


def confidences(data: bytes) -> Iterator[tuple[str, int]]:
    """(encoding, confidence in hundredths), in the order in which equal ones are decided."""
    pages, wide, *_ = tables()
    reading = Reading(data)
    for w in wide:
        found = reading.wide(w)
        if found is not None:
            yield w.name, found
    for page in pages:
        if not reading.lacking(page):
            yield page.name, reading.page(page)


def likeliest(data: bytes) -> tuple[str, int] | None:
    """The first of the largest ``confidences``, if it is large enough. Code pages in which the bytes can't be worth as much,
    however they stand, aren't scored."""
    pages, wide, most, several = tables()
    reading = Reading(data)
    name, best, order = max(((w.name, c, len(pages)) for w in wide if (c := reading.wide(w)) is not None), key=lambda x: x[1], default=(None, -1, -1))
    bounds = 100 * (most @ reading.every) * np.where(several, reading.doubt(), 1) / max(1, len(reading.at)) + 1
    for k in np.argsort(-bounds).tolist():
        if bounds[k] < max(best, LEAST):
            break
        if not reading.lacking(pages[k]):
            score = (reading.page(pages[k]), len(pages) - 1 - k)
            if score > (best, order):
                name, (best, order) = pages[k].name, score
    return (name, best) if best >= LEAST else None


def detect_encoding(data: Column) -> Column:
    """(encoding, confidence): by mark, zero bytes, escapes or valid UTF-8 with full confidence, else the likeliest
    encoding if it is likely enough; null otherwise."""
    text = data.cast("string")
    switched = F.contains(data, F.unhex(F.lit("1B"))) & ~text.rlike(r"[^\x00-\x7f]")
    utf8 = reduce(lambda out, e: F.when(switched & text.rlike(e[1]), e[0]).otherwise(out), ESCAPES.items(), F.lit("UTF-8"))
    told = guess_encoding(data, utf8)

    def run(values: pa.Array) -> pa.Array:
        found = (None if x is None else likeliest(x) for x in values.to_pylist())
        return pa.array([x and {"encoding": x[0], "confidence": x[1]} for x in found], pa.struct([("encoding", pa.string()), ("confidence", pa.int32())]))

    best = F.arrow_udf(run, "encoding string, confidence int")(F.when(told.isNull(), data))
    return F.coalesce(best, F.when(told.isNotNull(), F.struct(told.alias("encoding"), F.lit(100).alias("confidence"))))


def to_text(data: Column, encoding: Column) -> Column:
    """Text of bytes in an encoding that ``detect_encoding`` tells; null for others. The UTF family is decoded in the JVM."""
    other = F.when(encoding.isin(*CODE_PAGES, *WIDE, *ESCAPES) & data.isNotNull(), F.struct(data.alias("data"), encoding.alias("encoding")))
    return F.coalesce(to_utf8(data, encoding), by_codec(other, "string", lambda x: x["data"].decode(x["encoding"], "replace")))


def to_bytes(text: Column, encoding: Column) -> Column:
    """Bytes of a text in an encoding of those; characters that it lacks become ``?``. Null for others."""
    other = F.when(encoding.isin(*CODE_PAGES, *WIDE, *ESCAPES) & text.isNotNull(), F.struct(text.alias("text"), encoding.alias("encoding")))
    out = by_codec(other, "binary", lambda x: x["text"].encode(x["encoding"], "replace"))
    for name in ("UTF-8", "UTF-16LE", "UTF-16BE"):
        out = F.when(encoding == name, encoded(text, name)).otherwise(out)
    return out
