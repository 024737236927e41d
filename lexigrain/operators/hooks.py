"""Formatters whose hooks are Python methods.

A subclass of ``Hooks`` overrides the hooks that it needs; each returns a string, or None to write nothing. The tokens
of a row go to the workers as Arrow arrays, a batch of rows at a time, and a text comes back for each row; rows stay
where they are. Formatters that are maps by token type need no Python (``render.Formatter``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from lexigrain.operators.render import FORMATTERS, Formatter


class Hooks:
    """All hooks write nothing but the text itself. ``lexing`` hooks stand around the parts of embedded languages."""

    def start_document(self) -> str | None:
        return None

    def end_document(self) -> str | None:
        return None

    def start_token(self, type_: str) -> str | None:
        return None

    def end_token(self, type_: str) -> str | None:
        return None

    def write_token(self, text: str) -> str | None:
        return text

    def start_lexing(self, lexer: str) -> str | None:
        return None

    def end_lexing(self, lexer: str) -> str | None:
        return None

    def rendered(self, tokens: list[dict]) -> str:
        """The document of one row's tokens."""
        out, path = [self.start_document()], tokens[0]["path"][:1] if tokens else []
        for t in tokens:
            out += self.moved(path, t["path"])
            path = t["path"]
            out += [self.start_token(t["type"]), self.write_token(t["text"]), self.end_token(t["type"])]
        return "".join(x for x in [*out, *self.moved(path, path[:1]), self.end_document()] if x is not None)

    def moved(self, was: list[str], now: list[str]) -> Iterator[str | None]:
        """What leaves the languages of ``was`` and enters those of ``now``."""
        shared = 0
        while shared < min(len(was), len(now)) and was[shared] == now[shared]:
            shared += 1
        yield from (self.end_lexing(name) for name in reversed(was[shared:]))
        yield from (self.start_lexing(name) for name in now[shared:])


class BuiltIn(Hooks):
    """A built-in formatter with its options, to override single hooks of."""

    def __init__(self, name: str = "HTML", **options):
        made: Formatter = FORMATTERS[name](**options)
        self.head, self.tail, self.before, self.after = made.head, made.tail, made.before, made.after
        self.is_html = name == "HTML"
        if name == "RTF":
            raise ValueError("the escapes of RTF are column expressions")

    def start_document(self) -> str | None:
        return self.head

    def end_document(self) -> str | None:
        return self.tail

    def start_token(self, type_: str) -> str | None:
        return self.before.get(type_)

    def end_token(self, type_: str) -> str | None:
        return self.after.get(type_)

    def write_token(self, text: str) -> str | None:
        return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if self.is_html else text

    def start_lexing(self, lexer: str) -> str | None:
        return f'<SPAN class="{lexer}">' if self.is_html else None

    def end_lexing(self, lexer: str) -> str | None:
        return "</SPAN>" if self.is_html else None


def rendered_with(df: DataFrame, tokens_col: str = "tokens", **hooks: Hooks) -> DataFrame:
    """``df`` with the tokens replaced by the text that each of the named hooks makes of them; null tokens give null."""
    kept = [c for c in df.columns if c != tokens_col]
    fields = [df.schema[c] for c in kept] + [StructField(name, StringType()) for name in hooks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(tokens_col).to_pylist()
            made = [pa.array([None if ts is None else h.rendered(ts) for ts in rows], pa.string()) for h in hooks.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[f.name for f in fields])

    return df.select(*kept, tokens_col).mapInArrow(run, StructType(fields))
