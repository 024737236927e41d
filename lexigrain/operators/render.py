"""Tokens to text: markup, terminal colours, forum code, rich text, plain lines, and the themes' styles.

A formatter is a map of what goes before and after a token by its type; both maps are literals of the
plan, so rendering is one pass over a row's tokens and moves nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.operators.lexing import let
from lexigrain.plans import catalog

DEFAULT_THEME = "Molokai"


@dataclass(frozen=True)
class Style:
    fg: str | None = None
    bg: str | None = None
    bold: bool = False
    italic: bool = False
    underline: bool = False


Theme = Mapping[str, Style]


def theme(name: str | None = None) -> dict[str, Style]:
    """The styles of a theme by token type, in id order."""
    wanted = (name or DEFAULT_THEME).upper()
    return {type_: Style(*style) for owner, type_, *style in catalog.style_rows() if owner.upper() == wanted}


def rgb(colour: str) -> tuple[int, int, int]:
    return tuple(bytes.fromhex(colour[1:]))


steps256 = catalog.palette


def nearest256(colour: str) -> int:
    """The first palette entry with the least squared distance."""
    own = rgb(colour)
    return min(enumerate(catalog.palette()), key=lambda e: sum((a - b) ** 2 for a, b in zip(own, e[1], strict=True)))[0]


def nearest_palette(colours: DataFrame, palette: DataFrame | None = None) -> DataFrame:
    """(r, g, b, idx) for each different colour of a table. The palette, of 256 entries at most, is an array in the
    plan, so a colour is looked up where it is."""
    rows = enumerate(catalog.palette()) if palette is None else [(e.idx, (e.r, e.g, e.b)) for e in palette.limit(257).collect()]
    if palette is not None and len(rows) > 256:
        raise ValueError("a palette has 256 entries at most")
    entries = F.expr("array(" + ", ".join(f"named_struct('idx', {k}, 'r', {r}, 'g', {g}, 'b', {b})" for k, (r, g, b) in rows) + ")")
    distance = lambda e: sum(((F.col(c) - e[c]) * (F.col(c) - e[c]) for c in "rgb"), F.lit(0))
    nearest = F.array_min(F.transform(entries, lambda e: F.struct(distance(e), e["idx"].alias("idx"))))
    return colours.select("r", "g", "b").distinct().select("r", "g", "b", nearest["idx"].alias("idx"))


def parse_colour(text: Column) -> Column:
    """``#RGB`` or ``#RRGGBB`` as (r, g, b); null for any other shape."""
    short = F.regexp_replace(text, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")
    part = lambda at: F.conv(F.substring(short, at, 2), 16, 10).cast("int")
    return F.when(text.rlike("^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def css(styles: DataFrame, types: DataFrame, scope: str | None = None, indent: str = "") -> DataFrame:
    """(theme, css): one block for each style, with the classes of all types that have it, in the order in
    which a theme's styles come first."""
    prefix = f"{scope} ." if scope else "."
    rows = styles.join(F.broadcast(types), styles["type"] == types["name"]).where("cssclass <> ' ' and (fg is not null or bg is not null or bold or italic or underline)")
    look = ["fg", "bg", "bold", "italic", "underline"]
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "cssclass"))), lambda x: F.concat(F.lit(prefix), x["cssclass"])), ", ")
    groups = rows.groupBy("theme", *look).agg(F.min("id").alias("first"), names.alias("names"))
    line = lambda on, text: F.when(on, F.concat(F.lit(indent + "  "), text, F.lit(";\n"))).otherwise("")
    body = F.concat(
        line(F.col("bg").isNotNull(), F.concat(F.lit("background-color: "), "bg")),
        line(F.col("fg").isNotNull(), F.concat(F.lit("color: "), "fg")),
        line(F.col("bold"), F.lit("font-weight: bold")),
        line(F.col("italic"), F.lit("font-style: italic")),
        line(F.col("underline"), F.lit("text-decoration: underline")),
    )
    block = F.concat(F.col("names"), F.lit(" {\n"), body, F.lit("}\n"))
    blocks = groups.select("theme", "first", block.alias("block"))
    return blocks.groupBy("theme").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "block"))), lambda x: x["block"]), "").alias("css"))


def css_text(styles: Theme, scope: str | None = None) -> str:
    """The same for one theme in hand, for a page's head."""
    groups: dict[Style, list[str]] = {}
    for type_ in catalog.TYPE_IDS:
        if type_ in styles and catalog.CLASSES[type_] != " ":
            groups.setdefault(styles[type_], []).append((f"{scope} " if scope else "") + "." + catalog.CLASSES[type_])
    return "".join(", ".join(names) + " {\n" + "".join(f"  {x};\n" for x in css_lines(style)) + "}\n" for style, names in groups.items())


def css_lines(s: Style) -> list[str]:
    return [text for on, text in ((s.bg, f"background-color: {s.bg}"), (s.fg, f"color: {s.fg}"), (s.bold, "font-weight: bold"), (s.italic, "font-style: italic"), (s.underline, "text-decoration: underline")) if on]


def xml_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def dumped(text: Column) -> Column:
    """Line feed, tab and return as escapes, each byte of other control and non-ASCII characters as ``0xNN``."""
    out = F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    odd = r"[\x00-\x1f\x7f-\x{10ffff}]"
    one = lambda part: F.when(part.rlike("^" + odd), F.regexp_replace(F.lower(F.hex(F.encode(part, "UTF-8"))), "(..)", "0x$1")).otherwise(part)
    parts = F.regexp_extract_all(out, F.lit(rf"(?s){odd}+|[^\x00-\x1f\x7f-\x{{10ffff}}]+"), F.lit(0))
    return F.when(out.rlike(odd), F.array_join(F.transform(parts, one), "")).otherwise(out)


@dataclass
class Formatter:
    """Hooks of a formatter. A user's formatter overrides those it needs, or gives column functions for
    ``written``; ``before`` and ``after`` are by token type."""

    head: str = ""
    tail: str = ""
    before: dict[str, str] = field(default_factory=dict)
    after: dict[str, str] = field(default_factory=dict)
    written: Callable[[Column], Column] = staticmethod(lambda text: text)
    enter: Callable[[Column], Column] | None = None
    leave: Callable[[Column], Column] | None = None

    def moved(self, was: Column, now: Column) -> Column:
        """What stands between two paths of lexers: all levels below their common beginning are left, then the
        new ones are entered. The first level has no mark."""
        levels = F.sequence(F.lit(1), F.least(F.size(was), F.size(now)))
        shared = F.array_max(F.filter(levels, lambda n: F.slice(was, F.lit(1), n) == F.slice(now, F.lit(1), n)))
        between = lambda n: F.concat(F.array_join(F.transform(F.reverse(F.slice(was, n + 1, F.size(was) - n)), self.leave), ""), F.array_join(F.transform(F.slice(now, n + 1, F.size(now) - n), self.enter), ""))
        return let(F.coalesce(shared, F.lit(1)), between)

    def render(self, tokens: Column) -> Column:
        """One string for each row; null tokens give null."""

        def by_type(table: Mapping[str, str], type_: Column) -> Column:
            if not any(table.values()):
                return F.lit("")
            entries = [F.lit(x) for pair in table.items() for x in pair]
            return F.coalesce(F.create_map(*entries)[type_], F.lit(""))

        def one(t: Column, k: Column, all_: Column) -> Column:
            body = F.concat(by_type(self.before, t["type"]), self.written(t["text"]), by_type(self.after, t["type"]))
            if self.enter is None:
                return body
            was = F.coalesce(F.get(all_, k - 1)["path"], F.slice(t["path"], 1, 1))
            return F.concat(F.when(was == t["path"], "").otherwise(self.moved(was, t["path"])), body)

        def close(all_: Column) -> Column:
            last = F.try_element_at(all_, F.lit(-1))["path"]
            return F.coalesce(self.moved(last, F.slice(last, 1, 1)), F.lit("")) if self.enter is not None else F.lit("")

        whole = lambda ts: F.concat(F.lit(self.head), F.array_join(F.transform(ts, lambda t, k: one(t, k, ts)), ""), close(ts), F.lit(self.tail))
        return let(tokens, lambda ts: F.when(ts.isNotNull(), whole(ts)))


def html(theme_name: str | None = None, full: int = 0, title: str = "", nowrap: bool = False, noclasses: bool = False, cssclass: str = "", linestart: int = 1, styles: Theme | None = None) -> Formatter:
    """Spans with classes (or styles, if ``noclasses``) in a ``pre``; ``full`` 4 or 5 makes a page. Parts
    of another lexer stand in a SPAN with its name. ``linestart`` has no effect."""
    styles = theme(theme_name) if styles is None else styles
    kinds = [t for t in catalog.TYPE_IDS if t != "IGNORABLE"]
    if noclasses:
        inline = lambda s: "".join(f"{x};" for x in sorted(css_lines(s), key=lambda x: ("font-weight", "font-style", "text-decoration", "color", "background-color").index(x.split(":")[0])))
        before = {t: f'<span style="{inline(styles[t])}">' for t in kinds if t in styles}
    else:
        before = {t: f'<span class="{catalog.CLASSES[t][:2].strip() or " "}">' for t in kinds}
    head = tail = ""
    if full:
        doctype = "<!DOCTYPE html>" if full == 5 else '<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://www.w3.org/TR/html4/strict.dtd">'
        charset = '<meta charset="utf-8">' if full == 5 else '<meta http-equiv="content-type" content="text/html; charset=utf-8">'
        safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        sheet = "" if noclasses else css_text(styles)
        head = f'{doctype}\n<html>\n  <head>\n    <title>{safe}</title>\n    {charset}\n    <style type="text/css">{sheet}\n    </style>\n  </head>\n  <body>\n    '
        tail = "\n  </body>\n</html>"
    if not nowrap:
        head += f'<pre class="{cssclass}">' if cssclass else "<pre>"
        tail = "</pre>" + tail
    return Formatter(head, tail, before, {t: "</span>" for t in before}, xml_escaped, lambda name: F.concat(F.lit('<SPAN class="'), name, F.lit('">')), lambda name: F.lit("</SPAN>"))


def terminal(theme_name: str | None = None, mode256: bool = False, styles: Theme | None = None) -> Formatter:
    """ANSI sequences, in 24-bit colours or the nearest of 256."""
    before = {}
    for type_, s in (theme(theme_name) if styles is None else styles).items():
        colour = (lambda c: f"5;{nearest256(c)}") if mode256 else (lambda c: "2;" + ";".join(map(str, rgb(c))))
        codes = [code for on, code in ((s.bold, "1"), (s.italic, "3"), (s.underline, "4")) if on]
        codes += [f"{layer};{colour(c)}" for layer, c in (("38", s.fg), ("48", s.bg)) if c]
        before[type_] = "\x1b[" + ";".join(codes) + "m"
    return Formatter(before=before, after={t: "\x1b[39;49;00m" for t in before})


def bbcode(theme_name: str | None = None, codetag: bool = False, monofont: bool = False, styles: Theme | None = None) -> Formatter:
    """Forum code; a colour's parts are hexadecimal without leading zeros."""
    before, after = {}, {}
    for type_, s in (theme(theme_name) if styles is None else styles).items():
        tags = [t for on, t in ((s.bold, "b"), (s.italic, "i"), (s.underline, "u")) if on]
        colour = "[color=#" + "".join(f"{x:x}" for x in rgb(s.fg)) + "]" if s.fg else ""
        if tags or colour:
            before[type_] = "".join(f"[{t}]" for t in tags) + colour
            after[type_] = ("[/color]" if colour else "") + "".join(f"[/{t}]" for t in reversed(tags))
    return Formatter("[code]" * codetag + "[font=monospace]" * monofont, "[/font]" * monofont + "[/code]" * codetag, before, after)


def rtf(theme_name: str | None = None, styles: Theme | None = None) -> Formatter:
    """Rich text with a table of colours in the order in which the types first use them; its closing brace
    is written and braces and backslashes of the text are escaped, so that readers accept it."""
    styles = theme(theme_name) if styles is None else styles
    numbers: dict[str, int] = {}
    before = {}
    for type_ in catalog.TYPE_IDS:
        if s := styles.get(type_):
            for c in (s.fg, s.bg):
                if c:
                    numbers.setdefault(c, len(numbers) + 1)
            before[type_] = "{" + "\\b" * s.bold + "\\i" * s.italic + (f"\\cb{numbers[s.bg]}" if s.bg else "") + (f"\\cf{numbers[s.fg]}" if s.fg else "") + " "
    table = "".join("\\red{}\\green{}\\blue{};".format(*rgb(c)) for c in numbers)
    escaped = lambda text: F.regexp_replace(F.regexp_replace(text, r"[\\{}]", r"\\$0"), "\r\n|[\r\n]", r"\\par ")
    return Formatter("{\\rtf1\\ansi\\uc0\\deff0{\\fonttbl{\\f0\\fmodern\\fprq1\\fcharset0;}}{\\colortbl;" + table + "}\\f0 ", "}", before, {t: "}" for t in before}, escaped)


def plain(tokens: Column) -> Column:
    """A line ``TYPE: text`` for each token, control characters as escapes, without the last line end."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["type"], F.lit(": "), dumped(t["text"]))), "\n")


FORMATTERS: dict[str, Callable[..., Formatter]] = {"BBCode": bbcode, "HTML": html, "RTF": rtf, "Terminal": terminal}


def render(tokens: Column, formatter: str | Formatter, **options) -> Column:
    """``formatter`` is a name or a formatter of the user's."""
    if isinstance(formatter, Formatter):
        return formatter.render(tokens)
    if formatter.upper() == "PLAIN":
        return plain(tokens)
    name = next(n for n in FORMATTERS if n.upper() == formatter.upper())
    return FORMATTERS[name](**options).render(tokens)


def user_theme(spark: SparkSession, name: str, styles: Theme) -> DataFrame:
    """A theme of the user's as rows of ``theme_styles``."""
    rows = [(name, t, s.fg, s.bg, s.bold, s.italic, s.underline) for t, s in styles.items()]
    return spark.createDataFrame(rows, catalog.theme_styles(spark).schema)
