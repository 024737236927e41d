"""Splitting text into typed tokens with column expressions only.

A rule set is an ordered list of patterns; at each place the first pattern that matches makes a token, and
what no pattern matches gets the set's default type, so the tokens always spell the text. One
``regexp_replace`` puts a mark behind each piece that tells which pattern made it; all that follows works on
the marked text: word lists change the marks of the words they hold, neighbours with one mark are joined, and
in the end one function call a token makes rows of it. A text is scanned a few times, in the JVM, without a
shuffle. A rule may hand its piece to another rule set (the escapes of a string, the styles and scripts of a
page); the nesting of rule sets is part of the plan and so has a fixed depth.

The expression of a rule set is made as SQL text, which is parsed in one go; columns made one by one would
cost a call to the JVM for each of some thousand parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks, the stop behind a piece, and the hole that stands for a template's tag in the text around it, are the
#: characters of one private use block. A text's own ones are moved to another block meanwhile.
FIRST, SIZE = 0xE000, 256
STOP, HOLE = chr(FIRST + SIZE - 2), chr(FIRST + SIZE - 1)
RESERVED = rf"[\x{{{FIRST:x}}}-\x{{{FIRST + SIZE - 1:x}}}]"
BLOCK = rf"\x{{{FIRST:x}}}-\x{{{FIRST + SIZE - 2:x}}}"
ANY, TEXT = rf"[\x{{{FIRST:x}}}-\x{{{FIRST + SIZE - 3:x}}}]", f"[^{BLOCK}]++"
#: A piece with the marks around it, of which its own stays, or marks without a piece; and the same for neighbours with one
#: mark, of which the last one's stays. These match piece after piece, so that no place is looked at twice.
SPARE = rf"{ANY}*+(?:({TEXT}{ANY}){ANY}*+({STOP})|{STOP})"
TWINS = rf"{ANY}*+(?:({TEXT})(?:({ANY}){ANY}*+{STOP}{ANY}*+(?={TEXT}\2)|({ANY}){ANY}*+({STOP}))|{STOP})"
TOKEN = "array<struct<lexer:string,depth:int,type:string,text:string,path:array<string>>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` makes a token of ``type``. ``words``: other types for listed spellings, without regard
    to case if ``fold``. ``inner``: the rule set that cuts the piece further; its default type is ``type``
    unless it has one of its own."""

    type: str
    pattern: str
    words: Mapping[str, frozenset[str]] = field(default_factory=dict)
    fold: bool = False
    inner: RuleSet | None = None


@dataclass(frozen=True)
class RuleSet:
    """``lexer``: the name that its tokens carry; a set without a name is part of the one that calls it.
    ``outer``: the rule set of what no rule matches, as one text: what the rules match are islands in it, and
    a string, tag or style of the outer language goes on behind an island as if it weren't there."""

    rules: tuple[Rule, ...]
    default: str = "IGNORABLE"
    lexer: str | None = None
    outer: RuleSet | None = None


def rule(type_: str, pattern: str, fold: bool = False, inner: RuleSet | list[Rule] | None = None, **words: str) -> Rule:
    """``words`` are given as strings, keyword argument names are types."""
    if isinstance(inner, list):
        inner = RuleSet(tuple(inner), type_)
    lists = {t: frozenset((w.lower() if fold else w) for w in text.split()) for t, text in words.items()}
    return Rule(type_, pattern, lists, fold, inner)


def rules(*parts: Rule, default: str = "IGNORABLE", lexer: str | None = None, outer: RuleSet | None = None) -> RuleSet:
    return RuleSet(tuple(parts), default, lexer, outer)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def literal(text: str) -> str:
    """A string in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def groups_in(pattern: str) -> int:
    """Capturing groups of a pattern."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def shifted(pattern: str, by: int) -> str:
    """The pattern with its references to its own groups moved behind ``by`` other groups."""
    return re.sub(r"\\([1-9][0-9]*)", lambda m: "\\" + str(int(m[1]) + by), pattern) if groups_in(pattern) else pattern


def either(*patterns: str) -> str:
    """One alternation of patterns that may have groups."""
    parts, at = [], 0
    for pattern in patterns:
        parts.append(shifted(pattern, at))
        at += groups_in(pattern)
    return "|".join(parts)


def one_of(words: Iterable[str]) -> str:
    """A pattern for whole words of a list, as a tree of their beginnings."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        by_first.setdefault(word[:1], []).append(word[1:])
    ends = "" in by_first
    by_first.pop("", None)
    parts = [re.escape(first) + one_of(rest) for first, rest in by_first.items()]
    return parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})" + "?" * ends if parts else ""


def bound(name: str, value: str, use: str) -> str:
    """SQL of ``use`` with ``value`` computed once and called ``name``."""
    return f"transform(array({value}), {name} -> {use})[0]"


def marked_sql(text: str, patterns: list[tuple[str, str]]) -> str:
    """SQL of a text with marks around each piece and a stop behind it, from (pattern, mark) in order; the
    last is for single characters that no pattern matches. Of the marks behind a piece the first is its own."""
    parts, kept, at = [], [], 1
    for pattern, mark in patterns:
        parts.append(f"({shifted(pattern, at)})")
        kept.append(f"${at}{mark}")
        at += 1 + groups_in(pattern)
    return f"regexp_replace({text}, {literal('|'.join(parts))}, {literal(''.join(kept) + STOP)})"


def without_sql(marked: str, *patterns: str) -> str:
    return f"regexp_replace({marked}, {literal('|'.join(patterns))}, '')"


def own_marks_sql(marked: str) -> str:
    """Pieces with their own marks only."""
    return f"regexp_replace({marked}, {literal(SPARE)}, {literal('$1$2')})"


def joined_sql(marked: str) -> str:
    """Pieces with their own marks only, neighbours with one mark as one piece."""
    return f"regexp_replace({marked}, {literal(TWINS)}, {literal('$1$3$4')})"


def split_sql(marked: str) -> str:
    """Pieces with their own marks."""
    return f"split(rtrim('{STOP}', {marked}), '{STOP}')"


def number_sql(piece: str) -> str:
    return f"(ascii(substr({piece}, -1)) - {FIRST})"


class Marks(dict):
    """A mark for each key, in the order in which they are asked for."""

    def __missing__(self, key: tuple) -> str:
        if len(self) == SIZE - 2:
            raise ValueError("the rule sets have too many kinds of tokens")
        self[key] = mark = chr(FIRST + len(self))
        return mark


def relabelled_sql(marked: str, listed: list[tuple[str, list[tuple[Iterable[str], bool, str]], str]], plain: Mapping[tuple[str, str], str]) -> str:
    """SQL of a marked text, with spare marks or not, in which the words of lists have the lists' marks, from (mark of the rule, lists
    of (words, fold, mark), mark of other pieces), and pieces without certain characters another mark, from
    (characters, mark): marks of the rules. Other pieces come first, as they are told by their marks."""
    owns = "".join([own for own, *_ in listed] + list(plain.values()))
    parts, kept, at = [f"({TEXT}(?![{owns}]){ANY})"], ["$1"], 2
    for (needles, mark), rules_ in plain.items():
        parts.append(f"([^{BLOCK}{needles}]++)[{rules_}]")
        kept.append(f"${at}{mark}")
        at += 1
    for own, tables, other in listed:
        for words, fold, mark in tables:
            parts.append(f"((?i:{one_of(words)})){own}" if fold else f"({one_of(words)}){own}")
            kept.append(f"${at}{mark}")
            at += 1
        parts.append(f"({TEXT}){own}")
        kept.append(f"${at}{other}")
        at += 1
    if plain:
        parts.append(f"({TEXT}{ANY})")
        kept.append(f"${at}")
    return f"regexp_replace({marked}, {literal(f'{ANY}*+(?:{"|".join(parts)}){ANY}*+{STOP}')}, {literal(''.join(kept) + STOP)})"


def first_of(pattern: str) -> str | None:
    """The character with which all matches of a pattern begin, if that is easily told."""
    m = re.match(r"\\\\|\\\$|[&%]", pattern)
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    while (shorter := re.sub(r"\([^()]*\)", "", bare)) != bare:
        bare = shorter
    return m[0] if m and "|" not in bare else None


def spliced_sql(text: str, rule_set: RuleSet, marks: Marks, path: tuple[str, ...], level: int) -> str:
    """SQL of the marked text of a rule set with islands: each becomes a hole, the outer rule set sees the rest
    as one text, its pieces are cut at the holes, and the islands' own pieces go there."""
    y, o, p, i = f"y{level}", f"o{level}", f"p{level}", f"i{level}"
    island = literal(either(*(r.pattern for r in rule_set.rules)))
    inside = f"transform(regexp_extract_all({y}, {island}, 0), {p} -> {tokens_sql(p, RuleSet(rule_set.rules, rule_set.default), marks, path, level + 1)})"
    around = tokens_sql(f"regexp_replace({y}, {island}, {literal(HOLE)})", rule_set.outer, marks, path, level + 1)
    cut_ = f"regexp_replace({around}, {literal(f'{HOLE}(?=[^{BLOCK}]*+({ANY}))')}, {literal(f'$1{STOP}{HOLE}')})"
    cut_ = without_sql(without_sql(cut_, f"(?<={HOLE}){ANY}++{STOP}"), f"(?<![^{STOP}{HOLE}]){ANY}++{STOP}?")
    joined = f"array_join(transform(split({o}, '{HOLE}', -1), (c, k) -> concat(c, coalesce(get({i}, k), ''))), '')"
    return bound(y, text, bound(o, cut_, bound(i, inside, joined)))


def tokens_sql(text: str, rule_set: RuleSet, marks: Marks, path: tuple[str, ...], level: int = 0) -> str:
    """SQL of the marked text of a rule set and those inside it; a mark stands for (path of lexers, type). At level 0 pieces
    may have spare marks around them."""
    path = (*path, rule_set.lexer) if rule_set.lexer and rule_set.lexer != path[-1] else path
    if rule_set.outer is not None:
        return spliced_sql(text, rule_set, marks, path, level)
    p, s = f"p{level}", f"s{level}"
    patterns, listed, inner = [], [], []
    for k, r in enumerate(rule_set.rules):
        mark = marks[path, r.type]
        if r.inner is not None or any(r.words.values()):
            own = marks["rule", path, level, k, id(r)]
            if r.inner is not None:
                inner.append((own, r))
            else:  # the last list that has a word wins
                listed.append((own, [(words, r.fold, marks[path, t]) for t, words in reversed(r.words.items()) if words], mark))
            mark = own
        if patterns and patterns[-1][1] == mark and not groups_in(r.pattern):
            patterns[-1] = (f"{patterns[-1][0]}|{r.pattern}", mark)
        else:
            patterns.append((r.pattern, mark))
    out = marked_sql(text, [*patterns, (r"(?s:.)", marks[path, rule_set.default])])
    plain: dict[tuple[str, str], str] = {}  # pieces in which no inner rule can match
    for own, r in inner:
        needles = {first_of(i.pattern) for i in r.inner.rules}
        if None not in needles and not r.inner.lexer and r.inner.outer is None:
            key = ("".join(sorted(needles)), marks[path, r.inner.default])
            plain[key] = plain.get(key, "") + own
    if listed or plain:
        out = relabelled_sql(out, listed, plain)
    if not inner:
        return joined_sql(out) if level else out
    some = f"[{''.join(own for own, _ in inner)}]"
    cases = "".join(f" when {literal(own)} then {tokens_sql(f'substr({p}, 1, length({p}) - 2)', r.inner, marks, path, level + 1)}" for own, r in inner)
    parts = f"regexp_extract_all({s}, {literal(f'{TEXT}{some}{STOP}|(?:{TEXT}(?!{some}){ANY}{STOP})++')}, 0)"
    whole = f"array_join(transform({parts}, {p} -> case substr({p}, -2, 1){cases} else {p} end), '')"
    return bound(s, own_marks_sql(out), f"if({s} rlike {literal(some)}, {whole}, {s})")


def cut(text: Column, patterns: list[str]) -> Column:
    """Array of (number of the pattern, piece); the last number is for what none matches."""
    numbered = [(pattern, chr(FIRST + k)) for k, pattern in enumerate([*patterns, r"(?s:.)"])]
    pieces = pieces_of(text, lambda y: own_marks_sql(marked_sql(y, numbered)), numbered[-1][1])
    return F.call_function("transform", pieces, F.expr(f"p -> named_struct('n', {number_sql('p')}, 'text', {bare_sql('p')})"))


def pieces_of(text: Column, marked: Callable[[str], str], whole: str) -> Column:
    """The pieces of a text, each with its mark behind it, from SQL of the marked text; null of null, none of an empty text.
    Where the text has characters of the marks' block, these are moved to a private use block of planes 15 and 16 that the
    text doesn't touch, and back in the pieces; if there is no such block, the text is one piece with the mark ``whole``.
    What is computed once and named is copied each time, so these are strings and not yet structs."""
    high = literal(r"[^\x{f0000}-\x{10ffff}]+")
    taken = f"transform(split(regexp_replace(x, {high}, ''), ''), c -> substr(hex(encode(c, 'UTF-32')), -6, 4))"
    free = f"array_except(transform(sequence({0xF00}, {0x10FF}), b -> lpad(hex(b), 4, '0')), {taken})"
    block = lambda code: f"array_join(transform(sequence(0, {SIZE - 1}), i -> decode(unhex({code}), 'UTF-32')), '')"
    far = block("concat('00', free[0], lpad(hex(i), 2, '0'))")
    near = block(f"lpad(hex(i + {FIRST}), 8, '0')")
    moved = f"case when x rlike {literal(RESERVED)} then {bound('free', free, f"named_struct('near', {near}, 'far', if(size(free) = 0, '', {far}))")} end"
    pieces = split_sql(marked("if(v is null, x, translate(x, v.near, v.far))"))
    back = f"if(v is null, w, transform(w, p -> concat(translate({bare_sql('p')}, v.far, v.near), substr(p, -1))))"
    use = f"case when x is null then null when x = '' then cast(array() as array<string>) when v.far = '' then array(concat(x, {literal(whole)})) else {bound('w', pieces, back)} end"
    return F.call_function("transform", F.array(text), F.expr(f"x -> {bound('v', moved, use)}"))[0]


def bare_sql(piece: str) -> str:
    """The text of a piece without its mark."""
    return f"substr({piece}, 1, length({piece}) - 1)"


def uppercased(tokens: Column) -> Column:
    """Keywords in upper case; the tokens then no longer spell the text."""
    return F.transform(tokens, lambda t: t.withField("text", F.when(t["type"].isin("KEYWORD", "KEYWORD_TYPE"), F.upper(t["text"])).otherwise(t["text"])))


def lex_sql(rule_set: RuleSet, lexer: str) -> tuple[Callable[[str], str], str, str]:
    """From SQL of a text that of its marked text, the mark of a text that is one ERROR token, and a function of a piece, as
    SQL, that gives its token."""
    with_shebang = RuleSet((rule("IGNORABLE", "\\A#![^\r\n]*[\r\n]"), *rule_set.rules), rule_set.default, rule_set.lexer, rule_set.outer)
    marks = Marks()
    joined = joined_sql(tokens_sql("{text}", with_shebang, marks, (lexer,)))
    whole = marks[(lexer,), "ERROR"]
    kinds = [None if k[0] == "rule" else k for k in marks]
    paths = {k[0]: f"array({', '.join(map(literal, k[0]))})" for k in kinds if k}

    def column(value: Callable[[tuple], str], missing: str) -> str:
        values = [value(k) if k else missing for k in kinds]
        told = {v for v, k in zip(values, kinds, strict=True) if k}
        return told.pop() if len(told) == 1 else f"array({', '.join(values)})[{number_sql('p')}]"

    columns = {"lexer": column(lambda k: literal(k[0][-1]), "''"), "depth": column(lambda k: str(len(k[0]) - 1), "0"), "type": column(lambda k: literal(k[1]), "''"), "text": bare_sql("p"), "path": column(lambda k: paths[k[0]], f"array({literal(lexer)})")}
    token = f"named_struct({', '.join(f'{literal(name)}, {value}' for name, value in columns.items())})"
    return lambda text: joined.replace("{text}", text), whole, f"p -> {token}"


def lex(text: Column, rule_set: RuleSet, lexer: str) -> Column:
    """The tokens of ``text``: one leading byte order mark is left out, a first line that begins with
    ``#!`` is one IGNORABLE token, neighbours of one type are joined. Null gives null, an empty text no
    tokens; a text with characters of all 512 private use blocks of planes 15 and 16, and of the first block
    of plane 0, is one ERROR token."""
    bare = F.when(text.startswith("\ufeff"), F.substr(text, F.lit(2))).otherwise(text)
    marked, whole, token = lex_sql(rule_set, lexer)
    return F.call_function("transform", pieces_of(bare, marked, whole), F.expr(token))
