"""Options of lexers and formatters: checked and typed before a plan is built."""

from __future__ import annotations

import re
from collections.abc import Mapping

from lexigrain.operators.languages import rule_set
from lexigrain.operators.lexing import RuleSet
from lexigrain.plans import catalog


class OptionError(ValueError):
    """An unknown option, or a value of the wrong type."""


DECLARED = {(kind, owner, name): (type_, default) for kind, owner, name, type_, default in catalog.fields(catalog.OPTIONS)}


def find(name: str, among: list[str], aliases: Mapping[str, str] | None = None) -> str:
    """A name without regard to case."""
    table = {n.upper(): n for n in among} | {a.upper(): n for a, n in (aliases or {}).items() if a.upper() not in {x.upper() for x in among}}
    try:
        return table[name.upper()]
    except KeyError:
        raise OptionError(f"no {name!r} among {', '.join(among)}") from None


def lexer_name(name: str) -> str:
    aliases = {alias: row[0] for row in reversed(catalog.fields(catalog.LEXERS)) for alias in row[1].split()}
    return find(name, catalog.LEXER_NAMES, aliases)


def value_of(text: str, type_: str) -> bool | int | str | RuleSet:
    """The value of an option's text. Booleans: empty, on and true, off and false, else a number that
    isn't 0; integers: the leading number, else 0."""
    number = int((re.match(r"\s*([+-]?\d+)", text) or [0, 0])[1])
    if type_ == "bool":
        low = text.lower()
        return low in ("", "on", "true") or (low not in ("off", "false") and number != 0)
    if type_ == "int":
        return number
    if type_ == "theme":
        return find(text, list(catalog.THEMES))
    if type_ == "lexer":
        return lexer_of(text)[1]
    return text


def checked(kind: str, owner: str, options: Mapping[str, object]) -> dict:
    """``options`` of a lexer or formatter with typed values; texts are parsed."""
    out = {}
    for name, value in options.items():
        if (kind, owner, name) not in DECLARED:
            raise OptionError(f"{owner} has no option {name!r}")
        type_, _ = DECLARED[kind, owner, name]
        if isinstance(value, str):
            if kind == "lexer" and type_ == "lexer" and lexer_name(re.split(r"\?", value)[0]) == owner:
                raise OptionError(f"{owner} can't be its own {name}")
            value = value_of(value, type_)
        elif not isinstance(value, {"bool": bool, "int": int, "lexer": RuleSet}.get(type_, str)) or (type_ == "int" and isinstance(value, bool)):
            raise OptionError(f"{name!r} of {owner} is a {type_}, not {value!r}")
        out[name] = value
    return out


def option(kind: str, owner: str, name: str) -> tuple[str, str]:
    """(type, default) of an option."""
    try:
        return DECLARED[kind, owner, name]
    except KeyError:
        raise OptionError(f"{owner} has no option {name!r}") from None


def lexer_of(spec: str) -> tuple[str, RuleSet, dict]:
    """Name, rule set and options of ``name?option=value;flag``, ``;`` or ``&`` between options."""
    name, _, rest = spec.partition("?")
    name = lexer_name(name)
    pairs = (part.partition("=") for part in re.split("[;&]", rest) if part)
    options = checked("lexer", name, {key: value for key, _, value in pairs})
    return name, rule_set(name, **options), options
