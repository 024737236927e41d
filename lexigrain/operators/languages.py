"""The rule sets of the languages.

A construct that runs over lines (strings, comments, embedded code) is one pattern; its inside is cut by
an inner rule set. Patterns are Java regular expressions whose groups repeat possessively (a loop in the
matcher, without a stack) or not at all, so they scan texts of any length in linear time and constant stack. Word lists that are longer than a page stand in
``plans.word_lists``; ``rule_set(name, words={...})`` adds to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from lexigrain.operators.lexing import Rule, RuleSet, either, rule, rules
from lexigrain.plans import word_lists as lists
from lexigrain.plans.catalog import LEXER_NAMES

LINE = r"[^\r\n]*(?:\r\n|[\r\n])?"
REST_OF_LINE = r"[^\r\n]*"


def until(close: str, escapes: bool = True) -> str:
    """The rest of a construct up to ``close``; a backslash before it keeps it open; without it, to the
    end of the text."""
    before = r"(?<!\\)(?:\\\\)*+" if escapes else ""
    return rf"(?s:.*?)(?:{before}{close}|\z)"


def quoted(quote: str, escapes: bool = True) -> str:
    return quote + until(quote, escapes)


def doubled(quote: str) -> str:
    """A string in which the quote is written twice."""
    return rf"{quote}[^{quote}]*+(?:{quote}|\z)(?:{quote}[^{quote}]*+(?:{quote}|\z))*+"


C_COMMENT = r"/\*" + until(r"\*/", escapes=False)
SPACE = rule("IGNORABLE", r"\s+")


def escape(pattern: str) -> list[Rule]:
    return [rule("SEQUENCE_ESCAPED", pattern)]


def body(code: RuleSet, close: str, line: str = "") -> str:
    """What stands before ``close`` in embedded code: its strings and comments as their own rules tell them, so
    that a ``close`` inside them doesn't end it. ``line`` begins a comment that ends with the line or at ``close``."""
    whole = [r.pattern for r in code.rules if r.type.startswith("STRING") or r.type in ("COMMENT_MULTILINE", "COMMENT_DOCUMENTATION")]
    lines = [rf"(?:{line})(?:(?!{close})[^\r\n])*+"] if line else []
    return rf"(?:{either(r'[\w\s]++', *lines, *whole)}|(?!{close})(?s:.))*+"


def tagged(open_: str, code: RuleSet, close: str, inner: RuleSet, line: str = "", type_: str = "NAME_TAG") -> list[Rule]:
    """Rules for embedded code in tags: closed, and open to the end of the text. ``inner`` cuts the code."""
    between = body(code, close, line)
    first, last = rule(type_, rf"\A(?:{open_})"), rule(type_, rf"(?:{close})\z")
    cut = lambda *ends: RuleSet((*ends, Rule(inner.default, rf"(?s).+?(?=(?:{close})\z)|(?s).+" if last in ends else "(?s).+", inner=inner)), type_)
    return [rule(type_, f"(?:{open_}){between}(?:{close})", inner=cut(first, last)), rule(type_, f"(?:{open_}){between}", inner=cut(first))]


def named(keyword: str, name: str, *rest: Rule) -> Rule:
    """A keyword and the name after it, however much white space is between them; ``rest`` are the rules of
    what follows the keyword."""
    return rule("KEYWORD", rf"(?<!->|::|\$)\b{keyword}\s++{name}", inner=RuleSet((rule("KEYWORD", rf"\A{keyword}\b"), SPACE, *rest), "IGNORABLE"))


def extended(words: Mapping[str, Iterable[str]], fold: bool = False, **tables: str) -> list[str]:
    """The tables with the words given for them; a given word leaves the other tables."""
    spell = str.lower if fold else str
    given = {k: {spell(w) for w in words.get(k, ())} for k in tables}
    taken = set().union(*given.values())
    return [" ".join([*(w for w in table.split() if w not in taken), *sorted(given[k])]) for k, table in tables.items()]


HEX = "[0-9a-fA-F]"


def c() -> RuleSet:
    escapes = escape(rf"\\(?:[0-7]{{1,3}}|x{HEX}+|u{HEX}{{4}}|U{HEX}{{8}}|(?s:.))")
    return rules(
        rule("COMMENT_SINGLE", r"(?m:^)[ \t]*#(?:[^\r\n\\]++|\\\r\n|\\(?s:.))*+(?:\r\n|[\r\n])?"),
        rule("IGNORABLE", r"[ \t\f\x0b]+|[\r\n]+"),
        rule("COMMENT_SINGLE", "//" + LINE),
        rule("COMMENT_MULTILINE", C_COMMENT),
        rule("STRING_SINGLE", "L?" + quoted("'"), inner=escapes),
        rule("STRING_DOUBLE", 'L?' + quoted('"'), inner=escapes),
        rule("NUMBER_HEXADECIMAL", rf"0[xX]{HEX}+[uUlL]*"),
        rule("NUMBER_FLOAT", r"[0-9]+[eE][+-]?[0-9]+[fFlL]?|[0-9]*\.[0-9]+(?:[eE][+-]?[0-9]+)?[fFlL]?|[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?[fFlL]?"),
        rule("NUMBER_OCTAL", "0[0-9]+[uUlL]*"),
        rule("NUMBER_DECIMAL", "[0-9]+[uUlL]*"),
        # Keywords and the builtin name.
        rule("IGNORABLE", "[a-zA-Z_][a-zA-Z_0-9]*", NAME_BUILTIN="NULL", KEYWORD="break case continue default do else extern if for goto return sizeof static switch typedef while auto register volatile char double enum float int long short struct union void const signed unsigned"),
        rule("OPERATOR", r"\.\.\.|>>=?|<<=?|[!=<>|&~^*/%-]=|--|\+\+|->|[?:=&|!~^%<>*/+-]"),
        rule("PUNCTUATION", r"[\[\]{}(),;.]"),
        lexer="C",
    )


def go() -> RuleSet:
    number = r"(?:[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+|\.[0-9]+(?:[eE][+-]?[0-9]+)?)"
    return rules(
        SPACE,
        rule("COMMENT_SINGLE", "//[^\n]*"),
        rule("COMMENT_MULTILINE", C_COMMENT),
        rule("STRING_SINGLE", quoted("`", escapes=False)),
        rule("STRING_SINGLE", quoted("'")),
        rule("STRING_SINGLE", quoted('"')),
        rule("NUMBER_IMAGINARY", rf"(?:{number}|[0-9]+)i"),
        rule("NUMBER_FLOAT", number),
        rule("NUMBER_HEXADECIMAL", rf"0[xX]{HEX}+"),
        rule("NUMBER_OCTAL", "0[0-7]*"),
        rule("NUMBER_DECIMAL", "[1-9][0-9]*"),
        # Keywords, types and constants.
        rule("NAME", "[a-zA-Z_][a-zA-Z_0-9]*", KEYWORD="break default func select case defer go else goto package switch const fallthrough if range type continue for import return var", KEYWORD_TYPE="struct interface map chan bool byte rune int int8 int16 int32 int64 intptr uint uint8 uint16 uint32 uint64 uintptr error float32 float64 complex64 complex128 string", KEYWORD_CONSTANT="true false iota nil"),
        rule("OPERATOR", r"<-|&\^=?|[-+|&]{2}|[<>]{1,2}=?|[-+/*^%!=|:&]=?|[(){}\[\].,;]"),
        lexer="Go",
    )


def python(intended: bool = False) -> RuleSet:
    """``intended``: with the floating point numbers that the language's scanner defines but never tells."""
    floats = [rule("NUMBER_FLOAT", r"(?:[0-9]*\.[0-9]+|[0-9]+\.?)[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+\.")] if intended else []
    escapes = escape(rf"\\(?:['\"abfnrtv\\]|[0-7]{{1,3}}|o[0-7]{{1,3}}|x{HEX}{{2}}|N\{{[^}}]*\}}|u{HEX}{{4}}|U{HEX}{{8}})")
    short = lambda q: rf"{q}(?:[^{q}\\\n]++|\\(?s:.))*+{q}?"
    plain, raw = "(?:[bB]|[uU])?", "(?:[rR][bB]?|[bB][rR])"
    strings = []
    for prefix, type_, inner in ((raw, "STRING_DOUBLE", None), (plain, "STRING_SINGLE", escapes)):
        for q in ("'''", '"""'):
            strings.append(rule(type_, prefix + quoted(q), inner=inner))
        for q in ("'", '"'):
            strings.append(rule(type_, prefix + short(q), inner=inner))
    return rules(
        SPACE,
        rule("COMMENT_SINGLE", "#" + LINE),
        *strings,
        rule("NUMBER_IMAGINARY", r"(?:[0-9]*\.[0-9]+|[0-9]+\.?)(?:[eE][+-]?[0-9]+)?[jJ]"),
        *floats,
        rule("NUMBER_HEXADECIMAL", rf"0[xX]{HEX}+"),
        rule("NUMBER_OCTAL", "0[oO][0-7]+"),
        rule("NUMBER_BINARY", "0[bB][01]+"),
        rule("NUMBER_DECIMAL", "[1-9][0-9]*|0+"),
        # Constants, word operators and keywords.
        rule("NAME_VARIABLE", "[a-zA-Z_][a-zA-Z_0-9]*", KEYWORD_CONSTANT="False True None", OPERATOR="is in or and not", KEYWORD="finally try except raise for while elif if else return continue pass break class lambda def from nonlocal del global with as yield assert import"),
        rule("OPERATOR", r"[<>!=]=|[*<>/]{1,2}|[-+@%&|^~]"),
        rule("PUNCTUATION", r"[.,:;{}()\[\]]"),
        lexer="Python",
    )


def javascript(intended: bool = False) -> RuleSet:
    """``intended``: with the numbers, punctuation and regular expressions that the language's scanner
    defines but never tells; without, these are IGNORABLE and slashes OPERATOR."""
    more = [
        rule("NUMBER_HEXADECIMAL", rf"0[xX]{HEX}+"),
        rule("NUMBER_FLOAT", r"(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+"),
        rule("NUMBER_DECIMAL", "[0-9]+"),
        rule("STRING_REGEX", r"(?:(?<=[(,=:\[!&|?{};])|(?<=[(,=:\[!&|?{};] )|(?<=\breturn )|\A)/(?![/*])(?:[^/\\\[\r\n]++|\\.|\[(?:[^\]\\\r\n]++|\\.)*+\]?)++/[a-z]*", inner=escape(r"\\.")),
        rule("PUNCTUATION", r"[{}()\[\].;,]"),
    ] if intended else []
    escapes = escape(rf"\\(?:[\\'\"bfnrtv]|x{HEX}{{2}}|u{HEX}{{4}})")
    return rules(
        SPACE,
        rule("COMMENT_SINGLE", "//[^\r\n\u2028\u2029]*"),
        rule("COMMENT_MULTILINE", C_COMMENT),
        rule("STRING_DOUBLE", quoted("'"), inner=escapes),
        rule("STRING_DOUBLE", quoted('"'), inner=escapes),
        # Reserved words and constants.
        rule("NAME_VARIABLE", rf"(?:[$_a-zA-Z]|\\u{HEX}{{4}})(?:[$_a-zA-Z0-9]++|\\u{HEX}{{4}})*+", KEYWORD_CONSTANT="null true false", KEYWORD="break do instanceof typeof case else new var catch finally return void continue for switch while debugger function this with default if throw delete in try class enum extends super const export import implements let private public yield interface package protected static"),
        *more,
        rule("OPERATOR", r"[!=]==|>>>=?|[<>]{2}=?|[-+&|]{2}|[-+*/%&|^!<>=]=?|[~?:]"),
        lexer="Javascript",
    )


def json() -> RuleSet:
    lone = rf"\\u[dD][89a-fA-F]{HEX}{{2}}"
    inside = [
        rule("SEQUENCE_ESCAPED", rf"\\u[dD][89abAB]{HEX}{{2}}\\u[dD][c-fC-F]{HEX}{{2}}"),
        rule("ERROR", lone),
        rule("SEQUENCE_ESCAPED", r'\\(?:[\\"/bfnrt]|u[a-zA-Z0-9]{4})'),
    ]
    return rules(
        rule("KEYWORD_CONSTANT", "true|false|null"),
        rule("NUMBER_FLOAT", r"(?:[0-9]*\.[0-9]+|[0-9]+\.[0-9]*)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+"),
        rule("NUMBER_DECIMAL", "[0-9]+"),
        rule("STRING_DOUBLE", quoted('"'), inner=inside),
        rule("PUNCTUATION", r"[{}\[\],:]+"),
        SPACE,
        lexer="JSON",
    )


def lua() -> RuleSet:
    escapes = escape(rf"\\(?:[abfnrtv\\z0'\"]|x{HEX}{{2}}|[0-9]{{1,3}}|u\{{{HEX}+\}})")
    return rules(
        SPACE,
        rule("COMMENT_MULTILINE", r"--\[(=*)\[(?s:.*?)(?:\]\1\]|\z)"),
        rule("COMMENT_SINGLE", "--[^\n]*"),
        rule("STRING_SINGLE", r"\[(=*)\[(?s:.*?)(?:\]\1\]|\z)"),
        rule("STRING_DOUBLE", quoted('"'), inner=escapes),
        rule("STRING_DOUBLE", quoted("'"), inner=escapes),
        rule("NUMBER_HEXADECIMAL", rf"0[xX]{HEX}+(?:\.{HEX}+)?(?:[pP][+-]?[0-9]*)?"),
        rule("NUMBER_FLOAT", r"[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]*)?|[eE][+-]?[0-9]*)"),
        rule("NUMBER_DECIMAL", "[0-9]+"),
        # Constants, word operators and keywords.
        rule("NAME_VARIABLE", "[a-zA-Z_][a-zA-Z_0-9]*", KEYWORD_CONSTANT="false true nil", OPERATOR="and not or", KEYWORD="break do else elseif end for function goto if in local repeat return then until while"),
        rule("OPERATOR", r"[~<>]=|[=:<>/]{1,2}|\.{1,3}|[-+/*%^#&~|(){}\[\];,]"),
        lexer="Lua",
    )


def bash() -> RuleSet:
    variable = r"\$(?:[*@#?\-$!0_1-9]|[a-zA-Z_][a-zA-Z_0-9]*)"
    substitution = r"\$\([^)]*+\)?|`[^`]*+`?"
    for _ in range(64):  # substitutions in substitutions
        substitution = rf"\$\((?:[^)$`]++|\$(?!\()|{substitution})*+\)?|`[^`]*+`?"
    inside = [rule("STRING_DOUBLE", substitution), *escape(r'\\[$`"\\!]')]
    return rules(
        rule("STRING_DOUBLE", r"\$" + quoted("'"), inner=escape(rf"\\(?:[abeEfnrtv\\'\"]|[0-7]{{1,3}}|x{HEX}{{1,2}}|u{HEX}{{1,4}}|U{HEX}{{1,8}}|c.)")),
        rule("STRING_SINGLE", quoted("'", escapes=False)),
        rule("STRING_DOUBLE", rf'"(?:[^"\\$`]++|\\(?s:.)|\$(?!\()|{substitution})*+(?:"|\\?\z)', inner=inside),
        rule("COMMENT_SINGLE", r"(?<![^\s;|&(])#[^\n]*"),
        rule("NAME_VARIABLE", variable + r"|\$\{[^}\n]*\}"),
        rule("STRING_DOUBLE", substitution),
        rule("PUNCTUATION", r"[!{}\[\]](?![^\s;|&()<>])"),
        # Builtins and keywords.
        rule("STRING_SINGLE", r"(?:[^\s|&;()<>$#\"'`\\]++|\\(?s:.))++", NAME_BUILTIN=". : [ alias bg break builtin caller cd command compgen complete compopt continue declare dirs disown echo enable eval exec exit export fc fg getopts hash help history jobs kill let local logout mapfile popd printf pushd pwd read readarray readonly return set shift shopt source suspend test times trap type typeset ulimit umask unalias unset wait", KEYWORD="case do done elif else esac fi for function if in select then time until while"),
        rule("IGNORABLE", r"[\s|&;()<>]+"),
        lexer="Bash",
    )


def apache() -> RuleSet:
    variable = rule("SEQUENCE_INTERPOLATED", r"\$\{[^}\n]*\}", inner=RuleSet((rule("SEQUENCE_INTERPOLATED", r"\$\{|\}"),), "NAME_VARIABLE"))
    inside = lambda q: RuleSet((*escape(rf"\\[\\{q}]"), variable), "STRING_SINGLE")
    return rules(
        rule("COMMENT_SINGLE", r"(?m:^)[ \t]*#" + LINE),
        rule("NAME_TAG", r"(?m:^)[ \t]*<[^\s>]*>?|(?<=\S)>(?=[ \t]*(?:[\r\n]|\z))"),
        rule("KEYWORD_BUILTIN", r"(?m:^)[ \t]*+[^\s#<][^\s]*", inner=RuleSet((rule("IGNORABLE", "[ \t]+"),), "KEYWORD_BUILTIN")),
        rule("IGNORABLE", r"\\\r?\n|[ \t\r\f\x0b]+|\n"),
        rule("STRING_SINGLE", quoted('"'), inner=inside('"')),
        rule("STRING_SINGLE", quoted("'"), inner=inside("'")),
        variable,
        rule("NUMBER_DECIMAL", r"[0-9]+(?=[\s>])"),
        rule("STRING_SINGLE", r"(?:[^\s$>]++|>(?!\s|\z)|\$(?!\{))++"),
        lexer="Apache",
    )


def nginx(words: Mapping[str, Iterable[str]]) -> RuleSet:
    directives, variables = extended(words, directives=lists.NGINX_DIRECTIVES, variables=lists.NGINX_VARIABLES)
    prefixes = "|".join(p.removeprefix("$") for p in lists.NGINX_PREFIXES.split())
    return rules(
        rule("COMMENT_SINGLE", "#" + LINE),
        rule("IGNORABLE", r"(?:(?<=[;{}\n])\s*+|\A\s*+|(?=[^\S\n]*+\n)\s++)[^$#;{}\s'\"\\][^;{}\s]*", inner=RuleSet((SPACE, rule("TEXT", r"\S+", KEYWORD_BUILTIN=directives)), "IGNORABLE")),
        rule("IGNORABLE", r"\\\n|\s+"),
        rule("PUNCTUATION", "[;{}]"),
        rule("STRING_SINGLE", quoted('"'), inner=escape(r'\\[trn\\"]')),
        rule("STRING_SINGLE", quoted("'"), inner=escape(r"\\[trn\\']")),
        rule("NAME_BUILTIN", rf"\$(?:{prefixes})[^;{{}}()\s]*"),
        rule("NAME_VARIABLE", r"\$[^;{}()\s]+", NAME_BUILTIN=variables),
        rule("NUMBER_DECIMAL", r"[0-9]+(?=[;{}()\s])"),
        rule("STRING_SINGLE", r"[^$#;{}()\s]+"),
        lexer="Nginx",
    )


def elixir() -> RuleSet:
    escapes = lambda q: escape(rf"\\[abdefnrstv{q}]")
    sigil = lambda letters: "~[" + letters + r"](?:<[^>]*>?|\[[^\]]*\]?|\{[^}]*\}?|\([^)]*\)?|([^a-zA-Z0-9\s<\[{(])(?s:.*?)(?:\1|\z))[a-zA-Z]*"
    return rules(
        SPACE,
        rule("STRING_REGEX", sigil("rR")),
        rule("STRING_DOUBLE", sigil("sScC")),
        rule("IGNORABLE", sigil("a-zA-Z")),
        rule("COMMENT_SINGLE", "#[^\n]*"),
        rule("STRING_DOUBLE", quoted('"""', escapes=False)),
        rule("STRING_SINGLE", quoted("'''", escapes=False)),
        rule("STRING_INTERNED", r""":(?:[a-zA-Z_][a-zA-Z0-9_@]*[?!]?|"[^"]+"|'[^']+')"""),
        rule("STRING_DOUBLE", quoted('"'), inner=escapes('"')),
        rule("STRING_SINGLE", quoted("'"), inner=escapes("'")),
        rule("NUMBER_BINARY", "0[bB][01]+(?:_[01]+)*"),
        rule("NUMBER_OCTAL", "0[oO][0-7]+(?:_[0-7]+)*"),
        rule("NUMBER_HEXADECIMAL", rf"0[xX]{HEX}+(?:_{HEX}+)*"),
        rule("NUMBER_FLOAT", r"[0-9]+\.[0-9]+(?:[eE][-+]?[0-9]+)?"),
        rule("NUMBER_DECIMAL", "[0-9]+"),
        # Word operators, keywords and constants.
        rule("IGNORABLE", r"[a-zA-Z_][a-zA-Z0-9_]*[?!]?", OPERATOR="and in or not when", KEYWORD="def defp defmacro defmacrop defdelegate defexception defimpl defmodule defoverridable defprotocol defstruct fn do end after else rescue if unless case cond for with use import alias require", KEYWORD_BUILTIN="nil true false"),
        rule("PUNCTUATION", r"->|=>|%\{|\|>"),
        rule("OPERATOR", r"[!=]={1,2}|\|{2,3}|&{2,3}|\^{3}|[<>]=?|[-+^]"),
        rule("PUNCTUATION", r"[(){}\[\],:]"),
        lexer="Elixir",
    )


def ruby() -> RuleSet:
    body = r"(?:<[^>]*>?|\[[^\]]*\]?|\{[^}]*\}?|\([^)]*\)?|([^a-zA-Z0-9\s<\[{(=])(?s:.*?)(?:\1|\z))"
    return rules(
        rule("COMMENT_MULTILINE", r"(?m:^)=begin\s" + until(r"\n=end(?=\s|\z)", escapes=False)),
        SPACE,
        rule("COMMENT_SINGLE", "#[^\n]*"),
        rule("STRING_DOUBLE", "%[QWI]" + body),
        rule("STRING_SINGLE", "%[qwi]" + body),
        rule("STRING_INTERNED", "%s" + body),
        rule("STRING_REGEX", r"%r" + body + "[a-z]*|/(?=[^\\s/=])[^/\n]*/[mixounse]*"),
        rule("STRING_BACKTICK", "%x" + body + "|" + quoted("`", escapes=False)),
        rule("STRING_DOUBLE", quoted('"')),
        rule("STRING_SINGLE", quoted("'")),
        rule("NUMBER_BINARY", "0[bB][01]+(?:_[01]+)*"),
        rule("NUMBER_HEXADECIMAL", rf"0[xX]{HEX}+(?:_{HEX}+)*"),
        rule("NUMBER_OCTAL", "(?:0[oO]|0_?)[0-7]+(?:_[0-7]+)*"),
        rule("NUMBER_DECIMAL", "(?:0[dD][0-9]+|[1-9][0-9]*)(?:_[0-9]+)*"),
        rule("NAME_VARIABLE_GLOBAL", r"""\$(?:-[0adFiIlpvw]|[0-9_~*$?!@/\;,.=:<>"&`'+-]|[a-zA-Z_][a-zA-Z0-9_]*)"""),
        rule("NAME_VARIABLE_CLASS", r"@@[a-zA-Z0-9_\x80-\x{10ffff}]+"),
        rule("NAME_VARIABLE_INSTANCE", r"@[a-zA-Z0-9_\x80-\x{10ffff}]+"),
        rule("NAME_CLASS", "[A-Z][a-zA-Z0-9_]*(?=::)"),
        rule("NAME_VARIABLE", "[a-z_][a-zA-Z0-9_]*(?=::)"),
        rule("STRING_INTERNED", r"[a-zA-Z0-9_]+:(?!:)|:[a-zA-Z_][a-zA-Z0-9_]*"),
        # Keywords and builtin names.
        rule("NAME_VARIABLE_CLASS", r"[A-Z][a-zA-Z0-9_]*[!?]?", KEYWORD="BEGIN END", KEYWORD_BUILTIN="FALSE TRUE NIL"),
        rule("NAME_FUNCTION", r"[a-zA-Z0-9_\x80-\x{10ffff}]+[!?]?", NAME_BUILTIN_PSEUDO="self require __ENCODING__ __FILE__ __LINE__", KEYWORD="alias begin break case class def defined? do else elsif end ensure for if in module next redo rescue retry return super then undef unless until when while yield", KEYWORD_BUILTIN="false true nil", OPERATOR="and or not"),
        rule("OPERATOR", r"::|=>|->|\*\*|<=>|[<>!=]=|&&|\|\||[=!]~|\.{2,3}|>>|<<|[?:=!~&|^<>*+/-]"),
        rule("PUNCTUATION", r"[;.{}\[\]]"),
        lexer="Ruby",
    )


def template(code: RuleSet, lexer: str, secondary: RuleSet | None) -> RuleSet:
    """Tags ``<% … %>`` with code; what is outside goes to ``secondary``, as one text with the tags as islands."""
    return around(
        [rule("COMMENT_SINGLE", "<%#" + until("%>", escapes=False)), *tagged("<%=?", code, "%>", code, line="#")],
        r"(?s).+?(?=<%|\z)",
        lexer,
        secondary,
    )


def around(tags: list[Rule], rest: str, lexer: str, secondary: RuleSet | None) -> RuleSet:
    """A template: its tags, and the rest in the secondary language or as it is."""
    return rules(*tags, lexer=lexer, outer=secondary) if secondary else rules(*tags, Rule("IGNORABLE", rest), lexer=lexer)


def twig(secondary: RuleSet | None) -> RuleSet:
    inside = lambda keywords: rules(
        SPACE,
        rule("NUMBER_FLOAT", r"[0-9]+\.[0-9]+"),
        rule("NUMBER_DECIMAL", "[0-9]+"),
        rule("STRING_SINGLE", quoted("'"), inner=escape(r"\\'")),
        rule("STRING_DOUBLE", quoted('"'), inner=[*escape(r'\\"'), rule("SEQUENCE_INTERPOLATED", r"#\{|\}")]),
        rule("OPERATOR", r"b-(?:and|or|xor)\b|(?:starts|ends)[ \t]+with\b"),
        # Constants, word operators and statement keywords.
        rule("IGNORABLE", "[a-zA-Z_][a-zA-Z_0-9]*", KEYWORD_CONSTANT="true false null none", OPERATOR="is not in and or matches", KEYWORD=keywords),
        rule("OPERATOR", r"[.?/*]{2}|[!=<>]?=|[-+%|?:~]"),
        rule("PUNCTUATION", r"[{}.()\[\]]"),
    )
    # Statements.
    statements = "as autoescape block do else elseif embed endautoescape endblock endembed endfilter endfor endif endmacro endsandbox endset endspaceless endverbatim extends filter flush for from if import include macro sandbox set spaceless use verbatim with"
    values, commands = inside(""), inside(statements)
    comment = rule("COMMENT_MULTILINE", r"\{#" + until(r"#\}", escapes=False))
    return around([comment, *tagged(r"\{\{-?", values, r"-?\}\}", values), *tagged(r"\{%-?", commands, r"-?%\}", commands)], r"(?s).+?(?=\{[{%#]|\z)", "Twig", secondary)


# Commands.
CMAKE_COMMANDS = "add_compile_options add_custom_command add_custom_target add_definitions add_dependencies add_executable add_library add_subdirectory add_test aux_source_directory break build_command build_name cmake_host_system_information cmake_minimum_required cmake_parse_arguments cmake_policy configure_file continue create_test_sourcelist define_property else elseif enable_language enable_testing endforeach endfunction endif endmacro endwhile exec_program execute_process export export_library_dependencies file find_file find_library find_package find_path find_program fltk_wrap_ui foreach function get_cmake_property get_directory_property get_filename_component get_property get_source_file_property get_target_property get_test_property if include include_directories include_external_msproject include_regular_expression install install_files install_programs install_targets link_directories link_libraries list load_cache load_command macro make_directory mark_as_advanced math message option output_required_files project qt_wrap_cpp qt_wrap_ui remove remove_definitions return separate_arguments set set_directory_properties set_property set_source_files_properties set_target_properties set_tests_properties site_name source_group string subdir_depends subdirs target_compile_definitions target_compile_features target_compile_options target_include_directories target_link_libraries target_sources try_compile try_run unset use_mangled_mesa utility_source variable_requires variable_watch while write_file"


def cmake() -> RuleSet:
    variable = rule("SEQUENCE_INTERPOLATED", r"\$\{[^}\n]*\}?", inner=RuleSet((rule("SEQUENCE_INTERPOLATED", r"\$\{|\}"),), "NAME_VARIABLE"))
    expression = rule("TAG_PREPROC", r"\$<[^>\n]*>?", inner=RuleSet((rule("TAG_PREPROC", r"\$<|>"), rule("PUNCTUATION", ":"), variable), "IGNORABLE"))
    return rules(
        SPACE,
        rule("COMMENT_MULTILINE", r"#\[(=*)\[(?s:.*?)(?:\]\1\]|\z)"),
        rule("COMMENT_SINGLE", "#" + REST_OF_LINE),
        rule("STRING_DOUBLE", r"\[(=*)\[(?s:.*?)(?:\]\1\]|\z)", inner=[variable, expression]),
        rule("STRING_DOUBLE", quoted('"'), inner=[*escape(r"""\\[()#" \\$@^trn;]"""), variable, expression]),
        variable,
        expression,
        rule("NAME_FUNCTION", r"[A-Za-z_][A-Za-z0-9_]*(?=[ \t]*\()", fold=True, NAME_BUILTIN=CMAKE_COMMANDS),
        rule("PUNCTUATION", "[()]"),
        rule("IGNORABLE", r"[^\s#\[\"$()]+"),
        lexer="CMake",
    )


def css(words: Mapping[str, Iterable[str]]) -> RuleSet:
    # The two are looked up at different places, so a word may be in both.
    properties, values = extended(words, properties=lists.CSS_PROPERTIES) + extended(words, values=lists.CSS_VALUES)
    prefixes = "|".join(lists.CSS_PREFIXES.split())
    comment = rule("COMMENT_MULTILINE", C_COMMENT)
    name = "-?[a-z_][a-z0-9_-]*"
    block = rules(
        rule("PUNCTUATION", r"[{};()]"),
        SPACE,
        comment,
        rule("KEYWORD_BUILTIN", rf"(?:{prefixes})[a-z0-9_-]+(?=\s*:)", NAME_BUILTIN=properties),
        rule("KEYWORD", rf"{name}(?=\s*:)", NAME_BUILTIN=properties),
        rule("KEYWORD_PSEUDO", rf":{name}"),
        rule("NAME_FUNCTION", rf"{name}(?=\()"),
        rule("TAG_PREPROC", "!important"),
        rule("STRING_SINGLE", quoted('"')),
        rule("STRING_SINGLE", quoted("'")),
        rule("NUMBER_DECIMAL", rf"#{HEX}{{6}}|[-+]?(?:[0-9]*\.)?[0-9]+(?:%|[a-z]+)?"),
        rule("KEYWORD", name, NAME_BUILTIN=values),
    )
    return rules(
        comment,
        SPACE,
        rule("PUNCTUATION", rf"\{{{body(block, '[{}]')}\}}", inner=RuleSet(block.rules, "IGNORABLE")),
        rule("PUNCTUATION", "[{},()]"),
        rule("KEYWORD_PSEUDO", rf"::?{name}"),
        rule("OPERATOR", r"[~|^$*]=|[~+>*|\[\]=]"),
        rule("KEYWORD", rf"@{name}"),
        rule("NAME_CLASS", rf"\.{name}"),
        rule("NAME_FUNCTION", r"#[a-zA-Z0-9_-]+"),
        rule("STRING_SINGLE", quoted('"')),
        rule("KEYWORD", name),
        rule("IGNORABLE", "<!--|-->"),
        lexer="CSS",
    )


XML_NAME = r"[:A-Z_a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u1fff\u200c-\u218f\u2c00-\ud7ff][:A-Z_a-z\u00b7-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0300-\u1fff\u200c-\u218f\u2c00-\ud7ff0-9.-]*"


def dtd() -> RuleSet:
    entity = rule("NAME_ENTITY", f"%{XML_NAME};")
    strings = [rule("STRING_SINGLE", r'"[^"]*"?|\'[^\']*\'?', inner=[entity])]
    declared = lambda *more: RuleSet((rule("NAME_TAG", r"\A<![A-Z]+|>\z"), SPACE, entity, *strings, *more), "IGNORABLE")
    return rules(
        rule("COMMENT_MULTILINE", "<!--" + until("-->", escapes=False)),
        rule("NAME_TAG", r"<!ELEMENT\s[^>]*>?", inner=declared(rule("KEYWORD_CONSTANT", r"\bEMPTY\b|\bANY\b|#PCDATA"), rule("NAME_TAG", XML_NAME), rule("PUNCTUATION", "[(),]"), rule("OPERATOR", r"[|*+?]"))),
        rule("NAME_TAG", r"<!ATTLIST\s(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>?", inner=declared(rule("KEYWORD_CONSTANT", "#(?:IMPLIED|REQUIRED|FIXED)"), rule("NAME_ATTRIBUTE", XML_NAME, KEYWORD_CONSTANT="CDATA ID IDREF IDREFS ENTITY ENTITIES NMTOKEN NMTOKENS NOTATION"), rule("PUNCTUATION", "[()]"), rule("OPERATOR", r"\|"))),
        rule("NAME_TAG", r"<!ENTITY\s(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>?", inner=declared(rule("NAME_ENTITY", XML_NAME, KEYWORD_CONSTANT="SYSTEM PUBLIC NDATA"))),
        rule("NAME_TAG", r"<!NOTATION\s(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>?", inner=declared(rule("IGNORABLE", XML_NAME, KEYWORD_CONSTANT="SYSTEM PUBLIC"))),
        rule("NAME_TAG", rf"<!DOCTYPE(?=\s)|<!\[\s*(?:INCLUDE|IGNORE|%{XML_NAME};)\s*\[|\]\]>|\]\s*>"),
        entity,
        SPACE,
        lexer="DTD",
    )


def markup(html: bool, words: Mapping[str, Iterable[str]]) -> RuleSet:
    entity = rule("NAME_ENTITY", f"&{XML_NAME};")
    attributes = [
        SPACE,
        rule("NAME_ATTRIBUTE", rf"{XML_NAME}\s*=\s*|{XML_NAME}"),
        rule("STRING_SINGLE", "'[^']*'?", inner=[entity]),
        rule("STRING_SINGLE", '"[^"]*"?', inner=[entity]),
    ]
    declared = dtd()
    # an internal subset ends where its own declarations, comments and sections have ended
    subset = rf"(?:{either(r'[\w\s]++', *(r.pattern for r in declared.rules if r.pattern.startswith('<!') and 'DOCTYPE' not in r.pattern))}|\]\]>|(?!\]\s*>)(?s:.))*+"
    opened = RuleSet((rule("NAME_TAG", rf"\A<(?:!DOCTYPE|{XML_NAME})|>\z"), *attributes), "IGNORABLE")
    rest = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"
    parts = [
        rule("COMMENT_MULTILINE", "<!--" + until("-->", escapes=False)),
        rule("TAG_PREPROC", r"<!\[CDATA\[" + until(r"\]\]>", escapes=False), inner=RuleSet((rule("TAG_PREPROC", r"\A<!\[CDATA\[|\]\]>\z"),), "IGNORABLE")),
        rule("NAME_TAG", rf"<!DOCTYPE\s+{XML_NAME}[^>\[]*\[{subset}(?:\]\s*>|\z)", inner=declared),
        rule("NAME_TAG", r"<!DOCTYPE(?=\s)[^>]*>?", inner=opened),
        rule("TAG_PREPROC", rf"<\?{XML_NAME}" + until(r"\?>", escapes=False), inner=RuleSet((rule("TAG_PREPROC", rf"\A<\?{XML_NAME}|\?>\z"), *attributes), "IGNORABLE")),
    ]
    if html:
        for tag, inner in (("style", css(words)), ("script", javascript())):
            element = RuleSet((rule("NAME_TAG", rf"(?i)\A<{tag}\b{rest}>", inner=opened), rule("NAME_TAG", rf"(?i)</{tag}\s*>\z"), rule("IGNORABLE", rf"(?is).+?(?=</{tag}\s*>\z|\z)", inner=inner)), "NAME_TAG")
            parts.append(rule("NAME_TAG", rf"(?i:<{tag}\b){rest}>" + until(rf"(?i:</{tag}\s*>)", escapes=False), inner=element))
    return rules(
        *parts,
        rule("NAME_TAG", rf"</{XML_NAME}\s*>"),
        rule("NAME_TAG", rf"<{XML_NAME}{rest}>?", inner=opened),
        entity,
        rule("IGNORABLE", "[^<&]+"),
        lexer="HTML" if html else "XML",
    )


def postgresql(words: Mapping[str, Iterable[str]], standard_conforming_strings: bool = True) -> RuleSet:
    keywords, types = extended(words, fold=True, keywords=lists.POSTGRESQL_KEYWORDS, types=lists.POSTGRESQL_TYPES)
    escapes = escape(rf"\\(?:u{HEX}{{4}}|U{HEX}{{8}}|x{HEX}{{1,2}}|[0-7]{{1,3}}|(?s:.))")
    plain = doubled("'") if standard_conforming_strings else quoted("'")
    return rules(
        SPACE,
        rule("COMMENT_SINGLE", "--" + REST_OF_LINE),
        rule("COMMENT_MULTILINE", C_COMMENT),
        rule("NUMBER_BINARY", "[bB]'[^']*'?"),
        rule("NUMBER_HEXADECIMAL", "[xX]'[^']*'?"),
        rule("STRING_SINGLE", "[eE]" + quoted("'"), inner=escapes),
        rule("STRING_SINGLE", "(?:[nN]|[uU]&)?" + plain, inner=None if standard_conforming_strings else escapes),
        rule("STRING_SINGLE", "(?:[uU]&)?" + doubled('"')),
        rule("STRING_SINGLE", r"(\$(?:[A-Za-z_\x80-\xff][A-Za-z_0-9\x80-\xff]*)?\$)(?s:.*?)(?:\1|\z)"),
        rule("NAME_VARIABLE", r"\$[0-9]+"),
        rule("NUMBER_FLOAT", r"(?:[0-9]*\.[0-9]+|[0-9]+\.(?!\.)[0-9]*|[0-9]+)[eE][-+]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+\.(?!\.)[0-9]*"),
        rule("NUMBER_DECIMAL", "[0-9]+"),
        rule("IGNORABLE", r"[A-Za-z_\x80-\xff][A-Za-z_0-9$\x80-\xff]*", fold=True, KEYWORD=keywords, KEYWORD_TYPE=types),
        rule("OPERATOR", r"::|\.\.|:=|[~!@#^&|`?+\-*/%<>=]+|[,()\[\].;:]"),
        lexer="PostgreSQL",
    )


def mysql(words: Mapping[str, Iterable[str]], ansi_quotes: bool = False, no_backslash_escapes: bool = False) -> RuleSet:
    keywords, operators, constants = extended(words, fold=True, keywords=lists.MYSQL_KEYWORDS, operators=lists.MYSQL_OPERATORS, constants=lists.MYSQL_CONSTANTS)
    escapes = None if no_backslash_escapes else escape(r"\\(?s:.)")
    string = doubled if no_backslash_escapes else quoted  # a doubled quote makes two tokens of one type, which are joined
    return rules(
        SPACE,
        rule("COMMENT_SINGLE", r"(?:#|--(?=[\s\x00]|\z))" + REST_OF_LINE),
        rule("COMMENT_MULTILINE", r"/\*![0-9]{0,6}|(?<!\*)\*/"),
        rule("COMMENT_MULTILINE", C_COMMENT),
        rule("NUMBER_HEXADECIMAL", rf"[xX]'[^']*'?|0x{HEX}+"),
        rule("NUMBER_BINARY", "[bB]'[^']*'?|0b[01]+"),
        rule("STRING", string("'"), inner=escapes),
        rule("NAME" if ansi_quotes else "STRING", string('"'), inner=None if ansi_quotes else escapes),
        rule("NAME", doubled("`")),
        rule("NAME_VARIABLE", r"@{1,2}[a-zA-Z0-9_.$]+|@'[^']*'|@\"[^\"]*\"|@`[^`]*`"),
        rule("NUMBER", r"[-+]?(?:[0-9]*\.[0-9]+|[0-9]+\.?)(?:[eE][-+]?[0-9]+)?"),
        rule("NAME", r"[a-zA-Z_$\u0080-\uffff][a-zA-Z0-9_$\u0080-\uffff]*", fold=True, KEYWORD=keywords, OPERATOR=operators, KEYWORD_CONSTANT=constants),
        rule("OPERATOR", r"<=>|<<|>>|:=|&&|\|\||[<>!]=|<>|[-+*/%<>=!&|^~]"),
        rule("PUNCTUATION", r"[.,;()]"),
        lexer="MySQL",
    )


# Functions, variables and subroutines of the configuration language; 3 or 4 marks the only version that has one.
VARNISH_FUNCTIONS = "ban ban_url call error hash_data new regsub regsuball return rollback std.author std.cache_req_body std.collect std.duration std.fileread std.healthy std.integer std.ip std.log std.port std.querysort std.random std.real std.real2time std.rollback std.set_ip_tos std.strstr std.syslog std.time std.time2integer std.time2real std.timestamp std.tolower std.toupper synth synthetic"
VARNISH_VARIABLES = "bereq bereq.backend bereq.between_bytes_timeout bereq.connect_timeout bereq.first_byte_timeout bereq.method/4 bereq.proto bereq.request/3 bereq.retries bereq.uncacheable/4 bereq.url bereq.xid beresp beresp.age/4 beresp.backend/4 beresp.backend.ip beresp.backend.name beresp.backend.port/3 beresp.do_esi beresp.do_gunzip beresp.do_gzip beresp.do_stream beresp.grace beresp.keep beresp.proto beresp.reason beresp.response/3 beresp.saintmode/3 beresp.status beresp.storage/3 beresp.storage_hint/4 beresp.ttl beresp.uncacheable/4 beresp.was_304/4 client.identity client.ip client.port/3 local.ip now obj.age/4 obj.grace obj.hits obj.keep obj.lastuse/3 obj.proto obj.reason obj.response/3 obj.status obj.ttl obj.uncacheable/4 remote.ip/4 req req.backend/3 req.backend.healthy/3 req.backend_hint/4 req.can_gzip req.esi req.esi_level req.grace/3 req.hash_always_miss req.hash_ignore_busy req.keep/3 req.method/4 req.proto req.request/3 req.restarts req.ttl req.url req.xid resp resp.proto resp.reason/4 resp.response/3 resp.status server.hostname server.identity server.ip server.port/3"
VARNISH_SUBROUTINES = "vcl_fetch/3 vcl_backend_error/4 vcl_backend_fetch/4 vcl_backend_response/4 vcl_purge/4 vcl_deliver vcl_fini vcl_hash vcl_hit vcl_init vcl_miss vcl_pass vcl_pipe vcl_recv vcl_synth"


def varnish_body(version: int) -> RuleSet:
    old = version < 4
    has = lambda table: " ".join(w.split("/")[0] for w in table.split() if w[-2:] not in (("/4",) if old else ("/3",)))
    embedded = RuleSet((rule("NAME_TAG", r"\AC\{|\}C\z"), rule("IGNORABLE", r"(?s).+?(?=\}C\z|\z)", inner=c())), "NAME_TAG")
    number = r"(?:[0-9]*\.[0-9]+|[0-9]+\.[0-9]*|[0-9]+)"
    return rules(
        SPACE,
        rule("COMMENT_SINGLE", "(?://|#)" + LINE),
        rule("COMMENT_MULTILINE", C_COMMENT),
        rule("NAME_TAG", r"C\{" + until(r"\}C", escapes=False), inner=embedded),
        rule("LITERAL_DURATION", number + r"(?:ms|[smhdwy])(?![a-zA-Z_.-])"),
        rule("LITERAL_SIZE", "[0-9]+[KMGT]?[bB]"),
        rule("NUMBER_FLOAT", r"[0-9]*\.[0-9]+|[0-9]+\.[0-9]*"),
        rule("NUMBER_DECIMAL", "[0-9]+"),
        rule("STRING_SINGLE", r'\{"' + until(r'"\}', escapes=False)),
        rule("STRING_SINGLE", quoted('"'), inner=escape(r'\\[\\"nt]')),
        rule("KEYWORD_DECLARATION", r"vcl(?=\s+[0-9]*\.[0-9])"),
        named("sub", "[a-zA-Z_.-]+", rule("IGNORABLE", "[a-zA-Z_.-]+", NAME_FUNCTION=has(VARNISH_SUBROUTINES))),
        rule("NAME_VARIABLE", r"(?:be)?re(?:q|sp)\.http\.[a-zA-Z_.-]*|obj\.http\.[a-zA-Z_.-]*"),
        # Keywords.
        rule("IGNORABLE", "[a-zA-Z_.-]*[a-zA-Z_][a-zA-Z_.-]*", NAME_VARIABLE=has(VARNISH_VARIABLES), NAME_FUNCTION=VARNISH_FUNCTIONS, KEYWORD="sub set unset include import if else elseif elif elsif" + " remove" * old, KEYWORD_CONSTANT="true false"),
        rule("OPERATOR", r"\+\+|--|&&|\|\||[<=>!*/+-]=|<<|>>|!~|[-+*/%><=!&|~]"),
        rule("PUNCTUATION", r"[{}();.,]"),
        lexer="Varnish",
    )


def varnish(version: int = 3) -> RuleSet:
    """A ``vcl 4.0`` statement makes what follows it version 4."""
    if version >= 4:
        return varnish_body(version)
    return rules(Rule("IGNORABLE", r"(?s)\bvcl\s+[0-9]*\.[0-9].*", inner=varnish_body(4)), *varnish_body(version).rules, lexer="Varnish")


def diff(secondary: RuleSet | None) -> RuleSet:
    return rules(
        rule("GENERIC_INSERTED", r"(?m:^)\+" + LINE),
        rule("GENERIC_DELETED", "(?m:^)-" + LINE),
        rule("GENERIC_STRONG", "(?m:^)!" + LINE),
        rule("GENERIC_SUBHEADING", "(?m:^)@" + LINE),
        rule("GENERIC_HEADING", "(?m:^)(?:=|[iI]ndex|diff)" + LINE),
        Rule("IGNORABLE", r"[^\r\n]*(?:\r\n|[\r\n])|[^\r\n]+", inner=secondary),
        lexer="Diff",
    )


# Keywords, word operators, casts and types.
PHP_KEYWORDS = "abstract as break callable case catch class clone const continue declare default do echo else elseif enddeclare endfor endforeach endif endswitch endwhile exit die extends final finally for foreach function global goto if implements include include_once instanceof insteadof interface namespace new print private protected public require require_once return static switch throw trait try use var while yield eval isset unset empty list array"
PHP_TYPES = "array bool callable float int iterable object self string void"
PHP_PSEUDO = "__CLASS__ __TRAIT__ __FUNCTION__ __METHOD__ __LINE__ __FILE__ __DIR__ __NAMESPACE__"


def php_code() -> RuleSet:
    name = r"\\?[a-zA-Z_\x80-\xff][a-zA-Z0-9_\x80-\xff]*(?:\\[a-zA-Z_\x80-\xff][a-zA-Z0-9_\x80-\xff]*)*"
    head = r"\\u\{0*[dD]"
    variable = r"\$[a-zA-Z_\x80-\xff][a-zA-Z0-9_\x80-\xff]*"
    inside = [
        rule("SEQUENCE_ESCAPED", rf"{head}[89abAB]{HEX}{{2}}\}}{head}[c-fC-F]{HEX}{{2}}\}}"),
        rule("ERROR", rf"{head}[89a-fA-F]{HEX}{{2}}\}}"),
        rule("SEQUENCE_ESCAPED", rf"\\u\{{{HEX}+\}}|\\(?:[0-7]{{1,3}}|x{HEX}{{1,2}}|[nrtvef\\$\"])"),
        rule("SEQUENCE_INTERPOLATED", r"\{(?=\$)|\$\{|(?<=[a-zA-Z0-9_\])])\}"),
        rule("NAME_VARIABLE", variable),
    ]
    listed = lambda type_: RuleSet((rule("KEYWORD", r"\A[a-z]+(?:\s+(?:const|function)\b)?", fold=True, inner=RuleSet((SPACE,), "KEYWORD")), SPACE, rule("COMMENT_MULTILINE", C_COMMENT), rule("COMMENT_SINGLE", r"(?:#|//)[^\r\n]*"), rule("NAME_NAMESPACE", name + r"(?=\\\s*\{)"), named("(?i:function)", name, rule("NAME_FUNCTION", name)), named("(?i:const)", name, rule("NAME_CONSTANT", name)), rule(type_, name, fold=True, KEYWORD="as extends implements function const catch"), rule("OPERATOR", r"\|"), rule("PUNCTUATION", "[(),;{}]")), "IGNORABLE")
    word = lambda keyword: rf"(?i:\b{keyword})\s+(?=[a-zA-Z_\\\x80-\xff])"
    return rules(
        SPACE,
        rule("COMMENT_DOCUMENTATION", r"/\*\*(?=\s)" + until(r"\*/", escapes=False)),
        rule("COMMENT_MULTILINE", C_COMMENT),
        rule("COMMENT_SINGLE", r"(?:#|//)[^\r\n?]*+(?:\?(?!>)[^\r\n?]*+)*+(?:\r\n|[\r\n])?"),
        rule("STRING_SINGLE", quoted("'"), inner=escape(r"\\[\\']")),
        rule("STRING_DOUBLE", quoted('"'), inner=inside),
        rule("STRING_BACKTICK", quoted("`"), inner=inside),
        rule("STRING_SINGLE", r"<<<[ \t]*'([a-zA-Z_][a-zA-Z0-9_]*)'\r?\n(?s:.*?)(?:(?<=\n)\1\b|\z)"),
        rule("STRING_DOUBLE", r"<<<[ \t]*\"?([a-zA-Z_][a-zA-Z0-9_]*)\"?(?:\r?\n|\z)(?s:.*?)(?:(?<=\n)\1\b|\z)", inner=inside),
        rule("KEYWORD", r"(?i:\buse\s+const\s)[^;]*;?", inner=listed("NAME_CONSTANT")),
        rule("KEYWORD", r"(?i:\buse\s+function\s)[^;]*;?", inner=listed("NAME_FUNCTION")),
        rule("KEYWORD", word("use") + r"[^;{(]*\\\s*\{[^}]*\}?", inner=listed("NAME_CLASS")),
        rule("KEYWORD", word("use") + "[^;{(]*[;{]", inner=listed("NAME_CLASS")),
        rule("KEYWORD", "(?<!->|::)" + word("(?:extends|implements)") + "[^;{(]*", inner=listed("NAME_CLASS")),
        rule("KEYWORD", r"(?<!->|::)(?i:\bcatch)\s*\([^)$]*", inner=listed("NAME_CLASS")),
        named("(?i:public|protected|private|var)", variable, rule("NAME_VARIABLE_INSTANCE", variable)),
        rule("KEYWORD", word("namespace") + "[^;{(]*", inner=listed("NAME_NAMESPACE")),
        named("(?i:function)", r"&?\s*+[a-zA-Z_][a-zA-Z0-9_]*", rule("OPERATOR", "&"), rule("NAME_FUNCTION", "[a-zA-Z_][a-zA-Z0-9_]*")),
        named("(?i:const)", "[a-zA-Z_][a-zA-Z0-9_]*", rule("NAME_CONSTANT", "[a-zA-Z_][a-zA-Z0-9_]*")),
        named("(?i:class|trait|interface|extends|implements|new|instanceof)", name, rule("NAME_CLASS", name, fold=True, KEYWORD="class static", NAME_BUILTIN_PSEUDO="self parent")),
        rule("NAME_FUNCTION", r"(?<=->|::)[a-zA-Z_][a-zA-Z0-9_]*(?=\s*\()"),
        rule("NAME_VARIABLE_INSTANCE", r"(?<=->)[a-zA-Z_][a-zA-Z0-9_]*"),
        rule("NAME_CONSTANT", r"(?<=::)[a-zA-Z_][a-zA-Z0-9_]*", fold=True, KEYWORD="class"),
        rule("NAME_CLASS", name + r"(?=\s*::)", fold=True, NAME_BUILTIN_PSEUDO="self parent static"),
        rule("KEYWORD", r"\((?i:\s*(?:int|integer|bool|boolean|float|double|real|string|array|object|unset|binary)\s*)\)", inner=RuleSet((rule("OPERATOR", r"[()]"), rule("KEYWORD_TYPE", "[a-zA-Z]+")), "IGNORABLE")),
        rule("NAME_BUILTIN_PSEUDO", r"\$this\b"),
        rule("NAME_VARIABLE", variable),
        rule("NUMBER_HEXADECIMAL", rf"0[xX]{HEX}+"),
        rule("NUMBER_BINARY", "0[bB][01]+"),
        rule("NUMBER_FLOAT", r"(?:[0-9]*\.[0-9]+|[0-9]+\.[0-9]*)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+"),
        rule("NUMBER_OCTAL", "0[0-7]+"),
        rule("NUMBER_DECIMAL", "[0-9]+"),
        rule("NAME_FUNCTION", name + r"(?=\s*\()", fold=True, KEYWORD=PHP_KEYWORDS, OPERATOR="and or xor"),
        rule("KEYWORD_TYPE", rf"(?i:{'|'.join(PHP_TYPES.split())})(?=\s+&?(?:\.\.\.)?\$)"),
        rule("NAME_CLASS", name + r"(?=\s+&?(?:\.\.\.)?\$)", fold=True, KEYWORD=PHP_KEYWORDS, OPERATOR="and or xor"),
        rule("NAME_CONSTANT", name, fold=True, KEYWORD=PHP_KEYWORDS, OPERATOR="and or xor " + PHP_PSEUDO, KEYWORD_CONSTANT="true false null"),
        rule("OPERATOR", r"<=>|\*\*=?|\.{3}|<<=?|>>=?|===?|!==?|<>|\?\?|->|=>|::|[-+*/.%&|^<>]=|--|\+\+|&&|\|\||[-+*/.%&|^<>=!~?:@$]"),
        rule("PUNCTUATION", r"[{}()\[\],;]"),
        rule("IGNORABLE", r"\\"),
    )


def php(start_inline: bool = False, short_open_tag: bool = True, asp_tags: bool = False, version: int = 7, secondary: RuleSet | None = None) -> RuleSet:
    code = php_code()
    if start_inline:
        return rules(*code.rules, lexer="PHP")
    asp = asp_tags and version < 7
    opens = r"(?i:<\?php(?=\s|\z))|<\?=" + (r"|<\?(?!(?i:xml|php))" if short_open_tag else "") + ("|<%=?" if asp else "")
    closes = r"\?>" + ("|%>" if asp else "")
    return around(tagged(opens, code, closes, code, line="#|//"), rf"(?s).+?(?={opens}|\z)", "PHP", secondary)


def text() -> RuleSet:
    return rules(rule("IGNORABLE", "(?s).+"), lexer="Text")


#: Makers of the rule sets that take options or word lists.
WITH_OPTIONS: dict[str, Callable[..., RuleSet]] = {
    "CSS": lambda words, **o: css(words, **o),
    "Diff": lambda words, secondary=None: diff(secondary),
    "EEX": lambda words, secondary=None: template(elixir(), "EEX", secondary),
    "ERB": lambda words, secondary=None: template(ruby(), "ERB", secondary),
    "HTML": lambda words, **o: markup(True, words, **o),
    "MySQL": lambda words, uppercase_keywords=False, **o: mysql(words, **o),
    "Nginx": lambda words, **o: nginx(words, **o),
    "PHP": lambda words, **o: php(**o),
    "PostgreSQL": lambda words, uppercase_keywords=False, **o: postgresql(words, **o),
    "Twig": lambda words, secondary=None: twig(secondary),
    "Varnish": lambda words, **o: varnish(**o),
    "XML": lambda words, **o: markup(False, words, **o),
}
PLAIN: dict[str, Callable[[], RuleSet]] = {"Apache": apache, "Bash": bash, "C": c, "CMake": cmake, "DTD": dtd, "Elixir": elixir, "Go": go, "Javascript": javascript, "JSON": json, "Lua": lua, "Python": python, "Ruby": ruby, "Text": text}
assert sorted([*WITH_OPTIONS, *PLAIN]) == sorted(LEXER_NAMES)


def rule_set(name: str, words: Mapping[str, Iterable[str]] | None = None, **options) -> RuleSet:
    """The rules of a language by its name. ``words`` are added to the word lists (``keywords``,
    ``types``, ``operators``, ``constants``, ``directives``, ``variables``, ``properties``, ``values``)."""
    return PLAIN[name](**options) if name in PLAIN else WITH_OPTIONS[name](words or {}, **options)
