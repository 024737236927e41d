import re
from collections import Counter

import pytest
import regex

from lexigrain.operators.languages import rule_set
from lexigrain.operators.lexing import FIRST, SPARE, STOP, TWINS, cut, first_of, groups_in, lex_sql, one_of
from lexigrain.operators.render import render
from lexigrain.operators.tokens import coalesce_rows, explode_spans, explode_tokens, tokenize, tokenize_by, tokenize_specs, type_counts, with_spans
from lexigrain.plans.catalog import LEXER_NAMES
from lexigrain.plans.goldens import GOLDEN
from lexigrain.plans.queries import SOURCES
from pyspark.sql import functions as F


def lexed(spark, text, lexer, **options):
    row = tokenize(spark.createDataFrame([(text,)], "text string"), lexer, **options).first()
    return [(t.type, t.text) for t in row.tokens]


def parse(lines):
    """``TYPE: text`` lines with escapes."""
    return [(k, v.replace("\\n", "\n")) for k, _, v in (line.partition(": ") for line in lines)]


PHP = {"start_inline": True}
CASES = [
    ("PostgreSQL", {"uppercase_keywords": True}, "select", ["KEYWORD: SELECT"]),
    # a keyword, as the scanner's rules have it
    ("PHP", PHP, "echo<<<FOO\n", ["KEYWORD: echo", "STRING_DOUBLE: <<<FOO\\n"]),
    ("PHP", PHP, "exit;", ["KEYWORD: exit", "PUNCTUATION: ;"]),
    ("PHP", PHP, "use const \\Foo\\CONSTA, \\Bar\\CONSTB as CONSTC;", ["KEYWORD: use", "IGNORABLE:  ", "KEYWORD: const", "IGNORABLE:  ", "NAME_CONSTANT: \\Foo\\CONSTA", "PUNCTUATION: ,", "IGNORABLE:  ", "NAME_CONSTANT: \\Bar\\CONSTB", "IGNORABLE:  ", "KEYWORD: as", "IGNORABLE:  ", "NAME_CONSTANT: CONSTC", "PUNCTUATION: ;"]),
    ("PHP", PHP, "use function \\Foo\\fnA, \\Bar\\fnB as fnC;", ["KEYWORD: use", "IGNORABLE:  ", "KEYWORD: function", "IGNORABLE:  ", "NAME_FUNCTION: \\Foo\\fnA", "PUNCTUATION: ,", "IGNORABLE:  ", "NAME_FUNCTION: \\Bar\\fnB", "IGNORABLE:  ", "KEYWORD: as", "IGNORABLE:  ", "NAME_FUNCTION: fnC", "PUNCTUATION: ;"]),
    ("PHP", {"secondary": "XML", "short_open_tag": False}, '<?xml version="1.0"?>', ["TAG_PREPROC: <?xml", "IGNORABLE:  ", "NAME_ATTRIBUTE: version=", 'STRING_SINGLE: "1.0"', "TAG_PREPROC: ?>"]),
    ("Varnish", {}, "vcl 4.0;\n\nbereq.method", ["KEYWORD_DECLARATION: vcl", "IGNORABLE:  ", "NUMBER_FLOAT: 4.0", "PUNCTUATION: ;", "IGNORABLE: \\n\\n", "NAME_VARIABLE: bereq.method"]),
    ("Varnish", {"version": 4}, "bereq.method", ["NAME_VARIABLE: bereq.method"]),
    ("Varnish", {}, "bereq.method", ["IGNORABLE: bereq.method"]),
    ("PHP", {}, "#!/bin/foo\n<?php\necho __LINE__;", ["IGNORABLE: #!/bin/foo\\n", "NAME_TAG: <?php", "IGNORABLE: \\n", "KEYWORD: echo", "IGNORABLE:  ", "OPERATOR: __LINE__", "PUNCTUATION: ;"]),
]


@pytest.mark.parametrize("lexer,options,source,expected", CASES)
def test_cases(spark, lexer, options, source, expected):
    assert lexed(spark, source, lexer, **options) == parse(expected)


SURROGATES = [
    ("\\uD835", [("ERROR", "\\uD835")]),
    ("\\uD835\\u0022", [("ERROR", "\\uD835"), ("SEQUENCE_ESCAPED", "\\u0022")]),
    ("\\uDE3C\\uD835", [("ERROR", "\\uDE3C\\uD835")]),
    ("\\uD835;\\uDE3C", [("ERROR", "\\uD835"), ("STRING_DOUBLE", ";"), ("ERROR", "\\uDE3C")]),
    ("\\uDE3C", [("ERROR", "\\uDE3C")]),
    ("\\uD835\\uDE3C", [("SEQUENCE_ESCAPED", "\\uD835\\uDE3C")]),
]


@pytest.mark.parametrize("inside,expected", SURROGATES)
def test_surrogates(spark, inside, expected):
    got = lexed(spark, f'["{inside}"]', "JSON")
    assert got == [("PUNCTUATION", "["), ("STRING_DOUBLE", '"'), *expected, ("STRING_DOUBLE", '"'), ("PUNCTUATION", "]")]
    braced = lambda t: t.replace("\\uD835", "\\u{D835}").replace("\\uDE3C", "\\u{DE3C}").replace("\\u0022", "\\u{0022}")
    got = lexed(spark, f'"{braced(inside)}"', "PHP", start_inline=True)
    assert got == [("STRING_DOUBLE", '"'), *((k, braced(v)) for k, v in expected), ("STRING_DOUBLE", '"')]


@pytest.mark.parametrize("escape", ["\\u{A}", "\\u{" + "0" * 59 + "E9}"])
def test_php_code_points(spark, escape):
    assert lexed(spark, f'"{escape}"', "PHP", start_inline=True) == [("STRING_DOUBLE", '"'), ("SEQUENCE_ESCAPED", escape), ("STRING_DOUBLE", '"')]


#: Starts and middles of constructs of many languages, none of them closed.
BROKEN = "a \"b 'c `d /* e <!-- <? <% {{ {# $( ${x [[ --[[ <<<X\nR\"\\ %q( ~r/ #{ <style> <script> C{ \\\\ 0x 1.e+ é 𝒳 \r\n @@@ ]]> -->"


@pytest.mark.parametrize("lexer", LEXER_NAMES)
def test_tokens_spell_the_text(spark, lexer):
    texts = [SOURCES[lexer].replace("%%", "%").replace("%s", "7"), BROKEN, BROKEN[::-1], "", "\n", "x" * 50_000 + '"' + "\\\"" * 20_000, "(" * 3_000, "/*" * 3_000 + "<a b='" * 3_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for row in tokenize(df, lexer).collect():
        assert "".join(t.text for t in row.tokens) == row.text, (lexer, row.k)
        assert all(t.text for t in row.tokens)
        assert all((a.type, a.lexer, a.depth) != (b.type, b.lexer, b.depth) for a, b in zip(row.tokens, row.tokens[1:], strict=False))


N = 20_000
MANY_PARTS = [
    ("Python", "x = '" + "\\x00a" * N + "' + y", {"STRING_SINGLE": N + 1, "SEQUENCE_ESCAPED": N, "NAME_VARIABLE": 2}),
    ("Python", "r'" + "\\'a" * N + "' + y", {"STRING_DOUBLE": 1, "NAME_VARIABLE": 1}),
    ("Python", "'" + "\\\\" * N + "' + y", {"STRING_SINGLE": 2, "SEQUENCE_ESCAPED": 1, "NAME_VARIABLE": 1}),
    ("C", "#define A \\\n" + "  int x; \\\n" * N + "\nint y;", {"COMMENT_SINGLE": 1, "KEYWORD": 1}),
    ("C", '"' + "\\\\" * N + '" int', {"STRING_DOUBLE": 2, "SEQUENCE_ESCAPED": 1, "KEYWORD": 1}),
    ("HTML", "<p" + " a='>'" * N + ">x", {"NAME_TAG": 2, "NAME_ATTRIBUTE": N, "STRING_SINGLE": N}),
    ("XML", "<p" + ' a=">"' * N + ">x", {"NAME_TAG": 2, "NAME_ATTRIBUTE": N, "STRING_SINGLE": N}),
    ("DTD", "<!ATTLIST a" + " b CDATA '>'" * N + ">", {"NAME_TAG": 2, "KEYWORD_CONSTANT": N, "STRING_SINGLE": N}),
    ("DTD", "<!ENTITY a" + " '>'" * N + ">", {"NAME_TAG": 2, "NAME_ENTITY": 1, "STRING_SINGLE": N}),
    ("DTD", "<!NOTATION a" + " PUBLIC '>'" * N + ">", {"NAME_TAG": 2, "KEYWORD_CONSTANT": N, "STRING_SINGLE": N}),
    ("Javascript", "a" + "\\u00411" * N + " = 1", {"NAME_VARIABLE": 1, "OPERATOR": 1}),
    ("Bash", "a" + "\\ if" * N, {"STRING_SINGLE": 1}),
    ("PHP", "<?php //" + "? if" * N + "\nif", {"NAME_TAG": 1, "COMMENT_SINGLE": 1, "KEYWORD": 1}),
]


MANY_PARTS += [
    ("Bash", '"' + "$(a " * 12 + '"b"' + ")" * 12 + '" if', {"STRING_DOUBLE": 1, "KEYWORD": 1}),
    ("Bash", '"' + "$(a " * 60 + '"b"' + ")" * 60 + '" if', {"STRING_DOUBLE": 1, "KEYWORD": 1}),
    ("Bash", '"' + "$(a)`b`\\$" * N + '" if', {"SEQUENCE_ESCAPED": N, "STRING_DOUBLE": N + 1, "KEYWORD": 1}),
    ("Nginx", ";" + " " * N + "listen 1;" + "\n" * N + "  root /x;", {"KEYWORD_BUILTIN": 2}),
    ("Varnish", "sub" + " " * N + "vcl_recv {}", {"NAME_FUNCTION": 1, "KEYWORD": 1}),
    ("PHP", "<?php class" + " " * N + "A { public" + "\n" * N + "$x; function" + " " * N + "f() {} const" + " " * N + "K = 1; }", {"NAME_CLASS": 1, "NAME_VARIABLE_INSTANCE": 1, "NAME_FUNCTION": 1, "NAME_CONSTANT": 1}),
    ("PostgreSQL", "select '" + "''" * N + "' from", {"STRING_SINGLE": 1, "KEYWORD": 2}),
    ("Javascript", '"' + "\\\\" * N + '"; var', {"STRING_DOUBLE": 2, "KEYWORD": 1}),
]


@pytest.mark.parametrize("lexer", sorted({m[0] for m in MANY_PARTS}))
def test_constructs_of_many_parts(spark, lexer):
    for _, source, expected in (m for m in MANY_PARTS if m[0] == lexer):
        got = Counter(k for k, _ in lexed(spark, source, lexer))
        assert {k: got[k] for k in expected} == expected, source[:40]


def test_embedded_languages(spark):
    page = '<p class="a">x &amp; y<style>p{margin:0}</style><script>var t="</p>";</script></p>'
    row = tokenize(spark.createDataFrame([(page,)], "text string"), "HTML").first()
    by_lexer = {name: "".join(t.text for t in row.tokens if t.lexer == name) for name in ("CSS", "Javascript")}
    assert by_lexer == {"CSS": "p{margin:0}", "Javascript": 'var t="</p>";'}
    assert {t.depth for t in row.tokens if t.lexer == "CSS"} == {1}
    assert ("NAME_ENTITY", "&amp;") in [(t.type, t.text) for t in row.tokens]


def test_secondary_language(spark):
    got = tokenize(spark.createDataFrame([("<b>{{ x }}</b>",)], "text string"), "Twig", secondary="HTML").first().tokens
    assert [(t.lexer, t.text) for t in got if t.type == "NAME_TAG"] == [("HTML", "<b>"), ("Twig", "{{"), ("Twig", "}}"), ("HTML", "</b>")]


def test_word_lists_are_parameters(spark):
    assert lexed(spark, "foo bar", "PostgreSQL", words={"keywords": ["foo"]}) == [("KEYWORD", "foo"), ("IGNORABLE", " bar")]


RETAGS = [
    ("class A extends Z implements B, C { }", {"NAME_CLASS": ["A", "Z", "B", "C"]}),
    ("interface A extends B, \\N\\C { }", {"NAME_CLASS": ["A", "B", "\\N\\C"]}),
    ("try { f(); } catch (A | B $e) { }", {"NAME_CLASS": ["A", "B"], "OPERATOR": ["|"], "NAME_VARIABLE": ["$e"], "KEYWORD": ["try", "catch"]}),
    ("$p->catch(X);", {"NAME_FUNCTION": ["catch"], "NAME_CONSTANT": ["X"], "NAME_CLASS": []}),
    ("class A { public $x; private $y = 1; }", {"NAME_VARIABLE_INSTANCE": ["$x", "$y"], "NAME_VARIABLE": []}),
    ("use A\\{B, C as D};", {"NAME_NAMESPACE": ["A"], "NAME_CLASS": ["B", "C", "D"], "KEYWORD": ["use", "as"], "NAME_CONSTANT": []}),
    ("use function A\\{b, c};", {"NAME_NAMESPACE": ["A"], "NAME_FUNCTION": ["b", "c"]}),
    ("use A\\{function b, const C, D};", {"NAME_FUNCTION": ["b"], "NAME_CONSTANT": ["C"], "NAME_CLASS": ["D"]}),
]


def test_php_names_in_lists(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(RETAGS)], "k int, text string")
    for row in tokenize(df, "PHP", start_inline=True).collect():
        expected = RETAGS[row.k][1]
        assert {k: [t.text for t in row.tokens if t.type == k] for k in expected} == expected, row.text


FOLDS = [
    ("class A { public int $p, $q = [1, 2], $r; var $u; }", {"NAME_VARIABLE_INSTANCE": ["$p", "$q", "$r", "$u"], "KEYWORD_TYPE": ["int"], "NAME_VARIABLE": []}),
    ("class A { static ?Foo $s = null, $t; function f() { static $v, $w; } }", {"NAME_VARIABLE_INSTANCE": ["$s", "$t"], "NAME_CLASS": ["A", "Foo"], "NAME_VARIABLE": ["$v", "$w"]}),
    ("function f(int $a, Bar $b = X): ?Baz { return $x ? f($y) : Qux; }", {"NAME_CLASS": ["Bar", "Baz"], "NAME_CONSTANT": ["X", "Qux"], "KEYWORD_TYPE": ["int"]}),
    ("abstract function g(): int|Foo; $f = function () use ($a): array { };", {"KEYWORD_TYPE": ["int", "array"], "NAME_CLASS": ["Foo"], "NAME_VARIABLE": ["$f", "$a"]}),
    ("$g = fn(int $x): Foo => BAR;", {"NAME_CLASS": ["Foo"], "NAME_CONSTANT": ["BAR"]}),
    ("class B { function __construct(private int $x, Foo $y) {} } $o->public; X::class;", {"NAME_VARIABLE_INSTANCE": ["$x", "public"], "NAME_VARIABLE": ["$y", "$o"], "NAME_CLASS": ["B", "Foo", "X"]}),
    ("}}} ))) function ) : Foo public $", {"KEYWORD": ["function", "public"]}),
]


def test_php_fold(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(FOLDS)] + [(-1, "")], "k int, text string")
    for row in tokenize(df, "PHP", start_inline=True).collect():
        expected = FOLDS[row.k][1] if row.k >= 0 else {}
        assert {k: [t.text for t in row.tokens if t.type == k] for k in expected} == expected, row.text
        assert "".join(t.text for t in row.tokens) == row.text


def test_php_fold_of_a_long_text(spark):
    got = lexed(spark, "<?php " + "class A { public int $p, $q; function f(): Foo { return g($x); } }\n" * 1_000, "PHP")
    assert Counter(got)["NAME_VARIABLE_INSTANCE", "$q"] == 1_000 and Counter(got)["NAME_CLASS", "Foo"] == 1_000


WORDS = [
    ("Nginx", "daemon on; accept_mutex off; proxy_ssl_ciphers HIGH;", "KEYWORD_BUILTIN", ["daemon", "accept_mutex", "proxy_ssl_ciphers"]),
    ("Nginx", "set $x $geoip_city; set $y $ssl_server_name; set $z $upstream_cookie_a;", "NAME_BUILTIN", ["$geoip_city", "$ssl_server_name", "$upstream_cookie_a"]),
    ("CSS", "a { filter: none; tab-size: 4; object-position: x; -xv-a: crosshair; foo: red }", "NAME_BUILTIN", ["filter", "none", "tab-size", "object-position", "crosshair"]),
    ("CSS", "a { -xv-a: b; mso-style: c; -foo-x: d }", "KEYWORD_BUILTIN", ["-xv-a", "mso-style"]),
    ("PostgreSQL", "vacuum Analyze x; listen y; unlisten z; returns t citext, money, false", "KEYWORD", ["vacuum", "Analyze", "listen", "unlisten", "returns", "false"]),
    ("PostgreSQL", "vacuum x citext, Money, blob", "KEYWORD_TYPE", ["citext", "Money"]),
    ("MySQL", "load data Force lines optionally longtext rows jsonb vacuum in between binary", "KEYWORD", ["load", "Force", "lines", "optionally", "longtext", "in", "between", "binary"]),
    ("MySQL", "a and b is not Null or true", "OPERATOR", ["and", "is", "not", "or"]),
    ("MySQL", "a is Null or true unknown", "KEYWORD_CONSTANT", ["Null", "true"]),
]


@pytest.mark.parametrize("lexer,source,type_,expected", WORDS)
def test_whole_word_lists(spark, lexer, source, type_, expected):
    assert [t for k, t in lexed(spark, source, lexer) if k == type_] == expected


def test_words_are_added(spark):
    assert lexed(spark, "foo select TEXT", "PostgreSQL", words={"keywords": ["Foo", "text"]}) == [("KEYWORD", "foo"), ("IGNORABLE", " "), ("KEYWORD", "select"), ("IGNORABLE", " "), ("KEYWORD", "TEXT")]


def test_null_mark_and_noncharacters(spark):
    df = spark.createDataFrame([(None,), ("﻿1",), ("a﷐",)], "text string")
    got = [r.tokens and [(t.type, t.text) for t in r.tokens] for r in tokenize(df, "JSON").collect()]
    assert got == [None, [("NUMBER_DECIMAL", "1")], [("IGNORABLE", "a﷐")]]


def test_characters_of_the_marks(spark):
    """Texts with the marks' own characters, and with characters of the blocks to which they are moved."""
    odd = "".join(map(chr, [*range(0xE000, 0xE100), 0xF0000, 0xF00FF, 0x10FFFF, 1, 2]))
    got = lexed(spark, f'{{"{odd}": 1, {odd}: "\\n"}}', "JSON")
    assert got == [("PUNCTUATION", "{"), ("STRING_DOUBLE", f'"{odd}"'), ("PUNCTUATION", ":"), ("IGNORABLE", " "), ("NUMBER_DECIMAL", "1"), ("PUNCTUATION", ","), ("IGNORABLE", " " + odd), ("PUNCTUATION", ":"), ("IGNORABLE", " "), ("STRING_DOUBLE", '"'), ("SEQUENCE_ESCAPED", "\\n"), ("STRING_DOUBLE", '"'), ("PUNCTUATION", "}")]
    every = "\ue000" + "".join(chr((0xF00 + k) << 8) for k in range(512))
    assert lexed(spark, every, "JSON") == [("ERROR", every)]
    assert lexed(spark, every[:-1] + "1", "JSON") == [("IGNORABLE", every[:-1]), ("NUMBER_DECIMAL", "1")]
    cuts = spark.createDataFrame([("a\ue0001",), ("",)], "text string").select(cut(F.col("text"), ["[0-9]"]).alias("c")).collect()
    assert [[tuple(p) for p in r.c] for r in cuts] == [[(1, "a"), (1, "\ue000"), (0, "1")], []]


def test_word_trees():
    words = ["select", "set", "s", "from", "a.b", "[", "if", "iff", "x$y"]
    found = re.compile(one_of(words))
    assert all(found.fullmatch(w) for w in words) and not any(found.fullmatch(w) for w in ("se", "fro", "axb", "", "i", "x"))
    assert [first_of(p) for p in (r"\\\\(?:a|b)", "&x;", r"\\a|b", "ab", r"(?<=x)\\\\")] == ["\\\\", "&", None, None, None]


def test_spans_within_rows(spark):
    df = spark.createDataFrame([(1, '{"a":12}' * 500), (2, "[true]"), (3, ""), (4, None)], "id int, text string")
    lexed_df = tokenize(df, "JSON")
    got = {tuple(r) for r in explode_spans(lexed_df, "id").select("id", "seq", "type", "start", "end").collect()}
    assert got == {tuple(r) for r in with_spans(explode_tokens(lexed_df, "id"), "id").select("id", "seq", "type", "start", "end").collect()}
    assert len(got) > 2_000
    assert "Exchange" not in explode_spans(lexed_df, "id")._jdf.queryExecution().executedPlan().toString()


def test_rows_of_tokens(spark):
    df = spark.createDataFrame([(1, '{"a":12}'), (2, "[true]")], "id int, text string")
    rows = with_spans(explode_tokens(tokenize(df, "JSON"), "id"), "id")
    texts = {r.id: r.text for r in df.collect()}
    for r in rows.collect():
        assert texts[r.id][r.start : r.end] == r.text
    single = df.select("id", F.posexplode(cut(F.col("text"), ["[0-9a-z]"])).alias("seq", "p")).select("id", "seq", F.lit("x").alias("lexer"), F.lit(0).alias("depth"), F.col("p.n").cast("string").alias("type"), F.col("p.text").alias("text"))
    joined = {(r.id, r.text) for r in coalesce_rows(single, "id").collect()}
    assert joined == {(1, '{"'), (1, "a"), (1, '":'), (1, "12"), (1, "}"), (2, "["), (2, "true"), (2, "]")}


def test_lexer_by_column(spark):
    df = spark.createDataFrame([("1", "JSON"), ("1", "Text"), ("x = 1", "Python")], "text string, lexer string")
    got = [[t.type for t in r.tokens] for r in tokenize_by(df, "lexer", ["JSON", "Python"]).collect()]
    assert got == [["NUMBER_DECIMAL"], ["IGNORABLE"], ["NAME_VARIABLE", "IGNORABLE", "NUMBER_DECIMAL"]]


def test_groups_in():
    assert [groups_in(p) for p in (r"(a)", r"(?:a)", r"\(", "[(]", r"(?<x>a)", r"(?<=a)b", r"(?i:a)(b)")] == [1, 0, 0, 0, 1, 0, 1]


def test_no_python_in_the_plan(spark):
    plan = tokenize(spark.createDataFrame([("1",)], "text string"), "HTML")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert rule_set("HTML").lexer == "HTML"


#: Where a later rule would match more: the openings of long comments are told before short ones.
SHORTER = {("Lua", "COMMENT_MULTILINE", "COMMENT_SINGLE"), ("MySQL", "COMMENT_MULTILINE", "COMMENT_MULTILINE")}


def java_pattern(pattern):
    return regex.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern).replace("\\z", "\\Z"), regex.V0)


def longer_matches(rules, text):
    """(type, type) of rules where one that comes later matches more than the first, text between constructs aside."""
    patterns, at = [java_pattern(r.pattern) for r in rules.rules], 0
    while at < len(text):
        found = [(m.end() - at, r) for r, p in zip(rules.rules, patterns, strict=True) if (m := p.match(text, at)) and m.end() > at]
        yield from ((found[0][1].type, r.type) for n, r in found[1:] if n > found[0][0] and r.type != "IGNORABLE")
        if found and found[0][1].inner:
            yield from longer_matches(found[0][1].inner, text[at : at + found[0][0]])
        at += found[0][0] if found else 1


@pytest.mark.parametrize("language", GOLDEN)
def test_first_match_is_the_longest(language):
    name, _, variant = language.partition("?")
    text = "".join(t.partition(" ")[2] for t in GOLDEN[language]).replace("{k}", "7").replace("{n}", "Name")
    assert {(name, *types) for types in longer_matches(rule_set(name, **({variant: True} if variant else {})), text)} <= SHORTER


def test_texts_are_lexed_once(spark):
    df = spark.createDataFrame([(1, "1")], "id int, text string")
    lexed_df = tokenize(df.repartition(2), "JSON")
    for made in (explode_tokens(lexed_df, "id"), type_counts(lexed_df), explode_tokens(lexed_df, "id").where("type = 'ERROR'")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("true|false|null") == 1


#: (lexer, options, text, (path, type, text) that must be among the tokens)
EMBEDDED = [
    ("Twig", {"secondary": "HTML"}, '<a href="{{ u }}">text</a>', [("Twig/HTML", "STRING_SINGLE", '"'), ("Twig", "NAME_TAG", "{{"), ("Twig/HTML", "IGNORABLE", "text"), ("Twig/HTML", "NAME_TAG", "</a>")]),
    ("Twig", {"secondary": "HTML"}, '<h{{ n }} class="x{{ y }}z">', [("Twig/HTML", "NAME_TAG", "<h"), ("Twig/HTML", "NAME_ATTRIBUTE", "class="), ("Twig/HTML", "STRING_SINGLE", '"x'), ("Twig/HTML", "STRING_SINGLE", 'z"')]),
    ("Twig", {"secondary": "HTML"}, "<style>a{color:{{ x }}; top:0}</style>b", [("Twig/HTML/CSS", "NAME_BUILTIN", "color"), ("Twig/HTML/CSS", "NAME_BUILTIN", "top"), ("Twig/HTML", "NAME_TAG", "</style>"), ("Twig/HTML", "IGNORABLE", "b")]),
    ("Twig", {"secondary": "HTML"}, '<script>s = "a{{ b }}c"; {{ d }} var</script>', [("Twig/HTML/Javascript", "STRING_DOUBLE", '"a'), ("Twig/HTML/Javascript", "STRING_DOUBLE", 'c"'), ("Twig/HTML/Javascript", "KEYWORD", "var")]),
    ("Twig", {}, '{{ "}}" }}x{% if \'%}\' %}', [("Twig", "SEQUENCE_INTERPOLATED", "}}"), ("Twig", "IGNORABLE", "x"), ("Twig", "STRING_SINGLE", "'%}'")]),
    ("ERB", {"secondary": "HTML"}, "<p title='<%= @x # don't %>'><% if \"%>\" %>é", [("ERB/HTML", "STRING_SINGLE", "'"), ("ERB/Ruby", "COMMENT_SINGLE", "# don't "), ("ERB/Ruby", "STRING_DOUBLE", '"%>"'), ("ERB/HTML", "IGNORABLE", "é")]),
    ("EEX", {"secondary": "HTML"}, '<b id="<%= "%>" %>">', [("EEX/Elixir", "STRING_DOUBLE", '"%>"'), ("EEX/HTML", "STRING_SINGLE", '"'), ("EEX/HTML", "NAME_TAG", ">")]),
    ("PHP", {"secondary": "HTML"}, '<a href="<?php echo "a ?> b"; // c ?>">x</a>', [("PHP", "STRING_DOUBLE", '"a ?> b"'), ("PHP", "COMMENT_SINGLE", "// c "), ("PHP/HTML", "STRING_SINGLE", '"'), ("PHP/HTML", "NAME_TAG", "</a>")]),
    ("PHP", {}, "<?php $x = <<<A\n?>\nA;\n?>b", [("PHP", "STRING_DOUBLE", "<<<A\n?>\nA"), ("PHP", "NAME_TAG", "?>"), ("PHP", "IGNORABLE", "b")]),
    ("PHP", {}, "a<?php echo '?>", [("PHP", "STRING_SINGLE", "'?>")]),
    ("CSS", {}, 'a { content: "}"; color: red } b { /* } */ } c', [("CSS", "STRING_SINGLE", '"}"'), ("CSS", "NAME_BUILTIN", "color"), ("CSS", "COMMENT_MULTILINE", "/* } */"), ("CSS", "KEYWORD", "c")]),
    ("XML", {}, '<!DOCTYPE a [<![INCLUDE[<!ENTITY x "]>">]]><!-- ]> -->]><b/>', [("XML/DTD", "STRING_SINGLE", '"]>"'), ("XML/DTD", "COMMENT_MULTILINE", "<!-- ]> -->"), ("XML/DTD", "NAME_TAG", "]>"), ("XML", "NAME_TAG", "<b")]),
    ("HTML", {}, '<script data-x="a>b">var x;</script><p>', [("HTML", "STRING_SINGLE", '"a>b"'), ("HTML/Javascript", "KEYWORD", "var"), ("HTML", "NAME_TAG", "</script><p>")]),
]


@pytest.mark.parametrize("lexer,options,text,expected", EMBEDDED)
def test_embedded_code(spark, lexer, options, text, expected):
    row = tokenize(spark.createDataFrame([(text,)], "text string"), lexer, **options).select("tokens", render(F.col("tokens"), "HTML").alias("html")).first()
    assert "".join(t.text for t in row.tokens) == text
    found = [("/".join(t.path), t.type, t.text) for t in row.tokens]
    assert [x for x in expected if x not in found] == []
    assert all((t.path[-1], len(t.path) - 1) == (t.lexer, t.depth) for t in row.tokens)
    depth = 0
    for mark in re.findall("</?SPAN", row.html):
        depth += 1 if mark == "<SPAN" else -1
        assert depth >= 0
    assert depth == 0


def test_long_templates(spark):
    """Many islands in one string of the outer language, and one island of many parts."""
    n = 5_000
    got = lexed(spark, '<a b="' + "x{{ y }}" * n + '">z', "Twig", secondary="HTML")
    assert Counter(k for k, _ in got)["STRING_SINGLE"] == n + 1 and got[-1] == ("IGNORABLE", "z")
    got = lexed(spark, "<?php " + "f('?>'); // x\n" * n + "?>z", "PHP", secondary="HTML")
    assert Counter(k for k, _ in got)["STRING_SINGLE"] == n and got[-1] == ("IGNORABLE", "z")


def test_specs_by_row(spark):
    specs = ["PHP?start_inline=1", "Twig,HTML", "Twig?secondary=HTML", "JSON?x=1", "Nope", "php?secondary=php"]
    df = spark.createDataFrame([(s, "<b>{{ x }}</b>") for s in [*specs, "JSON"]] + [(None, "1"), (specs[0], None)], "spec string, text string")
    rows = tokenize_specs(df, "spec", specs).collect()
    assert [r.error for r in rows] == [None, None, None, "JSON has no option 'x'", rows[4].error, "PHP can't be its own secondary", "not among the specs: JSON", None, None]
    assert rows[4].error.startswith("no 'Nope' among ") and rows[1].tokens == rows[2].tokens and rows[8].tokens is None
    every = tokenize_specs(df, "spec").collect()
    assert [r.tokens for r in every[:6]] == [r.tokens for r in rows[:6]] and every[6].error is None and every[6].tokens
    with pytest.raises(ValueError):
        tokenize_specs(df, "spec", most=3)
    assert [t.lexer for t in rows[0].tokens] == ["PHP"] * len(rows[0].tokens) and "".join(t.text for t in rows[0].tokens) == "<b>{{ x }}</b>"


def test_marked_texts_are_gone_over_piece_by_piece():
    """Pieces are strings until their tokens are made; no pass over a marked text looks behind at each of its places; marks around pieces, marks without one and neighbours."""
    assert not any(f"(?<![^{STOP}])" in lex_sql(rule_set(name, None), name)[0]("x") for name in LEXER_NAMES)
    marked = chr(FIRST + 1) + "a" + chr(FIRST) * 2 + STOP + "b" + chr(FIRST) + STOP + chr(FIRST) + STOP + chr(FIRST) + "c" + chr(FIRST + 1) + chr(FIRST) + STOP
    assert re.sub(java(SPARE), r"\1\2", marked) == f"a{chr(FIRST)}{STOP}b{chr(FIRST)}{STOP}c{chr(FIRST + 1)}{STOP}"
    assert re.sub(java(TWINS), r"\1\3\4", marked.replace(chr(FIRST) + STOP + chr(FIRST) + STOP, chr(FIRST) + STOP)) == f"ab{chr(FIRST)}{STOP}c{chr(FIRST + 1)}{STOP}"


def java(pattern):
    """Characters by their codes, as Python writes them."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), pattern)
