"""Queries over the test tables, one or more for each group of operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain import api
from lexigrain.functions import encodings as encodings_of
from lexigrain.functions import strings
from lexigrain.operators import render, routing
from lexigrain.operators.hooks import BuiltIn, Hooks, rendered_with
from lexigrain.operators.lexing import cut
from lexigrain.operators.tokens import coalesce_rows, explode_spans, explode_tokens, sample_tokens, tokenize, tokenize_by, tokenize_specs, tokens, type_counts
from lexigrain.plans import catalog, catalog_sql
from lexigrain.plans.goldens import EMBEDDED, TEMPLATES, golden_rows
from lexigrain.sources import files


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """Columns of a table whose texts are to be lexed. Lexing takes time where a table may be one small file:
    with fewer files than cores the rows are dealt to all cores; larger tables are lexed where they are."""
    table = read(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    rows = table.select(*columns)
    return rows if len(table.inputFiles()) >= cores else rows.repartition(cores)


def long(c: Column) -> Column:
    return c.cast("long")


# Lexing: JSON of events, markup of pages, statements and patches made from orders


def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the events' properties by type."""
    return type_counts(tokenize(sources(spark, sf_dir, "events", "props"), "JSON", "props")).select("type", "tokens", "chars")


def json_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every event with its place."""
    spans = explode_spans(tokenize(sources(spark, sf_dir, "events", "event_id", "props"), "JSON", "props"), "event_id")
    return spans.select("event_id", long(F.col("seq")).alias("seq"), "type", "start", "end", "text")


def json_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single characters of the properties by kind, joined to runs: gaps and islands as rows."""
    pieces = cut(F.col("props"), ["[0-9]", "[a-z]"])
    rows = read(spark, sf_dir, "events").select("event_id", F.posexplode(pieces).alias("seq", "p"))
    kind = F.when(F.col("p.n") == 0, "NUMBER").when(F.col("p.n") == 1, "NAME").otherwise("IGNORABLE")
    rows = rows.select("event_id", "seq", F.lit("x").alias("lexer"), F.lit(0).alias("depth"), kind.alias("type"), F.col("p.text").alias("text"))
    runs = coalesce_rows(rows, "event_id")
    return runs.groupBy("type", "text").agg(F.count("*").alias("runs"))


def json_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of ``json_runs`` that aren't digits."""
    return json_runs(spark, sf_dir).where("type <> 'NUMBER'")


def json_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by day of the event and type."""
    rows = sources(spark, sf_dir, "events", "ts", "props").select(F.date_trunc("day", "ts").alias("day"), F.explode(tokens(F.col("props"), "JSON")).alias("t"))
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("t.type").alias("type")).agg(F.count("*").alias("tokens"))


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the pages by language (styles and scripts are their own) and type: the flagship."""
    return type_counts(tokenize(sources(spark, sf_dir, "pages", "html"), "HTML", "html"))


def page_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute names with values in the tags of pages."""
    rows = explode_tokens(tokenize(sources(spark, sf_dir, "pages", "page_id", "html"), "HTML", "html"), "page_id")
    names = rows.where("type = 'NAME_ATTRIBUTE' and text like '%='").select(F.rtrim(F.regexp_replace("text", r"\s*=\s*$", "")).alias("attribute"))
    return names.groupBy("attribute").agg(F.count("*").alias("uses"))


def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose tokens don't spell them: none."""
    rows = tokenize(sources(spark, sf_dir, "pages", "html").where("html is not null"), "HTML", "html")
    spelled = F.array_join(F.transform("tokens", lambda t: t["text"]), "")
    return rows.agg(F.count("*").alias("pages"), F.count_if(spelled != F.col("html")).alias("broken"))


def page_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the scripts of pages: in how many pages and how often."""
    rows = explode_tokens(tokenize(sources(spark, sf_dir, "pages", "page_id", "html"), "HTML", "html"), "page_id")
    return rows.where("lexer = 'Javascript' and type = 'NAME_VARIABLE'").groupBy("text").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("uses"))


def statement(quote: str = "'") -> Column:
    return F.concat(F.lit("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = "), F.col("o_custkey").cast("string"), F.lit(f" AND o_orderstatus = {quote}"), F.col("o_orderstatus"), F.lit(f"{quote} -- "), F.col("o_orderpriority"))


def sql_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of one statement for each order, in two dialects, of which one scan makes both."""
    orders = sources(spark, sf_dir, "orders", statement().alias("text"))
    both = F.concat(*(tokens(F.col("text"), lexer) for lexer in ("PostgreSQL", "MySQL")))
    return type_counts(orders.select(both.alias("tokens"))).select("lexer", "type", "tokens", "chars")


def sql_uppercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with their keywords in upper case."""
    orders = sources(spark, sf_dir, "orders", "o_orderkey", F.concat(F.lit("select o_orderkey from orders where o_custkey = "), F.col("o_custkey").cast("string")).alias("text"))
    rows = tokenize(orders, "PostgreSQL", uppercase_keywords=True)
    return rows.select("o_orderkey", F.array_join(F.transform("tokens", lambda t: t["text"]), "").alias("text"))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches made from orders: lines by kind."""
    lines = F.concat(F.lit("Index: o"), F.col("o_orderkey").cast("string"), F.lit("\n--- a\n+++ b\n@@ 1 @@\n-"), F.col("o_orderstatus"), F.lit("\n+"), F.col("o_orderpriority"), F.lit("\n end\n"))
    return type_counts(tokenize(sources(spark, sf_dir, "orders", lines.alias("text")), "Diff")).select("type", "tokens", "chars")


#: A source for each language, to be filled with a key and a name.
SOURCES = {
    "Apache": "<Directory /%s>\n  # %s\n  Options None\n</Directory>\n",
    "Bash": "for i in %s; do\n  echo \"$i %s\" # c\ndone\n",
    "C": "#include <a.h>\nint f%s(void) { return 0x1F; } /* %s */\n",
    "CMake": "add_library(l%s ${SRC}) # %s\n",
    "CSS": ".c%s { color: red; } /* %s */\n",
    "DTD": "<!ELEMENT e%s (a|b)*><!-- %s -->\n",
    "Diff": "diff a%s\n-%s\n+b\n",
    "EEX": "<p><%%= x%s %%></p><%%# %s %%>\n",
    "ERB": "<p><%%= @x%s %%></p><%%# %s %%>\n",
    "Elixir": "def f%s, do: :ok # %s\n",
    "Go": "func f%s() { return nil } // %s\n",
    "HTML": "<p class=\"c%s\">%s<script>var x = 1;</script></p>\n",
    "JSON": "{\"k\": %s, \"v\": \"%s\"}\n",
    "Javascript": "function f%s() { return \"%s\\n\"; }\n",
    "Lua": "local x%s = [[%s]] -- c\n",
    "MySQL": "select `a` from t where k = %s and v = '%s'\n",
    "Nginx": "server { listen %s; server_name %s; }\n",
    "PHP": "<?php echo \"x%s\\n\"; // %s\n?>\n",
    "PostgreSQL": "select a from t where k = %s and v = '%s'\n",
    "Python": "def f%s():\n    return '%s' # c\n",
    "Ruby": "def f%s\n  @y = '%s' # c\nend\n",
    "Text": "%s %s\n",
    "Twig": "{%% if a%s %%}{{ b }}{%% endif %%}{# %s #}\n",
    "Varnish": "sub vcl_recv { set req.url = \"%s\"; } # %s\n",
    "XML": "<?xml version=\"1.0\"?><a b=\"%s\">%s</a>\n",
}


def all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language a source for each supplier: tokens, characters and sources that don't come out
    whole (none)."""
    suppliers = sources(spark, sf_dir, "supplier", "s_suppkey", F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("name"))
    out = None
    for lexer, source in SOURCES.items():
        rows = tokenize(suppliers.select(F.format_string(source, F.col("s_suppkey").cast("string"), "name").alias("text")), lexer)
        spelled = F.array_join(F.transform("tokens", lambda t: t["text"]), "")
        counts = rows.agg(F.lit(lexer).alias("lexer"), F.sum(long(F.length("text"))).alias("chars"), F.count_if(spelled != F.col("text")).alias("broken"), F.count_if(F.size("tokens") > 0).alias("sources"))
        out = counts if out is None else out.unionByName(counts)
    return out


def golden_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden source of each language, filled with each supplier's key and a name, token by token."""
    texts: dict[str, str] = {}
    for language, _, _, _, text in golden_rows():
        texts[language] = texts.get(language, "") + text
    suppliers = sources(spark, sf_dir, "supplier", long(F.col("s_suppkey")).alias("s_suppkey"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("name"))
    out = None
    for language, text in texts.items():
        lexer, _, variant = language.partition("?")
        filled = F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{n}"), F.col("name"))
        rows = explode_tokens(tokenize(suppliers.select("s_suppkey", filled.alias("text")), lexer, **({variant: True} if variant else {})), "s_suppkey")
        rows = rows.select("s_suppkey", F.lit(language).alias("language"), long(F.col("seq")).alias("seq"), "lexer", "type", "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, language, tokens): templates in markup, and markup with other languages, made around a name that each
    page's URL gives."""
    name = F.concat(F.lit("u"), F.regexp_replace("url", "[^a-z0-9]", ""))
    pages = sources(spark, sf_dir, "pages", "page_id", name.alias("u"))
    made = []
    for language, found in EMBEDDED.items():
        text = F.replace(F.lit("".join(t for *_, t in found)), F.lit("{u}"), F.col("u"))
        lexer = language.split()[0]
        options = {"secondary": "HTML"} if lexer in TEMPLATES else {}
        made.append(F.struct(F.lit(language).alias("language"), tokens(text, lexer, **options).alias("tokens")))
    return pages.select("page_id", F.inline(F.array(*made)))


def embedded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of them, with the languages that it stands in."""
    rows = explode_tokens(embedded(spark, sf_dir), "page_id", "language")
    return rows.select("page_id", "language", long(F.col("seq")).alias("seq"), F.array_join("path", "/").alias("path"), "type", "text")


def embedded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of embedded languages in their HTML: how many, and in how many pages they don't balance."""
    marks = F.regexp_extract_all(render.render(F.col("tokens"), "HTML"), F.lit("</?SPAN"), F.lit(0))
    level = F.aggregate("marks", F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda a, m: F.struct((a["now"] + F.when(m == "<SPAN", 1).otherwise(-1)).alias("now"), F.least(a["least"], a["now"] + F.when(m == "<SPAN", 1).otherwise(-1)).alias("least")))
    rows = embedded(spark, sf_dir).select("language", marks.alias("marks")).withColumn("level", level)
    return rows.groupBy("language").agg(F.count("*").alias("pages"), F.sum(long(F.size(F.filter("marks", lambda m: m == "<SPAN")))).alias("spans"), F.count_if(F.expr("level.now <> 0 or level.least < 0")).alias("unbalanced"))


def keywords_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the word lists, lexed where they can stand: one for each order, as its key tells. Words by list and
    type, and how often."""
    places = {"directives": "%s x;", "variables": "set $q %s;", "properties": "a { %s: x }", "values": "a { b: %s }"}
    listed = [(language, kind, word, places.get(kind, "%s") % word) for language, kind, _, words in catalog_sql.WORDS for word in words.split()]
    words = spark.createDataFrame([(k, *w) for k, w in enumerate(listed)], "k int, language string, list string, word string, source string")
    orders = sources(spark, sf_dir, "orders", (F.col("o_orderkey") % len(listed)).cast("int").alias("k"))
    rows = tokenize_by(orders.join(F.broadcast(words), "k"), "language", dict.fromkeys(w[0] for w in listed), "source")
    found = explode_tokens(rows, "language", "list", "word").where("text = word")
    return found.groupBy("language", "list", "type").agg(F.count_distinct("word").alias("words"), F.count("*").alias("uses"))


def long_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros, tags and strings of up to 20 parts, and of up to 2,000 for every hundredth key, as an order's key tells:
    their tokens by type."""
    key = F.col("o_orderkey")
    parts = F.when(key % 100 == 0, key * 37 % 2_000).otherwise(key * 37 % 20) + 1
    keys = sources(spark, sf_dir, "orders", parts.cast("int").alias("n"))
    made = {"C": ("#define A", " \\\n  x", "\nint y;"), "HTML": ("<p", " a='>'", ">x"), "Javascript": ('"', "\\\\", '"; var'), "Python": ("'", "\\x41a", "' if")}
    wanted = {"C": ("COMMENT_SINGLE", "KEYWORD"), "HTML": ("NAME_TAG", "NAME_ATTRIBUTE", "STRING_SINGLE"), "Javascript": ("STRING_DOUBLE", "SEQUENCE_ESCAPED", "KEYWORD"), "Python": ("STRING_SINGLE", "SEQUENCE_ESCAPED", "KEYWORD")}
    out = None
    for language, (before, part, after) in made.items():
        rows = tokenize(keys.select(F.concat(F.lit(before), F.repeat(F.lit(part), F.col("n")), F.lit(after)).alias("text")), language)
        counts = type_counts(rows).where(F.col("type").isin(*wanted[language])).select(F.lit(language).alias("language"), "type", "tokens")
        out = counts if out is None else out.unionByName(counts)
    return out


# Routing


def url_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", routing.basename(F.regexp_replace("url", "[?#].*$", "")).alias("name"))


def url_lexers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the pages by the end of their URL, else by what they contain."""
    pages = sources(spark, sf_dir, "pages", "html", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return routing.route(pages, "html", "path").groupBy("lexer").agg(F.count("*").alias("pages"))


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, lexer) for texts made from orders, by what their number leaves."""
    k = F.col("o_orderkey") % 8
    text = F.when(k == 0, "#!/usr/bin/env -S python3 -u\nx").when(k == 1, "#!/bin/sh\n<?php").when(k == 2, "#!/bin/foo\n<?php echo 1;").when(k == 3, "<?xml version='1'?>").when(k == 4, "--- a\n+++ b").when(k == 5, "vcl 4.0;").when(k == 6, "CREATE TABLE t () engine=InnoDB;").otherwise("plain")
    return sources(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.coalesce(routing.guess(text), F.lit("Text")).alias("lexer"))


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses for texts made from orders."""
    return guesses(spark, sf_dir)


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a byte order mark, a first line for the shell and surrogates in a JSON string, made from orders: tokens by
    type."""
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("\ufeff#!/bin/x "), key, F.lit('\n["\\uD835\\uDE3C\\uD835'), F.col("o_orderstatus"), F.lit('\\u0041", '), key, F.lit("]"))
    return type_counts(tokenize(sources(spark, sf_dir, "orders", text.alias("text")), "JSON")).select("type", "tokens", "chars")


def user_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's theme beside a built-in one that is found by its name in any case: their sheets, for the types of the events'
    tokens, and how many tokens each styles."""
    own = render.user_theme(spark, "Own", {"PUNCTUATION": render.Style(fg="#ff0000", bold=True), "STRING_DOUBLE": render.Style(bg="#000080", italic=True, underline=True), "NAME_TAG": render.Style(fg="#00ff00")})
    name = routing.find_theme("MONOKAI")
    styles = own.unionByName(catalog.theme_styles(spark).where(F.col("theme") == name))
    counts = json_types(spark, sf_dir).select("type", "tokens")
    sheets = render.css(styles.join(counts, "type", "left_semi"), catalog.token_types(spark), indent="  ")
    styled = styles.where("coalesce(fg, bg) is not null or bold or italic or underline").join(counts, "type").groupBy("theme").agg(F.sum("tokens").alias("styled"))
    return sheets.join(styled, "theme")


def named_lexers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, aliases and MIME types that orders' keys choose, in either case: to which lexers they lead, and for how
    many orders."""
    known = sorted(set(catalog.LEXER_NAMES) | {v for row in catalog.fields(catalog.LEXERS) for field in (row[1], row[3]) for v in field.split()})
    names = spark.createDataFrame(list(enumerate(known)), "k int, value string")
    key = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").select((key % len(known)).cast("int").alias("k"), (key % 2 == 0).alias("upper"))
    asked = orders.join(F.broadcast(names), "k").select(F.when(F.col("upper"), F.upper("value")).otherwise(F.col("value")).alias("value"))
    both = routing.by_mime(routing.by_name(asked, "value", "named"), "value", "typed")
    return both.groupBy("value", "named", "typed").agg(F.count("*").alias("orders"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexer specs made from orders, taken apart: options and their values, and how often."""
    spec = F.concat("o_orderstatus", F.lit("?key="), F.col("o_orderkey").cast("string"), F.lit(";flag&priority="), F.col("o_orderpriority"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", routing.lexer_spec(spec).alias("s"))
    return rows.select("o_orderkey", "s.name", F.explode("s.options").alias("option", "value"))


#: Specs of lexers with options, two that no lexer has, and a text for each.
ROW_SPECS = [
    ("PHP?start_inline=1", "echo 1;"), ("php?start_inline=off&short_open_tag=on", "a<? echo 1; ?>"), ("PostgreSQL?uppercase_keywords", "select 1"), ("mysql?ansi_quotes=1;no_backslash_escapes", 'select "a\\"'),
    ("Varnish?version=4", "bereq.method"), ("Varnish", "bereq.method"), ("twig?secondary=HTML", "<b>{{ x }}</b>"), ("Twig,HTML", "<b>{{ y }}</b>"), ("JSON", "[1]"), ("JSON?unknown=1", "[1]"), ("Nothing", "[1]"),
]


def row_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexer with options of its own for each order, chosen by its key: tokens by spec and type, and what is wrong with
    the specs that can't be used."""
    table = F.array(*(F.struct(F.lit(spec).alias("spec"), F.lit(text).alias("text")) for spec, text in ROW_SPECS))
    orders = sources(spark, sf_dir, "orders", table[(F.col("o_orderkey") % len(ROW_SPECS)).cast("int")].alias("x")).select("x.*")
    rows = tokenize_specs(orders, "spec", [spec for spec, _ in ROW_SPECS])
    found = rows.select("spec", F.col("error"), F.explode_outer("tokens").alias("t"))
    return found.groupBy("spec", F.col("t.type").alias("type"), "error").agg(F.count("*").alias("tokens"))


# Files


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each supplier, in one of three encodings or with a zero byte, written to the shared folder and read
    back: files by encoding and language, and their characters."""
    key = F.col("s_suppkey")
    head = F.element_at(F.array(F.lit("<?php echo 1; // "), F.lit("#!/usr/bin/python\n# "), F.lit("<?xml version='1'?>\n"), F.lit("plain\x00 ")), (key % 4 + 1).cast("int"))
    said = F.when(key % 3 == 0, "\u0434\u043e\u043c\u0430").otherwise("\u00e9l\u00e8ve")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(head, said, F.lit("\n"), "s_name").alias("text"))
    folder = files.shared_folder(spark)
    for k, encoding in enumerate(("windows-1251", "UTF-8", "ISO-8859-1")):
        files.write_documents(rows.where(key % 3 == k), folder, encoding=encoding)
    found = routing.route(files.read_sources(spark, folder, glob="*.txt"))
    return found.groupBy("encoding", "lexer").agg(F.count("*").alias("files"), F.sum(long(F.length("text"))).alias("chars"))


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case file for each supplier, written to the shared folder and read back."""
    name, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("--TEST--\n"), name, F.lit("\n--LEXER--\nPHP\nversion="), key, F.lit("\nstart_inline\n--FORMATTER--\nPlain\n--SOURCE--\necho "), key, F.lit(";\n\n// "), name, F.lit("\n--EXPECT--\nKEYWORD: echo"))
    folder = files.shared_folder(spark)
    files.write_documents(read(spark, sf_dir, "supplier").select(text.alias("text")), folder)
    cases = files.read_cases(spark, folder, "*.txt")
    return cases.select("test", "lexer.name", F.col("lexer.options")["version"].alias("version"), F.col("lexer.options")["start_inline"].alias("start_inline"), "formatter", "source", "expect")


# Rendering


def events_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir, "events", "event_id", "props").select("event_id", render.render(tokens(F.col("props"), "JSON"), "HTML").alias("html"))


def events_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir, "events", "event_id", "props").select("event_id", render.render(tokens(F.col("props"), "JSON"), "Plain").alias("plain"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every formatter over the pages: the sizes of what comes out."""
    lexed = tokens(F.col("html"), "HTML")
    rows = sources(spark, sf_dir, "pages", "page_id", "html").select("page_id", lexed.alias("t"))
    made = {"bbcode": render.bbcode(codetag=True), "html": render.html(full=5, title="a & b"), "html_styles": render.html("Monokai", noclasses=True), "rtf": render.rtf(), "terminal": render.terminal(), "terminal_256": render.terminal(mode256=True)}
    return rows.select("page_id", *(long(F.length(f.render(F.col("t")))).alias(name) for name, f in made.items()))


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through the public functions: rendered by name with options, and the lexers that names, file names and contents
    lead to."""
    events = sources(spark, sf_dir, "events", "event_id", "props").withColumns({"path": F.concat(F.lit("/x/"), F.col("event_id").cast("string"), F.lit(".json")), "name": F.lit("json")})
    rows = api.highlight(events, "json", "html", text_col="props", cssclass="x", nowrap="off")
    rows = api.lexer_for_filename(api.lexer_by_name(rows, "name").withColumnRenamed("lexer", "named")).withColumnRenamed("lexer", "filed")
    return api.lexer_guess(rows, "props").select("event_id", "rendered", "named", "filed", F.col("lexer").alias("guessed"))


class Bracketed(Hooks):
    """``[type:text]`` for each token but those without a type of their own; strings are written with their length only."""

    def start_token(self, type_: str) -> str | None:
        self.type_ = type_
        return None if type_ == "IGNORABLE" else f"[{type_}:"

    def write_token(self, text: str) -> str | None:
        return str(len(text)) if self.type_ == "STRING_DOUBLE" else text

    def end_token(self, type_: str) -> str | None:
        return None if type_ == "IGNORABLE" else "]"

    def end_document(self) -> str | None:
        return "."


class Numbered(BuiltIn):
    """The HTML formatter with one hook of its own."""

    def write_token(self, text: str) -> str | None:
        return None if text.isdigit() else super().write_token(text)


def events_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as formatters with hooks in Python write them: one of its own, and HTML with one hook overridden."""
    lexed = tokens(F.col("props"), "JSON")
    rows = sources(spark, sf_dir, "events", "event_id", "props").select("event_id", lexed.alias("tokens"))
    return rendered_with(rows, bracketed=Bracketed(), html=Numbered("HTML", nowrap=True))


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup, JSON and plain escapes of what was said."""
    text = F.col("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(render.xml_escaped(text)).alias("xml"), F.md5(strings.json_quoted(text)).alias("json"))


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lexer, type, tokens, chars) of the pages; as many rows as there are pairs of a lexer and a type."""
    return page_types(spark, sf_dir)


def theme_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The themes as style sheets, for the types of tokens that the pages have."""
    seen = page_tokens(spark, sf_dir).select("type").distinct()
    return render.css(catalog.theme_styles(spark).join(seen, "type", "left_semi"), catalog.token_types(spark), scope=".code")


def nearest_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palette entries nearest to colours made from parts."""
    k = F.col("p_partkey")
    colours = read(spark, sf_dir, "part").select((k * 37 % 256).cast("int").alias("r"), (k * 59 % 256).cast("int").alias("g"), (k * 83 % 256).cast("int").alias("b")).distinct()
    return render.nearest_palette(colours, catalog.palette256(spark))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours written in three, six and other numbers of digits."""
    text = F.concat(F.lit("#"), F.lower(F.hex("o_orderkey")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", render.parse_colour(text).alias("c"))
    return rows.select("o_orderkey", "c.r", "c.g", "c.b")


def sample_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each token type that the pages have, in its own style."""
    seen = page_tokens(spark, sf_dir).select(F.col("type").alias("name")).distinct()
    types = catalog.token_types(spark).join(seen, "name", "left_semi")
    return types.agg(render.render(sample_tokens(types), "HTML").alias("html"))


# Catalog


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' tokens by type and what is above it; types without tokens too."""
    counts = page_tokens(spark, sf_dir).groupBy(F.col("type").alias("name")).agg(F.sum("tokens").alias("tokens"))
    rows = catalog.token_ancestors(spark).join(counts, "name", "left")
    return rows.select("name", "ancestor", "distance", F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))


def lexer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, patterns and types of all lexers, with the pages' tokens of each."""
    counts = page_tokens(spark, sf_dir).groupBy("lexer").agg(F.sum("tokens").alias("tokens"))
    return catalog.lexer_keys(spark).join(counts, "lexer", "left").select("ord", "lexer", "kind", "pos", "value", F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))


def texts_by_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guesses(spark, sf_dir).groupBy(F.col("lexer").alias("owner")).agg(F.count("*").alias("texts"))


def option_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All options, with the texts that are guessed to be of their lexer."""
    rows = catalog.options(spark).join(texts_by_lexer(spark, sf_dir), "owner", "left")
    return rows.select("owner_kind", "owner", "name", "type", "default", F.coalesce("texts", F.lit(0).cast("long")).alias("texts"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation of lexers and formatters, with the texts that are guessed to be of each."""
    rows = catalog.documentation(spark).join(texts_by_lexer(spark, sf_dir), "owner", "left")
    return rows.select("kind", "owner", "ord", "markdown", F.coalesce("texts", F.lit(0).cast("long")).alias("texts"))


# Scalar functions


def option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", strings.as_int(text).alias("number"), strings.as_bool(text).alias("flag"))


def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    padded = F.concat(F.lit(" \t"), name, F.lit(" \r\n"))
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        strings.chomp(padded).alias("chomped"),
        strings.trim(padded).alias("trimmed"),
        strings.ltrim(padded).alias("left_trimmed"),
        strings.rtrim(padded).alias("right_trimmed"),
        strings.insert(name, 1, "__").alias("inserted"),
        strings.delete(name, 1, 2).alias("deleted"),
        strings.subreplace(name, "*", 0, 3).alias("replaced"),
        strings.find(name, "a", fold=True).cast("long").alias("found"),
        strings.equal_fold(name, F.lower(name)).alias("same"),
        strings.starts_with(name, "Cust").alias("begins"),
        strings.ends_with(name, "9").alias("ends"),
        strings.formatted("%s/%05d", name, F.col("c_nationkey")).alias("printed"),
        F.lit(strings.VERSION).alias("version"),
        render.dumped(padded).alias("dumped"),
    )


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in five encodings: what is told, and whether they come back."""
    customers = read(spark, sf_dir, "customer").select("c_name")
    out = None
    for name, mark in (("UTF-8", "EFBBBF"), ("UTF-16LE", "FFFE"), ("UTF-16BE", "FEFF"), ("UTF-8", "")):
        data = F.concat(F.unhex(F.lit(mark)), F.encode("c_name", name))
        told = customers.select(F.lit(name).alias("written"), "c_name", strings.guess_encoding(data).alias("told"), strings.to_utf8(data, F.lit(name)).alias("text"), strings.is_binary(data).alias("binary"), strings.first_bad_utf8(F.concat(data, F.unhex(F.lit("C328")))).alias("bad"))
        out = told if out is None else out.unionByName(told)
    return out


#: For each written encoding: the texts' languages, and letters changed so that the texts have its script's.
LEGACY = [
    ("ISO-8859-1", "de fr es", "", ""), ("windows-1252", "de fr es", ".", "…"), ("ISO-8859-2", "en", "zlswk", "żłśęą"), ("windows-1250", "en", "zlswk", "žłšěř"),
    ("windows-1251", "en", "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшыжз"), ("KOI8-R", "en", "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшыжз"),
    ("UTF-8", "de fr es", "", ""), ("UTF-16LE", "en", "", ""),
]


def legacy_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in eight encodings, those with characters beyond ASCII: whether 95 % at least are told, and how many
    come back as they were, which are those of which the encoding has all characters."""
    docs = sources(spark, sf_dir, "documents", "lang", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    written = []
    for name, langs, old, new in LEGACY:
        text = F.translate("text", old, new) if old else F.col("text")
        written.append(F.when(F.col("lang").isin(*langs.split()), F.struct(F.lit(name).alias("written"), text.alias("text"), encodings_of.encoded(text, name).alias("data"))))
    rows = docs.select(F.inline(F.filter(F.array(*written), lambda x: x.isNotNull()))).where(F.col("text").rlike(r"[^\x00-\x7f]") | ((F.col("written") == "UTF-16LE") & (F.length("text") > 3)))
    rows = rows.select("written", "text", "data", encodings_of.detect_encoding(F.col("data"))["encoding"].alias("told"))
    back = encodings_of.to_text(F.col("data"), F.col("written")) == F.col("text")
    return rows.groupBy("written").agg(F.count("*").alias("texts"), (100 * F.count_if(F.col("told") == F.col("written")) >= 95 * F.count("*")).alias("mostly_told"), F.count_if(back).alias("back"))


ABC = "abcdefghijklmnopqrstuvwxyz"
KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
#: For each written encoding: letters changed so that English texts have its script's.
WIDE = [
    ("EUC-KR", ABC, "가나다라마바사아자차카타파하고노도로모보소오조초코토"), ("EUC-JP", ABC, KANA), ("Shift_JIS", ABC, KANA), ("ISO-2022-JP", ABC, KANA),
    ("Big5", ABC, "不中為主了人以來個們到國在地大子學我時是有的說這過就"), ("GB18030", ABC, "不中为主了人以来个们到国在地大子学我时是有的说这过就"),
    ("ISO-8859-5", ABC, "абцдефгхийклмнопярстувшыжз"), ("ISO-8859-7", ABC, "αβψδεφγηιξκλμνοπθρστυωώχύζ"), ("ISO-8859-8", ABC, "אבכדהפגחייקלמנופקרשתוווסיז"),
    ("ISO-8859-6", ABC, "ابكدهفغحيجكلمنوبقرستوفوخيز"), ("ISO-8859-9", "igsu", "ığşü"),
]


def wide_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents in the letters of eleven encodings' scripts: whether 95 % at least of those with such a letter are
    told, and how many come back as they were."""
    docs = sources(spark, sf_dir, "documents", F.lower("text").alias("text"), "lang").where((F.col("lang") == "en") & F.col("text").rlike("[a-z]"))
    texts = F.array(*(F.struct(F.lit(name).alias("written"), F.translate("text", old, new).alias("text")) for name, old, new in WIDE))
    rows = docs.select(F.inline(texts)).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    rows = rows.withColumn("data", encodings_of.to_bytes(F.col("text"), F.col("written")))
    rows = rows.select("written", "text", encodings_of.detect_encoding(F.col("data"))["encoding"].alias("told"), encodings_of.to_text(F.col("data"), F.col("written")).alias("back"))
    return rows.groupBy("written").agg(F.count("*").alias("texts"), (100 * F.count_if(F.col("told") == F.col("written")) >= 95 * F.count("*")).alias("mostly_told"), F.count_if(F.col("back") == F.col("text")).alias("back"))


QUERIES = {f.__name__: f for f in (json_types, json_spans, json_runs, json_islands, json_by_day, page_types, page_attributes, page_round_trip, page_identifiers, sql_types, sql_uppercase, diff_lines, all_languages, golden_tokens, embedded_tokens, embedded_spans, keywords_by_language, long_constructs, url_basename, url_lexers, guessed, marked_texts, user_themes, named_lexers, specs, row_specs, source_files, case_files, highlighted, events_hooks, events_html, events_plain, formats, escaped, theme_css, nearest_colours, colours, sample_document, ancestors, lexer_list, option_list, markdown, option_values, string_functions, encodings, legacy_encodings, wide_encodings)}

#: Tokens of the events' properties: pieces, their types, and neighbours of one type joined.
JSON = r"""
    with pieces as (select event_id, ts, regexp_extract_all(props, '"(?:[^"\\]|\\.)*"|[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+|[0-9]+[eE][+-]?[0-9]+|[0-9]+|true|false|null|(?s:.)') as l from events),
    raw as (select event_id, ts, i, l[i] as text, case when l[i][1] = '"' then 'STRING_DOUBLE' when regexp_full_match(l[i], '[0-9]+') then 'NUMBER_DECIMAL' when regexp_matches(l[i], '^\.?[0-9]') then 'NUMBER_FLOAT' when l[i] in ('true', 'false', 'null') then 'KEYWORD_CONSTANT' when contains('{}[],:', l[i]) then 'PUNCTUATION' else 'IGNORABLE' end as type from pieces, unnest(range(1, len(l) + 1)) as u(i)),
    islands as (select *, sum(new) over (partition by event_id order by i) as island from (select *, case when type = lag(type) over (partition by event_id order by i) then 0 else 1 end as new from raw)),
    tokens as (select event_id, any_value(ts) as ts, island - 1 as seq, any_value(type) as type, string_agg(text, '' order by i) as text from islands group by event_id, island)"""

ORACLE_SQL = {
    "json_types": JSON + " select type, count(*) as tokens, sum(length(text))::bigint as chars from tokens group by type",
    "json_spans": JSON + """ select event_id, seq::bigint as seq, type, ("end" - length(text))::bigint as start, "end"::bigint as "end", text from (select *, sum(length(text)) over (partition by event_id order by seq) as "end" from tokens)""",
    "json_runs": """
        with runs as (select unnest(regexp_extract_all(props, '[0-9]+|[a-z]+|[^0-9a-z]+')) as text from events)
        select case when regexp_matches(text, '^[0-9]') then 'NUMBER' when regexp_matches(text, '^[a-z]') then 'NAME' else 'IGNORABLE' end as type, text, count(*) as runs from runs group by all""",
    "json_islands": """
        with runs as (select unnest(regexp_extract_all(props, '[0-9]+|[a-z]+|[^0-9a-z]+')) as text from events)
        select case when regexp_matches(text, '^[a-z]') then 'NAME' else 'IGNORABLE' end as type, text, count(*) as runs from runs where not regexp_matches(text, '^[0-9]') group by all""",
    "json_by_day": JSON + " select strftime(ts, '%Y-%m-%d') as day, type, count(*) as tokens from tokens group by all",
    "page_attributes": """
        with bare as (select regexp_replace(html, '(?s)<!--.*?-->|<style.*?</style>|<script.*?</script>', '', 'g') as h from pages),
        tags as (select unnest(regexp_extract_all(h, '<[a-zA-Z!][^>]*>')) as tag from bare)
        select attribute, count(*) as uses from (select unnest(regexp_extract_all(regexp_replace(tag, '"[^"]*"', '""', 'g'), '([a-zA-Z:_-]+)\\s*=', 1)) as attribute from tags) group by attribute""",
    "page_round_trip": "select count(*) as pages, count_if(html is null)::bigint as broken from pages where html is not null",
    "page_identifiers": """
        with scripts as (select page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) as js from pages),
        names as (select page_id, unnest(regexp_extract_all(regexp_replace(js, '"[^"]*"', '', 'g'), '[$_a-zA-Z][$_a-zA-Z0-9]*')) as text from scripts)
        select text, count(distinct page_id) as pages, count(*) as uses from names where text not in ('var') group by text""",
    "sql_types": r"""
        with statements as (select o_orderkey as k, 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ' || o_custkey || ' AND o_orderstatus = ' || chr(39) || o_orderstatus || chr(39) || ' -- ' || o_orderpriority as s from orders),
        pieces as (select k, regexp_extract_all(s, '--[^\n]*|[\x27][^\x27]*[\x27]|[0-9]+|[A-Za-z_]+|\s+|(?s:.)') as l from statements),
        kinds as (select k, i, l[i] as text, case when starts_with(l[i], '--') then 'comment' when l[i][1] = chr(39) then 'string' when regexp_matches(l[i], '^[0-9]') then 'number' when l[i] in ('SELECT', 'FROM', 'WHERE', 'AND', '=', ',') then l[i] when regexp_matches(l[i], '^[A-Za-z_]') then 'name' else 'space' end as kind from pieces, unnest(range(1, len(l) + 1)) as u(i)),
        names(lexer, kind, type) as (values
            ('PostgreSQL', 'comment', 'COMMENT_SINGLE'), ('PostgreSQL', 'string', 'STRING_SINGLE'), ('PostgreSQL', 'number', 'NUMBER_DECIMAL'), ('PostgreSQL', 'name', 'IGNORABLE'), ('PostgreSQL', 'space', 'IGNORABLE'), ('PostgreSQL', '=', 'OPERATOR'), ('PostgreSQL', ',', 'OPERATOR'), ('PostgreSQL', 'SELECT', 'KEYWORD'), ('PostgreSQL', 'FROM', 'KEYWORD'), ('PostgreSQL', 'WHERE', 'KEYWORD'), ('PostgreSQL', 'AND', 'KEYWORD'),
            ('MySQL', 'comment', 'COMMENT_SINGLE'), ('MySQL', 'string', 'STRING'), ('MySQL', 'number', 'NUMBER'), ('MySQL', 'name', 'NAME'), ('MySQL', 'space', 'IGNORABLE'), ('MySQL', '=', 'OPERATOR'), ('MySQL', ',', 'PUNCTUATION'), ('MySQL', 'SELECT', 'KEYWORD'), ('MySQL', 'FROM', 'KEYWORD'), ('MySQL', 'WHERE', 'KEYWORD'), ('MySQL', 'AND', 'OPERATOR')),
        typed as (select lexer, k, i, text, type, case when type = lag(type) over (partition by lexer, k order by i) then 0 else 1 end as new from kinds join names using (kind))
        select lexer, type, sum(new)::bigint as tokens, sum(length(text))::bigint as chars from typed group by all""",
    "sql_uppercase": "select o_orderkey, 'SELECT o_orderkey FROM orders WHERE o_custkey = ' || o_custkey as text from orders",
    "diff_lines": """
        with lines as (select unnest(['Index: o' || o_orderkey, '--- a', '+++ b', '@@ 1 @@', '-' || o_orderstatus, '+' || o_orderpriority, ' end']) as line from orders),
        typed as (select case line[1] when '+' then 'GENERIC_INSERTED' when '-' then 'GENERIC_DELETED' when '@' then 'GENERIC_SUBHEADING' when 'I' then 'GENERIC_HEADING' else 'IGNORABLE' end as type, length(line) + 1 as n from lines)
        select type, count(*) as tokens, sum(n)::bigint as chars from typed group by type""",
    "url_basename": "select page_id, case when bare = '' then '/' else regexp_extract(bare, '[^/]*$') end as name from (select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') as bare from pages)",
    "url_lexers": "select case when regexp_matches(regexp_replace(url, '[?#].*$', ''), '[.]html/*$') then 'HTML' when contains(lower(html), '<?php') then 'PHP' when starts_with(html, '<?xml') or starts_with(html, '<!DOCTYPE') then 'XML' else 'Text' end as lexer, count(*) as pages from pages group by 1",
    "guessed": "select o_orderkey, ['Python', 'Bash', 'PHP', 'XML', 'Diff', 'Varnish', 'MySQL', 'Text'][o_orderkey % 8 + 1] as lexer from orders",
    "specs": "select o_orderkey, o_orderstatus as name, unnest(['key', 'flag', 'priority']) as option, unnest([o_orderkey::varchar, '', o_orderpriority]) as value from orders",
    "events_html": JSON + """ select event_id, '<pre>' || string_agg(case type when 'IGNORABLE' then text else '<span class="' || case type when 'STRING_DOUBLE' then 'sd' when 'NUMBER_DECIMAL' then 'md' when 'NUMBER_FLOAT' then 'mf' when 'PUNCTUATION' then 'p' else 'kc' end || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span>' end, '' order by seq) || '</pre>' as html from tokens group by event_id""",
    "events_hooks": JSON + """ select event_id, string_agg(case type when 'IGNORABLE' then text when 'STRING_DOUBLE' then '[STRING_DOUBLE:' || length(text) || ']' else '[' || type || ':' || text || ']' end, '' order by seq) || '.' as bracketed,
        string_agg(case type when 'IGNORABLE' then text else '<span class="' || case type when 'STRING_DOUBLE' then 'sd' when 'NUMBER_DECIMAL' then 'md' when 'NUMBER_FLOAT' then 'mf' when 'PUNCTUATION' then 'p' else 'kc' end || '">' || case when regexp_full_match(text, '[0-9]+') then '' else replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') end || '</span>' end, '' order by seq) as html from tokens group by event_id""",
    "source_files": """
        with s as (select s_suppkey % 3 as e, s_suppkey % 4 as k, length(s_name) as n from supplier where s_suppkey % 4 <> 3)
        select ['windows-1251', 'UTF-8', 'ISO-8859-1'][e + 1] as encoding, ['PHP', 'Python', 'XML'][k + 1] as lexer, count(*) as files,
               sum([17, 20, 20][k + 1] + case e when 0 then 4 else 5 end + n + 2)::bigint as chars from s group by all""",
    "case_files": """
        select s_name as test, 'PHP' as name, s_suppkey::varchar as version, '' as start_inline, 'Plain' as formatter, 'echo ' || s_suppkey || ';' || chr(10) || chr(10) || '// ' || s_name as source, 'KEYWORD: echo' as expect from supplier""",
    "highlighted": JSON + """ select event_id, '<pre class="x">' || string_agg(case type when 'IGNORABLE' then text else '<span class="' || case type when 'STRING_DOUBLE' then 'sd' when 'NUMBER_DECIMAL' then 'md' when 'NUMBER_FLOAT' then 'mf' when 'PUNCTUATION' then 'p' else 'kc' end || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span>' end, '' order by seq) || '</pre>' as rendered, 'JSON' as named, 'JSON' as filed, null::varchar as guessed from tokens group by event_id""",
    "events_plain": JSON + " select event_id, string_agg(type || ': ' || text, chr(10) order by seq) as plain from tokens group by event_id",
    "escaped": r"""
        select conv_id, turn, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as xml,
               md5('"' || replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), '/', '\/'), chr(8), '\b'), chr(12), '\f'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"') as json from conversations""",
    "nearest_colours": """
        with level as (select * from (values (0, 0), (1, 95), (2, 135), (3, 175), (4, 215), (5, 255)) t(k, v)),
        first as (select * from (values (0, 0, 0, 0), (1, 205, 0, 0), (2, 0, 205, 0), (3, 205, 205, 0), (4, 0, 0, 238), (5, 205, 0, 205), (6, 0, 205, 205), (7, 229, 229, 229), (8, 127, 127, 127), (9, 255, 0, 0), (10, 0, 255, 0), (11, 255, 255, 0), (12, 92, 92, 255), (13, 255, 0, 255), (14, 0, 255, 255), (15, 255, 255, 255)) t(idx, r, g, b)),
        palette as (select * from first union all select 16 + 36 * x.k + 6 * y.k + z.k, x.v, y.v, z.v from level x, level y, level z union all select 232 + k, 8 + 10 * k, 8 + 10 * k, 8 + 10 * k from range(24) t(k)),
        c as (select distinct p_partkey * 37 % 256 as r, p_partkey * 59 % 256 as g, p_partkey * 83 % 256 as b from part)
        select c.r::int as r, c.g::int as g, c.b::int as b, arg_min(idx, ((c.r - p.r) ** 2 + (c.g - p.g) ** 2 + (c.b - p.b) ** 2) * 1000 + idx)::int as idx from c, palette p group by all""",
    "colours": """
        with h as (select o_orderkey, lower(printf('%x', o_orderkey)) as h from orders),
        w as (select o_orderkey, case length(h) when 3 then h[1] || h[1] || h[2] || h[2] || h[3] || h[3] when 6 then h end as h from h)
        select o_orderkey, ('0x' || h[1:2])::int as r, ('0x' || h[3:4])::int as g, ('0x' || h[5:6])::int as b from w""",
    "option_values": "select o_orderkey, coalesce(try_cast(nullif(regexp_extract(o_orderpriority, '^\\s*([+-]?[0-9]+)', 1), '') as int), 0) as number, coalesce(try_cast(nullif(regexp_extract(o_orderpriority, '^\\s*([+-]?[0-9]+)', 1), '') as int), 0) <> 0 as flag from orders",
    "string_functions": r"""
        select c_custkey, ' ' || chr(9) || c_name || ' ' as chomped, c_name as trimmed, c_name || ' ' || chr(13) || chr(10) as left_trimmed, ' ' || chr(9) || c_name as right_trimmed,
               c_name[1] || '__' || c_name[2:] as inserted, c_name[1] || c_name[4:] as deleted, '*' || c_name[4:] as replaced,
               (nullif(instr(upper(c_name), 'A'), 0) - 1)::bigint as found, true as same, c_name[:4] = 'Cust' as begins, c_name[-1:] = '9' as ends, c_name || '/' || lpad(c_nationkey::varchar, 5, '0') as printed, '0.0.0' as version, ' \t' || c_name || ' \r\n' as dumped from customer""",
}
ORACLE_SQL |= catalog_sql.ORACLE_SQL
ORACLE_SQL["all_languages"] = f"""
    with {catalog_sql.values("sources", "lexer, source", ((k, v.replace("%%", "%")) for k, v in SOURCES.items()))},
    filled as (select lexer, length(source) - 4 + length(s_suppkey::varchar || 'S' || s_nationkey::varchar) as n from sources, supplier)
    select lexer, sum(n)::bigint as chars, 0::bigint as broken, count(*) as sources from filled group by lexer"""
ORACLE_SQL["marked_texts"] = """
    with o as (select length(o_orderkey::varchar) as n from orders)
    select type, sum(tokens)::bigint as tokens, sum(chars)::bigint as chars from (
        select unnest(['IGNORABLE', 'PUNCTUATION', 'STRING_DOUBLE', 'SEQUENCE_ESCAPED', 'ERROR', 'NUMBER_DECIMAL']) as type, unnest([2, 3, 3, 2, 1, 1]) as tokens, unnest([10 + n + 1, 3, 3, 18, 6, n]) as chars from o) group by type"""
ORACLE_SQL["user_themes"] = JSON + f""",
    {catalog_sql.TYPES}, {catalog_sql.STYLES}, own as (select 'Own' as theme, * from (values ('PUNCTUATION', '#ff0000', null, true, false, false), ('STRING_DOUBLE', null, '#000080', false, true, true)) t(type, fg, bg, bold, italic, underline)),
    every as (select * from own union all select * from styles where theme = 'Monokai'), counts as (select type, count(*) as n from tokens group by type),
    looks as (select every.*, id, cssclass, n from every join types on types.name = every.type join counts using (type) where fg is not null or bg is not null or bold or italic or underline),
    blocks as (select theme, min(id) as head, string_agg('.' || cssclass, ', ' order by id) || ' {{' || chr(10) || coalesce('    background-color: ' || bg || ';' || chr(10), '') || coalesce('    color: ' || fg || ';' || chr(10), '')
        || case when bold then '    font-weight: bold;' || chr(10) else '' end || case when italic then '    font-style: italic;' || chr(10) else '' end || case when underline then '    text-decoration: underline;' || chr(10) else '' end || '}}' || chr(10) as block
        from looks where cssclass <> ' ' group by theme, fg, bg, bold, italic, underline)
    select theme, css, styled from (select theme, string_agg(block, '' order by head) as css from blocks group by theme) join (select theme, sum(n)::bigint as styled from looks group by theme) using (theme)"""
#: (spec, type, tokens of one text, error)
ROW_SPEC_TOKENS = [
    ("PHP?start_inline=1", "KEYWORD", 1, None), ("PHP?start_inline=1", "IGNORABLE", 1, None), ("PHP?start_inline=1", "NUMBER_DECIMAL", 1, None), ("PHP?start_inline=1", "PUNCTUATION", 1, None),
    ("php?start_inline=off&short_open_tag=on", "IGNORABLE", 4, None), ("php?start_inline=off&short_open_tag=on", "NAME_TAG", 2, None), ("php?start_inline=off&short_open_tag=on", "KEYWORD", 1, None), ("php?start_inline=off&short_open_tag=on", "NUMBER_DECIMAL", 1, None), ("php?start_inline=off&short_open_tag=on", "PUNCTUATION", 1, None),
    ("PostgreSQL?uppercase_keywords", "KEYWORD", 1, None), ("PostgreSQL?uppercase_keywords", "IGNORABLE", 1, None), ("PostgreSQL?uppercase_keywords", "NUMBER_DECIMAL", 1, None),
    ("mysql?ansi_quotes=1;no_backslash_escapes", "KEYWORD", 1, None), ("mysql?ansi_quotes=1;no_backslash_escapes", "IGNORABLE", 1, None), ("mysql?ansi_quotes=1;no_backslash_escapes", "NAME", 1, None),
    ("Varnish?version=4", "NAME_VARIABLE", 1, None), ("Varnish", "IGNORABLE", 1, None), ("twig?secondary=HTML", "NAME_TAG", 4, None), ("twig?secondary=HTML", "IGNORABLE", 1, None), ("Twig,HTML", "NAME_TAG", 4, None), ("Twig,HTML", "IGNORABLE", 1, None),
    ("JSON", "PUNCTUATION", 2, None), ("JSON", "NUMBER_DECIMAL", 1, None), ("JSON?unknown=1", None, 1, "JSON has no option 'unknown'"), ("Nothing", None, 1, "no 'Nothing' among " + ", ".join(catalog.LEXER_NAMES)),
]
ORACLE_SQL["row_specs"] = f"""
    with {catalog_sql.values("specs", "k, spec", enumerate(spec for spec, _ in ROW_SPECS))}, {catalog_sql.values("found", "spec, type, n, error", ROW_SPEC_TOKENS)}
    select spec, type, error, sum(n)::bigint as tokens from orders join specs on k = o_orderkey % {len(ROW_SPECS)} join found using (spec) group by all"""
#: Texts of the documents as ``legacy_encodings`` writes them, and the characters that each encoding has.
ORACLE_SQL["legacy_encodings"] = f"""
    with {catalog_sql.values("pages", "written, langs, old, new, has", ((name, langs, old, new, encodings_of.upper_half(name) if name in encodings_of.CODE_PAGES else None) for name, langs, old, new in LEGACY))},
    rows as (select written, has, translate(lower(coalesce(text, '')), old, new) as text from documents join pages on list_contains(string_split(langs, ' '), lang))
    select written, count(*) as texts, true as mostly_told, count_if(has is null or translate(regexp_replace(text, '[\\x00-\\x7f]', '', 'g'), has, '') = '')::bigint as back
    from rows where regexp_matches(text, '[^\\x00-\\x7f]') or written = 'UTF-16LE' and length(text) > 3 group by written"""


def held(name: str, new: str) -> str | None:
    """The characters below U+3000 beyond ASCII, and those of ``new``, that an encoding has by Python's codec; None for all."""
    if name == "GB18030":
        return None
    there = lambda c: c.encode(name, "ignore").decode(name, "ignore") == c
    return "".join(c for c in [*map(chr, range(0x80, 0x3000)), *new] if there(c))


#: English texts as ``wide_encodings`` writes them.
ORACLE_SQL["wide_encodings"] = f"""
    with {catalog_sql.values("scripts", "written, old, new, has", ((name, old, new, held(name, new)) for name, old, new in WIDE))},
    rows as (select written, has, translate(lower(text), old, new) as text from documents, scripts where lang = 'en' and regexp_matches(lower(text), '[a-z]'))
    select written, count(*) as texts, true as mostly_told, count_if(has is null or translate(regexp_replace(text, '[\\x00-\\x7f]', '', 'g'), has, '') = '')::bigint as back
    from rows where regexp_matches(text, '[^\\x00-\\x7f]') group by written"""
