from lexigrain.operators import render
from lexigrain.operators.hooks import BuiltIn, Hooks, rendered_with
from lexigrain.operators.render import Formatter, Style
from lexigrain.operators.tokens import tokens
from lexigrain.plans import catalog
from pyspark.sql import functions as F


def rendered(spark, text, lexer, formatter, **options):
    return spark.createDataFrame([(text,)], "text string").select(render.render(tokens(F.col("text"), lexer), formatter, **options)).first()[0]


def test_html(spark):
    assert rendered(spark, '{"a":1}', "JSON", "html") == '<pre><span class="p">{</span><span class="sd">"a"</span><span class="p">:</span><span class="md">1</span><span class="p">}</span></pre>'
    assert rendered(spark, "1", "JSON", "HTML", nowrap=True, noclasses=True) == '<span style="color: #af87ff;">1</span>'
    assert rendered(spark, "&<>", "Text", "HTML", cssclass="x") == '<pre class="x">&amp;&lt;&gt;</pre>'
    page = rendered(spark, "1", "JSON", "HTML", full=5, title="a<b")
    assert page.startswith("<!DOCTYPE html>\n<html>\n  <head>\n    <title>a&lt;b</title>") and page.endswith("</pre>\n  </body>\n</html>") and ".md, " in page
    assert rendered(spark, "<style>a</style>", "HTML", "HTML", nowrap=True) == '<span class="nt">&lt;style&gt;</span><SPAN class="CSS"><span class="k">a</span></SPAN><span class="nt">&lt;/style&gt;</span>'


def test_other_formats(spark):
    assert rendered(spark, "1", "JSON", "Terminal") == "\x1b[38;2;175;135;255m1\x1b[39;49;00m"
    assert rendered(spark, "1", "JSON", "Terminal", mode256=True) == "\x1b[38;5;141m1\x1b[39;49;00m"
    assert rendered(spark, "true", "JSON", "BBCode", codetag=True) == "[code][b][color=#66d9ef]true[/color][/b][/code]"
    rtf = rendered(spark, "1{", "JSON", "RTF")
    assert rtf.startswith("{\\rtf1") and rtf.endswith(" 1}\\{}") and rtf.count("{") - rtf.count("\\{") == rtf.count("}")
    assert rendered(spark, "1\n\x01", "JSON", "Plain") == "NUMBER_DECIMAL: 1\nIGNORABLE: \\n0x01"
    assert rendered(spark, None, "JSON", "HTML") is None
    assert rendered(spark, "", "JSON", "HTML") == "<pre></pre>"


def test_users_formatter_and_theme(spark):
    mine = Formatter("[", "]", {"NUMBER_DECIMAL": "<"}, {"NUMBER_DECIMAL": ">"}, F.upper)
    assert rendered(spark, "[1,x]", "JSON", mine) == "[[<1>,X]]"
    inherited = render.html(nowrap=True)
    inherited.before["NUMBER_DECIMAL"] = "<i>"
    assert rendered(spark, "1", "JSON", inherited) == "<i>1</span>"
    styles = {"NUMBER_DECIMAL": Style("#010203", bold=True)}
    assert rendered(spark, "1", "JSON", render.bbcode(styles=styles)) == "[b][color=#123]1[/color][/b]"
    table = catalog.theme_styles(spark).unionByName(render.user_theme(spark, "Mine", styles))
    css = {r.theme: r.css for r in render.css(table, catalog.token_types(spark)).collect()}
    assert css["Mine"] == ".md {\n  color: #010203;\n  font-weight: bold;\n}\n"
    assert css["Molokai"] == render.css_text(render.theme("molokai"))
    assert css["Molokai"].startswith(".er {\n  background-color: #403d3d;\n  color: #f8f8f2;\n}\n.o, .kn {\n")


def test_colours(spark):
    row = spark.range(1).select(*(render.parse_colour(F.lit(t)).alias(n) for n, t in (("a", "#fA0"), ("b", "#010203"), ("c", "#12345"), ("d", "red")))).first()
    assert (tuple(row.a), tuple(row.b), row.c, row.d) == ((255, 170, 0), (1, 2, 3), None, None)
    colours = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (175, 135, 255)], "r int, g int, b int")
    got = {r.r: r.idx for r in render.nearest_palette(colours, catalog.palette256(spark)).collect()}
    assert got == {0: 0, 255: 15, 175: 141}
    assert {r.idx: (r.r, r.g, r.b) for r in catalog.palette256(spark).collect()} == dict(enumerate(render.steps256()))


def test_catalog(spark):
    assert catalog.token_types(spark).count() == 58 and len(catalog.LEXER_NAMES) == 25
    up = {(r.name, r.ancestor): r.distance for r in catalog.token_ancestors(spark).collect()}
    assert up["NAME_VARIABLE_GLOBAL", "NAME"] == 2 and ("STRING_DOUBLE", "STRING") not in up
    docs = {(r.kind, r.owner): r.markdown for r in catalog.documentation(spark).collect()}
    assert len(docs) == 30 and "| secondary | lexer | null/none |" in docs["lexer", "Twig"] and "Alias" not in docs["lexer", "C"]


def test_hooks_in_python(spark):
    class Own(Hooks):
        def start_token(self, type_):
            return f"<{type_}>"

        def write_token(self, text):
            return None if text == "x" else text

        def start_lexing(self, lexer):
            return f"({lexer}"

        def end_lexing(self, lexer):
            return f"{lexer})"

        def start_document(self):
            return "^"

        def end_document(self):
            return "$"

    class Louder(BuiltIn):
        def write_token(self, text):
            return super().write_token(text).upper()

    df = spark.createDataFrame([("<style>a{b:x}</style>x",), (None,), ("",)], "text string")
    lexed = df.select(tokens(F.col("text"), "HTML").alias("tokens"))
    got = [tuple(r) for r in rendered_with(lexed.withColumn("built_in", render.render(F.col("tokens"), "HTML", nowrap=True)), own=Own(), louder=Louder("HTML", nowrap=True)).select("own", "louder", "built_in").collect()]
    assert got[0][0] == "^<NAME_TAG><style>(CSS<KEYWORD>a<PUNCTUATION>{<KEYWORD>b<KEYWORD_PSEUDO>:x<PUNCTUATION>}CSS)<NAME_TAG></style><IGNORABLE>$"
    assert got[0][1].lower() == got[0][2].lower() and "&LT;STYLE&GT;" in got[0][1] and '<SPAN class="CSS">' in got[0][1]
    assert got[1:] == [(None, None, None), ("^$", "", "")]
