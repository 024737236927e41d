import pytest

from lexigrain import api
from lexigrain.operators.options import OptionError, checked, lexer_of, option
from lexigrain.operators.render import Formatter


def test_highlight(spark):
    df = spark.createDataFrame([("<b>{{ 1 }}</b>",)], "text string")
    assert api.highlight(df, ["twig", "html"], "plain").first().rendered == "NAME_TAG: <b>\nNAME_TAG: {{\nIGNORABLE:  \nNUMBER_DECIMAL: 1\nIGNORABLE:  \nNAME_TAG: }}\nNAME_TAG: </b>"
    assert api.highlight(df, "twig?secondary=html", "plain").first().rendered == api.highlight(df, ["twig", "html"], "plain").first().rendered
    assert api.highlight(spark.createDataFrame([("select",)], "text string"), "pgsql?uppercase_keywords=on", "BBCode", theme="monokai").first().rendered == "[b][color=#66d9ef]SELECT[/color][/b]"
    assert api.highlight(df, "Text", Formatter("<", ">")).first().rendered == "<<b>{{ 1 }}</b>>"
    assert api.sample(spark, "plain").first().rendered.startswith("EOS: EOS: end of stream\nIGNORABLE: \\n\n")


@pytest.mark.parametrize("lexers,formatter,options", [("nope", "HTML", {}), ("JSON?x=1", "HTML", {}), ("JSON", "nope", {}), ("JSON", "HTML", {"nope": 1}), ("JSON", "HTML", {"full": "x", "theme": "none"}), ("JSON", "HTML", {"full": True}), ("php?secondary=php", "HTML", {}), (["JSON", "HTML"], "HTML", {})])
def test_bad_options(spark, lexers, formatter, options):
    with pytest.raises(OptionError):
        api.highlight(spark.createDataFrame([("1",)], "text string"), lexers, formatter, **options)


def test_options():
    assert checked("lexer", "PHP", {"version": " 5x", "asp_tags": "", "short_open_tag": "off"}) == {"version": 5, "asp_tags": True, "short_open_tag": False}
    assert option("formatter", "HTML", "full") == ("int", "0")
    name, rules, found = lexer_of("mariadb?ansi_quotes=on&no_backslash_escapes=0")
    assert (name, rules.lexer, found) == ("MySQL", "MySQL", {"ansi_quotes": True, "no_backslash_escapes": False})


def test_files(spark, tmp_path):
    for name, text in (("a.json", "[1]"), ("b.py", "x = 1\n"), ("c", "plain"), ("d.php", "<?php echo 1;")):
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: (r.lexer, r.rendered) for r in api.highlight_files(spark, str(tmp_path), ["JSON", "Python", "PHP", "Text"], "Plain").collect()}
    assert got["a.json"] == ("JSON", "PUNCTUATION: [\nNUMBER_DECIMAL: 1\nPUNCTUATION: ]")
    assert got["c"] == ("Text", "IGNORABLE: plain") and got["d.php"][1].startswith("NAME_TAG: <?php") and got["b.py"][0] == "Python"


def test_lookups(spark):
    df = spark.createDataFrame([("x.rb", "vcl", "erb")], "path string, text string, name string")
    assert [f(df).first().lexer for f in (api.lexer_for_filename, api.lexer_guess, api.lexer_by_name)] == ["Ruby", "Varnish", "ERB"]
