import pytest

from lexigrain.functions import strings
from lexigrain.operators import render, routing
from lexigrain.sources.files import read_cases, read_routed, read_sources, write_documents, write_rendered
from lexigrain.streaming.highlight import read_stream, rendered_stream, windowed_type_counts
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text,want", [("a\r\n", "a"), ("a\n\n", "a\n"), ("a\x0b", "a"), ("a", "a"), ("", "")])
def test_chomp(spark, text, want):
    assert one(spark, strings.chomp(F.lit(text))) == want


def test_strings(spark):
    x = F.lit("héllo")
    assert one(spark, strings.insert(x, 1, "__")) == "h__éllo"
    assert one(spark, strings.delete(x, 1, 2)) == "hlo"
    assert one(spark, strings.subreplace(x, "*", 0, 3)) == "*lo"
    assert one(spark, strings.json_quoted(F.lit('a"/\\\n'))) == '"a\\"\\/\\\\\\n"'
    assert one(spark, strings.find(x, "LL", fold=True)) == 2 and one(spark, strings.find(x, "z")) is None
    assert one(spark, strings.equal_fold(F.lit("É"), F.lit("é"))) is False
    assert one(spark, strings.formatted("%s-%s", F.lit("a"), F.lit(1))) == "a-1"


@pytest.mark.parametrize("text,number,flag", [("", 0, True), ("on", 0, True), ("OFF", 0, False), (" -7x", -7, True), ("0", 0, False), ("x", 0, False), ("99999999999", 0, False)])
def test_options(spark, text, number, flag):
    assert (one(spark, strings.as_int(F.lit(text))), one(spark, strings.as_bool(F.lit(text)))) == (number, flag)


@pytest.mark.parametrize("data,name", [(b"\xef\xbb\xbfa", "UTF-8"), (b"\xff\xfe\0\0", "UTF-32LE"), (b"\0\0\xfe\xff", "UTF-32BE"), (b"\xff\xfea\0", "UTF-16LE"), (b"\xfe\xff\0a", "UTF-16BE"), (b"a\0b\0", "UTF-16LE"), (b"\0\0\0a", "UTF-32BE"), (b"abc", "UTF-8"), (b"\xc3(", None)])
def test_encoding(spark, data, name):
    assert one(spark, strings.guess_encoding(F.lit(data))) == name


def test_utf8(spark):
    assert one(spark, strings.first_bad_utf8(F.lit(b"ab\xc3("))) == 2
    assert one(spark, strings.first_bad_utf8(F.lit(b"ab"))) is None
    assert one(spark, strings.to_utf8(F.lit("é".encode("utf-16-be")), F.lit("UTF-16BE"))) == "é"
    assert one(spark, strings.is_binary(F.lit(b"x" * 1023 + b"\0"))) is True
    assert one(spark, strings.is_binary(F.lit(b"x" * 1024 + b"\0"))) is False


def test_sources(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.py").write_text("x = 1\n")
    (tmp_path / "in/sub/b").write_bytes(b"\xef\xbb\xbf<?xml?>")
    (tmp_path / "in/c.bin").write_bytes(b"a\0b")
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.text, r.lexer) for r in read_routed(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.py": ("UTF-8", "x = 1\n", "Python"), "b": ("UTF-8", "<?xml?>", "XML")}
    assert read_sources(spark, str(tmp_path / "in"), glob="*.py").count() == 1
    write_rendered(spark.createDataFrame([("é",)], "rendered string"), str(tmp_path / "out"), encoding="UTF-8")
    assert spark.read.text(str(tmp_path / "out")).first().value == "é"


def test_documents_and_encodings(spark, tmp_path):
    rows = [("“é”\nline two",), ("",), (None,), ("日",)]
    df = spark.createDataFrame(rows, "text string").repartition(2)
    write_documents(df, str(tmp_path / "docs"), encoding="windows-1252")
    files = sorted((tmp_path / "docs").glob("part-*"))
    assert sorted(f.read_bytes() for f in files) == sorted([b"\x93\xe9\x94\nline two\n", b"\n", b"\n", b"?\n"])
    found = {(r.encoding, r.text) for r in read_sources(spark, str(tmp_path / "docs")).collect()}
    assert found == {("windows-1252", "“é”\nline two\n"), ("UTF-8", "\n"), ("UTF-8", "?\n")}
    write_rendered(df.coalesce(1), str(tmp_path / "wide"), "text", encoding="UTF-16BE")
    (wide,) = (tmp_path / "wide").glob("part-*")
    assert sorted(wide.read_bytes().decode("utf-16-be").split("\n")) == sorted(["“é”", "line two", "", "", "日", ""])


def test_documents_are_dealt_to_all_cores(spark, tmp_path):
    """A file for each row of one partition, from as many tasks as there are cores; twice as many after a second write."""
    for turn in (1, 2):
        write_documents(spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("text")), str(tmp_path / "docs"))
        files = list((tmp_path / "docs").glob("part-*"))
        assert sorted(f.read_text() for f in files) == sorted([f"{k}\n" for k in range(40)] * turn)
    assert len({f.name.split("-")[1] for f in files}) == spark.sparkContext.defaultParallelism


def test_case_files(spark, tmp_path):
    (tmp_path / "x.ssc").write_text("--TEST--\nname\n--LEXER--\nphp\nstart_inline=1\nflag\n--SOURCE--\na\n\n--EXPECT--\nNAME: a\n")
    row = read_cases(spark, str(tmp_path)).first()
    assert (row.test, row.lexer.name, row.lexer.options, row.source, row.expect) == ("name", "php", {"start_inline": "1", "flag": ""}, "a\n", "NAME: a")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("[1]", "2024-01-01 00:10:00"), ("[2,3]", "2024-01-01 00:50:00"), ("true", "2024-01-01 01:10:00")], "text string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), rows.schema)
    query = rendered_stream(stream, "JSON", "Plain").writeStream.format("memory").queryName("rendered").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.rendered for r in spark.table("rendered").collect()} >= {"KEYWORD_CONSTANT: true"}
    query = windowed_type_counts(stream, "JSON", "at").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.window_start.hour, r.type): r.tokens for r in spark.table("counts").collect()}
    assert got == {(0, "PUNCTUATION"): 5, (0, "NUMBER_DECIMAL"): 3, (1, "KEYWORD_CONSTANT"): 1}


def test_bytes(spark):
    """The first bad byte, zero bytes and dumps, against Python's own view of the bytes."""
    data = [b"", b"abc", b"ab\xc3\x28cd", b"\xff", "é東𝒳".encode(), "é".encode() + b"\xe6\x9d", b"x" * 5_000 + b"\x80" + b"y" * 5_000, b"\xef\xbf\xbdok\xc0"]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(data)], "k int, d binary").select("k", strings.first_bad_utf8(F.col("d")).alias("bad"), strings.is_binary(F.col("d")).alias("zero")).collect()
    for r in rows:
        try:
            data[r.k].decode()
            assert r.bad is None
        except UnicodeDecodeError as problem:
            assert problem.start <= r.bad <= problem.end, data[r.k][:9]
        assert not r.zero
    zero = spark.createDataFrame([(b"\x00",), (b"a" * 1_023 + b"\x00",), (b"a" * 1_024 + b"\x00",), (b"\x10\x01",)], "d binary")
    assert [r[0] for r in zero.select(strings.is_binary(F.col("d"))).collect()] == [True, True, False, False]
    texts = ["plain\ttext\n", "é\x01𝒳\r", "", None, "\x7f"]
    dumped = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(render.dumped(F.col("t"))).collect()]
    assert dumped == ["plain\\ttext\\n", "0xc30xa90x010xf00x9d0x920xb3\\r", "", None, "0x7f"]


def test_shebang_with_many_arguments(spark):
    line = "#!/usr/bin/env " + "-x " * 3_000 + "python3 -u\nx"
    rows = spark.createDataFrame([(line,), ("#!/usr/bin/env\n",), ("#! /bin/sh -e\n",), ("<?xml",), ("",), (None,)], "t string").select(routing.guess(F.col("t")).alias("g")).collect()
    assert [r.g for r in rows] == ["Python", None, "Bash", "XML", None, None]
