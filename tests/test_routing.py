import pytest

from lexigrain.operators import routing
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "path,lexer",
    [("a/b.py", "Python"), ("X.HTML", "HTML"), ("dir/CMakeLists.txt", "CMake"), ("a.php5", "PHP"), ("a.php9", None), (".bashrc", "Bash"), ("/x/nginx.conf/", "Nginx"), ("a.c", "C"), ("a.h", "C"), ("notes.txt", "Text"), ("a.py.bak", None), ("", None)],
)
def test_by_filename(spark, path, lexer):
    assert spark.range(1).select(routing.by_filename(F.lit(path))).first()[0] == lexer


@pytest.mark.parametrize("path,name", [("", "."), ("/", "/"), ("///", "/"), ("a/b/", "b"), ("a", "a"), ("/a", "a")])
def test_basename(spark, path, name):
    assert spark.range(1).select(routing.basename(F.lit(path))).first()[0] == name


@pytest.mark.parametrize(
    "text,lexer",
    [
        ("#!/bin/sh\n", "Bash"),
        ("#! /usr/bin/env -S python3 -u\n", "Python"),
        ("#!/usr/bin/env nothing\n<?xml", None),
        ("#!/bin/foo\n<?php\necho 1;", "PHP"),
        ("<?xml version='1.0'?>", "XML"),
        ("﻿<!DOCTYPE html>", "XML"),
        ("Index: a", "Diff"),
        ("--- a", "Diff"),
        ("vcl 4.0;", "Varnish"),
        ("x engine=MyISAM x", "MySQL"),
        ("x engine=other! engine=MyISAM", None),
        ("<?=1", None),
        ("", None),
    ],
)
def test_guess(spark, text, lexer):
    assert spark.range(1).select(routing.guess(F.lit(text))).first()[0] == lexer


def test_route_precedence(spark):
    df = spark.createDataFrame([("<?php 1", "a.py"), ("<?php 1", "a.unknown"), ("x", "a.unknown"), (None, None)], "text string, path string")
    assert [r.lexer for r in routing.route(df, path_col="path", forced="Lua").collect()] == ["Python", "PHP", "Lua", "Lua"]
    assert [r.lexer for r in routing.route(df).collect()][2:] == ["Text", "Text"]


def test_names_and_types(spark):
    df = spark.createDataFrame([("JSON", "text/html"), ("pgsql", "TEXT/HTML"), ("js", "application/json"), ("", None), (None, "x")], "name string, mime string")
    got = routing.by_mime(routing.by_name(df, "name", "n"), "mime", "m").collect()
    assert sorted(((r.n, r.m) for r in got), key=str) == sorted([("JSON", "HTML"), ("PostgreSQL", None), ("Javascript", "JSON"), (None, None), (None, None)], key=str)


def test_specs(spark):
    row = spark.range(1).select(routing.lexer_spec(F.lit("php?secondary=html;flag&version=5=")).alias("a"), routing.lexer_spec(F.lit("php")).alias("b"), routing.lexer_spec(F.lit("php?a=b")).alias("c"), routing.lexer_group(F.lit("php?x=1,,html")).alias("g")).first()
    assert (row.a.name, row.a.options) == ("php", {"secondary": "html", "flag": "", "version": "5="})
    assert (row.b.name, row.b.options, row.c.options) == ("php", {}, {"a": "b"})
    assert [(s.name, s.options) for s in row.g] == [("php", {"x": "1"}), ("html", {})]
    assert routing.find_theme("MOLOKAI") == "Molokai" and routing.find_formatter("nope") is None
