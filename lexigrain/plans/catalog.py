"""The catalog as dimension tables: token types, lexers with their names and options, formatters, themes.

All of it is small and fixed, so each table is a local relation; joins with it are broadcast by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Token types as id order, "NAME<PARENT class: description"; class "-" is never styled.
TOKEN_TYPES = """
EOS -: end of stream
IGNORABLE -: ignorable like spaces
TEXT -: regular text
ERROR er: an invalid part
OPERATOR o: operator
PUNCTUATION p: syntax element like ';' in C
TAG_PREPROC tp: tag PI
NAME n: uncategorized name type
NAME_BUILTIN<NAME nb: builtin names; names that are available in the global namespace
NAME_BUILTIN_PSEUDO<NAME bp: builtin names that are implicit (`self` in Ruby, `this` in Java)
NAME_TAG<NAME nt: tag name
NAME_ENTITY<NAME ne: HTML/XML name entity
NAME_ATTRIBUTE<NAME na: tag attribute's name
NAME_FUNCTION<NAME nf: a function name
NAME_CLASS<NAME nc: a class name
NAME_CONSTANT<NAME nco: a constant name
NAME_NAMESPACE<NAME nn: a namespace name
NAME_VARIABLE<NAME v: variable name
NAME_VARIABLE_CLASS<NAME_VARIABLE vc: name of a class variable
NAME_VARIABLE_GLOBAL<NAME_VARIABLE vg: name of a global variable
NAME_VARIABLE_INSTANCE<NAME_VARIABLE vi: name of a variable instance
KEYWORD k: uncategorized keyword type
KEYWORD_DEFAULT<KEYWORD kd:
KEYWORD_BUILTIN<KEYWORD kb:
KEYWORD_CONSTANT<KEYWORD kc: a keyword that is constant
KEYWORD_DECLARATION<KEYWORD kd: a keyword used for variable declaration (`var` or `let` in Javascript)
KEYWORD_NAMESPACE<KEYWORD kn: a keyword used for namespace declaration (`namespace` in PHP, `package` in Java
KEYWORD_PSEUDO<KEYWORD kp: a keyword that is't really a keyword
KEYWORD_RESERVED<KEYWORD kr: a reserved keyword
KEYWORD_TYPE<KEYWORD kt: a builtin type (`char`, `int`, ... in C)
NUMBER m: uncategorized number type
NUMBER_FLOAT<NUMBER mf: float number
NUMBER_DECIMAL<NUMBER md: decimal number
NUMBER_IMAGINARY<NUMBER mi: imaginary number
NUMBER_BINARY<NUMBER mb: binary number
NUMBER_OCTAL<NUMBER mo: octal number
NUMBER_HEXADECIMAL<NUMBER mh: hexadecimal number
COMMENT c: uncategorized comment type
COMMENT_SINGLE<COMMENT cs: comment which ends at the end of the line
COMMENT_MULTILINE<COMMENT cm: multiline comment
COMMENT_DOCUMENTATION<COMMENT cd: comment with documentation value
STRING s: uncategorized string type
STRING_SINGLE ss: single quoted string
STRING_DOUBLE sd: double quoted string
STRING_BACKTICK sb: string enclosed in backticks
STRING_REGEX sr: regular expression
STRING_INTERNED si: interned string
SEQUENCE_ESCAPED es: escaped sequence in string like \\n, \\x32, \\u1234, etc
SEQUENCE_INTERPOLATED is: sequence in string for interpolated variables
LITERAL l: uncategorized literal type
LITERAL_SIZE<LITERAL ls: size literals (eg: 3ko)
LITERAL_DURATION<LITERAL ld: duration literals (eg: 23s)
GENERIC g:
GENERIC_STRONG<GENERIC gb: the token value as bold
GENERIC_HEADING<GENERIC gh: the token value is a headline
GENERIC_SUBHEADING<GENERIC gs: the token value is a subheadline
GENERIC_DELETED<GENERIC gd: marks the token value as deleted
GENERIC_INSERTED<GENERIC gi: marks the token value as inserted
"""

# Lexers in registry order, "name | aliases | file names | MIME types | interpreters".
LEXERS = """
Apache | apacheconf | httpd.conf apache.conf apache2.conf .htaccess | text/x-apacheconf |
Bash | shell sh | *.sh *.bash *.ebuild *.eclass .bashrc bashrc .bash_* bash_* PKGBUILD | application/x-sh application/x-shellscript | bash sh
C | | *.[ch] | text/x-chdr text/x-csrc |
CMake | | CMakeLists.txt *.cmake | text/x-cmake |
CSS | | *.css | text/css |
Diff | udiff | *.diff *.patch | text/x-diff text/x-patch |
DTD | | *.dtd | application/xml-dtd |
EEX | | *.eex | application/x-elixir-templating |
Elixir | | *.ex *.exs | text/x-elixir | elixir iex
ERB | | *.erb | application/x-ruby-templating |
Go | | *.go | text/x-gosrc |
HTML | | *.html | text/html |
Javascript | JS | *.js | text/javascript |
JSON | | *.json | application/json |
Lua | | *.lua | text/x-lua application/x-lua |
MySQL | mariadb | | text/x-mysql |
Nginx | nginxconf | nginx.conf | text/x-nginx-conf |
PHP | php3 php4 php5 php7 | *.php *.php[3457] *.inc | text/x-php application/x-httpd-php | php php-cli php[3457]*
PostgreSQL | pgsql postgre | | text/x-postgresql |
Python | | *.py | text/x-python application/x-python | python python[23]
Ruby | | *.rb | text/x-ruby application/x-ruby | ruby ruby[12]*
Text | txt | *.txt | text/plain |
Twig | | *.twig | application/x-twig text/html+twig |
Varnish | varnishconf VCL | *.vcl | text/x-varnish |
XML | | *.xml *.xsd | text/xml application/xml |
"""

# Options, "kind | owner | name | type | default".
OPTIONS = """
lexer | Diff | secondary | lexer |
lexer | EEX | secondary | lexer |
lexer | ERB | secondary | lexer |
lexer | MySQL | uppercase_keywords | bool | false
lexer | MySQL | ansi_quotes | bool | false
lexer | MySQL | no_backslash_escapes | bool | false
lexer | PHP | version | int | 7
lexer | PHP | asp_tags | bool | false
lexer | PHP | start_inline | bool | false
lexer | PHP | short_open_tag | bool | true
lexer | PHP | secondary | lexer |
lexer | PostgreSQL | uppercase_keywords | bool | false
lexer | PostgreSQL | standard_conforming_strings | bool | true
lexer | Twig | secondary | lexer |
lexer | Varnish | version | int | 3
formatter | BBCode | theme | theme |
formatter | BBCode | codetag | bool | false
formatter | BBCode | monofont | bool | false
formatter | HTML | full | int | 0
formatter | HTML | title | string |
formatter | HTML | nowrap | bool | false
formatter | HTML | noclasses | bool | false
formatter | HTML | theme | theme |
formatter | HTML | cssclass | string |
formatter | HTML | linestart | int | 1
formatter | Plain | nolexing | bool | true
formatter | RTF | theme | theme |
formatter | Terminal | theme | theme |
formatter | Terminal | mode256 | bool | false
"""

# Styles of the themes, "style: token types"; #foreground on#background and b, i, u.
THEMES = {
    "Molokai": """
#f8f8f2 on#403d3d: ERROR
#5e5d83 i: COMMENT_SINGLE COMMENT_MULTILINE
#465457 i: COMMENT_DOCUMENTATION
#a6e22e: GENERIC_INSERTED
#f92672: GENERIC_DELETED
#403d3d: GENERIC_HEADING
b: GENERIC_STRONG
#465457: GENERIC_SUBHEADING
#66d9ef b: KEYWORD KEYWORD_CONSTANT KEYWORD_DECLARATION KEYWORD_PSEUDO KEYWORD_RESERVED KEYWORD_TYPE
#f92672 b: KEYWORD_NAMESPACE OPERATOR
#af87ff: NUMBER NUMBER_FLOAT NUMBER_DECIMAL NUMBER_BINARY NUMBER_OCTAL NUMBER_IMAGINARY NUMBER_HEXADECIMAL SEQUENCE_ESCAPED
#d7d787: STRING STRING_REGEX STRING_SINGLE STRING_DOUBLE STRING_BACKTICK STRING_INTERNED
#a6e22e b: NAME NAME_CLASS NAME_FUNCTION
#66d9ef: NAME_CONSTANT
#f8f8f2: NAME_BUILTIN_PSEUDO NAME_BUILTIN NAME_ENTITY NAME_NAMESPACE NAME_VARIABLE_CLASS NAME_VARIABLE_GLOBAL NAME_VARIABLE_INSTANCE NAME_VARIABLE
#f92672: NAME_TAG
""",
    "Monokai": """
#960050 on#1e0010: ERROR
#75715e i: COMMENT_SINGLE COMMENT_MULTILINE
#75715e b i: COMMENT_DOCUMENTATION
#ffffff on#324932: GENERIC_INSERTED
#ffffff on#493131: GENERIC_DELETED
#999999: GENERIC_HEADING
b: GENERIC_STRONG
#aaaaaa: GENERIC_SUBHEADING
#66d9ef b: KEYWORD KEYWORD_DEFAULT KEYWORD_BUILTIN KEYWORD_CONSTANT KEYWORD_DECLARATION KEYWORD_PSEUDO KEYWORD_RESERVED KEYWORD_TYPE
#f92672 b: KEYWORD_NAMESPACE OPERATOR
#ae81ff: NUMBER NUMBER_FLOAT NUMBER_DECIMAL NUMBER_BINARY NUMBER_OCTAL NUMBER_IMAGINARY NUMBER_HEXADECIMAL STRING_SINGLE
#e6db74: STRING STRING_DOUBLE STRING_BACKTICK STRING_INTERNED
#a6e22e b: NAME NAME_CLASS NAME_CONSTANT NAME_FUNCTION
#f8f8f2: NAME_BUILTIN_PSEUDO NAME_BUILTIN NAME_ENTITY NAME_NAMESPACE NAME_VARIABLE_CLASS NAME_VARIABLE_GLOBAL NAME_VARIABLE_INSTANCE NAME_VARIABLE
#f92672: NAME_TAG
""",
}

FORMATTERS = {"BBCode": "Format tokens for forums using bbcode syntax to format post", "HTML": "Format tokens as HTML <span> tags within a <pre> tag", "Plain": "Format tokens one a line, for tests", "RTF": "Format tokens as rich text", "Terminal": "Format tokens with ANSI color sequences, for output in a text console"}


def fields(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split("|")] for line in table.strip().splitlines()]


def token_rows() -> list[tuple[int, str, str | None, str, str]]:
    """(id, name, parent, description, cssclass)."""
    out = []
    for k, line in enumerate(TOKEN_TYPES.strip().splitlines()):
        head, _, description = line.partition(":")
        name, cssclass = head.split()
        name, _, parent = name.partition("<")
        out.append((k, name, parent or None, description.strip(), " " if cssclass == "-" else cssclass))
    return out


TYPE_IDS = {name: k for k, name, *_ in token_rows()}
CLASSES = {name: cssclass for _, name, _, _, cssclass in token_rows()}
LEXER_NAMES = [row[0] for row in fields(LEXERS)]


def style_rows() -> list[tuple]:
    """(theme, type, fg, bg, bold, italic, underline); colours as #rrggbb."""
    out = []
    for theme, lines in THEMES.items():
        for line in lines.strip().splitlines():
            style, _, types = line.rpartition(":")
            marks = style.split()
            fg = next((m for m in marks if m.startswith("#")), None)
            bg = next((m[2:] for m in marks if m.startswith("on#")), None)
            out += [(theme, t, fg, bg, "b" in marks, "i" in marks, "u" in marks) for t in types.split()]
    return sorted(out, key=lambda r: (r[0], TYPE_IDS[r[1]]))


def token_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(token_rows(), "id int, name string, parent string, description string, cssclass string")


def token_ancestors(spark: SparkSession) -> DataFrame:
    """(name, ancestor, distance): each type with itself and what is above it; three levels are all."""
    types = token_types(spark).select("name", "parent")
    level, out = types.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("distance")), None
    for distance in range(3):
        out = level if out is None else out.unionByName(level)
        up = types.select(F.col("name").alias("ancestor"), F.col("parent").alias("above"))
        level = level.join(F.broadcast(up), "ancestor").where("above is not null").select("name", F.col("above").alias("ancestor"), F.lit(distance + 1).alias("distance"))
    return out


def lexers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LEXER_NAMES)), "ord int, name string")


def lexer_keys(spark: SparkSession) -> DataFrame:
    """(ord, lexer, kind, pos, value): aliases, file name patterns, MIME types and interpreters."""
    rows = []
    for k, row in enumerate(fields(LEXERS)):
        for kind, values in zip(("alias", "glob", "mime", "interpreter"), row[1:], strict=True):
            rows += [(k, row[0], kind, pos, v) for pos, v in enumerate(values.split())]
    return spark.createDataFrame(rows, "ord int, lexer string, kind string, pos int, value string")


def formatters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMATTERS.items()), "name string, description string")


def options(spark: SparkSession) -> DataFrame:
    rows = [(kind, owner, name, type_, default or None) for kind, owner, name, type_, default in fields(OPTIONS)]
    return spark.createDataFrame(rows, "owner_kind string, owner string, name string, type string, default string")


def theme_styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(style_rows(), "theme string, type string, fg string, bg string, bold boolean, italic boolean, underline boolean")


def palette() -> list[tuple[int, int, int]]:
    """The 256 colours: 16 fixed ones, a cube of six steps, a ramp of greys."""
    # The first sixteen colours.
    base = "000000 cd0000 00cd00 cdcd00 0000ee cd00cd 00cdcd e5e5e5 7f7f7f ff0000 00ff00 ffff00 5c5cff ff00ff 00ffff ffffff"
    levels = (0, 95, 135, 175, 215, 255)
    cube = [(r, g, b) for r in levels for g in levels for b in levels]
    return [tuple(bytes.fromhex(c)) for c in base.split()] + cube + [(g, g, g) for g in range(8, 248, 10)]


def palette256(spark: SparkSession) -> DataFrame:
    """(idx, r, g, b)."""
    return spark.createDataFrame([(k, *c) for k, c in enumerate(palette())], "idx int, r int, g int, b int")


def documentation(spark: SparkSession) -> DataFrame:
    """(kind, owner, ord, markdown): a section for each lexer and formatter, options as a table."""
    keys = lexer_keys(spark).groupBy("lexer").pivot("kind", ["alias", "glob", "mime"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), ", "))
    line = lambda c, title: F.when(F.col(c) != "", F.concat(F.lit(f"\n\n{title}: "), F.col(c))).otherwise("")
    row = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("name")), "type", F.concat(F.coalesce("default", F.lit("null/none")), F.lit(" |")))
    table = options(spark).groupBy("owner_kind", "owner").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows"))
    of_lexers = lexers(spark).join(F.broadcast(keys.withColumnRenamed("lexer", "name")), "name", "left").select(F.lit("lexer").alias("kind"), F.col("name").alias("owner"), "ord", F.concat(F.lit("## "), F.col("name"), line("alias", "Alias(es)"), line("glob", "Filename(s)"), line("mime", "MIME type(s)")).alias("head"))
    of_formatters = formatters(spark).select(F.lit("formatter").alias("kind"), F.col("name").alias("owner"), F.lit(0).alias("ord"), F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), F.col("description")).alias("head"))
    both = of_lexers.unionByName(of_formatters)
    both = both.join(F.broadcast(table.withColumnRenamed("owner_kind", "kind")), ["kind", "owner"], "left")
    options_text = F.when(F.col("rows").isNotNull(), F.concat(F.lit("\n\n| Option | Type | Default value |\n| --- | --- | --- |\n"), F.col("rows"))).otherwise("")
    return both.select("kind", "owner", "ord", F.concat("head", options_text).alias("markdown"))
