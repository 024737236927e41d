"""A source for each language as its tokens: what the lexers must make of it.

An entry is a type (with ``@`` and a language, if it is another than the source's), a blank and the text;
``{k}`` and ``{n}`` stand for a key and a name. ``?intended`` marks the variants with the numbers and
expressions that a scanner defines but never tells.
"""

from __future__ import annotations

GOLDEN: dict[str, list[str]] = {
    "Apache": [
        "COMMENT_SINGLE # c {k}\n", "NAME_TAG <Directory", "IGNORABLE  ", 'STRING_SINGLE "/{n}"', "NAME_TAG >",
        "IGNORABLE \n  ", "KEYWORD_BUILTIN Options", "IGNORABLE  ", "STRING_SINGLE None", "IGNORABLE  ",
        "SEQUENCE_INTERPOLATED ${", "NAME_VARIABLE X", "SEQUENCE_INTERPOLATED }", "STRING_SINGLE /y", "IGNORABLE  ",
        "NUMBER_DECIMAL 80", "IGNORABLE \n", "NAME_TAG </Directory>", "IGNORABLE \n",
    ],
    "Bash": [
        "KEYWORD for", "IGNORABLE  ", "STRING_SINGLE i", "IGNORABLE  ", "KEYWORD in", "IGNORABLE  ",
        "STRING_SINGLE a{k}", "IGNORABLE ; ", "KEYWORD do", "IGNORABLE \n  ", "NAME_BUILTIN echo", "IGNORABLE  ",
        'STRING_DOUBLE "$(f "{n}") ', "SEQUENCE_ESCAPED \\$", 'STRING_DOUBLE "', "IGNORABLE  ", "NAME_VARIABLE $i",
        "IGNORABLE  ", "STRING_SINGLE 'q'", "IGNORABLE  ", "COMMENT_SINGLE # c", "IGNORABLE \n", "KEYWORD done",
        "IGNORABLE \n",
    ],
    "C": [
        "COMMENT_SINGLE #define A \\\n  1\n", "KEYWORD int", "IGNORABLE  f{k}", "PUNCTUATION (", "KEYWORD void",
        "PUNCTUATION )", "IGNORABLE  ", "PUNCTUATION {", "IGNORABLE  ", "KEYWORD return", "IGNORABLE  ",
        "NUMBER_HEXADECIMAL 0x1F", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ", "NUMBER_FLOAT 1.5e3", "IGNORABLE  ",
        "OPERATOR +", "IGNORABLE  ", "NUMBER_OCTAL 017", "PUNCTUATION ;", "IGNORABLE  ", "PUNCTUATION }",
        "IGNORABLE  ", "COMMENT_MULTILINE /* {n} */", "IGNORABLE  ", "COMMENT_SINGLE // c\n", "KEYWORD char",
        "IGNORABLE  ", "OPERATOR *", "IGNORABLE s ", "OPERATOR =", "IGNORABLE  ", 'STRING_DOUBLE "a',
        "SEQUENCE_ESCAPED \\n", 'STRING_DOUBLE "', "PUNCTUATION ,", "IGNORABLE  c ", "OPERATOR =", "IGNORABLE  ",
        "STRING_SINGLE '{k}'", "PUNCTUATION ;", "IGNORABLE \n",
    ],
    "CMake": [
        "COMMENT_SINGLE # c", "IGNORABLE \n", "NAME_BUILTIN add_library", "PUNCTUATION (", "IGNORABLE l{k} ",
        "SEQUENCE_INTERPOLATED ${", "NAME_VARIABLE SRC", "SEQUENCE_INTERPOLATED }", "IGNORABLE  ",
        'STRING_DOUBLE "a;', "SEQUENCE_INTERPOLATED ${", "NAME_VARIABLE B", "SEQUENCE_INTERPOLATED }",
        "SEQUENCE_ESCAPED \\n", 'STRING_DOUBLE "', "PUNCTUATION )", "IGNORABLE  ", "COMMENT_MULTILINE #[[ {n} ]]",
        "IGNORABLE \n", "NAME_FUNCTION mine", "PUNCTUATION (", "IGNORABLE x", "PUNCTUATION )", "IGNORABLE \n",
    ],
    "CSS": [
        "NAME_CLASS .c{k}", "IGNORABLE  ", "OPERATOR >", "IGNORABLE  ", "KEYWORD a", "KEYWORD_PSEUDO :hover",
        "PUNCTUATION ,", "IGNORABLE  ", "NAME_FUNCTION #i", "IGNORABLE  ", "PUNCTUATION {", "IGNORABLE  ",
        "NAME_BUILTIN color", "IGNORABLE : ", "KEYWORD red", "IGNORABLE  ", "TAG_PREPROC !important", "PUNCTUATION ;",
        "IGNORABLE  ", "KEYWORD_BUILTIN -moz-x", "IGNORABLE : ", "NAME_FUNCTION f", "PUNCTUATION (",
        "NUMBER_DECIMAL 1px", "PUNCTUATION );", "IGNORABLE  ", "KEYWORD foo", "IGNORABLE : ", 'STRING_SINGLE "{n}"',
        "IGNORABLE  ", "PUNCTUATION }", "IGNORABLE  ", "COMMENT_MULTILINE /* c */", "IGNORABLE  ", "KEYWORD @media",
        "IGNORABLE  ", "KEYWORD x", "IGNORABLE  ", "PUNCTUATION {", "IGNORABLE  ", "PUNCTUATION }", "IGNORABLE \n",
    ],
    "Diff": [
        "GENERIC_HEADING diff a{k}\nIndex: b\n", "GENERIC_SUBHEADING @@ 1 @@\n", "GENERIC_DELETED -{n}\n",
        "GENERIC_INSERTED +b\n", "GENERIC_STRONG ! c\n", "IGNORABLE  d\n",
    ],
    "DTD": [
        "NAME_TAG <!ELEMENT", "IGNORABLE  ", "NAME_TAG e{k}", "IGNORABLE  ", "PUNCTUATION (", "NAME_TAG a",
        "OPERATOR |", "NAME_TAG b", "PUNCTUATION )", "OPERATOR *", "NAME_TAG >", "IGNORABLE \n", "NAME_TAG <!ATTLIST",
        "IGNORABLE  ", "NAME_ATTRIBUTE a", "IGNORABLE  ", "NAME_ATTRIBUTE b", "IGNORABLE  ", "KEYWORD_CONSTANT CDATA",
        "IGNORABLE  ", "KEYWORD_CONSTANT #REQUIRED", "NAME_TAG >", "IGNORABLE \n", "NAME_TAG <!ENTITY",
        "IGNORABLE  % ", "NAME_ENTITY x", "IGNORABLE  ", 'STRING_SINGLE "y', "NAME_ENTITY %z;", 'STRING_SINGLE "',
        "NAME_TAG >", "COMMENT_MULTILINE <!-- {n} -->", "IGNORABLE \n",
    ],
    "EEX": [
        "IGNORABLE <p>", "NAME_TAG <%=", "IGNORABLE@Elixir  x{k} ", "NAME_TAG %>", "IGNORABLE </p>",
        "COMMENT_SINGLE <%# {n} %>", "IGNORABLE \n",
    ],
    "ERB": [
        "IGNORABLE <p>", "NAME_TAG <%=", "IGNORABLE@Ruby  ", "NAME_VARIABLE_INSTANCE@Ruby @x{k}", "IGNORABLE@Ruby  ",
        "OPERATOR@Ruby +", "IGNORABLE@Ruby  ", "NUMBER_DECIMAL@Ruby 1", "IGNORABLE@Ruby  ", "NAME_TAG %>",
        "IGNORABLE </p>", "COMMENT_SINGLE <%# {n} %>", "IGNORABLE \n",
    ],
    "Elixir": [
        "KEYWORD def", "IGNORABLE  f{k}", "PUNCTUATION ,", "IGNORABLE  ", "KEYWORD do", "PUNCTUATION :",
        "IGNORABLE  ", "STRING_INTERNED :ok", "IGNORABLE  ", "COMMENT_SINGLE # c", "IGNORABLE \nx = ",
        'STRING_DOUBLE "a', "SEQUENCE_ESCAPED \\n", 'STRING_DOUBLE "', "IGNORABLE  ", "OPERATOR <>", "IGNORABLE  ",
        "STRING_REGEX ~r/{n}/", "IGNORABLE  ", "OPERATOR and", "IGNORABLE  ", "NUMBER_HEXADECIMAL 0x1F",
        "IGNORABLE  ", "OPERATOR and", "IGNORABLE  ", "NUMBER_FLOAT 1.5", "IGNORABLE \n",
    ],
    "Go": [
        "KEYWORD func", "IGNORABLE  ", "NAME f{k}", "OPERATOR (", "NAME a", "IGNORABLE  ", "KEYWORD_TYPE int",
        "OPERATOR )", "IGNORABLE  ", "KEYWORD_TYPE string", "IGNORABLE  ", "OPERATOR {", "IGNORABLE  ",
        "KEYWORD return", "IGNORABLE  ", "STRING_SINGLE `{n}`", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ",
        "NUMBER_FLOAT 1.5", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ", "NUMBER_IMAGINARY 2i", "IGNORABLE  ",
        "OPERATOR +", "IGNORABLE  ", "NUMBER_OCTAL 017", "IGNORABLE  ", "OPERATOR }", "IGNORABLE  ",
        "COMMENT_SINGLE // c", "IGNORABLE \n",
    ],
    "HTML": [
        "COMMENT_MULTILINE <!-- c -->", "NAME_TAG <p", "IGNORABLE  ", "NAME_ATTRIBUTE class=", 'STRING_SINGLE "c{k}"',
        "IGNORABLE  ", "NAME_ATTRIBUTE id=x", "NAME_TAG >", "IGNORABLE {n} ", "NAME_ENTITY &amp;", "IGNORABLE  b",
        "NAME_TAG <style>", "KEYWORD@CSS p", "IGNORABLE@CSS  ", "PUNCTUATION@CSS {", "IGNORABLE@CSS  ",
        "NAME_BUILTIN@CSS margin", "IGNORABLE@CSS : ", "NUMBER_DECIMAL@CSS 0", "IGNORABLE@CSS  ", "PUNCTUATION@CSS }",
        "NAME_TAG </style><script>", "KEYWORD@Javascript var", "IGNORABLE@Javascript  ", "NAME_VARIABLE@Javascript x",
        "IGNORABLE@Javascript  ", "OPERATOR@Javascript =", "IGNORABLE@Javascript  ", 'STRING_DOUBLE@Javascript "y"',
        "IGNORABLE@Javascript ;", "NAME_TAG </script></p>", "IGNORABLE \n",
    ],
    "JSON": [
        "PUNCTUATION {", 'STRING_DOUBLE "k"', "PUNCTUATION :", "IGNORABLE  ", "PUNCTUATION [", "NUMBER_DECIMAL {k}",
        "PUNCTUATION ,", "IGNORABLE  -", "NUMBER_FLOAT 1.5e3", "PUNCTUATION ,", "IGNORABLE  ",
        "KEYWORD_CONSTANT true", "PUNCTUATION ],", "IGNORABLE  ", 'STRING_DOUBLE "v"', "PUNCTUATION :", "IGNORABLE  ",
        'STRING_DOUBLE "{n}', "SEQUENCE_ESCAPED \\u0041", "ERROR \\uD835", 'STRING_DOUBLE "', "PUNCTUATION }",
        "IGNORABLE \n",
    ],
    "Javascript": [
        "KEYWORD function", "IGNORABLE  ", "NAME_VARIABLE f{k}", "IGNORABLE (", "NAME_VARIABLE a", "IGNORABLE ) { ",
        "KEYWORD return", "IGNORABLE  ", 'STRING_DOUBLE "{n}', "SEQUENCE_ESCAPED \\n", 'STRING_DOUBLE "',
        "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ", "NAME_VARIABLE a", "IGNORABLE  ", "OPERATOR /", "IGNORABLE  2 ",
        "OPERATOR ===", "IGNORABLE  ", "KEYWORD_CONSTANT null", "IGNORABLE ; } ", "COMMENT_SINGLE // c",
        "IGNORABLE \n", "COMMENT_MULTILINE /* d */", "IGNORABLE \n",
    ],
    "Javascript?intended": [
        "KEYWORD var", "IGNORABLE  ", "NAME_VARIABLE a", "IGNORABLE  ", "OPERATOR =", "IGNORABLE  ",
        "STRING_REGEX /{n}", "SEQUENCE_ESCAPED \\d", "STRING_REGEX /g", "PUNCTUATION ,", "IGNORABLE  ",
        "NAME_VARIABLE b", "IGNORABLE  ", "OPERATOR =", "IGNORABLE  ", "NUMBER_FLOAT 1.5", "IGNORABLE  ",
        "OPERATOR /", "IGNORABLE  ", "NUMBER_DECIMAL {k}", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ",
        "NUMBER_HEXADECIMAL 0x1F", "PUNCTUATION ;", "IGNORABLE \n",
    ],
    "Lua": [
        "KEYWORD local", "IGNORABLE  ", "NAME_VARIABLE x{k}", "IGNORABLE  ", "OPERATOR =", "IGNORABLE  ",
        "STRING_SINGLE [[{n}]]", "IGNORABLE  ", "OPERATOR ..", "IGNORABLE  ", 'STRING_DOUBLE "a',
        "SEQUENCE_ESCAPED \\n", 'STRING_DOUBLE "', "IGNORABLE  ", "COMMENT_SINGLE -- c", "IGNORABLE \n",
        "COMMENT_MULTILINE --[==[ d ]==]", "IGNORABLE  ", "KEYWORD if", "IGNORABLE  ", "OPERATOR not", "IGNORABLE  ",
        "NUMBER_FLOAT 1.5", "IGNORABLE  ", "KEYWORD then", "IGNORABLE  ", "KEYWORD end", "IGNORABLE \n",
    ],
    "MySQL": [
        "KEYWORD select", "IGNORABLE  ", "NAME `a`", "IGNORABLE  ", "KEYWORD from", "IGNORABLE  ", "NAME t",
        "IGNORABLE  ", "KEYWORD where", "IGNORABLE  ", "NAME k", "IGNORABLE  ", "OPERATOR =", "IGNORABLE  ",
        "NUMBER {k}", "IGNORABLE  ", "OPERATOR and", "IGNORABLE  ", "NAME v", "IGNORABLE  ", "OPERATOR =",
        "IGNORABLE  ", "STRING '{n}", "SEQUENCE_ESCAPED \\n", "STRING '", "IGNORABLE  ", "OPERATOR or", "IGNORABLE  ",
        "NAME_VARIABLE @x", "IGNORABLE  ", "OPERATOR is", "IGNORABLE  ", "KEYWORD_CONSTANT null", "IGNORABLE  ",
        "COMMENT_SINGLE -- c", "IGNORABLE \n", "KEYWORD optimize", "IGNORABLE  ", "KEYWORD table", "IGNORABLE  ",
        "NAME t", "IGNORABLE  ", "COMMENT_MULTILINE /*!", "IGNORABLE  ", "KEYWORD force", "IGNORABLE  ",
        "COMMENT_MULTILINE */", "PUNCTUATION ;", "IGNORABLE \n",
    ],
    "Nginx": [
        "KEYWORD_BUILTIN server", "IGNORABLE  ", "PUNCTUATION {", "IGNORABLE \n  ", "KEYWORD_BUILTIN listen",
        "IGNORABLE  ", "NUMBER_DECIMAL {k}", "PUNCTUATION ;", "IGNORABLE  ", "COMMENT_SINGLE # c\n", "IGNORABLE   ",
        "KEYWORD_BUILTIN server_name", "IGNORABLE  ", 'STRING_SINGLE "{n}"', "IGNORABLE  ", "NAME_BUILTIN $host",
        "IGNORABLE  ", "NAME_VARIABLE $mine", "PUNCTUATION ;", "IGNORABLE \n", "PUNCTUATION }", "IGNORABLE \n",
    ],
    "PHP": [
        "NAME_TAG <?php", "IGNORABLE  ", "KEYWORD use", "IGNORABLE  ", "NAME_NAMESPACE A", "IGNORABLE \\",
        "PUNCTUATION {", "NAME_CLASS B", "PUNCTUATION ,", "IGNORABLE  ", "KEYWORD function", "IGNORABLE  ",
        "NAME_FUNCTION c", "PUNCTUATION };", "IGNORABLE  ", "KEYWORD class", "IGNORABLE  ", "NAME_CLASS D{k}",
        "IGNORABLE  ", "KEYWORD extends", "IGNORABLE  ", "NAME_CLASS E", "IGNORABLE  ", "PUNCTUATION {",
        "IGNORABLE  ", "KEYWORD public", "IGNORABLE  ", "NAME_VARIABLE_INSTANCE $x", "PUNCTUATION ;", "IGNORABLE  ",
        "KEYWORD function", "IGNORABLE  ", "NAME_FUNCTION f", "PUNCTUATION ()", "IGNORABLE  ", "PUNCTUATION {",
        "IGNORABLE  ", "KEYWORD return", "IGNORABLE  ", "KEYWORD new", "IGNORABLE  ", "NAME_CLASS G", "PUNCTUATION (",
        "NAME_BUILTIN_PSEUDO $this", "OPERATOR ->", "NAME_FUNCTION h", "PUNCTUATION (", 'STRING_DOUBLE "{n}',
        "SEQUENCE_ESCAPED \\n", 'STRING_DOUBLE "', "PUNCTUATION ),", "IGNORABLE  ", "NAME_CONSTANT K",
        "PUNCTUATION ,", "IGNORABLE  ", "NUMBER_FLOAT 1.5", "PUNCTUATION );", "IGNORABLE  ", "PUNCTUATION }",
        "IGNORABLE  ", "PUNCTUATION }", "IGNORABLE  ", "COMMENT_SINGLE // c\n", "NAME_TAG ?>", "IGNORABLE t\n",
    ],
    "PostgreSQL": [
        "KEYWORD select", "IGNORABLE  a", "OPERATOR ,", "IGNORABLE  ", "NAME_VARIABLE $1", "IGNORABLE  ",
        "KEYWORD from", "IGNORABLE  t ", "KEYWORD where", "IGNORABLE  k ", "OPERATOR =", "IGNORABLE  ",
        "NUMBER_DECIMAL {k}", "IGNORABLE  ", "KEYWORD and", "IGNORABLE  v ", "OPERATOR =", "IGNORABLE  ",
        "STRING_SINGLE E'{n}", "SEQUENCE_ESCAPED \\n", "STRING_SINGLE '", "IGNORABLE  ", "KEYWORD or", "IGNORABLE  ",
        "STRING_SINGLE $$x$$", "IGNORABLE  ", "KEYWORD is", "IGNORABLE  ", "KEYWORD null", "IGNORABLE  ",
        "COMMENT_SINGLE -- c", "IGNORABLE \n", "KEYWORD vacuum", "IGNORABLE  ", "COMMENT_MULTILINE /* d */",
        "IGNORABLE  t", "OPERATOR ::", "KEYWORD_TYPE text", "OPERATOR ;", "IGNORABLE \n",
    ],
    "Python": [
        "KEYWORD def", "IGNORABLE  ", "NAME_VARIABLE f{k}", "PUNCTUATION (", "NAME_VARIABLE self", "PUNCTUATION ):",
        "IGNORABLE \n    ", "KEYWORD return", "IGNORABLE  ", "STRING_SINGLE '{n}", "SEQUENCE_ESCAPED \\n",
        "STRING_SINGLE '", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ", 'STRING_DOUBLE r"x"', "IGNORABLE  ",
        "OPERATOR is", "IGNORABLE  ", "KEYWORD_CONSTANT None", "IGNORABLE  ", "COMMENT_SINGLE # c\n",
        "NAME_VARIABLE x", "IGNORABLE  = ", "NUMBER_HEXADECIMAL 0x1F", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ",
        "NUMBER_DECIMAL 2", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ", "NUMBER_IMAGINARY 1j", "IGNORABLE \n",
    ],
    "Python?intended": [
        "NAME_VARIABLE x{k}", "IGNORABLE  = ", "NUMBER_FLOAT 1.5", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ",
        "NUMBER_FLOAT 2e3", "IGNORABLE  ", "COMMENT_SINGLE # {n}\n",
    ],
    "Ruby": [
        "KEYWORD def", "IGNORABLE  ", "NAME_FUNCTION f{k}", "IGNORABLE \n  ", "NAME_VARIABLE_INSTANCE @y",
        "IGNORABLE  ", "OPERATOR =", "IGNORABLE  ", "STRING_SINGLE '{n}'", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ",
        "STRING_INTERNED :s", "PUNCTUATION .", "NAME_FUNCTION to_s", "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ",
        "STRING_SINGLE %w(a b)", "IGNORABLE  ", "COMMENT_SINGLE # c", "IGNORABLE \n", "KEYWORD end", "IGNORABLE \n",
        "NAME_VARIABLE_GLOBAL $g", "IGNORABLE  ", "OPERATOR ||=", "IGNORABLE  ", "STRING_REGEX /x/", "IGNORABLE \n",
    ],
    "Text": [
        "IGNORABLE {n} {k}\n",
    ],
    "Twig": [
        "IGNORABLE <b>", "NAME_TAG {%", "IGNORABLE  ", "KEYWORD if", "IGNORABLE  a{k} ", "OPERATOR is", "IGNORABLE  ",
        "OPERATOR not", "IGNORABLE  ", "KEYWORD_CONSTANT null", "IGNORABLE  ", "NAME_TAG %}{{", "IGNORABLE  b",
        "OPERATOR |", "IGNORABLE e", "PUNCTUATION (", 'STRING_DOUBLE "x"', "PUNCTUATION )", "IGNORABLE  ",
        "NAME_TAG }}{%", "IGNORABLE  ", "KEYWORD endif", "IGNORABLE  ", "NAME_TAG %}", "COMMENT_MULTILINE {# {n} #}",
        "IGNORABLE </b>\n",
    ],
    "Varnish": [
        "KEYWORD_DECLARATION vcl", "IGNORABLE  ", "NUMBER_FLOAT 4.0", "PUNCTUATION ;", "IGNORABLE \n", "KEYWORD sub",
        "IGNORABLE  ", "NAME_FUNCTION vcl_recv", "IGNORABLE  ", "PUNCTUATION {", "IGNORABLE  ", "KEYWORD set",
        "IGNORABLE  ", "NAME_VARIABLE req.url", "IGNORABLE  ", "OPERATOR =", "IGNORABLE  ", 'STRING_SINGLE "{n}"',
        "IGNORABLE  ", "OPERATOR +", "IGNORABLE  ", "LITERAL_DURATION 1s", "PUNCTUATION ;", "IGNORABLE  ",
        "PUNCTUATION }", "IGNORABLE  ", "COMMENT_SINGLE # {k}\n",
    ],
    "XML": [
        "TAG_PREPROC <?xml", "IGNORABLE  ", "NAME_ATTRIBUTE version=", 'STRING_SINGLE "1.0"', "TAG_PREPROC ?>",
        "NAME_TAG <a", "IGNORABLE  ", "NAME_ATTRIBUTE b=", 'STRING_SINGLE "{k}"', "NAME_TAG >", "IGNORABLE {n} ",
        "NAME_ENTITY &x;", "TAG_PREPROC <![CDATA[", "IGNORABLE  <c> ", "TAG_PREPROC ]]>", "NAME_TAG </a>",
        "IGNORABLE \n",
    ],
}


def golden_rows() -> list[tuple[str, int, str, str, str]]:
    """(language, seq, lexer, type, text)."""
    out = []
    for language, tokens in GOLDEN.items():
        for seq, token in enumerate(tokens):
            kind, _, text = token.partition(" ")
            type_, _, lexer = kind.partition("@")
            out.append((language, seq, lexer or language.partition("?")[0], type_, text))
    return out


#: Templates in markup: (path of lexers below the template's own, type, text) of each token; ``{u}`` stands for a
#: name. A string, tag, style or script of the page goes on behind a tag of the template, and a tag of the template ends
#: where its code says so. A note in parentheses tells cases of one language apart.
EMBEDDED: dict[str, list[tuple[str, str, str]]] = {
    "Twig": [
        ("HTML", "NAME_TAG", "<h"), ("", "NAME_TAG", "{{"), ("", "IGNORABLE", " n "), ("", "NAME_TAG", "}}"),
        ("HTML", "IGNORABLE", " "), ("HTML", "NAME_ATTRIBUTE", "class="), ("HTML", "STRING_SINGLE", '"x'),
        ("", "NAME_TAG", "{{"), ("", "IGNORABLE", " {u} "), ("", "NAME_TAG", "}}"), ("HTML", "STRING_SINGLE", 'z"'),
        ("HTML", "NAME_TAG", "><style>"), ("HTML/CSS", "KEYWORD", "a"), ("HTML/CSS", "PUNCTUATION", "{"),
        ("HTML/CSS", "NAME_BUILTIN", "color"), ("HTML/CSS", "IGNORABLE", ":"), ("", "NAME_TAG", "{{"),
        ("", "IGNORABLE", " "), ("", "STRING_DOUBLE", '"'), ("", "SEQUENCE_INTERPOLATED", "}}"),
        ("", "STRING_DOUBLE", '"'), ("", "IGNORABLE", " "), ("", "NAME_TAG", "}}"), ("HTML/CSS", "PUNCTUATION", ";}"),
        ("HTML", "NAME_TAG", "</style>"), ("HTML", "IGNORABLE", "{u}"), ("", "NAME_TAG", "{%"), ("", "IGNORABLE", " "),
        ("", "KEYWORD", "if"), ("", "IGNORABLE", " a "), ("", "NAME_TAG", "%}"), ("HTML", "IGNORABLE", " b"),
        ("", "COMMENT_MULTILINE", "{# {u} #}"), ("HTML", "NAME_TAG", "<script>"), ("HTML/Javascript", "KEYWORD", "var"),
        ("HTML/Javascript", "IGNORABLE", " "), ("HTML/Javascript", "NAME_VARIABLE", "s"),
        ("HTML/Javascript", "IGNORABLE", " "), ("HTML/Javascript", "OPERATOR", "="),
        ("HTML/Javascript", "IGNORABLE", " "), ("HTML/Javascript", "STRING_DOUBLE", "'a"), ("", "NAME_TAG", "{{"),
        ("", "IGNORABLE", " b "), ("", "NAME_TAG", "}}"), ("HTML/Javascript", "STRING_DOUBLE", "c'"),
        ("HTML", "NAME_TAG", "</script>"),
    ],
    "PHP": [
        ("HTML", "NAME_TAG", "<a"), ("HTML", "IGNORABLE", " "), ("HTML", "NAME_ATTRIBUTE", "href="),
        ("HTML", "STRING_SINGLE", '"'), ("", "NAME_TAG", "<?php"), ("", "IGNORABLE", " "), ("", "KEYWORD", "echo"),
        ("", "IGNORABLE", " "), ("", "STRING_DOUBLE", '"{u} ?> b"'), ("", "PUNCTUATION", ";"), ("", "IGNORABLE", " "),
        ("", "COMMENT_SINGLE", "// c "), ("", "NAME_TAG", "?>"), ("HTML", "STRING_SINGLE", '"'),
        ("HTML", "NAME_TAG", ">"), ("HTML", "IGNORABLE", "{u}"), ("", "NAME_TAG", "<?="), ("", "IGNORABLE", " "),
        ("", "NAME_VARIABLE", "$x"), ("", "IGNORABLE", " "), ("", "COMMENT_MULTILINE", "/* ?> */"),
        ("", "IGNORABLE", " "), ("", "NAME_TAG", "?>"), ("HTML", "NAME_TAG", "</a>"),
    ],
    "PHP (declarations)": [
        ("", "NAME_TAG", "<?php"), ("", "IGNORABLE", " "), ("", "KEYWORD", "class"), ("", "IGNORABLE", " "),
        ("", "NAME_CLASS", "A{u}"), ("", "IGNORABLE", " "), ("", "PUNCTUATION", "{"), ("", "IGNORABLE", " "),
        ("", "KEYWORD", "public"), ("", "IGNORABLE", " "), ("", "KEYWORD_TYPE", "int"), ("", "IGNORABLE", " "),
        ("", "NAME_VARIABLE_INSTANCE", "$p"), ("", "PUNCTUATION", ","), ("", "IGNORABLE", " "),
        ("", "NAME_VARIABLE_INSTANCE", "$q"), ("", "IGNORABLE", " "), ("", "OPERATOR", "="), ("", "IGNORABLE", " "),
        ("", "PUNCTUATION", "["), ("", "NUMBER_DECIMAL", "1"), ("", "PUNCTUATION", ","), ("", "IGNORABLE", " "),
        ("", "NUMBER_DECIMAL", "2"), ("", "PUNCTUATION", "],"), ("", "IGNORABLE", " "),
        ("", "NAME_VARIABLE_INSTANCE", "${u}"), ("", "PUNCTUATION", ";"), ("", "IGNORABLE", " "),
        ("", "KEYWORD", "static"), ("", "IGNORABLE", " "), ("", "OPERATOR", "?"), ("", "NAME_CLASS", "F{u}"),
        ("", "IGNORABLE", " "), ("", "NAME_VARIABLE_INSTANCE", "$s"), ("", "PUNCTUATION", ";"), ("", "IGNORABLE", " "),
        ("", "KEYWORD", "function"), ("", "IGNORABLE", " "), ("", "NAME_FUNCTION", "f"), ("", "PUNCTUATION", "("),
        ("", "KEYWORD_TYPE", "array"), ("", "IGNORABLE", " "), ("", "NAME_VARIABLE", "$a"), ("", "PUNCTUATION", ")"),
        ("", "OPERATOR", ":"), ("", "IGNORABLE", " "), ("", "NAME_CLASS", "B{u}"), ("", "IGNORABLE", " "),
        ("", "PUNCTUATION", "{"), ("", "IGNORABLE", " "), ("", "KEYWORD", "static"), ("", "IGNORABLE", " "),
        ("", "NAME_VARIABLE", "$v"), ("", "PUNCTUATION", ","), ("", "IGNORABLE", " "), ("", "NAME_VARIABLE", "$w"),
        ("", "PUNCTUATION", ";"), ("", "IGNORABLE", " "), ("", "KEYWORD", "return"), ("", "IGNORABLE", " "),
        ("", "NAME_VARIABLE", "$x"), ("", "IGNORABLE", " "), ("", "OPERATOR", "?"), ("", "IGNORABLE", " "),
        ("", "NAME_FUNCTION", "f"), ("", "PUNCTUATION", "("), ("", "NAME_VARIABLE", "$y"), ("", "PUNCTUATION", ")"),
        ("", "IGNORABLE", " "), ("", "OPERATOR", ":"), ("", "IGNORABLE", " "), ("", "NAME_CONSTANT", "C{u}"),
        ("", "PUNCTUATION", ";"), ("", "IGNORABLE", " "), ("", "PUNCTUATION", "}"), ("", "IGNORABLE", " "),
        ("", "PUNCTUATION", "}"),
    ],
    "ERB": [
        ("HTML", "NAME_TAG", "<p"), ("HTML", "IGNORABLE", " "), ("HTML", "NAME_ATTRIBUTE", "title="),
        ("HTML", "STRING_SINGLE", "'"), ("", "NAME_TAG", "<%="), ("Ruby", "IGNORABLE", " "),
        ("Ruby", "NAME_VARIABLE_INSTANCE", "@{u}"), ("Ruby", "IGNORABLE", " "), ("Ruby", "COMMENT_SINGLE", "# don't "),
        ("", "NAME_TAG", "%>"), ("HTML", "STRING_SINGLE", "'"), ("HTML", "NAME_TAG", ">"), ("", "NAME_TAG", "<%"),
        ("Ruby", "IGNORABLE", " "), ("Ruby", "KEYWORD", "if"), ("Ruby", "IGNORABLE", " "),
        ("Ruby", "STRING_DOUBLE", '"%>"'), ("Ruby", "IGNORABLE", " "), ("", "NAME_TAG", "%>"),
        ("HTML", "IGNORABLE", "{u}"), ("HTML", "NAME_TAG", "</p>"),
    ],
    "EEX": [
        ("HTML", "NAME_TAG", "<b"), ("HTML", "IGNORABLE", " "), ("HTML", "NAME_ATTRIBUTE", "id="),
        ("HTML", "STRING_SINGLE", '"'), ("", "NAME_TAG", "<%="), ("Elixir", "IGNORABLE", " "),
        ("Elixir", "STRING_DOUBLE", '"{u} %>"'), ("Elixir", "IGNORABLE", " "), ("", "NAME_TAG", "%>"),
        ("HTML", "STRING_SINGLE", '"'), ("HTML", "NAME_TAG", ">"), ("", "COMMENT_SINGLE", "<%# {u} %>"),
        ("HTML", "NAME_TAG", "</b>"),
    ],
    "CSS": [
        ("", "KEYWORD", "a"), ("", "IGNORABLE", " "), ("", "PUNCTUATION", "{"), ("", "IGNORABLE", " "),
        ("", "NAME_BUILTIN", "content"), ("", "IGNORABLE", ": "), ("", "STRING_SINGLE", '"{u} }"'),
        ("", "PUNCTUATION", ";"), ("", "IGNORABLE", " "), ("", "COMMENT_MULTILINE", "/* } */"), ("", "IGNORABLE", " "),
        ("", "PUNCTUATION", "}"), ("", "IGNORABLE", " "), ("", "KEYWORD", "b"),
    ],
    "XML": [
        ("DTD", "NAME_TAG", "<!DOCTYPE"), ("DTD", "IGNORABLE", " a ["), ("DTD", "NAME_TAG", "<![INCLUDE[<!ENTITY"),
        ("DTD", "IGNORABLE", " "), ("DTD", "NAME_ENTITY", "x"), ("DTD", "IGNORABLE", " "),
        ("DTD", "STRING_SINGLE", '"{u} ]>"'), ("DTD", "NAME_TAG", ">]]>"), ("DTD", "COMMENT_MULTILINE", "<!-- ]> -->"),
        ("DTD", "NAME_TAG", "]>"), ("", "NAME_TAG", "<b"), ("", "IGNORABLE", "/"), ("", "NAME_TAG", ">"),
    ],
    "HTML": [
        ("", "NAME_TAG", "<script"), ("", "IGNORABLE", " "), ("", "NAME_ATTRIBUTE", "data-x="),
        ("", "STRING_SINGLE", '"{u}>b"'), ("", "NAME_TAG", ">"), ("Javascript", "KEYWORD", "var"),
        ("Javascript", "IGNORABLE", " "), ("Javascript", "NAME_VARIABLE", "x"), ("Javascript", "IGNORABLE", ";"),
        ("", "NAME_TAG", "</script><p>"),
    ],
}
#: The languages of these that take another around their tags.
TEMPLATES = frozenset({"EEX", "ERB", "PHP", "Twig"})


def embedded_rows() -> list[tuple[str, int, str, str, str]]:
    """(language, seq, path, type, text)."""
    return [(language, seq, f"{language.split()[0]}/{path}".rstrip("/"), type_, text) for language, found in EMBEDDED.items() for seq, (path, type_, text) in enumerate(found)]
