"""SQL for the queries over the catalog, the word lists and the golden sources: their text as values, and
what the queries make of it said in SQL."""

from __future__ import annotations

from collections.abc import Iterable

from lexigrain.plans import catalog
from lexigrain.plans import word_lists as lists
from lexigrain.plans.goldens import embedded_rows, golden_rows


def value(v: object) -> str:
    if v is None:
        return "null"
    return str(v).lower() if isinstance(v, (bool, int)) else "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: Iterable[tuple]) -> str:
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)})"


TYPES = values("types", "id, name, parent, description, cssclass", catalog.token_rows())
#: The registry as it is written: a line for each lexer, its fields between bars.
KEYS = values("registry", "ord, line", enumerate(catalog.LEXERS.strip().splitlines())) + """,
    fields as (select ord::int as ord, list_transform(string_split(line || ' ', '|'), lambda x: trim(x)) as f from registry),
    lexers as (select ord, f[1] as name, f from fields),
    keys as (select ord, name as lexer, kind, (pos - 1)::int as pos, v[pos] as value from (
        select ord, name, kind, string_split_regex(f[field], ' +') as v from lexers, (values (2, 'alias'), (3, 'glob'), (4, 'mime'), (5, 'interpreter')) k(field, kind) where coalesce(f[field], '') <> ''), unnest(range(1, len(v) + 1)) as u(pos))"""
OPTIONS = values("opts", "owner_kind, owner, name, type, dflt", ((k, o, n, t, d or None) for k, o, n, t, d in catalog.fields(catalog.OPTIONS)))
#: Texts that orders' keys make, by what they are guessed to be.
GUESSES = "guesses as (select ['Python', 'Bash', 'PHP', 'XML', 'Diff', 'Varnish', 'MySQL', 'Text'][o_orderkey % 8 + 1] as owner, count(*) as texts from orders group by 1)"
STYLES = values("styles", "theme, type, fg, bg, bold, italic, underline", catalog.style_rows())

#: (language, list, type of its words, the list)
WORDS = [
    ("PostgreSQL", "keywords", "KEYWORD", lists.POSTGRESQL_KEYWORDS),
    ("PostgreSQL", "types", "KEYWORD_TYPE", lists.POSTGRESQL_TYPES),
    ("MySQL", "keywords", "KEYWORD", lists.MYSQL_KEYWORDS),
    ("MySQL", "operators", "OPERATOR", lists.MYSQL_OPERATORS),
    ("MySQL", "constants", "KEYWORD_CONSTANT", lists.MYSQL_CONSTANTS),
    ("Nginx", "directives", "KEYWORD_BUILTIN", lists.NGINX_DIRECTIVES),
    ("Nginx", "variables", "NAME_BUILTIN", lists.NGINX_VARIABLES),
    ("CSS", "properties", "NAME_BUILTIN", lists.CSS_PROPERTIES),
    ("CSS", "values", "NAME_BUILTIN", lists.CSS_VALUES),
]

#: Pages as tokens: the pieces of a page, the parts of its tags, styles and scripts, neighbours joined.
PAGES = r"""
    with top as (select page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<style>.*?</style>|<script>.*?</script>|</[a-zA-Z][a-zA-Z0-9]*\s*>|<!?[a-zA-Z][^>]*>|&[a-zA-Z]+;|[^<&]+|.') as l from pages),
    pieces as (select page_id, i, l[i] as x from top, unnest(range(1, len(l) + 1)) as u(i)),
    cut as (select page_id, i, x, case
        when starts_with(x, '<style>') then ['<style>'] || regexp_extract_all(x[8:-9], '[a-z-]+|[0-9]+|(?s:.)') || ['</style>']
        when starts_with(x, '<script>') then ['<script>'] || regexp_extract_all(x[9:-10], '"(?:[^"\\]|\\.)*"|[A-Za-z_$][A-Za-z0-9_$]*|\s+|(?s:.)') || ['</script>']
        when regexp_matches(x, '^<!?[a-zA-Z]') then regexp_extract_all(x, '<!?[A-Za-z][A-Za-z0-9]*|\s+|[A-Za-z:_-]+\s*=\s*|"[^"]*"|[A-Za-z]+|>|(?s:.)')
        else [x] end as l from pieces),
    parts as (select page_id, i, j, x, l[j] as t, case when j > 1 and j < len(l) and starts_with(x, '<style>') then 'CSS' when j > 1 and j < len(l) and starts_with(x, '<script>') then 'Javascript' else 'HTML' end as lexer from cut, unnest(range(1, len(l) + 1)) as u(j)),
    typed as (select *, case
        when lexer = 'CSS' then case when t in ('{', '}', ';') then 'PUNCTUATION' when regexp_matches(t, '^[0-9]') then 'NUMBER_DECIMAL' when t in ('margin') then 'NAME_BUILTIN' when regexp_matches(t, '^[a-z]') then 'KEYWORD' else 'IGNORABLE' end
        when lexer = 'Javascript' then case when t = 'var' then 'KEYWORD' when t = '=' then 'OPERATOR' when starts_with(t, '"') then 'STRING_DOUBLE' when regexp_matches(t, '^[A-Za-z_$]') then 'NAME_VARIABLE' else 'IGNORABLE' end
        when starts_with(x, '<!--') then 'COMMENT_MULTILINE' when regexp_matches(t, '^(</?!?[a-zA-Z]|>$)') and starts_with(x, '<') then 'NAME_TAG'
        when starts_with(x, '<') and starts_with(t, '"') then 'STRING_SINGLE' when starts_with(x, '<') and regexp_matches(t, '^[A-Za-z:_-]') then 'NAME_ATTRIBUTE'
        when regexp_matches(t, '^&[a-zA-Z]+;$') then 'NAME_ENTITY' else 'IGNORABLE' end as type from parts),
    marked as (select *, case when lexer = lag(lexer) over w and type = lag(type) over w then 0 else 1 end as new from typed window w as (partition by page_id order by i, j))"""

ORACLE_SQL = {
    "page_types": PAGES + " select lexer, type, sum(new)::bigint as tokens, sum(length(t))::bigint as chars from marked group by all",
    "ancestors": f"""
        with recursive {TYPES}, up(name, ancestor, distance) as (
            select name, name, 0 from types union all select up.name, types.parent, up.distance + 1 from up join types on types.name = up.ancestor where types.parent is not null)
        , {PAGES.split("with", 1)[1]}, counts as (select type, sum(new)::bigint as n from marked group by type)
        select name, ancestor, distance::int as distance, coalesce(n, 0)::bigint as tokens from up left join counts on type = name""",
    "lexer_list": f"{PAGES}, {KEYS}, counts as (select lexer, sum(new)::bigint as n from marked group by lexer) select ord, keys.lexer, kind, pos, value, coalesce(n, 0)::bigint as tokens from keys left join counts using (lexer)",
    "option_list": f"with {OPTIONS}, {GUESSES} select owner_kind, owner, name, type, dflt as \"default\", coalesce(texts, 0)::bigint as texts from opts left join guesses using (owner)",
    "named_lexers": f"""
        with {KEYS}, known as (select value, (row_number() over (order by value) - 1)::int as k from (select name as value from lexers union select value from keys where kind in ('alias', 'mime'))),
        asked as (select case when o_orderkey % 2 = 0 then upper(value) else value end as value from orders join known on k = o_orderkey % (select count(*) from known)),
        named as (select upper(k) as k, arg_min(name, ord) as named from (select name as k, name, ord from lexers union all select value, lexer, ord from keys where kind = 'alias') group by 1),
        typed as (select value as k, arg_min(lexer, ord) as typed from keys where kind = 'mime' group by 1)
        select value, named, typed, count(*) as orders from asked left join named on named.k = upper(value) left join typed on typed.k = value group by all""",
    "theme_css": f"""
        {PAGES}, {TYPES}, {STYLES}, groups as (
            select theme, fg, bg, bold, italic, underline, min(id) as head, string_agg('.code .' || cssclass, ', ' order by id) as names from styles join types on types.name = styles.type
            where cssclass <> ' ' and (fg is not null or bg is not null or bold or italic or underline) and name in (select type from marked) group by all)
        select theme, string_agg(names || ' {{' || chr(10) || coalesce('  background-color: ' || bg || ';' || chr(10), '') || coalesce('  color: ' || fg || ';' || chr(10), '') || case when bold then '  font-weight: bold;' || chr(10) else '' end
            || case when italic then '  font-style: italic;' || chr(10) else '' end || case when underline then '  text-decoration: underline;' || chr(10) else '' end || '}}' || chr(10), '' order by head) as css from groups group by theme""",
    "sample_document": f"""
        {PAGES}, {TYPES}, lines as (select id, name, replace(replace(replace(name || ': ' || description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as text, case when cssclass = ' ' then ' ' else cssclass[1:2] end as class from types where name in (select type from marked))
        select '<pre>' || string_agg(case when name = 'IGNORABLE' then text else '<span class="' || class || '">' || text || '</span>' end || chr(10), '' order by id) || '</pre>' as html from lines""",
    "markdown": f"""
        with {KEYS}, {OPTIONS}, {GUESSES}, {values("formatters", "name, description", catalog.FORMATTERS.items())},
        lines as (select lexer, string_agg(value, ', ' order by pos) filter (kind = 'alias') as a, string_agg(value, ', ' order by pos) filter (kind = 'glob') as g, string_agg(value, ', ' order by pos) filter (kind = 'mime') as m from keys group by lexer),
        heads as (select 'lexer' as kind, name as owner, ord, '## ' || name || coalesce(chr(10) || chr(10) || 'Alias(es): ' || a, '') || coalesce(chr(10) || chr(10) || 'Filename(s): ' || g, '') || coalesce(chr(10) || chr(10) || 'MIME type(s): ' || m, '') as head from lexers left join lines on lexer = name
            union all select 'formatter', name, 0, '## ' || name || chr(10) || chr(10) || description from formatters),
        tables as (select owner_kind, owner, string_agg(line, chr(10) order by line) as lines from (select owner_kind, owner, '| ' || name || ' | ' || type || ' | ' || coalesce(dflt, 'null/none') || ' |' as line from opts) group by all)
        select kind, h.owner, ord::int as ord, head || coalesce(chr(10) || chr(10) || '| Option | Type | Default value |' || chr(10) || '| --- | --- | --- |' || chr(10) || lines, '') as markdown, coalesce(texts, 0)::bigint as texts
        from heads h left join tables t on t.owner_kind = kind and t.owner = h.owner left join guesses on guesses.owner = h.owner""",
    "encodings": """
        with w(written, mark, told, size) as (values ('UTF-8', 3, 'UTF-8', 1), ('UTF-16LE', 2, 'UTF-16LE', 2), ('UTF-16BE', 2, 'UTF-16BE', 2), ('UTF-8', 0, 'UTF-8', 1))
        select written, c_name, told, c_name as text, size = 2 as "binary", (case when written = 'UTF-8' then mark + length(c_name) else 0 end)::int as bad from w, customer""",
    "keywords_by_language": f"""
        with {values("words", "k, language, list, type, word", ((k, *w) for k, w in enumerate((language, kind, type_, word) for language, kind, type_, words in WORDS for word in words.split())))}
        select language, list, type, count(distinct word) as words, count(*) as uses from orders join words on k = o_orderkey % (select count(*) from words) group by all""",
    "golden_tokens": f"""
        with {values("golden", "language, seq, lexer, type, text", golden_rows())}
        select s_suppkey::bigint as s_suppkey, language, seq::bigint as seq, lexer, type, replace(replace(text, '{{k}}', s_suppkey::varchar), '{{n}}', 'S' || s_nationkey::varchar) as text from golden, supplier""",
    "embedded_tokens": f"""
        with {values("golden", "language, seq, path, type, text", embedded_rows())}
        select page_id, language, seq::bigint as seq, path, type, replace(text, '{{u}}', 'u' || regexp_replace(url, '[^a-z0-9]', '', 'g')) as text from golden, pages""",
    "embedded_spans": f"""
        with {values("golden", "language, seq, path, type, text", embedded_rows())},
        paths as (select language, seq, string_split(path, '/') as p, coalesce(lag(string_split(path, '/')) over (partition by language order by seq), [split_part(language, ' ', 1)]) as was from golden),
        entered as (select language, sum(len(p) - (select count(*) from unnest(range(1, least(len(p), len(was)) + 1)) as u(k) where p[1:k] = was[1:k])) as n from paths group by language)
        select language, count(*) as pages, sum(n)::bigint as spans, 0::bigint as unbalanced from entered, pages group by language""",
    "long_constructs": """
        with n as (select (o_orderkey * 37 % case when o_orderkey % 100 = 0 then 2000 else 20 end)::bigint as n, count(*) as texts from orders group by 1),
        kinds(language, type, tokens, per) as (values
            ('C', 'COMMENT_SINGLE', 1, 0), ('C', 'KEYWORD', 1, 0), ('HTML', 'NAME_TAG', 2, 0), ('HTML', 'NAME_ATTRIBUTE', 0, 1), ('HTML', 'STRING_SINGLE', 0, 1),
            ('Javascript', 'STRING_DOUBLE', 2, 0), ('Javascript', 'SEQUENCE_ESCAPED', 1, 0), ('Javascript', 'KEYWORD', 1, 0), ('Python', 'STRING_SINGLE', 1, 1), ('Python', 'SEQUENCE_ESCAPED', 0, 1), ('Python', 'KEYWORD', 1, 0))
        select language, type, sum(texts * (tokens + per * (n + 1)))::bigint as tokens from n, kinds group by all""",
}


def part(colour: str, at: int) -> str:
    return f"('0x' || {colour}[{at}:{at + 1}])::int"


def rgb(colour: str, between: str) -> str:
    return f" || '{between}' || ".join(part(colour, at) for at in (2, 4, 6))


def distance(colour: str) -> str:
    return " + ".join(f"({part(colour, at)} - {c}) ** 2" for c, at in zip("rgb", (2, 4, 6), strict=True))


#: The lengths of what each formatter makes of a page: what goes around tokens by type, and the texts.
FORMATS = r""",
    TYPES, STYLES, BASE,
    molokai as (select t.id, s.* from styles s join types t on t.name = s.type where theme = 'Molokai'),
    shades as (select c, row_number() over (order by min(id * 2 + slot)) as n from (select fg as c, id, 0 as slot from molokai union all select bg, id, 1 from molokai) where c is not null group by c),
    near as (select c, arg_min(idx, (DISTANCE) * 1000 + idx) as idx from shades, base group by c),
    lines as (select m.type, case when bold then ';1' else '' end || case when italic then ';3' else '' end || case when underline then ';4' else '' end as marks,
        coalesce(';38;2;' || FG, '') || coalesce(';48;2;' || BG, '') as colours, coalesce(';38;5;' || f.idx, '') || coalesce(';48;5;' || b.idx, '') as near_colours,
        '{' || case when bold then '\b' else '' end || case when italic then '\i' else '' end || coalesce('\cb' || sb.n, '') || coalesce('\cf' || sf.n, '') || ' }' as rich,
        repeat('[b][/b]', bold::int + italic::int + underline::int) || coalesce('[color=#' || printf('%x%x%x', PARTS) || '][/color]', '') as board
        from molokai m left join near f on f.c = fg left join near b on b.c = bg left join shades sf on sf.c = fg left join shades sb on sb.c = bg),
    looks as (select *, case when bold then 'font-weight: bold;' else '' end || case when italic then 'font-style: italic;' else '' end || case when underline then 'text-decoration: underline;' else '' end || coalesce('color: ' || fg || ';', '') || coalesce('background-color: ' || bg || ';', '') as look from styles),
    around as (select t.name as type, coalesce(length(board), 0) as bbcode, case when t.name = 'IGNORABLE' then 0 else length('<span class=""></span>') + case when t.cssclass = ' ' then 1 else length(t.cssclass[1:2]) end end as html,
        case when t.name = 'IGNORABLE' then 0 else coalesce(length('<span style="' || look || '"></span>'), 0) end as html_styles, coalesce(length(rich), 0) as rtf,
        coalesce(length(chr(27) || '[' || (marks || colours)[2:] || 'm' || chr(27) || '[39;49;00m'), 0) as terminal, coalesce(length(chr(27) || '[' || (marks || near_colours)[2:] || 'm' || chr(27) || '[39;49;00m'), 0) as terminal_256
        from types t left join lines on lines.type = t.name left join looks on looks.type = t.name and theme = 'Monokai'),
    sheet as (select sum(length(names) + length(' {|}|') + length(look) + 3 * (length(look) - length(replace(look, ';', '')))) as n from (
        select look, string_agg('.' || cssclass, ', ') as names from looks join types on types.name = looks.type where theme = 'Molokai' and cssclass <> ' ' group by look)),
    shown as (select m.*, length(t) as n, length(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as escaped, length(regexp_replace(regexp_replace(t, '[\\{}]', 'xx', 'g'), '\r\n|[\r\n]', '12345', 'g')) as quoted,
        case when lexer <> 'HTML' and lag(lexer) over w = 'HTML' then length('<SPAN class="">' || lexer) when lexer = 'HTML' and lag(lexer) over w <> 'HTML' then length('</SPAN>') else 0 end as moved from marked m window w as (partition by page_id order by i, j))
    select page_id, (sum(n + new * bbcode) + length('[code][/code]'))::bigint as bbcode,
        (sum(escaped + moved + new * html) + (select n from sheet) + length('<!DOCTYPE html>|<html>|  <head>|    <title>a &amp; b</title>|    <meta charset="utf-8">|    <style type="text/css">|    </style>|  </head>|  <body>|    <pre></pre>|  </body>|</html>'))::bigint as html,
        (sum(escaped + moved + new * html_styles) + length('<pre></pre>'))::bigint as html_styles,
        (sum(quoted + new * rtf) + (select sum(length('\red\green\blue;' || SHADE)) from shades) + length('{\rtf1\ansi\uc0\deff0{\fonttbl{\f0\fmodern\fprq1\fcharset0;}}{\colortbl;}\f0 }'))::bigint as rtf,
        sum(n + new * terminal)::bigint as terminal, sum(n + new * terminal_256)::bigint as terminal_256
    from shown join around using (type) group by page_id"""
for name, sql in (
    ("TYPES", TYPES),
    ("STYLES", STYLES),
    ("BASE", values("base", "idx, r, g, b", ((k, *c) for k, c in enumerate(catalog.palette())))),
    ("DISTANCE", distance("c")),
    ("FG", rgb("fg", ";")),
    ("BG", rgb("bg", ";")),
    ("PARTS", ", ".join(part("fg", at) for at in (2, 4, 6))),
    ("SHADE", rgb("c", "")),
):
    FORMATS = FORMATS.replace(name, sql, 1)
ORACLE_SQL["formats"] = PAGES + FORMATS
