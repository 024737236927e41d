"""PHP names whose meaning the grammar tells, not the scanner: a fold over the tokens with a small state.

The state knows which braces are class bodies, where a function's parameters end, and whether a property
declaration is under way. It gives a letter for each token (``i`` property, ``t`` built-in type, ``c`` class, ``.`` as it
is); letters are gathered in stretches, so a text of any length takes nearly linear time. No grammar is kept:
what doesn't parse keeps the scanner's types.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.operators.languages import PHP_TYPES
from lexigrain.operators.lexing import bound, literal

#: Tokens of one inner fold.
STRETCH = 256


def any_of(words: str) -> str:
    return "(" + ", ".join(map(literal, words.split())) + ")"


def step_sql() -> str:
    """SQL of the state after token ``t``, from the state ``a`` before it."""
    counted = lambda these: f"(length(t.text) - length(translate(t.text, '{these}', '')))"
    mark = "t.type = 'PUNCTUATION'"
    seen = f"""named_struct('l', lower(t.text), 'mark', {mark}, 'last', if({mark}, right(t.text, 1), ''), 'top', right(a.stack, 1),
        'par', if({mark}, a.par + {counted('([')} - {counted(')]')}, a.par), 'net', if({mark}, {counted('{')} - {counted('}')}, 0),
        'start', a.prev = '' or right(a.prev, 1) in (';', '{{', '}}'), 'variable', t.type in ('NAME_VARIABLE', 'NAME_VARIABLE_INSTANCE'),
        'name', t.type in ('NAME_CONSTANT', 'NAME_CLASS', 'NAME_FUNCTION', 'KEYWORD_TYPE') or t.type = 'KEYWORD' and lower(t.text) in ('array', 'callable'))"""
    begins = "t.type in ('KEYWORD', 'NAME_FUNCTION') and v.l in ('function', 'fn') and a.prev <> '->' and a.prev <> '::'"
    function = f"""case when {begins} then 1
        when a.fn = 1 and v.mark then case when v.par > a.fn_par then 2 when contains(t.text, '(') and v.last = ')' then 3 else 0 end
        when a.fn = 2 then if(v.mark and v.par <= a.fn_par, if(v.last = ')', 3, 0), 2)
        when a.fn = 3 then case when t.type = 'OPERATOR' and startswith(t.text, ':') then 4 when v.l = 'use' then 1 else 0 end
        when a.fn = 4 then if(v.mark and t.text rlike '[{{;]' or t.type = 'OPERATOR' and startswith(t.text, '=>'), 0, 4)
        else a.fn end"""
    modifier = f"t.type = 'KEYWORD' and v.l in {any_of('public private protected var')} and (v.start or a.prop = 1 or a.fn = 2) or v.l in {any_of('static readonly final abstract')} and (a.prop = 1 or v.start and v.top = 'c')"
    declared = f"""case when {modifier} then 1
        when a.prop in (1, 3) and v.variable then if(a.fn = 2, 0, 2)
        when a.prop = 1 and (v.name or t.type = 'KEYWORD_CONSTANT' or t.type = 'OPERATOR' and t.text rlike '^[?|&]+$') then 1
        when a.prop = 2 and not (v.mark and (v.par < a.prop_par or v.par = a.prop_par and contains(t.text, ';'))) then if(v.par = a.prop_par and v.last = ',', 3, 2)
        else 0 end"""
    letter = f"""case when a.prop in (1, 3) and t.type = 'NAME_VARIABLE' then 'i'
        when v.name and (a.fn = 4 or a.prop = 1 and v.l <> 'readonly') then if(v.l in {any_of(PHP_TYPES)}, 't', 'c') else '.' end"""
    after = f"""named_struct('stack', case when v.net > 0 then concat(a.stack, if(a.cls = 1, 'c', 'b'), repeat('b', v.net - 1)) when v.net < 0 then left(a.stack, greatest(length(a.stack) + v.net, 0)) else a.stack end,
        'cls', case when t.type = 'KEYWORD' and v.l in {any_of('class trait interface')} and a.prev <> '::' then 1 when v.mark and t.text rlike '[{{;]' then 0 else a.cls end,
        'fn', {function}, 'fn_par', if({begins}, a.par, a.fn_par), 'par', v.par, 'prop', {declared}, 'prop_par', if(a.prop = 1, a.par, a.prop_par),
        'prev', case when t.type = 'NAME_TAG' then ';' else right(t.text, 2) end, 'letters', concat(a.letters, {letter}))"""
    same = ", ".join(f"'{f}', a.{f}" for f in ("stack", "cls", "fn", "fn_par", "par", "prop", "prop_par", "prev"))
    aside = "t.lexer <> 'PHP' or t.type = 'IGNORABLE' or startswith(t.type, 'COMMENT')"
    return f"if({aside}, named_struct({same}, 'letters', concat(a.letters, '.')), {bound('v', seen, after)})"


def retagged_sql() -> str:
    """A function of tokens, as SQL."""
    begin = "named_struct('stack', '', 'cls', 0, 'fn', 0, 'fn_par', 0, 'par', 0, 'prop', 0, 'prop_par', 0, 'prev', '', 'letters', '')"
    bare = ", ".join(f"'{f}', s.{f}" for f in ("stack", "cls", "fn", "fn_par", "par", "prop", "prop_par", "prev"))
    inner = f"aggregate(slice(ts, k, {STRETCH}), named_struct({bare}, 'letters', ''), (a, t) -> {step_sql()})"
    outer = bound("e", inner, f"named_struct({bare.replace('s.', 'e.')}, 'letters', concat(s.letters, e.letters))")
    letters = f"aggregate(sequence(1, size(ts), {STRETCH}), {begin}, (s, k) -> {outer}, s -> s.letters)"
    types = "case letter when 'i' then 'NAME_VARIABLE_INSTANCE' when 't' then 'KEYWORD_TYPE' else 'NAME_CLASS' end"
    changed = f"named_struct('lexer', t.lexer, 'depth', t.depth, 'type', {types}, 'text', t.text, 'path', t.path)"
    each = f"transform(ts, (t, k) -> {bound('letter', 'get(letters, k)', f"if(letter = '.', t, {changed})")})"
    return f"ts -> if(size(ts) > 0, {bound('letters', f"split({letters}, '')", each)}, ts)"


def retagged(tokens: Column) -> Column:
    """PHP tokens with return types, the types of properties, and all properties of a declaration."""
    return F.call_function("transform", F.array(tokens), F.expr(retagged_sql()))[0]
