"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm.common import read
from lexigrain.llm.decontamination import decontaminate
from lexigrain.llm.exact_dedup import exact_dedup
from lexigrain.llm.gif import text_media
from lexigrain.llm.hard_negatives import mine
from lexigrain.llm.html_text import extract
from lexigrain.llm.mixing import mix
from lexigrain.llm.near_dedup import near_dedup
from lexigrain.llm.packing import pack
from lexigrain.llm.prefix_trie import prefix_trie, shared_heads, turns_of
from lexigrain.llm.token_counts import count_tokens
from lexigrain.llm.toxicity import toxicity
from lexigrain.llm.url_filter import judge_urls
from lexigrain.llm.warc import archived_pages


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), shingle_words=2)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings"), label=label)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*shared_heads(turns_of(read(spark, sf_dir, "conversations"))))


def level(rows: str, parents: str, name: str, budget: str) -> str:
    """SQL that divides the parents' budget among children with w and cap, as water fills vessels."""
    over = f"partition by {parents}"
    return f"""
        select *, case when is_full then cap when w_open > 0 then greatest({budget} - c_full, 0) * w // w_open else 0 end as share from (
            select *, sum(case when is_full then cap else 0 end) over ({over}) as c_full, sum(case when is_full then 0 else w end) over ({over}) as w_open from (
                select *, w > 0 and cap * (w_all - w_before) <= ({budget} - c_before) * w as is_full from (
                    select *, sum(w) over ({over}) as w_all, coalesce(sum(w) over earlier, 0) as w_before, coalesce(sum(cap) over earlier, 0) as c_before
                    from ({rows}) window earlier as ({over} order by case when w > 0 then cap::double / w end nulls last, {name} rows between unbounded preceding and 1 preceding))))"""


MIXING = f"""
    with named as (select doc_id, coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+'))::bigint as tokens from documents),
    d as (select *, case when not regexp_matches(source, '^src[0-9]{{1,9}}$') then 'other' when substr(source, 4)::int < 7 then 'web' when substr(source, 4)::int < 14 then 'reference' else 'community' end as domain from named),
    leaf as (select domain, lang, source, sum(tokens)::hugeint as leaf_tokens, 4 * sum(tokens)::hugeint as cap, 1 as w from d group by all),
    tops as ({level("select domain, sum(cap)::hugeint as cap, any_value(case domain when 'web' then 5 when 'reference' then 3 when 'community' then 2 else 1 end) as w, (select sum(leaf_tokens) from leaf) as budget, 0 as root from leaf group by domain", "root", "domain", "budget")}),
    mids as ({level("select l.domain, l.lang, sum(l.cap)::hugeint as cap, any_value(case l.lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end) as w, any_value(t.share) as budget from leaf l join tops t using (domain) group by l.domain, l.lang", "domain", "lang", "budget")}),
    lows as ({level("select l.*, m.share as budget from leaf l join mids m using (domain, lang)", "domain, lang", "source", "budget")}),
    plans as (select domain, lang, source, leaf_tokens, share, case when leaf_tokens > 0 then least(4, share // leaf_tokens) else 1 end as whole from lows),
    parts as (select *, case when whole < 4 then share - whole * leaf_tokens else 0 end as prefix from plans),
    placed as (select *, sum(tokens) over (partition by domain, lang, source order by md5('17:' || whole::bigint || ':' || doc_id)) as upto from d join parts using (domain, lang, source))
    select doc_id, domain, lang, source, tokens, share::bigint as leaf_budget, (whole + case when upto <= prefix and leaf_tokens > 0 then 1 else 0 end)::bigint as times from placed"""


URLS = """
    with a as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
    rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
    hits as (select page_id, p.host, p.path, arg_max(h || rules.p, length(h || rules.p)) as rule, arg_max(v, length(h || rules.p)) as v
        from p left join rules on (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, rules.p) group by all)
    select page_id, host, path, rule, coalesce(v, case when regexp_matches(host, '^(.*[.])?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)([.]|$)') then 'block' else 'allow' end) as verdict from hits"""


NEGATIVES = """
    with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
        from embeddings where label is not null and embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
    s as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_inner_product(a.q, b.q)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    p as (select anchor_id, own, vec_id as positive_id, score as positive_score from s where own = label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select anchor_id, positive_id, (row_number() over best)::int as rank, s.vec_id as negative_id, positive_score, score as negative_score
    from p join s using (anchor_id) where s.label <> p.own and 80 * positive_score <= 100 * score and score <= positive_score
    window best as (partition by anchor_id, positive_id order by score desc, s.vec_id) qualify row_number() over best <= 5"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = f"""
    with d as (select row_number() over () as k, doc_id, {WORDS} as w from documents),
    i as (select item_id, {WORDS} as w from benchmark),
    wins as (select item_id, least(10, len(w)) as n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0),
    grams as (select item_id, n, array_to_string(w[s:s + n - 1], ' ') as g from wins),
    starts as (select k, n, w, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from wins) where len(w) >= n),
    hits as (select k, s, n, item_id from (select k, s, n, array_to_string(w[s:s + n - 1], ' ') as g from starts) join grams using (n, g)),
    hit as (select k, count(distinct p) as n_hit from (select k, unnest(range(s, s + n)) as p from hits) group by k),
    ids as (select k, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct k, item_id::varchar as x from hits) group by k)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit using (k) left join ids using (k)"""

TRIE = r"""
    with recursive c as (select distinct conv_id from conversations where conv_id is not null),
    bits(conv_id, i, crc) as (select conv_id, 0, 4294967295::bigint from c union all
        select conv_id, i + 1, xor(x // 2, case when x % 2 = 1 then 3988292384::bigint else 0::bigint end)
        from (select conv_id, i, case when i % 8 = 0 then xor(crc, ascii(t[i // 8 + 1])::bigint) else crc end as x from (select *, conv_id::varchar as t from bits) where i < 8 * length(t))),
    h as (select conv_id, xor(max_by(crc, i), 4294967295::bigint) % 4 as h from bits group by conv_id),
    o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place, {'r': coalesce(role, ''), 't': coalesce(text, '')} as x from conversations where conv_id is not null),
    l as (select conv_id, list(x order by place) as x from o group by conv_id),
    r as (select l.conv_id, coalesce(b.x, [])[1:h] || l.x[h + 1:] as x from l join h using (conv_id) left join l b on b.conv_id = l.conv_id - l.conv_id % 20),
    m as (select conv_id, d, x[1:d] as node, x[1:d - 1] as up, len(x) = d as is_end from r, unnest(range(0, len(x) + 1)) as u(d)),
    n as (select d, node, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end) as ends from m group by d, node),
    kids as (select d - 1 as d, up as node, count(*) as n_children from n where d > 0 group by 1, 2),
    v as (select n.*, coalesce(n_children, 0) as n_children, case when n.d = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(node[n.d].t, '[^ 	-
]+')) end as saved from n left join kids using (d, node)),
    s as (select u as d, node[1:u] as node, count_if(n_children = 0) as n_leaves, sum(saved) as saved_tokens from (select *, unnest(range(0, d + 1)) as u from v) group by 1, 2)
    select v.conv_id, v.d::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
    from v join s using (d, node) left join v p on v.d > 0 and p.d = v.d - 1 and p.node = v.up"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
                   doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
            from documents window g as (partition by coalesce(text, ''))""",
        "op4_url_filter": URLS,
        "op6_mixing": MIXING,
        "op11_hard_negatives": NEGATIVES,
        "op12_decontamination": LEAKS,
        "op13_prefix_trie": TRIE,
        "op9_warc": """
            with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
            k as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) else page_id end as keep_id from p)
            select page_id, payload_bytes, payload_digest, case when keep_id = page_id then 'response' else 'revisit' end as record_type, case when keep_id <> page_id then keep_id end as refers_to from k""",
    }
