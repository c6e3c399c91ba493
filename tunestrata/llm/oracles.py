"""SQL for DuckDB that says the same as the queries that SQL can express."""

from __future__ import annotations

from tunestrata.llm import rules, secrets

WORD = r"[^\x20\x09-\x0D]"


def _bits(measures: str) -> str:
    parts = (f"case when {rule} then {1 << bit} else 0 end" for bit, rule in enumerate(rules.RULES.values()))
    return f"select *, cast({' + '.join(parts)} as bigint) as failed from {measures}"


RULE_LEDGER = f"""
    with d as (select doc_id, row_number() over () as i, coalesce(text, '') as t from documents),
         w as (select *, regexp_extract_all(t, '{WORD}+') as words,
                      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from d),
         p as (select i, unnest(range(1, cast(len(words) as bigint) - 1)) as spot, words from w where len(words) >= 3),
         g as (select i, spot, concat_ws(' ', words[spot], words[spot + 1], words[spot + 2]) as gram from p),
         again as (select i, spot, count(*) over (partition by i, gram) as times from g),
         marked as (select i, count(distinct spot + step) as n
                    from again, (values (0), (1), (2)) s(step) where times > 1 group by i),
         m as (select doc_id, cast(len(words) as bigint) as n_words,
                      cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
                      cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
                      cast(len(lines) as bigint) as n_lines,
                      cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
                      coalesce(n, 0) as n_repeat_words
               from w left join marked on w.i = marked.i),
         f as ({_bits('m')})
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
           (failed & {rules.mask(rules.BASE)}) <> 0 as base_failed,
           (failed & {rules.mask(rules.POLICIES[rules.CURRENT])}) = 0 as kept, '{rules.CURRENT}' as policy
    from f"""


_NAMES = list(rules.RULES)
_CASES = ", ".join(
    f"('{policy}', '{rule}', {rules.mask(members)}, {1 << _NAMES.index(rule)})" for policy, members in rules.POLICIES.items() for rule in members
)
RULE_POLICIES = f"""
    select p.policy, rule, count(*) filter (where (failed & members & bit) <> 0) as n_failed,
           count(*) filter (where (failed & members) = bit) as n_only, count(*) filter (where (failed & members) = 0) as n_kept
    from ({RULE_LEDGER}) l, (values {_CASES}) p(policy, rule, members, bit) group by p.policy, rule"""


def _kind_sql(kind: str) -> str:
    """Spans of one kind: lengths of what lies between matches and of the matches, added up."""
    pattern, group, least = secrets.KINDS[kind]
    quoted = pattern.replace("'", "''")
    place = list(secrets.KINDS).index(kind)
    return f"""
        select i, '{kind}' as kind, {place} as place, start, start + length(found[k]) as stop from (
            select i, found, held, k,
                   list_sum(list_transform(gaps[1:k], lambda x: length(x)))
                       + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) as start
            from (select i, string_split_regex(t, '{quoted}') as gaps, regexp_extract_all(t, '{quoted}') as found,
                         regexp_extract_all(t, '{quoted}', {group}) as held,
                         unnest(range(1, cast(len(regexp_extract_all(t, '{quoted}')) as bigint) + 1)) as k
                  from d where regexp_matches(t, '{quoted}')) x) y
        where length(held[k]) >= {least}"""


_SPANS = " union all ".join(_kind_sql(kind) for kind in secrets.KINDS)
_ONE = "concat(kind, ':', cast(start as bigint), ':', cast(stop as bigint))"
_BASE = ", ".join(f"'{k}'" for k in secrets.BASE)

SECRET_LEDGER = f"""
    with d as (select doc_id, row_number() over () as i, coalesce(text, '') as t from documents),
         s as ({_SPANS}),
         by_doc as (select i, {", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in secrets.BASE)},
                           string_agg({_ONE}, ',' order by start, place) filter (where kind in ({_BASE})) as base,
                           string_agg({_ONE}, ',' order by start, place) as spans
                    from s group by i)
    select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in secrets.BASE)},
           sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join by_doc on d.i = by_doc.i"""

LEDGER_RUNS = f"""
    with d as materialized (
             select row_number() over () as i, t, part
             from (select coalesce(text, '') as t, 1 as part from documents union all select coalesce(html, ''), 2 from pages)),
         s as ({_SPANS}),
         by_text as (select i, count(*) filter (where kind = 'hex') as n_hex from s group by i),
         r as (select part, t, coalesce(n_hex, 0) as n_hex, by_text.i is not null as held from d left join by_text on d.i = by_text.i),
         blobs as (select count(distinct t) as n, count(distinct t) filter (where part = 1) as first_n from r),
         runs as (select * from (values (1, 1), (2, 2), (3, 2)) v(run, upto))
    select run, count(*) as n_paths, cast(sum(n_hex) as bigint) as n_hex, count(*) filter (where held) as n_with_secrets,
           max(case run when 1 then first_n when 2 then n - first_n else 0 end) as n_scanned
    from runs join r on part <= upto cross join blobs group by run"""

WARC_CHUNKS = """
    with p as (select page_id, encode(coalesce(html, '')) as payload, sha256(coalesce(html, '')) as d from pages),
         f as (select d, min(page_id) as first from p where octet_length(payload) >= 100 group by d)
    select page_id, cast(octet_length(payload) as bigint) as payload_bytes, p.d as payload_digest,
           case when page_id > first then 'revisit' else 'response' end as record_type,
           case when page_id > first then first end as refers_to
    from p left join f on p.d = f.d"""



def _vector_groups(vectors: str) -> str:
    return f"""
    with recursive
         v as ({vectors}),
         p as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
               where list_cosine_similarity(a.e, b.e) >= 0.95),
         r as (select vec_id as a, vec_id as b from v union select r.a, p.b from r join p on r.b = p.a),
         least_of as (select a, min(b) as least from r group by a),
         n as (select a, count(*) as n from p group by a)
    select vec_id, coalesce(n, 0) as n_links, least as component_id, vec_id = least as kept
    from v join least_of l on vec_id = l.a left join n on vec_id = n.a"""


COVER_TREE = _vector_groups("select vec_id, cast(embedding as double[]) as e from embeddings")

_TURN = "list_transform(e, lambda x, i: x + {rate} * e[i % len(e) + 1])"
TURNED_VECTORS = _vector_groups(
    f"""select vec_id * 4 + k as vec_id,
               case k when 0 then e when 1 then {_TURN.format(rate=0.25)} when 2 then {_TURN.format(rate=0.45)}
                      else list_transform(e, lambda x: 3 * x) end as e
        from (select vec_id, cast(embedding as double[]) as e from embeddings) x, range(4) t(k)"""
)
