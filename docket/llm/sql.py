"""DuckDB SQL of the operators that SQL can express, written apart from the Spark code."""

from __future__ import annotations

PHRASE_COLLOCATIONS = r"""
with texts as (
    select coalesce(lang, 'und') as lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select row_number() over () as piece, lang, p
           from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from texts)),
words as (select piece, lang, unnest(list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '')) as w1,
                 generate_subscripts(list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> ''), 1) as i
          from pieces),
placed as (select lang, w1, lead(w1, 1) over one as w2, lead(w1, 2) over one as w3, lead(w1, 3) over one as w4
           from words window one as (partition by piece order by i)),
grams as (
    select lang, 1 as m, w1 as phrase from placed
    union all select lang, 2, w1 || ' ' || w2 from placed where w2 is not null
    union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from placed where w3 is not null
    union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from placed where w4 is not null),
freq as materialized (select lang, m, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from freq where m = 1 group by lang),
cand as materialized (select * from freq where m > 1 and f >= 30),
keyed as materialized (select lang || chr(10) || phrase as key, f from freq),
split as (select *, string_split(phrase, ' ') as ws, unnest(range(1, m)) as k from cand),
cuts as materialized (
    select c.lang, c.m, c.phrase, c.f as a, k, l.f as l, r.f as r, ((2000000::hugeint * c.f) // (l.f + r.f))::bigint as score
    from split c
    join keyed l on l.key = c.lang || chr(10) || array_to_string(c.ws[1:k], ' ')
    join keyed r on r.key = c.lang || chr(10) || array_to_string(c.ws[k + 1:], ' ')),
least as materialized (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
    select * from least s
    where not exists (select 1 from cand g where g.lang = s.lang and g.m > s.m
                      and contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') and 100 * g.f >= 80 * s.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score
from ranked join totals using (lang) where rank <= 2000
"""

_FIELDS = " || ".join(
    f"coalesce(strlen({c})::varchar || ':' || {c}, '-')"
    for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", "TEXT"))

# CRC-32 bit by bit: a byte is mixed in, then eight shifts (-1)
_CRC = """xor(list_reduce(flatten(list_transform(string_split(%s, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, 4294967295::bigint),
    4294967295::bigint)"""

MERKLE_MANIFEST = f"""
with recursive leaves as materialized (
    select row_number() over () as rid, doc_id, source, sha256({_FIELDS.replace("TEXT", "text")}) as leaf,
           case when {_CRC % 'doc_id::varchar'} % 2 = 0 then sha256({_FIELDS.replace("TEXT", "replace(text, chr(10), '')")}) end as tampered
    from documents),
placed as materialized (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n
    from leaves),
up(level, source, i, n, h) as (
    select 0, source, i, n, leaf from placed
    union all
    select level + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from up where n > 1
    group by level, source, i // 3, n),
subroots as materialized (
    select source, h as subroot, row_number() over (order by source is not null, encode(source)) - 1 as i, count(*) over () as n
    from up where n = 1),
top(level, i, n, h) as (
    select 0, i, n, subroot from subroots
    union all
    select level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from top where n > 1 group by level, i // 3, n),
root as (select h as root from top where n = 1),
powers as (select p, (3 ** p)::bigint as t from range(0, 40) x(p)),
proof as materialized (
    select rid, string_agg(h, '' order by part, level, i) as siblings from (
        select p.rid, 0 as part, u.level, u.i, u.h
        from placed p join powers x on x.t < p.n
        join up u on u.level = x.p and u.source is not distinct from p.source and u.n > 1
             and u.i // 3 = p.i // x.t // 3 and u.i <> p.i // x.t
        union all
        select p.rid, 1, u.level, u.i, u.h
        from placed p join subroots s on s.source is not distinct from p.source
        join powers x on x.t < s.n
        join top u on u.level = x.p and u.n > 1 and u.i // 3 = s.i // x.t // 3 and u.i <> s.i // x.t)
    group by rid),
fold(level, rid, source, i, n, h) as (
    select 0, rid, source, i, n, coalesce(tampered, leaf) from placed
    union all
    select f.level + 1, f.rid, f.source, f.i // 3, (f.n + 2) // 3,
           sha256(string_agg(case when u.i = f.i then f.h else u.h end, '' order by u.i))
    from fold f join up u on u.level = f.level and u.source is not distinct from f.source and u.i // 3 = f.i // 3
    where f.n > 1 group by f.level, f.rid, f.source, f.i, f.n),
refold(level, rid, i, n, h) as (
    select 0, f.rid, s.i, s.n, f.h from fold f join subroots s on s.source is not distinct from f.source where f.n = 1
    union all
    select f.level + 1, f.rid, f.i // 3, (f.n + 2) // 3,
           sha256(string_agg(case when u.i = f.i then f.h else u.h end, '' order by u.i))
    from refold f join top u on u.level = f.level and u.i // 3 = f.i // 3
    where f.n > 1 group by f.level, f.rid, f.i, f.n)
select p.doc_id, p.leaf, s.subroot, root.root, sha256(coalesce(proof.siblings, '')) as proof_sha256, f.h as folded_root,
       f.h = root.root as verified
from placed p join subroots s on s.source is not distinct from p.source
join refold f on f.rid = p.rid and f.n = 1 left join proof on proof.rid = p.rid cross join root
"""
