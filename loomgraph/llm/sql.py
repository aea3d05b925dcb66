"""SQL equivalents of this subpackage's queries, for DuckDB over the same tables.

There is none for language, toxicity and quality (trained models), nor for the suffix-array dedup (too slow on whole
tables): those are tested against held-out labels and brute force.
"""

from __future__ import annotations

from loomgraph.llm import licenses, mixing, urls
from loomgraph.llm.text import LOWER, UPPER

ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def words(text: str, gaps: str) -> str:
    return f"list_filter(string_split_regex({text}, '{gaps}'), lambda x: x <> '')"


def near_duplicates() -> str:
    gaps = r"[\x20\x09-\x0D]+"
    return f"""
with recursive w as materialized (select doc_id, {words(lowered("text"), gaps)} as w from documents),
s as materialized (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
u as materialized (select doc_id, len(s) as n, unnest(s) as g from s),
l as materialized (select a.doc_id as a, b.doc_id as b from u a join u b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e as materialized (select a, b from l union all select b, a from l),
reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on e.a = reach.b),
c as (select a, min(b) as c from reach group by a),
m as (select s.doc_id, len(s.s) as n, least(s.doc_id, coalesce(c.c, s.doc_id)) as component_id, s.s from s left join c on c.a = s.doc_id),
k as (select list_sort(s) as s, min(doc_id) as class_id from s where len(s) > 0 group by 1)
select m.doc_id, m.n as n_shingles, m.component_id, m.doc_id = m.component_id as kept, coalesce(k.class_id, m.doc_id) as class_id
from m left join k on k.s = list_sort(m.s) and m.n > 0"""


def top_k() -> str:
    return """
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2]))::bigint as score
  from v q, v r where q.vec_id % 20 = 0 and q.vec_id <> r.vec_id),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank, vec_id, score from k where rank <= 20"""


def decontamination() -> str:
    return f"""
with d as materialized (select doc_id, {words(lowered("text"), ALNUM)} as w from documents),
b as materialized (select item_id::varchar as item, {words(lowered("text"), ALNUM)} as w from benchmark where item_id is not null),
p as materialized (select distinct item, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
  from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)),
lengths as (select distinct k from p),
o as materialized (select d.doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + k - 1], ' ')}})) as x
  from d, lengths where len(w) >= k),
h as materialized (select o.doc_id, o.x.i as i, o.k, p.item from o join p on p.g = o.x.g and p.k = o.k),
n as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from (select distinct doc_id, i, k from h)) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(n.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.items, '')) as items_sha256,
  coalesce(n.n_hit, 0) > 0 and 20 * coalesce(n.n_hit, 0) >= len(d.w) as contaminated
from d left join n on n.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""


def url_filter() -> str:
    rest = "case when instr({u}, '://') > 0 then substr({u}, instr({u}, '://') + 3) end"
    host = "translate(coalesce(regexp_extract({r}, '^([^/?#]*)', 1), ''), '%s', '%s')" % (UPPER, LOWER)
    own = rest.format(u="url")
    fit = "null"
    for verdict, h, p in sorted(urls.RULES, key=lambda r: len(r[1] + r[2])):
        fit = f"case when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{'rule': '{h}{p}', 'verdict': '{verdict}'}} else {fit} end"
    pattern = """(?i)href\\s*=\\s*["'']?([^"''\\s>]+://[^"''\\s>]+)"""
    d = urls.DAMPING
    chain = []
    for k in range(urls.ITERATIONS):
        chain.append(
            f"r{k + 1} as materialized (select h.host, {1 - d!r} * h.trusted + {d!r} * coalesce((select sum(r.trust / e.n_out) from e join r{k} r on r.host = e.src where e.dst = h.host), 0) as trust, "
            f"{1 - d!r} * h.blocked + {d!r} * coalesce((select sum(r.distrust / e.n_in) from e join r{k} r on r.host = e.dst where e.src = h.host), 0) as distrust from h)"
        )
    return f"""
with c as materialized (select page_id, html, {host.format(r=own)} as host, coalesce(regexp_extract({own}, '^[^/?#]*([^?#]*)', 1), '') as path from pages),
f as materialized (select *, {fit} as fit from c),
k as materialized (select host, max(coalesce(fit.verdict = 'allow', false)::int) as a, max(coalesce(fit.verdict = 'block', false)::int) as b from f where host <> '' group by host),
t as materialized (select greatest(1, coalesce(sum(a), 0))::double as a, greatest(1, coalesce(sum(b * (1 - a)), 0))::double as b from k),
h as materialized (select host, k.a / t.a as trusted, k.b * (1 - k.a) / t.b as blocked from k, t),
x as (select host as src, unnest(regexp_extract_all(html, '{pattern}', 1)) as url from c where contains(html, '://')),
y as (select src, {host.format(r=rest.format(u="url"))} as dst from x
  union select host, regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) from h union select regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1), host from h),
z as materialized (select distinct src, dst from y where src <> dst and src in (select host from h) and dst in (select host from h)),
e as materialized (select src, dst, count(*) over (partition by src) as n_out, count(*) over (partition by dst) as n_in from z),
r0 as materialized (select host, trusted as trust, blocked as distrust from h),
{", ".join(chain)},
bad as materialized (select host from r{urls.ITERATIONS}, t where distrust > {urls.MARGIN} * trust and distrust > {urls.FLOOR * (1 - d)!r} / t.b)
select page_id, host, path, fit.rule as rule, coalesce(fit.verdict, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from f"""


def license_scan() -> str:
    base, at = [], []
    for k, (phrase, label) in enumerate(licenses.PHRASES.items()):
        own = licenses.tokens(phrase)
        same = " and ".join(f"w[i + {j}] = '{t}'" for j, t in enumerate(own, 1))
        at.append(f"list_filter(range(0, len(w) - {len(own) - 1}), lambda i: {same})")
        base.append(f"case when len(at{k}) > 0 then '{label}' end")
    templates = []
    for template in licenses.TEMPLATES:
        own = sorted(set(licenses.tokens(template.text)))
        listed = ", ".join(f"'{t}'" for t in own)
        templates.append(f"('{template.label}', {template.block}, [{listed}], {licenses.needed(len(own), licenses.THRESHOLD)})")
    return f"""
with d as materialized (select doc_id, {lowered("text")} as t from documents),
w as materialized (select doc_id, t, {words("t", ALNUM)} as w from d),
a as materialized (select doc_id, len(w) as n_words, {", ".join(f"{x} as at{k}" for k, x in enumerate(at))} from w),
b as (select *, {" || ".join(f"at{k}" for k in range(len(at)))} as places, list_sort(list_distinct(list_filter([{", ".join(base)}], lambda x: x is not null))) as base from a),
t as materialized (select * from (values {", ".join(templates)}) v(label, n, own, least)),
x as materialized (select doc_id, string_split(t, chr(10)) as x from d),
y as (select doc_id, n, x, unnest(range(1, len(x) + 1)) as i from x, (select distinct n from t)),
l as (select doc_id, n, list_distinct({words("array_to_string(x[i:i + n - 1], chr(10))", ALNUM)}) as b from y),
m as (select l.doc_id, t.label, len(list_intersect(l.b, t.own)) / len(t.own)::double as score from l join t on l.n = t.n where len(list_intersect(l.b, t.own)) >= t.least),
g as (select doc_id, list(distinct label) as own, max(score) as score from m group by doc_id)
select b.doc_id, n_words, len(places) as n_base, list_min(places) as first_word, list_max(places) as last_word, array_to_string(base, ',') as base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(g.own, []))), ',') as labels,
  greatest(case when len(places) > 0 then 1.0::double else 0.0::double end, coalesce(g.score, 0.0::double)) as score
from b left join g on g.doc_id = b.doc_id"""


def source_mix() -> str:
    mix = mixing.Mix()

    def weight(level: str) -> str:
        cases = "".join(f" when {level} = '{n}' then {float(w)!r}::double" for n, w in mix.weights.get(level, {}).items())
        return f"(case{cases} else {mix.other!r}::double end)" if cases else f"{mix.other!r}::double"

    parts = [
        r"""d as materialized (select doc_id, ['web', 'books', 'code', 'reference'][coalesce(try_cast(regexp_extract(source, '(\d{1,9})$', 1) as bigint), 0) % 4 + 1] as domain,
coalesce(lang, 'none') as lang, coalesce(source, 'none') as source,
len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n_tokens from documents)""",
        f"leaf as materialized (select domain, lang, source, sum(n_tokens)::bigint as supply, sum(n_tokens)::double * {mix.max_epochs} as cap from d group by 1, 2, 3)",
        f"g0 as materialized (select floor(sum(supply)::double * {mix.budget_share!r}) as amount from leaf)",
    ]
    for depth, level in enumerate(mixing.LEVELS):
        parent, own = mixing.LEVELS[:depth], mixing.LEVELS[: depth + 1]
        names, by = ", ".join(own), ", ".join(parent) or "1"
        on = " and ".join(f"c.{p} = g.{p}" for p in parent) or "true"
        parts.append(f"c{depth} as materialized (select {names}, sum(cap) as cap, {weight(level)} as weight from leaf group by {names})")
        order = f"(partition by {by} order by cap / weight, {level} rows between unbounded preceding and 1 preceding)"
        after = f"(partition by {by} order by cap / weight, {level} rows between current row and unbounded following)"
        parts.append(
            f"t{depth} as materialized (select *, (amount - coalesce(sum(cap) over {order}, 0)) / sum(weight) over {after} as try from (select c.*, g.amount from c{depth} c join g{depth} g on {on}))"
        )
        parts.append(
            f"g{depth + 1} as materialized (select {names}, case when level is null then cap else least(cap, level * weight) end as amount from "
            f"(select *, max(case when try * weight < cap then try end) over (partition by {by}) as level from t{depth}))"
        )
    parts += [
        "q as materialized (select l.domain, l.lang, l.source, supply, floor(amount + 1e-6)::bigint as quota from leaf l join g3 g on l.domain = g.domain and l.lang = g.lang and l.source = g.source)",
        "w as materialized (select *, case when supply > 0 then quota // supply else 0 end as whole from q)",
        f"k as materialized (select d.*, w.quota, w.whole, w.quota - w.whole * w.supply as rest, sum(d.n_tokens) over (partition by d.domain, d.lang, d.source order by md5('{mix.seed}:' || w.whole || ':' || coalesce(d.doc_id::varchar, '')), d.n_tokens rows unbounded preceding) as running from d join w on d.domain = w.domain and d.lang = w.lang and d.source = w.source)",
    ]
    return "with " + ",\n".join(parts) + " select doc_id, domain, lang, source, n_tokens, quota, (whole + case when running <= rest then 1 else 0 end)::int as epochs from k where whole > 0 or running <= rest"


def sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": near_duplicates(),
        "op2_top_k": top_k(),
        "op6_decontamination": decontamination(),
        "op8_url_filter": url_filter(),
        "op9_license_scan": license_scan(),
        "op10_mixing": source_mix(),
    }
