"""Search as one SQL statement for DuckDB, rung by rung, for the queries that must agree with it. Nothing here is used by the engine."""

from __future__ import annotations

from . import lexicons as L

_X = L.PART_LEXICONS


def _values(rows: list[tuple]) -> str:
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


def bases(table: str) -> str:
    """(word, i, base) of the words of a table."""
    cut = "case " + " ".join(f"when length(word) > {len(s) + 2} and word like '%{s}' then {len(s)}" for s in L.SUFFIXES) + " end"
    stems = f"select word, left(word, length(word) - cut) as stem from (select distinct word, {cut} as cut from {table}) where cut is not null"
    return f"(with b as ({stems}) select word, 0 as i, stem as base from b union all select word, 1, stem || 'e' from b union all select word, 2, left(stem, length(stem) - 1) from b where length(stem) > 2 and right(stem, 1) = substring(stem, length(stem) - 1, 1))"


def occasion_words(scores: str, hints: str) -> str:
    """(section, term): the words and phrases of each section."""
    return f"""with {scores}, r as (select section, term, row_number() over (partition by section order by round(lift * ln(1 + n), 9) desc, term desc) as r from sc where lift > 1.5)
 select section, term from r where r <= 12 union select section, section from z where length(section) >= 3 and not starts_with(section, 'e')
 union select section, phrase from ({hints}) where status = 'kept' and section in (select section from lp)"""


def occasions(scores: str, hints: str) -> str:
    """(word, section) of the words that lead to one section."""
    facet_words = ", ".join(f"'{e[2]}'" for e in _X.entries())
    return f"""(with k as ({occasion_words(scores, hints)}), ow as (select distinct section, unnest(string_split(term, ' ')) as word from k)
 select word, min(section) as section from ow where length(word) >= 4 and word not in ({facet_words}) group by word having count(distinct section) = 1)"""


def understood(queries: str, fold, variants: str, scores: str, hints: str) -> str:
    """Common tables up to tm (query_id, pos, term), fx (query_id, spot, word, corrected), gr (term, member), fc (query_id, kind, value, source, pos, spot);
    needs lp, tk, po, te. queries: (query_id, raw)."""
    alias = "case " + " ".join(f"when w = '{a}' then '{b}'" for a, b in _X.aliases.items()) + " else w end" if _X.aliases else "w"
    return f"""qs as ({queries}),
xn as (select query_id, card_number, doc from qs join lp on card_number = trim(raw) where regexp_matches(trim(raw), '^[0-9]+$')),
rq as (select query_id, raw, list_filter(string_split({fold('substring(raw, 1, 120)')}, ' '), lambda x: x <> '')[1:10] as ws from qs where query_id not in (select query_id from xn)),
qw as (select query_id, pos, {alias} as word from (select query_id, unnest(ws) as w, unnest(range(len(ws))) as pos from rq)),
ff(kind, value, word, spot) as {_values(_X.entries())},
vo as (select term, df from te where df >= 3),
pw as (select distinct word from qw where word not in (select word from ff)),
cn as (select word, term, df, damerau_levenshtein(word, term) as distance, case when length(word) >= 7 then 3 else 2 end as cap from pw join vo on length(word) >= 4 and length(term) >= 4 where word not in (select term from vo)),
cb as (select *, row_number() over (partition by word order by distance, df desc, term) as r from cn where distance <= cap and (distance <= 2 or distance <= 0.3 * greatest(length(word), length(term)))),
co as (select pw.word, case when vo.term is not null then vo.term else coalesce(cb.term, pw.word) end as corrected, case when vo.term is not null then 0 else coalesce(cb.distance, -1) end as distance
       from pw left join vo on vo.term = pw.word left join cb on cb.word = pw.word and cb.r = 1),
cu as (select word, substring(word, 1, i) as l, substring(word, i + 1) as r, i from co, (select unnest(range(3, 120)) as i) where distance < 0 and word not in (select term from te) and i <= length(word) - 3),
sp as (select word, l, r from (select word, l, r, row_number() over (partition by word order by least(a.df, b.df) desc, i) as k from cu join vo a on a.term = l join vo b on b.term = r) where k = 1),
pl as (select query_id, pos, qw.word, l, r, distance, corrected, case when l is not null then [l, r] when corrected is not null then [corrected] else [qw.word] end as parts
       from qw left join co on co.word = qw.word left join sp on sp.word = qw.word),
pe as (select *, row_number() over (partition by query_id order by pos, part) - 1 as tpos from (select *, unnest(parts) as term, unnest(range(len(parts))) as part from pl)),
tm as (select query_id, tpos as pos, term from pe where tpos < 10),
fx as (select query_id, word, corrected, min(spot) as spot from (select query_id, pos as spot, word, l || ' ' || r as corrected from pe where l is not null and part = 0
       union all select query_id, pos + 100, word, corrected from pe where tpos < 10 and l is null and distance > 0) group by all),
dt as (select distinct term as word from tm),
va as (select word, target from ({variants}) where status = 'kept'),
ba as (select word, i, base from {bases('dt')}),
le as (select word, word as lead from dt union select word, target from dt join va using (word) union select word, arg_min(base, i) from ba join te on te.term = base group by word),
px as (select lead, term, df, row_number() over (partition by lead order by term) as i from (select distinct lead from le where length(lead) >= 3) join te on starts_with(term, lead)),
pt as (select lead, term from (select lead, term, row_number() over (partition by lead order by df desc, term) as r from px where i <= 400) where r <= 24),
gr as (select word as term, lead as member from le union select word, pt.term from le join pt using (lead)),
oc as (select word, section from {occasions(scores, hints)}),
fo as (select word, word as form, -2 as i from dt union all select word, target, -1 from dt join va using (word) union all select word, base, i from ba),
fs as (select dt.word, kind, value, spot from dt join ff using (word) union all select fo.word, 'occasion', arg_min(section, i), {1 << 20} from fo join oc on oc.word = form group by fo.word),
fm as (select query_id, kind, value, term as source, pos, spot, row_number() over (partition by query_id, kind, value order by pos, spot) as n from tm join fs on word = term),
fc as (select query_id, kind, value, source, pos, spot from fm where n = 1)"""


def searched(limit: int, boost: float = L.RECENCY_BOOST, popularity: str | None = None) -> str:
    """Common tables up to out (query_id, rank, doc, strategy, fallback, message, why), over those of understood() and fa (kind, value, doc)."""
    slots = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in L.SLOT_PRIORITY.items()) + " end"
    age = f"greatest(0, (select max(year) from yr) - year) / {L.RECENCY_HALF_LIFE}"
    factor = f"case when year > 0 then 1 + {boost} * power(0.5, {age}) else 1 end" if boost > 0 else "1.0"
    return f"""yr as (select doc, card_number as number, card_title as title, coalesce(try_cast(substring(card_created_date, 1, 4) as bigint), 0) as year from lp),
nn as (select count(*) as total from lp),
id as (select term, df, ln(1 + (total - df + 0.5) / (df + 0.5)) as idf from te, nn),
fn as (select kind, value, n, 12 * least(ln(1 + total / n) / ln(1 + total / 100.0), 1.6) as boost from (select kind, value, count(*) as n from fa group by all), nn),
ts as (select query_id, tm.term, row_number() over (partition by query_id order by round(coalesce(idf, 0), 9) desc, pos) - 1 as t from tm left join id on id.term = tm.term where (query_id, tm.term) not in (select (query_id, source) from fc)),
ks as (select query_id, kind, value, coalesce(n, 0) as n, coalesce(boost, 0) as boost, row_number() over (partition by query_id order by {slots}, coalesce(n, 0), pos, spot) - 1 as k from fc left join fn using (kind, value)),
ty as (select query_id, term, min(pos) as pos from tm group by all),
wt as (select query_id, member, arg_min(case when member = ty.term or coalesce(b.df, 0) > greatest(coalesce(a.df, 0), 1) * 5 then 1.0 else 0.4 end, struct_pack(late := member <> ty.term, pos := pos)) as m
       from ty join gr using (term) left join te a on a.term = ty.term left join te b on b.term = member group by query_id, member),
sx as (select query_id, doc, sum(idf * weight * m) as text from wt join po on po.term = member join id on id.term = member group by all),
sz as (select query_id, count(*) as n_terms, (select count(*) from ts where ts.query_id = tm.query_id) as n_t, (select count(*) from ks where ks.query_id = tm.query_id) as n_k from tm group by query_id),
td as (select distinct query_id, t, doc from ts join gr using (term) join po on po.term = member),
kd as (select query_id, k, doc from ks join fa using (kind, value)),
ca as (select query_id, doc from sx union select query_id, doc from td union select query_id, doc from kd),
lt as (select ca.query_id, ca.doc, min(ts.t) as miss from ca join ts using (query_id) where (query_id, t, doc) not in (select (query_id, t, doc) from td) group by all),
lk as (select ca.query_id, ca.doc, min(ks.k) as miss from ca join ks using (query_id) where n > 0 and (query_id, k, doc) not in (select (query_id, k, doc) from kd) group by all),
cd as (select ca.query_id, ca.doc, coalesce(text, 0) as text, coalesce(lt.miss, n_t) as lead_t, coalesce(lk.miss, n_k) as lead_k from ca join sz using (query_id) left join sx using (query_id, doc) left join lt using (query_id, doc) left join lk using (query_id, doc)),
st as (select unnest(range(1, 11)) as d),
ru as (select query_id, n_t as need_t, n_k as need_k, 'all terms' as strategy, 1 as o from sz where n_t > 0
 union all select query_id, n_t - d, n_k, 'dropped ' || d || ' weak term(s)', 1 + d from sz, st where d < n_t
 union all select query_id, 1, n_k, 'facets + best term', 100 from sz where n_t > 0 and n_k > 0
 union all select query_id, 0, n_k, 'facets only', 101 from sz where n_k > 0
 union all select query_id, 1, d, d || ' facet(s) + best term', 200 - 2 * d from sz, st where d < n_k and n_t > 0
 union all select query_id, 0, d, d || ' facet(s) only', 201 - 2 * d from sz, st where d < n_k
 union all select query_id, 1, 0, 'best term only', 300 from sz where n_t > 0
 union all select query_id, 0, 0, 'any term', 301 from sz),
rf as (select query_id, need_t, need_k, strategy, o, coalesce(sum(boost), 0) as facets, coalesce(bool_or(n > 0), false) as active from ru left join ks using (query_id) where k is null or k < need_k group by all
 union all select query_id, need_t, need_k, strategy, o, 0, false from ru where need_k = 0 and query_id in (select query_id from ks)),
me as (select cd.query_id, doc, o, strategy, need_k, number, title, year, (text + facets) * {factor} as val from cd join rf using (query_id) join yr using (doc)
       where lead_t >= need_t and lead_k >= need_k and (need_t > 0 or active or text > 0) and text + facets > 0),
mt as (select *, max(val) over (partition by query_id, o) as top, min(o) over (partition by query_id, doc) as first from me),
hi as (select *, row_number() over (partition by query_id order by o, floor(round(10 * val / top, 9)) desc, tiebreak desc, title, doc) as rank
       from (select mt.*, {'coalesce(score, 0)' if popularity else 'cast(year as double)'} as tiebreak from mt {f'left join ({popularity}) pop using (number)' if popularity else ''} where o = first)),
ht as (select * from hi where rank <= {limit}),
la as (select query_id, strategy as landed from ht where rank = 1),
xf as (select query_id, string_agg(word || ' → ' || corrected, ', ' order by spot, word, corrected) as fixed from fx group by query_id),
y1 as (select query_id, doc, string_agg(kind || '=' || value, ', ' order by k) as a from ht join ks using (query_id) join fa using (kind, value, doc) where k < need_k group by all),
y2 as (select query_id, doc, 'matched ' || string_agg(term, '+' order by pos) as b from (select query_id, doc, tm.term, pos, row_number() over (partition by query_id, doc order by pos) as n from ht join tm using (query_id) join po using (term, doc)) where n <= 4 group by all),
ne as (select doc, year, row_number() over (order by year desc, try_cast(number as bigint) desc, doc) as rank from yr),
out as (select query_id, rank, doc, landed as strategy, false as fallback, case when fixed is not null then 'Showing results for ' || fixed when landed <> 'all terms' then 'Broadened your search (' || landed || ')' end as message, concat_ws(', ', a, b) as why
        from ht join la using (query_id) left join xf using (query_id) left join y1 using (query_id, doc) left join y2 using (query_id, doc)
 union all select query_id, 1, max(doc), 'card number', false, 'Card ' || card_number || '.', 'card number ' || card_number from xn group by query_id, card_number
 union all select query_id, rank, doc, case when query_id in (select query_id from tm) then 'latest' else 'empty' end, true,
        case when query_id in (select query_id from tm) then 'No matching cards. Showing the latest additions.' else 'Showing the latest cards.' end, 'newest (' || year || ')'
        from rq, ne where rank <= {limit} and query_id not in (select query_id from la))"""
