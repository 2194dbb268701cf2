"""DuckDB SQL for the queries of ``catalog``; written from the definitions, not from the Spark plans."""

from __future__ import annotations

from ..functions.dna import BASES, LETTERS
from ..operators.prime import SCAFFOLD
from ..operators.scoring import ACTIVITY_GC_HIGH, ACTIVITY_GC_LOW, ACTIVITY_INTERCEPT, POSITION_WEIGHTS, activity_weights

ADAPTER = "TTACT"
SCAFFOLD_GC, SCAFFOLD_LENGTH = 31, 76  # of the guide scaffold, which starts with GUU and ends in UGC


def _dna(text: str) -> str:
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTN', 'TGCAN'))"


S = f"s as (select doc_id, source, {_dna('text')} as seq from documents)"
B = f"b as (select item_id, {_dna('text')} as seq from benchmark)"


def _windows(name: str, k: int, src: str = "s", key: str = "doc_id", valid: bool = True, more: str = "") -> str:
    test = "where not contains(kmer, 'N')" if valid else ""
    return f"{name} as (select * from (select {key}{more}, i - 1 as pos, substr(seq, i, {k}) as kmer from (select {key}{more}, seq, unnest(generate_series(1, length(seq) - {k} + 1)) as i from {src} where length(seq) >= {k})) {test})"


def _canon(x: str) -> str:
    return f"least({x}, {_rc(x)})"


def _sites(name: str, src: str, key: str, more: str = "") -> str:
    return (
        _windows(f"{name}_w", 23, src, key, True, more)
        + f", {name} as (select {key}{more}, pos as start, '+' as strand, kmer as site from {name}_w where kmer like '%GG' union all select {key}{more}, pos, '-', {_rc('kmer')} from {name}_w where kmer like 'CC%')"
    )


GUIDES = f"{B}, {_sites('bs', 'b', 'item_id')}, g as (select distinct substr(site, 1, 20) as spacer from bs)"
HITS = f"{S}, {GUIDES}, {_sites('ds', 's', 'doc_id')}, hits as (select spacer as guide_id, spacer, doc_id, start, strand, site, hamming(substr(site, 1, 20), spacer) as mismatches from ds join g on hamming(substr(site, 1, 20), spacer) <= 4)"
WEIGHTS = "[" + ", ".join(f"{w}::double" for w in reversed(POSITION_WEIGHTS)) + "]"
SCORED = f"{HITS}, scored as (select *, list_reduce(list_prepend(1.0::double, list_transform(range(1, 21), lambda i: case when substr(spacer, i::int, 1) = substr(site, i::int, 1) then 1.0::double else ({WEIGHTS})[i] end)), lambda a, x: a * x) as score from hits)"


def _pam(regex: str, k: int) -> str:
    return f"with {S}, {_windows('k', k, valid=False)} select doc_id, pos, 0 as strand from k where regexp_full_match(kmer, '{regex}')"


def _candidates(head: str, src: str, key: str) -> str:
    return f"""{head}, {_windows('k', 23, src, key, valid=False)},
c0 as (select {key}, pos, '+' as strand, kmer as guide from k union all select {key}, pos, '-', {_rc('kmer')} from k),
c1 as (select *, substr(guide, 1, 20) as sp from c0 where regexp_full_match(guide, '[ACGT]{{21}}GG')),
c2 as (select *, (length(sp) - length(replace(replace(sp, 'C', ''), 'G', ''))) / 20.0 as gc,
  list_max(list_transform(regexp_extract_all(sp, '(A+|C+|G+|T+)'), lambda x: length(x))) as run,
  list_sum(list_transform(['A', 'C', 'G', 'T'], lambda x: case when contains(sp, x) then -((20 - length(replace(sp, x, ''))) / 20.0::double) * log2((20 - length(replace(sp, x, ''))) / 20.0::double) else 0 end)) as h from c1),
c as (select *, list_filter([case when gc < 0.4 then 'low_gc' end, case when gc > 0.7 then 'high_gc' end, case when run > 4 then 'homopolymer' end, case when h < 1.2 then 'low_complexity' end], lambda x: x is not null) as rs from c2)"""


CANDIDATES = _candidates(S, 's', 'doc_id')


def _minimizers(name: str, src: str, key: str) -> str:
    k, w = 15, 10
    return (
        _windows(f"{name}_w", k, src, key)
        + f""", {name}_r as (select *, pos - row_number() over (partition by {key} order by pos) as run, {_canon('kmer')} as c from {name}_w),
{name}_m as (select {key}, row_number() over o as rn, min(c || lpad(pos::varchar, 12, '0')) over (partition by {key}, run order by pos rows between {w - 1} preceding and current row) as m from {name}_r window o as (partition by {key}, run order by pos)),
{name} as (select distinct {key}, substr(m, {k + 1})::bigint as pos, substr(m, 1, {k}) as kmer from {name}_m where rn >= {w})"""
    )


def _cpg(width: int) -> str:
    return f"""{S}, p as (select doc_id, length(seq) as n, i - 1 as pos, substr(seq, i, 1) as x, substr(seq, i, 2) as y from (select doc_id, seq, unnest(generate_series(1, length(seq))) as i from s where length(seq) > 0)),
q as (select doc_id, n, pos, sum((x = 'C')::int) over w1 as c, sum((x = 'G')::int) over w1 as g, sum((y = 'CG')::int) over w2 as cg from p
  window w1 as (partition by doc_id order by pos rows between current row and {width - 1} following), w2 as (partition by doc_id order by pos rows between current row and {width - 2} following)),
cand as (select doc_id, pos from q where pos <= n - {width} and 2 * (c + g) >= {width} and c > 0 and g > 0 and 5 * {width} * cg >= 3 * c * g),
isl as (select doc_id, min(pos) as start, max(pos) + {width} as "end" from (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as run from cand) group by doc_id, run having count(*) >= {width})"""


TANDEM = f"""{S}, p as (select doc_id, seq, unnest(generate_series(1, length(seq))) as i from s where length(seq) > 0),
r as (select doc_id, i - 1 as pos, q, i - row_number() over (partition by doc_id, q order by i) as run from (select doc_id, seq, i, unnest([1, 2, 3, 4, 5, 6]) as q from p) where i > q and substr(seq, i, 1) = substr(seq, i - q, 1)),
t as (select doc_id, min(pos) - q as start, q as period, (min(pos) - q) + ((count(*) + q) // q) * q as "end" from r group by doc_id, q, run having count(*) >= q * 2),
tc as (select t.doc_id, start, "end", period::bigint as period, substr(seq, start + 1, period) as motif from t join s using (doc_id))"""

_W1 = {k: w for k, w in activity_weights().items()}
_MAP = "map {" + ", ".join(f"'{k}': {w}::double" for k, w in _W1.items()) + "}"
CONTEXT = f"""{B}, {_windows('k', 30, 'b', 'item_id')},
x0 as (select item_id, pos, '+' as strand, kmer as context from k union all select item_id, pos, '-', {_rc('kmer')} from k),
x1 as (select *, substr(context, 5, 20) as spacer from x0 where substr(context, 26, 2) = 'GG'),
x as (select *, 1 / (1 + exp(-({ACTIVITY_INTERCEPT} + list_sum(list_transform(range(1, 31), lambda i: coalesce(({_MAP})[i::varchar || substr(context, i::int, 1)], 0.0)))
  + list_sum(list_transform(range(1, 30), lambda i: coalesce(({_MAP})[i::varchar || substr(context, i::int, 2)], 0.0)))
  + case when length(regexp_replace(spacer, '[^GC]', '', 'g')) < 10 then {ACTIVITY_GC_LOW} when length(regexp_replace(spacer, '[^GC]', '', 'g')) > 10 then {ACTIVITY_GC_HIGH} else 0.0 end))) as activity from x1)"""

POOLS = f"""s0 as (select doc_id, source, {_dna('text')} as seq from documents where source is not null), {_sites('ds', 's0', 'doc_id', ', source')},
pool as (select *, row_number() over (partition by gene order by score desc, spacer) as place from (select distinct source as gene, substr(site, 1, 20) as spacer, length(regexp_replace(substr(site, 1, 20), '[^CG]', '', 'g'))::bigint as score from ds))"""


def _dedup(src: str, wanted: int) -> str:
    return f"""owner as (select spacer, gene as owner from (select *, row_number() over (partition by spacer order by score desc, gene) as r from {src}) where r = 1),
chosen as (select gene, rank, spacer, score from (select p.gene, p.spacer, p.score, row_number() over (partition by p.gene order by p.place) as rank from {src} p join owner o on p.spacer = o.spacer and p.gene = o.owner) where rank <= {wanted})"""


READS = f"""r0 as (select conv_id, turn, role, {_dna('text')} as seq from conversations),
r as (select conv_id, turn, role, case when instr(seq, '{ADAPTER}') > 0 then substr(seq, 1, instr(seq, '{ADAPTER}') - 1) else seq end as cut, length(seq) as n from r0),
t as (select conv_id, turn, role, cut as seq, length(cut) as qual_length, n - length(cut) as removed from r)"""

PE2 = f"""{S}, e as (select doc_id, seq, length(seq) // 2 as start, greatest(length(seq) // 2 - 100, 0) as origin, substr(seq, length(seq) // 2 + 1, 1) as r from s where length(seq) >= 23),
c0 as (select doc_id, start, origin, start - origin as here, translate(r, 'ACGTN', 'GTACA') as a, substr(seq, origin + 1, start - origin + 101) as ctx from e),
c1 as (select doc_id, origin, '+' as strand, a, length(ctx) as n, here as ed, ctx from c0 union all select doc_id, origin, '-', {_rc('a')}, length(ctx), length(ctx) - 1 - here, {_rc('ctx')} from c0),
c2 as (select *, substr(ctx, 1, ed) || a || substr(ctx, ed + 2) as edited from c1 where n >= 23),
c3 as (select * from (select *, unnest(generate_series(20, n - 3)) as p from c2) where regexp_full_match(substr(ctx, p + 1, 3), '[ACGT]GG') and not contains(substr(ctx, p - 19, 20), 'N') and ed >= p - 3 and not (ed < p + 3 and ed + 1 > p and regexp_full_match(substr(edited, p + 1, 3), '[ACGT]GG'))),
c4 as (select * from (select *, unnest(range(10, 31)) as rl from c3) where ed - (p - 3) + 1 <= rl and p - 3 + rl <= length(edited) and not contains(substr(edited, p - 2, rl), 'N')),
c5 as (select *, translate({_rc('substr(ctx, p - 2 - pl, pl)')}, 'T', 'U') as pbs, translate({_rc('substr(edited, p - 2, rl)')}, 'T', 'U') as rtt, translate(substr(ctx, p - 19, 20), 'T', 'U') as s
  from (select *, unnest(range(8, 16)) as pl from c4) where p - 3 - pl >= 0 and not contains(substr(ctx, p - 2 - pl, pl), 'N'))
select doc_id, strand, translate(s, 'U', 'T') as spacer, pl as pbs_length, rl as rtt_length, pbs, rtt, case when strand = '+' then origin + p - 3 else origin + n - (p - 3) end as nick, rl - 1 - (ed - (p - 3)) as edit_in_rtt from c5
where not contains(substr(s, 18, 3) || 'GUU|' || s || '|' || rtt || '|' || pbs || '|UGC' || substr(rtt, 1, 3), 'UUUU')
  and (length(regexp_replace(s || rtt || pbs, '[^CG]', '', 'g')) + {SCAFFOLD_GC})::double / (length(s || rtt || pbs) + {SCAFFOLD_LENGTH}) between 0.25 and 0.75"""

_BYTE = " + ".join(f"(instr('0123456789abcdef', substr(h, {2 * i + 1 + j}, 1)) - 1)::double * {16.0 ** (2 * i + 1 - j)}" for i in range(8) for j in range(2))
ORACLE_SQL = {
    "library_table": f"with {POOLS}, rich as (select * from pool where score >= 14), {_dedup('rich', 40)}, n as (select gene, count(*) as c from chosen group by 1), f as (select *, row_number() over (order by gene, rank) as library_index from chosen) select library_index, f.gene, rank, spacer, case when c < 40 then 'UNDER_BALANCED:deficit=' || (40 - c) else '' end as notes from f join n on f.gene = n.gene",
    "kmer_tokens": f"with {GUIDES} select spacer as guide_id, array_to_string(list_transform(range(1, 19), lambda i: substr(spacer, i::int, 3)), ' ') as tokens from g",
    "smoke_scores": f"with {HITS}, d as (select *, sha256('seed0001' || guide_id || '|' || site || '|' || doc_id || '|' || start || '|' || strand || '|' || mismatches) as h from hits) select guide_id, doc_id, start, strand, round(({_BYTE}) / 18446744073709551616.0::double, 12) as score from d",
    "be_ranking": f"""with {SCORED}, f as (select *, row_number() over (partition by guide_id, mismatches = 0 order by doc_id, start, strand) as rn from scored), o as (select guide_id, sum(score) as off_score, count(*) as off_targets from f where mismatches > 0 or rn > 1 group by 1),
{_windows('k', 23, 'b', 'item_id', False)}, t as (select item_id, pos, substr(kmer, 1, 20) as spacer, length(regexp_replace(substr(kmer, 4, 5), '[^C]', '', 'g')) as n from k where regexp_full_match(kmer, '[ACGT]{{21}}GG')),
r as (select item_id, pos, spacer, n > 0 as in_window, greatest(n - 1, 0) as bystanders, coalesce(off_targets, 0) as off_targets, round((n > 0)::int - 0.2::double * greatest(n - 1, 0) - 0.5 * coalesce(off_score, 0), 9) as rank_score from t left join o on guide_id = spacer)
select * from (select *, row_number() over (partition by item_id order by rank_score desc, pos) as rank from r) where rank <= 20""",
    "pe2_enumeration": f"with {PE2}",
    "packed_roundtrip": f"with {S}, n as (select doc_id, replace(seq, 'N', '') as seq from s) select doc_id, length(seq) as bases, (length(seq) + 3) // 4 as bytes, md5(seq) as back_md5 from n",
    "kmer_topn_k15": f"with {S}, {_windows('k', 15)} select {_canon('kmer')} as kmer, count(*) as count from k group by 1 having count(*) >= 2 order by 2 desc, 1 limit 200",
    "kmer_histogram": f"with {S}, {_windows('k', 15)}, c as (select {_canon('kmer')} as kmer, count(*) as n from k group by 1) select n as times, count(*) as kmers from c group by n",
    "kmer_packed": f"with {S}, {_windows('k', 11)}, c as (select {_canon('kmer')} as kmer, count(*) as count from k group by 1) select " + " + ".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1)::bigint * {4 ** (10 - i)}" for i in range(11)) + " as packed, kmer, count from c",
    "sequence_profile": f"""with {S}, a as (select *, length(seq) as n, length(seq) - length(replace(seq, 'A', '')) as na, length(seq) - length(replace(seq, 'C', '')) as nc, length(seq) - length(replace(seq, 'G', '')) as ng, length(seq) - length(replace(seq, 'T', '')) as nt from s)
select doc_id, n as bases, round(case when na + nc + ng + nt > 0 then (nc + ng)::double / (na + nc + ng + nt) else 0 end, 9) as gc_fraction, round(case when n > 0 then (nc + ng) * 100.0::double / n else 0 end, 7) as gc_percent,
  round(case when n > 0 then (n - na - nc - ng - nt)::double / n else 0 end, 9) as n_fraction, coalesce(list_max(list_transform(regexp_extract_all(seq, '(A+|C+|G+|T+|N+)'), lambda x: length(x))), 0)::bigint as homopolymer,
  round(list_sum(list_transform([na, nc, ng, nt], lambda c: case when c > 0 then -(c::double / (na + nc + ng + nt)) * log2(c::double / (na + nc + ng + nt)) else 0.0 end)), 9) as entropy, md5({_rc('seq')}) as rc_md5 from a""",
    "pam_ngg": _pam("[ACGT]GG", 3),
    "pam_ng": _pam("[ACGT]G", 2),
    "pam_nrn": _pam("[ACGT][AG][ACGT]", 3),
    "pam_nnnrrt": _pam("[ACGT]{3}[AG][AG]T", 6),
    "primer_hits": f"with {S}, {_windows('k', 6, valid=False)}, {_windows('p', 4, valid=False)} select doc_id, pos, case when kmer = 'TTACAG' then 0 else 1 end as strand, 'TTACAG' as primer from k where kmer in ('TTACAG', 'CTGTAA') union all select doc_id, pos, 0, 'ACGT' from p where kmer = 'ACGT'",
    "methylation_contexts": f"""with {S}, p as (select doc_id, i - 1 as pos, substr(seq, i, 1) as x, substr(seq, i, 3) as f, case when i >= 3 then substr(seq, i - 2, 3) when i = 2 then substr(seq, 1, 2) else substr(seq, 1, 1) end as r from (select doc_id, seq, unnest(generate_series(1, length(seq))) as i from s where length(seq) > 0)),
o as (select doc_id, pos, '+' as strand, f as m from p where x = 'C' union all select doc_id, pos, '-', {_rc('r')} from p where x = 'G')
select doc_id, pos, strand, case when m like 'CG%' then 'CG' when regexp_full_match(m, 'C[ACT]G') then 'CHG' else 'CHH' end as context, case when m like 'CG%' then 'CG' else m end as motif from o where m like 'CG%' or regexp_full_match(m, 'C[ACT][ACGT]')""",
    "guide_candidates": f"with {CANDIDATES} select doc_id, pos, strand, guide, array_to_string(rs, ';') as reasons from c",
    "guide_rejections": f"with {CANDIDATES} select reason, strand, count(*) as guides from (select strand, unnest(rs) as reason from c) group by 1, 2",
    "be_window_targets": f"with {CANDIDATES}, e as (select *, list_filter(range(3, 8), lambda i: substr(guide, (i + 1)::int, 1) = 'C') as ts from c) select doc_id, pos, strand, array_to_string(list_transform(ts, lambda x: x::varchar), ',') as targets, len(ts) > 0 as in_window, greatest(len(ts) - 1, 0) as bystanders from e",
    "minimizers_k15_w10": f"with {S}, {_minimizers('m', 's', 'doc_id')} select * from m",
    "cpg_candidates": f"with {_cpg(200)} select * from cand",
    "cpg_islands": f"with {_cpg(200)} select * from isl",
    "cpg_islands_w40": f"with {_cpg(40)} select * from isl",
    "tandem_candidates": f"with {TANDEM} select * from tc",
    "tandem_repeats": f"""with recursive {TANDEM}, o1 as (select *, case when start < max("end") over (partition by doc_id order by start, "end" desc, period rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from tc),
o2 as (select *, sum(new) over (partition by doc_id order by start, "end" desc, period rows unbounded preceding) as stretch from o1),
o as materialized (select *, row_number() over (partition by doc_id, stretch order by start, "end" desc, period) as rn from o2),
w as (select doc_id, stretch, rn, start, "end", period, motif, "end" as last, true as kept from o where rn = 1 union all
  select o.doc_id, o.stretch, o.rn, o.start, o."end", o.period, o.motif, case when o.start >= w.last then o."end" else w.last end, o.start >= w.last from w join o on o.doc_id = w.doc_id and o.stretch = w.stretch and o.rn = w.rn + 1)
select doc_id, start, "end", period, motif from w where kept""",
    "offtarget_pigeonhole": f"with {HITS} select guide_id, doc_id, start, strand, mismatches::int as mismatches, array_to_string(list_transform(range(1, 21), lambda i: case when substr(site, i::int, 1) = substr(spacer, i::int, 1) then substr(site, i::int, 1) else lower(substr(site, i::int, 1)) end), '') || substr(site, 21, 3) as dna from hits",
    "seed_prefilter_exact": f"with {S}, {GUIDES}, {_sites('ds', 's', 'doc_id')}, n as (select substr(site, 9, 12) as seed, count(*) as c from ds group by 1) select spacer as guide_id, doc_id, start, strand, c as seed_hit_count from ds join g on substr(site, 9, 12) = substr(spacer, 9, 12) join n on seed = substr(spacer, 9, 12)",
    "seed_lookup_freqcap": f"with {S}, {B}, {_minimizers('q', 'b', 'item_id')}, {_minimizers('m', 's', 'doc_id')}, ok as (select kmer from m group by 1 having count(*) <= 1000) select item_id, doc_id, q.pos as query_pos, m.pos as ref_pos, q.kmer from q join m using (kmer) join ok using (kmer)",
    "nick_band_join": f"with {S}, {_sites('ds', 's', 'doc_id')}, pairs as (select a.doc_id, a.start + 17 as nick, abs(a.start + 17 - b.start - 6) as d from ds a join ds b on a.doc_id = b.doc_id and a.strand = '+' and b.strand = '-') select doc_id, nick, count(*) as partners, min(d) as nearest from pairs where d between 40 and 100 group by 1, 2",
    "paralog_flag": f"with {_cpg(40)}, {_windows('k', 3, valid=False)} select doc_id, pos, exists (select 1 from isl where isl.doc_id = k.doc_id and k.pos >= isl.start and k.pos < isl.\"end\") as in_island from k where regexp_full_match(kmer, '[ACGT]GG')",
    "on_off_split": f"with {HITS} select guide_id, count(*) filter (where mismatches = 0) as on_targets, count(*) filter (where mismatches > 0) as off_targets from hits group by 1",
    "diff_positional": "with a as (select conv_id, row_number() over (partition by conv_id order by turn, length(text)) as place, length(text) as left_value from conversations where role = 'user'), b as (select conv_id, row_number() over (partition by conv_id order by turn, length(text)) as place, length(text) as right_value from conversations where role = 'assistant') select conv_id, place, coalesce(left_value, -1) as left_value, coalesce(right_value, -1) as right_value from a full join b using (conv_id, place) where left_value is distinct from right_value",
    "mismatch_scores": f"with {SCORED} select guide_id, doc_id, start, strand, round(score, 9) as score from scored",
    "specificity": f"with {SCORED} select guide_id, round(10000.0::double / (100.0 + 100.0 * coalesce(sum(score) filter (where mismatches > 0), 0)), 6) as specificity, count(*) filter (where mismatches > 0) as off_targets from scored group by 1",
    "specificity_top_split": f"with {_cpg(40)}, {SCORED.replace(S + ', ', '', 1)}, f as (select *, exists (select 1 from isl where isl.doc_id = scored.doc_id and scored.start >= isl.start and scored.start < isl.\"end\") as in_island from scored where mismatches > 0), r as (select *, row_number() over (partition by guide_id, in_island order by score desc) as rn from f) select guide_id, in_island, round(sum(score), 6) as total, count(*) as hits from r where rn <= 200 group by 1, 2",
    "top_offtargets": f"with {SCORED}, r as (select *, row_number() over (partition by guide_id order by score desc, doc_id, start, strand) as rn from scored where mismatches > 0) select guide_id, string_agg(doc_id || ':' || start || ':' || mismatches || ';' || printf('%.4f', score), ';' order by rn) as top from r where rn <= 5 group by 1",
    "activity_scores": f"with {CONTEXT} select item_id, pos, strand, context, round(activity, 9) as activity from x",
    "guide_ranking": f"""with {CONTEXT}, {SCORED.replace(B + ', ', '', 1)}, sp as (select guide_id as spacer, round(10000.0::double / (100.0 + 100.0 * coalesce(sum(score) filter (where mismatches > 0), 0)), 6) as spec, count(*) filter (where mismatches > 0) as off_targets from scored group by 1),
f as (select * from (select *, row_number() over (partition by item_id, spacer order by pos, strand) as rn from x) where rn = 1),
c as (select item_id, f.spacer, strand, round(0.5 * greatest(0, least(1, round(activity, 9))) + 0.5 * greatest(0, least(1, coalesce(spec, 100.0::double) / 100)), 6) as composite, coalesce(off_targets, 0) as off_targets, length(regexp_replace(f.spacer, '[^GC]', '', 'g')) * 5.0 as gc from f left join sp on f.spacer = sp.spacer)
select item_id, rank, spacer, strand, composite, off_targets, concat_ws(';', case when gc < 25 then 'LOW_GC' end, case when gc > 75 then 'HIGH_GC' end, case when contains(spacer, 'TTTT') then 'POLY_T_RUN' end) as notes from (select *, row_number() over (partition by item_id order by composite desc, spacer) as rank from c) where rank <= 10""",
    "library_dedup": f"with {POOLS}, {_dedup('pool', 50)} select * from chosen",
    "library_balance": f"with {POOLS}, rich as (select * from pool where score >= 14), {_dedup('rich', 40)}, n as (select gene, count(*) as selected from chosen group by 1) select gene, coalesce(selected, 0) as selected, greatest(40 - coalesce(selected, 0), 0) as deficit, coalesce(selected, 0) < 40 as under_balanced from (select distinct source as gene from documents where source is not null) left join n using (gene)",
    "dedup_collisions": f"with {POOLS} select spacer, count(distinct gene) as genes from pool group by 1 having count(distinct gene) >= 2",
    "trim_reads": f"with {READS} select * from t",
    "trim_stats": f"with {READS} select count(*) as reads, count(*) filter (where removed > 0) as trimmed, count(*) filter (where length(seq) = 0) as emptied, sum(length(seq) + removed)::bigint as bases_in, sum(length(seq))::bigint as bases_out from t",
    "trim_histogram": f"with {READS} select removed, count(*) as reads from t where removed > 0 group by 1",
    "latency_percentiles": "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, max(value) as most from events group by 1",
    "position_jaccard": f"with {S}, {_windows('k', 3, valid=False)}, c as (select doc_id, pos // 4 as cell, max((kmer like '_GG')::int) as a, max((kmer like '_AG')::int) as b from k where regexp_full_match(kmer, '[ACGT][AG]G') group by 1, 2) select doc_id, sum(a * b)::bigint as shared, count(*) as \"either\", round(sum(a * b)::double / count(*), 9) as jaccard from c group by 1",
    "pe3_nicking": f"""with {S}, {_sites('ds', 's', 'doc_id')}, m as (select doc_id, length(seq) // 2 as e from s),
n as (select doc_id, start + 17 as nick, e from ds join m using (doc_id) where strand = '+' and start + 17 <= e and e - start - 17 < 30),
p as (select n.doc_id, nick, substr(site, 1, 20) as nicking_spacer, start + 6 as nicking_site, abs(nick - start - 6) as distance from n join ds on n.doc_id = ds.doc_id and ds.strand = '-' where abs(nick - start - 6) between 40 and 100 and start + 6 <> e)
select * from (select *, row_number() over (partition by doc_id, nick order by distance, nicking_spacer, nicking_site) as rank from p) where rank <= 3""",
    "pair_scores": f"""with {HITS}, w as (select *, list_transform(range(1, 21), lambda i: case when substr(spacer, i::int, 1) = substr(site, i::int, 1) then 1.0::double else (1 - 0.5::double * ({WEIGHTS})[i]) * case when substr(spacer, i::int, 1) || substr(site, i::int, 1) in ('GA', 'TC') then 0.9::double else 0.7::double end end) as ws from hits)
select guide_id, doc_id, start, strand, round(list_reduce(list_prepend(1.0::double, ws), lambda a, x: a * x), 9) as score from w""",
    "control_guides": f"""with {S}, {_windows('k', 20)}, held as (select distinct {_canon('kmer')} as c from k),
c as (select i as candidate, translate(substr(sha256('42|' || i), 1, 20), '0123456789abcdef', 'ACGTACGTACGTACGT') as spacer from (select unnest(range(20000)) as i)),
f as (select * from c where length(replace(replace(spacer, 'G', ''), 'C', '')) between 8 and 12 and not regexp_matches(spacer, 'TTTT|A{{5}}|C{{5}}|G{{5}}|T{{5}}'))
select candidate, spacer from f where {_canon('spacer')} not in (select c from held)""",
    "edit_notations": f"""with {S}, x as (select doc_id, doc_id % 7 as form, length(seq) // 3 as here, replace(seq, 'N', 'A') as seq from s where length(seq) >= 40),
y as (select *, case form when 0 then 1 when 4 then 1 when 2 then 0 else 4 end as width from x),
z as (select *, substr(seq, here + 1, width) as ref, case form when 0 then 'T' when 1 then 'ACGT' when 2 then 'GATC' when 3 then '' when 4 then 'G' when 5 then 'CC' else substr(seq, here + 1, 4) || substr(seq, here + 1, 4) end as alt from y)
select 'd' || doc_id as chrom, case form when 2 then 'insertion' when 3 then 'deletion' when 5 then 'replacement' when 6 then 'duplication' else 'substitution' end as kind, here as start, here + width as "end", ref, alt, md5(substr(seq, 1, here) || alt || substr(seq, here + width + 1)) as edited_md5 from z""",
    "target_slices": f"""with {S}, x as (select doc_id, seq, greatest(length(seq) // 3 - 10, 0) as start, 2 * (length(seq) // 3) + 10 as "end" from s where length(seq) >= 3)
select doc_id, 'd' || doc_id as chrom, start, "end", md5(substr(seq, start + 1, "end" - start)) as slice_md5 from x""",
}

_NEAR = "hamming(substr(site, 9, 12), substr(spacer, 9, 12))"
_DNA_SITE = "array_to_string(list_transform(range(1, 21), lambda i: case when substr(site, i::int, 1) = substr(spacer, i::int, 1) then substr(site, i::int, 1) else lower(substr(site, i::int, 1)) end), '') || substr(site, 21, 3)"
_PE2_ITEMS = PE2.replace(S + ", ", B + ", ", 1).replace("doc_id", "item_id").replace("from s where", "from b where").replace("select item_id, strand, translate", "select item_id, start, strand, translate")
_PE2_ITEMS = _PE2_ITEMS.replace("select item_id, origin, '+'", "select item_id, start, origin, '+'").replace("union all select item_id, origin, '-'", "union all select item_id, start, origin, '-'").replace("select item_id, start, strand, translate", "pe2 as (select item_id, start, strand, translate") + ")"
_PE2_ITEMS = _PE2_ITEMS.replace("\npe2 as", ",\npe2 as", 1)
_PLACE = "row_number() over (order by conv_id nulls first, turn nulls first, role nulls first, seq nulls first) as p"


def _placed(adapter: str) -> str:
    """Reads before an adapter, with their places."""
    return f"(select *, {_PLACE} from (select conv_id, turn, role, case when instr(seq, '{adapter}') > 0 then substr(seq, 1, instr(seq, '{adapter}') - 1) else seq end as seq from r0))"


ORACLE_SQL |= {
    "seed_prefilter_mismatch": f"""with {S}, {GUIDES}, {_sites('ds', 's', 'doc_id')}, n as (select substr(site, 9, 12) as seed, count(*) as c from ds group by 1)
select spacer as guide_id, doc_id, start + case strand when '-' then 3 else 0 end as position, strand, substr(site, 21, 3) as pam, seed as target_seed, {_NEAR} as seed_mismatches,
  array_to_string(list_filter(range(12), lambda i: substr(site, 9 + i, 1) <> substr(spacer, 9 + i, 1)), ',') as at, c as seed_hit_count
from ds join g on {_NEAR} <= 2 join n on seed = substr(site, 9, 12)""",
    "guide_rollup": f"""with {_candidates(B, 'b', 'item_id')}, q as (select item_id || ':' || pos || ':' || strand as guide_id, substr(guide, 1, 20) as spacer from c where len(rs) = 0),
{S}, {_sites('ds', 's', 'doc_id')}, h as (select guide_id, doc_id, {_NEAR} as m from ds join q on {_NEAR} <= 1)
select guide_id, count(m) as seed_hit_count, count(*) filter (where m = 0) as exact_seed_hit_count, count(*) filter (where m > 0) as mismatched_seed_hit_count,
  count(distinct doc_id) as n_references, md5(coalesce(array_to_string(list(distinct doc_id order by doc_id) filter (where doc_id is not null), ','), '')) as references_md5
from q left join h using (guide_id) group by 1""",
    "record_agreement": f"""with r0 as (select conv_id, turn, role, {_dna('text')} as seq from conversations), a as {_placed(ADAPTER)}, b as {_placed(ADAPTER + 'A')},
n as (select count(a.p) as left_rows, count(b.p) as right_rows, count(*) filter (where a.p is not null and b.p is not null and a.conv_id is not distinct from b.conv_id and a.turn is not distinct from b.turn
  and a.role is not distinct from b.role and a.seq is not distinct from b.seq) as equal_rows from a full join b on a.p = b.p)
select *, equal_rows / greatest(left_rows, right_rows) as fraction, case when equal_rows = greatest(left_rows, right_rows) then 'PASS' when equal_rows / greatest(left_rows, right_rows) >= 0.99 then 'DIVERGE' else 'FAIL' end as verdict from n""",
    "score_agreement": f"""with {SCORED}, r as (select round(score, 9) as x, printf('%.6f', round(score, 9))::double as y from scored)
select count(*) as records, 0::bigint as identity_mismatches, count(*) filter (where abs(x - y) > 1e-6) as beyond, round(max(abs(x - y)), 9) as max_abs_diff, count(*) filter (where abs(x - y) > 1e-6) = 0 as equal from r""",
    "score_lines": f"""with {SCORED} select concat_ws(chr(9), guide_id, 'X', spacer || 'NGG', {_DNA_SITE}, doc_id, start, strand, mismatches, 0, printf('%.6f', score)) as line from scored""",
    "fasta_ranges": f"""with {S} select 'd' || doc_id as contig, length(seq) // 3 as start, 2 * (length(seq) // 3) as "end", md5(substr(seq, length(seq) // 3 + 1, length(seq) // 3)) as slice_md5 from s where length(seq) >= 3""",
    "fastq_ranges": f"""with r0 as (select conv_id, turn, role, {_dna('text')} as seq from conversations)
select concat_ws(':', conv_id, turn, role) as read_id, length(seq) as bases, length(seq) as qualities, md5(seq) as seq_md5 from r0""",
    "gene_targets": """with d as (select doc_id, coalesce(n_chars, 0) as n from documents where doc_id is not null),
g as (select *, row_number() over (partition by doc_id % 97 order by n desc, doc_id) as rn from d where doc_id % 11 <> 0)
select d.doc_id, case when d.doc_id % 3 = 0 then 'chr' || (d.doc_id % 7) else coalesce('chr' || (g.doc_id % 7), 'none') end as chrom,
  case when d.doc_id % 3 = 0 then greatest(d.doc_id * 13 - 100, 0) else coalesce(greatest(g.doc_id * 13 - 100, 0), -1) end as start,
  case when d.doc_id % 3 = 0 then d.doc_id * 13 + 200 else coalesce(g.doc_id * 13 + g.n + 100, -1) end as "end",
  case when d.doc_id % 3 = 0 then '+' when g.doc_id is null then 'none' when g.doc_id % 2 = 0 then '+' else '-' end as strand,
  case when d.doc_id % 3 = 0 then printf('chr%d:%s-%s', d.doc_id % 7, format('{:,}', d.doc_id * 13 + 1), format('{:,}', d.doc_id * 13 + 100)) else 'G' || (d.doc_id % 97) end as label
from d left join g on g.rn = 1 and g.doc_id % 97 = d.doc_id % 97 and d.doc_id % 3 <> 0""",
    "transcript_edits": f"""with {S}, x as (select doc_id, replace(seq, 'N', 'A') as seq, length(seq) as n, doc_id % 4 as form, case doc_id % 4 when 0 then 1 when 2 then 3 else 2 end as w from s where length(seq) >= 40 and doc_id is not null),
y as (select *, case when doc_id % 2 = 0 then n // 3 + 1 else n // 2 - 1 - w end as start from x),
z as (select *, substr(seq, start + 1, w) as ref from y),
a as (select *, case form when 0 then translate(ref, 'ACGT', 'GTAC') when 1 then case when doc_id % 2 = 0 then 'ACG' else 'CGT' end when 2 then '' else ref || ref end as alt from z)
select 'd' || doc_id as chrom, case form when 0 then 'substitution' when 1 then 'replacement' when 2 then 'deletion' else 'duplication' end as kind, start, start + w as "end", ref, alt, md5(substr(seq, 1, start) || alt || substr(seq, start + w + 1)) as edited_md5 from a""",
    "pe_ranking": f"""with {_PE2_ITEMS}, {_cpg(40)}, {SCORED.replace(S + ', ', '', 1).replace(B + ', ', '', 1)},
nk as (select distinct p.item_id, p.strand, p.nick, p.start as e from pe2 p),
nn as (select nk.item_id, nk.strand, nick, substr(site, 1, 20) as nicking_spacer, row_number() over (partition by nk.item_id, nk.strand, nick order by abs(nick - case bs.strand when '+' then bs.start + 17 else bs.start + 6 end), substr(site, 1, 20), bs.start) as rn
  from nk join bs on nk.item_id = bs.item_id and nk.strand <> bs.strand and abs(nick - case bs.strand when '+' then bs.start + 17 else bs.start + 6 end) between 40 and 100 and case bs.strand when '+' then bs.start + 17 else bs.start + 6 end <> e),
pc as (select *, null as nicking_spacer, 'PE2' as strategy from pe2 union all select p.*, n.nicking_spacer, 'PE3' from pe2 p join nn n on n.rn = 1 and p.item_id = n.item_id and p.strand = n.strand and p.nick = n.nick),
fl as (select guide_id, score, exists (select 1 from isl where isl.doc_id = scored.doc_id and scored.start >= isl.start and scored.start < isl."end") as i from scored where mismatches > 0),
rk as (select *, row_number() over (partition by guide_id, i order by score desc) as r from fl),
sp as (select guide_id, round(10000.0::double / (100.0 + 100.0 * coalesce(sum(score) filter (where r <= 200 and not i), 0)), 6) as s, count(*) filter (where not i) as n,
  round(10000.0::double / (100.0 + 100.0 * coalesce(sum(score) filter (where r <= 200 and i), 0)), 6) as ps, count(*) filter (where i) as pn from rk group by 1),
f as (select c.*, coalesce(o.s, 100.0::double) as specificity, coalesce(o.n, 0) as off_targets, coalesce(o.ps, 100.0::double) as paralog_specificity, coalesce(o.pn, 0) as paralog_hits,
  case when c.nicking_spacer is null then -1.0::double else coalesce(q.s, 100.0::double) end as nicking_specificity, case when c.nicking_spacer is null then -1 else coalesce(q.n, 0) end as nicking_off_targets,
  length(regexp_replace(pbs, '[^CG]', '', 'g')) as pg, length(regexp_replace(rtt, '[^CG]', '', 'g')) as rg
  from pc c left join sp o on o.guide_id = c.spacer left join sp q on q.guide_id = c.nicking_spacer),
h as (select *, case when rtt like 'C%' then null else round(50.0::double + pg - 2 * abs(pbs_length - 13) - (rtt_length - 10) / 10.0::double - 0.3::double * specificity - 0.15::double * greatest(nicking_specificity, 0) - 0.1::double * greatest(0, 1.5::double * (rg + pg) - 25), 9) end as x,
  item_id || '_' || nick || case strand when '+' then '_p_pbs' else '_m_pbs' end || pbs_length || '_rtt' || rtt_length || '_sgRNA_' || strategy || '_' || substr(sha1(translate(spacer, 'T', 'U') || '{SCAFFOLD.replace("T", "U")}' || rtt || pbs), 1, 8) as pegrna_id from f),
z as (select *, row_number() over (partition by item_id order by (x is null)::int, coalesce(-x, 0), strand, nick, pbs_length, rtt_length, strategy, pegrna_id) as rank from h)
select item_id, rank, pegrna_id, spacer, strategy, coalesce(round(x, 6), -1e9) as composite, specificity, off_targets, paralog_specificity, paralog_hits, coalesce(nicking_spacer, '') as nicking_spacer, nicking_specificity, nicking_off_targets from z where rank <= 20""",
}
ORACLE_SQL |= {
    "pe_result_cells": f"""select item_id, rank, case when composite < -1e8 then 'NA' else printf('%.6g', composite) end as composite, printf('%.6g', specificity) as specificity,
  case when nicking_specificity < 0 then '' else printf('%.6g', nicking_specificity) end as nicking_specificity from ({ORACLE_SQL['pe_ranking']})""",
    "kmer_blobs": f"select packed, count from ({ORACLE_SQL['kmer_packed']})",
    "guide_report": f"""with {CONTEXT}, {SCORED.replace(B + ', ', '', 1)}, act as (select spacer, max(round(activity, 9)) as a from x group by 1),
t as (select doc_id, length(seq) // 3 as lo, 2 * (length(seq) // 3) as hi from s where doc_id is not null),
hh as (select scored.*, mismatches = 0 and start >= lo and start < hi as here from scored join t using (doc_id)),
fo as (select * from (select *, row_number() over (partition by doc_id, spacer order by start, strand) as rn from hh where here) where rn = 1),
oo as (select doc_id, spacer, sum(score) filter (where mismatches > 0) as total, count(*) as n from hh where not here group by 1, 2),
cc as (select fo.doc_id, fo.spacer, fo.strand, fo.start, coalesce(a, 0) as a, 10000.0::double / (100.0 + 100.0 * coalesce(total, 0)) as spec, coalesce(n, 0) as n, length(regexp_replace(fo.spacer, '[^GC]', '', 'g')) * 5.0 as gc
  from fo left join act on act.spacer = fo.spacer left join oo on oo.doc_id = fo.doc_id and oo.spacer = fo.spacer),
dd as (select *, round(0.5::double * greatest(0, least(1, a)) + 0.5::double * greatest(0, least(1, spec / 100)), 9) as composite from cc),
ee as (select *, row_number() over (partition by doc_id order by composite desc, spacer) as rank from dd)
select concat_ws(chr(9), rank, spacer, strand, doc_id, start, printf('%.2f', gc), printf('%.6f', a), printf('%.6f', spec), n, printf('%.6f', composite),
  concat_ws(';', case when gc < 25 then 'LOW_GC' end, case when gc > 75 then 'HIGH_GC' end, case when contains(spacer, 'TTTT') then 'POLY_T_RUN' end)) as line from ee where rank <= 10""",
}
