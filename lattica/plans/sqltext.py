"""Pieces of oracle SQL."""

from __future__ import annotations


def op_len(c: str, ops: str = "MIXmix=") -> str:
    return rf"coalesce(cast(list_sum(list_transform(regexp_extract_all({c}, '(\d+)[{ops}]', 1), lambda v: cast(v as bigint))) as bigint), 0)"


def pct(part: str, whole: str) -> str:
    return f"case when ({whole}) <> 0 then floor((({part}) * 20000 + ({whole})) / (({whole}) * 2)) / 100 end"


def mismatch(c: str, ops: str = "MIXmix=") -> str:
    return pct(op_len(c, "IXDixd"), op_len(c, ops))


def both_clipped(c: str) -> str:
    return rf"regexp_matches({c}, '^\d+[Ss](\d+[A-Za-z=])+\d+[Ss]$')"


def mid_clip(c: str, pos: str, ref_len: str, ops: str = "MIXmix=") -> str:
    return rf"(regexp_matches({c}, '[Ss]') and not (regexp_matches({c}, '^\d+[Ss]') and {pos} = 1) and not (regexp_matches({c}, '[Ss]$') and {pos} + {op_len(c, ops)} - 1 = {ref_len}))"


ALN = f"""aln as (
  select read_base, mate, side, ref_id, ref_len, pos, cigar, {mismatch('cigar')} as bad, {op_len('cigar')} as aligned, {both_clipped('cigar')} as bothc, {mid_clip('cigar', 'pos', 'ref_len')} as midc,
    least(pos - 1, ref_len - pos - {op_len('cigar')} + 1) as near, regexp_matches(cigar, '[Ss]') as clipped
  from fx_aln
)"""

# qualified pairs of both sides: reads, then references that are fine for every mate, then classes
PAIRS = f"""{ALN}, mins as (
  select side, read_base, mate, coalesce(min(bad) filter (where aligned >= 45), min(bad)) as ref_min from aln group by all
), hits as (
  select side, read_base, mate, ref_id, count(distinct pos) > 1 as several from aln group by all
), judged as (
  select a.*, not h.several and not bothc and bad <= 2 and aligned >= 45 and not midc and (a.side <> 'marker' or bad <= ref_min) as fine
  from aln a join mins m using (side, read_base, mate) join hits h using (side, read_base, mate, ref_id)
), good as (
  select distinct side, read_base, ref_id, mate, pos, cigar, ref_len, aligned, near, clipped from judged j
  where not exists (select 1 from judged k where k.side = j.side and k.read_base = j.read_base and k.ref_id = j.ref_id and not k.fine)
), mates as (
  select side, read_base, max(case when mate = 1 then 1 else 0 end) as r1, max(case when mate = 2 then 1 else 0 end) as r2 from good group by all
), shared as (
  select side, read_base, ref_id, count(distinct mate) as n from good group by all
), pairs as (
  select g.*, case when r1 = 1 and r2 = 1 then 'both' when r1 = 1 then 'r1' else 'r2' end as pair_class
  from good g join mates using (side, read_base) join shared s using (side, read_base, ref_id)
  where r1 + r2 = 1 or s.n = 2
)"""

LINKS = f"""{PAIRS}, mk as (select distinct read_base, ref_id as marker, pair_class from pairs where side = 'marker'),
ct as (select distinct p.read_base, p.ref_id as contig, c.genome, p.pair_class from pairs p join fx_contigs c on c.contig = p.ref_id where p.side = 'contig'),
ones as (select read_base from ct group by 1 having count(distinct genome) = 1),
links as (
  select m.read_base, m.marker, c.contig, c.genome from mk m join ct c using (read_base)
  where (m.pair_class = 'both' and c.pair_class = 'both')
     or (m.pair_class <> 'both' and c.pair_class <> 'both' and read_base in (select read_base from ones))
)"""


def side(name: str, which: str) -> str:
    """Statistics of one side of the links; `covered` counts distinct positions by listing them."""
    end_num = "cast(count(*) filter (where near <= 10) as bigint)"
    return f"""{name}_hits as (
  select l.marker, l.contig, l.read_base, p.pos, p.aligned, p.near, p.clipped, p.ref_len from links l join pairs p on p.read_base = l.read_base and p.side = '{which}' and p.ref_id = l.{which}
), {name}_pos as (
  select marker, contig, count(distinct x) as matched from (select marker, contig, unnest(range(pos, pos + aligned)) as x from {name}_hits) group by all
), {name}_st as (
  select marker, contig, count(distinct read_base) as reads, count(*) as cigars, {pct('count(*) filter (where aligned <= 75)', 'count(*)')} as short_pct,
    {end_num} as end_num, {pct(end_num, 'count(*)')} as end_pct, {pct('count(*) filter (where clipped)', 'count(*)')} as clip_pct, max(ref_len) as ref_len
  from {name}_hits group by all
), {name} as (
  select s.* exclude (ref_len), p.matched, {pct('p.matched', 's.ref_len')} as matched_pct from {name}_st s join {name}_pos p using (marker, contig)
)"""


STATS = f"{LINKS}, {side('l', 'marker')}, {side('r', 'contig')}"
JOINED = "l join r using (marker, contig)"
COLS = "marker, contig, " + ", ".join(f"{s}.{c} as {c}_{s}" for s in "lr" for c in ("reads", "cigars", "short_pct", "end_num", "end_pct", "clip_pct", "matched", "matched_pct"))
SHORT = "(l.short_pct < (case when l.cigars < 100 then 85 else 75 end) and r.short_pct < (case when l.cigars < 100 then 85 else 75 end))"

# both rounds: pairs of three sides (markers, contigs, bridges), then what the first round leaves free
PAIRS3 = PAIRS.replace("from fx_aln", "from (select read_base, mate, side, ref_id, ref_len, pos, cigar from fx_aln union all select read_base, mate, 'mini' as side, ref_id, ref_len, pos, cigar from fx_minis)")


def bridge_side(name: str, other: str, which: str) -> str:
    """Statistics of one side (l: bridge, r: other) of the links of bridges and `other` (a side's name)."""
    mate = "3 - o.mate" if other == "marker" else "o.mate"
    end_num = "cast(count(*) filter (where near <= 10) as bigint)"
    return f"""{name}_hits as (
  select m.ref_id as mini, o.ref_id as other, m.read_base, {which}.pos, {which}.aligned, {which}.near, {which}.clipped, {which}.ref_len
  from (select * from pairs where side = 'mini') m join (select * from pairs where side = '{other}') o on o.read_base = m.read_base and {mate} = m.mate
), {name}_pos as (
  select mini, other, count(distinct x) as matched from (select mini, other, unnest(range(pos, pos + aligned)) as x from {name}_hits) group by all
), {name}_st as (
  select mini, other, count(distinct read_base) as reads, count(*) as cigars, {pct('count(*) filter (where aligned <= 75)', 'count(*)')} as short_pct,
    {end_num} as end_num, {pct(end_num, 'count(*)')} as end_pct, {pct('count(*) filter (where clipped)', 'count(*)')} as clip_pct, max(ref_len) as ref_len
  from {name}_hits group by all
), {name} as (
  select s.* exclude (ref_len), p.matched, {pct('p.matched', 's.ref_len')} as matched_pct from {name}_st s join {name}_pos p using (mini, other)
)"""


BRIDGES = f"{PAIRS3}, {bridge_side('cl', 'contig', 'm')}, {bridge_side('cr', 'contig', 'o')}, {bridge_side('ml', 'marker', 'm')}, {bridge_side('mr', 'marker', 'o')}"


def bridge_cols(a: str, b: str, name: str) -> str:
    return f"mini, other as {name}, " + ", ".join(f"{t}.{c} as {c}_{s}" for t, s in ((a, "l"), (b, "r")) for c in ("reads", "cigars", "short_pct", "end_num", "end_pct", "clip_pct", "matched", "matched_pct"))


def bridge_short(a: str, b: str) -> str:
    return f"({a}.short_pct < (case when {a}.cigars < 100 then 85 else 75 end) and {b}.short_pct < (case when {a}.cigars < 100 then 85 else 75 end))"


def bridge_end(x: str, pct_at_least: int) -> str:
    return f"({x}.end_num > 0 and {x}.end_pct >= {pct_at_least})"


TO_CONTIG = f"{bridge_short('cl', 'cr')} and not (cl.cigars > 15 and abs(cl.clip_pct - cr.clip_pct) > 50) and ({bridge_end('cl', 5)} or cl.matched >= 300 or cl.matched_pct >= 50) and {bridge_end('cr', 20)}"
TO_MARKER = f"{bridge_short('ml', 'mr')} and ({bridge_end('ml', 5)} or ml.matched >= 300 or ml.matched_pct >= 50) and ({bridge_end('mr', 5)} or mr.matched >= 300 or mr.matched_pct >= 50)"
ROUND2 = f"""{BRIDGES}, mini_genome as (
  select mini, genome, cast(sum(cl.reads) as bigint) as n from cl join cr using (mini, other) join fx_contigs c on c.contig = other where cl.reads >= 3 and {TO_CONTIG} group by all
), bridge as (
  select mini, genome from (select *, max(n) over (partition by genome) as best from (select *, row_number() over (partition by mini order by n desc, genome) as k from mini_genome where n >= 3) where k = 1) where n >= best * 0.8
), mini_marker as (
  select mini, other as marker, ml.reads as n from ml join mr using (mini, other) where ml.reads >= 3 and {TO_MARKER}
)"""
