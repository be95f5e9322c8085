"""The mix of documents in DuckDB's dialect, for a repetition limit and the least budget."""

from __future__ import annotations

from .mixing import BLOCKS


def _number(digits: int, *parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(cast({p} as varchar), '')" for p in parts) + ")"
    return f"cast('0x' || substr(md5({text}), 1, {digits}) as bigint)"


def mixing_sql(repeats: float = 2.0, seed: int = 42) -> str:
    limit = f"({repeats} * (1 + 1e-12))"
    return f"""
with d as (
  select doc_id, source, greatest(cast(ceil(coalesce(strlen(text), 0) / 4) as bigint), 1) as tokens, {_number(15, "doc_id", "text")} as key from documents
), b as (select source, key % {BLOCKS} as block, cast(sum(tokens) as bigint) as tokens from d group by all),
s as (select source, cast(sum(tokens) as bigint) as t from b group by all),
g as (select sum(t) as total, min(t) as lo, max(t) as hi from s),
a as (select *, case when hi / lo <= {limit} then 0 else ceil((1 - ln({limit}) / ln(hi / lo)) * 1073741824) / 1073741824 end as alpha from g),
z as (select total, lo, hi, alpha, sum(pow(t / total, alpha)) as z from a, s group by all),
budget as (select *, ceil(total * greatest(pow(hi / total, 1 - alpha) * z, pow(lo / total, 1 - alpha) * z)) as budget from z),
w as (select s.source, s.t, pow(s.t / total, alpha) / z as weight, greatest(cast(floor(pow(s.t / total, alpha) / z * budget + 1e-6) as bigint), s.t) as quota from s, budget),
f as (select b.source, b.block, b.tokens, w.t, w.weight, w.quota, w.quota // w.t as whole from b join w on b.source is not distinct from w.source),
r as (
  select *, quota - whole * t - (sum(tokens) over (partition by source order by {_number(10, "source", "block", "whole", str(seed))}, block) - tokens) as room from f
), plan as (select source, block, weight, whole + case when room >= tokens then 1 else 0 end as epochs, case when room > 0 and room < tokens then room end as room from r),
upto as (
  select d.source, p.block, d.key, p.room, sum(d.tokens) over (partition by d.source, p.block order by d.key) as upto
  from d join plan p on d.source is not distinct from p.source and d.key % {BLOCKS} = p.block where p.room is not null
), cuts as (select source, block, max(key) as cut from upto where upto <= room group by all),
e as (
  select d.doc_id, d.source, d.tokens, p.weight, p.block, unnest(range(1, p.epochs + case when d.key <= c.cut then 1 else 0 end + 1)) as epoch
  from d join plan p on d.source is not distinct from p.source and d.key % {BLOCKS} = p.block
  left join cuts c on c.source is not distinct from p.source and c.block = p.block
)
select doc_id, source, tokens, round(weight, 9) as weight, epoch, block, {_number(10, "source", "block", "epoch - 1", str(seed))} as turn from e"""
