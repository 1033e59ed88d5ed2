"""The rules as plain SQL over the order tables, step by step as they are stated: responses in sequence."""

from __future__ import annotations

PUBLISH = """
publish as (
  select 'K' || cast(o_custkey as varchar) as message_key, 'N' || cast(c_nationkey as varchar) as cluster_id,
         o_orderkey as msg_offset,
         o_orderdate + (o_orderkey % 1440) * interval '1' minute as published_at,
         o_orderdate + (o_orderkey % 1440) * interval '1' minute + (30 + (o_orderkey % 5) * 60) * interval '1' day as expire_at
  from orders join customer on c_custkey = o_custkey
  where o_orderkey in (select l_orderkey from lineitem)),
"""

BASE = """
with {publish}
expected as (
  select distinct l_orderkey as msg_offset, 'S' || cast(l_suppkey % 3 as varchar) as store_number,
         'pos-' || cast(l_suppkey as varchar) || '-' || cast(l_partkey as varchar) as pos_hostname
  from lineitem),
response as (
  select p.message_key, 'S' || cast(l_suppkey % 3 as varchar) as store_number,
         'pos-' || cast(l_suppkey as varchar) || '-' || cast(l_partkey as varchar) as pos_hostname,
         case when l_returnflag = 'A' then 'DONE' when l_returnflag = 'R' and l_linestatus = 'F' then 'DELIVERED'
              when l_returnflag = 'R' then 'DELIVERED_NO_ACK' else 'FAILED' end as status,
         p.published_at + ((l_partkey*7 + l_linenumber*11) % 90 + k*5) * interval '1' minute as received_at,
         case when l_returnflag in ('A','R') and l_linestatus = 'F'
              then p.published_at + ((l_partkey*7 + l_linenumber*11) % 90 + k*5) * interval '1' minute
                   - interval '2' second end as ack_at,
         (((l_orderkey*20000 + l_partkey)*1000 + l_suppkey)*8 + l_linenumber)*2 + k as seq
  from lineitem join publish p on p.msg_offset = l_orderkey
       cross join (select 0 as k union all select 1 as k) kk
  where not (l_returnflag = 'N' and l_linestatus = 'O') and (k = 0 or l_quantity > 45)),
heard as (select * from response where received_at <= timestamp '{as_of}'),
stores0 as (
  select msg_offset, store_number, count(*) as expected from expected
  where msg_offset in (select msg_offset from publish where published_at <= timestamp '{as_of}')
  group by msg_offset, store_number),
ep as (
  select p.*, expire_at + interval '{lag}' second as cutoff,
         (select count(*) from stores0 s where s.msg_offset = p.msg_offset) as total_stores,
         lag(msg_offset) over w as prev_offset, lag(expire_at) over w as prev_expire,
         lead(published_at) over w as next_at
  from publish p where published_at <= timestamp '{as_of}'
  window w as (partition by message_key order by published_at, msg_offset)),
att as (
  select r.*, e.msg_offset, e.published_at, e.expire_at, e.cutoff
  from heard r left join ep e on e.message_key = r.message_key and e.published_at <= r.received_at
       and (e.next_at is null or r.received_at < e.next_at)),
known as (
  select a.*, s.expected, h.pos_hostname is not null as named,
         row_number() over (partition by a.msg_offset, a.store_number, a.pos_hostname order by received_at, seq) as host_no
  from att a join stores0 s on s.msg_offset = a.msg_offset and s.store_number = a.store_number
       left join expected h on h.msg_offset = a.msg_offset and h.store_number = a.store_number and h.pos_hostname = a.pos_hostname
  where a.received_at < a.cutoff),
run as (
  select *, case when named and host_no = 1 then 1 else 0 end as advance,
         sum(case when named and host_no = 1 then 1 else 0 end)
           over (partition by msg_offset, store_number order by received_at, seq rows unbounded preceding) as responded
  from known),
guarded as (
  select *, coalesce(max(case when responded >= expected then 1 else 0 end)
           over (partition by msg_offset, store_number order by received_at, seq
                 rows between unbounded preceding and 1 preceding), 0) as was_done
  from run),
acc as (select * from guarded where was_done = 0),
latest as (
  select * from (select *, row_number() over (partition by msg_offset, store_number, pos_hostname
                                              order by received_at desc, seq desc) as newest from acc)
  where newest = 1),
progress as (
  select msg_offset, store_number, max(responded) as responded,
         min(case when responded >= expected then received_at end) as done_at, max(received_at) as last_received_at
  from acc group by msg_offset, store_number),
faults as (
  select msg_offset, store_number,
         max(case when status in ('DONE','DELIVERED') then 1 else 0 end) * max(case when status = 'DELIVERED_NO_ACK' then 1 else 0 end) as conflicting,
         max(case when status in ('DONE','DELIVERED') and ack_at is null then 1 else 0 end) as ack_missing,
         sum(case when ack_at is null then 1 else 0 end) as unacked, max(ack_at) as last_ack_at
  from latest group by msg_offset, store_number),
st as (
  select s.msg_offset, s.store_number, e.message_key, e.cluster_id, e.published_at, e.expire_at, e.next_at, e.total_stores,
         s.expected, coalesce(p.responded, 0) as responded, s.expected - coalesce(p.responded, 0) as missing,
         p.done_at, p.last_received_at, coalesce(f.conflicting, 0) as conflicting, coalesce(f.ack_missing, 0) as ack_missing,
         coalesce(f.unacked, 0) as unacked, f.last_ack_at,
         coalesce(p.done_at, case when (e.next_at is null or e.cutoff <= e.next_at) and e.cutoff <= timestamp '{as_of}' then e.cutoff end) as finalized_at
  from stores0 s join ep e on e.msg_offset = s.msg_offset
       left join progress p on p.msg_offset = s.msg_offset and p.store_number = s.store_number
       left join faults f on f.msg_offset = s.msg_offset and f.store_number = s.store_number),
counted as (
  select msg_offset, count(case when finalized_at is not null and missing = 0 then 1 end) as stores_done,
         count(case when finalized_at is not null and missing > 0 then 1 end) as stores_timed_out,
         count(finalized_at) as settled, max(finalized_at) as last_settled_at, sum(missing) as missing, sum(unacked) as unacked,
         max(last_received_at) as last_received_at, max(last_ack_at) as last_ack_at,
         max(case when finalized_at is not null then conflicting else 0 end) as any_conflicting,
         max(case when finalized_at is not null then ack_missing else 0 end) as any_ack_missing,
         max(case when finalized_at is not null and missing > 0 then 1 else 0 end) as any_missing
  from st group by msg_offset),
m0 as (
  select e.*, c.stores_done, c.stores_timed_out, c.last_settled_at, c.missing, c.unacked, c.last_received_at, c.last_ack_at,
         c.any_conflicting, c.any_ack_missing, c.any_missing,
         case when c.settled >= e.total_stores then c.last_settled_at end as finalized_at
  from ep e join counted c on c.msg_offset = e.msg_offset),
m1 as (
  select *, case when lag(msg_offset) over w is not null and lag(finalized_at) over w is null then 0 else 1 end as starts
  from m0 window w as (partition by message_key order by published_at, msg_offset)),
m2 as (select *, sum(starts) over (partition by message_key order by published_at, msg_offset rows unbounded preceding) as chain from m1),
m3 as (
  select *, min(published_at) over (partition by message_key, chain) as first_published_at,
         row_number() over (partition by message_key, chain order by published_at, msg_offset) as publish_count
  from m2),
m4 as (
  select *, finalized_at is null and next_at is not null as replaced,
         publish_count > 1 as dup, publish_count > 1 and coalesce(prev_expire > published_at, false) as premature,
         publish_count > 1 and prev_offset is not null and prev_offset <> msg_offset as offs,
         finalized_at is not null and stores_timed_out > 0 as missing_store,
         coalesce(datediff('second', first_published_at, last_received_at) >= 61*60, false) as late
  from m3),
msg as (
  select *, case when dup then 1 else 0 end + case when premature then 1 else 0 end + case when offs then 1 else 0 end
            + case when missing_store then 1 else 0 end as flag_count,
         concat_ws(',', case when dup then 'DUPLICATE_KEY' end, case when premature then 'PREMATURE_REPUBLISH' end,
                   case when offs then 'OFFSET_MISMATCH' end, case when missing_store then 'MISSING_STORE' end) as flags,
         concat_ws(',', case when any_conflicting = 1 then 'CONFLICTING_STATUS' end, case when any_ack_missing = 1 then 'CONSUMER_ACK_MISSING' end,
                   case when dup then 'DUPLICATE_KEY' end, case when late then 'LATE_POS_RESPONSE' end,
                   case when any_missing = 1 then 'MISSING_POS' end, case when missing_store then 'MISSING_STORE' end,
                   case when offs then 'OFFSET_MISMATCH' end, case when premature then 'PREMATURE_REPUBLISH' end) as all_flags
  from m4),
message_results as (
  select message_key, cluster_id, msg_offset,
         case when replaced then 'REPLACED' when flag_count > 0 or stores_timed_out > 0 then 'DEGRADED' else 'DONE' end as state,
         total_stores, stores_done, cast(0 as bigint) as stores_partial, stores_timed_out, publish_count,
         cast(flag_count as bigint) as inconsistency_count, flags as inconsistencies,
         epoch_ms(first_published_at) as first_published_at, epoch_ms(published_at) as last_published_at, epoch_ms(expire_at) as expire_at,
         epoch_ms(case when replaced then greatest(published_at, coalesce(last_settled_at, published_at)) else finalized_at end)
           - epoch_ms(first_published_at) as tracking_duration_ms,
         case when replaced then next_at else finalized_at end as event_ts,
         all_flags <> '' as has_inconsistency, all_flags as all_inconsistencies,
         epoch_ms(last_ack_at) - epoch_ms(first_published_at) as last_consumer_ack_ms,
         epoch_ms(last_received_at) - epoch_ms(first_published_at) as publish_to_last_pos_ack_ms,
         cast(unacked as bigint) as unacked_pos_count, cast(missing as bigint) as missing_pos_count
  from msg where replaced or finalized_at is not null),
pct as (
  select *, cast(floor(responded * 100.0e0 / expected + 0.5e0) as bigint) as p,
         cast(floor((responded - advance) * 100.0e0 / expected + 0.5e0) as bigint) as p0
  from acc),
cross0 as (
  select *, case when p >= 100 then 100 when p >= 50 then 50 when p >= 1 then 1 else 0 end as cp,
         case when p0 >= 100 then 100 when p0 >= 50 then 50 when p0 >= 1 then 1 else 0 end as cp0
  from pct),
checkpoints as (
  select c.message_key, c.msg_offset, m.cluster_id, c.store_number, cast(null as varchar) as location_id,
         case when c.responded >= c.expected then 'DONE' else 'PARTIAL' end as state, cast(c.cp as bigint) as checkpoint_pct,
         c.expected as expected_pos_count, cast(c.responded as bigint) as responded_pos_count,
         cast(c.expected - c.responded as bigint) as missing_pos_count,
         datediff('second', m.first_published_at, c.received_at) >= 61*60 as is_late, m.expire_at, c.received_at as event_ts
  from cross0 c join msg m on m.msg_offset = c.msg_offset where c.cp > c.cp0),
st_flags as (
  select s.*, m.first_published_at, s.finalized_at is not null as final,
         coalesce(datediff('second', m.first_published_at, s.last_received_at) >= 61*60, false) as late
  from st s join msg m on m.msg_offset = s.msg_offset),
store_results as (
  select message_key, msg_offset, cluster_id, store_number, location_id, state, checkpoint_pct, expected_pos_count, responded_pos_count,
         missing_pos_count, cast(case when is_late then 1 else 0 end as bigint) as inconsistency_count,
         case when is_late then 'LATE_POS_RESPONSE' else '' end as inconsistencies, epoch_ms(expire_at) as expire_at, event_ts,
         floor(responded_pos_count * 100.0e0 / expected_pos_count * 100.0e0 + 0.5e0) / 100.0e0 as pos_completion_pct
  from checkpoints
  union all
  select message_key, msg_offset, cluster_id, store_number, cast(null as varchar),
         case when missing > 0 then 'TIMED_OUT' else 'DONE' end, cast(100 as bigint), expected, cast(responded as bigint), cast(missing as bigint),
         cast(case when late then 1 else 0 end + conflicting + case when missing > 0 then 1 else 0 end + ack_missing as bigint),
         concat_ws(',', case when late then 'LATE_POS_RESPONSE' end, case when conflicting = 1 then 'CONFLICTING_STATUS' end,
                   case when missing > 0 then 'MISSING_POS' end, case when ack_missing = 1 then 'CONSUMER_ACK_MISSING' end),
         epoch_ms(expire_at), finalized_at, floor(responded * 100.0e0 / expected * 100.0e0 + 0.5e0) / 100.0e0
  from st_flags where final and floor(responded * 100.0e0 / expected + 0.5e0) < 100),
pos_results as (
  select s.message_key, s.msg_offset, s.cluster_id, s.store_number, cast(null as varchar) as location_id, h.pos_hostname,
         'MISSING' as status, epoch_ms(s.expire_at) as expire_at, epoch_ms(s.first_published_at) as first_published_at,
         cast(null as bigint) as response_lag_ms, s.finalized_at as event_ts
  from st_flags s join expected h on h.msg_offset = s.msg_offset and h.store_number = s.store_number
  where s.final and not exists (select 1 from latest l where l.msg_offset = h.msg_offset and l.store_number = h.store_number
                                and l.pos_hostname = h.pos_hostname)
  union all
  select s.message_key, s.msg_offset, s.cluster_id, s.store_number, cast(null as varchar), l.pos_hostname, l.status,
         epoch_ms(s.expire_at), epoch_ms(s.first_published_at), epoch_ms(l.received_at) - epoch_ms(s.first_published_at), s.finalized_at
  from st_flags s join latest l on l.msg_offset = s.msg_offset and l.store_number = s.store_number
  where s.final and l.status in ('FAILED', 'DELIVERED_NO_ACK'))
"""

END = "2003-01-01 00:00:00"


def over(select: str, as_of: str = END, lag: int = 60) -> str:
    """A query over the base tables at a point in time."""
    return BASE.format(publish=PUBLISH, as_of=as_of, lag=lag) + select
