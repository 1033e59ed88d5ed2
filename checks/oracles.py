"""One SQL statement per registered query."""

from __future__ import annotations

from checks.sql import over

MID = "1998-07-01 00:00:00"
MONTH = 30 * 86400


def _mid(select: str) -> str:
    return over(select, MID, MONTH)


STORE_NEWEST = """
select * from (select *, row_number() over (partition by {by} order by event_ts desc, checkpoint_pct desc, store_number desc, msg_offset desc) as rn
               from store_results) where rn = 1
"""

STORE_STATE = """case when finalized_at is not null and missing > 0 then 'TIMED_OUT' when finalized_at is not null then 'DONE'
       when responded > 0 then 'PARTIAL' else 'PENDING' end"""

STORE_PROGRESS = f"""
select message_key, msg_offset, store_number, {STORE_STATE} as state, expected, cast(responded as bigint) as responded,
       cast(missing as bigint) as missing, floor(responded * 100.0e0 / expected * 100.0e0 + 0.5e0) / 100.0e0 as pos_completion_pct,
       done_at, finalized_at
from st
"""

OPEN = "finalized_at is null and next_at is null"
OPEN_STORES = f"(select *, {STORE_STATE} as state from st where {OPEN})"
STALLED_STORES = f"""
(select message_key, msg_offset, store_number, state, greatest(published_at, coalesce(last_received_at, published_at)) as last_activity
 from {OPEN_STORES}
 where greatest(published_at, coalesce(last_received_at, published_at)) < timestamp '{MID}' - interval '5' minute
 order by last_activity, message_key, published_at, msg_offset, store_number limit 500)
"""
STALLED_MESSAGES = f"""
(select message_key, msg_offset, 'PENDING' as state, greatest(published_at, coalesce(last_received_at, published_at)) as last_activity
 from msg where {OPEN} and greatest(published_at, coalesce(last_received_at, published_at)) < timestamp '{MID}' - interval '5' minute
 order by last_activity, message_key, published_at, msg_offset limit 500)
"""
EXPIRED = f"""
(select message_key, msg_offset, store_number, state, expire_at from {OPEN_STORES}
 where expire_at < timestamp '{MID}' and state in ('PENDING', 'PARTIAL')
 order by expire_at, message_key, published_at, msg_offset, store_number limit 500)
"""

STATUS = """
select m.message_key, m.cluster_id, 'PENDING' as state,
       floor((m.stores_done + m.stores_timed_out) * 100.0e0 / m.total_stores * 100.0e0 + 0.5e0) / 100.0e0 as cluster_completion_pct,
       m.total_stores, m.stores_done, cast(0 as bigint) as stores_partial,
       m.total_stores - m.stores_done - m.stores_timed_out as stores_pending, m.stores_timed_out,
       epoch_ms(m.first_published_at) as first_published_at, epoch_ms(m.expire_at) as expire_at, m.flags as inconsistencies,
       s.store_number, case when s.responded > 0 then 'PARTIAL' else 'PENDING' end as store_state,
       floor(s.responded * 100.0e0 / s.expected * 100.0e0 + 0.5e0) / 100.0e0 as pos_completion_pct,
       cast(s.responded as bigint) as responded_pos_count, s.expected as expected_pos_count, cast(s.missing as bigint) as missing_pos_count,
       coalesce((select string_agg(h.pos_hostname, ',' order by h.pos_hostname) from expected h
                 where h.msg_offset = s.msg_offset and h.store_number = s.store_number
                   and not exists (select 1 from latest l where l.msg_offset = h.msg_offset and l.store_number = h.store_number
                                   and l.pos_hostname = h.pos_hostname)), '') as missing_pos,
       case when s.late then 'LATE_POS_RESPONSE' else '' end as store_inconsistencies
from msg m left join st_flags s on s.msg_offset = m.msg_offset and s.finalized_at is null
where m.finalized_at is null and m.next_at is null
"""

DOCUMENTS = """
select s.message_key, s.msg_offset, s.store_number,
       '["' || string_agg(h.pos_hostname, '","' order by h.pos_hostname) || '"]' as expected_pos,
       case when count(l.seq) = 0 then '[]' else '["' || string_agg(case when l.seq is not null then h.pos_hostname end, '","' order by h.pos_hostname) || '"]' end as responded_pos,
       case when count(l.seq) = count(*) then '[]' else '["' || string_agg(case when l.seq is null then h.pos_hostname end, '","' order by h.pos_hostname) || '"]' end as missing_pos,
       '{' || coalesce(string_agg(case when l.seq is not null then '"' || h.pos_hostname || '":{"status":"' || l.status || '"'
            || case when l.ack_at is null then '' else ',"consumerAckTimestamp":"' || strftime(l.ack_at, '%Y-%m-%dT%H:%M:%S.000Z') || '"' end
            || ',"patchReceivedAt":"' || strftime(l.received_at, '%Y-%m-%dT%H:%M:%S.000Z') || '"}' end, ',' order by h.pos_hostname), '') || '}' as pos_statuses
from st s join expected h on h.msg_offset = s.msg_offset and h.store_number = s.store_number
     left join latest l on l.msg_offset = h.msg_offset and l.store_number = h.store_number and l.pos_hostname = h.pos_hostname
group by s.message_key, s.msg_offset, s.store_number
"""

# The status map as rows, with machines that were not named.
STATUS_ENTRIES = """
select l.message_key, l.msg_offset, l.store_number, l.pos_hostname, h.pos_hostname is not null as named,
       '{"status":"' || l.status || '"'
       || case when l.ack_at is null then '' else ',"consumerAckTimestamp":"' || strftime(l.ack_at, '%Y-%m-%dT%H:%M:%S.000Z') || '"' end
       || ',"patchReceivedAt":"' || strftime(l.received_at, '%Y-%m-%dT%H:%M:%S.000Z') || '"}' as entry
from latest l left join expected h on h.msg_offset = l.msg_offset and h.store_number = l.store_number and h.pos_hostname = l.pos_hostname
"""

LIST = "case when {0} = '' then '[]' else '[\"' || replace({0}, ',', '\",\"') || '\"]' end"
STATUS_JSON = f"""
select message_key,
       '{{"messageKey":"' || message_key || '","clusterId":"' || any_value(cluster_id) || '","state":"' || any_value(state)
       || '","clusterCompletionPct":' || any_value(cluster_completion_pct) || ',"totalStores":' || any_value(total_stores)
       || ',"storesDone":' || any_value(stores_done) || ',"storesPartial":' || any_value(stores_partial) || ',"storesPending":' || any_value(stores_pending)
       || ',"storesTimedOut":' || any_value(stores_timed_out)
       || ',"firstPublishedAt":"' || strftime(make_timestamp_ms(any_value(first_published_at)), '%Y-%m-%dT%H:%M:%S.000Z')
       || '","expireAt":"' || strftime(make_timestamp_ms(any_value(expire_at)), '%Y-%m-%dT%H:%M:%S.000Z')
       || '","inconsistencies":' || any_value({LIST.format("inconsistencies")}) || ',"stores":['
       || coalesce(string_agg('{{"storeNumber":"' || store_number || '","state":"' || store_state || '","posCompletionPct":' || pos_completion_pct
                              || ',"respondedPosCount":' || responded_pos_count || ',"expectedPosCount":' || expected_pos_count
                              || ',"missingPosCount":' || missing_pos_count || ',"missingPos":' || {LIST.format("missing_pos")}
                              || ',"inconsistencies":' || {LIST.format("store_inconsistencies")} || '}}', ',' order by store_number), '')
       || ']}}' as document
from ({STATUS})
group by message_key
"""

EVENT_JSON = """
select 'MessageTrackingResult' as event_type, epoch_ms(event_ts) as timestamp_ms,
       '{"messageKey":"' || message_key || '","clusterId":"' || cluster_id || '","msgOffset":' || msg_offset || ',"state":"' || state
       || '","totalStores":' || total_stores || ',"storesDone":' || stores_done || ',"storesPartial":' || stores_partial
       || ',"storesTimedOut":' || stores_timed_out || ',"publishCount":' || publish_count || ',"inconsistencyCount":' || inconsistency_count
       || ',"inconsistencies":"' || inconsistencies || '","firstPublishedAt":' || first_published_at || ',"lastPublishedAt":' || last_published_at
       || ',"expireAt":' || expire_at || ',"trackingDurationMs":' || tracking_duration_ms || '}' as attributes
from message_results
union all
select 'StoreTrackingResult', epoch_ms(event_ts),
       '{"messageKey":"' || message_key || '","clusterId":"' || cluster_id || '","storeNumber":"' || store_number || '","state":"' || state
       || '","checkpointPct":' || checkpoint_pct || ',"expectedPosCount":' || expected_pos_count || ',"respondedPosCount":' || responded_pos_count
       || ',"missingPosCount":' || missing_pos_count || ',"inconsistencyCount":' || inconsistency_count || ',"inconsistencies":"' || inconsistencies
       || '","expireAt":' || expire_at || '}'
from store_results
union all
select 'PosTrackingResult', epoch_ms(event_ts),
       '{"messageKey":"' || message_key || '","clusterId":"' || cluster_id || '","storeNumber":"' || store_number || '","posHostname":"' || pos_hostname
       || '","status":"' || status || '","expireAt":' || expire_at || ',"firstPublishedAt":' || first_published_at
       || case when response_lag_ms is null then '' else ',"responselagMs":' || response_lag_ms end || '}'
from pos_results
"""

REASONS = """
       case when a.msg_offset is null then 'UNKNOWN_KEY' when a.received_at >= a.cutoff then 'AFTER_CUTOFF'
            when s.msg_offset is null then 'UNKNOWN_STORE' when g.was_done = 1 then 'STORE_DONE' end
"""

# Publishes of `tillwatch.sources.samples`, one row per publish, with the rules they break.
SAMPLE_PUBLISHES = """
with p as (
  select o_orderkey, o_orderkey % 3 as last_store, o_custkey,
         case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then '  ' else 'K' || o_custkey end as message_key,
         case when o_orderstatus = 'O' and o_orderpriority = '2-HIGH' then null else 'C' || (o_custkey % 10) end as cluster_id,
         case when o_totalprice < 2000 then null else o_orderkey end as msg_offset, o_orderdate as published_at,
         case when o_totalprice > 450000 then null else o_orderdate + interval '2' day end as expire_at,
         o_orderpriority = '5-LOW' and o_orderstatus = 'F' as no_stores
  from orders),
checked as (
  select *, concat_ws(',', case when trim(message_key) = '' then 'MESSAGE_KEY_BLANK' end, case when cluster_id is null then 'CLUSTER_ID_BLANK' end,
            case when msg_offset is null then 'MSG_OFFSET_NULL' end, case when published_at is null then 'PUBLISHED_AT_NULL' end,
            case when expire_at is null then 'EXPIRE_AT_NULL' end, case when no_stores then 'STORES_EMPTY' end) as reasons
  from p),
good as (select * from checked where reasons = ''),
r as (
  select ((l_orderkey * 20000 + l_partkey) * 1000 + l_suppkey) * 8 + l_linenumber as seq, l_linenumber, l_shipdate,
         concat_ws(',', case when l_quantity > 49 then 'POS_HOSTNAME_BLANK' end, case when l_linenumber = 7 then 'STORE_NUMBER_BLANK' end,
                   case when l_linenumber = 6 then 'DELIVERED_NULL' end,
                   case when l_returnflag = 'R' and l_linestatus = 'O' then 'STATUS_BLANK' end,
                   case when l_shipdate is null then 'RECEIVED_AT_NULL' end) as reasons
  from lineitem)
"""

WINDOWS = """
with slots as (
  select e.event_type, e.value, time_bucket(interval '1' hour, e.ts) - i * interval '1' hour as slot_start,
         time_bucket(interval '1' hour, e.ts) - i * interval '1' hour + {size} * interval '1' hour as slot_end
  from events e cross join (select unnest(range({size})) as i))
select slot_start, slot_end, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total
from slots group by slot_start, slot_end, event_type
"""


HALF_HOUR = f"event_ts >= timestamp '{MID}' - interval '30' minute"
LAST_DAY = f"event_ts >= timestamp '{MID}' - interval '1' day"


# Queries that answer the question of another in another way.
SAME = {
    "lookup_message": "find_message",
    "lookup_store": "find_store",
    "lookup_stores": "find_stores",
    "retention_table": "retention_keep",
    **{
        f"rollup_{name}": f"dash_{name}"
        for name in (
            "d01_messages_by_state d02_inconsistency_rate d03_inconsistency_breakdown d04_replaced_per_hour d06_degraded_by_cluster "
            "d07_unacknowledged_by_cluster d09_missing_by_store d13_delivery_window d14_problem_trend d15_slowest_clusters d21_event_volume"
        ).split()
    },
}


def all_sql() -> dict[str, str]:
    """SQL for all queries that SQL can express."""
    plain = _own_sql()
    rejects = f"select source, reasons, count(*) as n from ({plain['validation_rejects']}) group by source, reasons"
    return {**plain, "stream_rejects": rejects, **{name: plain[other] for name, other in SAME.items()}}


def _own_sql() -> dict[str, str]:
    messages = "select * from message_results"
    half_hour = "time_bucket(interval '30' minute, event_ts) as slot"
    hour = "time_bucket(interval '1' hour, event_ts) as slot"
    return {
        "message_results": over(messages),
        "message_results_mid": _mid(messages),
        "stream_message_results": over(messages),
        "stream_store_results": over("select * from store_results"),
        "stream_pos_results": over("select * from pos_results"),
        "resumed_message_results": over(messages),
        "resumed_store_results": over("select * from store_results"),
        "stream_stale_responses": over(
            f"""select a.seq, a.message_key, a.store_number,
                       case when {REASONS} in ('UNKNOWN_KEY', 'AFTER_CUTOFF') or m.finalized_at <= a.received_at then 'NO_OPEN_DELIVERY' else {REASONS} end as reject_reason
                from att a left join stores0 s on s.msg_offset = a.msg_offset and s.store_number = a.store_number
                     left join guarded g on g.seq = a.seq left join msg m on m.msg_offset = a.msg_offset where {REASONS} is not null"""
        ),
        "stream_missing_pos": over(
            """select e.cutoff as missing_since, e.message_key, e.msg_offset, h.store_number, h.pos_hostname
               from ep e join expected h on h.msg_offset = e.msg_offset
               where not exists (select 1 from response r where r.message_key = e.message_key and r.store_number = h.store_number
                                 and r.pos_hostname = h.pos_hostname and r.received_at >= e.published_at and r.received_at < e.cutoff)"""
        ),
        "store_results": over("select * from store_results"),
        "pos_results": over("select * from pos_results"),
        "publish_flags": over(
            """select message_key, msg_offset, publish_count, first_published_at,
                      concat_ws(',', case when dup then 'DUPLICATE_KEY' end, case when premature then 'PREMATURE_REPUBLISH' end,
                                case when offs then 'OFFSET_MISMATCH' end) as flags from msg"""
        ),
        "response_attribution": over(
            "select seq, message_key, msg_offset, coalesce(received_at < expire_at + interval '60' second, false) as in_window from att"
        ),
        "stale_responses": over(
            f"""select a.seq, a.message_key, a.store_number, {REASONS} as reject_reason
                from att a left join stores0 s on s.msg_offset = a.msg_offset and s.store_number = a.store_number
                     left join guarded g on g.seq = a.seq where {REASONS} is not null"""
        ),
        "unexpected_hosts": over(
            """select message_key, msg_offset, store_number, pos_hostname, count(*) as n_responses, min(received_at) as first_received_at
               from acc where not named group by message_key, msg_offset, store_number, pos_hostname"""
        ),
        "missing_pos": over(
            """select s.message_key, s.msg_offset, s.store_number, h.pos_hostname, cast(1 as bigint) as missing
               from st s join expected h on h.msg_offset = s.msg_offset and h.store_number = s.store_number
               where not exists (select 1 from acc l where l.msg_offset = h.msg_offset and l.store_number = h.store_number
                                 and l.pos_hostname = h.pos_hostname)"""
        ),
        "store_progress": over(STORE_PROGRESS),
        "store_progress_mid": _mid(STORE_PROGRESS),
        "checkpoint_events": over(
            """select message_key, msg_offset, cluster_id, store_number, location_id, state, checkpoint_pct, expected_pos_count,
                      responded_pos_count, missing_pos_count, cast(case when is_late then 1 else 0 end as bigint) as inconsistency_count,
                      case when is_late then 'LATE_POS_RESPONSE' else '' end as inconsistencies, epoch_ms(expire_at) as expire_at, event_ts,
                      floor(responded_pos_count * 100.0e0 / expected_pos_count * 100.0e0 + 0.5e0) / 100.0e0 as pos_completion_pct
               from checkpoints"""
        ),
        "late_responses": over(
            """select a.seq, a.message_key, a.msg_offset, datediff('second', m.first_published_at, a.received_at) // 60 as lag_minutes
               from acc a join msg m on m.msg_offset = a.msg_offset
               where datediff('second', m.first_published_at, a.received_at) >= 61 * 60"""
        ),
        "pos_latest_status": over("select message_key, msg_offset, store_number, pos_hostname, status, received_at, ack_at from latest"),
        "store_faults": over(
            """select message_key, msg_offset, store_number,
                      concat_ws(',', case when late then 'LATE_POS_RESPONSE' end, case when final and conflicting = 1 then 'CONFLICTING_STATUS' end,
                                case when final and missing > 0 then 'MISSING_POS' end, case when final and ack_missing = 1 then 'CONSUMER_ACK_MISSING' end) as flags
               from st_flags"""
        ),
        "store_documents": over(DOCUMENTS),
        "store_status_entries": over(STATUS_ENTRIES),
        "status_documents": _mid(STATUS_JSON),
        "status_document_of_key": _mid(f"select * from ({STATUS_JSON}) where message_key = 'K84'"),
        "event_json": over(EVENT_JSON),
        "status_snapshot": _mid(STATUS),
        "find_message": _mid(f"select message_key, msg_offset, cluster_id, total_stores, stores_done from msg where {OPEN} and message_key = 'K84'"),
        "find_store": _mid(
            f"""select message_key, msg_offset, store_number, state, expected, cast(responded as bigint) as responded
                from {OPEN_STORES} where message_key = 'K84' and store_number = 'S2'"""
        ),
        "find_stores": _mid(
            f"""select message_key, msg_offset, store_number, state, expected, cast(responded as bigint) as responded
                from {OPEN_STORES} where message_key = 'K84' order by store_number"""
        ),
        "open_state": _mid(f"select message_key, msg_offset, store_number, state, expire_at from {OPEN_STORES}"),
        "expired_open_topk": _mid(f"select * from {EXPIRED}"),
        "stalled_stores_topk": _mid(f"select * from {STALLED_STORES}"),
        "stalled_messages_topk": _mid(f"select * from {STALLED_MESSAGES}"),
        "attention_list": _mid(
            f"""select message_key, msg_offset, cast(null as varchar) as store_number, state, last_activity as since, 'STALLED_MESSAGE' as reason
                from {STALLED_MESSAGES}
                union all select message_key, msg_offset, store_number, state, last_activity, 'STALLED_STORE' from {STALLED_STORES}
                union all select message_key, msg_offset, store_number, state, expire_at, 'EXPIRED_STORE' from {EXPIRED}""".replace(" limit 500", "")
        ),
        "retention_keep": over(
            """select message_key, msg_offset, store_number, strftime(expire_at, '%Y_%m_%d') as suffix from st
               where cast(expire_at as date) >= date '1998-06-28'"""
        ),
        "partition_days": over(
            """select strftime(day, '%Y_%m_%d') as suffix, cast(day as timestamp) as lower_bound,
                      cast(day + interval '1' day as timestamp) as upper_bound, cast(sum(n) as bigint) as n_rows, day < date '1998-06-28' as droppable
               from (select cast(expire_at as date) as day, 1 as n from st
                     union all select cast(unnest(generate_series(date '1998-07-01', date '1998-07-15', interval '1' day)) as date), 0)
               group by day"""
        ),
        "publish_store_rows": SAMPLE_PUBLISHES
        + """select message_key, msg_offset, 'S' || i as store_number, case when i = 1 then null else 'L' || i end as location_id,
                    host as pos_hostname, cast(count(host) as bigint) as units
             from (select *, unnest(range(last_store + 1)) as i from good),
                  lateral (select unnest(case when i = 2 then [null] else ['pos-' || (o_custkey % 5), 'pos-' || (o_custkey % 7)] end) as host)
             group by message_key, msg_offset, i, host""",
        "publish_summary_rows": SAMPLE_PUBLISHES
        + """select message_key, published_at, msg_offset, cluster_id, expire_at, cast(last_store + 1 as integer) as total_stores from good""",
        "validation_rejects": SAMPLE_PUBLISHES
        + """select 'publish' as source, o_orderkey as id, reasons from checked where reasons <> ''
             union all select 'response', seq, reasons from r where reasons <> ''""",
        "ack_parsing": SAMPLE_PUBLISHES
        + """select seq, case l_linenumber when 1 then date_trunc('day', l_shipdate) + interval '10:05:23' hour to second
                    when 2 then date_trunc('day', l_shipdate) + to_milliseconds(36323250)
                    when 3 then date_trunc('day', l_shipdate) + to_milliseconds(29123000) end as ack_at
             from r where reasons = ''""".replace(
            "interval '10:05:23' hour to second", "to_milliseconds(36323000)"
        ),
        "dash_d01_messages_by_state": over(f"select {hour}, state, count(*) as n from message_results group by 1, 2"),
        "dash_d01_last_day": _mid(f"select {hour}, state, count(*) as n from message_results where {LAST_DAY} group by 1, 2"),
        "dash_d08_last_day": _mid(
            f"""select message_key, store_number, pos_completion_pct, state
                from ({STORE_NEWEST.format(by='message_key, store_number')}) where {LAST_DAY}"""
        ),
        "dash_d09_last_day": _mid(
            f"""select store_number, cast(sum(missing_pos_count) as bigint) as missing_pos from store_results
                where state in ('DONE', 'TIMED_OUT') and {LAST_DAY} group by store_number order by 2 desc, 1 limit 20"""
        ),
        "message_results_spread": over(messages),
        "store_results_spread": over("select * from store_results"),
        "pos_results_spread": over("select * from pos_results"),
        "dash_d01_last_half_hour": _mid(f"select {hour}, state, count(*) as n from message_results where {HALF_HOUR} group by 1, 2"),
        "dash_d02_last_half_hour": _mid(
            f"select case when count(*) > 0 then 100.0e0 * count(*) filter (where has_inconsistency) / count(*) end as pct_inconsistent from message_results where {HALF_HOUR}"
        ),
        "dash_d02_empty_window": "select cast(null as double) as pct_inconsistent",
        "dash_d08_last_half_hour": _mid(
            f"""select message_key, store_number, pos_completion_pct, state
                from ({STORE_NEWEST.format(by='message_key, store_number')}) where {HALF_HOUR}"""
        ),
        "dash_d09_last_half_hour": _mid(
            f"""select store_number, cast(sum(missing_pos_count) as bigint) as missing_pos from store_results
                where state in ('DONE', 'TIMED_OUT') and {HALF_HOUR} group by store_number order by 2 desc, 1 limit 20"""
        ),
        "dash_d11_last_four_hours": _mid(
            f"""select max(state) as state, max(pos_completion_pct) as pos_completion_pct, max(missing_pos_count) as missing_pos_count
                from ({STORE_NEWEST.format(by='message_key, store_number')})
                where message_key = 'K84' and store_number = 'S2' and event_ts >= timestamp '{MID}' - interval '4' hour"""
        ),
        "dash_d12_last_day": _mid(
            f"""select {half_hour}, avg(last_consumer_ack_ms) / 1000 as avg_sec, round(quantile_cont(last_consumer_ack_ms, 0.5) / 1000, 6) as p50_sec,
                       round(quantile_cont(last_consumer_ack_ms, 0.95) / 1000, 6) as p95_sec, round(quantile_cont(last_consumer_ack_ms, 0.99) / 1000, 6) as p99_sec
                from message_results where {LAST_DAY} group by 1"""
        ),
        "dash_d02_inconsistency_rate": over(
            "select 100.0e0 * count(*) filter (where has_inconsistency) / count(*) as pct_inconsistent from message_results"
        ),
        "dash_d03_inconsistency_breakdown": over(
            """select count(*) filter (where all_inconsistencies like '%MISSING_POS%') as missing_pos,
                      count(*) filter (where all_inconsistencies like '%CONSUMER_ACK_MISSING%') as unacknowledged,
                      count(*) filter (where all_inconsistencies like '%MISSING_STORE%') as missing_store,
                      count(*) filter (where all_inconsistencies like '%DUPLICATE_KEY%') as duplicate_keys,
                      count(*) filter (where all_inconsistencies like '%LATE_POS_RESPONSE%') as late_responses from message_results"""
        ),
        "dash_d04_replaced_per_hour": over(f"select {hour}, count(*) as n from message_results where state = 'REPLACED' group by 1"),
        "dash_d05_cluster_completion": over(
            f"select cluster_id, message_key, pos_completion_pct from ({STORE_NEWEST.format(by='cluster_id, message_key')})"
        ),
        "dash_d06_degraded_by_cluster": over(
            "select cluster_id, count(*) as n from message_results where state = 'DEGRADED' group by cluster_id"
        ),
        "dash_d07_unacknowledged_by_cluster": over(
            """select cluster_id, 100.0e0 * count(*) filter (where all_inconsistencies like '%CONSUMER_ACK_MISSING%') / count(*) as pct_unacknowledged
               from message_results group by cluster_id"""
        ),
        "dash_d08_store_completion": over(
            f"select message_key, store_number, pos_completion_pct, state from ({STORE_NEWEST.format(by='message_key, store_number')})"
        ),
        "dash_d09_missing_by_store": over(
            """select store_number, cast(sum(missing_pos_count) as bigint) as missing_pos from store_results where state in ('DONE', 'TIMED_OUT')
               group by store_number order by 2 desc, 1 limit 20"""
        ),
        "dash_d10_missing_machines_by_store": over(
            """select store_number, count(distinct pos_hostname) as machines from pos_results where status = 'MISSING'
               group by store_number order by 2 desc, 1 limit 20"""
        ),
        "dash_d11_store_lookup": over(
            f"""select state, pos_completion_pct, missing_pos_count from ({STORE_NEWEST.format(by='message_key, store_number')})
                where message_key = 'K84' and store_number = 'S2'"""
        ),
        "dash_d12_latency": over(
            f"""select {half_hour}, avg(last_consumer_ack_ms) / 1000 as avg_sec, round(quantile_cont(last_consumer_ack_ms, 0.5) / 1000, 6) as p50_sec,
                       round(quantile_cont(last_consumer_ack_ms, 0.95) / 1000, 6) as p95_sec, round(quantile_cont(last_consumer_ack_ms, 0.99) / 1000, 6) as p99_sec
                from message_results group by 1"""
        ),
        "dash_d13_delivery_window": over(
            f"select {half_hour}, avg(publish_to_last_pos_ack_ms) / 1000 as delivery_window_sec from message_results group by 1"
        ),
        "dash_d14_problem_trend": over(
            f"""select {hour}, cast(sum(unacked_pos_count) as bigint) as unacked_pos_count, cast(sum(missing_pos_count) as bigint) as missing_pos_count
                from message_results group by 1"""
        ),
        "dash_d15_slowest_clusters": over(
            """select cluster_id, avg(last_consumer_ack_ms) / 1000 as avg_sec from message_results group by cluster_id
               order by 2 desc nulls last, 1 limit 10"""
        ),
        "dash_d16_reached_all": over(
            """select message_key, msg_offset, cast(missing as bigint) as missing_pos_count, missing = 0 as reached_all
               from (select *, row_number() over (partition by message_key order by published_at desc, msg_offset desc) as rn from msg) where rn = 1"""
        ),
        "dash_d17_missing_machines": over(
            "select message_key, msg_offset, cluster_id, store_number, pos_hostname, event_ts from pos_results where status = 'MISSING'"
        ),
        "dash_d18_pending_by_store": _mid(
            f"select message_key, msg_offset, store_number, state, cast(missing as bigint) as pending_pos from {OPEN_STORES}"
        ),
        "dash_d19_republished": over(
            "select message_key, count(*) as times, max(event_ts) as last_replaced_at from message_results where state = 'REPLACED' group by message_key"
        ),
        "dash_d20_chronic_missing": over(
            """select store_number, cast(sum(missing_pos_count) as bigint) as missing_pos from store_results where state in ('DONE', 'TIMED_OUT')
               group by store_number"""
        ),
        "dash_d21_event_volume": over(
            """select event_type, day, cast(sum(n) as bigint) as events, max(n) as peak_per_minute
               from (select event_type, cast(event_ts as date) as day, date_trunc('minute', event_ts) as minute, count(*) as n
                     from (select 'message' as event_type, event_ts from message_results union all select 'store', event_ts from store_results
                           union all select 'pos', event_ts from pos_results) group by 1, 2, 3) group by event_type, day"""
        ),
        "dash_d22_in_flight": over(
            """select level, day, cast(sum(change) over (partition by level order by day) as bigint) as open_rows
               from (select level, cast(t as date) as day, sum(step) as change
                     from (select 'message' as level, published_at as t, 1 as step from msg
                           union all select 'message', coalesce(finalized_at, next_at), -1 from msg
                           union all select 'store', published_at, 1 from st
                           union all select 'store', coalesce(finalized_at, next_at), -1 from st)
                     where t is not null group by 1, 2)"""
        ),
        "stream_event_windows": WINDOWS.format(size=1),
        "stream_trailing_windows": WINDOWS.format(size=4),
    }
