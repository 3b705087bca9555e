"""Streaming queries, run once over all available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import rules
from ..sources.scratch import new_path
from ..streaming import streams
from .catalog import query
from .fixtures import OBSERVATION, Registry, message_table, with_ctes
from .q_messages import ALL_F, AS_OF, FULL, HEAD, HEAD_CTES

TS = "cast(ts as timestamp)"


def events_stream(spark, sf_dir):
    return streams.read_table(spark, sf_dir, "events.parquet").selectExpr(
        "event_id", f"{TS} as ts", "user_id", "event_type", "value")


def job(spark, sf_dir, out):
    """A batch job over a micro-batch of messages."""
    r = Registry(spark, sf_dir)

    def run(messages):
        v = rules.Validation(messages, r.orgs(), r.codes(), r.relations(), r.valid_values(), f"date '{AS_OF}'", r.locations())
        return out(v)

    return run


def message_stream(spark, sf_dir):
    return message_table(streams.read_table(spark, sf_dir, "orders.parquet"))


@query("stream_ingest", with_ctes(FULL, "select rule, severity, count(*) as findings from all_f group by 1, 2", ALL_F))
def stream_ingest(spark, sf_dir):
    rows = streams.ingest(message_stream(spark, sf_dir), job(spark, sf_dir, lambda v: v.findings().select("msg_id", "org_id", "rule", "severity")))
    return rows.groupBy("rule", "severity").agg(F.count("*").alias("findings"))


@query("stream_dedup", "select distinct concat(user_id, '-', event_type, '-', day(ts)) as control_id from events")
def stream_dedup(spark, sf_dir):
    events = events_stream(spark, sf_dir).selectExpr("concat(user_id, '-', event_type, '-', day(ts)) as control_id", "ts")
    return streams.run_to_files(streams.dedup(events, "control_id", "ts", "60 days"), "dedup").select("control_id")


UPSERTED = ["name_last", "sex", "state", "protection_ind", "guardian_last", "reported_date", "updated_date"]


@query("stream_upsert", with_ctes(HEAD, f"""
    select org_id, mrn, arg_max(name_last, ord) as name_last, arg_max(sex, ord) as sex, arg_max(state, ord) as state,
      case when bool_or(has_pd1) then 'N' end as protection_ind, arg_max(guardian_last, ord) filter (guardian_last is not null) as guardian_last,
      min(received_date) as reported_date, max(received_date) as updated_date
    from (select f.*, g.nk_last as guardian_last, (received_date, f.msg_id) as ord from fxf f
      left join (select fxn.msg_id, nk_last from fxn join nk on fxn.msg_id = nk.msg_id and fxn.k = nk.pick) g on f.msg_id = g.msg_id
      where eff_type in ('VXU', 'ORU') and f.msg_id not in (select msg_id from head where severity = 'E')) t group by 1, 2""", HEAD_CTES))
def stream_upsert(spark, sf_dir):
    accepted = job(spark, sf_dir, lambda v: v.accepted)
    return streams.upsert_stream(message_stream(spark, sf_dir), accepted).rows().select("org_id", "mrn", *UPSERTED)


@query("stream_counts", """
    select 'tumbling' as kind, event_type, date_trunc('day', ts)::date as start_day, 0 as start_hour, count(*) as n from events group by 1, 2, 3 union all
    select 'sliding', event_type, s::date, cast(hour(s) as int), count(*) from (select event_type, time_bucket(interval 12 hours, ts, timestamp '2000-01-01 00:00:00') as s from events union all
      select event_type, time_bucket(interval 12 hours, ts, timestamp '2000-01-01 00:00:00') - interval 12 hours from events) t group by 1, 2, 3, 4 union all
    select 'session', user_id::varchar, min(ts)::date, cast(hour(min(ts)) as int), count(*) from (
      select *, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as sid from (
        select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 12 hours then 0 else 1 end as fresh from events) a) b group by user_id, sid""")
def stream_counts(spark, sf_dir):
    def build(events):
        def rows(agg, kind, key):
            return agg.selectExpr(f"'{kind}' as kind", f"cast({key} as string) as event_type", "w.start as start", "n")
        return (rows(streams.counts(events, "ts", "1 day", None, "event_type"), "tumbling", "event_type")
                .unionByName(rows(streams.counts(events, "ts", "1 day", "12 hours", "event_type"), "sliding", "event_type"))
                .unionByName(rows(streams.sessions(events, "ts", "12 hours", "user_id"), "session", "user_id")))
    closed = streams.closed_windows(events_stream(spark, sf_dir), "ts", "1 day", build, "counts")
    return closed.selectExpr("kind", "event_type", "cast(start as date) as start_day", "hour(start) as start_hour", "n")


RECEIVED = "ts + make_interval(0, 0, 0, cast(case when event_id % 10 = 3 then 2 else 0 end as int), cast(event_id % 5 as int), 0, 0)"
ARRIVALS = ["2024-01-05", "2024-01-12", "2024-01-19"]  # a batch of the stream ends at each of these days, the last one after them
SLICE = " + ".join(f"cast(received >= timestamp '{d} 00:00:00' as int)" for d in ARRIVALS)


@query("late_messages", f"""
    with e as (select *, ts + to_days(case when event_id % 10 = 3 then 2 else 0 end) + to_hours(event_id % 5) as received from events),
    s as (select *, {SLICE} as slice from e),
    m as (select x.slice, (select max(ts) from s y where y.slice < x.slice) - interval 12 hours as mark from (select distinct slice from s) x),
    t as (select s.*, coalesce(date_trunc('day', ts) + interval 1 day <= mark, false) as is_late from s join m using (slice))
    select user_id, arg_max(value, (received, event_id)) as value, strftime(max(received), '%Y-%m-%d %H:%M') as last_received, count(*) filter (is_late) as late,
      count(distinct date_trunc('day', ts)) filter (not is_late) as days from t group by 1""")
def late_messages(spark, sf_dir):
    """Events land in four batches by arrival; what comes after its day was closed goes to the side table."""
    landing = new_path(spark, "arrivals")
    source = Registry(spark, sf_dir).table("events").selectExpr("event_id", f"{TS} as ts", "user_id", "value").selectExpr("*", f"{RECEIVED} as received")
    split = streams.LateSplit(spark, "ts", "12 hours", "1 day")
    for k in range(len(ARRIVALS) + 1):
        source.where(f"{SLICE} = {k}").write.mode("append").parquet(landing)
        split.run(spark.readStream.schema(source.schema).parquet(landing))
    on_time, late = split.on_time(), split.late()
    known = streams.last_known(on_time.unionByName(late), "user_id", "received", "value")
    n_late = late.groupBy("user_id").agg(F.count("*").alias("late"))
    days = on_time.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"))
    return known.join(n_late, "user_id", "left").join(days, "user_id", "left").selectExpr(
        "user_id", "value", "date_format(last_received, 'yyyy-MM-dd HH:mm') as last_received", "coalesce(late, 0) as late", "coalesce(days, 0) as days")


@query("stream_lookup", with_ctes("fx_observation loinc", """
    select obs_id, identifier_code, label as identifier_label, coalesce(suppress, false) as suppress from fx_observation left join loinc on identifier_code = code"""))
def stream_lookup(spark, sf_dir):
    stream = Registry.project(streams.read_table(spark, sf_dir, "events.parquet"), OBSERVATION).select("obs_id", "identifier_code")
    table = C.loinc_table(spark).selectExpr("code as identifier_code", "label as identifier_label", "suppress")
    rows = streams.run_to_files(streams.lookup(stream, table, "identifier_code"), "lookup")
    return rows.selectExpr("obs_id", "identifier_code", "identifier_label", "coalesce(suppress, false) as suppress")
