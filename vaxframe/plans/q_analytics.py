"""Queries for population analytics."""

from __future__ import annotations


from ..functions import codes as C
from ..operators import analytics, feeds
from .catalog import query
from .fixtures import Registry, with_ctes
from .q_feeds import MX, MY
from .q_identity import VORD

AS_OF = "date '2002-01-01'"
SALT = "pepper"
GIVEN = {"given": "select v.*, family from fx_vaccination v join family on v.cvx = family.cvx where action_code <> 'D' and completion_status <> 'RE'"}


def given(spark, sf_dir):
    return Registry(spark, sf_dir).vaccinations().where("action_code <> 'D' and completion_status <> 'RE'")


def families(spark):
    return spark.sql(C.family_sql())


def schedule(spark):
    return spark.sql(C.schedule_sql())


@query("clearinghouse_dedup", with_ctes("fx_vaccination fx_patient", f"""
    select name_last, name_first, birth_date, administered_date, cvx, arg_max(vr_link, ord) as vr_link, arg_max(lot, ord) as lot, arg_max(patient_id, ord) as patient_id,
      count(*) as reports, count(distinct org_id) as orgs
    from (select v.*, {VORD} as ord, name_last, name_first, birth_date, org_id from fx_vaccination v join fx_patient p on v.patient_id = p.patient_id) t group by 1, 2, 3, 4, 5"""))
def clearinghouse_dedup(spark, sf_dir):
    r = Registry(spark, sf_dir)
    return analytics.clearinghouse_dedup(r.vaccinations(), r.patients(), VORD)


@query("deidentify", with_ctes("fx_vaccination fx_patient", f"""
    select sha256(concat('{SALT}', '|', org_id, '|', mrn)) as person_key, cast(year(birth_date) as int) as birth_year, left(zip, 3) as zip3, sex, cvx, administered_date, info_source, completion_status
    from fx_vaccination v join fx_patient p on v.patient_id = p.patient_id"""))
def deidentify(spark, sf_dir):
    r = Registry(spark, sf_dir)
    return analytics.deidentify(r.vaccinations(), r.patients(), SALT)


@query("first_dose", with_ctes("fx_vaccination family", """
    select patient_id, family, min(administered_date) as administered_date, arg_min(cvx, (administered_date, cvx)) as cvx from given group by 1, 2""", GIVEN))
def first_dose(spark, sf_dir):
    return analytics.first_dose(given(spark, sf_dir), families(spark))


@query("dose_intervals", with_ctes("fx_vaccination family schedule", """
    select d.patient_id, d.family, d.dose_no, administered_date, cvx, days, same_product, coalesce(days < min_days, false) as too_early from (
      select *, cast(row_number() over w as int) as dose_no, cast(administered_date - lag(administered_date) over w as int) as days, lag(cvx) over w = cvx as same_product
      from (select distinct patient_id, family, administered_date, cvx from given) t window w as (partition by patient_id, family order by administered_date, cvx)) d
    left join schedule s on s.family = d.family and s.dose_no = d.dose_no""", GIVEN))
def dose_intervals(spark, sf_dir):
    return analytics.dose_intervals(given(spark, sf_dir), families(spark), schedule(spark))


NEXT = """select g.patient_id, g.family, cast(n + 1 as int) as dose_no, last_date, cast(last_date + min_days as date) as valid_date, cast(last_date + due_days as date) as due_date, cast(last_date + overdue_days as date) as overdue_date
    from (select patient_id, family, count(distinct administered_date) as n, max(administered_date) as last_date from given where {} group by 1, 2) g join schedule s on s.family = g.family and s.dose_no = n + 1"""


@query("next_dose", with_ctes("fx_vaccination family schedule", NEXT.format("true"), GIVEN))
def next_dose(spark, sf_dir):
    return analytics.next_dose(given(spark, sf_dir), families(spark), schedule(spark))


@query("recall_list", with_ctes("fx_vaccination family schedule", f"""
    select patient_id, family, dose_no, due_date, overdue_date < {AS_OF} as overdue from ({NEXT.format("administered_date <= date '2000-01-01'")}) t where due_date < {AS_OF}
      and not exists (select 1 from given g where g.patient_id = t.patient_id and g.family = t.family and g.administered_date > date '2000-01-01' and g.administered_date <= {AS_OF})""", GIVEN))
def recall_list(spark, sf_dir):
    return analytics.recall_list(given(spark, sf_dir), families(spark), schedule(spark), "date '2000-01-01'", AS_OF)


SPAN = f"(cast({feeds.MAX_RESOLUTION / 2 ** 9!r} as double) * 256)"


@query("hotspots", with_ctes("fx_patient fx_org", f"""
    select region_name, x, y, n, round((n - mean) / sd, 6) as score from (select *, avg(n) over (partition by region_name) as mean, stddev_pop(n) over (partition by region_name) as sd from (
      select region_name, cast(floor(({MX} + {feeds.EXTENT}) / {SPAN}) as bigint) as x, cast(floor(({feeds.EXTENT} - {MY}) / {SPAN}) as bigint) as y, count(*) as n
      from fx_patient p join fx_org o on p.org_id = o.org_id group by 1, 2, 3) t) u where n > mean + 1.0 * sd"""))
def hotspots(spark, sf_dir):
    r = Registry(spark, sf_dir)
    points = r.patients().select("org_id", "lon", "lat").join(r.orgs().select("org_id", "region_name"), "org_id")
    return analytics.hotspots(points, 9, 1.0)


@query("average_efficacy", with_ctes("fx_vaccination fx_patient family", """
    select * from (select area, vacc, vacc_cases, others, other_cases, round(efficacy, 6) as efficacy from rated union all select null, null, null, null, null, round(avg(efficacy), 6) from rated) t""",
    {**GIVEN, "person": """select org_id as area, exists (select 1 from given g where g.patient_id = p.patient_id and g.cvx = '207') as vaccinated,
       exists (select 1 from events e where e.user_id = p.patient_id % 150 and e.event_type = 'error' and e.event_id % 9 = p.patient_id % 9) as is_case from fx_patient p""",
     "area": """select area, count(*) filter (vaccinated) as vacc, count(*) filter (vaccinated and is_case) as vacc_cases, count(*) filter (not vaccinated) as others,
       count(*) filter (not vaccinated and is_case) as other_cases from person group by 1""",
     "rated": "select *, case when vacc > 0 and other_cases > 0 then 1 - (vacc_cases / vacc) / (other_cases / others) end as efficacy from area"}))
def average_efficacy(spark, sf_dir):
    r = Registry(spark, sf_dir)
    shots = given(spark, sf_dir).where("cvx = '207'").select("patient_id").distinct().selectExpr("patient_id", "true as v")
    sick = r.table("events").where("event_type = 'error'").selectExpr("user_id as u", "event_id % 9 as e").distinct().selectExpr("*", "true as c")
    people = (r.patients().selectExpr("patient_id", "org_id as area", "patient_id % 150 as u", "patient_id % 9 as e")
              .join(shots, "patient_id", "left").join(sick, ["u", "e"], "left"))
    return analytics.average_efficacy(people.selectExpr("area", "coalesce(v, false) as vaccinated", "coalesce(c, false) as is_case"))


@query("inventory_balance", with_ctes("fx_movement", """
    select center, product, day, ordered, administered, wasted, cast(sum(ordered - administered - wasted) over w as bigint) as balance,
      round(sum(wasted) over w / nullif(sum(ordered) over w, 0), 6) as wastage
    from (select center, product, day, cast(coalesce(sum(qty) filter (kind = 'ordered'), 0) as bigint) as ordered, cast(coalesce(sum(qty) filter (kind = 'administered'), 0) as bigint) as administered,
      cast(coalesce(sum(qty) filter (kind = 'wasted'), 0) as bigint) as wasted from fx_movement group by 1, 2, 3) t window w as (partition by center, product order by day)"""))
def inventory_balance(spark, sf_dir):
    return analytics.inventory_balance(Registry(spark, sf_dir).movements())


@query("coverage", with_ctes("fx_vaccination fx_patient family", f"""
    select org_id, age_band, cast(grouping(org_id, age_band) as int) as level, count(*) as patients, count(*) filter (covered) as covered, round(100.0 * count(*) filter (covered) / count(*), 6) as pct
    from (select org_id, cast((year({AS_OF}) - year(birth_date)) // 10 * 10 as int) as age_band, coalesce(n, 0) >= 25 as covered from fx_patient p
      left join (select patient_id, count(distinct (administered_date, cvx)) as n from fx_vaccination where action_code <> 'D' and completion_status <> 'RE' group by 1) g on p.patient_id = g.patient_id) t
    group by rollup (org_id, age_band)"""))
def coverage(spark, sf_dir):
    return analytics.coverage(Registry(spark, sf_dir).patients(), given(spark, sf_dir), 25, AS_OF)


FIELDS = ["name_middle", "birth_date", "sex", "phone", "email", "state", "race", "ethnicity", "guardian_first"]


@query("field_completeness", with_ctes("fx_patient", " union all ".join(
    f"select org_id, '{c}' as column_name, count(*) filter (coalesce(cast({c} as string), '') <> '') as filled, "
    f"round(100.0 * count(*) filter (coalesce(cast({c} as string), '') <> '') / count(*), 6) as pct from fx_patient group by 1" for c in FIELDS)))
def field_completeness(spark, sf_dir):
    return analytics.field_completeness(Registry(spark, sf_dir).patients(), FIELDS)


@query("consolidated_record", with_ctes("fx_vaccination fx_patient", f"""
    select master_id, administered_date, cvx, arg_max(vr_link, ord) as vr_link, count(*) as reports, count(distinct org_id) as orgs
    from (select v.*, {VORD} as ord, org_id, master_id from fx_vaccination v join (select patient_id, org_id, min(patient_id) over (partition by name_first, name_last) as master_id from fx_patient) p
      on v.patient_id = p.patient_id) t group by 1, 2, 3"""))
def consolidated_record(spark, sf_dir):
    r = Registry(spark, sf_dir)
    return analytics.consolidated_record(r.vaccinations(), r.patients(), VORD)
