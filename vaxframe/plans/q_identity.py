"""Queries for code mapping, matching, identity, upsert and delete."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acceptance, codemap, identity, respond, rules, upsert
from ..functions import codes as C
from ..sources import files
from ..sources.scratch import new_path, stage
from .catalog import query
from .fixtures import PATIENT, VACCINATION, Registry, with_ctes
from .q_messages import DATE, FULL, LENIENT, ORDER_CTES, validation

CUT = "1999-01-01"
VACC_KEYS = "vr_link, part_id, facility_id, tie_price"
VID = "cast(vr_id as string) || '/' || cast(part_id as string) || '/' || cast(facility_id as string) || '/' || cast(tie_price as string)"
VORD = "concat(lpad(cast(vr_id as string), 19, '0'), '/', part_id, '/', facility_id, '/', tie_price)"

# ------------------------------------------------------------- code mapping


PERIOD = {"valid_from": "case when length(value) % 4 = 1 then date '1997-01-01' end", "valid_to": "case when length(label) % 3 = 0 then date '1998-12-31' end"}
DATED = {"dated": "select *, " + ", ".join(f"{e} as {c}" for c, e in PERIOD.items()) + " from code"}


def dated_codes(spark, sf_dir):
    """The code table with validity dates, landed as files and read back."""
    path = new_path(spark, "codes")
    codes = Registry(spark, sf_dir).codes().selectExpr("*", *[f"{e} as {c}" for c, e in PERIOD.items()])
    columns = [x.split()[0] for x in files.CODE_SCHEMA.split(", ")]
    files.write_csv(codes.select(*columns), path)
    return files.read_codes(spark, path)


@query("scan_codes", with_ctes("code", """
    select codeset, status, count(*) as codes, count(new_value) as renamed, count(valid_from) as later, count(valid_to) as ended from dated group by 1, 2""", DATED))
def scan_codes(spark, sf_dir):
    return dated_codes(spark, sf_dir).groupBy("codeset", "status").agg(
        F.count("*").alias("codes"), F.count("new_value").alias("renamed"), F.count("valid_from").alias("later"), F.count("valid_to").alias("ended"))


@query("code_as_of", with_ctes("fx_vaccination code", f"""
    select {VACC_KEYS}, c.label as cvx_label, n.label as ndc_label from fx_vaccination v
    left join dated c on c.codeset = 'VACCINATION_CVX_CODE' and c.value = cvx and coalesce(c.valid_from <= administered_date, true) and coalesce(administered_date <= c.valid_to, true)
    left join dated n on n.codeset = 'VACCINATION_NDC_CODE' and n.value = ndc and coalesce(n.valid_from <= administered_date, true) and coalesce(administered_date <= n.valid_to, true)""", DATED))
def code_as_of(spark, sf_dir):
    """Codes as they were valid on the day of the dose."""
    rows, codes = Registry(spark, sf_dir).vaccinations(), dated_codes(spark, sf_dir)
    rows = C.lookup_on(rows, codes, "VACCINATION_CVX_CODE", "cvx", "cvx", "administered_date", ("label",))
    rows = C.lookup_on(rows, codes, "VACCINATION_NDC_CODE", "ndc", "ndc", "administered_date", ("label",))
    return rows.select(*VACC_KEYS.split(", "), "cvx_label", "ndc_label")


@query("code_lookup", with_ctes("fx_vaccination code", f"""
    select {VACC_KEYS}, m.label as mvx_label, i.label as info_label, r.label as route_label from fx_vaccination
    left join code m on m.codeset = 'VACCINATION_MANUFACTURER_CODE' and m.value = mvx
    left join code i on i.codeset = 'VACCINATION_INFORMATION_SOURCE' and i.value = info_source
    left join code r on r.codeset = 'BODY_ROUTE' and r.value = body_route"""))
def code_lookup(spark, sf_dir):
    r = Registry(spark, sf_dir)
    out, codes = r.vaccinations(), r.codes()
    for codeset, column, prefix in (("VACCINATION_MANUFACTURER_CODE", "mvx", "mvx"), ("VACCINATION_INFORMATION_SOURCE", "info_source", "info"),
                                    ("BODY_ROUTE", "body_route", "route")):
        out = C.lookup(out, codes, codeset, column, prefix, ("label",))
    return out.selectExpr(*VACC_KEYS.split(", "), "mvx_label", "info_label", "route_label")


@query("ndc_replace", with_ctes("fx_vaccination code", f"""
    select {VACC_KEYS}, ndc, value is not null as ndc_known, coalesce(new_value, ndc) as ndc_final from fx_vaccination
    left join code on codeset = 'VACCINATION_NDC_CODE' and value = ndc"""))
def ndc_replace(spark, sf_dir):
    r = Registry(spark, sf_dir)
    return codemap.replace_deprecated(r.vaccinations(), r.codes(), "VACCINATION_NDC_CODE", "ndc").selectExpr(
        *VACC_KEYS.split(", "), "ndc", "ndc_known", "ndc_final")


SENT = "case when facility_id % 3 = 0 then '' else cvx end"


@query("resolve_cvx", with_ctes("fx_vaccination code code_rel", f"""
    select {VACC_KEYS}, coalesce(nullif(sent, ''), case when n.value is not null then nr.to_cvx end, case when c.value is not null then cr.to_cvx end, '') as cvx,
      case when sent <> '' then 'CVX' when n.value is not null and nr.to_cvx is not null then 'NDC' when c.value is not null and cr.to_cvx is not null then 'CPT' else '' end as cvx_source,
      coalesce(sent <> '' and n.value is not null and sent <> nr.to_cvx, false) as ndc_differs,
      coalesce(c.value is not null and coalesce(nullif(sent, ''), case when n.value is not null then nr.to_cvx end) <> cr.to_cvx, false) as cpt_differs
    from (select *, {SENT} as sent from fx_vaccination) v
    left join code n on n.codeset = 'VACCINATION_NDC_CODE' and n.value = ndc
    left join code_rel nr on nr.from_set = 'VACCINATION_NDC_CODE' and nr.from_value = ndc
    left join code c on c.codeset = 'VACCINATION_CPT_CODE' and c.value = cpt
    left join code_rel cr on cr.from_set = 'VACCINATION_CPT_CODE' and cr.from_value = cpt"""))
def resolve_cvx(spark, sf_dir):
    r = Registry(spark, sf_dir)
    rows = r.vaccinations().selectExpr("*", f"{SENT} as cvx_sent").drop("cvx")
    return codemap.resolve_cvx(rows, r.codes(), r.relations()).selectExpr(
        *VACC_KEYS.split(", "), "cvx", "cvx_source", "ndc_differs", "cpt_differs")


@query("loinc_visible", with_ctes("fx_observation loinc", """
    select obs_id, patient_id, identifier_code, label as identifier_label, identifier_code in ('TPG_PAND', 'TPG_POP_GRP', 'TPG_TIER') as priority_group
    from fx_observation left join loinc on identifier_code = code where not coalesce(suppress, false)"""))
def loinc_visible(spark, sf_dir):
    rows = Registry(spark, sf_dir).observations()
    return codemap.loinc_visible(rows, C.loinc_table(spark)).select(
        "obs_id", "patient_id", "identifier_code", "identifier_label", "priority_group")


# ---------------------------------------------------------------- matching

P1 = "select org_id as o, mrn as m, min(patient_id) as patient_id from fx_patient group by 1, 2"


@query("match_mrn", with_ctes("fx_query fx_patient", f"""
    select query_id, patient_id from fx_query left join ({P1}) p on q_org = o and q_mrn = m"""))
def match_mrn(spark, sf_dir):
    r = Registry(spark, sf_dir)
    return identity.match_by_mrn(r.queries(), r.patients()).selectExpr("query_id", "mrn_hit.patient_id as patient_id")


P2 = ("select org_id as o, birth_date as b, name_last as l, name_first as f, min(patient_id) as patient_id from fx_patient group by 1, 2, 3, 4")


@query("match_demographics", with_ctes("fx_query fx_patient", f"""
    select query_id, patient_id from fx_query left join ({P2}) p on q_org = o and q_birth = b and q_last = l and q_first = f"""))
def match_demographics(spark, sf_dir):
    r = Registry(spark, sf_dir)
    return identity.match_by_demographics(r.queries(), r.patients()).selectExpr("query_id", "demo_hit.patient_id as patient_id")


MATCH_CTES = {
    "cand": f"""select q.*, q_last <> '' and q_first <> '' as complete,
        case when q_last <> '' and q_first <> '' then coalesce(a.patient_id, d.patient_id) else a.patient_id end as cand_id
        from fx_query q left join ({P1}) a on q_org = a.o and q_mrn = a.m
        left join ({P2}) d on q_org = d.o and q_birth = d.b and q_last = d.l and q_first = d.f""",
    "scored": """select c.*, case when complete and cand_id is not null then cast(
        (case when q_last <> '' and lower(q_last) = lower(name_last) then 2 else 0 end) + (case when q_first <> '' and lower(q_first) = lower(name_first) then 2 else 0 end)
        + (case when q_middle <> '' and lower(q_middle) = lower(name_middle) then 2 else 0 end) + (case when q_sex <> '' and lower(q_sex) = lower(sex) then 2 else 0 end)
        + (case when q_birth = birth_date then 2 else 0 end) as int) end as points from cand c left join fx_patient p on c.cand_id = p.patient_id""",
    "matched": "select *, case when not complete or points >= 6 then cand_id end as patient_id from scored",
}


@query("match_score", with_ctes("fx_query fx_patient", "select query_id, complete, points, patient_id from matched", MATCH_CTES))
def match_score(spark, sf_dir):
    r = Registry(spark, sf_dir)
    return identity.match_queries(r.queries(), r.patients()).selectExpr("query_id", "complete", "points", "hit.patient_id as patient_id")


POSSIBLE_CTES = {
    **MATCH_CTES,
    "pairs": """select distinct m.query_id, p.patient_id, p.reported_date from matched m join fx_patient p on m.q_org = p.org_id and m.q_birth = p.birth_date
        and (m.q_last = p.name_last or m.q_first = p.name_first) where m.patient_id is null and m.complete""",
}


@query("possible_matches", with_ctes("fx_query fx_patient", """
    select m.query_id, coalesce(possible, 0) as possible, coalesce(possible, 0) > cap as too_many, pairs.patient_id
    from (select query_id, least(20, coalesce(try_cast(rcp as int), 20)) as cap from matched where patient_id is null and complete) m
    left join (select query_id, count(*) as possible from pairs group by 1) n on m.query_id = n.query_id
    left join pairs on pairs.query_id = m.query_id and possible <= cap""", POSSIBLE_CTES))
def possible_matches(spark, sf_dir):
    r = Registry(spark, sf_dir)
    matched = identity.match_queries(r.queries(), r.patients())
    counted = identity.possible_counts(matched.where("hit is null and complete"), r.patients())
    return identity.possible_report(counted, r.patients(), respond.result_cap("rcp"))


# ------------------------------------------------------------------ linkage

LINK_SQL = f"""
    with old as (select * from fx_patient where reported_date < date '{CUT}'),
    batch as (select org_id, mrn, concat('N', patient_id % 150) as name_last, name_first, birth_date, patient_id as arrival from fx_patient),
    masters as (select patient_id as master_id, name_last, name_first, birth_date from old union all
                select 1000000 + patient_id, concat('N', patient_id % 90), name_first, birth_date from old where patient_id % 2 = 0),
    placed as (select b.*, (select min(patient_id) from old where old.org_id = b.org_id and old.mrn = b.mrn and old.patient_id % 3 = 0) as known,
        (select min(master_id) from masters m where m.name_last = b.name_last and m.name_first = b.name_first and m.birth_date = b.birth_date) as exact_m,
        (select min(master_id) from masters m where m.name_last = b.name_last and m.name_first = b.name_first) as named_m from batch b),
    made as (select *, known is null and named_m is null as unplaced, min(case when known is null and named_m is null then arrival end) over (partition by name_first, name_last) as maker from placed),
    birthed as (select m.*, k.birth_date as maker_birth from made m left join batch k on m.maker = k.arrival)
    select org_id, mrn, coalesce(known, exact_m, named_m) as master_id, case when unplaced then maker end as new_master,
      cast(case when known is not null then null when exact_m is not null then 2 when named_m is not null then 1 when maker = arrival then null
           when maker_birth = birth_date then 2 else 1 end as int) as confidence, 'N000' as soundex_last, 'F000' as soundex_first from birthed"""


LINKED = "select * from (" + LINK_SQL.strip() + ") t"


def linked_patients(spark, sf_dir):
    r = Registry(spark, sf_dir)
    old = r.patients().where(f"reported_date < date '{CUT}'")
    masters = old.selectExpr("patient_id as master_id", "name_last", "name_first", "birth_date").unionByName(
        old.where("patient_id % 2 = 0").selectExpr("1000000 + patient_id as master_id", "concat('N', patient_id % 90) as name_last",
                                                   "name_first", "birth_date"))
    reports = old.where("patient_id % 3 = 0").selectExpr("org_id", "mrn", "patient_id as master_id")
    batch = r.patients().selectExpr("org_id", "mrn", "concat('N', patient_id % 150) as name_last", "name_first", "birth_date",
                                    "patient_id as arrival")
    return identity.link_patients(batch, reports, masters)


@query("link_patients", with_ctes("fx_patient", LINKED))
def link_patients(spark, sf_dir):
    return linked_patients(spark, sf_dir).select("org_id", "mrn", "master_id", "new_master", "confidence", "soundex_last", "soundex_first")


@query("patient_links", with_ctes("fx_patient", f"select org_id, mrn, master_id, new_master, confidence from ({LINKED}) l where confidence is not null"))
def patient_links(spark, sf_dir):
    return identity.patient_links(linked_patients(spark, sf_dir))


@query("match_vaccination", with_ctes("fx_vaccination", f"""
    select b.{VACC_KEYS.replace(', ', ', b.')}, r.report_id from fx_vaccination b left join
    (select patient_id, vr_link, min(vr_id) as report_id from fx_vaccination where administered_date < date '{CUT}' group by 1, 2) r
    on b.patient_id = r.patient_id and b.vr_link = r.vr_link"""))
def match_vaccination(spark, sf_dir):
    rows = Registry(spark, sf_dir).vaccinations()
    out = identity.match_vaccination(rows, rows.where(f"administered_date < date '{CUT}'"))
    return out.selectExpr(*VACC_KEYS.split(", "), "report_id")


LOT = "case when facility_id % 4 = 0 then '' else lot end"
NEAR = "date_trunc('month', administered_date)"


@query("dedup_vaccinations", with_ctes("fx_vaccination", f"""
    select ord, case when lot is null or n0 < f then m0 else f end as master_id from (
      select ord, nullif(lot, '') as lot, min(ord) over (partition by patient_id, part_mod, month_no, info_source) as m0,
        min(case when nullif(lot, '') is null then ord end) over (partition by patient_id, part_mod, month_no, info_source) as n0,
        min(ord) over (partition by patient_id, part_mod, month_no, info_source, nullif(lot, '')) as f
      from (select *, {VORD} as ord, {LOT} as lot, part_id % 2 as part_mod, year(administered_date) as month_no from fx_vaccination) v) t"""
    .replace("select *, concat", "select patient_id, info_source, part_id, facility_id, administered_date, concat")))
def dedup_vaccinations(spark, sf_dir):
    rows = Registry(spark, sf_dir).vaccinations().selectExpr(
        "patient_id", "info_source", f"{VORD} as ord", f"{LOT} as lot", "part_id % 2 as part_mod", "year(administered_date) as month_no")
    out = identity.dedup_vaccinations(rows, ("patient_id", "part_mod", "month_no", "info_source"), "lot", "ord")
    return out.select("ord", "master_id")


REACHED = """(select * from (select *, coalesce(bool_or(failed) over (partition by msg_id order by k rows between unbounded preceding and 1 preceding), false) as gone,
    coalesce(code1 = '' or vr_link = '' or adm is null or adm > date '2002-01-01' or cvx = '' or not cvx_known or (f_pear and facility_code <> '' and not loc_known), false) as early
    from dose_fail) t where not gone and live and not early)"""


@query("upsert_locations", with_ctes(FULL, f"""
    select org_id, facility_code, '' as city, '' as state, false as created from fx_location union all
    select org_id, facility_code, arg_min(facility_city, msg_id * 100 + k), 'MI', true from {REACHED} r
    where facility_code <> '' and not exists (select 1 from fx_location l where l.org_id = r.org_id and l.facility_code = r.facility_code) group by 1, 2""", ORDER_CTES))
def upsert_locations(spark, sf_dir):
    existing = Registry(spark, sf_dir).locations().selectExpr("org_id", "facility_code", "'' as city", "'' as state")
    rows = acceptance.reached_location(validation(spark, sf_dir).doses).where("facility_code <> ''").selectExpr(
        "org_id", "facility_code", "facility_city as city", "facility_state as state", "msg_id", "order_no")
    return identity.get_or_create(existing, rows, ["org_id", "facility_code"], "struct(msg_id, order_no)")


@query("upsert_providers", with_ctes(FULL, f"""
    select org_id, provider_code as person_link, arg_min(provider_last, (received_date >= date '{CUT}', msg_id * 100 + k)) as name_last, 'First' as name_first, 'M' as name_middle,
      min(received_date) >= date '{CUT}' as created
    from {REACHED} r where provider_code <> '' group by 1, 2""", ORDER_CTES))
def upsert_providers(spark, sf_dir):
    rows = acceptance.reached_location(validation(spark, sf_dir).doses).where("provider_link <> ''").selectExpr(
        "org_id", "provider_link as person_link", "provider_last as name_last", "provider_first as name_first",
        "provider_middle as name_middle", "received_date", "msg_id", "order_no")
    rows = stage(rows, "providers")
    empty = rows.select("org_id", "person_link", "name_last", "name_first", "name_middle").limit(0)
    return in_two(rows, empty, lambda old, new: identity.get_or_create(old.drop("created"), new, ["org_id", "person_link"], "struct(msg_id, order_no)"))


@query("match_observation", with_ctes("fx_observation", """
    select b.obs_id, r.master_obs from fx_observation b left join
    (select patient_id, vaccination_ref, identifier_code, min(obs_id) as master_obs from fx_observation where observation_date < date '2024-01-15' group by 1, 2, 3) r
    on b.patient_id = r.patient_id and b.vaccination_ref is not distinct from r.vaccination_ref and b.identifier_code = r.identifier_code"""))
def match_observation(spark, sf_dir):
    rows = Registry(spark, sf_dir).observations()
    return identity.match_observation(rows, rows.where("observation_date < date '2024-01-15'")).select("obs_id", "master_obs")


_SYMS = " || ".join(f"substr('{identity.ID_SYMBOLS}', cast(concat('0x', substr(d, {1 + 4 * i}, 4)) as int) % 33 + 1, 1)" for i in range(12))


@query("assign_ids", with_ctes("fx_patient", f"""
    select org_id, mrn, {_SYMS} as patient_link from (select org_id, mrn, sha256(concat(org_id, '|', mrn, '|', 0)) as d from fx_patient) t"""))
def assign_ids(spark, sf_dir):
    rows = Registry(spark, sf_dir).patients().select("org_id", "mrn")
    return identity.assign_patient_link(rows)


@query("report_links", with_ctes("fx_patient", """
    select patient_id, min(patient_id) over w as master_id, count(*) over w as n_reports, min(patient_id) over w as first_report
    from fx_patient window w as (partition by name_last, name_first)"""))
def report_links(spark, sf_dir):
    people = Registry(spark, sf_dir).patients().select("patient_id", "name_last", "name_first")
    masters = people.groupBy("name_last", "name_first").agg(F.min("patient_id").alias("master_id"))
    return identity.report_links(people.join(masters, ["name_last", "name_first"]))


WANTED = "concat(user_id, '.', 1 + event_id % 7)"


@query("read_by_link", with_ctes("fx_vaccination", f"""
    select {VACC_KEYS}, cvx, administered_date, s_name as facility_name from fx_vaccination left join supplier on facility_id = s_suppkey
    where vr_link in (select {WANTED} from events)"""))
def read_by_link(spark, sf_dir):
    r = Registry(spark, sf_dir)
    wanted = r.table("events").selectExpr(f"{WANTED} as vr_link")
    places = r.table("supplier").selectExpr("s_suppkey as facility_id", "s_name as facility_name")
    return identity.read_by_link(r.vaccinations(), wanted, places).selectExpr(*VACC_KEYS.split(", "), "cvx", "administered_date", "facility_name")


# ------------------------------------------------------------------- upsert


def in_two(batch, empty, job):
    """The registry of the messages before the cut-off, then with the others merged into it."""
    stored = stage(job(empty, batch.where(f"received_date < date '{CUT}'")), "stored")
    return job(stored, batch.where(f"received_date >= date '{CUT}'"))


def accepted_doses(spark, sf_dir):
    kept = ["org_id", "mrn", "vr_link", *upsert.DOSE, "body_route", "body_site", "has_rxr", "received_date", "msg_id", "order_no"]
    v = validation(spark, sf_dir).stage_orders(*kept)
    rows = upsert.dose_batch(acceptance.accepted_prefix(v.doses), v.observations)
    return rows.select(*kept, "funding_eligibility", "funding_source")


REG_PID = {c: PATIENT.get(c, "''") for c in upsert.PID} | {"death_date": "cast(null as date)"}
REG_OLD = {"publicity_ind": "'01'", "publicity_date": "cast(null as date)", "protection_ind": "'Y'", "protection_date": "date '1990-01-01'",
           "registry_status": "'I'", "registry_date": "cast(null as date)"}
PICKED = ["name_last", "name_middle", "birth_date", "sex", "state", "phone", "protection_ind", "protection_date", "registry_status",
          "guardian_last", "guardian_relationship", "reported_date", "updated_date"]
HEAD_OK = f"""select f.*, case when f_cantaloupe then {LENIENT('birth_text')} else {DATE('birth_text')} end as birth_date,
    case when f_cantaloupe then {LENIENT('protection_text')} else {DATE('protection_text')} end as protection_date,
    g.nk_last as guardian_last, g.relationship as guardian_relationship,
    case when phone_use = 'PRN' then concat(phone_area, phone_local) else '' end as phone
    from fxf f left join (select fxn.msg_id, nk_last, relationship from fxn join nk on fxn.msg_id = nk.msg_id and fxn.k = nk.pick) g on f.msg_id = g.msg_id
    where eff_type in ('VXU', 'ORU') and f.msg_id not in (select msg_id from head where severity = 'E')"""


@query("upsert_patients", with_ctes(FULL + " fx_patient", """
    select coalesce(o.org_id, n.org_id) as org_id, coalesce(o.mrn, n.mrn) as mrn,
      coalesce(n.name_last, o.name_last) as name_last, case when n.mrn is null then coalesce(o.name_middle, '') else n.name_middle end as name_middle,
      case when n.mrn is null then o.birth_date else n.birth_date end as birth_date,
      coalesce(n.sex, o.sex) as sex, coalesce(n.state, o.state) as state, coalesce(n.phone, o.phone) as phone,
      case when p_any then 'N' when o.mrn is not null then 'Y' end as protection_ind,
      case when p_any then p_date when o.mrn is not null then date '1990-01-01' end as protection_date,
      case when p_any then 'A' when o.mrn is not null then 'I' end as registry_status,
      coalesce(g_last, o.guardian_last) as guardian_last, coalesce(g_rel, o.guardian_relationship) as guardian_relationship,
      coalesce(o.reported_date, first_date) as reported_date, greatest(last_date, o.reported_date) as updated_date
    from fx_patient o full join (
      select org_id, mrn, min(received_date) as first_date, max(received_date) as last_date, coalesce(bool_or(has_pd1), false) as p_any,
        arg_max(name_last, ord) as name_last, arg_max(name_middle, ord) as name_middle, arg_max(birth_date, ord) as birth_date, arg_max(sex, ord) as sex,
        arg_max(state, ord) as state, arg_max(phone, ord) as phone,
        arg_max_null(protection_date, ord) filter (has_pd1) as p_date, arg_max(guardian_last, ord) filter (guardian_last is not null) as g_last,
        arg_max(guardian_relationship, ord) filter (guardian_last is not null) as g_rel
      from (select *, (received_date, msg_id) as ord from head_ok) h group by org_id, mrn) n on o.org_id = n.org_id and o.mrn = n.mrn""",
    {**ORDER_CTES, "head_ok": HEAD_OK}))
def upsert_patients(spark, sf_dir):
    r = Registry(spark, sf_dir)
    old = r.table("customer").selectExpr(
        f"{PATIENT['org_id']} as org_id", f"{PATIENT['mrn']} as mrn", *[f"coalesce({e}, '') as {c}" if c not in ("birth_date", "death_date") else f"{e} as {c}"
                                                                        for c, e in REG_PID.items()],
        *[f"{e} as {c}" for c, e in REG_OLD.items()], *[f"{PATIENT.get(c, chr(39) * 2)} as {c}" for c in upsert.NK1],
        f"{PATIENT['reported_date']} as reported_date", f"{PATIENT['reported_date']} as updated_date")
    batch = validation(spark, sf_dir).accepted
    return upsert.upsert_patients(old, batch).select("org_id", "mrn", *PICKED)


@query("upsert_vaccinations", with_ctes(FULL, f"""
    select org_id, mrn, vr_link, arg_max(cvx, ord) as cvx, arg_max(ndc_final, ord) as ndc_final, arg_max(adm, ord) as administered_date,
      arg_max(lot, ord) as lot, arg_max(completion_status, ord) as completion_status,
      arg_max(body_route, ord) filter (has_rxr) as body_route, arg_max(elig, ord) filter (elig is not null) as funding_eligibility,
      arg_max(fund, ord) filter (fund is not null) as funding_source, min(received_date) as reported_date, max(received_date) as updated_date
    from (select d.*, e.elig, e.fund, (d.received_date, d.msg_id, d.k) as ord from
        (select *, not bool_or(failed) over (partition by msg_id order by k) as accepted from dose_fail) d left join
        (select msg_id, k, arg_max(value_code, j) filter (identifier_code = '64994-7' and value_code in (select value from code where codeset = 'FINANCIAL_STATUS_CODE')) as elig,
           arg_max(value_code, j) filter (identifier_code = '30963-3' and value_code in (select value from code where codeset = 'VACCINATION_FUNDING_SOURCE')) as fund
         from fxx group by 1, 2) e on d.msg_id = e.msg_id and d.k = e.k
      where accepted and live) t group by 1, 2, 3""", ORDER_CTES))
def upsert_vaccinations(spark, sf_dir):
    batch = stage(accepted_doses(spark, sf_dir), "doses")
    keys = ["org_id", "mrn", "vr_link"]
    return in_two(batch, upsert.empty_registry(spark, batch, keys, upsert.DOSE_GROUPS), upsert.upsert_vaccinations).select(
        *keys, "cvx", "ndc_final", "administered_date", "lot", "completion_status", "body_route", "funding_eligibility",
        "funding_source", "reported_date", "updated_date")


@query("vaccination_masters", with_ctes(FULL, f"""
    select org_id, master_id, min(created) as created, count(distinct vr_link) as reports, arg_max(cvx, (fresh, ord)) as cvx, arg_max(administered_date, (fresh, ord)) as administered_date,
      arg_max(vr_link, (fresh, ord)) as last_report from (
      select d.org_id, d.mrn, d.vr_link, d.cvx, d.adm as administered_date, (d.received_date, d.msg_id, d.k) as ord, d.received_date >= date '{CUT}' as fresh,
        coalesce(l.master_id, concat(d.org_id, '/', d.mrn, '/', d.vr_link)) as master_id, l.master_id is null as created
      from (select *, not bool_or(failed) over (partition by msg_id order by k) as accepted from dose_fail) d left join linked l using (org_id, mrn, vr_link) where accepted and live
        and (d.received_date >= date '{CUT}' or (d.received_date, d.msg_id, d.k) = l.last)) t group by 1, 2""",
    {**ORDER_CTES, "linked": f"""select org_id, mrn, vr_link, last, concat(org_id, '/', mrn, '/', min(vr_link) over (partition by org_id, mrn, cvx)) as master_id from (
        select org_id, mrn, vr_link, arg_max(cvx, (received_date, msg_id, k)) as cvx, max((received_date, msg_id, k)) as last
        from (select *, not bool_or(failed) over (partition by msg_id order by k) as accepted from dose_fail) d where accepted and live and received_date < date '{CUT}' group by 1, 2, 3) o"""}))
def vaccination_masters(spark, sf_dir):
    """Stored reports of a patient and code share a master; the messages after the cut-off change reports and masters."""
    keys = ["org_id", "mrn", "vr_link"]
    batch = stage(accepted_doses(spark, sf_dir), "doses")
    old = batch.where(f"received_date < date '{CUT}'")
    stored = old.groupBy(*keys).agg(F.expr("max_by(struct(cvx, administered_date, struct(received_date, msg_id, order_no) as ord), struct(received_date, msg_id, order_no)) as r"))
    stored = stored.selectExpr(*keys, "r.*")
    shared = stored.groupBy("org_id", "mrn", "cvx").agg(F.min("vr_link").alias("first"))
    links = stage(stored.join(shared, ["org_id", "mrn", "cvx"]).selectExpr(*keys, "cvx", "administered_date", "ord", "concat(org_id, '/', mrn, '/', first) as master_id"), "links")
    masters = links.groupBy("org_id", "mrn", "master_id").agg(F.expr("max_by(struct(cvx, administered_date, vr_link as last_report), ord) as r")).selectExpr("org_id", "mrn", "master_id", "r.*")
    after, linked = upsert.vaccination_masters(masters, links.select(*keys, "master_id"), batch.where(f"received_date >= date '{CUT}'"))
    counts = linked.groupBy("master_id").agg(F.count("*").alias("reports"))
    return after.join(counts, "master_id").select("org_id", "master_id", "created", "reports", "cvx", "administered_date", "last_report")


@query("upsert_observations", with_ctes(FULL, f"""
    select org_id, mrn, case when is_dose then vr_link else '' end as vr_link, identifier_code, arg_max(value_code, ord) as value_code,
      arg_max_null(od, ord) as observation_date, min(received_date) as reported_date, max(received_date) as updated_date
    from (select *, (received_date, msg_id, obx_no) as ord, case when f_cantaloupe then {LENIENT('obs_text')} else {DATE('obs_text')} end as od from obx
      where not exists (select 1 from (select msg_id, k from dose_fail where failed union all select msg_id, k from oru_order where not has_obr) x where x.msg_id = obx.msg_id and x.k < obx.k)) t
    group by 1, 2, 3, 4""", ORDER_CTES))
def upsert_observations(spark, sf_dir):
    v = validation(spark, sf_dir)
    keys = ["org_id", "mrn", "vr_link", "identifier_code"]
    batch = v.observations.selectExpr("*", "case when is_dose then vr_link else '' end as link").drop("vr_link").withColumnRenamed("link", "vr_link")
    batch = stage(batch.select(*keys, *upsert.OBSERVATION, "received_date", "msg_id", "obx_no"), "observed")
    return in_two(batch, upsert.empty_registry(spark, batch, keys, upsert.OBSERVATION_GROUPS), upsert.upsert_observations).select(*keys, "value_code", "observation_date", "reported_date", "updated_date")


@query("delete_vaccinations", with_ctes("fx_vaccination", f"""
    with base as (select patient_id, cvx, administered_date, info_source, vr_link, {VORD} as ord from fx_vaccination),
    linked as (select *, min(ord) over (partition by patient_id, cvx, administered_date, info_source) as master_id from base),
    kept as (select * from linked where vr_link not in (select {WANTED} from events))
    select 'report' as kind, count(*) as rows_left, count(distinct master_id) as masters from kept union all
    select 'master', count(*), count(distinct master_id) from (select distinct master_id from kept) t""".replace("with base", "select * from (with base", 1) + ") t"))
def delete_vaccinations(spark, sf_dir):
    r = Registry(spark, sf_dir)
    rows = r.vaccinations().selectExpr("patient_id", "cvx", "administered_date", "info_source", "vr_link", f"{VORD} as ord", "'' as lot")
    # the dedup feeds both tallies: it is written once
    linked = stage(identity.dedup_vaccinations(rows, order="ord").select("vr_link", "master_id"), "linked")
    wanted = r.table("events").selectExpr(f"{WANTED} as vr_link")
    reports, masters = upsert.delete_vaccinations(linked, linked.select("master_id").distinct(), wanted)
    def tally(df, kind):
        return df.select("master_id").groupBy().agg(F.count("*").alias("rows_left"), F.countDistinct("master_id").alias("masters")).selectExpr(
            f"'{kind}' as kind", "rows_left", "masters")
    return tally(reports, "report").unionByName(tally(masters, "master"))
