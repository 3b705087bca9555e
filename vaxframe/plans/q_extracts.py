"""Queries for nested extracts and FHIR ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity, interchange, rules
from .catalog import query
from .fixtures import Registry, with_ctes
from .q_identity import VACC_KEYS, VORD, _SYMS
from .q_response import HIST, rich_patients, shown_history

BASE = "https://registry.example.org/fhir"


def _j(name, expr):
    """JSON member text, '' when the value is NULL."""
    return f"""coalesce(',"{name}":' || {expr}, '')"""


def _s(expr):
    return f"""('"' || {expr} || '"')"""


GENDER = "case sex when 'F' then 'female' when 'M' then 'male' when 'O' then 'other' when 'U' then 'unknown' when 'X' then 'other' end"
PATIENT_JSON = f"""'{{"resourceType":"Patient","identifier":[{{"value":"' || patient_link || '","type":{{"coding":[{{"code":"MR"}}]}}}}],"name":[{{"family":"' || name_last
    || '","given":["' || name_first || '"' || coalesce(',"' || name_middle || '"', '') || ']}}],"birthDate":"' || cast(birth_date as string) || '"' || {_j('gender', _s('(' + GENDER + ')'))}
    || ',"address":[{{"line":["' || line1 || '"],"city":"' || city || '"' || {_j('state', _s("nullif(state, '')"))} || ',"postalCode":"' || zip || '","country":"USA","district":"' || county || '"}}]'
    || ',"telecom":[{{"system":"phone"' || {_j('value', _s("nullif(phone, '')"))} || '}}]'
    || case when birth_flag = 'N' then ',"multipleBirthBoolean":false' when birth_flag = 'Y' and try_cast(birth_order as int) is null then ',"multipleBirthBoolean":true' else '' end
    || case when birth_flag = 'Y' then {_j('multipleBirthInteger', "cast(try_cast(birth_order as int) as string)")} else '' end
    || case when guardian_relationship <> '' then ',"contact":[{{"relationship":[{{"coding":[{{"code":"' || guardian_relationship || '"}}]}}],"name":{{"family":"' || guardian_last || '","given":['
       || case when guardian_first <> '' then '"' || guardian_first || '"' else '' end || ']}}}}]' else '' end || '}}'"""
DOSE_JSON = f"""'{{"resourceType":"Immunization","occurrenceDateTime":"' || cast(administered_date as string) || '","vaccineCode":{{"coding":[{{"code":"' || s.cvx || '","display":"' || c.label || '","system":"CVX"}}'
    || case when n.value is not null then ',{{"code":"' || n.value || '","display":"' || n.label || '","system":"NDC"}}' else '' end || ']}},"doseQuantity":{{"value":' || amount || '}}'
    || case when info_source = '00' then ',"primarySource":true' when info_source <> '' then ',"primarySource":false' else '' end || ',"lotNumber":"' || lot || '"}}'"""
LINKED = {"people": f"select *, {_SYMS} as patient_link from (select *, sha256(concat(org_id, '|', mrn, '|', 0)) as d from fx_patient) p"}


@query("patient_bundle", with_ctes("fx_vaccination fx_patient code", f"""
    select patient_id, cast(page as int) as page, count(*) as entries, '{{"resourceType":"Bundle","entry":[' || string_agg('{{"resource":' || js || '}}', ',' order by seq) || ']}}' as bundle from (
      select patient_id, 0 as page, 0 as seq, {PATIENT_JSON} as js from people union all
      select patient_id, (seq - 1) // 1000, seq, {DOSE_JSON} from seqd s join code c on c.codeset = 'VACCINATION_CVX_CODE' and c.value = s.cvx
      left join code n on n.codeset = 'VACCINATION_NDC_CODE' and n.value = s.ndc) t group by 1, 2""", {**HIST, **LINKED}))
def patient_bundle(spark, sf_dir):
    r = Registry(spark, sf_dir)
    # the history's reports move as one value each, with every column that is named
    doses = shown_history(spark, sf_dir, ["ndc", "lot", "amount", "info_source", "action_code"]).selectExpr("*", "cast(null as date) as expiration_date")
    return interchange.patient_bundle(rich_patients(spark, sf_dir), doses, r.codes())


@query("registry_immunization", with_ctes("fx_vaccination fx_patient", f"""
    select {VACC_KEYS}, '{{"resourceType":"Immunization","id":"' || vr_link || '","recorded":"' || cast(v.reported_date as string) || '","lotNumber":"' || lot || '","occurrenceDateTime":"' || cast(administered_date as string)
      || '","doseQuantity":{{"value":' || cast(cast(amount as decimal(18,4)) as string) || '}}' || case when completion_status = 'CP' then ',"status":"completed"' when completion_status = 'RE' then ',"status":"not-done"' else '' end
      || case when refusal_code <> '' then ',"reasonCode":[{{"coding":[{{"code":"' || refusal_code || '"}}]}}]' else '' end || ',"vaccineCode":{{"coding":[{{"code":"' || cvx || '"}}]}},"patient":{{"reference":"{BASE}/Patient/' || mrn
      || '"}}' || coalesce(',"location":{{"id":"' || cast(s_suppkey as string) || '","name":"' || s_name || '"}}', '') || ',"extension":[{{"url":"#links","valueString":"{BASE}/MedicationAdministration/' || vr_link || '"}}]}}' as resource
    from fx_vaccination v join fx_patient p on v.patient_id = p.patient_id left join supplier on facility_id = s_suppkey"""))
def registry_immunization(spark, sf_dir):
    r = Registry(spark, sf_dir)
    places = r.table("supplier").selectExpr("s_suppkey as facility_id", "s_name as facility_name")
    rows = r.vaccinations().selectExpr("*", "vr_link as master_link")
    return interchange.registry_immunization(rows, r.patients(), places, BASE).selectExpr(*VACC_KEYS.split(", "), "resource")


ISSUER, NBF = "https://registry.example.org/issuer", 1009843200


@query("health_card_payload", with_ctes("fx_vaccination fx_patient code", f"""
    select s.patient_id, seq, '{{"iss":"{ISSUER}","nbf":{NBF},"vc":{{"@context":["https://www.w3.org/2018/credentials/v1"],"type":["VerifiableCredential","https://smarthealth.cards#health-card"],"credentialSubject":{{"fhirVersion":"4.0.1","fhirBundle":{{"resourceType":"Bundle","type":"collection","entry":[{{"fullUrl":"resource:0","resource":{{"resourceType":"Patient","gender":"'
      || case sex when 'F' then 'female' when 'M' then 'male' when 'U' then 'unknown' else 'other' end || '","birthDate":"' || cast(birth_date as string) || '","name":[{{"family":"' || name_last || '","given":["' || name_first || '"' || coalesce(',"' || name_middle || '"', '')
      || ']}}]}}}},{{"fullUrl":"resource:1","resource":{{"resourceType":"Immunization","status":"completed","vaccineCode":{{"coding":[{{"system":"http://hl7.org/fhir/sid/cvx","code":"' || cvx || '"}}]}},"patient":{{"reference":"resource:0"}},"occurrenceDateTime":"'
      || cast(administered_date as string) || '","lotNumber":"' || lot || '"}}}}]}}}}}}}}' as payload
    from seqd s join fx_patient p on s.patient_id = p.patient_id""", HIST))
def health_card_payload(spark, sf_dir):
    r = Registry(spark, sf_dir)
    return interchange.health_card_payload(r.patients(), shown_history(spark, sf_dir), ISSUER, NBF)


# ------------------------------------------------------------------- ingest

EVENT = {
    "link": "case when part_id % 97 = 0 then '' else vr_link end",
    "ref": "case when part_id % 89 = 0 then 'NOPE' else p.mrn end",
    "pid": "case when part_id % 83 = 0 then '' else p.mrn end",
}
EVENTS_CTE = {"ev": f"""select {VORD} as msg_id, p.org_id, p.patient_id, {EVENT['link']} as vr_link, {EVENT['ref']} as patient_ref, {EVENT['pid']} as mrn, p.name_last, p.name_first, p.birth_date,
    v.cvx, v.administered_date, v.reported_date, case when facility_id % 4 = 0 then '' else v.lot end as lot, case when info_source = '00' then '00' else '01' end as info_source, facility_id
    from fx_vaccination v join fx_patient p on v.patient_id = p.patient_id"""}
FHIR_RULE = """case when vr_link = '' then 'V60' when patient_ref <> '' and not exists (select 1 from fx_patient x where x.org_id = ev.org_id and x.mrn = ev.patient_ref) then 'V61'
    when mrn = '' then 'V62' when administered_date < birth_date then 'V63' end"""


def events(spark, sf_dir):
    r = Registry(spark, sf_dir)
    rows = r.vaccinations(r.patients().select("patient_id", "org_id", "mrn", "name_last", "name_first", "birth_date")).alias("p")
    event = f"""to_json(named_struct(
        'patient', named_struct('identifier', array(named_struct('value', {EVENT['pid']})), 'name', array(named_struct('family', name_last, 'given', array(name_first))), 'birthDate', birth_date),
        'immunization', named_struct('identifier', array(named_struct('value', {EVENT['link']})), 'recorded', case when part_id % 2 = 0 then reported_date end, 'occurrenceDateTime', administered_date,
            'lotNumber', case when facility_id % 4 = 0 then '' else lot end, 'doseQuantity', named_struct('value', cast(amount as decimal(18,4))), 'primarySource', info_source = '00',
            'vaccineCode', named_struct('coding', array(named_struct('code', cvx))), 'patient', named_struct('reference', {EVENT['ref']}),
            'location', named_struct('id', case when part_id % 13 = 0 then '' else concat('FAC', facility_id) end, 'name', concat('Facility ', facility_id), 'address', named_struct(
                'line', case when part_id % 2 = 0 then array('1 Way') else array('1 Way', concat('Room ', part_id % 9)) end, 'city', concat('Town', facility_id % 60), 'state', 'MI',
                'postalCode', concat(49000 + part_id % 9), 'country', case when part_id % 4 = 0 then null else 'USA' end)))))"""
    raw = rows.selectExpr(f"{VORD} as msg_id", f"{VORD} as arrival", "org_id", "reported_date as received_date", f"{event} as event")
    return interchange.parse_events(raw)


@query("dq_fhir", with_ctes("fx_vaccination fx_patient", f"select * from (select msg_id, {FHIR_RULE} as rule from ev) t where rule is not null", EVENTS_CTE))
def dq_fhir(spark, sf_dir):
    return rules.fhir_findings(events(spark, sf_dir), Registry(spark, sf_dir).patients()).select("msg_id", "rule")


BY = "part_id % 3 = 0"  # the events that come first
FACILITY = "case when part_id % 13 = 0 then '' else 'FAC' || cast(facility_id as string) end"


def _latest(source):
    return f"""select org_id, mrn, vr_link, min(msg_id) as first_arrival, arg_max(cvx, msg_id) as cvx, arg_max(administered_date, msg_id) as administered_date,
        arg_max(reported_date, msg_id) as reported_date, arg_max(lot, msg_id) as lot, arg_max(info_source, msg_id) as info_source, arg_max(facility_code, msg_id) as facility_code
        from {source} group by 1, 2, 3"""


def _firsts(source):
    return f"""select org_id, mrn, arg_min(name_last, msg_id) as name_last, arg_min(name_first, msg_id) as name_first, arg_min(birth_date, msg_id) as birth_date, min(msg_id) as arrival
        from {source} group by 1, 2"""


GROUP = "partition by org_id, mrn, cvx, administered_date, info_source"
INGEST_CTES = {
    "ev": EVENTS_CTE["ev"].replace("facility_id\n", f"facility_id, part_id, {FACILITY} as facility_code\n"),
    "good": f"select * from ev where ({FHIR_RULE}) is null",
    "good1": f"select * from good where {BY}", "good2": f"select * from good where not ({BY})",
    "latest1": _latest("good1"), "latest2": _latest("good2"),
    "stored": f"""select * exclude (m0, n0, f), case when lot = '' or n0 < f then m0 else f end as master from (select *, min(first_arrival) over ({GROUP}) as m0,
        min(case when lot = '' then first_arrival end) over ({GROUP}) as n0, min(first_arrival) over ({GROUP}, lot) as f from latest1) t""",
    "merged": """select coalesce(s.org_id, n.org_id) as org_id, coalesce(s.mrn, n.mrn) as mrn, coalesce(s.vr_link, n.vr_link) as vr_link, coalesce(s.first_arrival, n.first_arrival) as first_arrival,
        coalesce(n.cvx, s.cvx) as cvx, coalesce(n.administered_date, s.administered_date) as administered_date, coalesce(n.reported_date, s.reported_date) as reported_date,
        coalesce(n.lot, s.lot) as lot, coalesce(n.info_source, s.info_source) as info_source, coalesce(n.facility_code, s.facility_code) as facility_code, s.master as given,
        (case when s.master is null then '1' else '0' end) || coalesce(s.first_arrival, n.first_arrival) as o
        from stored s full join latest2 n on s.org_id = n.org_id and s.mrn = n.mrn and s.vr_link = n.vr_link""",
    "told": f"""select *, case when lot = '' then m0 when n0 < f then (case when n0[1] = '0' then n0 else m0 end) else f end as t from (select *, min(o) over ({GROUP}) as m0,
        min(case when lot = '' then o end) over ({GROUP}) as n0, min(o) over ({GROUP}, lot) as f from merged) t""",
    "report": """select told.* exclude (m0, n0, f, o), coalesce(told.given, s.master, substr(t, 2)) as vaccination_master from told
        left join (select first_arrival as fa, org_id as so, mrn as sm, master from stored) s on t = '0' || fa and told.org_id = so and told.mrn = sm""",
    "firsts1": _firsts("good1"), "firsts2": _firsts("good2"),
    "person1": """select *, maker as patient_master, cast(case when maker = arrival then null when maker_birth = birth_date then 2 else 1 end as int) as confidence
        from (select *, min(arrival) over w as maker, arg_min(birth_date, arrival) over w as maker_birth from firsts1 window w as (partition by name_last, name_first)) t""",
    "masters1": "select patient_master, name_last, name_first, birth_date from person1 where patient_master = arrival",
    "placed": """select f.*, (select min(patient_master) from masters1 m where m.name_last = f.name_last and m.name_first = f.name_first and m.birth_date = f.birth_date) as exact_m,
        (select min(patient_master) from masters1 m where m.name_last = f.name_last and m.name_first = f.name_first) as named_m
        from firsts2 f where not exists (select 1 from person1 p where p.org_id = f.org_id and p.mrn = f.mrn)""",
    "made": """select *, min(case when named_m is null then arrival end) over w as maker, arg_min(birth_date, arrival) filter (named_m is null) over w as maker_birth
        from placed window w as (partition by name_last, name_first)""",
    "person": """select org_id, mrn, patient_master, confidence from person1 union all
        select org_id, mrn, coalesce(exact_m, named_m, maker), cast(case when exact_m is not null then 2 when named_m is not null then 1 when maker = arrival then null when maker_birth = birth_date then 2 else 1 end as int) from made""",
}


def ingested(spark, sf_dir, *needed):
    """The stored tables after two batches: a third of the events first, then the others.

    ``needed`` are the tables of the first batch that the asked ones build on.
    """
    r = Registry(spark, sf_dir)
    rows = events(spark, sf_dir).withColumn("part_id", F.expr("cast(split_part(msg_id, '/', 2) as bigint)"))
    empty = interchange.empty_store(spark)
    store = empty | interchange.Ingest(empty, rows.where(BY), r.patients()).write(*needed)
    return interchange.Ingest(store, rows.where(f"not ({BY})"), r.patients())


@query("fhir_ingest", with_ctes("fx_vaccination fx_patient", """
    select org_id, mrn, vr_link, cvx, administered_date, reported_date, lot, info_source, facility_code, vaccination_master, patient_master, confidence
    from report join person using (org_id, mrn)""", INGEST_CTES))
def fhir_ingest(spark, sf_dir):
    after = ingested(spark, sf_dir, "reports", "patients", "patient_masters")
    return after.reports.join(after.patients, ["org_id", "mrn"]).select(
        "org_id", "mrn", "vr_link", "cvx", "administered_date", "reported_date", "lot", "info_source", "facility_code",
        "vaccination_master", "patient_master", "confidence")


@query("fhir_masters", with_ctes("fx_vaccination fx_patient", """
    select 'vaccination' as kind, master as master_id, cvx as label, administered_date as day from stored where master = first_arrival union all
    select 'vaccination', vaccination_master, cvx, administered_date from report where given is null and vaccination_master = first_arrival union all
    select 'patient', patient_master, name_last || ' ' || name_first, birth_date from masters1 union all
    select 'patient', maker, name_last || ' ' || name_first, birth_date from made where named_m is null and maker = arrival""", INGEST_CTES))
def fhir_masters(spark, sf_dir):
    after = ingested(spark, sf_dir, "reports", "vaccination_masters", "patients", "patient_masters")
    shots = after.vaccination_masters.selectExpr("'vaccination' as kind", "vaccination_master as master_id", "cvx as label", "administered_date as day")
    return shots.unionByName(after.patient_masters.selectExpr(
        "'patient' as kind", "patient_master as master_id", "concat(name_last, ' ', name_first) as label", "birth_date as day"))


@query("fhir_locations", with_ctes("fx_vaccination fx_patient", f"""
    select org_id, facility_code, 'Facility ' || cast(facility_id as string) as facility_name, '1 Way' as facility_line1, case when part_id % 2 <> 0 then 'Room ' || cast(part_id % 9 as string) end as facility_line2,
      'Town' || cast(facility_id % 60 as string) as facility_city, 'MI' as facility_state, cast(49000 + part_id % 9 as string) as facility_zip, case when part_id % 4 <> 0 then 'USA' end as facility_country
    from (select *, row_number() over (partition by org_id, facility_code order by ({BY}) desc, msg_id) as rn from good where facility_code <> '') t where rn = 1""", INGEST_CTES))
def fhir_locations(spark, sf_dir):
    return ingested(spark, sf_dir, "locations").locations.select("org_id", "facility_code", *interchange.LOCATION)
