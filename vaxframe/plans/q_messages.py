"""Queries over the message table: structuring, validation, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hl7text as h
from ..operators import acceptance, hl7, rules
from ..sources import files
from ..sources.scratch import new_path, stage
from .catalog import query
from .fixtures import Registry, with_ctes

AS_OF = "2002-01-01"


def validation(spark, sf_dir) -> rules.Validation:
    r = Registry(spark, sf_dir)
    return rules.Validation(r.messages(), r.orgs(), r.codes(), r.relations(), r.valid_values(),
                            f"date '{AS_OF}'", r.locations())


def parsed(spark, sf_dir):
    return hl7.parse(Registry(spark, sf_dir).messages())


# ------------------------------------------------------------- structuring

N_LINES = ("case when eff_type = 'QBP' or (eff_type = '' and msg_type = 'QBP') then n_msh + (case when has_qpd then 1 else 0 end) + 1 "
           "else n_msh + (case when has_pid then 1 else 0 end) + (case when has_pd1 then 1 else 0 end) + n_nk1 end")


@query("hl7_segments", with_ctes("fxo", """
    select msg_id, count(*) as orc, cast(sum(case when msg_type = 'ORU' then 0 when has_rxa then 1 else 0 end) as bigint) as rxa,
           cast(sum(case when msg_type <> 'ORU' and has_rxa and has_rxr then 1 else 0 end) as bigint) as rxr,
           cast(sum(n_obx) as bigint) as obx, cast(max(n_nk1) as bigint) as nk1,
           cast(max(case when has_pid then 1 else 0 end) as bigint) as pid
    from fxo where msg_type <> 'QBP' group by msg_id
    union all select msg_id, 0, 0, 0, 0, 0, 0 from fxm where msg_type = 'QBP'"""))
def hl7_segments(spark, sf_dir):
    rows = hl7.segments(Registry(spark, sf_dir).messages())
    return rows.groupBy("msg_id").agg(*[
        F.count_if(F.col("segment") == s).alias(s.lower()) for s in ("ORC", "RXA", "RXR", "OBX", "NK1", "PID")])


@query("scan_messages", with_ctes("fxm", f"""
    select org_id, count(*) as messages, cast(sum({N_LINES} - n_msh) as bigint) as header_lines,
           cast(sum(n_msh) as bigint) as msh_lines from fxm group by org_id"""))
def scan_messages(spark, sf_dir):
    """Messages land in batch files per organisation, those with one MSH back to back and the others framed."""
    messages = Registry(spark, sf_dir).messages()
    whole, paths = f"{h.segment_count(h.normalised('message'), 'MSH')} = 1", {f: new_path(spark, f"batch-{f}") for f in ("msh", "mllp")}
    files.write_messages(messages.where(whole), paths["msh"], "msh", "org_id")
    files.write_messages(messages.where(f"not ({whole})"), paths["mllp"], "mllp", "org_id")
    rows = files.read_messages(spark, paths["msh"], "msh").unionByName(files.read_messages(spark, paths["mllp"], "mllp"))
    all_lines = F.filter(F.split("message", "\r"), lambda s: s != "")
    header = F.size(F.filter(all_lines, lambda s: F.left(s, F.lit(3)).isin("PID", "PD1", "NK1", "QPD", "RCP")))
    return rows.groupBy("org_id").agg(
        F.count("*").alias("messages"), F.sum(header).alias("header_lines"),
        F.sum(F.size(F.filter(all_lines, lambda s: s.startswith("MSH|")))).alias("msh_lines"))


@query("route_messages", with_ctes("fxm", """
    select msg_id, case when eff_type in ('VXU', 'ORU', 'QBP') then eff_type else 'unsupported' end as route,
           case when n_msh = 0 then '' else control_id end as control_id from fxm"""))
def route_messages(spark, sf_dir):
    return hl7.route(parsed(spark, sf_dir)).select("msg_id", "route", "control_id")


DATE = "cast(try_strptime({}, '%Y%m%d') as date)".format
LEFT8 = "cast(try_strptime(left({}, 8), '%Y%m%d') as date)".format
GUARDIAN_CTE = {"nk": """
    select msg_id, coalesce(min(case when relationship in ('MTH', 'FTH', 'GRD') then k end), max(k)) as pick
    from fxn group by msg_id""",
    "guardian": "select fxn.msg_id, nk_last, nk_first, nk_middle, relationship from fxn join nk on fxn.msg_id = nk.msg_id and fxn.k = nk.pick"}


@query("extract_patients", with_ctes("fxm fxn", f"""
    select fxm.msg_id, has_pd1, case when id_type = 'XX' then '' else mrn end as mrn,
      case when id_type = 'XX' then '' else authority end as mrn_authority, case when id_type = 'XX' then '' else id_type end as mrn_type,
      name_last, name_first, name_middle, mother_maiden, {DATE('birth_text')} as birth_date, sex, race, race2, '' as race3,
      line1, city, state, zip, country, county,
      concat(left(zip, 5), ':', case when position(' ' in line1) > 1 then split_part(line1, ' ', 1) else line1 end) as address_frag,
      case when phone_use = 'PRN' then concat(phone_area, phone_local) else '' end as phone,
      case when phone_use = 'PRN' and length(concat(phone_area, phone_local)) = 10
           then concat('^PRN^PH^^^', left(concat(phone_area, phone_local), 3), '^', substr(concat(phone_area, phone_local), 4, 7)) else '' end as phone_field,
      email, ethnicity, birth_flag, birth_order, {DATE('death_text')} as death_date, death_flag,
      case when has_pd1 then {DATE('protection_text')} end as protection_date,
      case when has_pd1 then {LEFT8('registry_text')} end as registry_date,
      case when has_pd1 then {DATE('publicity_text')} end as publicity_date,
      case when has_pd1 then 'N' else '' end as protection_ind, case when has_pd1 then 'A' else '' end as registry_status,
      coalesce(g.nk_last, '') as guardian_last, coalesce(g.nk_first, '') as guardian_first,
      coalesce(g.nk_middle, '') as guardian_middle, coalesce(g.relationship, '') as guardian_relationship
    from fxm left join guardian g on fxm.msg_id = g.msg_id where has_pid and msg_type <> 'QBP'""", GUARDIAN_CTE))
def extract_patients(spark, sf_dir):
    rows = hl7.keep(hl7.extract_patients(parsed(spark, sf_dir)), "has_pid")
    return rows.selectExpr("*", f"{h.render_phone('phone')} as phone_field").select(
        "msg_id", "has_pd1", "mrn", "mrn_authority", "mrn_type", "name_last", "name_first", "name_middle", "mother_maiden",
        "birth_date", "sex", "race", "race2", "race3", "line1", "city", "state", "zip", "country", "county", "address_frag",
        "phone", "phone_field", "email", "ethnicity", "birth_flag", "birth_order", "death_date", "death_flag", "protection_date",
        "registry_date", "publicity_date", "protection_ind", "registry_status", "guardian_last", "guardian_first",
        "guardian_middle", "guardian_relationship")


LENIENT = """(case when regexp_matches(left({0}, 8), '^[0-9]{{8}}$')
    then cast(make_date(cast(substr({0}, 1, 4) as int), 1, 1)
         + to_months(cast(substr({0}, 5, 2) as int) - 1) + to_days(cast(substr({0}, 7, 2) as int) - 1) as date) end)""".format
SLOT = """case when {0} then code1 when {1} then code2 else '' end""".format
NDC = SLOT("type1 = 'NDC' and code1 <> ''", "type2 = 'NDC'")
CPT = SLOT("type1 = 'C4' and code1 <> ''", "type2 = 'C4'")
CVX_SENT = SLOT("type1 = 'CVX' and code1 <> ''", "type2 not in ('NDC', 'C4')")
VACC_COLUMNS = """msg_id, cast(k as int) as order_no, has_rxa, vr_link,
      case when has_rxa then code1 else '' end as vaccine_code,
      case when has_rxa then {NDC} else '' end as ndc, case when has_rxa then {CPT} else '' end as cpt,
      case when has_rxa then {CVX_SENT} else '' end as cvx_sent,
      case when has_rxa then {D1} end as administered_date, case when has_rxa then {D2} end as administered_lenient,
      case when has_rxa then amount else '' end as amount,
      case when has_rxa and amount <> '999' then amount when has_rxa then null else '' end as simple_amount,
      case when has_rxa then info_source else '' end as info_source,
      case when has_rxa then provider_code else '' end as provider_link, case when has_rxa then provider_last else '' end as provider_last,
      case when has_rxa then facility_code else '' end as facility_code, case when has_rxa then facility_city else '' end as facility_city,
      case when has_rxa then lot else '' end as lot, case when has_rxa then {D3} end as expiration_date,
      case when has_rxa then mvx else '' end as mvx, case when has_rxa then refusal_code else '' end as refusal_code,
      case when has_rxa then completion_status else '' end as completion_status, case when has_rxa then action_code else '' end as action_code,
      case when has_rxa and has_rxr then body_route else '' end as body_route,
      case when has_rxa and has_rxr then body_site else '' end as body_site""".format(
    NDC=NDC, CPT=CPT, CVX_SENT=CVX_SENT, D1=DATE("admin_text"), D2=LENIENT("admin_text"), D3=DATE("expiration_text"))


@query("extract_vaccinations", with_ctes("fxo", f"select {VACC_COLUMNS} from fxo where eff_type = 'VXU'"))
def extract_vaccinations(spark, sf_dir):
    rows = hl7.extract_vaccinations(parsed(spark, sf_dir))
    return rows.selectExpr(
        "msg_id", "order_no", "has_rxa", "vr_link", "vaccine_code", "ndc", "cpt", "cvx_sent", "administered_date",
        f"{h.parse_date('administered_text', 'false')} as administered_lenient", "amount",
        "case when amount <> '999' then amount end as simple_amount",
        "info_source", "provider_link", "provider_last", "facility_code", "facility_city", "lot", "expiration_date", "mvx",
        "refusal_code", "completion_status", "action_code", "body_route", "body_site")


@query("simple_extract", with_ctes("fxo", f"""
    select msg_id, order_no, vr_link, administered_date, lot, mvx, info_source, simple_amount as amount from (select {VACC_COLUMNS} from fxo where eff_type = 'VXU') t"""))
def simple_extract(spark, sf_dir):
    return hl7.simple_doses(hl7.extract_vaccinations(parsed(spark, sf_dir)))


@query("order_groups", with_ctes("fxo", """
    select msg_id, cast(k as int) as order_no, cast(1 + (case when msg_type = 'ORU' then (case when has_obr then 1 else 0 end)
           else (case when has_rxa then 1 else 0 end) + (case when has_rxa and has_rxr then 1 else 0 end) end) + n_obx as bigint) as segments
    from fxo where msg_type <> 'QBP'"""))
def order_groups(spark, sf_dir):
    rows = hl7.segments(Registry(spark, sf_dir).messages())
    return rows.where("order_no > 0").groupBy("msg_id", "order_no").agg(F.count("*").alias("segments"))


OBX_FROM = """from (select *, cast(row_number() over (partition by msg_id order by k, j) as int) as obx_no from fxx
      where (eff_type = 'VXU' and has_rxa) or (eff_type = 'ORU' and has_obr)) t"""


@query("extract_observations", with_ctes("fxx", f"""
    select msg_id, cast(k as int) as order_no, obx_no, identifier_code, value_code, 'VLbl' as value_label, 'TBL' as value_table,
           'F' as result_status, {DATE('obs_text')} as observation_date, 'VXC40' as method_code {OBX_FROM}"""))
def extract_observations(spark, sf_dir):
    rows = hl7.orders(parsed(spark, sf_dir), only="msg_type in ('VXU', 'ORU')")
    return hl7.extract_observations(rows).select(
        "msg_id", "order_no", "obx_no", "identifier_code", "value_code", "value_label", "value_table", "result_status",
        "observation_date", "method_code")


RCP_INT = "try_cast(split_part(rcp, '^', 1) as int)"


@query("extract_queries", with_ctes("fxm", f"""
    select msg_id, profile, has_qpd, case when has_qpd then cast(msg_id as string) else '' end as query_tag,
      case when has_qpd and id_type in ('MR', 'PT') then mrn else '' end as q_mrn,
      case when has_qpd then name_last else '' end as q_last, case when has_qpd then name_first else '' end as q_first,
      case when has_qpd then name_middle else '' end as q_middle, case when has_qpd then {LENIENT('birth_text')} end as q_birth,
      case when has_qpd then sex else '' end as q_sex, {RCP_INT} as quantity
    from fxm where eff_type = 'QBP'"""))
def extract_queries(spark, sf_dir):
    return hl7.extract_queries(parsed(spark, sf_dir)).select(
        "msg_id", "profile", "has_qpd", "query_tag", "q_mrn", "q_last", "q_first", "q_middle", "q_birth", "q_sex", "quantity")


# -------------------------------------------------------------- validation

FINDING_KEYS = ["msg_id", "rule", "severity", "segment", "seg_repeat", "field"]


def keyed(findings, keep):
    return findings.where(keep).select(*FINDING_KEYS)


def _rule(source, pos, rule, severity, thrown, segment, field, cond, repeat="1", stage=1, k="0", o="0"):
    return (f"select msg_id, {stage} as stage, {k} as k, {pos} as pos, {o} as obx_no, '{rule}' as rule, {severity} as severity, "
            f"{thrown} as thrown, '{segment}' as segment, cast({repeat} as int) as seg_repeat, cast({field} as int) as field "
            f"from {source} where {cond}")


def flavored(flavor, yes, no):
    return f"case when f_{flavor.lower()} then '{yes}' else '{no}' end"


def head_rules() -> str:
    ok = "eff_type in ('VXU', 'ORU') and n_msh = 1 and not (f_soursop and facility <> org_name)"
    phone = "concat(phone_area, phone_local)"
    digits = f"regexp_replace({phone}, '[^0-9]', '', 'g')"
    strange = f"regexp_replace({phone}, '[0-9. ()-]', '', 'g')"
    bdate = f"case when f_cantaloupe then {LENIENT('birth_text')} else {DATE('birth_text')} end"
    def bad(col):
        return f"{col} <> '' and (case when f_cantaloupe then {LENIENT(col)} else {LEFT8(col)} end) is null"
    vv = "(select value from valid_value where valid_set in ({}))".format
    known = "exists (select 1 from code where codeset = '{0}' and value = {1} and status = 'VALID')".format
    single, multi = "birth_flag in ('', 'N')", "birth_flag = 'Y'"
    t, f = "true", "false"
    table = [  # rule, severity, thrown, segment, field, condition
        ("V29", "'E'", t, "", 0, "not has_pid", 0),
        ("V28", "'E'", t, "PID", 3, "has_pid and id_type = 'XX'", 1),
        ("V30", flavored("QUINZE", "E", "W"), f, "PID", 13, "has_pid and phone_use <> 'PRN'", 1),
        ("V31", "'W'", f, "PID", 13, f"has_pid and {strange} <> ''", 1),
        ("V32", "'W'", f, "PID", 13, f"has_pid and (length({digits}) <> 10 or regexp_matches({phone}, '^(555|0|1)'))", 1),
        ("V33", "'E'", t, "PID", 5, "name_last = ''", 1),
        ("V34", "'E'", t, "PID", 5, "name_first = ''", 1),
        ("V35", "'E'", t, "PID", 7, f"({bdate}) is null", 1),
        ("V36", "'E'", t, "PID", 7, f"({bdate}) > date '{AS_OF}'", 1),
        ("V37", "'W'", f, "PID", 29, bad("death_text"), 1),
        ("V38", "'W'", f, "PID", 8, f"sex not in {vv(chr(39) + 'SEX' + chr(39))}", 1),
        ("V39", flavored("GUAVA", "W", "E"), f, "PID", 11, f"country <> '' and country not in {vv(chr(39) + 'COUNTRY_2DIGIT' + chr(39) + ',' + chr(39) + 'COUNTRY_3DIGIT' + chr(39))}", 1),
        ("V40", flavored("GUAVA", "W", "E"), f, "PID", 11, f"country in ('', 'US', 'USA') and state <> '' and state not in {vv(chr(39) + 'STATE' + chr(39))}", 1),
        ("V41", flavored("FIG", "E", "W"), f, "PID", 10, f"race <> '' and not {known('PATIENT_RACE', 'race')}", 1),
        ("V42", flavored("FIG", "E", "W"), f, "PID", 10, f"ethnicity <> '' and not {known('PATIENT_ETHNICITY', 'ethnicity')}", 1),
        ("V43", "'E'", t, "PID", 11, "f_blackberry and (line1 = '' or city = '' or state = '' or zip = '')", 1),
        ("V44", flavored("PLANTAIN", "W", "E"), f, "PID", 25, f"{single} and birth_order not in ('1', '')", 1),
        ("V45", "'W'", f, "PID", 24, f"{multi} and birth_order = ''", 1),
        ("V46", flavored("PLANTAIN", "W", "E"), f, "PID", 25, f"{multi} and birth_order <> '' and birth_order not in {vv(chr(39) + 'BIRTH_ORDER' + chr(39))}", 1),
        ("V47", flavored("PLANTAIN", "W", "E"), f, "PID", 24, f"not {single} and not {multi}", 1),
        ("V48a", "'W'", f, "PD1", 13, "has_pd1 and " + bad("protection_text"), 1),
        ("V48b", "'W'", f, "PD1", 17, "has_pd1 and " + bad("registry_text"), 1),
        ("V48c", "'W'", f, "PD1", 18, "has_pd1 and " + bad("publicity_text"), 1),
    ]
    src = f"(select * from fxf where {ok}) t"
    parts = [_rule("fxf", 0, "V59", "'E'", t, "", 0, "n_msh = 0", 0, 0), _rule("fxf", 0, "V64", "'E'", t, "MSH", 0, "n_msh > 1", 1, 0),
             _rule("fxf", 1, "V01", "'E'", t, "", 0, "n_msh = 1 and f_soursop and facility <> org_name", 0, 0),
             _rule("fxf", 2, "V02", "'E'", t, "", 0, "n_msh = 1 and eff_type not in ('VXU', 'ORU', 'QBP') and not (f_soursop and facility <> org_name)", 0, 0)]
    parts += [_rule(src, i + 1, r, s, th, seg, fld, c, rep) for i, (r, s, th, seg, fld, c, rep) in enumerate(table)]
    nk = (f"(select fxn.*, t2.f_soursop, t2.org_name as own from fxn join fxf t2 on fxn.msg_id = t2.msg_id "
          f"left join nk on fxn.msg_id = nk.msg_id where fxn.eff_type in ('VXU', 'ORU') and fxn.n_msh = 1 and not (t2.f_soursop and fxn.facility <> t2.org_name) and k <= nk.pick) t")
    for pos, (r, fld, c) in enumerate([("V49", 2, "nk_last = ''"), ("V50", 2, "nk_first = ''"), ("V51", 3, "relationship = ''"),
                                       ("V52", 3, "relationship not in ('MTH', 'FTH', 'GRD')")]):
        parts.append(_rule(nk, f"100 + k * 10 + {pos}", r, "'W'", f, "NK1", fld, c, "k"))
    return " union all ".join(parts)


HEAD = "fxm fxn fx_org code valid_value"
HEAD_CTES = {
    **{"nk": GUARDIAN_CTE["nk"]},
    "fxf": "select fxm.*, fx_org.* exclude (org_id) from fxm left join fx_org on fxm.org_id = fx_org.org_id",
    "raw_head": None,  # filled below
    "head": "select * from (select *, min(case when thrown then stage * 1000 + pos end) over (partition by msg_id) as stop from raw_head) t "
            "where stop is null or stage * 1000 + pos <= stop",
}
HEAD_CTES["raw_head"] = head_rules()
KEYS_SQL = ", ".join(FINDING_KEYS)


@query("dq_message", with_ctes(HEAD, f"select {KEYS_SQL} from head where stage = 0", HEAD_CTES))
def dq_message(spark, sf_dir):
    return keyed(validation(spark, sf_dir).head_findings(), F.col("stage") == 0)


@query("dq_patient", with_ctes(HEAD, f"select {KEYS_SQL} from head where stage = 1 and segment <> 'NK1'", HEAD_CTES))
def dq_patient(spark, sf_dir):
    return keyed(validation(spark, sf_dir).head_findings(), (F.col("stage") == 1) & (F.col("segment") != "NK1"))


@query("dq_guardian", with_ctes(HEAD, f"select {KEYS_SQL} from head where segment = 'NK1'", HEAD_CTES))
def dq_guardian(spark, sf_dir):
    return keyed(validation(spark, sf_dir).head_findings(), F.col("segment") == "NK1")


def order_rules() -> str:
    adm = f"case when f_cantaloupe then {LENIENT('admin_text')} else {DATE('admin_text')} end"
    src = "dose"
    t, f = "true", "false"
    table = [
        ("V25", "'E'", t, "ORC", 0, "not has_rxa"),
        ("V08", "'E'", t, "RXA", 5, "has_rxa and code1 = ''"),
        ("V09", "'E'", t, "ORC", 3, "live and vr_link = ''"),
        ("V10", "'E'", t, "RXA", 3, "live and adm is null"),
        ("V11", "'E'", t, "RXA", 3, f"live and adm > date '{AS_OF}'"),
        ("V12", "'W'", f, "RXA", 5, "live and ndc_known and ndc_cvx is null"),
        ("V13", "'W'", f, "RXA", 5, "live and ndc_known and cvx_sent <> '' and cvx_sent <> ndc_cvx"),
        ("V14", "'W'", f, "RXA", 5, "live and cpt_known and cpt_cvx is null"),
        ("V15", "'W'", f, "RXA", 5, "live and cpt_known and coalesce(nullif(cvx_sent, ''), case when ndc_known then ndc_cvx end) <> cpt_cvx"),
        ("V16", "'E'", t, "RXA", 5, "live and cvx = ''"),
        ("V17", "'E'", t, "RXA", 5, "live and not cvx_known"),
        ("V18", "'E'", t, "RXA", 11, "live and f_pear and facility_code <> '' and not loc_known"),
        ("V19", "'W'", f, "RXA", 16, f"live and expiration_text <> '' and (case when f_cantaloupe then {LENIENT('expiration_text')} else {LEFT8('expiration_text')} end) is null"),
        ("V20", "'W'", f, "RXA", 18, "live and refusal_code <> '' and refusal_code not in (select value from code where codeset = 'VACCINATION_REFUSAL')"),
        ("V21", "'E'", t, "RXA", 0, "live and f_spruce and not has_rxr and info_source = '00'"),
        ("V22", "'E'", t, "RXA", 3, "live and adm < birth_date and not f_clementine"),
    ]
    parts = [_rule(src, i + 1, r, s, th, seg, fld, c, "k", 2, k="k") for i, (r, s, th, seg, fld, c) in enumerate(table)]
    parts.append(_rule("oru_order", 1, "V53", "'E'", t, "ORC", 0, "not has_obr", "k", 2, k="k"))
    odate = f"(case when f_cantaloupe then {LENIENT('obs_text')} else {LEFT8('obs_text')} end)"
    contra = "identifier_code = '30945-0'"
    def unknown(codeset):
        return f"value_code <> '' and value_code not in (select value from code where codeset = '{codeset}')"
    obs = [
        ("50", 0, "V23", 5, "is_dose and identifier_code = '64994-7' and " + unknown("FINANCIAL_STATUS_CODE")),
        ("50", 0, "V24", 5, "is_dose and identifier_code = '30963-3' and " + unknown("VACCINATION_FUNDING_SOURCE")),
        ("60", 0, "V57", 14, f"obs_text <> '' and {odate} is null"),
        ("60", 1, "V54", 5, f"{contra} and " + unknown("CONTRAINDICATION_OR_PRECAUTION")),
        ("60", 2, "V55", 5, f"{contra} and {odate} > date '{AS_OF}'"),
        ("60", 3, "V56", 14, f"{contra} and {odate} < birth_date"),
    ]
    for block, i, r, fld, c in obs:
        parts.append(_rule("obx", f"{block} + {i}", r, "'W'", f, "OBX", fld, c, "obx_no", 2, k="k", o="obx_no"))
    parts.append("select msg_id, 3, 0, 1, 0, case when f_cranberry and v = 0 then 'V26' else 'V27' end, 'E', true, '', 0, 0 from totals "
                 "where not any_failed and ((f_cranberry and v = 0) or (f_bilberry and v = 0 and re = 0))")
    return " union all ".join(parts)


ORDER_CTES = {
    **HEAD_CTES,
    "passed": f"select fxf.*, case when f_cantaloupe then {LENIENT('birth_text')} else {DATE('birth_text')} end as birth_date from fxf "
              "where eff_type in ('VXU', 'ORU') and n_msh = 1 and not (f_soursop and facility <> org_name) "
              "and msg_id not in (select msg_id from head where severity = 'E')",
    "flagged": "select fxo.*, p.* exclude (msg_id, " + ", ".join(__import__("vaxframe.plans.fixtures", fromlist=["MESSAGE"]).MESSAGE.keys() - {"msg_id"})
               + ") from fxo join passed p on fxo.msg_id = p.msg_id",
    "oru_order": "select * from flagged where eff_type = 'ORU'",
    "slots": f"select *, {NDC} as ndc, {CPT} as cpt, {CVX_SENT} as cvx_sent, "
             f"case when f_cantaloupe then {LENIENT('admin_text')} else {DATE('admin_text')} end as adm, "
             "has_rxa and code1 <> '998' as live from flagged where eff_type = 'VXU'",
    "mapped": "select s.*, n.value is not null as ndc_known, coalesce(nullif(n.new_value, ''), s.ndc) as ndc_final, nr.to_cvx as ndc_cvx, "
              "c.value is not null as cpt_known, cr.to_cvx as cpt_cvx, "
              "coalesce(nullif(s.cvx_sent, ''), case when n.value is not null then nr.to_cvx end, case when c.value is not null then cr.to_cvx end, '') as cvx "
              "from slots s left join code n on n.codeset = 'VACCINATION_NDC_CODE' and n.value = s.ndc "
              "left join code_rel nr on nr.from_set = 'VACCINATION_NDC_CODE' and nr.from_value = s.ndc "
              "left join code c on c.codeset = 'VACCINATION_CPT_CODE' and c.value = s.cpt "
              "left join code_rel cr on cr.from_set = 'VACCINATION_CPT_CODE' and cr.from_value = s.cpt",
    "dose": "select m.*, m.cvx in (select value from code where codeset = 'VACCINATION_CVX_CODE') as cvx_known, "
            "l.org_id is not null as loc_known from mapped m left join fx_location l on l.org_id = m.org_id and l.facility_code = m.facility_code",
    "dose_fail": None, "obx": None, "totals": None, "raw_order": None,
    "orders_f": "select * from (select *, min(case when thrown then (stage, k, least(pos, 60), obx_no, pos) end) over (partition by msg_id) as stop from raw_order) t "
                "where stop is null or (stage, k, least(pos, 60), obx_no, pos) <= stop",
}
_FAIL = ("not has_rxa or code1 = '' or (live and (vr_link = '' or adm is null or adm > date '" + AS_OF + "' or cvx = '' or not cvx_known "
         "or (f_pear and facility_code <> '' and not loc_known) or (f_spruce and not has_rxr and info_source = '00') "
         "or (adm < birth_date and not f_clementine)))")
ORDER_CTES["dose_fail"] = f"select *, coalesce({_FAIL}, false) as failed from dose"
ORDER_CTES["obx"] = (
    "select x.* exclude (org_id, mrn, vr_link, has_rxa, has_obr, n_obx, code1, custkey, received_date, eff_type), o.* exclude (msg_id, k) from "
    "(select *, cast(row_number() over (partition by msg_id order by k, j) as int) as obx_no from fxx where (eff_type = 'VXU' and has_rxa) or (eff_type = 'ORU' and has_obr)) x join "
    "(select msg_id, k, vr_link, birth_date, f_cantaloupe, live as is_dose, mrn, org_id, received_date from dose_fail where not failed union all "
    "select msg_id, k, vr_link, birth_date, f_cantaloupe, false, mrn, org_id, received_date from oru_order where has_obr) o on x.msg_id = o.msg_id and x.k = o.k")
ORDER_CTES["totals"] = (
    "select p.msg_id, f_cranberry, f_bilberry, coalesce(any_failed, false) as any_failed, coalesce(v, 0) as v, coalesce(re, 0) as re from passed p left join "
    "(select msg_id, bool_or(failed) as any_failed, count(*) filter (not failed and live and cvx not in ('998', '999') and completion_status in ('CP', 'PA', '')) as v, "
    "count(*) filter (not failed and live and completion_status = 'RE') as re from dose_fail group by msg_id) c on p.msg_id = c.msg_id "
    "where p.eff_type = 'VXU'")
ORDER_CTES["raw_order"] = order_rules()
FULL = "fxm fxo fxx fxn fx_org fx_location code code_rel valid_value"


@query("dq_order", with_ctes(FULL, f"select {KEYS_SQL} from orders_f where rule not in ('V54', 'V55', 'V56', 'V57')", ORDER_CTES))
def dq_order(spark, sf_dir):
    return keyed(validation(spark, sf_dir).findings(), "stage >= 2 and block < 2")


@query("dq_observation", with_ctes(FULL, f"select {KEYS_SQL} from orders_f where rule in ('V54', 'V55', 'V56', 'V57')", ORDER_CTES))
def dq_observation(spark, sf_dir):
    return keyed(validation(spark, sf_dir).findings(), "block = 2")


QUERY_RULES = " union all ".join([
    "select msg_id, 'V03' as rule, 'E' as severity, '' as segment, 0 as seg_repeat, 0 as field from q where not has_qpd",
    f"select msg_id, 'V07', 'W', 'QPD', 1, 6 from q where has_qpd and birth_text <> '' and {LENIENT('birth_text')} is null",
    "select msg_id, 'V04', 'E', 'QPD', 1, 4 from q where has_qpd and name_last = ''",
    "select msg_id, 'V05', 'E', 'QPD', 1, 4 from q where has_qpd and name_last <> '' and name_first = ''",
    f"select msg_id, 'V06', 'E', 'QPD', 1, 6 from q where has_qpd and name_last <> '' and name_first <> '' and {LENIENT('birth_text')} is null",
    "select msg_id, 'V58', 'E', 'MSH', 1, 21 from q where has_qpd and profile not in ('Z34', 'Z44') and id_type in ('MR', 'PT') "
    "and exists (select 1 from fx_patient p where p.org_id = q.org_id and p.mrn = q.mrn)"])


@query("dq_query", with_ctes("fxm fx_patient", QUERY_RULES, {"q": "select * from fxm where eff_type = 'QBP'"}))
def dq_query(spark, sf_dir):
    r = Registry(spark, sf_dir)
    # written once: the join's "is not null" would go below the parse, as a second and longer text of the whole message
    asked = hl7.extract_queries(parsed(spark, sf_dir)).select(
        "msg_id", "org_id", "q_mrn", "profile", "has_qpd", "q_last", "q_first", "q_birth", "q_birth_text")
    asked = stage(asked, "queries")
    side = r.patients().select("org_id", F.col("mrn").alias("q_mrn")).distinct()
    matched = asked.join(side, ["org_id", "q_mrn"], "left_semi")
    return rules.query_findings(asked, matched).select(*FINDING_KEYS)


# -------------------------------------------------------------- acceptance

ALL_F = {**ORDER_CTES, "all_f": f"select msg_id, stage, rule, severity from head union all select msg_id, stage, rule, severity from orders_f"}


@query("ack_status", with_ctes(FULL, """
    select fxm.msg_id, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings,
           case when coalesce(errors, 0) + coalesce(warnings, 0) > 0 then 'AE' else 'AA' end as status
    from fxm left join (select msg_id, count(*) filter (severity = 'E') as errors, count(*) filter (severity = 'W') as warnings
                        from all_f group by msg_id) f on fxm.msg_id = f.msg_id""", ALL_F))
def ack_status(spark, sf_dir):
    return acceptance.ack_status(validation(spark, sf_dir).report)


@query("accepted_prefix", with_ctes(FULL, """
    select msg_id, cast(k as int) as order_no, failed, not bool_or(failed) over (partition by msg_id order by k) as accepted from dose_fail""", ORDER_CTES))
def accepted_prefix(spark, sf_dir):
    return acceptance.accepted_prefix(validation(spark, sf_dir).doses).select("msg_id", "order_no", "failed", "accepted")


@query("accepted_patients", with_ctes(HEAD, f"""
    select msg_id, org_id, mrn, name_last, birth_date from (select fxf.*, case when f_cantaloupe then {LENIENT('birth_text')} else {DATE('birth_text')} end as birth_date from fxf) fxf
    where eff_type in ('VXU', 'ORU') and msg_id not in (select msg_id from head where severity = 'E')""", HEAD_CTES))
def accepted_patients(spark, sf_dir):
    return validation(spark, sf_dir).accepted.select("msg_id", "org_id", "mrn", "name_last", "birth_date")


@query("vaccination_refusal_counts", with_ctes(FULL, """
    select msg_id, count(*) filter (accepted and live and cvx not in ('998', '999') and completion_status in ('CP', 'PA', '')) as vaccinations,
           count(*) filter (accepted and live and completion_status = 'RE') as refusals
    from (select *, not bool_or(failed) over (partition by msg_id order by k) as accepted from dose_fail) t group by msg_id""", ORDER_CTES))
def vaccination_refusal_counts(spark, sf_dir):
    return acceptance.event_counts(validation(spark, sf_dir).report)


@query("dq_summary", with_ctes(FULL, """
    select org_id, rule, severity, count(*) as findings from all_f join (select msg_id, org_id from fxm) m on all_f.msg_id = m.msg_id
    group by org_id, rule, severity""", ALL_F))
def dq_summary(spark, sf_dir):
    return acceptance.summary(validation(spark, sf_dir).findings())


LOG_SQL = """select fxm.msg_id, fxm.org_id, received_date, case when eff_type in ('VXU', 'ORU') then 'Update' else 'Unknown' end as category_request,
    case when eff_type not in ('VXU', 'ORU') then 'NAck' when exists (select 1 from all_f a where a.msg_id = fxm.msg_id and severity = 'E') then 'Exception' else 'Ack' end as category_response
    from fxm where eff_type <> 'QBP' and msg_id not in (select msg_id from all_f where stage = 0 and rule <> 'V02')"""


# ------------------------------------------------------------ quarantine

#: Faults that are planted in some messages, in the order in which they are looked for.
PLANTED = {"empty": ("msg_id % 61 = 11", "''"), "binary": ("msg_id % 59 = 3", "concat(message, char(1))"),
           "nested header": ("msg_id % 47 = 7", "concat(message, char(13), 'OBX|1|TX|MSH|^~|EHR')"),
           "truncated header": ("msg_id % 53 = 5", "left(message, 25)"), "broken segment": ("msg_id % 43 = 13", "concat(message, char(13), 'PI')")}
BROKEN = {"broken": "select msg_id, case " + " ".join(
    f"when {PLANTED[f][0]} then '{f}'" if f in PLANTED else "when n_msh = 0 then 'no header'"
    for f in ("empty", "binary", "no header", "nested header", "truncated header", "broken segment")) + " end as fault from fxm"}


def broken_validation(spark, sf_dir) -> rules.Validation:
    r = Registry(spark, sf_dir)
    text = "case " + " ".join(f"when {when} then {then}" for when, then in PLANTED.values()) + " else message end"
    messages = r.messages().selectExpr("msg_id", "org_id", "received_date", f"{text} as message")
    return rules.Validation(messages, r.orgs(), r.codes(), r.relations(), r.valid_values(), f"date '{AS_OF}'", r.locations())


@query("quarantine", with_ctes("fxm", "select msg_id, fault from broken where fault is not null", BROKEN))
def quarantine(spark, sf_dir):
    return broken_validation(spark, sf_dir).quarantined().select("msg_id", "fault")


@query("dq_quarantine", with_ctes(FULL, """
    select msg_id, rule, severity from all_f where msg_id not in (select msg_id from broken where fault is not null) union all
    select msg_id, 'V59', 'E' from broken where fault is not null""", ALL_F | BROKEN))
def dq_quarantine(spark, sf_dir):
    """Findings of a batch with broken messages: V59 for those, all others as without them."""
    return broken_validation(spark, sf_dir).findings().select("msg_id", "rule", "severity")
