"""Projections of the star-schema tables onto registry entities.

Every expression below is in the common dialect of Spark SQL and DuckDB, so one
text serves both sides: Spark selects it from parquet, the oracle uses it in a
CTE.  All of them are narrow (no shuffle) except ``fx_vaccination``, which joins
lineitem to orders on the order key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..sources.scratch import stage


def pick(expr: str, *values: str) -> str:
    """The given SQL expression for 0,1,2,... of ``expr``; the last one beyond."""
    texts = [v[1:-1] for v in values if v[0] == "'" and v[-1] == "'" and v.count("'") == 2 and "," not in v]
    if len(texts) == len(values) > 3:
        return f"split_part('{','.join(texts)}', ',', cast(least({expr}, {len(texts) - 1}) + 1 as int))"
    arms = " ".join(f"when {i} then {v}" for i, v in enumerate(values[:-1]))
    return f"(case {expr} {arms} else {values[-1]} end)"


def ymd(date_expr: str) -> str:
    """yyyyMMdd text of a date, the same in both dialects."""
    return f"replace(cast({date_expr} as string), '-', '')"


CVX = ["'03'", "'08'", "'10'", "'20'", "'21'", "'62'", "'83'", "'88'", "'91'", "'94'", "'207'", "'ZZZ'"]


def birth(key: str) -> str:
    return f"cast(date '1950-01-01' + cast(({key} % 240) * 75 as int) as date)"


#: When the queries are asked; some patients were reported in the two minutes before.
ASKED = "timestamp '2002-01-01 00:03:00'"

FLAVOR_RULES = {
    "SOURSOP": "org_id % 11 = 1", "SNAIL30": "org_id % 15 = 3", "SNAIL60": "org_id % 15 = 4",
    "SNAIL90": "org_id % 15 = 5", "SNAIL": "org_id % 15 = 6", "CANTALOUPE": "org_id % 8 = 3", "PEAR": "org_id % 9 = 4",
    "SPRUCE": "org_id % 7 = 2", "CLEMENTINE": "org_id % 6 = 1", "CRANBERRY": "org_id % 11 = 5",
    "BILBERRY": "org_id % 11 = 6", "QUINZE": "org_id % 10 = 3", "ELDERBERRIES": "org_id % 10 = 4",
    "GUAVA": "org_id % 6 = 0", "FIG": "org_id % 4 = 0", "BLACKBERRY": "org_id % 12 = 7",
    "PLANTAIN": "org_id % 5 = 2", "COCONUT": "org_id % 9 = 2", "ORANGE": "org_id % 7 = 0",
    "GREEN": "org_id % 5 = 0", "LIME": "org_id % 8 = 1", "PITAYA": "org_id % 13 = 2",
    "PERSIMMON": "org_id % 13 = 4",
}

PATIENT = {
    "patient_id": "c_custkey",
    "org_id": "c_nationkey",
    "mrn": "concat('MRN', c_custkey)",
    "name_last": "concat('L', c_custkey % 120)",
    "name_first": "concat('F', c_custkey % 40)",
    "name_middle": "case when c_custkey % 3 = 0 then null else concat('M', c_custkey % 7) end",
    "birth_date": birth("c_custkey"),
    "sex": "case c_mktsegment when 'BUILDING' then 'F' when 'MACHINERY' then 'M' "
           "when 'HOUSEHOLD' then 'X' when 'FURNITURE' then 'U' else 'Q' end",
    "phone": "case when c_custkey % 5 = 0 then '' else concat('269571', 1000 + c_custkey % 9000) end",
    "email": "case when c_custkey % 4 = 0 then '' else concat('p', c_custkey, '@example.org') end",
    "line1": "concat(c_custkey % 999, ' Main Street')",
    "line2": "''",
    "city": "concat('City', c_custkey % 60)",
    "state": "case when c_custkey % 17 = 0 then '' else 'MI' end",
    "zip": "concat(10000 + c_custkey % 89, '-1234')",
    "country": "'USA'",
    "county": "concat('K', c_custkey % 9)",
    "race": "case when c_custkey % 6 = 0 then 'OLD-1' when c_custkey % 6 = 1 then '' else '2106-3' end",
    "ethnicity": "case when c_custkey % 7 = 0 then '' when c_custkey % 7 = 1 then 'OLD-2' else '2186-5' end",
    "birth_flag": "case when c_custkey % 20 = 0 then 'Y' when c_custkey % 20 = 1 then 'N' else '' end",
    "birth_order": "case when c_custkey % 40 = 0 then '2' when c_custkey % 40 = 20 then 'B' else '' end",
    "mother_maiden": "concat('MM', c_custkey % 50)",
    "guardian_last": "concat('G', c_custkey % 70)",
    "guardian_first": "case when c_custkey % 8 = 0 then '' else concat('H', c_custkey % 30) end",
    "guardian_relationship": "case c_custkey % 5 when 0 then 'MTH' when 1 then 'FTH' when 2 then '' when 3 then 'QQQ' else 'GRD' end",
    "reported_date": "cast(date '1995-01-01' + cast(c_custkey % 2000 as int) as date)",
    "reported_ts": f"case when c_custkey % 3 = 1 then {ASKED} - interval '1' second * (c_custkey % 120) "
                   "else cast(cast(date '1995-01-01' + cast(c_custkey % 2000 as int) as date) as timestamp) end",
    "lon": "cast(c_custkey % 300 - 7450 as double) / 100",
    "lat": "cast(c_custkey % 250 + 1750 as double) / 100",
}

VACCINATION = {
    "msg_id": "l_orderkey",
    "order_no": "l_linenumber",
    "vr_id": "l_orderkey * 10 + l_linenumber",
    "vr_link": "concat(l_orderkey, '.', l_linenumber)",
    "patient_id": "o_custkey",
    "administered_date": "cast(l_shipdate as date)",
    "reported_date": "cast(o_orderdate as date)",
    "cvx": pick("l_partkey % 12", *CVX),
    "ndc": "concat('NDC-', l_partkey % 30)",
    "cpt": "concat('CPT-', l_partkey % 16)",
    "lot": "concat('LOT', l_suppkey % 50)",
    "amount": "cast(l_quantity as string)",
    "info_source": "case l_returnflag when 'N' then '00' when 'A' then '01' else '' end",
    "refusal_code": "case when l_returnflag = 'R' then '00' else '' end",
    "completion_status": "case when l_returnflag = 'R' then 'RE' when l_linestatus = 'O' then 'CP' else '' end",
    "action_code": "case when l_discount >= 0.095 then 'D' else 'A' end",
    "mvx": "case l_suppkey % 3 when 0 then 'MSD' when 1 then 'PFR' else 'QQQ' end",
    "body_route": "case l_suppkey % 4 when 0 then 'C28161' when 1 then 'C38299' when 2 then '' else 'XROUTE' end",
    "body_site": "case l_suppkey % 3 when 0 then 'LA' when 1 then 'RA' else '' end",
    "facility_id": "l_suppkey",
    "part_id": "l_partkey",
    "tie_price": "cast(round(l_extendedprice * 100) as bigint)",
}

OBSERVATION = {
    "obs_id": "event_id",
    "patient_id": "user_id",
    "observation_date": "cast(ts as date)",
    "identifier_code": "case event_type when 'error' then '30945-0' when 'click' then '64994-7' "
                       "when 'view' then '30963-3' when 'signup' then '30956-7' else '59784-9' end",
    "value_code": "concat('V', event_id % 9)",
    "value_table": "case when event_id % 2 = 0 then 'TBL' else '' end",
    "value_num": "value",
    "value_json": "props",
    "vaccination_ref": "case when event_id % 4 = 0 then null else event_id % 50 end",
}

CASE_ROW = {
    "country_region": pick("user_id % 3", "'Brazil'", "'US'", "'Haiti'"),
    "Date": "concat(month(ts), '/', day(ts), '/', year(ts))",
    "cases": "value",
}

SESSION = {
    "center_id": "s_suppkey",
    "name": "s_name",
    "district_id": "s_nationkey",
    "pincode": "834000 + s_suppkey % 10",
    "fee_type": "case when s_suppkey % 2 = 0 then 'Free' else 'Paid' end",
    "session_date": "cast(l_shipdate as date)",
    "available_capacity": "cast(l_quantity as int)",
    "min_age_limit": "case when l_linenumber % 2 = 0 then 18 else 45 end",
}

QUERY = {
    "query_id": "event_id",
    "profile": "case when event_id % 50 = 0 then 'Z99' when event_id % 2 = 0 then 'Z34' else 'Z44' end",
    "q_mrn": "case when event_id % 5 = 0 then concat('MRN', user_id) else '' end",
    "q_last": "case when event_id % 11 = 0 then '' else concat('L', user_id % 120) end",
    "q_first": "concat('F', (case when event_id % 3 = 0 then user_id + 1 else user_id end) % 40)",
    "q_middle": "concat('M', event_id % 7)",
    "q_birth": birth("user_id"),
    "q_sex": pick("event_id % 3", "'F'", "'m'", "''"),
    "q_org": "cast(case when event_id % 5 = 0 then event_id % 25 else user_id % 25 end as int)",
    "rcp": "case when event_id % 13 = 0 then 'x' else cast(event_id % 25 as string) end",
    "qpd_line": "concat('QPD|Z34^Request Immunization History^CDCPHINVS|', event_id, '|', "
                "case when event_id % 5 = 0 then concat('MRN', user_id) else '' end, '^^^^MR')",
}

FORECAST = {  # k = 1..2 per customer
    "patient_id": "c_custkey",
    "forecast_no": "k",
    "vaccine_cvx": pick("(c_custkey + k) % 5", "'03'", "'08'", "'10'", "'20'", "'62'"),
    "label": pick("(c_custkey + k) % 5", "'MMR'", "'HepB'", "'Polio'", "'DTaP'", "'HPV'"),
    "admin_status": pick("(c_custkey + k) % 4", "'D'", "'L'", "'O'", "'C'"),
    "admin_label": pick("(c_custkey + k) % 4", "'due'", "'due later'", "'overdue'", "'complete'"),
    "valid_date": "cast(date '2002-01-01' + cast((c_custkey + k) % 100 as int) as date)",
    "due_date": "case when (c_custkey + k) % 4 = 3 then null else cast(date '2002-02-01' + cast((c_custkey + k) % 100 as int) as date) end",
    "overdue_date": "cast(date '2002-06-01' + cast((c_custkey + k) % 100 as int) as date)",
}

LOCATION = {  # facilities FAC0..FAC39 are known to the orgs 0..24
    "org_id": "cast(s_suppkey % 25 as int)",
    "facility_code": "concat('FAC', s_suppkey % 40)",
}

MOVEMENT = {
    "center": "l_suppkey",
    "product": "l_partkey % 12",
    "day": "cast(l_shipdate as date)",
    "qty": "cast(l_quantity as bigint)",
    "kind": "case l_returnflag when 'N' then 'ordered' when 'A' then 'administered' else 'wasted' end",
}

IMAGERY = {
    "layer_id": "p_partkey",
    "name": "concat(p_brand, ' ', p_partkey)",
    "credit": "concat('Copyright ', p_type)",
    "date_text": pick(
        "p_partkey % 5",
        "concat('2010/01/', 10 + p_partkey % 18)",
        "concat('2010/01/', 10 + p_partkey % 18, '-2010/01/', 11 + p_partkey % 18)",
        "concat('2010/01/', 10 + p_partkey % 18, ' (More Imagery added on 2010/01/21)')",
        "'Various'",
        "concat('2010/01/', 10 + p_partkey % 18)"),
    "resolution_text": pick("p_partkey % 7", "'0.15'", "'1M'", "'1M/pixel'", "'2.5'", "'?'", "'Various'",
                            "concat('0.', 10 + p_size)"),
}

# Product codes of the fixtures: NDC-0..NDC-26 and three quarters of the CPT
# codes are known; some are deprecated, some have no CVX relation.
PRODUCT_CODES = (
    "select distinct 'VACCINATION_NDC_CODE' as codeset, concat('NDC-', p_partkey % 30) as value, "
    "concat('Product ', p_partkey % 30) as label, 'VALID' as status, "
    "case when p_partkey % 30 in (3, 13, 23) then concat('NDC-', p_partkey % 30 + 1) end as new_value "
    "from part where p_partkey % 30 < 27 union all "
    "select distinct 'VACCINATION_CPT_CODE', concat('CPT-', p_partkey % 16), concat('Procedure ', p_partkey % 16), "
    "'VALID', cast(null as string) from part where p_partkey % 4 <> 3")
PRODUCT_RELATIONS = (
    "select distinct 'VACCINATION_NDC_CODE' as from_set, concat('NDC-', p_partkey % 30) as from_value, "
    + pick("(p_partkey % 30) % 11", *CVX[:11]) + " as to_cvx from part where (p_partkey % 30) % 7 <> 0 union all "
    "select distinct 'VACCINATION_CPT_CODE', concat('CPT-', p_partkey % 16), "
    + pick("(p_partkey % 16) % 11", *CVX[:11]) + " from part where p_partkey % 4 <> 2")

# ---------------------------------------------------------------- HL7 messages
# One message per row of orders; the orders / observations / relatives inside a
# message follow by arithmetic from (msg_id, k, j), so the text is a projection.

MESSAGE = {
    "msg_id": "o_orderkey",
    "custkey": "o_custkey",
    "org_id": "cast(o_custkey % 25 as int)",
    "received_date": "cast(o_orderdate as date)",
    "msg_type": "case when o_orderkey % 97 = 3 then 'ADT' when o_orderkey % 10 = 9 then 'QBP' "
                "when o_orderkey % 10 = 8 then 'ORU' else 'VXU' end",
    "facility": "case when o_orderkey % 4 = 1 then 'OTHER' else concat('NATION_', o_custkey % 25) end",
    "control_id": "case when o_orderkey % 53 = 7 then '' else concat('C', o_orderkey) end",
    "n_msh": "case when o_orderkey % 101 = 5 then 2 when o_orderkey % 103 = 6 then 0 else 1 end",
    "eff_type": "case when o_orderkey % 101 <> 5 and o_orderkey % 103 = 6 then '' when o_orderkey % 97 = 3 then 'ADT' "
                "when o_orderkey % 10 = 9 then 'QBP' when o_orderkey % 10 = 8 then 'ORU' else 'VXU' end",
    "profile": pick("o_orderkey % 30", *(["'Z22'"] * 9), "'Z34'", *(["'Z22'"] * 9), "'Z44'", "'Z99'"),
    "has_pid": "o_orderkey % 41 <> 2",
    "id_type": "case when o_orderkey % 43 = 4 then 'XX' when o_orderkey % 3 = 0 then 'MR' "
               "when o_orderkey % 3 = 1 then 'PT' else 'PI' end",
    "mrn": "concat('MRN', o_custkey)",
    "authority": "concat('AUTH', o_custkey % 25)",
    "name_last": "case when o_orderkey % 47 = 6 then '' else concat('L', o_custkey % 120) end",
    "name_first": "case when o_orderkey % 59 = 8 then '' else concat('F', o_custkey % 40) end",
    "name_middle": "case when o_custkey % 3 = 0 then '' else concat('M', o_custkey % 7) end",
    "mother_maiden": "concat('MM', o_custkey % 50)",
    "birth_text": f"case when o_orderkey % 61 = 9 then '20210230' when o_orderkey % 67 = 10 then '20991231' "
                  f"when o_orderkey % 71 = 11 then '' else {ymd(birth('o_custkey'))} end",
    "sex": pick("o_orderkey % 7", "'F'", "'M'", "'X'", "'U'", "''", "'Q'", "'F'"),
    "race": pick("o_orderkey % 8", "'2106-3'", "'2106-3'", "'2106-3'", "'2054-5'", "'2054-5'", "''", "'9999-9'", "'OLD-1'"),
    "race2": "case when o_orderkey % 6 = 0 then '2028-9' else '' end",
    "ethnicity": pick("o_orderkey % 9", "''", "'BAD'", "'OLD-2'", "'2186-5'"),
    "line1": "case when o_orderkey % 51 = 7 then ' Lead' when o_orderkey % 13 = 1 then '' "
             "else concat(o_custkey % 999, ' Main Street') end",
    "city": "concat('City', o_custkey % 60)",
    "state": pick("o_orderkey % 17", "'MI'", "'QQ'", "''", "'MA'"),
    "zip": "concat(10000 + o_custkey % 89, '-1234')",
    "country": pick("o_orderkey % 19", "''", "'ZZZ'", "'CAN'", "'MX'", "'USA'"),
    "county": "concat('K', o_custkey % 9)",
    "phone_use": "case when o_orderkey % 7 = 3 then 'ORN' else 'PRN' end",
    "phone_area": "case when o_custkey % 5 = 0 then '' when o_custkey % 31 = 3 then '555' else '269' end",
    "phone_local": "case when o_custkey % 5 = 0 then '' when o_custkey % 23 = 1 then '571x805' "
                   "when o_custkey % 29 = 2 then '57-138' else concat('571', 1000 + o_custkey % 9000) end",
    "email": "case when o_custkey % 2 = 0 then '' else concat('p', o_custkey, '@example.org') end",
    "birth_flag": pick("o_orderkey % 12", "'Y'", "'N'", "'Z'", "''"),
    "birth_order": pick("o_orderkey % 15", "'1'", "'2'", "'0'", "''"),
    "death_text": "case when o_orderkey % 73 = 12 then '20210230' when o_orderkey % 74 = 13 then '20000101' else '' end",
    "death_flag": "case when o_orderkey % 74 = 13 then 'Y' else '' end",
    "has_pd1": "o_orderkey % 4 <> 0",
    "protection_text": "case when o_orderkey % 37 = 1 then '2021' else '20010101' end",
    "registry_text": "case when o_orderkey % 39 = 1 then 'BAD' else '20010102120000' end",
    "publicity_text": "case when o_orderkey % 33 = 1 then '20011301' else '20010103' end",
    "n_nk1": "cast(o_orderkey % 4 as int)",
    "n_orders": "cast(1 + o_orderkey % 5 as int)",
    "has_qpd": "o_orderkey % 90 <> 89",
    "rcp": pick("o_orderkey % 4", "'5^RD'", "'x'", "''", "'30'"),
}

NK1 = {  # k = 1..n_nk1
    "relationship": pick("(msg_id + k) % 6", "'MTH'", "'SIB'", "''", "'FTH'", "'OTH'", "'GRD'"),
    "nk_last": "(case when (msg_id + k * 3) % 14 = 0 then '' else concat('N', (custkey + k) % 50) end)",
    "nk_first": "(case when (msg_id + k * 5) % 16 = 0 then '' else concat('P', (custkey + k) % 30) end)",
    "nk_middle": "concat('Q', (custkey + k) % 3)",
}

ORDER = {  # k = 1..n_orders
    "vr_link": "(case when (msg_id * 7 + k) % 83 = 0 then '' else concat(custkey, '.', msg_id % 3, '.', k) end)",
    "has_rxa": "((msg_id + 13 * k) % 89 <> 5)",
    "has_obr": "((msg_id + 13 * k) % 37 <> 5)",
    "code1": "(case when (msg_id + k) % 79 = 0 then '' when (msg_id + k) % 31 = 1 then '998' "
             "when (msg_id + k) % 6 = 0 then concat('NDC-', (msg_id * 3 + k) % 30) "
             "when (msg_id + k) % 9 = 1 then concat('CPT-', (msg_id + k * 2) % 16) "
             f"when (msg_id + k) % 83 = 2 then 'ZZZ' else {pick('(msg_id * 3 + k) % 11', *CVX[:11])} end)",
    "type1": "(case when (msg_id + k) % 79 = 0 then 'CVX' when (msg_id + k) % 31 = 1 then 'CVX' "
             "when (msg_id + k) % 6 = 0 then 'NDC' when (msg_id + k) % 9 = 1 then 'C4' else 'CVX' end)",
    "code2": "(case when (msg_id + k) % 31 = 1 then '' when (msg_id + k) % 12 = 0 then '08' "
             "when (msg_id + k) % 4 = 1 then concat('NDC-', (msg_id + k) % 30) else '' end)",
    "type2": "(case when (msg_id + k) % 31 = 1 then '' when (msg_id + k) % 12 = 0 then 'CVX' "
             "when (msg_id + k) % 4 = 1 then 'NDC' else '' end)",
    "admin_text": "(case when (msg_id + k) % 91 = 3 then '' when (msg_id + k) % 93 = 4 then '20210230' "
                  "when (msg_id + k) % 95 = 5 then '20991231' "
                  "when (msg_id + k) % 89 = 6 then '19400101' "
                  f"else {ymd('cast(received_date - cast((msg_id * k) % 400 as int) as date)')} end)",
    "amount": pick("(msg_id + k) % 5", "''", "'999'", "'abc'", "'0.5'"),
    "info_source": pick("(msg_id + k) % 3", "'00'", "'01'", "''"),
    "lot": "concat('LOT', (msg_id + k) % 40)",
    "expiration_text": "(case when (msg_id + k) % 33 = 1 then 'BAD' when (msg_id + k) % 3 = 1 then '' else '20301231' end)",
    "mvx": pick("(msg_id + k) % 3", "'MSD'", "'PFR'", "'QQQ'"),
    "refusal_code": pick("(msg_id + k) % 21", "'00'", "'XX'", "''"),
    "completion_status": pick("(msg_id + k) % 8", "'RE'", "''", "'PA'", "'NA'", "'CP'"),
    "action_code": "(case when (msg_id + k) % 16 = 0 then 'D' else 'A' end)",
    "has_rxr": "((msg_id + k) % 4 <> 2)",
    "body_route": pick("(msg_id + k) % 3", "'C28161'", "'C38299'", "''"),
    "body_site": pick("(msg_id + k) % 5", "'LA'", "'RA'", "''"),
    "facility_code": "(case when (msg_id + k) % 10 = 0 then '' else concat('FAC', (msg_id + k) % 60) end)",
    "facility_city": "concat('Town', (msg_id + k) % 60)",
    "provider_code": "(case when (msg_id + k) % 7 = 0 then '' else concat('PRV', (msg_id + k) % 45) end)",
    "provider_last": "concat('DR', (msg_id + k) % 45)",
    "n_obx": "cast((msg_id + k) % 3 as int)",
}

OBX = {  # j = 1..n_obx inside order k
    "identifier_code": pick("(msg_id + k + j) % 6", "'30945-0'", "'64994-7'", "'30963-3'", "'59784-9'", "'29768-9'", "'TPG_TIER'"),
    "value_code": "(case (msg_id + k + j) % 6 "
                  f"when 0 then {pick('(msg_id + k + j) % 4', chr(39) + 'BADC' + chr(39), chr(39) + 'VXC18' + chr(39))} "
                  "when 1 then (case when (msg_id + k + j) % 5 = 0 then 'V99' else 'V05' end) "
                  "when 2 then (case when (msg_id + k + j) % 5 = 0 then 'QQQ' else 'VXC50' end) "
                  "else concat('VAL', (msg_id + k + j) % 9) end)",
    "obs_text": "(case when (msg_id + k + j) % 17 = 0 then 'BAD' when (msg_id + k + j) % 19 = 0 then '20991231' "
                "when (msg_id + k + j) % 22 = 0 then '19000101' when (msg_id + k + j) % 5 = 0 then '' "
                f"else {ymd('received_date')} end)",
}


def _line(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _put(text: str, values: dict[str, str]) -> str:
    """``text`` with ``values`` for their names, outside of literals."""
    return re.sub(r"'[^']*'|\b[a-z]\w*", lambda found: values.get(found[0], found[0]), text)


def _written_out(count: str, least: int, most: int, name: str, line: str, otherwise: str | None = None) -> str:
    """The lines for ``name`` = 1..``count``, one expression each: Spark compiles these, and interprets a lambda for every row.

    ``otherwise`` gives the text when ``count`` is not in ``least``..``most``; without it ``count`` is at most ``most``.
    """
    lines = [f"case when {count} >= {i} then {_put(line, {name: str(i)})} end" for i in range(1, most + 1)]
    text = f"concat_ws(char(13), {', '.join(lines)})"
    return f"case when {count} between {least} and {most} then {text} else {otherwise} end" if otherwise else text


def message_text() -> str:
    """Spark SQL expression over the columns TEXT_FROM that writes the HL7 text."""
    m, o, x, n = MESSAGE, ORDER, OBX, NK1
    msh = _line("'MSH|^~\\\\&|EHR|'", "facility", "'|REG|IIS|20010101||'", "msg_type", "'^V04|'", "control_id",
                "'|P|2.5.1|||||||||'", "profile", "'^CDCPHINVS'")
    pid = _line("'PID|1||9^^^Z^ZZ~'", "mrn", "'^^^'", "authority", "'^'", "id_type", "'||'", "name_last", "'^'",
                "name_first", "'^'", "name_middle", "'^^^^L|'", "mother_maiden", "'^^^^^^M|'", "birth_text", "'|'",
                "sex", "'||'", "race", "'^R^CDCREC~'", "race2", "'|'", "line1", "'^^'", "city", "'^'", "state", "'^'",
                "zip", "'^'", "country", "'^P^^'", "county", "'||^'", "phone_use", "'^PH^^^'", "phone_area", "'^'",
                "phone_local", "'~^NET^^'", "email", "'|||||||||'", "ethnicity", "'||'", "birth_flag", "'|'",
                "birth_order", "'||||'", "death_text", "'|'", "death_flag")
    pd1 = _line("'PD1|||||||||||02|N|'", "protection_text", "'|||A|'", "registry_text", "'|'", "publicity_text")
    nk1 = _line("'NK1|'", "k", "'|'", n["nk_last"], "'^'", n["nk_first"], "'^'", n["nk_middle"], "'^^^^L|'",
                n["relationship"], "'^R^HL70063'")
    obx = _line("'OBX|'", "j", "'|CE|'", x["identifier_code"], "'^Lbl^LN|1|'", x["value_code"],
                "'^VLbl^TBL||||||F||'", "'|'", x["obs_text"], "'|||VXC40^Method^CDCPHINVS'")
    rxa = _line("'RXA|0|1|'", o["admin_text"], "'||'", o["code1"], "'^Text^'", o["type1"], "'^'", o["code2"], "'^Text^'",
                o["type2"], "'|'", o["amount"], "'|mL||'", o["info_source"], "'^I^NIP001|'", o["provider_code"], "'^'",
                o["provider_last"], "'^First^M|^^^'", o["facility_code"], "'^^^^^1 Way^^'", o["facility_city"],
                "'^MI^49000^USA||||'", o["lot"], "'|'", o["expiration_text"], "'|'", o["mvx"], "'^M^MVX|'",
                o["refusal_code"], "'^X^NIP002||'", o["completion_status"], "'|'", o["action_code"])
    rxr = _line("'RXR|'", o["body_route"], "'^Route^NCIT|'", o["body_site"], "'^Site^HL70163'")
    head = ("concat_ws(char(13), "
            + _line("'ORC|RE||'", o["vr_link"], "'^ORG'")
            + f", case when msg_type = 'ORU' then (case when {o['has_obr']} then 'OBR|1' end)"
            + f" when {o['has_rxa']} then {rxa} end"
            + f", case when msg_type <> 'ORU' and {o['has_rxa']} and {o['has_rxr']} then {rxr} end, ")
    order = head + f"array_join(transform(filter(sequence(0, {o['n_obx']}), j -> j > 0), j -> {obx}), char(13)))"
    relatives = _written_out("n_nk1", 0, 3, "k", nk1, f"array_join(transform(filter(sequence(0, n_nk1), k -> k > 0), k -> {nk1}), char(13))")
    orders = _written_out("n_orders", 1, 5, "k", head + _written_out(o["n_obx"], 0, 2, "j", obx) + ")",
                          f"array_join(transform(sequence(1, n_orders), k -> {order}), char(13))")
    qpd = _line("'QPD|'", "profile", "'^Q^CDCPHINVS|'", "msg_id", "'|'", "mrn", "'^^^'", "authority", "'^'", "id_type",
                "'|'", "name_last", "'^'", "name_first", "'^'", "name_middle", "'|'", "mother_maiden", "'|'",
                "birth_text", "'|'", "sex", "'|'", "line1")
    update = ("concat_ws(char(13), case when n_msh = 2 then " + msh + " end, case when n_msh > 0 then " + msh + " end, case when has_pid then " + pid
              + " end, case when has_pd1 then " + pd1
              + " end, " + relatives + ", " + orders + ")")
    query = ("concat_ws(char(13), case when n_msh = 2 then " + msh + " end, case when n_msh > 0 then " + msh + " end, case when has_qpd then " + qpd + " end, concat('RCP|I|', rcp))")
    return _from_keys(f"case when msg_type = 'QBP' then {query} else {update} end")


#: Columns a message's text is written from. Its other fields are expressions inside the text: as columns of one projection they
#: make a generated method above 8,000 bytes, which the JVM never compiles.
TEXT_FROM = ["msg_id", "custkey", "org_id", "received_date", "msg_type", "n_msh", "n_nk1", "n_orders"]


def _from_keys(text: str) -> str:
    """Puts the expressions of MESSAGE for the names in ``text`` that are not in TEXT_FROM."""
    fields = {n: f"({e})".replace("o_orderkey", "msg_id").replace("o_custkey", "custkey") for n, e in MESSAGE.items() if n not in TEXT_FROM}
    return _put(text, fields)


# ------------------------------------------------------------------ Spark side

class Registry:
    """The fixture tables of one scale-factor directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(rows) if name in ("events", "lineitem", "orders") else rows

    @staticmethod
    def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return df.selectExpr(*[f"{expr} as {name}" for name, expr in columns.items()])

    def orgs(self) -> DataFrame:
        nation = self.table("nation").selectExpr("n_nationkey as org_id", "n_name as org_name", "n_regionkey")
        region = self.table("region").selectExpr("r_regionkey as n_regionkey", "r_name as region_name")
        flags = ", ".join(f"case when {cond} then '{name}' end" for name, cond in FLAVOR_RULES.items())
        return (nation.join(region, "n_regionkey").drop("n_regionkey")
                .withColumn("flavors", F.expr(f"filter(array({flags}), f -> f is not null)")))

    def patients(self) -> DataFrame:
        return self.project(self.table("customer"), PATIENT)

    def vaccinations(self, people: DataFrame | None = None) -> DataFrame:
        """The doses; with ``people`` (unique by ``patient_id``) also the other columns of their patient.

        Patients join the orders, which are fewer and narrower than the doses.
        """
        lines = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")
        orders, kept = self.table("orders"), []
        if people is not None:
            kept = [c for c in people.columns if c != "patient_id"]
            orders = orders.join(people.withColumnsRenamed({c: f"p_{c}" for c in people.columns}), F.col("o_custkey") == F.col("p_patient_id"))
        joined = lines.repartition(tasks_for(lines), "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return self.project(joined, VACCINATION | {c: f"p_{c}" for c in kept})

    def observations(self) -> DataFrame:
        return self.project(self.table("events"), OBSERVATION)

    def cases(self) -> DataFrame:
        return self.project(self.table("events"), CASE_ROW)

    def sessions(self) -> DataFrame:
        joined = self.table("lineitem").join(
            self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return self.project(joined, SESSION)

    def queries(self) -> DataFrame:
        return self.project(self.table("events"), QUERY)

    def forecasts(self) -> DataFrame:
        twice = self.table("customer").selectExpr("c_custkey", "explode(sequence(1, 2)) as k")
        return self.project(twice, FORECAST)

    def movements(self) -> DataFrame:
        return self.project(self.table("lineitem"), MOVEMENT)

    def codes(self) -> DataFrame:
        return self._from_part(PRODUCT_CODES).unionByName(C.seed_codes(self.spark))

    def relations(self) -> DataFrame:
        return self._from_part(PRODUCT_RELATIONS)

    def _from_part(self, text: str) -> DataFrame:
        """A code table, written: from ``part`` itself Spark expects a large one, and sorts and shuffles what is looked up in it."""
        return stage(self.spark.sql(text.replace("from part ", "from {part} "), part=self.table("part")), "part-codes")

    def valid_values(self) -> DataFrame:
        return C.seed_valid_values(self.spark)

    def locations(self) -> DataFrame:
        return stage(self.table("supplier").selectExpr(*[f"{e} as {n}" for n, e in LOCATION.items()]).distinct(), "locations")

    def imagery(self) -> DataFrame:
        return self.project(self.table("part"), IMAGERY)

    def messages(self) -> DataFrame:
        return message_table(dealt(self.spark.read.parquet(f"{self.sf_dir}/orders.parquet")))


def spread(df: DataFrame) -> DataFrame:
    """Spreads a table that arrives in fewer splits than there are cores.

    Large tables have more splits than that and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tasks per split of a table whose rows become messages or events: their text is some 30 times the row's stored bytes.
TASKS_A_SPLIT = 16


def tasks_for(df: DataFrame) -> int:
    """Number of tasks for rows that become texts; it grows with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, TASKS_A_SPLIT * df.rdd.getNumPartitions())


def dealt(df: DataFrame) -> DataFrame:
    """Deals rows that become messages evenly over tasks, whatever the row groups of the file.

    A split holds whole row groups, so a file of few large ones has splits without rows. The tasks grow with the table.
    """
    return df.select("o_orderkey", "o_custkey", "o_orderdate").repartition(tasks_for(df))


def message_table(orders: DataFrame) -> DataFrame:
    """orders rows -> (msg_id, org_id, received_date, message); batch or stream."""
    return (Registry.project(orders, {n: MESSAGE[n] for n in TEXT_FROM})
            .select("msg_id", "org_id", "received_date", F.expr(message_text()).alias("message")))


# ---------------------------------------------------------------- oracle side

def _select(columns: dict[str, str], source: str) -> str:
    return "select " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + " from " + source


def _flags() -> str:
    return ", ".join(f"({cond}) as f_{name.lower()}" for name, cond in FLAVOR_RULES.items())


CTES = {
    "fx_org": f"select *, {_flags()} from (select n_nationkey as org_id, n_name as org_name, r_name as region_name "
              "from nation join region on n_regionkey = r_regionkey) t",
    "fx_patient": _select(PATIENT, "customer"),
    "fx_vaccination": _select(VACCINATION, "lineitem join orders on l_orderkey = o_orderkey"),
    "fx_observation": _select(OBSERVATION, "events"),
    "fx_case": _select(CASE_ROW, "events"),
    "fx_session": _select(SESSION, "lineitem join supplier on l_suppkey = s_suppkey"),
    "fx_query": _select(QUERY, "events"),
    "fx_forecast": _select(FORECAST, "(select c_custkey, unnest(generate_series(1, 2)) as k from customer) t"),
    "fx_movement": _select(MOVEMENT, "lineitem"),
    "fx_imagery": _select(IMAGERY, "part"),
    "fx_location": "select distinct " + ", ".join(f"{e} as {n}" for n, e in LOCATION.items()) + " from supplier",
    "code": f"{PRODUCT_CODES} union all {C.codes_sql()}",
    "code_rel": PRODUCT_RELATIONS,
    "valid_value": C.valid_values_sql(),
    "loinc": C.loinc_sql(),
    "family": C.family_sql(),
    "schedule": C.schedule_sql(),
    "fxm": _select(MESSAGE, "orders"),
    "fxo": "select *, " + ", ".join(f"{e} as {n}" for n, e in ORDER.items())
           + " from (select fxm.*, unnest(generate_series(1, n_orders)) as k from fxm) t",
    "fxx": "select *, " + ", ".join(f"{e} as {n}" for n, e in OBX.items())
           + " from (select msg_id, custkey, org_id, received_date, eff_type, mrn, k, vr_link, n_obx, code1, has_rxa, has_obr,"
             " unnest(generate_series(1, n_obx)) as j from fxo) t",
    "fxn": "select *, " + ", ".join(f"{e} as {n}" for n, e in NK1.items())
           + " from (select fxm.*, unnest(generate_series(1, n_nk1)) as k from fxm) t",
}
CTE_NEEDS = {"fxo": ["fxm"], "fxx": ["fxm", "fxo"], "fxn": ["fxm"]}


def with_ctes(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named fixture CTEs and then the extra ones."""
    extra = extra or {}
    ordered: list[str] = []
    for name in names.split():
        for need in [*CTE_NEEDS.get(name, []), name]:
            if need not in ordered:
                ordered.append(need)
    parts = [f"{n} as ({CTES[n]})" for n in ordered]
    parts += [f"{n} as ({sql})" for n, sql in extra.items()]
    return ("with " + ", ".join(parts) + " " if parts else "") + body
