"""Message structuring: HL7 v2 text -> segment, patient, order, observation rows.

A message is one row and its text is cut where an ORC starts, which gives the
order groups without a window: every operator here is a projection (plus an
explode inside the message), with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import hl7text as h

KEYS = ["msg_id", "org_id", "received_date", "flavors", "org_name", "strict"]
ID_TYPES = ["MR", "PT", "PI"]
GUARDIANS = "('MTH', 'FTH', 'GRD')"
HEADER = ["n_msh", "fault", "msg_type", "sending_app", "sending_facility", "receiving_app", "control_id", "processing_id", "profile"]


def _keys(df: DataFrame) -> list[str]:
    return [c for c in KEYS if c in df.columns]


def _as(columns: dict[str, str]) -> list[str]:
    return [f"{expr} as {name}" for name, expr in columns.items()]


def keep(df: DataFrame, condition: str) -> DataFrame:
    """Filter that stays above the parse.

    A plain filter on parsed columns would be moved below the projections and
    parse every text a second time; on the output of an explode it stays here.
    """
    return (df.selectExpr("*", f"explode_outer(case when {condition} then array(true) end) as __keep")
            .where("__keep").drop("__keep"))


def segments(messages: DataFrame) -> DataFrame:
    """(msg_id, pos, order_no, segment, line, fields); order_no 0 is the header."""
    marked = (f"flatten(transform({h.order_chunks(h.normalised('message'))}, (c, i) -> transform(filter(split(c, '\\r'), s -> s <> ''), "
              "s -> named_struct('order_no', i, 'line', s))))")
    return (messages.selectExpr("msg_id", f"posexplode_outer({marked}) as (p, s)")
            .where("p is not null")
            .selectExpr("msg_id", "p + 1 as pos", "s.order_no as order_no", "substring_index(s.line, '|', 1) as segment",
                        "s.line as line", f"{h.split_fields('s.line')} as fields"))


#: Characters of the largest message that is taken apart.
MOST_CHARS = 10 << 20


#: Characters no text message holds. Listed one by one, Java looks them up in a table; ranges are tested one after another.
CONTROL = "".join(f"\\\\x{c:02X}" for c in [*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F])


#: A text of CRs and whole segments without control characters or U+FFFD, which also stands for bytes that are no UTF-8: one pass
#: without a loop over alternatives. What is not clean is looked at further, so this may be narrower than the faults, not wider.
CLEAN = f"\\\\A(?:\\r(?:[A-Z][A-Z0-9]{{2}}(?:\\\\|[^\\r{CONTROL}\\\\x{{FFFD}}]*)?)?)*+\\\\z"


def fault() -> str:
    """Why a message cannot be taken apart, over ``message`` (normalised), ``clean``, ``single``, ``msh`` and ``n_msh``; NULL when it can."""
    nested = f"not single and {h.occurrences('message', chr(39) + 'MSH|^~' + chr(39), 6)} > n_msh"
    return ("case when coalesce(n_msh, 0) = 0 and coalesce(replace(message, '\\r', ''), '') = '' then 'empty' "
            f"when not clean and (not is_valid_utf8(message) or contains(message, '\uFFFD') or message rlike '[{CONTROL}]') then 'binary' "
            f"when n_msh = 0 then 'no header' when {nested} then 'nested header' "
            f"when octet_length(message) > {MOST_CHARS} and length(message) > {MOST_CHARS} then 'too large' "
            "when size(msh) < 12 then 'truncated header' "
            "when not clean and message rlike '\\r(?![A-Z][A-Z0-9]{2}(\\\\||\\r|$))[^\\r]' then 'broken segment' end")


def parse(messages: DataFrame) -> DataFrame:
    """One row per message: keys, MSH columns, the normalised text and its ``fault``."""
    keys = _keys(messages)
    return (messages.selectExpr(*keys, f"{h.normalised('message')} as message")
            .selectExpr(*keys, "message", f"{h.split_fields(h.segment_line('message', 'MSH'))} as msh",
                                f"{h.one_header('message')} as single", f"message rlike '{CLEAN}' as clean")
            .selectExpr("*", f"case when single then 1 else {h.segment_count('message', 'MSH')} end as n_msh")
            .selectExpr(*keys, "message", "coalesce(n_msh, 0) as n_msh", f"{fault()} as fault", *_as({
                "msg_type": h.field("msh", 9, msh=True),
                "sending_app": h.raw_field("msh", 3, msh=True),
                "sending_facility": h.raw_field("msh", 4, msh=True),
                "receiving_app": h.raw_field("msh", 5, msh=True),
                "control_id": h.raw_field("msh", 10, msh=True),
                "processing_id": h.raw_field("msh", 11, msh=True),
                "profile": h.field("msh", 21, msh=True)})))


def route(parsed: DataFrame) -> DataFrame:
    """Adds ``route``: VXU, ORU, QBP or unsupported, from MSH-9."""
    return parsed.selectExpr("*", "case when msg_type in ('VXU', 'ORU', 'QBP') then msg_type else 'unsupported' end as route")


def _first_ids(reps: str, kinds: list[str]) -> list[str]:
    """First repeat of every id kind, as columns ``id_MR``, ``id_PT``, ..."""
    return [f"get(filter({reps}, r -> get(r, 4) = '{t}'), 0) as id_{t}" for t in kinds]


def _identifier(kinds: list[str]) -> dict[str, str]:
    """Id, authority and type of the first kind that carries an id."""
    def first(value):
        return "case " + " ".join(f"when id_{t}[0] <> '' then {value(t)}" for t in kinds) + " else '' end"
    return {"mrn": first(lambda t: f"id_{t}[0]"), "mrn_authority": first(lambda t: h.blank(f"get(id_{t}, 3)")),
            "mrn_type": first(lambda t: f"'{t}'")}


def extract_patients(parsed: DataFrame, *carry: str) -> DataFrame:
    """PID, PD1 and the chosen NK1 of every message as patient columns.

    Dates are read strictly unless a ``strict`` column says otherwise.
    """
    keys = _keys(parsed)
    strict = "strict" if "strict" in keys else "true"
    relative = ", ".join(f"'{n}', {h.field('f', *at)}" for n, at in {
        "last": (2, 1), "first": (2, 2), "middle": (2, 3), "relationship": (3, 1)}.items())
    base = parsed.selectExpr(
        *keys, *HEADER, *carry,
        f"{h.split_fields(h.segment_line('message', 'PID'))} as pid",
        f"{h.split_fields(h.segment_line('message', 'PD1'))} as pd1",
        f"transform({h.segment_lines('message', 'NK1')}, s -> {h.split_fields('s')}) as nk1")
    base = base.selectExpr(
        *keys, *HEADER, *carry, "pid", "pd1", f"{h.repeats('pid', 3)} as ids", f"{h.repeats('pid', 13)} as telecoms", f"split({h.raw_field('pid', 10)}, '~') as races",
        f"transform(nk1, f -> named_struct({relative})) as relatives")
    # The first recognised guardian wins; without one the last relative stays.
    base = base.selectExpr("*", *_first_ids("ids", ID_TYPES), f"coalesce(get(filter(relatives, r -> r.relationship in {GUARDIANS}), 0), "
                                "try_element_at(relatives, -1)) as guardian",
                           f"concat({h.field('pid', 13, 6)}, {h.field('pid', 13, 7)}) as phone_text",
                           f"{h.field('pid', 13, 2)} as phone_use", f"{h.field('pid', 7)} as birth_text",
                           f"{h.field('pid', 29)} as death_text", f"{h.field('pd1', 13)} as protection_text",
                           f"{h.field('pd1', 17)} as registry_text", f"{h.field('pd1', 18)} as publicity_text")
    return base.selectExpr(
        *keys, *HEADER, *carry, "relatives",
        "phone_text", "phone_use", "birth_text", "death_text", "protection_text", "registry_text", "publicity_text",
        *_as({
            "has_pid": "pid is not null", "has_pd1": "pd1 is not null", "has_nk1": "guardian is not null",
            **_identifier(ID_TYPES),
            "name_last": h.field("pid", 5, 1), "name_first": h.field("pid", 5, 2), "name_middle": h.field("pid", 5, 3),
            "mother_maiden": h.field("pid", 6),
            "birth_date": h.parse_date("birth_text", strict),
            "sex": h.field("pid", 8),
            **{"race" if k == 1 else f"race{k}": h.blank(f"substring_index(get(races, {k - 1}), '^', 1)") for k in range(1, 7)},
            "line1": h.field("pid", 11, 1), "line2": h.field("pid", 11, 2), "city": h.field("pid", 11, 3),
            "state": h.field("pid", 11, 4), "zip": h.field("pid", 11, 5), "country": h.field("pid", 11, 6),
            "county": h.field("pid", 11, 9),
            "address_frag": h.address_frag(h.field("pid", 11, 5), h.field("pid", 11, 1)),
            "phone": "case when phone_use = 'PRN' then phone_text else '' end",
            "email": h.find_repeat("telecoms", 4, "NET", 2),
            "ethnicity": h.field("pid", 22), "birth_flag": h.field("pid", 24), "birth_order": h.field("pid", 25),
            "death_date": h.parse_date("death_text", strict), "death_flag": h.field("pid", 30),
            "publicity_ind": h.field("pd1", 11), "protection_ind": h.field("pd1", 12),
            "protection_date": h.parse_date("protection_text", strict),
            "registry_status": h.field("pd1", 16), "registry_date": h.parse_date("registry_text", strict),
            "publicity_date": h.parse_date("publicity_text", strict),
            "guardian_last": h.blank("guardian.last"), "guardian_first": h.blank("guardian.first"),
            "guardian_middle": h.blank("guardian.middle"), "guardian_relationship": h.blank("guardian.relationship"),
        }))


def orders(parsed: DataFrame, *carry: str, only: str = "true") -> DataFrame:
    """One row per ORC group with its ORC, RXA/OBR, RXR fields and OBX lines.

    ``only`` restricts the messages.  It guards the split instead of being a
    filter: a filter would move below the parse and read the text twice.  For
    the same reason the explode is the outer form.  ``obx_before`` counts the
    observations of earlier groups, so the running OBX number needs no window.
    Messages without a group keep one row with a NULL ``order_no``.
    """
    kept = [*_keys(parsed), "msg_type", *carry]
    rows = (parsed.selectExpr(*kept, f"case when {only} then {h.order_chunks('message')} end as parts")
            .selectExpr(*kept, "slice(parts, 2, size(parts)) as chunks")
            .selectExpr(*kept, "chunks", f"transform(chunks, c -> case when msg_type = 'ORU' then {h.segment_count(h.after_segment('c', 'OBR'), 'OBX')} "
                        f"else {h.segment_count(h.after_segment('c', 'RXA'), 'OBX')} end) as counts")
            .selectExpr(*kept, "counts", "posexplode_outer(chunks) as (i, chunk)"))
    oru = "msg_type = 'ORU'"
    rows = rows.selectExpr(
        *kept, "i", "counts", "chunk",
        f"case when {oru} then {h.segment_line('chunk', 'OBR')} else {h.segment_line('chunk', 'RXA')} end as anchor",
        f"case when {oru} then {h.after_segment('chunk', 'OBR')} else {h.after_segment('chunk', 'RXA')} end as after")
    return rows.selectExpr(
        *kept, "i + 1 as order_no", "aggregate(slice(counts, 1, i), 0, (a, x) -> a + x) as obx_before",
        f"{h.split_fields(h.segment_line('chunk', 'ORC'))} as orc", "anchor is not null as has_anchor",
        f"{h.split_fields('anchor')} as rxa", f"{h.split_fields(h.segment_line('after', 'RXR'))} as rxr",
        f"{h.segment_lines('after', 'OBX')} as obx")


def _code_slots() -> dict[str, str]:
    """RXA-5 primary code and its alternate, sorted into NDC, CPT and CVX slots."""
    def slot(fits: str) -> str:
        return (f"case when code_type {fits} and vaccine_code <> '' then vaccine_code "
                f"when alt_type {fits} then alt_code else '' end")
    return {"ndc": slot("= 'NDC'"), "cpt": slot("in ('CPT', 'C4', 'C5')"),
            "cvx_sent": slot("not in ('NDC', 'CPT', 'C4', 'C5')")}


def dose_columns(order_rows: DataFrame, *carry: str) -> DataFrame:
    """ORC, RXA and RXR columns of order rows."""
    keys = _keys(order_rows)
    strict = "strict" if "strict" in keys else "true"
    kept = [*keys, *carry, "msg_type", "order_no", "obx_before", "obx"]
    rows = order_rows.selectExpr(
        *kept, "orc", "rxa", "rxr", "has_anchor", *_as({
            "vaccine_code": h.field("rxa", 5, 1), "code_type": h.field("rxa", 5, 3),
            "alt_code": h.field("rxa", 5, 4), "alt_type": h.field("rxa", 5, 6),
            "administered_text": h.field("rxa", 3), "expiration_text": h.field("rxa", 16)}))
    return rows.selectExpr(
        *kept, "has_anchor", "has_anchor and msg_type <> 'ORU' as has_rxa", "rxr is not null as has_rxr", "vaccine_code",
        "administered_text", "expiration_text", *_as({
            "vr_link": h.field("orc", 3), **_code_slots(),
            "administered_date": h.parse_date("administered_text", strict),
            "amount": h.field("rxa", 6), "info_source": h.field("rxa", 9),
            "provider_link": h.field("rxa", 10), "provider_last": h.field("rxa", 10, 2),
            "provider_first": h.field("rxa", 10, 3), "provider_middle": h.field("rxa", 10, 4),
            "provider_authority": h.field("rxa", 10, 9), "provider_name_type": h.field("rxa", 10, 10),
            "provider_id_type": h.field("rxa", 10, 13), "provider_suffix": h.field("rxa", 10, 21),
            "facility_code": h.field("rxa", 11, 4), "facility_line1": h.field("rxa", 11, 9),
            "facility_line2": h.field("rxa", 11, 10), "facility_city": h.field("rxa", 11, 11),
            "facility_state": h.field("rxa", 11, 12), "facility_zip": h.field("rxa", 11, 13),
            "facility_country": h.field("rxa", 11, 14),
            "lot": h.field("rxa", 15), "expiration_date": h.parse_date("expiration_text", strict),
            "mvx": h.field("rxa", 17), "refusal_code": h.field("rxa", 18),
            "completion_status": h.field("rxa", 20), "action_code": h.field("rxa", 21),
            "body_route": h.field("rxr", 1), "body_site": h.field("rxr", 2)}))


def extract_vaccinations(parsed: DataFrame, *carry: str) -> DataFrame:
    """Dose columns of every order of the update messages."""
    rows = orders(parsed, *carry, only="msg_type = 'VXU'").where("order_no is not null")
    return dose_columns(rows, *carry)


def simple_doses(vaccinations: DataFrame) -> DataFrame:
    """Reduced dose projection; the placeholder amount 999 is left out."""
    return vaccinations.selectExpr(
        "msg_id", "order_no", "vr_link", "administered_date", "lot", "mvx", "info_source",
        "case when amount <> '999' then amount end as amount")


def extract_observations(order_rows: DataFrame, keep_empty: bool = False) -> DataFrame:
    """OBX columns of every order; ``obx_no`` runs over the whole message.

    All other columns of ``order_rows`` are kept.  With ``keep_empty`` an order
    without OBX keeps one row (``obx_no`` NULL).
    """
    kept = [c for c in order_rows.columns if c not in ("obx", "obx_before")]
    strict = "strict" if "strict" in kept else "true"
    rows = order_rows.selectExpr(*kept, "obx_before", "posexplode_outer(obx) as (obx_i, line)")
    rows = rows if keep_empty else rows.where("obx_i is not null")
    rows = rows.selectExpr(*kept, "obx_i", "obx_before + obx_i + 1 as obx_no", f"{h.split_fields('line')} as f")
    rows = rows.selectExpr(*kept, "obx_i", "obx_no", "f", f"{h.field('f', 14)} as observation_text")
    return rows.selectExpr(*kept, "obx_i", "obx_no", "observation_text", *_as({
        "value_type": h.field("f", 2), "identifier_code": h.field("f", 3, 1), "identifier_label": h.field("f", 3, 2),
        "identifier_table": h.field("f", 3, 3), "value_code": h.field("f", 5, 1), "value_label": h.field("f", 5, 2),
        "value_table": h.field("f", 5, 3), "units_code": h.field("f", 6, 1), "units_label": h.field("f", 6, 2),
        "units_table": h.field("f", 6, 3), "result_status": h.field("f", 11),
        "observation_date": h.parse_date("observation_text", strict),
        "method_code": h.field("f", 17, 1), "method_label": h.field("f", 17, 2), "method_table": h.field("f", 17, 3)}))


def extract_queries(parsed: DataFrame) -> DataFrame:
    """QPD and RCP columns of the query messages; the birth date is read leniently."""
    keys = _keys(parsed)
    rows = (keep(parsed, "msg_type = 'QBP'")
            .selectExpr(*keys, "profile", f"{h.segment_line('message', 'QPD')} as qpd_line",
                        f"{h.split_fields(h.segment_line('message', 'RCP'))} as rcp_f")
            .selectExpr(*keys, "profile", "qpd_line", "rcp_f", f"{h.split_fields('qpd_line')} as qpd")
            .selectExpr(*keys, "profile", "qpd_line", "rcp_f", "qpd", f"{h.repeats('qpd', 3)} as ids",
                        f"{h.field('qpd', 6)} as q_birth_text")
            .selectExpr("*", *_first_ids("ids", ID_TYPES[:2])))
    ids = _identifier(ID_TYPES[:2])
    return rows.selectExpr(*keys, "profile", "qpd_line", "q_birth_text", *_as({
        "has_qpd": "qpd is not null", "query_tag": h.field("qpd", 2),
        "q_mrn": ids["mrn"], "q_authority": ids["mrn_authority"],
        "q_last": h.field("qpd", 4, 1), "q_first": h.field("qpd", 4, 2), "q_middle": h.field("qpd", 4, 3),
        "q_birth": h.parse_date("q_birth_text", "false"), "q_sex": h.field("qpd", 7),
        "rcp": h.field("rcp_f", 2), "quantity": f"try_cast({h.field('rcp_f', 2)} as int)"}))
