"""Validation rules V01-V64 as conditions, and the stop logic around them.

Rules of one message run in a fixed order.  A *thrown* error ends the message
at once; a *listed* error ends it at the end of the patient stage.  All stages
run in one pass: what fired is a bit mask per group of rules on the message row
or the exploded order rows, and one aggregation per message puts the masks
together.  A message is one input row, so such a group is
never larger than one message.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import hl7text as h
from ..sources.scratch import stage
from . import codemap, hl7
from .acceptance import accepted_prefix
from .rulebook import NO_ENTRY, Group, finding, spelled


def has(flavor: str) -> str:
    return f"array_contains(flavors, '{flavor}')"


def unreadable(text: str) -> str:
    return f"case when {text} = '' then 'No date was specified' else concat('Unparseable date: \"', left({text}, 8), '\"') end"


def with_org(messages: DataFrame, orgs: DataFrame) -> DataFrame:
    """Adds the org's flavors, its name and whether dates are read strictly."""
    kept = messages.columns
    return (messages.join(orgs.select("org_id", "org_name", "flavors"), "org_id", "left")
            .selectExpr(*kept, "org_name", "coalesce(flavors, cast(array() as array<string>)) as flavors")
            .selectExpr("*", f"not {has('CANTALOUPE')} as strict"))


def header_rules() -> Group:
    return Group(
        1,
        finding("V59", "fault is not null", "E", "", 0, thrown=True, repeat=0),
        finding("V64", "n_msh > 1", "E", "MSH", 0, thrown=True),
        finding("V01", f"{has('SOURSOP')} and sending_facility <> coalesce(org_name, '')", "E", "", 0, thrown=True, repeat=0),
        finding("V02", "msg_type not in ('VXU', 'ORU', 'QBP')", "E", "", 0, thrown=True, repeat=0))


def patient_rules(as_of: str, skip_blank_phone: bool = False) -> Group:
    """PID and PD1 rules; a blank phone is checked like any other unless skipped."""
    looked = "phone_text <> ''" if skip_blank_phone else "has_pid"
    strange = h.phone_strange("phone_text")
    single, multiple = "birth_flag in ('', 'N')", "birth_flag = 'Y'"

    def eight(text):
        return f"left({text}, 8)"

    return Group(
        2,
        finding("V29", "not has_pid", "E", "", 0, thrown=True, repeat=0),
        finding("V28", "mrn = ''", "E", "PID", 3, thrown=True),
        finding("V30", f"{looked} and phone_use <> 'PRN'", has("QUINZE"), "PID", 13),
        finding("V31", f"{looked} and {strange} <> ''", "W", "PID", 13, strange),
        finding("V32", f"{looked} and {h.phone_invalid('phone_text')}", "W", "PID", 13),
        finding("V33", "name_last = ''", "E", "PID", 5, thrown=True),
        finding("V34", "name_first = ''", "E", "PID", 5, thrown=True),
        finding("V35", "birth_date is null", "E", "PID", 7, unreadable("birth_text"), thrown=True),
        finding("V36", f"birth_date > {as_of}", "E", "PID", 7, thrown=True),
        finding("V37", h.bad_date("death_text", "death_date"), "W", "PID", 29, eight("death_text")),
        finding("V38", "not sex_ok", "W", "PID", 8, "sex"),
        finding("V39", "country <> '' and not country_ok", f"not {has('GUAVA')}", "PID", 11, "country"),
        finding("V40", "country in ('', 'US', 'USA') and state <> '' and not state_ok", f"not {has('GUAVA')}", "PID", 11, "state"),
        finding("V41", "race <> '' and coalesce(race_status, '') <> 'VALID'", has("FIG"), "PID", 10, "race"),
        finding("V42", "ethnicity <> '' and coalesce(ethnicity_status, '') <> 'VALID'", has("FIG"), "PID", 10, "ethnicity"),
        finding("V43", f"{has('BLACKBERRY')} and (line1 = '' or city = '' or state = '' or zip = '')", "E", "PID", 11, thrown=True),
        finding("V44", f"{single} and birth_order not in ('1', '')", f"not {has('PLANTAIN')}", "PID", 25, "birth_order"),
        finding("V45", f"{multiple} and birth_order = ''", "W", "PID", 24),
        finding("V46", f"{multiple} and birth_order <> '' and not birth_order_ok", f"not {has('PLANTAIN')}", "PID", 25, "birth_order"),
        finding("V47", f"not {single} and not {multiple}", f"not {has('PLANTAIN')}", "PID", 24, "birth_flag"),
        finding("V48a", h.bad_date("protection_text", "protection_date"), "W", "PD1", 13, eight("protection_text")),
        finding("V48b", h.bad_date("registry_text", "registry_date"), "W", "PD1", 17, eight("registry_text")),
        finding("V48c", h.bad_date("publicity_text", "publicity_date"), "W", "PD1", 18, eight("publicity_text")))


def relative_rules() -> Group:
    """Rules per relative ``r``, over the relatives up to the first recognised guardian; none of them is an error."""
    known = f"r.relationship in {hl7.GUARDIANS}"
    return Group(
        3,
        finding("V49", "r.last = ''", "W", "NK1", 2, repeat=None),
        finding("V50", "r.first = ''", "W", "NK1", 2, repeat=None),
        finding("V51", "r.relationship = ''", "W", "NK1", 3, repeat=None),
        finding("V52", "r.relationship = ''", "W", "NK1", 3, repeat=None),
        finding("V52", f"r.relationship <> '' and not {known}", "W", "NK1", 3, "r.relationship", repeat=None, text="V52b"))


def relative_entries() -> str:
    group = relative_rules()
    masked = f"transform(slice(relatives, 1, n_relatives), (r, i) -> named_struct('at', i + 1, 'mask', {group.mask()}, 'relationship', r.relationship))"
    entry = group.entry("r.mask", stage="1", block=1, obx_no="r.at", at="r.at")
    return f"transform(filter({masked}, r -> r.mask <> 0L), r -> {entry})"


def order_rules(as_of: str) -> Group:
    """Order rules; code 998 stands for "no dose", only its observations are read."""

    def rx(rule, cond, severity, field, *values, segment="RXA", thrown=False):
        return finding(rule, f"is_dose and {cond}", severity, segment, field, *values, thrown=thrown, repeat=None)

    return Group(
        4,
        finding("V53", "msg_type = 'ORU' and not has_anchor", "E", "ORC", 0, thrown=True, repeat=None),
        finding("V25", "msg_type = 'VXU' and not has_anchor", "E", "ORC", 0, thrown=True, repeat=None),
        rx("V08", "vaccine_code = ''", "E", 5, thrown=True),
        rx("V09", "vr_link = ''", "E", 3, segment="ORC", thrown=True),
        rx("V10", "administered_date is null", "E", 3, unreadable("administered_text"), thrown=True),
        rx("V11", f"administered_date > {as_of}", "E", 3, thrown=True),
        rx("V12", "ndc_known and ndc_cvx is null", "W", 5, "ndc_final"),
        rx("V13", "ndc_differs", "W", 5, "ndc_final", "ndc_cvx", "cvx"),
        rx("V14", "cpt_known and cpt_cvx is null", "W", 5, "cpt"),
        rx("V15", "cpt_differs", "W", 5, "cpt", "cpt_cvx", "cvx"),
        rx("V16", "cvx = ''", "E", 5, thrown=True),
        rx("V17", "cvx_label is null", "E", 5, "cvx", thrown=True),
        rx("V18", f"{has('PEAR')} and facility_code <> '' and not location_known", "E", 11, thrown=True),
        rx("V19", h.bad_date("expiration_text", "expiration_date"), "W", 16, "left(expiration_text, 8)"),
        rx("V20", "refusal_code <> '' and refusal_value is null", "W", 18),
        rx("V21", f"{has('SPRUCE')} and not has_rxr and info_source = '00'", "E", 0, thrown=True),
        rx("V22", f"administered_date < birth_date and not {has('CLEMENTINE')}", "E", 3, thrown=True))


def funding_rules() -> Group:
    """The funding rules run over all OBX of an order before the others start."""
    sent = "is_dose and not failed and value_code <> '' and obx_code is null"
    return Group(
        5,
        finding("V23", f"identifier_code = '64994-7' and {sent}", "W", "OBX", 5, "value_code", repeat=None),
        finding("V24", f"identifier_code = '30963-3' and {sent}", "W", "OBX", 5, "value_code", repeat=None))


def observation_rules(as_of: str) -> Group:
    contra = "not failed and identifier_code = '30945-0'"
    return Group(
        6,
        finding("V57", "not failed and " + h.bad_date("observation_text", "observation_date"), "W", "OBX", 14,
                "left(observation_text, 8)", repeat=None),
        finding("V54", f"{contra} and obx_code is null", "W", "OBX", 5, repeat=None),
        finding("V55", f"{contra} and observation_date > {as_of}", "W", "OBX", 5, repeat=None),
        finding("V56", f"{contra} and observation_date < birth_date", "W", "OBX", 14, repeat=None))


def whole_rules() -> Group:
    """Rules over all accepted orders of a message."""
    whole = "not stopped and msg_type = 'VXU' and first_fail is null"
    return Group(
        7,
        finding("V26", f"{whole} and {has('CRANBERRY')} and vaccinations = 0", "E", "", 0, thrown=True, repeat=0),
        finding("V27", f"{whole} and {has('BILBERRY')} and vaccinations = 0 and refusals = 0", "E", "", 0, thrown=True, repeat=0))


def query_rules() -> Group:
    return Group(
        8,
        finding("V03", "not has_qpd", "E", "", 0, repeat=0),
        finding("V07", "has_qpd and " + h.bad_date("q_birth_text", "q_birth"), "W", "QPD", 6, "left(q_birth_text, 8)"),
        finding("V04", "has_qpd and q_last = ''", "E", "QPD", 4),
        finding("V05", "has_qpd and q_last <> '' and q_first = ''", "E", "QPD", 4),
        finding("V06", "has_qpd and q_last <> '' and q_first <> '' and q_birth is null", "E", "QPD", 6),
        finding("V58", "is_match and profile not in ('Z34', 'Z44')", "E", "MSH", 21, "profile"))


def fhir_rules() -> Group:
    return Group(
        9,
        finding("V60", "coalesce(vr_link, '') = ''", "E", "Immunization", 0, thrown=True, repeat=0),
        finding("V61", "coalesce(patient_ref, '') <> '' and found_ref is null", "E", "Immunization", 0, thrown=True, repeat=0),
        finding("V62", "coalesce(mrn, '') = ''", "E", "Patient", 0, thrown=True, repeat=0),
        finding("V63", "administered_date < birth_date", "E", "Immunization", 0, thrown=True, repeat=0))


def findings_of(entries: str) -> str:
    """SQL list of the findings of a list of entries of any rules."""
    day = "current_date"
    return spelled(entries, [header_rules(), patient_rules(day), relative_rules(), order_rules(day), funding_rules(), observation_rules(day),
                             whole_rules(), query_rules(), fhir_rules()])


OBX_CODESET = ("case identifier_code when '64994-7' then 'FINANCIAL_STATUS_CODE' when '30963-3' then "
               "'VACCINATION_FUNDING_SOURCE' when '30945-0' then 'CONTRAINDICATION_OR_PRECAUTION' end")


def attach_obx_code(observations: DataFrame, codes: DataFrame) -> DataFrame:
    """``obx_code``: the coded value when the identifier's code set knows it."""
    side = codes.selectExpr("codeset as __set", "value as obx_code").where(
        "__set in ('FINANCIAL_STATUS_CODE', 'VACCINATION_FUNDING_SOURCE', 'CONTRAINDICATION_OR_PRECAUTION')")
    return observations.join(side, F.expr(f"{OBX_CODESET} = __set and value_code = obx_code"), "left").drop("__set")


class Validation:
    """All findings of a batch of messages.

    ``codes``, ``relations``, ``valid_values`` and ``locations`` are lookup
    tables; ``as_of`` is the SQL expression that stands for "now".
    """

    CARRY = [*[c for c in hl7.HEADER if c != "msg_type"], "head", "refused", "stopped", "mrn", "birth_date"]

    def __init__(self, messages: DataFrame, orgs: DataFrame, codes: DataFrame, relations: DataFrame,
                 valid_values: DataFrame, as_of: str, locations: DataFrame | None = None, skip_blank_phone: bool = False):
        self.parsed = hl7.parse(with_org(messages, orgs))
        self.codes, self.relations, self.valid_values = codes, relations, valid_values
        self.locations, self.as_of, self.skip_blank_phone = locations, as_of, skip_blank_phone

    @cached_property
    def head(self) -> DataFrame:
        """Patient row per message with ``head`` (header and patient findings) and ``stopped``."""
        rows = hl7.extract_patients(self.parsed, "message")
        rows = C.lookup(rows, self.codes, "PATIENT_RACE", "race", "race", ("status",))
        rows = C.lookup(rows, self.codes, "PATIENT_ETHNICITY", "ethnicity", "ethnicity", ("status",))
        for sets, column in ((["SEX"], "sex"), (["COUNTRY_2DIGIT", "COUNTRY_3DIGIT"], "country"),
                             (["STATE"], "state"), (["BIRTH_ORDER"], "birth_order")):
            rows = C.member(rows, self.valid_values, sets, column, f"{column}_ok")
        header, patient = header_rules(), patient_rules(self.as_of, self.skip_blank_phone)
        rows = rows.selectExpr(
            "*", f"{header.mask()} as header_mask",
            f"coalesce(nullif(array_position(transform(relatives, r -> r.relationship in {hl7.GUARDIANS}), true), 0), "
            "size(relatives)) as n_relatives")
        rows = rows.selectExpr("*", "header_mask = 0L and msg_type in ('VXU', 'ORU') as is_update")
        rows = rows.selectExpr("*", f"case when is_update then {patient.mask()} else 0L end as patient_mask")
        rows = rows.selectExpr(
            "* except (header_mask, patient_mask)", f"{header.cut('header_mask')} as header_mask", f"{patient.cut('patient_mask')} as patient_mask")
        rows = rows.selectExpr("*", f"{patient.errors('patient_mask')} as patient_errors")
        kin = f"is_update and (patient_mask & {patient.thrown}) = 0L"
        return rows.selectExpr(
            "* except (header_mask, patient_mask, patient_errors, n_relatives)",
            f"concat({header.entries('header_mask')}, {patient.entries('patient_mask', stage='1')}, "
            f"case when {kin} then {relative_entries()} else {NO_ENTRY} end) as head",
            f"(header_mask & {header.bits(lambda r: r.rule != 'V02')}) <> 0L as refused", "not is_update or patient_errors <> 0L as stopped")

    @cached_property
    def accepted(self) -> DataFrame:
        """Patient rows of the messages that passed the patient stage."""
        return hl7.keep(self.head, "not stopped")

    @cached_property
    def orders(self) -> DataFrame:
        """Order rows (VXU and ORU) with ``found`` (a mask), ``failed`` and ``failed_early``; one empty row for a stopped message."""
        carry = [c for c in self.CARRY]
        rows = hl7.dose_columns(hl7.orders(self.head, *carry, only="not stopped"), *carry)
        rows = codemap.resolve_cvx(rows, self.codes, self.relations)
        rows = C.lookup(rows, self.codes, "VACCINATION_REFUSAL", "refusal_code", "refusal")
        if self.locations is None:
            rows = rows.selectExpr("*", "true as location_known")
        else:
            kept = rows.columns
            known = self.locations.select("org_id", "facility_code").distinct().selectExpr("*", "true as __known")
            rows = (rows.join(known, ["org_id", "facility_code"], "left")
                    .selectExpr(*kept, "__known is not null as location_known"))
        rows = rows.selectExpr("*", "order_no is not null and has_rxa and vaccine_code <> '998' as is_dose")
        rules = order_rules(self.as_of)
        rows = rows.selectExpr("*", f"case when order_no is not null then {rules.mask()} end as fired")
        early = rules.bits(lambda r: r.thrown and r.rule not in ("V21", "V22"))
        rows = rows.selectExpr("* except (fired)", f"{rules.cut('fired')} as found")
        return rows.selectExpr("*", f"coalesce((found & {rules.thrown}) <> 0L, false) as failed", f"coalesce((found & {early}) <> 0L, false) as failed_early")

    #: Columns that acceptance and observations read.
    COMMIT = ["msg_id", "msg_type", "strict", "order_no", "is_dose", "failed", "obx", "obx_before"]

    def stage_orders(self, *columns: str) -> Validation:
        """Writes the order rows once, for jobs that start several branches from them.

        With ``columns`` only these and those of ``COMMIT`` are written, and nothing else is computed.
        """
        kept = [c for c in self.orders.columns if not columns or c in {*columns, *self.COMMIT}]
        self.orders = stage(self.orders.select(*kept), "orders")
        return self

    @cached_property
    def doses(self) -> DataFrame:
        """Order rows of the vaccination updates."""
        # one condition on the exploded column, so no part of it moves below the parse
        return self.orders.where("case when order_no is not null then msg_type = 'VXU' else false end")

    @cached_property
    def observations(self) -> DataFrame:
        """OBX rows of the committed orders, with their recognised code."""
        committed = accepted_prefix(self.orders.where("order_no is not null")).where("accepted")
        return attach_obx_code(hl7.extract_observations(committed), self.codes)

    @cached_property
    def report(self) -> DataFrame:
        """One row per message: header columns, ``entries`` (masks), ``findings``, ``vaccinations``, ``refusals``, ``first_fail``."""
        rows = hl7.extract_observations(self.orders, keep_empty=True)
        rows = attach_obx_code(rows, self.codes)

        orders, funding, late = order_rules(self.as_of), funding_rules(), observation_rules(self.as_of)
        counted = "is_dose and not failed and lead"
        given = "cvx not in ('998', '999') and completion_status in ('CP', 'PA', '')"
        rows = rows.selectExpr("*", "obx_i is null or obx_i = 0 as lead", f"{funding.mask()} as funding_mask", f"{late.mask()} as late_mask")
        rows = rows.selectExpr("*", "case when lead then coalesce(found, 0L) else 0L end as order_mask")
        at = {"stage": "2", "order_no": "order_no"}
        entries = [orders.entries("order_mask", at="order_no", **at)]
        entries += [g.entries(m, block=i, obx_no="obx_no", at="obx_no", **at) for i, (g, m) in enumerate(((funding, "funding_mask"), (late, "late_mask")), 1)]
        rows = rows.selectExpr(
            "*", f"concat({', '.join(entries)}) as keyed",
            f"case when {counted} and {given} then order_no end as given_no",
            f"case when {counted} and completion_status = 'RE' then order_no end as refused_no")
        first = ["org_id", "received_date", "msg_type", "flavors", *self.CARRY]
        rows = rows.groupBy("msg_id").agg(
            *[F.expr(f"first({c}) as {c}") for c in first],
            F.expr("array_sort(flatten(collect_list(keyed))) as keyed"),
            F.expr("collect_list(given_no) as given"), F.expr("collect_list(refused_no) as refused_nos"),
            F.expr("min(case when failed then order_no end) as first_fail"))
        # the first failing order throws, which ends the message before its observations
        kept = "first_fail is null or e.order_no < first_fail or (e.order_no = first_fail and e.block = 0)"
        rows = rows.selectExpr(
            "* except (keyed)", f"filter(keyed, e -> {kept}) as found",
            "size(filter(given, n -> first_fail is null or n < first_fail)) as vaccinations",
            "size(filter(refused_nos, n -> first_fail is null or n < first_fail)) as refusals")
        whole = whole_rules()
        rows = rows.selectExpr("*", f"{whole.mask()} as fired")
        rows = rows.selectExpr("*", f"{whole.cut('fired')} as whole_mask")
        rows = rows.selectExpr(
            "msg_id", *[c for c in first if c != "head"], f"concat(head, found, {whole.entries('whole_mask', stage='3')}) as entries",
            "vaccinations", "refusals", "first_fail")
        return rows.selectExpr("*", f"{findings_of('entries')} as findings")

    def quarantined(self) -> DataFrame:
        """Messages that cannot be taken apart, with their fault and text; their report holds V59 alone."""
        return hl7.keep(self.parsed, "fault is not null").selectExpr("msg_id", "org_id", "received_date", "fault", "substring(message, 2) as message")

    def head_findings(self) -> DataFrame:
        """Header and patient findings as rows (no shuffle)."""
        rows = hl7.keep(self.head, "size(head) > 0").select("msg_id", "head")
        return rows.selectExpr("msg_id", f"explode({findings_of('head')}) as f").selectExpr("msg_id", "f.*")

    def findings(self) -> DataFrame:
        """Every finding of the update and unsupported messages as rows."""
        return self.report.selectExpr("msg_id", "org_id", "explode(findings) as f").selectExpr("msg_id", "org_id", "f.*")


def query_findings(queries: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """V03-V07 (and V58 when ``matched`` msg_ids are given); none of them stops the answer."""
    kept = queries.columns
    if matched is None:
        rows = queries.selectExpr("*", "false as is_match")
    else:
        hits = matched.select("msg_id").distinct().selectExpr("*", "true as __hit")
        rows = queries.join(hits, "msg_id", "left").selectExpr(*kept, "__hit is not null as is_match")
    rules = query_rules()
    rows = rows.selectExpr("*", f"{rules.mask()} as fired")
    return rows.selectExpr("msg_id", f"explode({findings_of(rules.entries('fired'))}) as f").selectExpr("msg_id", "f.*")


def fhir_checked(resources: DataFrame, known_patients: DataFrame) -> DataFrame:
    """Ingest rows (org_id, vr_link, patient_ref, mrn, administered_date, birth_date) with ``found``, the mask of V60-V63.

    ``known_patients`` holds the reports (org_id, mrn) a reference may point to.
    """
    side = known_patients.selectExpr("org_id", "mrn as patient_ref", "true as found_ref").distinct()
    rows = resources.join(side, ["org_id", "patient_ref"], "left")
    rules = fhir_rules()
    rows = rows.selectExpr(*resources.columns, f"{rules.mask()} as fired")
    return rows.selectExpr("* except (fired)", f"{rules.cut('fired')} as found")


def fhir_findings(resources: DataFrame, known_patients: DataFrame) -> DataFrame:
    """V60-V63 as rows."""
    rows = fhir_checked(resources, known_patients)
    return rows.selectExpr("msg_id", f"explode({findings_of(fhir_rules().entries('found'))}) as f").selectExpr("msg_id", "f.*")
