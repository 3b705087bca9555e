"""Nested JSON extracts and FHIR ingest.

Resources are structs of built-in expressions; ``to_json`` leaves out NULL
fields, so optional parts are simply NULL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..sources.scratch import stage
from . import codemap, identity, rules

# Columns of a bundle entry, in output order; a resource fills the ones it has.
RESOURCE = ["resourceType", "identifier", "name", "birthDate", "gender", "address", "telecom", "multipleBirthBoolean",
            "multipleBirthInteger", "contact", "occurrenceDateTime", "vaccineCode", "doseQuantity", "primarySource", "lotNumber",
            "expirationDate"]


def _text(column: str) -> str:
    return f"nullif({column}, '')"


def patient_resources(patients: DataFrame) -> DataFrame:
    """(patient_id, resource columns); address only with a line or a zip, contact only with a name."""
    rows = patients.withColumn("gender", codemap.sex_display(F.col("sex"), "fhir"))
    line = f"filter(array({_text('line1')}, {_text('line2')}), x -> x is not null)"
    number = "try_cast(birth_order as int)"
    return rows.selectExpr(
        "patient_id", "'Patient' as resourceType",
        "array(named_struct('value', patient_link, 'type', named_struct('coding', array(named_struct('code', 'MR'))))) as identifier",
        f"array(named_struct('family', name_last, 'given', filter(array({_text('name_first')}, {_text('name_middle')}), x -> x is not null))) as name",
        "cast(birth_date as string) as birthDate", "gender",
        f"case when coalesce(line1, '') <> '' or coalesce(zip, '') <> '' then array(named_struct('line', {line}, 'city', {_text('city')}, "
        f"'state', {_text('state')}, 'postalCode', {_text('zip')}, 'country', {_text('country')}, 'district', {_text('county')})) end as address",
        f"array(named_struct('system', 'phone', 'value', {_text('phone')})) as telecom",
        f"case when birth_flag = 'N' then false when birth_flag = 'Y' and {number} is null then true end as multipleBirthBoolean",
        f"case when birth_flag = 'Y' then {number} end as multipleBirthInteger",
        "case when coalesce(guardian_relationship, '') <> '' and (coalesce(guardian_last, '') <> '' or coalesce(guardian_first, '') <> '') then "
        "array(named_struct('relationship', array(named_struct('coding', array(named_struct('code', guardian_relationship)))), "
        f"'name', named_struct('family', {_text('guardian_last')}, 'given', filter(array({_text('guardian_first')}), x -> x is not null)))) end as contact")


def immunization_resources(doses: DataFrame, codes: DataFrame, compat: bool = False) -> DataFrame:
    """(patient_id, seq, resource columns) of a filtered history.

    A known NDC is added to the CVX coding; with ``compat`` a sent NDC replaces it.
    """
    rows = C.lookup(doses, codes, "VACCINATION_CVX_CODE", "cvx", "cvx", ("label",))
    rows = C.lookup(rows, codes, "VACCINATION_NDC_CODE", "ndc", "ndc", ("value", "label"))
    cvx = "named_struct('code', cvx, 'display', cvx_label, 'system', 'CVX')"
    ndc = "case when ndc_value is not null then named_struct('code', ndc_value, 'display', ndc_label, 'system', 'NDC') end"
    coding = f"filter(array({cvx}, {ndc}), x -> x is not null)"
    if compat:
        coding = f"case when coalesce(ndc, '') <> '' then filter(array({ndc}), x -> x is not null) else array({cvx}) end"
    return rows.selectExpr(
        "patient_id", "seq", "'Immunization' as resourceType", "cast(administered_date as string) as occurrenceDateTime",
        f"named_struct('coding', {coding}) as vaccineCode",
        "case when try_cast(amount as double) is not null then named_struct('value', try_cast(amount as double)) end as doseQuantity",
        "case when coalesce(info_source, '') <> '' then info_source = '00' end as primarySource",
        f"{_text('lot')} as lotNumber", "cast(expiration_date as string) as expirationDate")


def patient_bundle(patients: DataFrame, doses: DataFrame, codes: DataFrame, page_size: int = 1000, compat: bool = False) -> DataFrame:
    """(patient_id, page, entries, bundle): the patient and the numbered history as JSON.

    A bundle page holds at most ``page_size`` immunizations, so one very long
    history becomes several rows instead of one unbounded value.
    """
    entries = (patient_resources(patients).selectExpr("*", "0 as seq")
               .unionByName(immunization_resources(doses, codes, compat), allowMissingColumns=True))
    entries = entries.selectExpr("patient_id", "seq", f"cast(greatest(seq - 1, 0) div {page_size} as int) as page",
                                 f"named_struct('resource', struct({', '.join(RESOURCE)})) as entry")
    pages = entries.groupBy("patient_id", "page").agg(
        F.count("*").alias("entries"), F.expr("array_sort(collect_list(struct(seq, entry))) as es"))
    return pages.selectExpr("patient_id", "page", "entries",
                            "to_json(named_struct('resourceType', 'Bundle', 'entry', transform(es, e -> e.entry))) as bundle")


STATUS = "case when completion_status in ('CP', 'PA') then 'completed' when completion_status in ('RE', 'NA') then 'not-done' end"


def registry_immunization(reports: DataFrame, patients: DataFrame, locations: DataFrame, base_url: str) -> DataFrame:
    """Adds ``resource``: the report as an immunization resource with its location and links.

    ``patients`` (patient_id, mrn) and ``locations`` (facility_id, facility_name) are keyed lookups.
    """
    rows = reports.join(patients.select("patient_id", "mrn"), "patient_id").join(locations, "facility_id", "left")
    return rows.selectExpr(*reports.columns, f"""to_json(named_struct(
        'resourceType', 'Immunization', 'id', vr_link, 'recorded', cast(reported_date as string), 'lotNumber', {_text('lot')},
        'occurrenceDateTime', cast(administered_date as string),
        'doseQuantity', case when try_cast(amount as decimal(18,4)) is not null then named_struct('value', try_cast(amount as decimal(18,4))) end,
        'status', {STATUS},
        'reasonCode', case when coalesce(refusal_code, '') <> '' then array(named_struct('coding', array(named_struct('code', refusal_code)))) end,
        'vaccineCode', named_struct('coding', array(named_struct('code', cvx))),
        'patient', named_struct('reference', concat('{base_url}/Patient/', mrn)),
        'location', case when facility_name is not null then named_struct('id', cast(facility_id as string), 'name', facility_name) end,
        'extension', array(named_struct('url', '#links', 'valueString', concat('{base_url}/MedicationAdministration/', master_link))))) as resource""")


def health_card_payload(patients: DataFrame, doses: DataFrame, issuer: str, nbf: int) -> DataFrame:
    """(patient_id, seq, payload): unsigned credential with a minimal patient and one immunization."""
    people = patients.withColumn("gender", codemap.sex_display(F.col("sex"), "card"))
    rows = doses.select("patient_id", "seq", "cvx", "administered_date", "lot").join(
        people.select("patient_id", "name_last", "name_first", "name_middle", "birth_date", "gender"), "patient_id")
    patient = ("named_struct('resourceType', 'Patient', 'gender', gender, 'birthDate', cast(birth_date as string), 'name', "
               "array(named_struct('family', name_last, 'given', filter(array(name_first, name_middle), x -> coalesce(x, '') <> ''))))")
    shot = ("named_struct('resourceType', 'Immunization', 'status', 'completed', 'vaccineCode', named_struct('coding', "
            "array(named_struct('system', 'http://hl7.org/fhir/sid/cvx', 'code', cvx))), 'patient', named_struct('reference', 'resource:0'), "
            f"'occurrenceDateTime', cast(administered_date as string), 'lotNumber', {_text('lot')})")
    # the two entries differ in type, so the entry list is put together as text
    entry = (f"concat('[{{\"fullUrl\":\"resource:0\",\"resource\":', to_json({patient}), '}},{{\"fullUrl\":\"resource:1\",\"resource\":', "
             f"to_json({shot}), '}}]')")
    text = (f"concat('{{\"iss\":\"{issuer}\",\"nbf\":{nbf},\"vc\":{{\"@context\":[\"https://www.w3.org/2018/credentials/v1\"],"
            "\"type\":[\"VerifiableCredential\",\"https://smarthealth.cards#health-card\"],\"credentialSubject\":{\"fhirVersion\":\"4.0.1\","
            f"\"fhirBundle\":{{\"resourceType\":\"Bundle\",\"type\":\"collection\",\"entry\":', {entry}, '}}}}}}}}')")
    return rows.selectExpr("patient_id", "seq", f"{text} as payload")


# -------------------------------------------------------------------- ingest

EVENT_SCHEMA = """
    patient struct<identifier: array<struct<value: string>>, name: array<struct<family: string, given: array<string>>>, birthDate: date>,
    immunization struct<identifier: array<struct<value: string>>, recorded: date, occurrenceDateTime: date, lotNumber: string,
        doseQuantity: struct<value: decimal(18,4)>, primarySource: boolean, expirationDate: date,
        reasonCode: array<struct<text: string>>, vaccineCode: struct<coding: array<struct<code: string>>>,
        patient: struct<reference: string>,
        location: struct<id: string, name: string, address: struct<line: array<string>, city: string, state: string, postalCode: string, country: string>>>"""


def parse_events(events: DataFrame, received: str = "received_date") -> DataFrame:
    """Event JSON -> report and location columns; ``recorded`` falls back to the arrival date."""
    schema = " ".join(EVENT_SCHEMA.split())
    kept = [c for c in events.columns if c != "event"]
    rows = events.selectExpr(*kept, f"from_json(event, '{schema}') as e")
    i, at = "e.immunization", "e.immunization.location"
    return rows.selectExpr(
        *kept, "coalesce(get(e.patient.identifier, 0).value, '') as mrn", "get(e.patient.name, 0).family as name_last",
        "get(get(e.patient.name, 0).given, 0) as name_first", "e.patient.birthDate as birth_date",
        f"coalesce(get({i}.identifier, 0).value, '') as vr_link", f"coalesce({i}.recorded, {received}) as reported_date",
        f"{i}.occurrenceDateTime as administered_date", f"coalesce({i}.lotNumber, '') as lot",
        f"cast({i}.doseQuantity.value as string) as amount", f"{i}.expirationDate as expiration_date",
        f"coalesce(get({i}.reasonCode, 0).text, '') as refusal_code", f"get({i}.vaccineCode.coding, 0).code as cvx",
        f"case when {i}.primarySource then '00' else '01' end as info_source",
        f"coalesce({i}.patient.reference, '') as patient_ref",
        f"coalesce({at}.id, '') as facility_code", f"{at}.name as facility_name", f"get({at}.address.line, 0) as facility_line1",
        f"get({at}.address.line, 1) as facility_line2", f"{at}.address.city as facility_city", f"{at}.address.state as facility_state",
        f"{at}.address.postalCode as facility_zip", f"{at}.address.country as facility_country")


LOCATION = ["facility_name", "facility_line1", "facility_line2", "facility_city", "facility_state", "facility_zip", "facility_country"]


def locations_of(events: DataFrame) -> DataFrame:
    """Location columns of the parsed events that name one."""
    return events.where("facility_code <> ''").select("org_id", "facility_code", *LOCATION, "arrival")


#: The stored tables of the ingest, by name.
REPORT = ["cvx", "administered_date", "reported_date", "lot", "amount", "info_source", "refusal_code", "facility_code"]
STORE = {
    "reports": "org_id int, mrn string, vr_link string, first_arrival string, cvx string, administered_date date, reported_date date, lot string, amount string, "
               "info_source string, refusal_code string, facility_code string, vaccination_master string",
    "vaccination_masters": "vaccination_master string, org_id int, mrn string, cvx string, administered_date date",
    "patients": "org_id int, mrn string, patient_master string, confidence int",
    "patient_masters": "patient_master string, name_last string, name_first string, birth_date date",
    "locations": "org_id int, facility_code string, " + ", ".join(f"{c} string" for c in LOCATION),
}


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    """Tables that Spark knows to be empty, so that their joins and unions drop out of a first batch."""
    def nothing(schema: str) -> str:
        return "select " + ", ".join(f"cast(null as {kind}) as {name}" for name, kind in (c.split() for c in schema.split(", "))) + " where false"
    return {name: spark.sql(nothing(schema)) for name, schema in STORE.items()}


#: Staged tables of the ingest are written once and read a few times.
PACKED = {"compression": "zstd"}


class Ingest:
    """The stored tables after a batch of parsed events (with msg_id, org_id and ``arrival``).

    * Rejected events (V60-V63) leave nothing behind, and the last event of a report wins.
    * A report that is stored keeps its vaccination master; a new one joins the master of the earliest stored or new
      report of its patient that equals it, else it makes a master with its code and date.
    * A patient that is stored keeps its master; a new one is linked to a stored or new master by name and birth date.
    * A location is made by the first event that names it and stays as it was made.

    Only the tables that are asked for are computed; :meth:`write` writes all of them once, as the next batch's store.
    """

    KEY = ["org_id", "mrn", "vr_link"]
    PERSON = ["name_last", "name_first", "birth_date"]

    def __init__(self, store: dict[str, DataFrame], events: DataFrame, known_patients: DataFrame):
        self.store, self.events, self.known_patients = store, events, known_patients

    @cached_property
    def _good(self) -> DataFrame:
        good = rules.fhir_checked(self.events, self.known_patients).where("found = 0L")
        return good.select(*self.KEY, "arrival", *REPORT, *self.PERSON, *LOCATION)

    @cached_property
    def accepted(self) -> DataFrame:
        return stage(self._good, "fhir-accepted", PACKED)

    @cached_property
    def _matched(self) -> DataFrame:
        """All reports with ``given`` (the stored master) and ``master_id``.

        Stored and new reports are dealt by patient once. Merging them and finding their masters stays inside a patient,
        so no later step moves them.
        """
        columns = f"struct({', '.join(REPORT)}) as r"
        stored = self.store["reports"].selectExpr(*self.KEY, "false as fresh", "first_arrival as arrival", columns, "vaccination_master as given")
        new = self.accepted.selectExpr(*self.KEY, "true as fresh", "arrival", columns, "cast(null as string) as given")
        # a report with a missing key never meets a stored one
        missing = " or ".join(f"{k} is null" for k in self.KEY)
        rows = stored.unionByName(new).selectExpr("*", f"case when {missing} then struct(fresh, case when not fresh then arrival end as stored) end as apart")
        merged = rows.repartition("org_id", "mrn").groupBy(*self.KEY, "apart").agg(
            F.expr("coalesce(min(arrival) filter (where not fresh), min(arrival) filter (where fresh)) as first_arrival"),
            F.expr("max_by(r, case when not fresh or arrival is not null then struct(fresh, arrival) end) as r"), F.max("given").alias("given"))
        merged = merged.selectExpr(*self.KEY, "first_arrival", "r.*", "given")
        return identity.join_masters(merged, ("org_id", "mrn", "cvx", "administered_date", "info_source"), "lot", "first_arrival", "given")

    @cached_property
    def _linked(self) -> DataFrame:
        """New patients with their master."""
        batch = self.accepted.groupBy("org_id", "mrn").agg(F.min("arrival").alias("arrival"), F.expr(f"min_by(struct({', '.join(self.PERSON)}), arrival) as p"))
        fresh = batch.join(self.store["patients"], ["org_id", "mrn"], "left_anti").selectExpr("org_id", "mrn", "arrival", "p.*")
        masters = self.store["patient_masters"].withColumnRenamed("patient_master", "master_id")
        none = self.store["patients"].selectExpr("org_id", "mrn", "patient_master as master_id").limit(0)
        return identity.link_patients(fresh, none, masters).withColumn("patient_master", F.expr("coalesce(master_id, new_master)"))

    @property
    def reports(self) -> DataFrame:
        return self._matched.withColumnRenamed("master_id", "vaccination_master").select(*self.KEY, "first_arrival", *REPORT, "vaccination_master")

    @property
    def vaccination_masters(self) -> DataFrame:
        made = self._matched.where("given is null and master_id = first_arrival").withColumnRenamed("master_id", "vaccination_master")
        old = self.store["vaccination_masters"]
        return old.unionByName(made.select(old.columns))

    @property
    def patients(self) -> DataFrame:
        return self.store["patients"].unionByName(self._linked.select("org_id", "mrn", "patient_master", "confidence"))

    @property
    def patient_masters(self) -> DataFrame:
        return self.store["patient_masters"].unionByName(self._linked.where("new_master = arrival").select("patient_master", *self.PERSON))

    @property
    def locations(self) -> DataFrame:
        return identity.get_or_create(self.store["locations"], locations_of(self.__dict__.get("accepted", self._good)), ["org_id", "facility_code"], "arrival").drop("created")

    def write(self, *names: str) -> dict[str, DataFrame]:
        """The named tables (all of them), written and read back; reports and vaccination masters are two views of one written table."""
        names = names or tuple(STORE)
        if "reports" in names:
            self._matched = stage(self._matched, "fhir-reports", PACKED)
        if {"patients", "patient_masters"} <= {*names}:
            self._linked = stage(self._linked, "fhir-linked", PACKED)
        return {name: self.reports if name == "reports" else stage(getattr(self, name), f"fhir-{name}", PACKED) for name in names}
