"""Upserts and deletes: the last message wins per key, in one aggregation.

Every batch is reduced with max_by before it meets the registry, so a key that
repeats many times is combined on the map side; the registry join is on a
unique key.  ``order`` is the arrival order of a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PID = ["mrn_type", "mrn_authority", "name_last", "name_first", "name_middle", "mother_maiden", "birth_date", "sex", "race",
       "line1", "line2", "city", "state", "zip", "country", "county", "ethnicity", "birth_flag", "birth_order", "death_date",
       "death_flag", "email", "phone"]
PD1 = ["publicity_ind", "publicity_date", "protection_ind", "protection_date", "registry_status", "registry_date"]
NK1 = ["guardian_last", "guardian_first", "guardian_middle", "guardian_relationship"]


def last_of(columns: list[str], order: str, out: str, where: str | None = None) -> str:
    """Aggregate: the struct of ``columns`` at the highest ``order``, optionally of some rows only."""
    keep = f" filter (where {where})" if where else ""
    return f"max_by(struct({', '.join(columns)}), {order}){keep} as {out}"


def upsert(registry: DataFrame, batch: DataFrame, keys: list[str], groups: dict[str, tuple[list[str], str | None]],
           order: str, date: str) -> DataFrame:
    """Merge ``batch`` into ``registry`` on ``keys``.

    ``groups`` maps a name to (columns, condition): the group's columns are
    replaced as a whole by the last batch row that meets the condition, and
    stay as they were without one.  ``reported_date`` is the first and
    ``updated_date`` the last date seen.
    """
    new = batch.groupBy(*keys).agg(
        *[F.expr(last_of(cols, order, f"new_{g}", where)) for g, (cols, where) in groups.items()],
        F.min(date).alias("new_reported"), F.max(date).alias("new_updated"))
    old = registry.selectExpr(*keys, *[f"struct({', '.join(cols)}) as old_{g}" for g, (cols, _) in groups.items()],
                              "reported_date", "updated_date")
    merged = old.join(new, keys, "full")
    picks = [f"coalesce(new_{g}, old_{g}) as {g}" for g in groups]
    merged = merged.selectExpr(*keys, *picks, "coalesce(reported_date, new_reported) as reported_date",
                               "greatest(new_updated, updated_date) as updated_date")
    return merged.selectExpr(*keys, *[f"{g}.{c} as {c}" for g, (cols, _) in groups.items() for c in cols],
                             "reported_date", "updated_date")


PATIENT_GROUPS = {"pid_cols": (PID, None), "pd1_cols": (PD1, "has_pd1"), "nk1_cols": (NK1, "has_nk1")}
DOSE = ["cvx", "ndc_final", "administered_date", "amount", "info_source", "lot", "expiration_date", "mvx", "refusal_code",
        "completion_status", "action_code", "facility_code", "provider_link"]
DOSE_GROUPS = {"dose_cols": (DOSE, None), "route_cols": (["body_route", "body_site"], "has_rxr"),
               "elig_cols": (["funding_eligibility"], "funding_eligibility is not null"),
               "fund_cols": (["funding_source"], "funding_source is not null")}
OBSERVATION = ["value_type", "identifier_label", "identifier_table", "value_code", "value_label", "value_table", "units_code",
               "result_status", "observation_date", "method_code"]
OBSERVATION_GROUPS = {"obs_cols": (OBSERVATION, None)}


def empty_registry(spark, batch: DataFrame, keys: list[str], groups: dict) -> DataFrame:
    """A registry without rows, for a first load."""
    columns = [*keys, *[c for cols, _ in groups.values() for c in cols]]
    return batch.selectExpr(*columns, "cast(null as date) as reported_date", "cast(null as date) as updated_date").limit(0)


def upsert_patients(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Accepted patient rows of a batch into the registry, by (org_id, mrn)."""
    return upsert(registry, batch, ["org_id", "mrn"], PATIENT_GROUPS, "struct(received_date, msg_id)", "received_date")


def upsert_vaccinations(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Accepted doses into the registry, by (org_id, mrn, vr_link)."""
    return upsert(registry, batch, ["org_id", "mrn", "vr_link"], DOSE_GROUPS, "struct(received_date, msg_id, order_no)", "received_date")


def vaccination_masters(masters: DataFrame, links: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(masters, links) after a batch of accepted doses.

    ``links`` (org_id, mrn, vr_link, master_id) names the master of every stored report, and several may share one.
    A new report makes a master of its own, named by its key.  Each changed report hands its code and date on to its
    master, so the last one in the batch (``last_report``) decides; masters without a changed report stay.
    """
    key, order = ["org_id", "mrn", "vr_link"], "struct(received_date, msg_id, order_no)"
    latest = (batch.groupBy(*key).agg(F.expr(f"max_by(struct(cvx, administered_date, {order} as ord), {order}) as r")).selectExpr(*key, "r.*"))
    changed = latest.join(links, key, "left").selectExpr(
        *key, "cvx", "administered_date", "ord", "master_id is null as fresh", "coalesce(master_id, concat_ws('/', org_id, mrn, vr_link)) as master_id")
    linked = links.unionByName(changed.where("fresh").select(*key, "master_id"))
    new = changed.groupBy("org_id", "mrn", "master_id").agg(F.expr("max_by(struct(cvx, administered_date, vr_link as last_report), ord) as n"))
    old = masters.selectExpr("org_id", "mrn", "master_id", "struct(cvx, administered_date, last_report) as o")
    merged = old.join(new, ["org_id", "mrn", "master_id"], "full").selectExpr("org_id", "mrn", "master_id", "coalesce(n, o) as r", "o is null as created")
    return merged.selectExpr("org_id", "mrn", "master_id", "r.*", "created"), linked


def upsert_observations(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Observations by (org_id, mrn, vr_link, identifier_code); '' as link means "no vaccination"."""
    return upsert(registry, batch, ["org_id", "mrn", "vr_link", "identifier_code"], OBSERVATION_GROUPS,
                  "struct(received_date, msg_id, obx_no)", "received_date")


def dose_batch(accepted: DataFrame, observations: DataFrame) -> DataFrame:
    """Accepted dose orders with the last recognised funding codes of their observations."""
    funding = observations.where("obx_code is not null").groupBy("msg_id", "order_no").agg(
        F.expr("max_by(obx_code, obx_no) filter (where identifier_code = '64994-7') as funding_eligibility"),
        F.expr("max_by(obx_code, obx_no) filter (where identifier_code = '30963-3') as funding_source"))
    return accepted.where("accepted and is_dose").join(funding, ["msg_id", "order_no"], "left")


def delete_vaccinations(reports: DataFrame, masters: DataFrame, requested: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reports, masters) left after deleting the requested links.

    A master goes when no report refers to it any more; with ``compat`` it goes
    with its first deleted report.
    """
    wanted = requested.select("vr_link").distinct().selectExpr("*", "true as __deleted")
    marked = reports.join(wanted, "vr_link", "left").selectExpr(*reports.columns, "__deleted is not null as __deleted")
    gone = "deleted" if compat else "deleted and not used"
    # by an aggregate, not its key: the join's "is not null" stays above, so both results read the same marked reports and one plan moves them once
    gone = marked.groupBy("master_id").agg(
        F.max("master_id").alias("gone"), F.expr("bool_or(__deleted) as deleted"), F.expr("bool_or(not __deleted) as used")).where(gone)
    return marked.where("not __deleted").drop("__deleted"), masters.join(gone.selectExpr("gone as master_id"), "master_id", "left_anti")
