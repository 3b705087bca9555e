"""Code mapping: deprecated replacement, CVX resolution, LOINC visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.loinc import PRIORITY_GROUPS


def replace_deprecated(df: DataFrame, codes: DataFrame, codeset: str, column: str) -> DataFrame:
    """Adds ``<column>_known`` and ``<column>_final`` (the replacement of a deprecated code)."""
    kept = df.columns
    return C.lookup(df, codes, codeset, column, "__c", ("value", "new_value")).selectExpr(
        *kept, f"__c_value is not null as {column}_known",
        f"coalesce(nullif(__c_new_value, ''), {column}) as {column}_final")


def resolve_cvx(df: DataFrame, codes: DataFrame, relations: DataFrame) -> DataFrame:
    """CVX of a dose: the sent one, else by NDC, else by CPT.

    Needs ``cvx_sent``, ``ndc`` and ``cpt`` ('' when absent).  Adds the mapped
    codes, ``cvx`` ('' when nothing maps), ``cvx_source``, ``cvx_label`` (NULL
    when the code is unknown) and the two disagreement flags.
    """
    kept = df.columns
    out = replace_deprecated(df, codes, "VACCINATION_NDC_CODE", "ndc")
    out = C.relate(out, relations, "VACCINATION_NDC_CODE", "ndc", "ndc_rel")
    out = C.lookup(out, codes, "VACCINATION_CPT_CODE", "cpt", "cpt")
    out = C.relate(out, relations, "VACCINATION_CPT_CODE", "cpt", "cpt_rel")
    out = out.selectExpr(*kept, "ndc_known", "ndc_final", "cpt_value is not null as cpt_known",
                         "case when ndc_known then ndc_rel end as ndc_cvx",
                         "case when cpt_value is not null then cpt_rel end as cpt_cvx", "nullif(cvx_sent, '') as sent")
    out = out.selectExpr(
        "*", "coalesce(sent, ndc_cvx, cpt_cvx, '') as cvx",
        "case when sent is not null then 'CVX' when ndc_cvx is not null then 'NDC' when cpt_cvx is not null then 'CPT' else '' end as cvx_source",
        "coalesce(sent <> ndc_cvx, false) as ndc_differs",
        "coalesce(coalesce(sent, ndc_cvx) <> cpt_cvx, false) as cpt_differs").drop("sent")
    return C.lookup(out, codes, "VACCINATION_CVX_CODE", "cvx", "cvx", ("label",))


def loinc_visible(observations: DataFrame, loinc: DataFrame) -> DataFrame:
    """Adds the label and drops identifiers that are shown elsewhere; marks priority groups."""
    side = loinc.select(F.col("code").alias("__code"), F.col("label").alias("identifier_label"),
                        F.col("suppress").alias("__suppress"))
    return (observations.join(side, F.col("identifier_code") == F.col("__code"), "left")
            .where(~F.coalesce(F.col("__suppress"), F.lit(False)))
            .withColumn("priority_group", F.col("identifier_code").isin(PRIORITY_GROUPS))
            .drop("__code", "__suppress"))


def sex_display(sex, style: str):
    """Sex code as shown in a message (``hl7``), a resource (``fhir``) or a health card (``card``)."""
    names = {
        "fhir": {"F": "female", "M": "male", "O": "other", "U": "unknown", "X": "other"},
        "card": {"F": "female", "M": "male", "U": "unknown"},
    }
    if style == "hl7":
        return F.when(sex.isin("F", "M", "X"), sex).otherwise(F.lit("U"))
    table = F.create_map(*[F.lit(x) for pair in names[style].items() for x in pair])
    found = F.try_element_at(table, sex)
    return F.coalesce(found, F.lit("other")) if style == "card" else found
