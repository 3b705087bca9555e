"""Seed code tables and the lookup joins that use them.

A user passes their own tables with the same columns.  No join here carries a
broadcast hint: the seed tables are inline relations of known size and larger
user tables are read from files, so Spark picks the strategy from their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import loinc as _loinc

CODE_COLUMNS = ["codeset", "value", "label", "status", "new_value"]
RELATION_COLUMNS = ["from_set", "from_value", "to_cvx"]

# Code set -> (value, label); status VALID unless listed below.
CODES = {
    "VACCINATION_CVX_CODE": [
        ("03", "MMR"), ("08", "Hep B, adolescent or pediatric"), ("10", "IPV"), ("20", "DTaP"), ("21", "varicella"),
        ("62", "HPV, quadrivalent"), ("83", "Hep A, ped/adol, 2 dose"), ("88", "influenza, unspecified formulation"),
        ("91", "typhoid, unspecified formulation"), ("94", "MMRV"),
        ("207", "COVID-19, mRNA, LNP-S, PF, 100 mcg/0.5 mL dose"), ("208", "COVID-19, mRNA, LNP-S, PF, 30 mcg/0.3 mL dose"),
        ("998", "no vaccine administered"), ("999", "unknown")],
    "VACCINATION_REFUSAL": [
        ("00", "Parental decision"), ("01", "Religious exemption"), ("02", "Other"), ("03", "Patient decision")],
    "FINANCIAL_STATUS_CODE": [
        ("V01", "Not VFC eligible"), ("V02", "VFC eligible - Medicaid/Medicaid Managed Care"),
        ("V03", "VFC eligible - Uninsured"), ("V04", "VFC eligible - American Indian/Alaskan Native"),
        ("V05", "VFC eligible - Federally Qualified Health Center Patient (under-insured)")],
    "VACCINATION_FUNDING_SOURCE": [
        ("VXC50", "Public"), ("VXC51", "Private"), ("VXC52", "Public non-VFC")],
    "PATIENT_RACE": [
        ("1002-5", "American Indian or Alaska Native"), ("2028-9", "Asian"), ("2054-5", "Black or African American"),
        ("2076-8", "Native Hawaiian or Other Pacific Islander"), ("2106-3", "White"), ("2131-1", "Other Race"),
        ("OLD-1", "Retired race code")],
    "PATIENT_ETHNICITY": [
        ("2135-2", "Hispanic or Latino"), ("2186-5", "not Hispanic or Latino"), ("OLD-2", "Retired ethnicity code")],
    "CONTRAINDICATION_OR_PRECAUTION": [
        ("VXC18", "Allergy to gelatin"), ("VXC20", "Current fever"), ("VXC21", "Previous history of intussusception")],
    "VACCINATION_INFORMATION_SOURCE": [
        ("00", "New immunization record"), ("01", "Historical information - source unspecified")],
    "VACCINATION_MANUFACTURER_CODE": [
        ("CSL", "CSL Behring"), ("MSD", "Merck and Co., Inc."), ("PFR", "Pfizer, Inc.")],
    "VACCINATION_COMPLETION": [
        ("CP", "Complete"), ("NA", "Not Administered"), ("PA", "Partially Administered"), ("RE", "Refused")],
    "BODY_ROUTE": [("C28161", "Intramuscular"), ("C38299", "Subcutaneous")],
    "BODY_SITE": [("LA", "Left Upper Arm"), ("LD", "Left Deltoid"), ("RA", "Right Upper Arm")],
    "PERSON_RELATIONSHIP": [("FTH", "Father"), ("GRD", "Guardian"), ("MTH", "Mother"), ("SIB", "Sibling")],
}
DEPRECATED = [("PATIENT_ETHNICITY", "OLD-2"), ("PATIENT_RACE", "OLD-1")]

# Sets of accepted values (a user table replaces them).
VALID_VALUES = {
    "SEX": ["F", "M", "U", "X", "O", "A", "N"],
    "COUNTRY_2DIGIT": ["BR", "CA", "DE", "FR", "GB", "HT", "IN", "MX", "US"],
    "COUNTRY_3DIGIT": ["BRA", "CAN", "DEU", "FRA", "GBR", "HTI", "IND", "MEX", "USA"],
    "STATE": ("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC "
              "ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY AS GU MP PR VI").split(),
    "BIRTH_ORDER": ["1", "2", "3", "4", "5", "6", "7", "8", "9"],
}

# Schedule rule table (family, dose, minimum age/interval, due and overdue days).
FAMILY = {"03": "MMR", "94": "MMR", "08": "HEPB", "10": "POLIO", "20": "DTAP", "21": "VAR", "62": "HPV",
          "83": "HEPA", "88": "FLU", "91": "TYPHOID", "207": "COVID", "208": "COVID"}
SCHEDULE = [  # family, dose_no, min_days, due_days, overdue_days (after the previous dose)
    ("MMR", 2, 28, 90, 180), ("HEPB", 2, 28, 60, 120), ("HEPB", 3, 56, 120, 300), ("POLIO", 2, 28, 60, 120),
    ("POLIO", 3, 28, 60, 120), ("DTAP", 2, 28, 60, 120), ("DTAP", 3, 28, 60, 120), ("DTAP", 4, 180, 270, 400),
    ("VAR", 2, 84, 120, 400), ("HPV", 2, 150, 180, 400), ("HEPA", 2, 180, 200, 400), ("COVID", 2, 21, 28, 42),
    ("COVID", 3, 60, 150, 365), ("FLU", 2, 300, 365, 500),
]


def _literal(value) -> str:
    if value is None:
        return "cast(null as string)"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values_sql(columns: list[str], rows: list[tuple]) -> str:
    """Inline table text in the common dialect of Spark SQL and DuckDB."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"select * from (values {body}) as t({', '.join(columns)})"


def code_rows() -> list[tuple]:
    return [(s, v, label, "DEPRECATED" if (s, v) in DEPRECATED else "VALID", None)
            for s, pairs in CODES.items() for v, label in pairs]


def codes_sql() -> str:
    return values_sql(CODE_COLUMNS, code_rows())


def valid_values_sql() -> str:
    return values_sql(["valid_set", "value"], [(s, v) for s, vs in VALID_VALUES.items() for v in vs])


def loinc_sql() -> str:
    return values_sql(["code", "label", "suppress"], [(c, t, c in _loinc.SUPPRESSED) for c, t in _loinc.LOINC])


def family_sql() -> str:
    return values_sql(["cvx", "family"], list(FAMILY.items()))


def schedule_sql() -> str:
    return values_sql(["family", "dose_no", "min_days", "due_days", "overdue_days"], SCHEDULE)


def seed_codes(spark: SparkSession) -> DataFrame:
    return spark.sql(codes_sql())


def seed_valid_values(spark: SparkSession) -> DataFrame:
    return spark.sql(valid_values_sql())


def loinc_table(spark: SparkSession) -> DataFrame:
    return spark.sql(loinc_sql())


def lookup(df: DataFrame, codes: DataFrame, codeset: str, column: str, prefix: str,
           take: tuple[str, ...] = ("value",)) -> DataFrame:
    """Left join one code set; ``<prefix>_<field>`` is NULL for an unknown value.

    The code table is keyed on (codeset, value), so no row is multiplied.
    """
    side = codes.where(f"codeset = '{codeset}'").selectExpr(
        f"value as __{prefix}", *[f"{t} as {prefix}_{t}" for t in take])
    return df.join(side, F.expr(f"{column} = __{prefix}"), "left").drop(f"__{prefix}")


def lookup_on(df: DataFrame, codes: DataFrame, codeset: str, column: str, prefix: str, day: str,
              take: tuple[str, ...] = ("value",)) -> DataFrame:
    """Like :func:`lookup` as of the date ``day``: a code is unknown before ``valid_from`` and after ``valid_to``.

    The periods of a value (a few rows) become one list, so no row is multiplied when periods overlap; of those the
    one that began last counts.
    """
    period = f"struct(valid_from, valid_to, {', '.join('value as __value' if t == 'value' else t for t in take)})"
    side = (codes.where(f"codeset = '{codeset}'").groupBy("value").agg(F.expr(f"sort_array(collect_list({period}), false) as __periods"))
            .withColumnRenamed("value", f"__{prefix}"))
    valid = f"get(filter(__periods, p -> coalesce(p.valid_from <= {day}, p.valid_from is null) and coalesce({day} <= p.valid_to, p.valid_to is null)), 0)"
    rows = df.join(side, F.expr(f"{column} = __{prefix}"), "left").selectExpr(*df.columns, f"{valid} as __period")
    return rows.selectExpr(*df.columns, *[f"__period.{'__value' if t == 'value' else t} as {prefix}_{t}" for t in take])


def relate(df: DataFrame, relations: DataFrame, from_set: str, column: str, out: str) -> DataFrame:
    """Left join code -> CVX; ``out`` is NULL when there is no relation."""
    side = relations.where(f"from_set = '{from_set}'").selectExpr(f"from_value as __{out}", f"to_cvx as {out}")
    return df.join(side, F.expr(f"{column} = __{out}"), "left").drop(f"__{out}")


def member(df: DataFrame, valid_values: DataFrame, sets: list[str], column: str, out: str) -> DataFrame:
    """Boolean ``out``: the value belongs to one of the sets (keyed on valid_set, value)."""
    names = ", ".join(f"'{s}'" for s in sets)
    side = valid_values.where(f"valid_set in ({names})").selectExpr(f"value as __{out}_value")
    if len(sets) > 1:
        side = side.distinct()
    side = side.selectExpr("*", f"true as __{out}")
    kept = df.columns
    return (df.join(side, F.expr(f"{column} = __{out}_value"), "left")
            .selectExpr(*kept, f"__{out} is not null as {out}"))
