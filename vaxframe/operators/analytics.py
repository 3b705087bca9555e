"""Population analytics over patients, doses and stock movements.

Rows are first reduced to one per patient, family and day (or center, product
and day), so the windows below run over calendars, not over raw reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import feeds


def clearinghouse_dedup(reports: DataFrame, patients: DataFrame, order: str) -> DataFrame:
    """One row per person, date and code over all providers: the last report and how many there were."""
    people = patients.select("patient_id", "org_id", "name_last", "name_first", "birth_date")
    return (reports.join(people, "patient_id").groupBy("name_last", "name_first", "birth_date", "administered_date", "cvx")
            .agg(F.expr(f"max_by(struct(vr_link, lot, patient_id), {order}) as r"), F.count("*").alias("reports"),
                 F.countDistinct("org_id").alias("orgs"))
            .selectExpr("name_last", "name_first", "birth_date", "administered_date", "cvx", "r.*", "reports", "orgs"))


def deidentify(reports: DataFrame, patients: DataFrame, salt: str) -> DataFrame:
    """Doses with a salted person key, birth year and three-digit zip; names and contacts are dropped."""
    people = patients.selectExpr("patient_id", f"sha2(concat('{salt}', '|', org_id, '|', mrn), 256) as person_key", "year(birth_date) as birth_year",
                                 "left(zip, 3) as zip3", "sex")
    return reports.join(people, "patient_id").select(
        "person_key", "birth_year", "zip3", "sex", "cvx", "administered_date", "info_source", "completion_status")


def family_doses(doses: DataFrame, families: DataFrame) -> DataFrame:
    """Distinct (patient_id, family, administered_date, cvx) of the doses with a known family."""
    return doses.join(families, "cvx").select("patient_id", "family", "administered_date", "cvx").distinct()


def first_dose(doses: DataFrame, families: DataFrame) -> DataFrame:
    """First date and product per patient and vaccine family."""
    return (doses.join(families, "cvx").groupBy("patient_id", "family")
            .agg(F.expr("min(struct(administered_date, cvx)) as first")).selectExpr("patient_id", "family", "first.*"))


def dose_intervals(doses: DataFrame, families: DataFrame, schedule: DataFrame) -> DataFrame:
    """Days since the previous dose of the family, product change and "too early" against the schedule."""
    rows = family_doses(doses, families).selectExpr(
        "*", "row_number() over (partition by patient_id, family order by administered_date, cvx) as dose_no",
        "lag(struct(administered_date, cvx)) over (partition by patient_id, family order by administered_date, cvx) as prev")
    rows = rows.selectExpr("patient_id", "family", "dose_no", "administered_date", "cvx",
                           "datediff(administered_date, prev.administered_date) as days", "prev.cvx = cvx as same_product")
    return rows.join(schedule.select("family", "dose_no", "min_days"), ["family", "dose_no"], "left").selectExpr(
        "patient_id", "family", "dose_no", "administered_date", "cvx", "days", "same_product", "coalesce(days < min_days, false) as too_early")


def next_dose(doses: DataFrame, families: DataFrame, schedule: DataFrame) -> DataFrame:
    """The next scheduled dose per patient and family, from the doses given (one per day)."""
    given = (doses.join(families, "cvx").select("patient_id", "family", "administered_date").distinct()
             .groupBy("patient_id", "family").agg(F.count("*").alias("doses"), F.max("administered_date").alias("last_date")))
    return (given.selectExpr("*", "cast(doses + 1 as int) as dose_no").join(schedule, ["family", "dose_no"])
            .selectExpr("patient_id", "family", "dose_no", "last_date", "date_add(last_date, min_days) as valid_date",
                        "date_add(last_date, due_days) as due_date", "date_add(last_date, overdue_days) as overdue_date"))


def recall_list(doses: DataFrame, families: DataFrame, schedule: DataFrame, known_until: str, as_of: str) -> DataFrame:
    """Doses due before ``as_of`` (from what was given until ``known_until``) that were not given by then."""
    due = next_dose(doses.where(f"administered_date <= {known_until}"), families, schedule).where(f"due_date < {as_of}")
    later = (doses.where(f"administered_date > {known_until} and administered_date <= {as_of}").join(families, "cvx")
             .select("patient_id", "family").distinct())
    return due.join(later, ["patient_id", "family"], "left_anti").selectExpr(
        "patient_id", "family", "dose_no", "due_date", f"overdue_date < {as_of} as overdue")


def hotspots(points: DataFrame, zoom: int, k: float) -> DataFrame:
    """Tiles per region with more points than mean + k * stddev of the region's tiles."""
    counts = feeds.tile_index(points, zoom).groupBy("region_name", "x", "y").agg(F.count("*").alias("n"))
    stats = counts.groupBy("region_name").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    return (counts.join(stats, "region_name").where(F.col("n") > F.col("mean") + F.lit(k) * F.col("sd"))
            .selectExpr("region_name", "x", "y", "n", "round((n - mean) / sd, 6) as score"))


def average_efficacy(people: DataFrame) -> DataFrame:
    """Per area: 1 - attack rate of the vaccinated / of the others, and the mean over the areas.

    ``people`` has area, vaccinated, is_case (one row per person).
    """
    areas = people.groupBy("area").agg(
        F.count_if("vaccinated").alias("vacc"), F.count_if(F.expr("vaccinated and is_case")).alias("vacc_cases"),
        F.count_if(F.expr("not vaccinated")).alias("others"), F.count_if(F.expr("not vaccinated and is_case")).alias("other_cases"))
    rated = areas.selectExpr("*", "case when vacc > 0 and other_cases > 0 then 1 - (vacc_cases / vacc) / (other_cases / others) end as efficacy")
    mean = rated.agg(F.avg("efficacy").alias("efficacy")).selectExpr(
        "cast(null as int) as area", "cast(null as bigint) as vacc", "cast(null as bigint) as vacc_cases", "cast(null as bigint) as others",
        "cast(null as bigint) as other_cases", "efficacy")
    return rated.unionByName(mean).selectExpr("area", "vacc", "vacc_cases", "others", "other_cases", "round(efficacy, 6) as efficacy")


def inventory_balance(movements: DataFrame) -> DataFrame:
    """Running balance ordered - administered - wasted per center and product, by day."""
    daily = movements.groupBy("center", "product", "day").agg(*[
        F.coalesce(F.expr(f"sum(qty) filter (where kind = '{k}')"), F.lit(0)).alias(k) for k in ("ordered", "administered", "wasted")])
    w = "over (partition by center, product order by day rows between unbounded preceding and current row)"
    return daily.selectExpr("center", "product", "day", "ordered", "administered", "wasted",
                            f"sum(ordered - administered - wasted) {w} as balance",
                            f"round(sum(wasted) {w} / nullif(sum(ordered) {w}, 0), 6) as wastage")


def coverage(patients: DataFrame, doses: DataFrame, n: int, as_of: str) -> DataFrame:
    """Share of patients with at least ``n`` doses by org and ten-year age band, with subtotals."""
    given = doses.select("patient_id", "administered_date", "cvx").distinct().groupBy("patient_id").agg(F.count("*").alias("doses"))
    rows = patients.join(given, "patient_id", "left").selectExpr(
        "org_id", f"cast((year({as_of}) - year(birth_date)) div 10 * 10 as int) as age_band", f"coalesce(doses, 0) >= {n} as covered")
    return rows.rollup("org_id", "age_band").agg(
        F.expr("cast(grouping_id() as int) as level"), F.count("*").alias("patients"), F.count_if("covered").alias("covered")).selectExpr(
        "org_id", "age_band", "level", "patients", "covered", "round(100.0D * covered / patients, 6) as pct")


def field_completeness(rows: DataFrame, columns: list[str], by: str = "org_id") -> DataFrame:
    """Percentage of filled values per column and org."""
    filled = rows.groupBy(by).agg(F.count("*").alias("rows"), *[
        F.count_if(F.expr(f"coalesce(cast({c} as string), '') <> ''")).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return filled.selectExpr(by, "rows", f"stack({len(columns)}, {pairs}) as (column_name, filled)").selectExpr(
        by, "column_name", "filled", "round(100.0D * filled / rows, 6) as pct")


def consolidated_record(reports: DataFrame, patients: DataFrame, order: str) -> DataFrame:
    """History per patient master (same first and last name) over all orgs."""
    masters = patients.groupBy("name_first", "name_last").agg(F.min("patient_id").alias("master_id"))
    people = patients.select("patient_id", "org_id", "name_first", "name_last").join(masters, ["name_first", "name_last"])
    return (reports.where("administered_date is not null and coalesce(cvx, '') <> ''").join(people, "patient_id")
            .groupBy("master_id", "administered_date", "cvx")
            .agg(F.expr(f"max_by(vr_link, {order}) as vr_link"), F.count("*").alias("reports"), F.countDistinct("org_id").alias("orgs")))
