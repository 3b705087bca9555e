"""Matching and identity: patients, vaccinations, locations, providers, ids.

"First hit" means the lowest id, found by an aggregation with partial combine,
so a key that holds a large part of the rows is reduced before the shuffle and
every join side that can be made unique is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stage

PATIENT_COLUMNS = ["patient_id", "name_last", "name_first", "name_middle", "birth_date", "sex", "reported_date", "reported_ts"]


def _struct(columns: list[str]) -> str:
    return "struct(" + ", ".join(columns) + ")"


def first_by(df: DataFrame, keys: list[str], order: str, columns: list[str], out: str = "hit") -> DataFrame:
    """One row per key: the struct of ``columns`` at the lowest ``order``."""
    return df.groupBy(*keys).agg(F.expr(f"min_by({_struct(columns)}, {order}) as {out}"))


def match_by_mrn(queries: DataFrame, patients: DataFrame) -> DataFrame:
    """Adds ``mrn_hit``: the lowest patient with the query's (org, mrn); a blank id matches nobody.

    Blank ids get keys of their own, so that they neither match nor meet in one task.
    """
    side = first_by(patients.where("mrn <> ''").withColumnsRenamed({"org_id": "q_org", "mrn": "__mrn"}), ["q_org", "__mrn"],
                    "patient_id", PATIENT_COLUMNS, "mrn_hit")
    key = "case when coalesce(q_mrn, '') = '' then concat(char(0), xxhash64(query_id)) else q_mrn end"
    return queries.withColumn("__mrn", F.expr(key)).join(side, ["q_org", "__mrn"], "left").drop("__mrn")


def match_by_demographics(queries: DataFrame, patients: DataFrame) -> DataFrame:
    """Adds ``demo_hit``: the lowest patient of the org with equal birth date and names."""
    keys = ["q_org", "q_birth", "q_last", "q_first"]
    side = first_by(patients.selectExpr("org_id as q_org", "birth_date as q_birth", "name_last as q_last",
                                        "name_first as q_first", *PATIENT_COLUMNS), keys, "patient_id", PATIENT_COLUMNS, "demo_hit")
    return queries.join(side, keys, "left")


def score(query: str, hit: str, compat: bool = False) -> str:
    """Two points per equal item, without regard to case; a blank query value scores 0."""
    pairs = [("q_last", "name_last"), ("q_first", "name_first"),
             ("q_middle", "name_first" if compat else "name_middle"), ("q_sex", "sex")]
    terms = [f"case when {q} <> '' and lower({q}) = lower({hit}.{p}) then 2 else 0 end" for q, p in pairs]
    return " + ".join([*terms, f"case when q_birth = {hit}.birth_date then 2 else 0 end"])


def match_queries(queries: DataFrame, patients: DataFrame, threshold: int = 6, compat: bool = False) -> DataFrame:
    """Adds ``hit`` (NULL when unmatched), ``points`` and ``complete``.

    A query without last name, first name or birth date keeps its id hit
    unscored; the others need ``threshold`` points.
    """
    rows = match_by_demographics(match_by_mrn(queries, patients), patients)
    kept = queries.columns
    rows = rows.selectExpr(
        *kept, "mrn_hit", "demo_hit",
        "coalesce(q_last, '') <> '' and coalesce(q_first, '') <> '' and q_birth is not null as complete")
    rows = rows.selectExpr(*kept, "complete", "case when complete then coalesce(mrn_hit, demo_hit) else mrn_hit end as candidate")
    rows = rows.selectExpr("*", f"case when complete and candidate is not null then {score('q', 'candidate', compat)} end as points")
    return rows.selectExpr(*kept, "complete", "points",
                           f"case when not complete or points >= {threshold} then candidate end as hit")


def possible_counts(unmatched: DataFrame, patients: DataFrame) -> DataFrame:
    """Adds ``possible``: patients of the org with the birth date and one of the names.

    Counted per key (last + first - both), so no pair is made for a large bucket.
    """
    base = patients.selectExpr("org_id as q_org", "birth_date as q_birth", "name_last as q_last", "name_first as q_first")

    def counted(keys, out):
        return base.groupBy("q_org", "q_birth", *keys).agg(F.count("*").alias(out))

    rows = (unmatched.join(counted(["q_last"], "n_last"), ["q_org", "q_birth", "q_last"], "left")
            .join(counted(["q_first"], "n_first"), ["q_org", "q_birth", "q_first"], "left")
            .join(counted(["q_last", "q_first"], "n_both"), ["q_org", "q_birth", "q_last", "q_first"], "left"))
    return rows.selectExpr(*unmatched.columns,
                           "coalesce(n_last, 0) + coalesce(n_first, 0) - coalesce(n_both, 0) as possible")


def possible_matches(counted: DataFrame, patients: DataFrame, cap: str) -> DataFrame:
    """The candidates of the queries that list them: 0 < possible <= ``cap``.

    A query over the cap gets no list (its answer is "too many"), so a query
    meets at most ``cap`` patients and the two joins stay small.
    """
    listing = counted.where(f"possible > 0 and possible <= {cap}").select(
        "query_id", "q_org", "q_birth", "q_last", "q_first")
    side = patients.selectExpr("org_id as q_org", "birth_date as q_birth", "name_last", "name_first", "patient_id")
    by_last = listing.join(side, (listing.q_last == side.name_last) & (listing.q_org == side.q_org)
                           & (listing.q_birth == side.q_birth)).select("query_id", "patient_id")
    by_first = listing.join(side, (listing.q_first == side.name_first) & (listing.q_org == side.q_org)
                            & (listing.q_birth == side.q_birth) & ~listing.q_last.eqNullSafe(side.name_last)
                            ).select("query_id", "patient_id")
    return by_last.unionByName(by_first)


def possible_report(counted: DataFrame, patients: DataFrame, cap: str) -> DataFrame:
    """Every counted query with its exact count and whether it is over ``cap``: a row per listed candidate, else one without."""
    rows = counted.selectExpr("query_id", "possible", f"possible > {cap} as too_many")
    return rows.join(possible_matches(counted, patients, cap), "query_id", "left")


def link_patients(batch: DataFrame, reports: DataFrame, masters: DataFrame) -> DataFrame:
    """Master of every new report: known id, exact, possible, or a new one.

    ``batch`` (org_id, mrn, name_last, name_first, birth_date, arrival),
    ``reports`` (org_id, mrn, master_id) and ``masters`` (master_id, names,
    birth_date).  Once a master exists for (first, last) no new one is made
    for that name, so arrival order collapses to: the exact master, else the
    lowest one of the name, else the first arrival of the name in the batch.
    A new master takes the arrival number of its maker as ``new_master``.
    """
    name = ["name_first", "name_last"]
    rows = (batch.groupBy("org_id", "mrn").agg(F.expr(f"min_by(struct(arrival, name_last, name_first, birth_date), arrival) as r"))
            .selectExpr("org_id", "mrn", "r.*"))
    known = reports.groupBy("org_id", "mrn").agg(F.min("master_id").alias("known_master"))
    rows = rows.join(known, ["org_id", "mrn"], "left")
    exact = masters.groupBy(*name, "birth_date").agg(F.min("master_id").alias("exact_master"))
    named = masters.groupBy(*name).agg(F.min("master_id").alias("named_master"))
    rows = rows.join(exact, [*name, "birth_date"], "left").join(named, name, "left")
    rows = rows.selectExpr("*", "known_master is null and named_master is null as unplaced")
    makers = (rows.where("unplaced").groupBy(*name)
              .agg(F.expr("min_by(struct(arrival, birth_date), arrival) as maker")))
    rows = rows.join(makers, name, "left")
    return rows.selectExpr(
        "org_id", "mrn", "name_last", "name_first", "birth_date", "arrival",
        "coalesce(known_master, exact_master, named_master) as master_id",
        "case when unplaced then coalesce(maker.arrival, arrival) end as new_master",
        "case when known_master is not null then null when exact_master is not null then 2 "
        "when named_master is not null then 1 when coalesce(maker.arrival, arrival) = arrival then null "
        "when maker.birth_date = birth_date then 2 else 1 end as confidence",
        "soundex(name_last) as soundex_last", "soundex(name_first) as soundex_first")


def patient_links(linked: DataFrame) -> DataFrame:
    """Link rows only for records that matched an existing master."""
    return linked.where("confidence is not null").select("org_id", "mrn", "master_id", "new_master", "confidence")


def match_vaccination(batch: DataFrame, reports: DataFrame) -> DataFrame:
    """Adds ``report_id``: the lowest report with the same (patient_id, vr_link)."""
    side = reports.groupBy("patient_id", "vr_link").agg(F.min("vr_id").alias("report_id"))
    return batch.join(side, ["patient_id", "vr_link"], "left")


def dedup_vaccinations(reports: DataFrame, on: tuple[str, ...] = ("patient_id", "cvx", "administered_date", "info_source"),
                       optional: str = "lot", order: str = "vr_id") -> DataFrame:
    """Adds ``master_id``: equal on ``on``, and ``optional`` equal or missing on one side.

    Gives what adding the reports one by one in ``order`` would give: a report
    joins the earliest match and takes over its master.  With m0 the first of
    the group, n0 its first without ``optional`` and f the first with the same
    value: reports without it go to m0; the others to m0 when n0 comes before
    f, else to f.  Only minima per key are needed, no pairs.  As in
    :func:`join_masters` they are taken over windows, so the reports move once.
    """
    missing = " or ".join(f"{k} is null" for k in on)
    rows = reports.selectExpr("*", f"nullif({optional}, '') as __v", f"case when {missing} then {order} end as __alone")
    group = ", ".join([*on, "__alone"])
    whole = f"(partition by {group} order by __v rows between unbounded preceding and unbounded following)"  # in the order that the second window needs
    rows = rows.selectExpr("*", f"min({order}) over {whole} as __m0", f"min(case when __v is null then {order} end) over {whole} as __n0")
    rows = rows.selectExpr("*", f"min({order}) over (partition by {group}, __v) as __f")
    # a report with a missing key matches nothing and is its own master
    return rows.selectExpr(*reports.columns, f"case when {missing} then {order} when __v is null or __n0 < __f then coalesce(__m0, {order}) "
                                             f"else coalesce(__f, {order}) end as master_id")


def join_masters(reports: DataFrame, on: tuple[str, ...], optional: str, order: str, given: str) -> DataFrame:
    """Adds ``master_id``: stored reports (``given`` is set) keep theirs, new ones join as if added after them in ``order``.

    As in :func:`dedup_vaccinations` only minima per key are needed.  With m0 the first of the group, n0 its first
    without ``optional`` and f the first with the same value (stored ones before new ones), a report without it
    follows m0, and any other follows f, or when n0 comes before f, n0 if that is stored and m0 if it is new.
    The minima are taken over windows, so the reports move once, and not at all when they lie by some of ``on`` already.
    """
    missing = " or ".join(f"{k} is null" for k in on)
    rows = reports.selectExpr("*", f"nullif({optional}, '') as __v", f"struct({given} is null as fresh, {order} as place, {given} as master) as __o",
                              f"case when {missing} then {order} end as __alone")
    group = ", ".join([*on, "__alone"])
    whole = f"(partition by {group} order by __v rows between unbounded preceding and unbounded following)"  # in the order that the second window needs
    rows = rows.selectExpr("*", f"min(__o) over {whole} as __m0", f"min(case when __v is null then __o end) over {whole} as __n0")
    rows = rows.selectExpr("*", f"min(__o) over (partition by {group}, __v) as __f")
    to = "case when __v is null then __m0 when __n0 < __f then case when __n0.fresh then __m0 else __n0 end else __f end"
    rows = rows.selectExpr("*", f"{to} as __to")
    # a report with a missing key matches nothing and is its own master
    return rows.selectExpr(*reports.columns, f"case when {missing} then coalesce({given}, {order}) "
                                             f"else coalesce({given}, __to.master, __to.place, {order}) end as master_id")


def get_or_create(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows plus the first incoming row of every unknown key."""
    columns = [c for c in existing.columns if c not in keys]
    fresh = (incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
             .groupBy(*keys).agg(F.expr(f"min_by({_struct(columns)}, {order}) as r"))
             .selectExpr(*keys, "r.*"))
    return existing.selectExpr(*keys, *columns, "false as created").unionByName(fresh.selectExpr(*keys, *columns, "true as created"))


def match_observation(batch: DataFrame, masters: DataFrame) -> DataFrame:
    """Adds ``master_obs``: the lowest observation with the same patient, vaccination (or none) and identifier."""
    side = (masters.groupBy("patient_id", "vaccination_ref", "identifier_code").agg(F.min("obs_id").alias("master_obs"))
            .withColumnsRenamed({"patient_id": "__p", "vaccination_ref": "__v", "identifier_code": "__i"}))
    return batch.join(side, (F.col("patient_id") == F.col("__p")) & F.col("vaccination_ref").eqNullSafe(F.col("__v"))
                      & (F.col("identifier_code") == F.col("__i")), "left").drop("__p", "__v", "__i")


# Symbols of a patient link (33, without I, O and 0).
ID_SYMBOLS = "ABCDEFGHJKLMNPQRSTUVWXYZ123456789"


def _link(key: str, salt: str) -> str:
    digest = f"sha2(concat({key}, '|', {salt}), 256)"
    symbols = ", ".join(f"substring('{ID_SYMBOLS}', cast(conv(substring(d, {1 + 4 * i}, 4), 16, 10) as int) % 33 + 1, 1)" for i in range(12))
    return f"transform(array({digest}), d -> concat({symbols}))[0]"


def assign_patient_link(patients: DataFrame, taken: DataFrame | None = None, key: str = "concat(org_id, '|', mrn)",
                        tries: int = 1000) -> DataFrame:
    """Adds ``patient_link``: twelve symbols from the hash of (org, mrn), so a rerun gives the same.

    Equal keys have one link.  Links of several keys, and links in ``taken``, are
    found by a count over the link alone; only the keys behind them get further
    salts.  Keys that are left after ``tries`` salts fail the job.
    """
    rows = patients.selectExpr("*", f"{key} as __key").selectExpr("*", _link("__key", "0") + " as patient_link")
    links = rows.select("__key", "patient_link")
    clashing = (links.groupBy("patient_link").agg(F.expr("min(xxhash64(__key)) as low"), F.expr("max(xxhash64(__key)) as high"))
                .where("low < high").select("patient_link"))
    if taken is not None:
        taken = taken.select("patient_link").distinct()
        clashing = clashing.unionByName(taken.join(links, "patient_link", "left_semi")).distinct()
    clashing = stage(clashing, "clashing-links")
    if clashing.isEmpty():
        return rows.drop("__key")
    waiting = stage(links.join(clashing, "patient_link", "left_semi").select("__key").distinct(), "waiting")
    settled = None
    for salt in range(tries):
        # salt 0 belongs to the smallest key behind a link; every later one must be new
        chosen = waiting.selectExpr("__key", _link("__key", str(salt)) + " as link").groupBy("link").agg(F.min("__key").alias("__key"))
        used = [t for t in (taken, links.select("patient_link") if salt else None,
                            settled.selectExpr("link as patient_link") if settled is not None else None) if t is not None]
        for others in used:
            chosen = chosen.join(others.withColumnRenamed("patient_link", "link"), "link", "left_anti")
        chosen = stage(chosen.select("__key", "link"), "chosen")
        settled = chosen if settled is None else stage(settled.unionByName(chosen), "settled")
        waiting = stage(waiting.join(chosen, "__key", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    else:
        raise ValueError(f"patient links still repeat after {tries} salts")
    return rows.join(settled, "__key", "left").selectExpr(*patients.columns, "coalesce(link, patient_link) as patient_link")


def report_links(linked: DataFrame) -> DataFrame:
    """Every report with its master and the number of reports of that master."""
    counts = linked.groupBy("master_id").agg(F.count("*").alias("n_reports"), F.min("patient_id").alias("first_report"))
    return linked.select("master_id", "patient_id").join(counts, "master_id")


def read_by_link(reports: DataFrame, requested: DataFrame, locations: DataFrame) -> DataFrame:
    """Reports whose external link is requested, with their location."""
    wanted = requested.select("vr_link").distinct()
    return reports.join(wanted, "vr_link", "left_semi").join(locations, "facility_id", "left")
