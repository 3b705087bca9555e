"""Acceptance of messages, patients and orders; acknowledgement and log categories.

All of it reads the one-row-per-message report of :class:`rules.Validation`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rulebook import count


def ack_status(report: DataFrame) -> DataFrame:
    """(msg_id, status, errors, warnings): AE when any error or warning, else AA."""
    return report.selectExpr(
        "msg_id", f"{count('entries', 'e.errors')} as errors", f"{count('entries', 'e.mask & ~e.errors')} as warnings",
        "case when size(entries) > 0 then 'AE' else 'AA' end as status")


def accepted_prefix(doses: DataFrame) -> DataFrame:
    """Marks the orders before the first failing one of their message.

    Orders are committed one by one, so an error keeps what came before it.
    The window group is one message.
    """
    return doses.selectExpr("*", "not max(failed) over (partition by msg_id order by order_no "
                                 "rows between unbounded preceding and current row) as accepted")


def reached_location(doses: DataFrame) -> DataFrame:
    """Orders that got as far as their location and provider rows.

    These rows are saved before the later rules of the order run, so an order
    that fails on one of those still leaves them.
    """
    kept = doses.columns
    return (doses.selectExpr("*", "coalesce(max(failed) over (partition by msg_id order by order_no "
                                  "rows between unbounded preceding and 1 preceding), false) as before_failed")
            .where("not before_failed and is_dose and not failed_early")
            .select(*kept))


def event_counts(report: DataFrame) -> DataFrame:
    """Vaccinations and refusals per update message, over its accepted dose orders."""
    return report.where("msg_type = 'VXU' and not stopped").select("msg_id", "vaccinations", "refusals")


def error_location(f: str) -> str:
    """seg^rep[^field]; '' without a segment."""
    return (f"case when {f}.segment = '' then '' else concat_ws('^', {f}.segment, cast({f}.seg_repeat as string), "
            f"case when {f}.field > 0 then cast({f}.field as string) end) end")


def error_line(f: str) -> str:
    """ERR segment of a finding struct."""
    return f"concat('ERR||', {error_location(f)}, '|101^Required field missing^HL70357||', {f}.severity, '||||', {f}.text, '|')"


def update_categories(report: DataFrame) -> DataFrame:
    """Log categories of update and unsupported messages.

    Header errors other than an unsupported type end before the log is written.
    """
    return (report.where("msg_type <> 'QBP' and not refused")
            .selectExpr("msg_id", "org_id", "received_date",
                        "case when msg_type in ('VXU', 'ORU') then 'Update' else 'Unknown' end as category_request",
                        "case when msg_type not in ('VXU', 'ORU') then 'NAck' "
                        "when exists(entries, e -> e.errors <> 0L) then 'Exception' else 'Ack' end as category_response"))


def summary(findings: DataFrame) -> DataFrame:
    """Number of findings by org, rule and severity."""
    return findings.groupBy("org_id", "rule", "severity").agg(F.count("*").alias("findings"))


def build_ack(report: DataFrame, registry_name: str = "IIS") -> DataFrame:
    """(msg_id, ack): MSH, MSA and every ERR of the message, in rule order."""
    sender = ("case when n_msh = 0 then 'MSH NOT FOUND' when control_id = '' then 'MSH-10 NOT VALUED' else control_id end")
    msh = (f"concat('MSH|^~\\\\&|', receiving_app, '|{registry_name}|', sending_app, '|', sending_facility, '|', "
           "date_format(received_date, 'yyyyMMdd'), '||ACK^V04^ACK|', cast(msg_id as string), '|', processing_id, "
           "'|2.5.1|||NE|NE|||||Z23^CDCPHINVS')")
    msa = f"concat('MSA|', case when size(entries) > 0 then 'AE' else 'AA' end, '|', {sender})"
    return report.selectExpr(
        "msg_id", "org_id", "received_date",
        f"array_join(concat(array({msh}, {msa}), transform(findings, f -> {error_line('f')})), '\\r') as ack")
