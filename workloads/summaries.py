"""Summaries of rule verdicts, events, scores and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwatch.operators import cross_entity, summarize
from panelwatch.operators.entity import rule_features
from panelwatch.operators.events import classify_events
from panelwatch.operators.rules import apply_rules
from panelwatch.sources.io import format_datetimes
from workloads import Workloads
from workloads.features import rule_sql
from workloads.rules import EVENT_LIMITS, EVENT_SQL, RULE_LIMITS, rules_sql
from workloads.tables import (
    CUSTOMERS, EVENTS, EVENTS_BY_HOUR, ORDERS, SUPPLIER_MONTH, customers, events, num, nums, orders, supplier_month, tidy,
)

WORK = Workloads()

_ORDERS_Z = rule_sql("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders", ORDERS)
_COUNTS = f"""count(*) AS total_records, count(*) FILTER (WHERE flag) AS anomaly_count,
    {num("avg(flag::INTEGER)", "anomaly_rate")}"""
# A deterministic stand-in for a model score: the z-score of an order in its customer's recent orders, over 5.
SCORED_ORDERS_SQL = f"""
    SELECT *, coalesce(abs(o_totalprice_z_score) > 1::DOUBLE, false) AS flag,
           coalesce(o_totalprice_z_score / 5::DOUBLE, 0) AS score, least(2 * abs(coalesce(o_totalprice_z_score / 5::DOUBLE, 0)), 1) AS confidence
    FROM ({_ORDERS_Z})"""
_INDICATOR_SQL = """CASE WHEN NOT flag THEN 'NORMAL' WHEN confidence > 0.8::DOUBLE THEN 'HIGH_CONFIDENCE_ANOMALY'
    WHEN confidence > 0.6::DOUBLE THEN 'MEDIUM_CONFIDENCE_ANOMALY' ELSE 'LOW_CONFIDENCE_ANOMALY' END"""


def scored_orders(spark, folder):
    z = F.col("o_totalprice_z_score")
    flagged = rule_features(orders(spark, folder), ORDERS).select(
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        "o_totalprice",
        F.coalesce(F.abs(z) > 1, F.lit(False)).alias("is_anomaly"),
        F.coalesce(z / 5, F.lit(0.0)).alias("score"),
    )
    confidence = summarize.confidence_of_score(F.col("score"))
    return flagged.select(
        "*", confidence.alias("confidence"), summarize.indicator(F.col("is_anomaly"), confidence).alias("indicator")
    )


@WORK.add(
    "far_orders_by_customer",
    f"""SELECT o_custkey, count(*) AS total_records,
               count(*) FILTER (WHERE abs(o_totalprice_z_score) > 2::DOUBLE) AS anomaly_count,
               {num("avg(coalesce(abs(o_totalprice_z_score) > 2::DOUBLE, false)::INTEGER)", "anomaly_rate")}
        FROM ({_ORDERS_Z}) GROUP BY o_custkey""",
)
def far_orders_by_customer(spark, folder):
    """Which customers have orders far from their own recent mean, and how many each."""
    features = rule_features(orders(spark, folder), ORDERS)
    far = features.withColumn("is_anomaly", F.abs("o_totalprice_z_score") > 2.0)
    return tidy(summarize.entity_totals(far, ORDERS))


@WORK.add(
    "row_indicators",
    f"""SELECT o_orderkey, flag AS is_anomaly, {nums("score", "confidence")}, {_INDICATOR_SQL} AS indicator
        FROM ({SCORED_ORDERS_SQL})""",
)
def row_indicators(spark, folder):
    return tidy(scored_orders(spark, folder).select("o_orderkey", "is_anomaly", "score", "confidence", "indicator"))


@WORK.add(
    "rule_indicators",
    f"""SELECT l_suppkey, month, CASE WHEN final_anomaly THEN 'HIGH_CONFIDENCE_ANOMALY' ELSE 'NORMAL' END AS indicator
        FROM ({rules_sql(RULE_LIMITS)})""",
)
def rule_indicators(spark, folder):
    return classified(spark, folder).select(
        "l_suppkey", "month", summarize.rule_indicator(F.col("final_anomaly")).alias("indicator")
    )


def classified(spark, folder):
    return apply_rules(supplier_month(spark, folder), SUPPLIER_MONTH, RULE_LIMITS)


@WORK.add("table_totals", f"SELECT {_COUNTS} FROM ({SCORED_ORDERS_SQL})")
def table_totals(spark, folder):
    return tidy(summarize.table_totals(scored_orders(spark, folder)))


@WORK.add(
    "entity_indicators",
    f"""SELECT o_custkey, {_COUNTS},
               count(*) FILTER (WHERE indicator = 'HIGH_CONFIDENCE_ANOMALY') AS high_confidence_anomalies,
               count(*) FILTER (WHERE indicator = 'MEDIUM_CONFIDENCE_ANOMALY') AS medium_confidence_anomalies,
               count(*) FILTER (WHERE indicator = 'LOW_CONFIDENCE_ANOMALY') AS low_confidence_anomalies,
               count(*) FILTER (WHERE indicator = 'NORMAL') AS normal_records
        FROM (SELECT *, {_INDICATOR_SQL} AS indicator FROM ({SCORED_ORDERS_SQL})) GROUP BY o_custkey""",
)
def entity_indicators(spark, folder):
    return tidy(summarize.entity_indicators(scored_orders(spark, folder), ORDERS))


@WORK.add(
    "entity_scores",
    f"""SELECT o_custkey, {_COUNTS}, {num("avg(score)", "avg_score")}, {num("max(score)", "max_score")},
               {num("min(score)", "min_score")}
        FROM ({SCORED_ORDERS_SQL}) GROUP BY o_custkey""",
)
def entity_scores(spark, folder):
    return tidy(summarize.entity_scores(scored_orders(spark, folder), ORDERS))


@WORK.add(
    "entity_inputs",
    """SELECT user_id, 0::BIGINT AS piece, count(*) AS rows, list(ts ORDER BY ts, event_id) AS ts,
              list(value ORDER BY ts, event_id) AS value, list(event_id ORDER BY ts, event_id) AS event_id
       FROM (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events) GROUP BY user_id""",
)
def entity_inputs(spark, folder):
    df = format_datetimes(events(spark, folder))
    return summarize.entity_inputs(df, EVENTS, df.columns)


@WORK.add(
    "entity_verdicts",
    f"""SELECT l_suppkey, 0::BIGINT AS piece, count(*) AS rows, list(final_anomaly ORDER BY month) AS final_anomaly,
               list(CASE WHEN final_anomaly THEN 'HIGH_CONFIDENCE_ANOMALY' ELSE 'NORMAL' END ORDER BY month) AS indicator
        FROM ({rules_sql(RULE_LIMITS)}) GROUP BY l_suppkey""",
)
def entity_verdicts(spark, folder):
    return summarize.entity_verdicts(classified(spark, folder), SUPPLIER_MONTH, ["final_anomaly"])


@WORK.add(
    "rule_type_totals",
    f"SELECT anomaly_type, count(*) AS total_records FROM ({rules_sql(RULE_LIMITS)}) GROUP BY anomaly_type",
)
def rule_type_totals(spark, folder):
    return summarize.type_totals(classified(spark, folder))


@WORK.add(
    "rule_entity_totals",
    f"""SELECT l_suppkey, count(*) AS total_records, count(*) FILTER (WHERE final_anomaly) AS anomaly_count,
               {num("avg(final_anomaly::INTEGER)", "anomaly_rate")}
        FROM ({rules_sql(RULE_LIMITS)}) GROUP BY l_suppkey""",
)
def rule_entity_totals(spark, folder):
    return tidy(summarize.entity_totals(classified(spark, folder), SUPPLIER_MONTH, "final_anomaly"))


def _events_classified(spark, folder):
    return classify_events(events(spark, folder), EVENTS_BY_HOUR, EVENT_LIMITS)


_EVENT_COUNTS = """count(*) AS total_records, count(*) FILTER (WHERE individual_anomaly) AS individual_anomalies,
    count(*) FILTER (WHERE is_market_wide) AS market_wide_anomalies,
    count(*) FILTER (WHERE final_anomaly) AS total_anomalies"""


@WORK.add(
    "event_totals",
    f"""SELECT *, {num("individual_anomalies / total_records", "individual_anomaly_rate")},
               {num("market_wide_anomalies / total_records", "market_wide_anomaly_rate")},
               {num("total_anomalies / total_records", "total_anomaly_rate")}
        FROM (SELECT {_EVENT_COUNTS} FROM ({EVENT_SQL}))""",
)
def event_totals(spark, folder):
    return tidy(summarize.event_totals(_events_classified(spark, folder)))


@WORK.add(
    "event_type_totals", f"SELECT anomaly_type, count(*) AS total_records FROM ({EVENT_SQL}) GROUP BY anomaly_type"
)
def event_type_totals(spark, folder):
    return summarize.type_totals(_events_classified(spark, folder))


@WORK.add(
    "entity_events",
    f"""SELECT user_id, individual_anomalies AS high_confidence_anomalies,
               market_wide_anomalies AS medium_confidence_anomalies, 0::BIGINT AS low_confidence_anomalies,
               total_records - individual_anomalies - market_wide_anomalies AS normal_records,
               {num("individual_anomalies / nullif(total_records - market_wide_anomalies, 0)", "anomaly_rate")}
        FROM (SELECT user_id, {_EVENT_COUNTS} FROM ({EVENT_SQL}) GROUP BY user_id)""",
)
def entity_events(spark, folder):
    return tidy(summarize.entity_events(_events_classified(spark, folder), EVENTS_BY_HOUR))


@WORK.add(
    "event_verdicts",
    f"""SELECT user_id, 0::BIGINT AS piece, count(*) AS rows,
               list(final_anomaly ORDER BY ts, event_id) AS final_anomaly,
               list(individual_anomaly ORDER BY ts, event_id) AS individual_anomaly,
               list(is_market_wide ORDER BY ts, event_id) AS is_market_wide,
               list(CASE WHEN final_anomaly THEN 'HIGH_CONFIDENCE_ANOMALY' ELSE 'NORMAL' END ORDER BY ts, event_id)
                   AS indicator
        FROM ({EVENT_SQL}) GROUP BY user_id""",
)
def event_verdicts(spark, folder):
    flags = ["final_anomaly", "individual_anomaly", "is_market_wide"]
    return summarize.entity_verdicts(_events_classified(spark, folder), EVENTS_BY_HOUR, flags)


@WORK.add(
    "page_of_orders",
    """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
              row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number
       FROM orders QUALIFY row_number BETWEEN 201 AND 300""",
)
def page_of_orders(spark, folder):
    return summarize.page_of(orders(spark, folder), ["o_totalprice", "o_orderkey"], page=3, page_size=100)


@WORK.add(
    "page_summary",
    """SELECT count(*) AS total_records, 3 AS page, 100 AS page_size, ceil(count(*) / 100)::BIGINT AS total_pages,
              300 < count(*) AS has_next, true AS has_previous FROM orders""",
)
def page_summary(spark, folder):
    return summarize.page_summary(orders(spark, folder), page=3, page_size=100)


_FLAGGED_EVENTS_SQL = f"""SELECT *, coalesce(abs(value_z_score) > 1::DOUBLE, false) AS flag
    FROM ({rule_sql("SELECT event_id, user_id, ts, value FROM events", EVENTS)})"""
_CROSS_SQL = f"""
    SELECT *, flagged_entities / total_entities AS anomaly_rate,
           flagged_entities / total_entities >= 0.3::DOUBLE AS is_cross_entity
    FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS period,
                 count(DISTINCT user_id) FILTER (WHERE flag) AS flagged_entities,
                 count(DISTINCT user_id) AS total_entities FROM ({_FLAGGED_EVENTS_SQL}) GROUP BY ALL)"""
_CROSS_COLUMNS = f"period, flagged_entities, total_entities, {num('anomaly_rate')}, is_cross_entity"


def _flagged_events(spark, folder):
    features = rule_features(events(spark, folder), EVENTS)
    return features.withColumn("is_anomaly", F.coalesce(F.abs("value_z_score") > 1, F.lit(False)))


@WORK.add("cross_entity_periods", f"SELECT {_CROSS_COLUMNS} FROM ({_CROSS_SQL})")
def cross_entity_periods(spark, folder):
    return tidy(cross_entity.cross_entity_periods(_flagged_events(spark, folder), EVENTS))


@WORK.add("cross_entity_events", f"SELECT {_CROSS_COLUMNS} FROM ({_CROSS_SQL}) WHERE is_cross_entity")
def cross_entity_events(spark, folder):
    return tidy(cross_entity.cross_entity_events(_flagged_events(spark, folder), EVENTS))


@WORK.add(
    "cross_entity_total",
    f"""SELECT count(*) FILTER (WHERE is_cross_entity) AS total_cross_entity_events, count(*) AS periods,
               0.3::DOUBLE AS threshold_used FROM ({_CROSS_SQL})""",
)
def cross_entity_total(spark, folder):
    return cross_entity.cross_entity_total(_flagged_events(spark, folder), EVENTS)


@WORK.add(
    "cross_entity_flagged",
    f"""SELECT date_trunc('day', ts)::TIMESTAMP AS period, 0::BIGINT AS part,
               list_sort(list(DISTINCT user_id)) AS entities
        FROM ({_FLAGGED_EVENTS_SQL}) WHERE flag GROUP BY ALL""",
)
def cross_entity_flagged(spark, folder):
    return cross_entity.flagged_entities(_flagged_events(spark, folder), EVENTS)


@WORK.add(
    "cross_entity_without_time",
    f"""SELECT 'all' AS period, count(DISTINCT c_nationkey) FILTER (WHERE c_acctbal < 0) AS flagged_entities,
               count(DISTINCT c_nationkey) AS total_entities,
               {num("count(DISTINCT c_nationkey) FILTER (WHERE c_acctbal < 0) / count(DISTINCT c_nationkey)",
                    "anomaly_rate")},
               count(DISTINCT c_nationkey) FILTER (WHERE c_acctbal < 0) / count(DISTINCT c_nationkey) >= 0.3::DOUBLE
                   AS is_cross_entity FROM customer""",
)
def cross_entity_without_time(spark, folder):
    flagged = customers(spark, folder).withColumn("is_anomaly", F.col("c_acctbal") < 0)
    return tidy(cross_entity.cross_entity_periods(flagged, CUSTOMERS))
