"""Rule detector and event classification."""

from __future__ import annotations

from panelwatch.config import EventThresholds, RuleThresholds
from panelwatch.operators.events import classify_events, market_periods, period_highs
from panelwatch.operators.entity import rule_features
from panelwatch.operators.rules import RULES, apply_rules, market_statistics
from workloads import Workloads
from workloads.features import rule_sql
from workloads.tables import (
    EVENTS_BY_HOUR, SUPPLIER_MONTH, SUPPLIER_MONTH_SQL, events, num, nums, supplier_month, tidy,
)

WORK = Workloads()

# Changes of monthly totals are far larger than daily returns, hence the wider momentum threshold.
RULE_LIMITS = RuleThresholds(momentum_threshold=2.0)
STRICT_LIMITS = RuleThresholds(
    z_threshold=2.5, momentum_threshold=3.0, percentile_threshold=0.05, volatility_threshold=2.5
)
EVENT_LIMITS = EventThresholds(correlation_threshold=0.1)

_FEATURES = rule_sql(SUPPLIER_MONTH_SQL, SUPPLIER_MONTH)
_MARKET = ", ".join(
    f"avg({a}_z_score) AS {a}_market_z_mean, stddev_samp({a}_z_score) AS {a}_market_z_std, "
    f"avg({a}_volatility_10) AS {a}_market_volatility"
    for a in SUPPLIER_MONTH.attributes
)


def rules_sql(th: RuleThresholds, market_rule: bool = True) -> str:
    """Every row of the supplier panel with its rule flags, final flag and type."""
    d = {k: f"{v}::DOUBLE" for k, v in vars(th).items()}
    flags, types = [], []
    for a in SUPPLIER_MONTH.attributes:
        market = (
            f"abs({a}_market_z_mean) > {d['market_threshold']} OR {a}_market_z_std > {d['market_spread_threshold']}"
            if market_rule
            else "false"
        )
        conditions = {
            "z": f"abs({a}_z_score) > {d['z_threshold']}",
            "volatility": f"{a}_volatility_ratio > {d['volatility_threshold']} "
            f"OR {a}_volatility_10 > {a}_volatility_30 * 1.5::DOUBLE",
            "momentum": f"abs({a}_momentum_5) > {d['momentum_threshold']} "
            f"OR abs({a}_momentum_10) > {d['momentum_threshold']} * 1.5::DOUBLE",
            "percentile": f"{a}_percentile_20 < {d['percentile_threshold']} "
            f"OR {a}_percentile_20 > 1::DOUBLE - {d['percentile_threshold']}",
            "market_wide": market,
        }
        for rule, condition in conditions.items():
            flags.append(f"coalesce({condition}, false) AS {a}_{rule}_anomaly")
            types.append(f"WHEN {a}_{rule}_anomaly THEN '{a}_{'z_score' if rule == 'z' else rule}'")
    names = [f"{a}_{r}_anomaly" for a in SUPPLIER_MONTH.attributes for r in RULES]
    return f"""
        WITH features AS ({_FEATURES}),
             market AS (SELECT month AS market_month, {_MARKET} FROM features GROUP BY month),
             flagged AS (SELECT *, {", ".join(flags)} FROM features LEFT JOIN market ON month = market_month)
        SELECT *, {" OR ".join(names)} AS final_anomaly, CASE {" ".join(types)} ELSE 'normal' END AS anomaly_type
        FROM flagged"""


_FLAG_NAMES = [f"{a}_{r}_anomaly" for a in SUPPLIER_MONTH.attributes for r in RULES]


@WORK.add(
    "market_statistics",
    f"""SELECT period, {nums(*[f"{a}_{s}" for a in SUPPLIER_MONTH.attributes
                               for s in ("market_z_mean", "market_z_std", "market_volatility")])}
        FROM (SELECT month AS period, {_MARKET} FROM ({_FEATURES}) GROUP BY month)""",
)
def market_statistics_supplier_month(spark, folder):
    return tidy(market_statistics(rule_features(supplier_month(spark, folder), SUPPLIER_MONTH), SUPPLIER_MONTH))


@WORK.add(
    "rule_flags",
    f"SELECT l_suppkey, month, {', '.join(_FLAG_NAMES)}, final_anomaly, anomaly_type FROM ({rules_sql(RULE_LIMITS)})",
)
def rule_flags(spark, folder):
    df = apply_rules(supplier_month(spark, folder), SUPPLIER_MONTH, RULE_LIMITS)
    return df.select("l_suppkey", "month", *_FLAG_NAMES, "final_anomaly", "anomaly_type")


@WORK.add(
    "rule_flags_without_market",
    f"SELECT l_suppkey, month, final_anomaly, anomaly_type FROM ({rules_sql(STRICT_LIMITS, market_rule=False)})",
)
def rule_flags_without_market(spark, folder):
    df = apply_rules(supplier_month(spark, folder), SUPPLIER_MONTH, STRICT_LIMITS, market_rule=False)
    return df.select("l_suppkey", "month", "final_anomaly", "anomaly_type")


_EVENT_FEATURES = rule_sql("SELECT event_id, user_id, ts, value FROM events", EVENTS_BY_HOUR)
_HIGH = f"coalesce(abs(value_z_score) > {EVENT_LIMITS.z_threshold}::DOUBLE, false)"
_PERIODS = f"""
    SELECT *, total >= 2 AND value_high >= greatest(2, floor(total * {EVENT_LIMITS.correlation_threshold}::DOUBLE))
              AS is_market_wide
    FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS period, count(*) AS total,
                 count(*) FILTER (WHERE {_HIGH}) AS value_high
          FROM ({_EVENT_FEATURES}) GROUP BY ALL)"""
EVENT_SQL = f"""
    SELECT e.*, is_market_wide, individual_anomaly, individual_anomaly OR is_market_wide AS final_anomaly,
           CASE WHEN is_market_wide THEN 'value_market_wide' ELSE 'none' END AS market_wide_reason,
           CASE WHEN individual_anomaly THEN 'individual' WHEN is_market_wide THEN 'market_wide' ELSE 'normal' END
               AS anomaly_type
    FROM (SELECT f.*, is_market_wide, {_HIGH} AND NOT is_market_wide AND total >= 2 AS individual_anomaly
          FROM ({_EVENT_FEATURES}) f JOIN ({_PERIODS}) p ON date_trunc('hour', f.ts) = p.period) e"""


@WORK.add(
    "event_periods",
    f"""SELECT period, total, value_high, is_market_wide,
               CASE WHEN is_market_wide THEN 'value_market_wide' ELSE 'none' END AS market_wide_reason
        FROM ({_PERIODS})""",
)
def event_periods(spark, folder):
    features = rule_features(events(spark, folder), EVENTS_BY_HOUR)
    return market_periods(period_highs(features, EVENTS_BY_HOUR, EVENT_LIMITS), EVENTS_BY_HOUR, EVENT_LIMITS)


@WORK.add(
    "event_classes",
    f"""SELECT event_id, {num("value_z_score")}, is_market_wide, market_wide_reason, individual_anomaly, final_anomaly,
               anomaly_type FROM ({EVENT_SQL})""",
)
def event_classes(spark, folder):
    df = classify_events(events(spark, folder), EVENTS_BY_HOUR, EVENT_LIMITS)
    return tidy(df.select("event_id", "value_z_score", "is_market_wide", "market_wide_reason", "individual_anomaly",
                          "final_anomaly", "anomaly_type"))
