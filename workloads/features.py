"""Rolling, peer and calendar features."""

from __future__ import annotations

from panelwatch.config import ENTITY_FEATURES, PEER_STATISTICS, PanelSpec
from panelwatch.operators.calendar import calendar_features
from panelwatch.operators.entity import RULE_FEATURES, entity_features, rule_features
from panelwatch.operators.peers import peer_features, period_statistics
from workloads import Workloads
from workloads.tables import (
    CUSTOMERS, EVENTS, ORDERS, SUPPLIER_MONTH, SUPPLIER_MONTH_SQL, customers, events, num, nums, orders, supplier_month,
    tidy,
)

WORK = Workloads()


def _frame(n: int, alias: str = "w") -> str:
    return f"({alias} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rank(a: str, n: int) -> str:
    seen = f"list({a}) FILTER (WHERE {a} IS NOT NULL) OVER {_frame(n)}"
    return (
        f"CASE WHEN {a} IS NOT NULL THEN (len(list_filter({seen}, lambda x: x < {a})) + "
        f"(len(list_filter({seen}, lambda x: x = {a})) + 1) / 2.0) / len({seen}) END"
    )


def entity_sql(source: str, spec: PanelSpec, id_column: str, attribute: str) -> str:
    """The 14 features of one attribute as three nested SELECTs: filled values, windows, windows over changes."""
    a, order = attribute, ", ".join(spec.order)
    w = f"WINDOW w AS (PARTITION BY {spec.key} ORDER BY {order})"
    return f"""
        WITH filled AS (
            SELECT *, last_value({a} IGNORE NULLS) OVER {_frame(1_000_000_000)} AS ff FROM ({source}) {w}),
        level AS (
            SELECT *, ff / nullif(lag(ff) OVER w, 0) - 1 AS change,
                   avg({a}) OVER {_frame(5)} AS ma_5, avg({a}) OVER {_frame(20)} AS ma_20,
                   stddev_samp({a}) OVER {_frame(5)} AS std_5, stddev_samp({a}) OVER {_frame(20)} AS std_20,
                   {a} / nullif(lag({a}, 5) OVER w, 0) - 1 AS momentum_5,
                   {a} / nullif(lag({a}, 20) OVER w, 0) - 1 AS momentum_20,
                   {_rank(a, 20)} AS percentile_5, {_rank(a, 50)} AS percentile_20
            FROM filled {w}),
        spread AS (
            SELECT *, stddev_samp(change) OVER {_frame(5)} AS volatility_5,
                   stddev_samp(change) OVER {_frame(20)} AS volatility_20
            FROM level {w})
        SELECT {id_column}, {", ".join(num(f"coalesce({e}, 0)", f"{a}_{n}") for n, e in {
            "change": "change", "ma_5": "ma_5", "ma_20": "ma_20", "std_5": "std_5", "std_20": "std_20",
            "zscore_5": f"({a} - ma_5) / CASE WHEN std_5 = 0 THEN 1 ELSE std_5 END",
            "zscore_20": f"({a} - ma_20) / CASE WHEN std_20 = 0 THEN 1 ELSE std_20 END",
            "volatility_5": "volatility_5", "volatility_20": "volatility_20",
            "volatility_ratio": "volatility_5 / CASE WHEN volatility_20 = 0 THEN 1 ELSE volatility_20 END",
            "momentum_5": "momentum_5", "momentum_20": "momentum_20",
            "percentile_5": "percentile_5", "percentile_20": "percentile_20",
        }.items())}
        FROM spread"""


def rule_sql(source: str, spec: PanelSpec) -> str:
    """The nine rule inputs of every attribute, unrounded, next to the columns of ``source``."""
    w = f"WINDOW w AS (PARTITION BY {spec.key} ORDER BY {', '.join(spec.order)})"
    windows, derived = [], []
    for a in spec.attributes:

        def over(n, needed, aggregate, name, a=a):
            return f"CASE WHEN count({a}) OVER {_frame(n)} >= {needed} THEN {aggregate} OVER {_frame(n)} END AS {a}_{name}"

        windows += [
            over(20, 5, f"avg({a})", "rolling_mean"),
            over(20, 5, f"stddev_samp({a})", "rolling_std"),
            over(10, 5, f"stddev_samp({a})", "volatility_10"),
            over(30, 5, f"stddev_samp({a})", "volatility_30"),
            over(5, 3, f"sum({a})", "momentum_5"),
            over(10, 5, f"sum({a})", "momentum_10"),
            f"CASE WHEN count({a}) OVER {_frame(20)} >= 5 THEN {_rank(a, 20)} END AS {a}_percentile_20",
        ]
        derived += [
            f"({a} - {a}_rolling_mean) / ({a}_rolling_std + 1e-8) AS {a}_z_score",
            f"{a}_volatility_10 / ({a}_volatility_30 + 1e-8) AS {a}_volatility_ratio",
        ]
    return f"SELECT *, {', '.join(derived)} FROM (SELECT *, {', '.join(windows)} FROM ({source}) {w})"


def peer_sql(source: str, spec: PanelSpec, id_column: str, period: str | None, skip_small: bool = False) -> str:
    a = spec.attributes[0]

    def stats(prefix: str) -> str:
        return f"""count(*) AS {prefix}rows, avg({a}) AS {prefix}mean, stddev_samp({a}) AS {prefix}std,
            quantile_cont({a}, 0.5) AS {prefix}median, min({a}) AS {prefix}min, max({a}) AS {prefix}max,
            quantile_cont({a}, 0.25) AS {prefix}q25, quantile_cont({a}, 0.75) AS {prefix}q75"""

    if period is None:
        joined = f"SELECT * FROM source, (SELECT {stats('')} FROM source)"
    else:
        small = "NULL" if skip_small else "g_{0}"
        chosen = ", ".join(f"CASE WHEN p_rows < 2 THEN {small.format(s)} ELSE p_{s} END AS {s}" for s in PEER_STATISTICS)
        joined = f"""SELECT source.*, {chosen}
            FROM source LEFT JOIN (SELECT {period} AS p, {stats('p_')} FROM source GROUP BY ALL) ON {period} = p,
                 (SELECT {stats('g_')} FROM source)"""
    return f"""
        WITH source AS ({source}), joined AS ({joined})
        SELECT {id_column}, {", ".join(num(f"coalesce({s}, 0)", f"cross_{a}_{s}") for s in PEER_STATISTICS)},
               {num(f"coalesce(CASE WHEN max = min THEN 0.5 ELSE ({a} - min) / (max - min) END, 0)",
                    f"{a}_relative_position")},
               {num(f"coalesce(CASE WHEN std = 0 THEN 0 ELSE ({a} - mean) / std END, 0)", f"{a}_cross_zscore")}
        FROM joined"""


_EVENTS = "SELECT event_id, user_id, ts, value FROM events"
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders"
_DAY = "date_trunc('day', ts)"


@WORK.add("entity_features_events", entity_sql(_EVENTS, EVENTS, "event_id", "value"))
def entity_features_events(spark, folder):
    df = entity_features(events(spark, folder), EVENTS)
    return tidy(df.select("event_id", *[f"value_{s}" for s in ENTITY_FEATURES]))


@WORK.add("entity_features_orders", entity_sql(_ORDERS, ORDERS, "o_orderkey", "o_totalprice"))
def entity_features_orders(spark, folder):
    df = entity_features(orders(spark, folder), ORDERS)
    return tidy(df.select("o_orderkey", *[f"o_totalprice_{s}" for s in ENTITY_FEATURES]))


@WORK.add(
    "entity_features_supplier_month",
    "SELECT * FROM "
    + " JOIN ".join(f"({entity_sql(SUPPLIER_MONTH_SQL, SUPPLIER_MONTH, 'l_suppkey, month', a)}) {a}" for a in SUPPLIER_MONTH.attributes)
    + " USING (l_suppkey, month)",
)
def entity_features_supplier_month(spark, folder):
    df = entity_features(supplier_month(spark, folder), SUPPLIER_MONTH)
    names = [f"{a}_{s}" for a in SUPPLIER_MONTH.attributes for s in ENTITY_FEATURES]
    return tidy(df.select("l_suppkey", "month", *names))


@WORK.add(
    "rule_features_events",
    f"SELECT event_id, {nums(*[f'value_{s}' for s in RULE_FEATURES])} FROM ({rule_sql(_EVENTS, EVENTS)})",
)
def rule_features_events(spark, folder):
    return tidy(rule_features(events(spark, folder), EVENTS).select("event_id", *[f"value_{s}" for s in RULE_FEATURES]))


@WORK.add(
    "rule_features_orders",
    f"SELECT o_orderkey, {nums(*[f'o_totalprice_{s}' for s in RULE_FEATURES])} FROM ({rule_sql(_ORDERS, ORDERS)})",
)
def rule_features_orders(spark, folder):
    df = rule_features(orders(spark, folder), ORDERS)
    return tidy(df.select("o_orderkey", *[f"o_totalprice_{s}" for s in RULE_FEATURES]))


_PEER_NAMES = [f"cross_{{a}}_{s}" for s in PEER_STATISTICS] + ["{a}_relative_position", "{a}_cross_zscore"]


def _peer_columns(a: str) -> list[str]:
    return [n.format(a=a) for n in _PEER_NAMES]


@WORK.add("peer_features_events_by_day", peer_sql(_EVENTS, EVENTS, "event_id", _DAY))
def peer_features_events_by_day(spark, folder):
    return tidy(peer_features(events(spark, folder), EVENTS).select("event_id", *_peer_columns("value")))


@WORK.add("peer_features_orders", peer_sql(_ORDERS, ORDERS, "o_orderkey", "o_orderdate"))
def peer_features_orders(spark, folder):
    return tidy(peer_features(orders(spark, folder), ORDERS).select("o_orderkey", *_peer_columns("o_totalprice")))


@WORK.add("peer_features_small_skipped", peer_sql(_ORDERS, ORDERS, "o_orderkey", "o_orderdate", skip_small=True))
def peer_features_small_skipped(spark, folder):
    df = peer_features(orders(spark, folder), ORDERS, small_period="skip")
    return tidy(df.select("o_orderkey", *_peer_columns("o_totalprice")))


@WORK.add(
    "peer_features_without_time",
    peer_sql("SELECT c_custkey, c_nationkey, c_acctbal FROM customer", CUSTOMERS, "c_custkey", None),
)
def peer_features_without_time(spark, folder):
    return tidy(peer_features(customers(spark, folder), CUSTOMERS).select("c_custkey", *_peer_columns("c_acctbal")))


@WORK.add(
    "period_statistics",
    f"""SELECT period, rows, {nums(*[f"value_{s}" for s in PEER_STATISTICS])} FROM (
        SELECT {_DAY}::TIMESTAMP AS period, count(*) AS rows, avg(value) AS value_mean, stddev_samp(value) AS value_std,
               quantile_cont(value, 0.5) AS value_median, min(value) AS value_min, max(value) AS value_max,
               quantile_cont(value, 0.25) AS value_q25, quantile_cont(value, 0.75) AS value_q75
        FROM events GROUP BY ALL)""",
)
def period_statistics_events(spark, folder):
    return tidy(period_statistics(events(spark, folder), EVENTS))


def _ranked(p: float) -> str:
    """The smallest value whose rank reaches ``p``."""
    return f"list_sort(list(value) FILTER (WHERE value IS NOT NULL))[greatest(1, ceil({p} * count(value)))::INTEGER]"


@WORK.add(
    "period_statistics_sketched",
    f"""SELECT period, rows, {nums(*[f"value_{s}" for s in PEER_STATISTICS])} FROM (
        SELECT {_DAY}::TIMESTAMP AS period, count(*) AS rows, avg(value) AS value_mean, stddev_samp(value) AS value_std,
               {_ranked(0.5)} AS value_median, min(value) AS value_min, max(value) AS value_max,
               {_ranked(0.25)} AS value_q25, {_ranked(0.75)} AS value_q75
        FROM events GROUP BY ALL)""",
)
def period_statistics_sketched(spark, folder):
    """The periods of the given tables hold fewer values than the sketch, whose ranks are then exact."""
    return tidy(period_statistics(events(spark, folder), EVENTS, rank_error=0.0003))


CALENDAR_SQL = """SELECT event_id, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week,
              day(ts)::INTEGER AS day_of_month, month(ts)::INTEGER AS month, quarter(ts)::INTEGER AS quarter,
              year(ts)::INTEGER AS year, (isodow(ts) >= 6)::INTEGER AS is_weekend,
              (ts::DATE = last_day(ts::DATE))::INTEGER AS is_month_end,
              (ts::DATE = last_day(ts::DATE) AND month(ts) % 3 = 0)::INTEGER AS is_quarter_end
       FROM events"""


@WORK.add("calendar_features", CALENDAR_SQL)
def calendar_features_events(spark, folder):
    return calendar_features(events(spark, folder), EVENTS).drop("user_id", "ts", "value")


@WORK.add(
    "calendar_features_orders",
    """SELECT o_orderkey, day(o_orderdate)::INTEGER AS day_of_month, quarter(o_orderdate)::INTEGER AS quarter,
              year(o_orderdate)::INTEGER AS year,
              (o_orderdate::DATE = last_day(o_orderdate::DATE))::INTEGER AS is_month_end,
              (o_orderdate::DATE = last_day(o_orderdate::DATE) AND month(o_orderdate) % 3 = 0)::INTEGER AS is_quarter_end
       FROM orders""",
)
def calendar_features_orders(spark, folder):
    df = calendar_features(orders(spark, folder), ORDERS)
    return df.select("o_orderkey", "day_of_month", "quarter", "year", "is_month_end", "is_quarter_end")
