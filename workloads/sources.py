"""Reading, describing, writing and preparing the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwatch.functions.exprs import or_zero, ratio
from panelwatch.operators import prep
from panelwatch.plans.totals import numbered
from panelwatch.session import shared_folder
from panelwatch.sources.io import format_datetimes, load_panel, profile, write_panel
from workloads import Workloads
from workloads.tables import EVENTS, ORDERS, events, num, orders, table, tidy

WORK = Workloads()


def _round_trip(spark, df, format):
    path = f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"
    write_panel(df, path, format)
    return load_panel(spark, path, format, df.schema)


@WORK.add("load_csv", "SELECT event_id, ts, user_id, event_type, value FROM events")
def load_csv(spark, folder):
    df = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return _round_trip(spark, df, "csv")


@WORK.add("load_csv_documents", "SELECT doc_id, text, lang, source FROM documents")
def load_csv_documents(spark, folder):
    """Texts with quotes, separators and line breaks."""
    return _round_trip(spark, table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), "csv")


@WORK.add("load_json", "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders")
def load_json(spark, folder):
    return _round_trip(spark, orders(spark, folder), "jsonl")


@WORK.add("load_parquet", "SELECT event_id, user_id, ts, value FROM events")
def load_parquet(spark, folder):
    return _round_trip(spark, events(spark, folder), "parquet")


_PROFILE_TYPES = {
    "doc_id": ("bigint", "numeric"), "text": ("string", "categorical"), "lang": ("string", "categorical"),
    "source": ("string", "categorical"), "n_chars": ("bigint", "numeric"), "quality": ("int", "numeric"),
    "toxic": ("int", "numeric"),
}


@WORK.add(
    "profile_documents",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, '{k}' AS kind, count(*) AS rows, "
        f"count(*) - count({c}) AS missing FROM documents LEFT JOIN labels USING (doc_id)"
        for i, (c, (t, k)) in enumerate(_PROFILE_TYPES.items())
    ),
)
def profile_documents(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return profile(docs.select(*_PROFILE_TYPES))


@WORK.add(
    "datetimes_as_text",
    "SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders",
)
def datetimes_as_text(spark, folder):
    return format_datetimes(orders(spark, folder))


@WORK.add(
    "parse_time",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS zoned,
              CASE WHEN event_type <> 'error' THEN date_trunc('day', ts)::TIMESTAMP END AS by_format FROM events""",
)
def parse_time(spark, folder):
    bad = F.when(F.col("event_type") == "error", "not a time")
    text = table(spark, folder, "events").select(
        "event_id",
        F.coalesce(bad, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-05:00"))).alias("zoned"),
        F.coalesce(bad, F.date_format("ts", "dd/MM/yyyy")).alias("by_format"),
    )
    return text.select(
        "event_id",
        prep.parse_time("zoned").alias("zoned"),
        prep.parse_time("by_format", ["dd/MM/yyyy"]).alias("by_format"),
    )


@WORK.add(
    "wall_clock",
    "SELECT event_id, (ts - INTERVAL 3 HOUR)::TIMESTAMP AS local_time FROM events",
)
def wall_clock(spark, folder):
    instants = events(spark, folder).select("event_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC").alias("t"))
    utc_clock = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("t").cast("timestamp_ntz"))
    instants = instants.withColumn("t", utc_clock.cast("timestamp"))
    return instants.select("event_id", prep.wall_clock("t", "Etc/GMT+3").alias("local_time"))


@WORK.add(
    "fill_missing_time",
    """WITH known AS (SELECT CASE WHEN event_type <> 'error' THEN ts END AS ts, event_id FROM events),
            middle AS (SELECT quantile_cont(epoch_us(ts), 0.5) AS m FROM known WHERE ts IS NOT NULL)
       SELECT event_id, coalesce(ts, make_timestamp(CAST(floor(m) AS BIGINT))) AS ts FROM known, middle""",
)
def fill_missing_time(spark, folder):
    known = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts")
    )
    return prep.fill_missing_time(known, "ts")


@WORK.add("entity_list", "SELECT DISTINCT user_id FROM events ORDER BY user_id")
def entity_list(spark, folder):
    return prep.entities(events(spark, folder), EVENTS)


@WORK.add("entity_count", "SELECT count(DISTINCT o_custkey) AS n_entities FROM orders")
def entity_count(spark, folder):
    return prep.entity_count(orders(spark, folder), ORDERS)


@WORK.add(
    "entity_order",
    """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place
       FROM orders""",
)
def entity_order(spark, folder):
    placed = numbered(orders(spark, folder), [ORDERS.key], ORDERS.order, "place")
    return placed.select("o_orderkey", "o_custkey", "place")


@WORK.add(
    "clean_ratio",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
               {num("coalesce(l_tax / nullif(l_discount, 0), 0)", "tax_per_discount")} FROM lineitem""",
)
def clean_ratio(spark, folder):
    lines = table(spark, folder, "lineitem")
    cleaned = or_zero(ratio(F.col("l_tax"), F.col("l_discount"))).alias("tax_per_discount")
    return tidy(lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", cleaned))


@WORK.add(
    "label_values",
    """SELECT doc_id, coalesce(quality, -1) AS quality_label, coalesce((toxic = 1)::INTEGER, -1) AS toxic_label
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def label_values(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    typed = docs.select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic"))
    return typed.select(
        "doc_id",
        *[F.coalesce(prep.label_value(c), F.lit(-1)).alias(f"{c}_label") for c in ("quality", "toxic")],
    )


@WORK.add(
    "verdict_encoding",
    """SELECT doc_id, coalesce(toxic = 1, false) AS supervised, coalesce(1 - 2 * toxic = -1, false) AS unsupervised
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def verdict_encoding(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id",
        prep.verdict(F.col("toxic"), supervised=True).alias("supervised"),
        prep.verdict(1 - 2 * F.col("toxic"), supervised=False).alias("unsupervised"),
    )
