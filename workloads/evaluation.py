"""Verdicts against labels and methods against each other."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelwatch import Detector
from panelwatch.functions.exprs import any_of, is_true
from panelwatch.operators import evaluate
from panelwatch.operators.entity import rule_features
from panelwatch.operators.ground_truth import hybrid_truth, ml_truth, statistical_truth
from panelwatch.operators.peers import peer_features
from panelwatch.operators.rules import apply_rules, with_market
from panelwatch.operators.rules import rule_flags as rule_columns
from panelwatch.session import staged
from workloads import Workloads
from workloads.rules import RULE_LIMITS, STRICT_LIMITS, rules_sql
from workloads.tables import COMPONENTS, EVENTS, SUPPLIER_MONTH, VECTORS, num, nums, supplier_month, table, tidy, vector_panel

WORK = Workloads()

_METRIC_NAMES = (*evaluate.METRICS, "auc", "anomaly_rate")
_CONFUSION = """count(*) FILTER (WHERE NOT truth AND NOT flag) AS tn, count(*) FILTER (WHERE NOT truth AND flag) AS fp,
    count(*) FILTER (WHERE truth AND NOT flag) AS fn, count(*) FILTER (WHERE truth AND flag) AS tp"""


def metrics_sql(verdicts: str, by: str = "") -> str:
    group = f"{by}," if by else ""
    return f"""
        SELECT {group} tn, fp, fn, tp, (tp + tn) / (tn + fp + fn + tp) AS accuracy,
               coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
               coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score,
               coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 0.5) AS auc,
               (tp + fp) / (tn + fp + fn + tp) AS anomaly_rate
        FROM (SELECT {group} {_CONFUSION} FROM ({verdicts}) {"GROUP BY " + by if by else ""})"""


# Labelled documents; the verdict calls short ones unusual.
_DOCS_SQL = """SELECT doc_id, lang, source, n_chars, toxic = 1 AS truth, n_chars < 600 AS flag
    FROM documents JOIN labels USING (doc_id)"""


def _documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id", "lang", "source", "n_chars", (F.col("toxic") == 1).alias("truth"), (F.col("n_chars") < 600).alias("flag")
    )


@WORK.add("verdict_metrics", f"SELECT tn, fp, fn, tp, {nums(*_METRIC_NAMES)} FROM ({metrics_sql(_DOCS_SQL)})")
def verdict_metrics(spark, folder):
    return tidy(evaluate.metrics(_documents(spark, folder)))


@WORK.add(
    "verdict_metrics_by_language",
    f"SELECT lang, tn, fp, fn, tp, {nums(*_METRIC_NAMES)} FROM ({metrics_sql(_DOCS_SQL, 'lang')})",
)
def verdict_metrics_by_language(spark, folder):
    return tidy(evaluate.metrics(_documents(spark, folder), ["lang"]))


@WORK.add(
    "score_auc",
    f"""SELECT {num("sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))", "auc")}
        FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     AS below
              FROM (SELECT n_chars, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg
                    FROM ({_DOCS_SQL}) GROUP BY n_chars))""",
)
def score_auc(spark, folder):
    return tidy(evaluate.score_auc(_documents(spark, folder), "n_chars", "truth"))


@WORK.add(
    "detection_overlap",
    f"""SELECT *, {num("coalesce(true_positives / nullif(total_anomalies, 0), 0)", "detection_rate")},
               {num("coalesce(false_positives / nullif(detected_anomalies, 0), 0)", "false_positive_rate")}
        FROM (SELECT count(*) FILTER (WHERE t) AS total_anomalies, count(*) FILTER (WHERE f) AS detected_anomalies,
                     count(*) FILTER (WHERE t AND f) AS true_positives,
                     count(*) FILTER (WHERE NOT t AND f) AS false_positives,
                     count(*) FILTER (WHERE t AND NOT f) AS false_negatives
              FROM (SELECT user_id, ts, bool_or(event_type = 'error') AS t, bool_or(value > 100) AS f
                    FROM events GROUP BY user_id, ts))""",
)
def detection_overlap(spark, folder):
    flagged = table(spark, folder, "events").select(
        "user_id", "ts", (F.col("event_type") == "error").alias("truth"), (F.col("value") > 100).alias("flag")
    )
    return tidy(evaluate.detection(flagged, EVENTS, "truth", "flag"))


_ROW_ID = ["l_suppkey", "month"]


def _rules(spark, folder, limits):
    return apply_rules(supplier_month(spark, folder), SUPPLIER_MONTH, limits)


def _verdicts(classified, condition=None):
    flag = F.col("final_anomaly") if condition is None else F.coalesce(condition, F.lit(False))
    return classified.select(*_ROW_ID, flag.alias("flag"))


_BIG_MOVE = "abs(price_change) > 1"


@WORK.add(
    "ground_truth_statistical", f"SELECT l_suppkey, month, final_anomaly AS truth FROM ({rules_sql(STRICT_LIMITS)})"
)
def ground_truth_statistical(spark, folder):
    return statistical_truth(supplier_month(spark, folder), SUPPLIER_MONTH, STRICT_LIMITS)


_FOLDS = 3
_FAR = 2.5

# Each fold's vectors against those of the other folds: scaling, neighbours, densities and threshold are theirs alone.
_UNSEEN_SQL = f"""
    WITH e AS (SELECT vec_id, ('0x' || substr(md5(vec_id || '|42'), 1, 8))::BIGINT % {_FOLDS} AS fold, embedding::DOUBLE[] AS x FROM embeddings),
         parts AS (SELECT vec_id, fold, unnest(x) AS v, unnest(range(len(x))) AS d FROM e),
         folds AS (SELECT unnest(range({_FOLDS})) AS f),
         q AS (SELECT f, d, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS w
               FROM parts JOIN folds ON fold <> f GROUP BY f, d),
         s AS (SELECT f, vec_id AS id, fold, list((v - m) / CASE WHEN w = 0 THEN 1 ELSE w END ORDER BY d)::DOUBLE[64] AS x
               FROM parts JOIN q USING (d) GROUP BY f, vec_id, fold),
         pairs AS (SELECT a.f, a.id, a.fold = a.f AS unseen, b.id AS ref, array_distance(a.x, b.x) AS d
                   FROM s a JOIN s b ON a.f = b.f AND b.fold <> b.f AND a.id <> b.id
                   QUALIFY row_number() OVER (PARTITION BY a.f, a.id ORDER BY array_distance(a.x, b.x), b.id) <= 20),
         reach AS (SELECT f, id, max(d) AS k_distance FROM pairs WHERE NOT unseen GROUP BY f, id),
         around AS (SELECT p.f, p.id, unseen, avg(greatest(k_distance, d)) + 1e-10 AS distance
                    FROM pairs p JOIN reach r ON p.f = r.f AND p.ref = r.id GROUP BY p.f, p.id, unseen),
         factor AS (SELECT p.f, p.id, p.unseen, -avg(1 / n.distance) * any_value(o.distance) AS score
                    FROM pairs p JOIN around n ON p.f = n.f AND p.ref = n.id JOIN around o ON p.f = o.f AND p.id = o.id
                    GROUP BY p.f, p.id, p.unseen),
         cut AS (SELECT f, quantile_cont(score, 0.1) AS cut FROM factor WHERE NOT unseen GROUP BY f),
         verdicts AS (SELECT id AS vec_id, f::INTEGER AS fold, score, score < cut AS truth FROM factor JOIN cut USING (f) WHERE unseen)"""


def _ml_truth(spark, folder):
    return ml_truth(vector_panel(spark, folder), VECTORS, Detector("local_outlier_factor"), _FOLDS, COMPONENTS)


@WORK.add("ground_truth_ml", f"{_UNSEEN_SQL} SELECT vec_id, fold, {num('score')}, truth FROM verdicts")
def ground_truth_ml(spark, folder):
    """The verdict on each vector of a local outlier factor fitted without its fold."""
    return tidy(_ml_truth(spark, folder))


@WORK.add(
    "ground_truth_hybrid",
    f"""{_UNSEEN_SQL}
        SELECT vec_id, truth OR abs(z) > {_FAR} AS truth FROM verdicts
        JOIN (SELECT vec_id, (embedding[1]::DOUBLE - m) / s AS z FROM embeddings,
                     (SELECT avg(embedding[1]::DOUBLE) AS m, stddev_samp(embedding[1]::DOUBLE) AS s FROM embeddings)) USING (vec_id)""",
)
def ground_truth_hybrid(spark, folder):
    """Flagged by the model or far from the mean in the first component."""
    compared = peer_features(vector_panel(spark, folder), VECTORS)
    far = compared.select("vec_id", (F.abs("x0_cross_zscore") > _FAR).alias("truth"))
    return hybrid_truth(far, _ml_truth(spark, folder), VECTORS)


@WORK.add("ground_truth_forest")
def ground_truth_forest(spark, folder):
    """Statistical, out-of-fold forest and hybrid truth of the supplier months, side by side."""
    # Panel and verdicts are read several times: written once, lines are not shuffled and rows not scored again for each.
    panel = staged(supplier_month(spark, folder))
    months = panel.select("month").distinct().count()
    rules = staged(statistical_truth(panel, SUPPLIER_MONTH, STRICT_LIMITS, months))
    # One calendar feature is named month, and missing times are filled in: ``began`` keeps a row's id as it is.
    named = panel.withColumn("began", F.col("month")).withColumnRenamed("month", "at")
    spec = replace(SUPPLIER_MONTH, time="at", tie=("l_suppkey", "began"))
    forest = staged(ml_truth(named, spec, Detector("isolation_forest", options={"n_trees": 50})).select("l_suppkey", F.col("began").alias("month"), "truth"))
    both = hybrid_truth(rules, forest, SUPPLIER_MONTH)
    # Grouped and not joined, as a part of an id may be NULL.
    kinds = {"statistical": rules, "ml": forest, "hybrid": both}
    verdicts = [d.select(*_ROW_ID, *[(F.col("truth") if n == m else F.lit(None).cast("boolean")).alias(m) for m in kinds]) for n, d in kinds.items()]
    together = verdicts[0].unionByName(verdicts[1]).unionByName(verdicts[2])
    return together.groupBy(*_ROW_ID).agg(*[F.max(m).alias(m) for m in kinds])


@WORK.add(
    "hybrid_verdict",
    f"""SELECT l_suppkey, month, final_anomaly OR coalesce({_BIG_MOVE}, false) AS flag
        FROM ({rules_sql(STRICT_LIMITS)})""",
)
def hybrid_verdict(spark, folder):
    rules = _verdicts(_rules(spark, folder, STRICT_LIMITS))
    moves = _verdicts(supplier_month(spark, folder), F.expr(_BIG_MOVE))
    return evaluate.either(rules, moves, _ROW_ID)


@WORK.add(
    "rule_hits",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS attribute, count(*) FILTER (WHERE {a}_z_anomaly) AS z_score,
                   count(*) FILTER (WHERE {a}_volatility_anomaly) AS volatility,
                   count(*) FILTER (WHERE {a}_momentum_anomaly) AS momentum,
                   count(*) FILTER (WHERE {a}_percentile_anomaly) AS percentile FROM ({rules_sql(RULE_LIMITS)})"""
        for a in SUPPLIER_MONTH.attributes
    ),
)
def rule_hits(spark, folder):
    return evaluate.rule_hits(_rules(spark, folder, RULE_LIMITS), SUPPLIER_MONTH)


_METHODS_SQL = f"""
    SELECT m.method, t.truth, CASE m.method WHEN 'rules' THEN r.final_anomaly
               WHEN 'moves' THEN coalesce(abs(r.price_change) > 1, false)
               ELSE r.final_anomaly OR coalesce(abs(r.price_change) > 1, false) END AS flag
    FROM ({rules_sql(RULE_LIMITS)}) r
    JOIN (SELECT l_suppkey, month, final_anomaly AS truth FROM ({rules_sql(STRICT_LIMITS)})) t USING (l_suppkey, month),
         (VALUES ('rules'), ('moves'), ('hybrid')) m(method)"""
_COMPARED_SQL = f"SELECT *, anomaly_rate >= 0.6::DOUBLE AS meets_target FROM ({metrics_sql(_METHODS_SQL, 'method')})"


def _compared(spark, folder):
    """All methods and the truth come from one table of rule features."""
    features = with_market(rule_features(supplier_month(spark, folder), SUPPLIER_MONTH), SUPPLIER_MONTH)

    def fired(limits):
        return any_of([f for a in SUPPLIER_MONTH.attributes for f in rule_columns(a, limits).values()])

    rules, moves = fired(RULE_LIMITS), is_true(F.expr(_BIG_MOVE))
    methods = {"rules": rules, "moves": moves, "hybrid": rules | moves}
    return evaluate.compare(evaluate.verdict_columns(features, _ROW_ID, methods, fired(STRICT_LIMITS)))


@WORK.add(
    "method_comparison", f"SELECT method, tn, fp, fn, tp, {nums(*_METRIC_NAMES)}, meets_target FROM ({_COMPARED_SQL})"
)
def method_comparison(spark, folder):
    return tidy(_compared(spark, folder))


@WORK.add(
    "grouped_result_means",
    "SELECT lang, "
    + ", ".join(f"round(avg({m}) + 1e-9, 3) AS {m}" for m in evaluate.METRICS)
    + f" FROM ({metrics_sql(_DOCS_SQL, 'lang, source')}) GROUP BY lang",
)
def grouped_result_means(spark, folder):
    return evaluate.grouped_means(evaluate.metrics(_documents(spark, folder), ["lang", "source"]), ["lang"])


@WORK.add(
    "best_run",
    f"""SELECT source, tn, fp, fn, tp, {nums(*_METRIC_NAMES)} FROM ({metrics_sql(_DOCS_SQL, 'source')})
        ORDER BY f1_score DESC, source DESC LIMIT 1""",
)
def best_run(spark, folder):
    return tidy(evaluate.best_run(evaluate.metrics(_documents(spark, folder), ["source"]), tie=["source"]))


@WORK.add(
    "improvement_report",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, {num("b", "base")}, {num("o", "other")}, {num("o - b", "difference")},
                   {num("(o - b) / nullif(b, 0) * 100", "percent")}
            FROM (SELECT max({m}) FILTER (WHERE method = 'moves') AS b, max({m}) FILTER (WHERE method = 'hybrid') AS o
                  FROM ({_COMPARED_SQL}))"""
        for m in evaluate.METRICS
    ),
)
def improvement_report(spark, folder):
    return tidy(evaluate.improvement(_compared(spark, folder), "method", "moves", "hybrid"))


@WORK.add(
    "caught_or_missed",
    f"SELECT *, CASE WHEN flag THEN 'caught' ELSE 'missed' END AS outcome FROM ({_DOCS_SQL}) WHERE truth",
)
def caught_or_missed(spark, folder):
    return evaluate.caught_or_missed(_documents(spark, folder))


@WORK.add(
    "train_test_split",
    """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey || '|42'), 1, 8))::BIGINT % 10000 < 7000
                               THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def train_test_split(spark, folder):
    """Both parts under each other; the test suite checks that they are disjoint, complete and near 70/30."""
    train, test = evaluate.split_rows(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
