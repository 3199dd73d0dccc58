"""Scaling, thresholds and the trained detectors."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from panelwatch import Detector, Model, PanelSpec, refit
from panelwatch.operators import prep
from panelwatch.operators.detector import combined
from panelwatch.operators.evaluate import best_run, grouped_means, improvement
from panelwatch.operators.lof import fit_local_outlier_factor
from panelwatch.operators.registry import latest
from panelwatch.operators.scale import Scaler
from panelwatch.operators.supervised import class_weights
from panelwatch.operators.sweep import sweep, sweep_metrics
from panelwatch.operators.threshold import below, contamination_threshold
from panelwatch.operators.update import fit_with_memory, update
from panelwatch.session import shared_folder
from workloads import Workloads
from workloads.evaluation import metrics_sql
from workloads.summaries import SCORED_ORDERS_SQL, scored_orders
from workloads.tables import COMPONENTS, EVENTS, ORDERS, VECTORS, events, num, nums, orders, table, tidy, vector_panel

WORK = Workloads()

_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate"


@WORK.add(
    "robust_scaling",
    f"""WITH q AS (SELECT {", ".join(
        f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS w_{c}"
        for c in _LINE_COLUMNS)} FROM lineitem)
        SELECT {_LINE_KEYS}, {", ".join(
            num(f"({c} - m_{c}) / CASE WHEN w_{c} = 0 THEN 1 ELSE w_{c} END", f"scaled_{c}") for c in _LINE_COLUMNS)}
        FROM lineitem, q""",
)
def robust_scaling(spark, folder):
    lines = table(spark, folder, "lineitem")
    scaler = Scaler.fit(lines, _LINE_COLUMNS)
    scaled = [c.alias(f"scaled_{n}") for c, n in zip(scaler.scaled(), _LINE_COLUMNS)]
    return tidy(lines.select(*_LINE_KEYS.split(", "), *scaled))


@WORK.add(
    "contamination_threshold",
    f"""WITH s AS (SELECT o_orderkey, -abs(score) AS score FROM ({SCORED_ORDERS_SQL}))
        SELECT o_orderkey, {num("score")}, score < (SELECT quantile_cont(score, 0.1) FROM s) AS is_anomaly FROM s""",
)
def contamination_share(spark, folder):
    scores = scored_orders(spark, folder).select("o_orderkey", (-F.abs("score")).alias("score"))
    cut = contamination_threshold(scores, 0.1)
    return tidy(scores.select("o_orderkey", "score", below(F.col("score"), cut).alias("is_anomaly")))


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label"
    )


_K = 20
_LOF_SQL = f"""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings),
         pairs AS (SELECT a.vec_id AS id, b.vec_id AS ref, array_distance(a.x, b.x) AS d
                   FROM v a JOIN v b ON a.vec_id <> b.vec_id
                   QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY array_distance(a.x, b.x), b.vec_id) <= {_K}),
         reach AS (SELECT id, max(d) AS k_distance FROM pairs GROUP BY id),
         density AS (SELECT p.id, 1 / (avg(greatest(r.k_distance, d)) + 1e-10) AS density
                     FROM pairs p JOIN reach r ON p.ref = r.id GROUP BY p.id),
         factor AS (SELECT p.id, -avg(n.density) / any_value(o.density) AS score
                    FROM pairs p JOIN density n ON p.ref = n.id JOIN density o ON p.id = o.id GROUP BY p.id)"""


@WORK.add(
    "local_outlier_factor",
    f"""{_LOF_SQL} SELECT id AS vec_id, {num("score")},
        score < (SELECT quantile_cont(score, 0.1) FROM factor) AS is_anomaly FROM factor""",
)
def local_outlier_factor(spark, folder):
    rows = vectors(spark, folder)
    scored = fit_local_outlier_factor(rows, "x", _K, "vec_id").training_score(rows, "x")
    cut = contamination_threshold(scored, 0.1)
    return tidy(scored.select("vec_id", "score", below(F.col("score"), cut).alias("is_anomaly")))


DOCS = PanelSpec("source", ("n_chars",), None, ("doc_id",), label="toxic")
_DOC_FEATURES = ["n_chars", "words", "lines", "distinct_share"]
_DOC_FEATURES_SQL = """
    SELECT doc_id, n_chars::DOUBLE AS n_chars, len(w)::DOUBLE AS words, (len(string_split(text, chr(10))))::DOUBLE AS lines,
           len(list_distinct(w)) / len(w) AS distinct_share, quality, toxic
    FROM (SELECT *, string_split(text, ' ') AS w FROM documents) LEFT JOIN labels USING (doc_id)"""


def documents(spark, folder):
    """Labelled documents with four simple measures of their whole text."""
    words = F.split("text", " ")
    measured = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"),
    )
    return measured.join(table(spark, folder, "labels"), "doc_id", "left")


@WORK.add(
    "document_measures",
    f"""SELECT doc_id, {nums('n_chars', 'words', 'lines', 'distinct_share')}, toxic IS NOT NULL AS is_labelled
        FROM ({_DOC_FEATURES_SQL})""",
)
def document_measures(spark, folder):
    measured = documents(spark, folder)
    return tidy(measured.select("doc_id", *_DOC_FEATURES, F.col("toxic").isNotNull().alias("is_labelled")))


@WORK.add(
    "labelled_ratio",
    f"""SELECT count(*) AS rows, count(toxic) AS labelled,
               {num("avg((toxic IS NOT NULL)::INTEGER)", "labelled_ratio")}
        FROM documents LEFT JOIN labels USING (doc_id)""",
)
def labelled_ratio(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return tidy(prep.labelled_ratio(docs, "toxic"))


@WORK.add(
    "class_weights",
    f"""SELECT toxic, count(*) AS rows,
               {num("(SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * count(*))", "weight")}
        FROM labels GROUP BY toxic""",
)
def class_weights_labels(spark, folder):
    return tidy(class_weights(table(spark, folder, "labels"), "toxic"))


def _scored(detector, df, spec, features=None):
    return detector.fit_score(df, spec, features)[1]


_VERDICT = ["is_anomaly", "score", "confidence", "indicator"]


@WORK.add("isolation_forest_events")
def isolation_forest_events(spark, folder):
    return _scored(Detector("isolation_forest"), events(spark, folder), EVENTS).select("event_id", *_VERDICT)


@WORK.add("one_class_svm_documents")
def one_class_svm_documents(spark, folder):
    df = documents(spark, folder)
    return _scored(Detector("one_class_svm"), df, DOCS, _DOC_FEATURES).select("doc_id", *_VERDICT)


@WORK.add("local_outlier_factor_new_rows")
def local_outlier_factor_new_rows(spark, folder):
    """Every vector scored as a new point against all of them."""
    rows = vectors(spark, folder)
    return fit_local_outlier_factor(rows, "x", _K, "vec_id").score(rows, "x").select("vec_id", "score")


@WORK.add("random_forest_documents")
def random_forest_documents(spark, folder):
    """Trained on the labelled documents, scoring all."""
    df = documents(spark, folder)
    return _scored(Detector("random_forest"), df, DOCS, _DOC_FEATURES).select("doc_id", *_VERDICT)


@WORK.add("logistic_regression_documents")
def logistic_regression_documents(spark, folder):
    df = documents(spark, folder)
    return _scored(Detector("logistic_regression"), df, DOCS, _DOC_FEATURES).select("doc_id", *_VERDICT)


def _newton_sql(steps: int) -> str:
    """Newton steps of the balanced, penalised loss of one scaled feature, one subquery each."""
    ctes = []
    for i in range(steps):
        ctes.append(f"""w{i + 1} AS (
            SELECT a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b
            FROM (SELECT any_value(a) AS a, any_value(b) AS b, sum(u * (p - y) * x) + any_value(a) AS g1, sum(u * (p - y)) AS g2,
                         sum(u * p * (1 - p) * x * x) + 1 + 1e-9 AS h11, sum(u * p * (1 - p) * x) AS h12, sum(u * p * (1 - p)) + 1e-9 AS h22
                  FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS p FROM labelled, w{i})))""")
    return f"""
        WITH docs AS (SELECT doc_id, n_chars::DOUBLE AS n, toxic AS y FROM documents LEFT JOIN labels USING (doc_id)),
             scaled AS (SELECT doc_id, y, (n - m) / w AS x FROM docs, (SELECT quantile_cont(n, 0.5) AS m, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS w FROM docs)),
             labelled AS (SELECT x, y, count(*) OVER () / (2 * count(*) OVER (PARTITION BY y)) AS u FROM scaled WHERE y IS NOT NULL),
             w0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b), {", ".join(ctes)}
        SELECT doc_id, 1 / (1 + exp(-(a * x + b))) AS score FROM scaled, w{steps}"""


@WORK.add(
    "logistic_regression_newton",
    f"""SELECT doc_id, {num("score")}, score > 0.5 AS is_anomaly, {num("score", "confidence")},
               CASE WHEN NOT score > 0.5 THEN 'NORMAL' WHEN score > 0.8 THEN 'HIGH_CONFIDENCE_ANOMALY'
                    WHEN score > 0.6 THEN 'MEDIUM_CONFIDENCE_ANOMALY' ELSE 'LOW_CONFIDENCE_ANOMALY' END AS indicator
        FROM ({_newton_sql(12)})""",
)
def logistic_regression_newton(spark, folder):
    """Toxicity by the length of a document: coefficients as a table, fitted by sums that can be updated."""
    df = documents(spark, folder)
    model, _ = fit_with_memory(Detector("logistic_regression"), df, DOCS, ["n_chars"])
    return tidy(model.score(df).select("doc_id", *_VERDICT))


@WORK.add("pseudo_label_documents")
def pseudo_label_documents(spark, folder):
    """Only confirmed toxic documents carry a label, too few to learn from."""
    df = documents(spark, folder).withColumn("toxic", F.when(F.col("toxic") == 1, 1))
    return _scored(Detector("logistic_regression"), df, DOCS, _DOC_FEATURES).select("doc_id", *_VERDICT)


@WORK.add(
    "training_statistics",
    """SELECT 'isolation_forest' AS algorithm, count(*) AS n_samples, count(DISTINCT o_custkey) AS n_entities,
              32 AS n_features, 'o_custkey' AS key_column, 'o_orderdate' AS time_column,
              ['o_totalprice'] AS target_attributes FROM orders""",
)
def training_statistics(spark, folder):
    model = Detector("isolation_forest", options={"n_trees": 50}).fit(orders(spark, folder), ORDERS)
    return model.stats_table(spark).select(
        "algorithm", "n_samples", "n_entities", "n_features", "key_column", "time_column", "target_attributes"
    )


def _alike(found, want, row_id):
    """Per row of ``want``, whether ``found`` has the same verdict for it."""
    theirs = found.select(F.col(row_id).alias("__of"), F.struct(*_VERDICT).alias("found"))
    # An equality of plain ids would put a filter on one side only, and features that both sides share be computed twice.
    on = (F.struct(row_id) == F.struct("__of")) & F.col(row_id).isNotNull()
    same = F.abs(F.col("found.score") - F.col("score")) < 1e-9
    for c in ("is_anomaly", "indicator"):
        same &= F.col(f"found.{c}").eqNullSafe(F.col(c))
    return want.join(theirs, on, "left").select(row_id, F.coalesce(same, F.lit(False)).alias("alike"))


@WORK.add("saved_model_scores", "SELECT doc_id, true AS alike FROM documents")
def saved_model_scores(spark, folder):
    """Verdicts of a model that was saved and loaded, against those it gave before."""
    df = documents(spark, folder)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model = Detector("isolation_forest").fit(df, DOCS, _DOC_FEATURES)
    model.save(path, spark)
    return _alike(Model.load(path, spark).score(df), model.score(df), "doc_id")


@WORK.add("refit_with_new_rows", "SELECT o_orderkey, true AS alike FROM orders WHERE o_orderdate >= DATE '2000-01-01'")
def refit_with_new_rows(spark, folder):
    """Orders up to 1999 are history; later ones arrive. A model trained again on both against one of the whole table."""
    df = orders(spark, folder)
    earlier, later = df.filter("o_orderdate < '2000-01-01'"), df.filter("o_orderdate >= '2000-01-01'")
    detector = Detector("isolation_forest", options={"n_trees": 50})
    again, direct = refit(detector, earlier, later, ORDERS), detector.fit(df, ORDERS)
    return _alike(again.score(later, history=earlier), direct.score(later, history=earlier), "o_orderkey")


@WORK.add("forest_updated_by_memory", "SELECT doc_id, true AS alike FROM documents")
def forest_updated_by_memory(spark, folder):
    """Documents arrive in two parts; the forest that has seen one after the other against one of the whole table."""
    df = documents(spark, folder)
    detector = Detector("isolation_forest")
    model, memory = fit_with_memory(detector, df.filter("doc_id % 3 > 0"), DOCS, _DOC_FEATURES)
    model, _ = update(model, memory, df.filter("doc_id % 3 = 0"))
    found = model.score(df).select("doc_id", F.col("score").alias("found"))
    whole = detector.fit(df, DOCS, _DOC_FEATURES).score(df)
    return whole.join(found, "doc_id", "left").select("doc_id", F.coalesce(F.abs(F.col("found") - F.col("score")) < 1e-7, F.lit(False)).alias("alike"))


@WORK.add(
    "combined_keep_last",
    """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1""",
)
def combined_keep_last(spark, folder):
    df = orders(spark, folder)
    earlier, later = df.filter("o_orderdate < '2000-01-01'"), df.filter("o_orderdate >= '2000-01-01'")
    return combined(earlier, later, ORDERS, keep="last")


@WORK.add(
    "registry_latest",
    """SELECT model_id, created_at, status FROM (
           SELECT o_custkey AS model_id, o_orderdate AS created_at,
                  CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'live' END AS status
           FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
       WHERE status = 'live'""",
)
def registry_latest(spark, folder):
    """Orders read as registry entries: one model per customer, an order of status F deletes it."""
    entries = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("model_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("live").alias("status"),
        "o_orderkey",
    )
    live = latest(entries, F.struct("created_at", "o_orderkey"))
    return live.select("model_id", "created_at", "status")


def _sweep_results(spark, folder):
    df = documents(spark, folder)
    small = {"isolation_forest": {"n_trees": 50}, "one_class_svm": {"passes": 4}}
    return sweep_metrics(
        sweep(df, DOCS, ["isolation_forest", "one_class_svm"], [0.05, 0.1, 0.2], _DOC_FEATURES, small)
    )


@WORK.add("algorithm_sweep")
def algorithm_sweep(spark, folder):
    return _sweep_results(spark, folder)


_SHARES = [0.05, 0.1, 0.2]
_SCALED_LOF_SQL = _LOF_SQL.replace(
    "SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings",
    """SELECT vec_id, list((p - m) / CASE WHEN w = 0 THEN 1 ELSE w END ORDER BY i)::DOUBLE[64] AS x
            FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS p, unnest(range(len(embedding))) AS i FROM embeddings)
            JOIN (SELECT i, quantile_cont(p, 0.5) AS m, quantile_cont(p, 0.75) - quantile_cont(p, 0.25) AS w
                  FROM (SELECT unnest(embedding)::DOUBLE AS p, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)
            USING (i) GROUP BY vec_id""",
)


@WORK.add(
    "contamination_sweep",
    f"""SELECT algorithm, {num("contamination")}, tn, fp, fn, tp, {nums("accuracy", "precision", "recall", "f1_score", "auc", "anomaly_rate")}
        FROM ({metrics_sql(f"""
            {_SCALED_LOF_SQL}, cut AS (SELECT unnest({_SHARES})::DOUBLE AS contamination,
                                              unnest([{", ".join(f"(SELECT quantile_cont(score, {c}) FROM factor)" for c in _SHARES)}]) AS cut)
            SELECT 'local_outlier_factor' AS algorithm, contamination, label % 2 = 1 AS truth, score < cut AS flag
            FROM factor JOIN embeddings ON id = vec_id, cut""", "algorithm, contamination")})""",
)
def contamination_sweep(spark, folder):
    """One fit of the local outlier factor on the vectors, judged at three shares."""
    return tidy(sweep_metrics(sweep(vector_panel(spark, folder), VECTORS, ["local_outlier_factor"], _SHARES, COMPONENTS)))
