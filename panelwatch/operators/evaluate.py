"""Judge verdicts against labels, compare methods and runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.config import PanelSpec
from panelwatch.functions.exprs import is_true, ratio
from panelwatch.plans.totals import running_total

_HASH_STEPS = 10_000
METRICS = ("accuracy", "precision", "recall", "f1_score")


def row_digest(row_id: list[str], seed: int = 42) -> Column:
    """32 bits that depend on the row's id (as text) and the seed only."""
    named = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_id], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long")


def split_rows(df: DataFrame, row_id: list[str], share: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together are ``df``; a row's part depends only on its id (as text) and the seed."""
    here = row_digest(row_id, seed) % _HASH_STEPS < int(share * _HASH_STEPS)
    return df.filter(here), df.filter(~here)


def confusion(truth: str, flag: str) -> list[Column]:
    t, f = is_true(F.col(truth).cast("boolean")), is_true(F.col(flag).cast("boolean"))
    return [
        F.count_if(~t & ~f).alias("tn"),
        F.count_if(~t & f).alias("fp"),
        F.count_if(t & ~f).alias("fn"),
        F.count_if(t & f).alias("tp"),
    ]


def metrics(verdicts: DataFrame, by: list[str] | None = None, truth: str = "truth", flag: str = "flag") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, AUC of the hard verdicts and anomaly rate, per group.

    Undefined ratios are 0, an undefined AUC is 0.5.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    counts = verdicts.groupBy(*(by or [])).agg(*confusion(truth, flag))
    rows = tn + fp + fn + tp
    auc = (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2
    return counts.select(
        "*",
        or_zero(ratio(tp + tn, rows)).alias("accuracy"),
        or_zero(ratio(tp, tp + fp)).alias("precision"),
        or_zero(ratio(tp, tp + fn)).alias("recall"),
        or_zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_score"),
        F.coalesce(auc, F.lit(0.5)).alias("auc"),
        or_zero(ratio(tp + fp, rows)).alias("anomaly_rate"),
    )


def score_auc(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the ROC curve of a numeric score, with ties counted half.

    Equal scores are summed first; what remains is one running total over the distinct scores.
    """
    positive = is_true(F.col(truth).cast("boolean"))
    per_score = (
        scored.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("s"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )
    placed = running_total(per_score, [], ["s"], F.col("neg"), "below")
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return placed.agg(F.coalesce(ratio(won, pairs), F.lit(0.5)).alias("auc"))


def detection(df: DataFrame, spec: PanelSpec, truth: str, flag: str) -> DataFrame:
    """Overlap of true and detected anomalies as sets of (entity, time): rate of true ones found, share of false ones."""
    place = [spec.key] + ([spec.time] if spec.time else list(spec.tie))
    t, f = is_true(F.col(truth).cast("boolean")), is_true(F.col(flag).cast("boolean"))
    per_place = df.groupBy(*place).agg(F.max(t).alias("__true"), F.max(f).alias("__flag"))
    total, found = F.col("total_anomalies"), F.col("detected_anomalies")
    hits, extra = F.col("true_positives"), F.col("false_positives")
    return per_place.agg(
        F.count_if("__true").alias("total_anomalies"),
        F.count_if("__flag").alias("detected_anomalies"),
        F.count_if(F.col("__true") & F.col("__flag")).alias("true_positives"),
        F.count_if(~F.col("__true") & F.col("__flag")).alias("false_positives"),
        F.count_if(F.col("__true") & ~F.col("__flag")).alias("false_negatives"),
    ).select(
        "*",
        F.coalesce(ratio(hits, total), F.lit(0.0)).alias("detection_rate"),
        F.coalesce(ratio(extra, found), F.lit(0.0)).alias("false_positive_rate"),
    )


def either(a: DataFrame, b: DataFrame, row_id: list[str], flag: str = "flag") -> DataFrame:
    """Hybrid verdict: flagged by one method or the other, matched by row id."""
    both = a.select(*row_id, flag).unionByName(b.select(*row_id, flag))
    return both.groupBy(*row_id).agg(F.max(is_true(F.col(flag))).alias(flag))


def rule_hits(classified: DataFrame, spec: PanelSpec) -> DataFrame:
    """How often each rule fires, one row per attribute."""
    rules = ("z", "volatility", "momentum", "percentile")
    counts = classified.agg(
        *[F.count_if(f"{a}_{r}_anomaly").alias(f"{i}_{r}") for i, a in enumerate(spec.attributes) for r in rules]
    )
    rows = [
        F.struct(F.lit(a).alias("attribute"), *[F.col(f"{i}_{r}").alias("z_score" if r == "z" else r) for r in rules])
        for i, a in enumerate(spec.attributes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def verdict_columns(df: DataFrame, row_id: list[str], methods: dict[str, Column], truth: Column) -> DataFrame:
    """(method, row id, truth, flag) of verdicts that are columns of one table: one pass, however many methods."""
    flags = [F.struct(F.lit(m).alias("method"), is_true(c).alias("flag")) for m, c in methods.items()]
    named = df.select(*row_id, is_true(truth).alias("truth"), F.inline(F.array(*flags)))
    return named.select("method", *row_id, "truth", "flag")


def long_verdicts(methods: dict[str, DataFrame], row_id: list[str], flag: str = "flag") -> DataFrame:
    """(method, row id, flag) of several verdict tables, one under the other."""
    parts = [d.select(F.lit(m).alias("method"), *row_id, is_true(F.col(flag)).alias("flag")) for m, d in methods.items()]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


def compare(
    verdicts: DataFrame, truth: DataFrame | None = None, row_id: list[str] | None = None, target_rate: float = 0.6
) -> DataFrame:
    """One row per method: confusion counts, metrics, and whether its anomaly rate reaches ``target_rate``.

    ``truth`` is joined by row id, unless the verdicts carry it already.
    """
    if truth is not None:
        known = truth.select(*[F.col(c).alias(f"__of_{c}") for c in row_id], F.col("truth"))
        verdicts = verdicts.join(known, [F.col(c) == F.col(f"__of_{c}") for c in row_id])
    return metrics(verdicts, ["method"]).withColumn("meets_target", F.col("anomaly_rate") >= target_rate)


def grouped_means(results: DataFrame, by: list[str], columns: Iterable[str] = METRICS, digits: int = 3) -> DataFrame:
    return results.groupBy(*by).agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])


def best_run(results: DataFrame, by: str = "f1_score", tie: list[str] | None = None) -> DataFrame:
    """The result row with the highest ``by``; equal ones are settled by the ``tie`` columns."""
    rank = F.struct(F.col(by), *[F.col(c) for c in tie or []])
    return results.agg(F.max_by(F.struct("*"), rank).alias("best")).select("best.*")


def improvement(results: DataFrame, run: str, base: str, other: str, columns: Iterable[str] = METRICS) -> DataFrame:
    """One row per metric: value in each run, difference, and difference relative to the base in percent."""
    columns = list(columns)
    picked = results.filter(F.col(run).isin(base, other)).agg(
        *[
            F.max(F.when(F.col(run) == r, F.col(c))).alias(f"{side}_{c}")
            for side, r in (("base", base), ("other", other))
            for c in columns
        ]
    )

    def row(c: str) -> Column:
        b, o = F.col(f"base_{c}").cast("double"), F.col(f"other_{c}").cast("double")
        return F.struct(
            F.lit(c).alias("metric"),
            b.alias("base"),
            o.alias("other"),
            (o - b).alias("difference"),
            (ratio(o - b, b) * 100).alias("percent"),
        )

    return picked.select(F.inline(F.array(*[row(c) for c in columns])))


def caught_or_missed(verdicts: DataFrame, truth: str = "truth", flag: str = "flag") -> DataFrame:
    """The true anomalies, each marked caught or missed."""
    caught = F.when(is_true(F.col(flag).cast("boolean")), "caught").otherwise("missed")
    return verdicts.filter(is_true(F.col(truth).cast("boolean"))).withColumn("outcome", caught)
