"""Counts and classification metrics.

Each operator scans its input once and reduces on the map side to a handful of
rows; the metrics are arithmetic on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: more failed replies than this raise the alert, unless a run says otherwise.
PARSE_ALERT_ABOVE = 10

_TINY = 1e-15


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label, most frequent first; null labels are left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), label)


def split_distribution(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split, null included."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the bottom is 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _pairs(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Rows per (true, predicted) pair. Metrics built on it share one shuffle."""
    return df.groupBy(F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def _cells(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """The four cells of the binary matrix as one row."""
    t, p = F.col("t"), F.col("p")

    def cell(name: str, true: int, pred: int) -> Column:
        return F.coalesce(F.sum(F.when((t == true) & (p == pred), F.col("n"))), F.lit(0)).alias(name)

    return _pairs(df, y_true, y_pred).agg(cell("tn", 0, 0), cell("fp", 0, 1), cell("fn", 1, 0), cell("tp", 1, 1))


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Always four rows (``true_label``, ``pred_label``, ``n``); empty cells are 0."""
    cells = [
        F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"), F.col(name).alias("n"))
        for t, p, name in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    ]
    return _cells(df, y_true, y_pred).select(F.inline(F.array(*cells)))


def prf_binary(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: accuracy, and precision, recall, F1 of class 1. Nothing to divide by gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return _cells(df, y_true, y_pred).select(
        (tn + fp + fn + tp).alias("n"),
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", digits: int = 4
) -> DataFrame:
    """Rows per class, then accuracy, macro average and weighted average.

    Columns ``class``, ``precision``, ``recall``, ``f1``, ``support``. The
    accuracy row holds its value in ``f1``.
    """
    pairs = _pairs(df, y_true, y_pred)
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    marks = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("t").alias("c"), F.col("n").alias("sup"), none.alias("prd"), hit.alias("hit")),
                F.struct(F.col("p").alias("c"), none.alias("sup"), F.col("n").alias("prd"), none.alias("hit")),
            )
        )
    )
    per_class = marks.groupBy("c").agg(F.sum("sup").alias("sup"), F.sum("prd").alias("prd"), F.sum("hit").alias("hit"))
    row = F.struct(
        F.col("c").cast("string").alias("class"),
        _ratio(F.col("hit"), F.col("prd")).alias("precision"),
        _ratio(F.col("hit"), F.col("sup")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("prd") + F.col("sup")).alias("f1"),
        F.col("sup").alias("support"),
    )
    values = per_class.select(row.alias("row"), F.col("sup"), F.col("hit"))
    parts = ["precision", "recall", "f1"]
    # One row per class goes into the list.
    whole = values.agg(
        F.sort_array(F.collect_list("row")).alias("rows"),
        F.sum("sup").alias("total"),
        _ratio(F.sum("hit"), F.sum("sup")).alias("accuracy"),
        *[F.avg(f"row.{m}").alias(f"macro_{m}") for m in parts],
        *[_ratio(F.sum(F.col(f"row.{m}") * F.col("sup")), F.sum("sup")).alias(f"weighted_{m}") for m in parts],
    )
    empty = F.lit(None).cast("double")

    def line(name: str, *measures: Column) -> Column:
        named = [m.alias(p) for m, p in zip(measures, parts)]
        return F.struct(F.lit(name).alias("class"), *named, F.col("total").alias("support"))

    summary = F.array(
        line("accuracy", empty, empty, F.col("accuracy")),
        line("macro avg", *[F.col(f"macro_{m}") for m in parts]),
        line("weighted avg", *[F.col(f"weighted_{m}") for m in parts]),
    )
    table = whole.select(F.inline(F.concat("rows", summary)))
    return table.select("class", *[F.round(m, digits).alias(m) for m in parts], "support")


def log_loss(df: DataFrame, y_true: str = "y_true", p_one: str = "p_true") -> DataFrame:
    """Mean of -ln(probability given to the true class)."""
    p = F.when(F.col(y_true) == 1, F.col(p_one)).otherwise(1 - F.col(p_one))
    return df.agg((-F.avg(F.log(F.greatest(p, F.lit(_TINY))))).alias("log_loss"))


def run_summary(
    df: DataFrame, label: str = "llm_green_suggested", failed: str = "parse_failed", alert_above: int = PARSE_ALERT_ABOVE
) -> DataFrame:
    """One row of totals for a labelling run, with an alert on more than ``alert_above`` failed replies.

    ``failed_rate`` is their share, 0 for no rows: a large run is judged by it and not
    by a count.
    """
    n_failed = F.count_if(F.coalesce(F.col(failed), F.lit(False)))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label) == 1).alias("green"),
        F.count_if(F.col(label) == 0).alias("not_green"),
        n_failed.alias("parse_failed"),
        (n_failed > alert_above).alias("alert"),
        F.coalesce(F.try_divide(n_failed, F.count(F.lit(1))), F.lit(0.0)).alias("failed_rate"),
    )


def parse_quality(df: DataFrame, label: str = "label", ok: str = "ok") -> DataFrame:
    """How many replies parsed cleanly, through the fallback, or not at all."""
    has_label, clean = F.col(label).isNotNull(), F.col(ok)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has_label & clean).alias("clean"),
        F.count_if(has_label & ~clean).alias("fallback"),
        F.count_if(~has_label).alias("unparsed"),
    )


def metric_rows(
    df: DataFrame, run: str, y_true: str = "y_true", y_pred: str = "y_pred", p_one: str | None = None
) -> DataFrame:
    """All metrics of a run as long rows (``run``, ``section``, ``class``, ``metric``, ``value``)."""
    none = F.lit(None).cast("string")

    def long(section: str, cls: Column, table: DataFrame, names: list[str]) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
        return table.select(
            F.lit(run).alias("run"), F.lit(section).alias("section"), cls.alias("class"), F.inline(F.array(*cells))
        )

    matrix = confusion_matrix(df, y_true, y_pred).select(
        F.lit(run).alias("run"),
        F.lit("confusion_matrix").alias("section"),
        F.col("true_label").cast("string").alias("class"),
        F.concat(F.lit("pred_"), F.col("pred_label").cast("string")).alias("metric"),
        F.col("n").cast("double").alias("value"),
    )
    report = classification_report(df, y_true, y_pred)
    out = (
        long("summary", none, prf_binary(df, y_true, y_pred), ["n", "accuracy", "precision", "recall", "f1"])
        .unionByName(matrix)
        .unionByName(long("report", F.col("class"), report, ["precision", "recall", "f1", "support"]))
    )
    if p_one is not None:
        out = out.unionByName(long("summary", none, log_loss(df, y_true, p_one), ["log_loss"]))
    return out
