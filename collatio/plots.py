"""What the plots show, as data; drawing is left to a plotting library, where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.policy import check_columns


def comparison_data(x: DataFrame, percent: bool = True) -> DataFrame:
    """comparison ("B - A"), metric, and the difference with its interval, in percent or as rates."""
    check_columns(x.columns, "system_a", "system_b", "metric", "difference_b_minus_a", "conf_low", "conf_high")
    scale = 100.0 if percent else 1.0
    values = {"difference_plot": "difference_b_minus_a", "conf_low_plot": "conf_low", "conf_high_plot": "conf_high"}
    return x.select(F.concat_ws(" - ", "system_b", "system_a").alias("comparison"), "metric", *[(F.col(c) * scale).alias(k) for k, c in values.items()])


def error_profile_data(x: DataFrame, group: str | None = None, percent: bool = True) -> DataFrame:
    """group_value, metric, error_type, rate: a row for each bar."""
    check_columns(x.columns, group, "metric", "substitution_rate", "deletion_rate", "insertion_rate")
    value = F.col(group).cast("string") if group else F.lit("All data")
    scale = 100.0 if percent else 1.0
    kinds = ["substitution", "deletion", "insertion"]
    wide = x.select(value.alias("group_value"), "metric", *[(F.col(f"{k}_rate") * scale).alias(k) for k in kinds])
    return wide.unpivot(["group_value", "metric"], kinds, "error_type", "rate")


#: Rows that a figure shows; more raise, as no reader could tell them apart.
MOST_ROWS = 10_000


def _plt():
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("drawing needs matplotlib; the data functions have what it would show") from e
    return plt


def _shown(data: DataFrame, *order: str) -> list:
    rows = data.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows to draw")
    return rows


def draw_comparison(x: DataFrame, percent: bool = True):
    """A figure of points and error bars, if matplotlib is installed."""
    rows = _shown(comparison_data(x, percent), "comparison", "metric")
    figure, axes = _plt().subplots()
    for i, r in enumerate(rows):
        axes.errorbar([r.difference_plot], [i], xerr=[[r.difference_plot - r.conf_low_plot], [r.conf_high_plot - r.difference_plot]], fmt="o")
    axes.set_yticks(range(len(rows)), [f"{r.comparison}, {r.metric}" for r in rows])
    axes.axvline(0)
    return figure


def draw_error_profile(x: DataFrame, group: str | None = None, percent: bool = True):
    """A figure of stacked bars, one panel a metric and one bar a group, if matplotlib is installed."""
    rows = _shown(error_profile_data(x, group, percent), "metric", "group_value", "error_type")
    metrics = list(dict.fromkeys(r.metric for r in rows))
    figure, panels = _plt().subplots(1, max(1, len(metrics)), squeeze=False)
    for axes, metric in zip(panels[0], metrics, strict=False):
        groups = list(dict.fromkeys(str(r.group_value) for r in rows if r.metric == metric))
        base = dict.fromkeys(groups, 0.0)
        for kind in ("deletion", "insertion", "substitution"):
            heights = {str(r.group_value): r.rate or 0.0 for r in rows if r.metric == metric and r.error_type == kind}
            axes.bar(groups, [heights.get(g, 0.0) for g in groups], bottom=[base[g] for g in groups], label=kind)
            base = {g: base[g] + heights.get(g, 0.0) for g in groups}
        axes.set_title(metric)
        axes.legend()
    return figure
