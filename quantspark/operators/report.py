"""Reports: the comparison of runs as a table, and one run as text for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the comparison: caption, metric, whether it is a percentage.
COMPARED = (
    ("Total Return", "total_return", True), ("Ann. Return", "annualized_return", True), ("Ann. Vol", "annualized_volatility", True),
    ("Sharpe", "sharpe_ratio", False), ("Sortino", "sortino_ratio", False), ("Max DD", "max_drawdown", True),
    ("Calmar", "calmar_ratio", False), ("Win Rate", "win_rate", True), ("Profit Factor", "profit_factor", False),
)


def comparison(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """metric and a column per run."""
    names = [m for _, m, _ in COMPARED]
    long = metrics.select("run_id", *(F.col(m).cast("double").alias(m) for m in names)).unpivot(["run_id"], names, "metric", "value")
    return long.groupBy("metric").pivot("run_id", runs).agg(F.first("value"))


def comparison_text(metrics: DataFrame, runs: list[str]) -> str:
    by = {r["run_id"]: r for r in metrics.where(F.col("run_id").isin(runs)).collect()}
    lines = [f"{'':16}" + "".join(f"{r:>16}" for r in runs)]
    for caption, metric, percent in COMPARED:
        values = [by[r][metric] if r in by else None for r in runs]
        lines.append(f"{caption:16}" + "".join(f"{'N/A':>16}" if v is None else f"{v:16.2%}" if percent else f"{v:16.3f}" for v in values))
    return "\n".join(lines) + "\n"


def text_summary(run_id: str, windows: DataFrame, metrics: DataFrame, trades: DataFrame, checks: DataFrame | None = None) -> str:
    """Overview, metrics, windows, checks and costs of one run.  Everything collected is a row per window or check."""
    own = F.col("run_id") == run_id
    found = metrics.where(own).first()
    lines = ["=" * 60, f"Backtest of {run_id}", "=" * 60]
    if found is None:
        return "\n".join([*lines, "no returns", ""])
    each = windows.where(own).orderBy("window_idx").collect()
    lines += [f"period {each[0]['test_start']} to {each[-1]['test_end']}, {len(each)} windows"] if each else []
    lines += [f"  {k:28}{v:>14.4f}" for k, v in found.asDict().items() if k != "run_id" and v is not None]
    lines += [f"  window {w['window_idx']}: {w['test_start']} to {w['test_end']}, return {w['window_return']:+.2%}, {w['n_trades']} trades" for w in each]
    if checks is not None:
        lines += [f"  [{'pass' if c['passed'] else 'FAIL'}] {c['name']}: {c['value']:.3f}" for c in checks.where(own).orderBy("name").collect()]
    cost = trades.where(own).agg(F.sum("total_cost").alias("cost"), F.sum(F.abs("gross_value")).alias("gross")).first()
    if cost["gross"]:
        lines.append(f"  costs {cost['cost']:,.2f}, {cost['cost'] / cost['gross']:.4%} of the traded value")
    return "\n".join([*lines, ""])
