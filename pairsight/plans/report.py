"""Text reports and figures from small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def summary(tables: dict[str, DataFrame], order: dict[str, list[str]]) -> str:
    """Each table under its name, rows in order; result tables only."""
    out = []
    for name, df in tables.items():
        rows = df.orderBy(*order.get(name, df.columns[:1])).collect()
        out.append(f"== {name} ({len(rows)} rows)")
        out.append("  ".join(df.columns))
        out += ["  ".join(f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v) for v in r) for r in rows]
        out.append("")
    return "\n".join(out)


def accuracy_figure(accuracies: DataFrame, path: str) -> bool:
    """Bars with intervals, if a plotting library is there; tells whether it drew."""
    try:
        import matplotlib
    except ImportError:
        return False
    matplotlib.use("Agg")
    from matplotlib import pyplot

    rows = accuracies.orderBy(*accuracies.columns[:3]).collect()
    height = [r["accuracy"] for r in rows]
    error = [[r["accuracy"] - r["ci95_low"] for r in rows], [r["ci95_high"] - r["accuracy"] for r in rows]]
    figure, axes = pyplot.subplots(figsize=(max(4, 0.4 * len(rows)), 3))
    axes.bar(range(len(rows)), height, yerr=error)
    axes.set_xticks(range(len(rows)), [" ".join(map(str, r[:3])) for r in rows], rotation=90)
    figure.savefig(path, bbox_inches="tight")
    return True
