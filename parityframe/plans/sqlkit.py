"""Small text helpers for the DuckDB oracle SQL (independent of the Spark
code paths: plain GROUP BY / window SQL written by hand)."""

from __future__ import annotations


def counts_sql(y: str = "y_true", p: str = "y_pred") -> str:
    """Confusion counts as BIGINT select items."""
    return (f"CAST(count_if(NOT ({y} = 1) AND NOT ({p} = 1)) AS BIGINT) AS tn, "
            f"CAST(count_if(NOT ({y} = 1) AND {p} = 1) AS BIGINT) AS fp, "
            f"CAST(count_if({y} = 1 AND NOT ({p} = 1)) AS BIGINT) AS fn, "
            f"CAST(count_if({y} = 1 AND {p} = 1) AS BIGINT) AS tp")


def div(num: str, den: str, zero: float | None) -> str:
    e = f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0)"
    return e if zero is None else f"COALESCE({e}, {float(zero)})"


METRIC_SQL = {
    "n": lambda: "CAST(tn + fp + fn + tp AS BIGINT)",
    "accuracy": lambda: div("tp + tn", "tn + fp + fn + tp", None),
    "precision": lambda: div("tp", "tp + fp", 0.0),
    "recall": lambda: div("tp", "tp + fn", 0.0),
    "f1": lambda: div("2 * tp", "2 * tp + fp + fn", 0.0),
    "tpr": lambda: div("tp", "tp + fn", None),
    "fpr": lambda: div("fp", "fp + tn", None),
    "fnr": lambda: div("fn", "fn + tp", None),
    "selection_rate": lambda: div("tp + fp", "tn + fp + fn + tp", None),
}


def metrics_sql(names: list[str], rnd: int | None = 6) -> str:
    """Select items computing named metrics from columns tn, fp, fn, tp."""
    items = []
    for m in names:
        e = METRIC_SQL[m]()
        if rnd is not None and m != "n":
            e = f"ROUND({e}, {rnd})"
        items.append(f"{e} AS {m}")
    return ", ".join(items)


def hash32_sql(seed, *parts: str) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"coalesce(CAST({p} AS VARCHAR), chr(0))" for p in parts])
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT"
