"""Results as files for people: JSON lines of receipts and activity, Markdown tables of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as the table has parts; an earlier export is replaced."""
    rows.write.mode("overwrite").json(path)


def markdown(scores: DataFrame, columns: tuple[str, ...], most: int = 1000) -> str:
    """A Markdown table of a small result such as scores by class, in the order of its first column.

    Rates (doubles) are per cent with one decimal, null is a dash. A result of more than ``most`` rows is refused, not cut.
    """
    rows = scores.select(*columns).orderBy(columns[0]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows is no report")
    shown = lambda v: "-" if v is None else f"{100 * v:.1f} %" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows]) + "\n"
