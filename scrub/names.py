"""Column names that hold any character, and names that are still free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name: dots, quotes and backticks are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def unique_names(names) -> list[str]:
    """Header names as a pandas reader keeps them: blanks numbered, repeats suffixed."""
    out, seen = [], set()
    for i, n in enumerate(names):
        n = base = n or f"Unnamed: {i}"
        k = 0
        while n.lower() in seen:
            k += 1
            n = f"{base}.{k}"
        seen.add(n.lower())
        out.append(n)
    return out
