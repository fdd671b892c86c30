"""Exploding arrays without duplicating the work that produced them.

For an inner ``explode`` Catalyst infers a ``size(array) > 0`` filter and
pushes it below the projection that computes the array, where it is
evaluated a second time (for the pipeline: the whole redaction, and before
any repartition that spreads the work).  ``explode_outer`` infers nothing; the
rows it adds for empty or null arrays are dropped by a filter on the generated
column, which cannot move below the generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrub.names import col


def explode_kept(df: DataFrame, keep, arr: Column, alias: str, pos: str | None = None) -> DataFrame:
    """``df.select(*keep, explode(arr))`` without the inferred, duplicated filter.

    With ``pos`` the position column is added (``posexplode``); elements that
    are themselves null are kept then.  Without it, null elements are dropped
    (no array built here holds any).
    """
    keep = [col(k) if isinstance(k, str) else k for k in keep]
    if pos is None:
        return df.select(*keep, F.explode_outer(arr).alias(alias)).where(F.col(alias).isNotNull())
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, alias)).where(F.col(pos).isNotNull())
