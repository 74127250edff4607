"""Green/Yellow/Red zone binning. Two conventions exist and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zone_feature(x) -> Column:
    """Right-closed bins (-1,40] Red, (40,70] Yellow, (70,100] Green; else NULL."""
    c = F.col(x) if isinstance(x, str) else x
    return (
        F.when((c > -1.0) & (c <= 40.0), F.lit("Red"))
        .when((c > 40.0) & (c <= 70.0), F.lit("Yellow"))
        .when((c > 70.0) & (c <= 100.0), F.lit("Green"))
    )


def zone_candidate(x) -> Column:
    """Left-closed: >= 70 Green, >= 40 Yellow, otherwise (and NULL) Red."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c >= 70.0, F.lit("Green")).when(c >= 40.0, F.lit("Yellow")).otherwise(F.lit("Red"))
