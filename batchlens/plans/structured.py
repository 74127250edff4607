"""Structured path: production table + process time series -> feature table.

Plan: median-impute production (1 stats row) ; aggregate process per batch
(one shuffle on Batch_ID, partial aggregation first), checkpointed ;
median-impute the aggregate ; left join on Batch_ID, checkpointed (the
per-batch table feeds five statistics passes) ; IQR winsorise ; KPIs ;
controls. Every statistic is a one-row global aggregate folded into the next
plan as literals, so every plan stays linear.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_EMISSION_FACTOR
from batchlens.operators.features import kpi_features, process_agg
from batchlens.session import stored
from batchlens.operators.stats import iqr_clip, median_impute


@dataclass
class StructuredResult:
    features: DataFrame
    merged: DataFrame
    report: dict = field(default_factory=dict)


def numeric_columns(df: DataFrame, id_col: str = "Batch_ID") -> list[str]:
    return [c for c in df.columns if c != id_col]


def clean_production(production: DataFrame) -> tuple[DataFrame, int]:
    cols = numeric_columns(production)
    typed = production.select("Batch_ID", *[F.col(c).try_cast("double").alias(c) for c in cols])
    return median_impute(typed, cols)


def batch_join(production: DataFrame, process: DataFrame) -> tuple[DataFrame, int]:
    """Cleaned production LEFT JOIN cleaned per-batch process aggregate.

    Returns (joined per-batch table, number of cells median-filled)."""
    prod_clean, prod_filled = clean_production(production)
    agg = stored(process_agg(process))
    agg_clean, agg_filled = median_impute(agg, numeric_columns(agg))
    merged = prod_clean.join(agg_clean, on="Batch_ID", how="left")
    return merged, prod_filled + agg_filled


def build_features(
    production: DataFrame, process: DataFrame, emission_factor: float = DEFAULT_EMISSION_FACTOR
) -> StructuredResult:
    merged, filled = batch_join(production, process)
    merged = stored(merged)
    clipped, clip_counter = iqr_clip(merged, numeric_columns(merged))
    # KPIs and control columns; the controls' statistics share the eco pass
    features = kpi_features(clipped, emission_factor, with_controls=True)
    report = {"missing_values_filled": filled, "clip_counter": clip_counter}
    return StructuredResult(features, merged, report)
