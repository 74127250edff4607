"""The whole run over two input tables: map, validate, gate, choose a path and take it.

``route`` judges the tables under canonical names; ``run_pipeline`` then builds features by the structured
path (production joined with per-batch process statistics) or by the adaptive path (readings alone).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_EMISSION_FACTOR, REQUIRED_PROCESS_COLUMNS, REQUIRED_PRODUCTION_COLUMNS
from batchlens.operators import schema_map as sm
from batchlens.operators.features import KPI_PRODUCTION_COLUMNS
from batchlens.plans.adaptive import run_adaptive
from batchlens.plans.structured import build_features


@dataclass
class Route:
    structured_columns: bool
    validation_passed: bool
    gate_passed: bool

    @property
    def name(self) -> str:
        return "structured" if self.structured_columns and self.validation_passed and self.gate_passed else "adaptive"


def route(production: DataFrame, process: DataFrame) -> Route:
    """Structured only if all required columns are there, every validation holds and every rule of the
    quality gate (null rate included) passes. Three aggregations, one row each."""
    columns = set(REQUIRED_PRODUCTION_COLUMNS) <= set(production.columns) and set(REQUIRED_PROCESS_COLUMNS) <= set(process.columns)
    passed = lambda df: bool(df.agg(F.coalesce(F.bool_and("passed"), F.lit(False))).first()[0])
    gate = sm.quality_gate({"production_batches": production, "process_readings": process})
    return Route(columns, passed(sm.validate_structured(production, process)), passed(gate))


def run_pipeline(process: DataFrame, order_col: str, production: DataFrame | None = None, emission_factor: float = DEFAULT_EMISSION_FACTOR) -> tuple[str, DataFrame]:
    """(path taken, feature table). Without a production table, where the structured rule fails, and where the production
    table lacks columns that the scores are made of (the rule asks for generic names, the scores need others too),
    the readings go the adaptive path under whatever headers they have."""
    if production is not None and set(KPI_PRODUCTION_COLUMNS) <= set(production.columns) and route(production, process).name == "structured":
        return "structured", build_features(production, process, emission_factor).features
    return "adaptive", run_adaptive(process, order_col, emission_factor).features
