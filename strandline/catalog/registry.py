"""Registry of named queries over the warehouse tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

MODULES = (
    "sources_joins",
    "transforms",
    "windows",
    "aggregates",
    "crosscorr",
    "regressions",
    "analogues",
    "strategies",
    "recursions",
    "sweeps",
    "live",
)

DIGITS = 6

#: Column types the oracle must return so that both sides compare as the same type.
ORACLE_TYPES = {
    "B4_keyed_cross_section_join": {"year": "integer"},
    "B7_dimension_lookup": {"action": "double"},
    "B8_event_window": {"offset": "integer"},
    "B10_label_drop": {"year": "integer"},
    "B12_parameter_product": {"k": "double"},
    "C7_latest_per_key": {"year": "integer"},
    "C9_top_k_rank": {"rank": "integer"},
    "D10_threshold_interaction": {"below": "double"},
    "E23_reset_accumulators": {"errors": "bigint"},
    "F4_return_by_year": {"year": "integer"},
    "F7_top_choice_quartiles": {"rank": "integer"},
    "F14_portfolio_risk": {"weight": "double"},
    "F15_stress_scenarios": {"impact": "double"},
    "G10_mutual_information": {"rank": "integer"},
    "I1_nearest_patterns": {"rank": "integer"},
    "I1_nearest_vectors": {"rank": "integer"},
    "I2_matching_patterns": {"rank": "integer"},
    "J3_two_asset_rotation": {"signal": "double"},
    "J6_bubble_signal": {"signal": "double"},
    "J9_discounted_speculation": {"signal": "double"},
    "J11_automatic_window": {"forecast": "double"},
    "J16_bias_learning": {"plain": "double", "learned": "double"},
    "K1_parameter_sweep": {"rank": "integer"},
    "K3_rolling_folds": {"fold": "integer"},
    "K8_blend_sweep": {"rank": "integer"},
    "L1_live_signal": {"signal": "double"},
}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column, so that summation order does not show in results."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register a query; ``sql`` is wrapped so that its doubles are rounded the same way."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = lambda spark, path: rounded(fn(spark, path), digits)
        if sql is not None:
            casts = ", ".join(f'cast("{c}" as {t}) as "{c}"' for c, t in ORACLE_TYPES.get(name, {}).items())
            _ORACLES[name] = f"select * replace ({casts}) from ({sql})" if casts else sql
        return fn

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"strandline.catalog.{m}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
