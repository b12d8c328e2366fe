"""All registered queries."""

import importlib

from stridegrid.plans.registry import COVERS, ORACLES, QUERIES

for _name in (
    "scalar_queries",
    "text_queries",
    "window_queries",
    "join_queries",
    "aggregate_queries",
    "timeline_queries",
    "gait_queries",
    "source_queries",
    "tracking_queries",
    "stream_queries",
):
    try:
        importlib.import_module(f"stridegrid.plans.{_name}")
    except ModuleNotFoundError as missing:
        if missing.name != f"stridegrid.plans.{_name}":
            raise

__all__ = ["COVERS", "ORACLES", "QUERIES"]
