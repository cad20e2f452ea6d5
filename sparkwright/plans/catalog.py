"""All registered queries (imports every query module for its side effect)."""

from __future__ import annotations

from sparkwright.plans import registry

_MODULES = ["q_profile", "q_prep", "q_split", "q_eval", "q_flows", "q_models", "q_sources", "q_features"]


def _load():
    import importlib
    for m in _MODULES:
        importlib.import_module(f"sparkwright.plans.{m}")


def all_queries():
    _load()
    return dict(registry.QUERIES)


def all_oracles():
    _load()
    return dict(registry.ORACLES)
