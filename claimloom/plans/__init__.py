"""Named queries over the evidence graph."""

import importlib

from claimloom.plans.registry import Registry, core

MODULES = ("graph_quality", "store", "quality", "search", "graph", "grounding", "logs", "intake")


def all_core() -> Registry:
    for m in MODULES:
        importlib.import_module(f"claimloom.plans.{m}")
    return core
