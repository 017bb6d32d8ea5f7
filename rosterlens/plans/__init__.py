"""Analyses over the snapshot panel, one per registered query key."""

from rosterlens.plans.context import Workforce, clear_contexts, workforce
from rosterlens.plans.registry import ANALYSES, registered_queries

__all__ = ["ANALYSES", "Workforce", "clear_contexts", "registered_queries", "workforce"]
