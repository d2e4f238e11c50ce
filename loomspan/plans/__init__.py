"""Registered queries, by what they read."""

from loomspan.plans import edits, evaluation, metrics, pages, rasters, texts, trees, values, workflows
from loomspan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "edits", "evaluation", "metrics", "pages", "rasters", "texts", "trees", "values", "workflows"]
