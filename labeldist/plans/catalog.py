"""Imports every check-query module so the registry is complete."""

from __future__ import annotations

from labeldist.plans import q_annotation, q_distributions, q_metrics, q_models, q_prompts, q_streaming, q_text  # noqa: F401
from labeldist.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
