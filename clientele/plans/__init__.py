"""Registered queries: one per operator, each with its checking SQL where one exists."""

from __future__ import annotations

import importlib

from .registry import REG, Registry

MODULES = ["customer_features", "relational", "business_metrics", "cohorts_and_tests", "recommendations", "review_text", "churn_models"]


def load_all() -> Registry:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return REG
