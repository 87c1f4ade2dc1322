"""The audit queries and their SQL: every plan module adds (name, DataFrame of the views, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

MODULES = ("provenance", "corpus", "execution", "chains", "review", "mining", "feedback", "retrieval", "ranking", "safety", "tamper", "files", "streams")


def _plans() -> list[tuple[str, Callable[[Views], DataFrame], str | None]]:
    return [p for m in MODULES for p in import_module(f".{m}", __package__).PLANS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Views(spark, sf_dir))) for name, plan, _ in _plans()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, _, sql in _plans() if sql}
