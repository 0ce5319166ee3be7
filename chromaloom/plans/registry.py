"""All named queries with their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chromaloom.plans import contacts, files, matrices, modelling, objects, small, structures

MODULES = (contacts, structures, matrices, modelling, small, files, objects)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leg cleaning, binning at 20 kb and CPM."""
    return contacts.BOOK.queries["clean_leg_cpm"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.BOOK.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.BOOK.sql.items()}
