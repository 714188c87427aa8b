"""All registered queries of the pedigree operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .fixtures import views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The operator ids of the survey that a query covers.
COVERS: dict[str, str] = {}


def query(name: str, covers: str, *needs: str, sql: str | None = None):
    """Register a function of views as a query; ``sql`` is its oracle over the same views."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*views(spark, sf_dir, *needs))
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    for family in ("intervals", "pedigree", "concordance", "hapmap", "sv", "hmm", "repeats", "truthset", "files"):
        import_module(f"{__package__}.{family}_queries")


_load()
