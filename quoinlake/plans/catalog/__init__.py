"""Registered queries: every operator over the given tables, with the SQL that checks it."""

from quoinlake.plans.catalog import ingest, modelling, normalizing, pool, reporting, series  # noqa: F401
from quoinlake.plans.catalog.registry import QUERIES, SQL  # noqa: F401
