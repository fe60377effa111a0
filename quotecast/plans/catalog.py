"""All registered queries."""

from quotecast.plans import catalog_series, catalog_tables  # noqa: F401
from quotecast.plans.catalog_series import flagship
from quotecast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
