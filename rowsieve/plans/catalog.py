"""All registered queries; importing this module fills the registry."""

from rowsieve.plans import (  # noqa: F401
    correction_queries,
    ingest_queries,
    ledger_queries,
    rule_queries,
    streaming_queries,
    transform_queries,
)
from rowsieve.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
