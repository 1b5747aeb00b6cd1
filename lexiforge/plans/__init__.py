"""All queries of the reference's own operators, with their SQL."""

from lexiforge.plans import alignment, catalog, decisions, exchange, leases, ledger, payloads, reconcile, reports, resolution, streams, texts  # noqa: F401
from lexiforge.plans.registry import ORACLES, QUERIES  # noqa: F401
