"""Every operator as a query over the shared test tables, with its SQL twin."""

from assayframe.catalog import hits, identifiers, jobs, journals, readers, structures, timings
from assayframe.catalog.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "hits", "identifiers", "jobs", "journals", "readers", "structures",
    "timings",
]
