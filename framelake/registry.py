"""All queries of the library's own operators, and the SQL that each must agree with."""

from __future__ import annotations

from framelake.plans import datasets, densities, dynamics, evidence, files, further, geometry, graphs, intervals, pairings, spectra, statistics, streams  # noqa: F401
from framelake.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
