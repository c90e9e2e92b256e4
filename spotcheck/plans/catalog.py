"""All queries of the verification engine by name, with their SQL for DuckDB."""

from __future__ import annotations

from spotcheck.plans import certificates, changes, market, quality, recon, reports, scopes, stores, streams, verification  # noqa: F401
from spotcheck.plans.registry import QUERIES, SQL  # noqa: F401
