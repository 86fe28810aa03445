"""All registered queries of the sensing operators and their SQL."""

from __future__ import annotations

from . import ingest, files, places, readings, roads, routes, streams, texts, trips, validation  # noqa: F401
from .core import ORACLE_SQL, QUERIES  # noqa: F401
