"""Registry of the engine's queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.plans import dedupe, evidence, legacy, persons, playbook, quality, tracker, triage
from concord.streaming import requests

_PARTS = (dedupe, persons, legacy, quality, tracker, triage, evidence, playbook, requests)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for p in _PARTS for n, f in p.QUERIES.items()}
ORACLES: dict[str, str] = {n: q for p in _PARTS for n, q in p.ORACLES.items()}
FLAGSHIP = "org_dedupe_pairs"
