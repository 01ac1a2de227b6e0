"""The read API as DataFrames of JSON: events, their summary, results of sweeps, tests and benchmarks."""

from __future__ import annotations

import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import recent
from .sinks import as_json


class ReadApi:
    """``get`` gives the body of an endpoint, one JSON text a row; ``token`` asks for a bearer header."""

    def __init__(self, tables: dict[str, DataFrame], token: str | None = None):
        self.tables, self.token = tables, token

    def authorised(self, header: str | None) -> bool:
        return self.token is None or hmac.compare_digest((header or "").encode(), f"Bearer {self.token}".encode())

    def get(self, path: str, header: str | None = None, limit: int = 100) -> DataFrame:
        if not self.authorised(header):
            raise PermissionError("a bearer token is asked for")
        name = path.rstrip("/").rpartition("/")[2]
        if not path.startswith("/api/") or name not in ("events", "summary", "sweep_results", "test_results", "beir_results"):
            raise KeyError(path)
        if name == "events":
            return as_json(recent(self.tables["events"], limit).select("event_id", "event_type", "user_id"))
        if name == "summary":
            e = self.tables["events"]
            return as_json(e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")))
        return as_json(self.tables[name])
