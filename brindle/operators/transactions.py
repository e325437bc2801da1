"""Optimistic multi-document transactions.

Mutations are staged at the driver as a small table with the CAS each was based on.  Commit
validates reads and writes by one join with the current state and then applies all at once.
Isolation holds for one engine: there is a single place that commits.
"""

from __future__ import annotations

import datetime as dt
import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CasMismatch, Conflict, Expired, Invalid, NotFound
from . import kv

STAGED = "txn_id string, bucket string, scope string, collection string, key string, op string, value string, original_cas bigint"
_ids = itertools.count(1)


@dataclass
class Transaction:
    bucket: str
    state: DataFrame
    now: dt.datetime
    timeout_s: float = 15.0
    txn_id: str = field(default_factory=lambda: f"txn-{next(_ids)}")
    status: str = "Active"
    staged: dict[str, tuple[str, str | None, int | None]] = field(default_factory=dict)
    reads: dict[str, int] = field(default_factory=dict)

    def _check(self, now: dt.datetime | None = None) -> None:
        if self.status != "Active":
            raise Conflict(f"{self.txn_id} is {self.status}")
        if now is not None and (now - self.now).total_seconds() >= self.timeout_s:
            self.status = "Expired"
            raise Expired(self.txn_id)

    def _current(self, key: str) -> tuple[str, int] | None:
        row = kv.get(self.state, key, F.lit(self.now)).select("value", "cas").first()
        return (row["value"], row["cas"]) if row else None

    def get(self, key: str) -> str:
        """What this transaction has written, else the committed value."""
        self._check()
        if key in self.staged:
            op, value, _ = self.staged[key]
            if op == "remove":
                raise NotFound(key)
            return value
        found = self._current(key)
        if found is None:
            raise NotFound(key)
        self.reads[key] = found[1]
        return found[0]

    def insert(self, key: str, value: str) -> None:
        self._check()
        was = self.staged.get(key)
        if (was and was[0] != "remove") or (not was and self._current(key)):
            raise Conflict(f"key exists: {key}")
        self.staged[key] = ("replace" if was else "insert", value, was[2] if was else None)

    def _base(self, key: str) -> tuple[str, int | None]:
        was = self.staged.get(key)
        if was:
            if was[0] == "remove":
                raise NotFound(key)
            return was[0], was[2]
        found = self._current(key)
        if found is None:
            raise NotFound(key)
        return "replace", self.reads.get(key, found[1])

    def replace(self, key: str, value: str) -> None:
        self._check()
        op, cas = self._base(key)
        self.staged[key] = (op, value, cas)

    def remove(self, key: str) -> None:
        self._check()
        op, cas = self._base(key)
        if op == "insert":
            del self.staged[key]
        else:
            self.staged[key] = ("remove", None, cas)

    def table(self) -> DataFrame:
        rows = [(self.txn_id, self.bucket, "_default", "_default", k, op, v, cas) for k, (op, v, cas) in self.staged.items()]
        return self.state.sparkSession.createDataFrame(rows, STAGED)

    def commit(self, current: DataFrame, clock: kv.Clock) -> DataFrame:
        """The state after all staged mutations; ``current`` may have moved on since begin."""
        self._check(clock.now)
        spark = current.sparkSession
        staged = self.table()
        reads = spark.createDataFrame([(k, "read", c) for k, c in self.reads.items() if k not in self.staged], "key string, op string, original_cas bigint")
        bad = conflicts(staged.select("key", "op", "original_cas").union(reads), kv.live(current, clock.time)).limit(1).collect()
        if bad:
            self.status = "RolledBack"
            raise CasMismatch(bad[0]["key"])
        out = current
        written = staged.filter("op <> 'remove'").select("key", "value")
        if any(op != "remove" for op, _, _ in self.staged.values()):
            out = kv.upsert(out, written, clock)
        if any(op == "remove" for op, _, _ in self.staged.values()):
            out = kv.delete(out, staged.filter("op = 'remove'").select("key"), clock)
        self.status = "Committed"
        return out

    def rollback(self) -> None:
        if self.status == "Committed":
            raise Invalid(f"{self.txn_id} is committed")
        self.staged.clear()
        self.status = "RolledBack"


def conflicts(staged: DataFrame, live: DataFrame) -> DataFrame:
    """Staged rows whose document changed, came or went since: key, op, original and current cas."""
    now = live.select("key", F.col("cas").alias("current_cas"))
    both = staged.join(now, "key", "left")
    moved = F.when(F.col("op") == "insert", F.col("current_cas").isNotNull()).otherwise(~F.col("current_cas").eqNullSafe(F.col("original_cas")))
    return both.filter(moved)
