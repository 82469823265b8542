"""Exclusive locks of keys among a driver's threads: first come first served, re-entrant, with timeout and deadlock detection."""

from __future__ import annotations

import contextlib
import threading
import time
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DeadlockVictim, LockWaitTimeout
from ..plans.stages import drop_stored, stored

Resource = tuple[str, str, object]


class LockManager:
    """Of a cycle of waiting transactions the one with the largest id gives way."""

    def __init__(self, timeout: float = 5.0):
        self.timeout = timeout
        self._owner: dict[Resource, int] = {}
        self._waiting: dict[Resource, deque[int]] = {}
        self._waits_for: dict[int, Resource] = {}
        self._victims: set[int] = set()
        self._changed = threading.Condition()

    def acquire(self, tx: int, resource: Resource, timeout: float | None = None) -> None:
        end = time.monotonic() + (self.timeout if timeout is None else timeout)
        with self._changed:
            if self._owner.get(resource, tx) == tx and not self._waiting.get(resource):
                self._owner[resource] = tx
                return
            if self._owner.get(resource) == tx:
                return
            queue = self._waiting.setdefault(resource, deque())
            queue.append(tx)
            self._waits_for[tx] = resource
            try:
                if cycle := self._cycle(tx):
                    self._victims.add(max(cycle))
                    self._changed.notify_all()
                while self._owner.get(resource) is not None or queue[0] != tx:
                    if tx in self._victims:
                        raise DeadlockVictim(f"transaction {tx}")
                    left = end - time.monotonic()
                    if left <= 0:
                        raise LockWaitTimeout(f"{resource}")
                    self._changed.wait(left)
                if tx in self._victims:
                    raise DeadlockVictim(f"transaction {tx}")
                self._owner[resource] = tx
            finally:
                queue.remove(tx)
                self._waits_for.pop(tx, None)
                self._changed.notify_all()

    def _cycle(self, tx: int) -> list[int]:
        """The transactions of the cycle that ``tx`` closes by waiting: each waits for one resource, so there is one way to follow."""
        path, now = [tx], tx
        while (resource := self._waits_for.get(now)) is not None and (owner := self._owner.get(resource)) is not None:
            if owner == tx:
                return path
            if owner in path:
                return []
            path.append(owner)
            now = owner
        return []

    def release(self, tx: int, resource: Resource) -> None:
        with self._changed:
            if self._owner.get(resource) == tx:
                del self._owner[resource]
                self._changed.notify_all()

    def release_all(self, tx: int) -> None:
        with self._changed:
            for resource in [r for r, owner in self._owner.items() if owner == tx]:
                del self._owner[resource]
            self._victims.discard(tx)
            self._changed.notify_all()

    def is_aborted(self, tx: int) -> bool:
        with self._changed:
            return tx in self._victims

    @contextlib.contextmanager
    def held(self, tx: int, resources: list[Resource], outer: threading.RLock | None = None):
        """All of the resources, taken in sorted order, then ``outer``."""
        taken = []
        try:
            for r in sorted(resources, key=repr):
                if self._owner.get(r) != tx:
                    self.acquire(tx, r)
                    taken.append(r)
            with outer or contextlib.nullcontext():
                yield
        finally:
            for r in taken:
                self.release(tx, r)


def _cycles(waits_for: DataFrame) -> DataFrame:
    """member, least: each transaction in a cycle, and the smallest of its cycle.

    Each waiter has one holder, so steps can double: after k joins every waiter knows whom it reaches by 2**k steps. Walks
    that end drop out; once no more do, all are endless. Transactions that are reached by so many steps dwindle to those in
    cycles; once their number stands still, only these are left. Minima spread by doubling as well. Rounds are the logarithm
    of the longest chain or cycle, and each is a join by key of tables that are written between rounds.
    """
    held: list[DataFrame] = []

    def step(df: DataFrame) -> DataFrame:
        held.append(stored(df))
        if len(held) > 2:
            drop_stored(held.pop(0))
        return held[-1]

    reach = step(waits_for.select(F.col("waiter").alias("node"), F.col("holder").alias("to")).where("node is not null and to is not null").dropDuplicates(["node"]))
    ahead = lambda df: df.select(F.col("node").alias("to"), *(F.col(c).alias(f"{c}_2") for c in df.columns if c != "node"))
    n, ends = reach.count(), -1
    while True:
        reach = step(reach.join(ahead(reach), "to").select("node", F.col("to_2").alias("to")))
        now = reach.agg(F.count("*").alias("n"), F.count_distinct("to").alias("ends")).first()
        if (now["n"], now["ends"]) == (n, ends):
            break
        n, ends = now["n"], now["ends"]
    members = stored(reach.select(F.col("to").alias("node")).distinct())
    own = waits_for.select(F.col("waiter").alias("node"), F.col("holder").alias("to")).dropDuplicates(["node"]).join(members, "node", "left_semi")
    spread = step(own.withColumn("least", F.least("node", "to")))
    while True:
        further = spread.join(ahead(spread), "to")
        spread, before = step(further.select("node", F.col("to_2").alias("to"), F.least("least", "least_2").alias("least"), (F.col("least_2") < F.col("least")).alias("fell"))), spread
        if not spread.where("fell").limit(1).count():
            drop_stored(members, before)
            return spread.select(F.col("node").alias("member"), "least")
        spread = spread.drop("fell")


def deadlocked(waits_for: DataFrame) -> DataFrame:
    """member, cycle_length of each transaction in a cycle of ``waits_for`` (waiter, holder; each waiter waits for one). Cycles may have any length."""
    cycles = _cycles(waits_for)
    lengths = cycles.groupBy("least").agg(F.count("*").alias("cycle_length"))
    return cycles.join(lengths, "least").select("member", "cycle_length")


def victims(waits_for: DataFrame) -> DataFrame:
    """victim, cycle_length of each cycle: the transaction with the largest id gives way."""
    return _cycles(waits_for).groupBy("least").agg(F.max("member").alias("victim"), F.count("*").alias("cycle_length")).drop("least")
