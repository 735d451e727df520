"""Stateful processors: sliding-log limits and monthly quotas per key."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kbspark import constants as K


class SlidingLog(StatefulProcessor):
    """State: the accepted times of the last window, at most ``limit`` of them."""

    def __init__(self, limits: dict[str, int], window_seconds: int):
        self.limits = limits
        self.window_us = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        # The micro-batch is the unit of order; its size is bounded by the source's trigger options.
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        accepted = []
        for us, endpoint in zip(batch["us"], batch["endpoint"]):
            limit = self.limits.get(endpoint)
            ok = limit is None or len(recent) - bisect_right(recent, us - self.window_us) < limit
            if ok and limit is not None:
                insort(recent, int(us))
            accepted.append(ok)
        del recent[:bisect_right(recent, int(batch["us"].iloc[-1]) - self.window_us)]
        if recent:
            self.recent.update((recent,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((recent[-1] + self.window_us) // 1000 + 1)
        yield pd.DataFrame({"event_id": batch["event_id"].to_numpy(), "accepted": accepted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A window has passed since the last accepted request: nothing to remember.
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


class MonthlyQuota(StatefulProcessor):
    """State per key and month: counts, and the reason once disabled."""

    def __init__(self, request_cap: int, llm_cap: int):
        self.request_cap = request_cap
        self.llm_cap = llm_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "requests bigint, calls bigint, reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests, calls, reason = tuple(self.counts.get()) if self.counts.exists() else (0, 0, "")
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        reasons = []
        for is_capped in batch["is_capped"]:
            if not reason:
                requests += 1
                if requests > self.request_cap:
                    reason = K.REQUEST_CAP_REASON
                elif is_capped:
                    calls += 1
                    if calls > self.llm_cap:
                        reason = K.LLM_CAP_REASON
            reasons.append(reason)
        self.counts.update((requests, calls, reason))
        if not list(self.handle.listTimers()):
            end = (pd.Period(key[-1], freq="M") + 1).start_time
            self.handle.registerTimer(int(end.timestamp() * 1000))
        yield pd.DataFrame({
            "event_id": batch["event_id"].to_numpy(), "api_key": key[0], "month": key[-1],
            "allowed": [r == "" for r in reasons], "block_reason": reasons,
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()  # the month is over
        return iter(())

    def close(self) -> None:
        pass
