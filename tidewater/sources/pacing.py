"""Requests of one task, paced by host: a queue and a token bucket each, so that a host that is slow, busy or has most of the addresses delays no other."""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import Any

#: Addresses that a task reads ahead.
ROOM = 10_000


class Buckets:
    """When each host may be asked next: `rate` requests a second, of which `burst` may come at once. Full buckets are forgotten."""

    def __init__(self, rate: float | None, burst: int) -> None:
        self.step, self.slack = (1 / rate if rate else 0.0), (burst - 1) / rate if rate else 0.0
        self.full: dict[str, float] = {}

    def next(self, host: str, now: float) -> float:
        return max(now, self.full.get(host, now) - self.slack)

    def take(self, host: str, now: float) -> None:
        if self.step:
            self.full[host] = max(now, self.full.get(host, now)) + self.step
            if len(self.full) > ROOM:
                self.full = {h: t for h, t in self.full.items() if t > now}


def paced(rows: Iterator[tuple[str, Any]], ask: Callable[[Any], Any], skip: Callable[[Any], Any], workers: int, rate: float | None, burst: int = 1, end: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[Any]:
    """ask(item) of rows (host, item) as the answers come, one request a host at a time; after the time `end`, skip(item) of what was not asked.

    rows are read ROOM ahead: if each host's rows are spread as evenly as its number allows (its first before any other's second), a host is waited for only by itself.
    """
    buckets, queues, ready, running = Buckets(rate, burst), {}, [], {}
    order, waiting, more = 0, 0, True
    with ThreadPoolExecutor(workers) as pool:
        while True:
            while more and waiting < ROOM:
                row = next(rows, None)
                if row is None:
                    more = False
                    break
                host, item = row
                if host not in queues:
                    queues[host] = deque()
                    heapq.heappush(ready, (buckets.next(host, clock()), order, host))
                    order += 1
                queues[host].append(item)
                waiting += 1
            now = clock()
            if end is not None and now >= end:
                for host in list(queues):
                    while queues[host]:
                        yield skip(queues[host].popleft())
                waiting, ready = 0, []
                if not running and not more:
                    return
                queues = {host: deque() for host in running.values()}
            while ready and len(running) < workers and ready[0][0] <= now:
                _, _, host = heapq.heappop(ready)
                buckets.take(host, now)
                running[pool.submit(ask, queues[host].popleft())] = host
                waiting -= 1
            if not running and not ready:
                if not more:
                    return
                continue
            pause = max(0.0, ready[0][0] - now) if ready and len(running) < workers else None
            if end is not None and ready:
                pause = min(pause, max(0.0, end - now)) if pause is not None else max(0.0, end - now)
            if not running:
                sleep(pause)
                continue
            done: set[Future] = wait(running, pause, FIRST_COMPLETED)[0]
            for answer in done:
                host = running.pop(answer)
                if queues[host]:
                    heapq.heappush(ready, (buckets.next(host, clock()), order, host))
                    order += 1
                else:
                    del queues[host]
                yield answer.result()
