"""Requests to a model server: in order, a few at once, with one retry and a breaker."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

from cutloom.functions.captions import fault

NO_FRAME = "no representative frame"


def in_order(items: Iterable[tuple[int, str | None]], ask: Callable[[str], str], *, parallel: int = 2, limit: int = 5, tries: int = 2) -> Iterator[tuple[int, str | None, str | None, bool]]:
    """(id, reply, error, tripped) for (id, frame path), in the order of the items whatever order the answers come in.

    A request that fails, or whose reply is not what is wanted, is tried again; then its error is the outcome. An item without a path is an error that does
    not count. After ``limit`` failures in a row one last outcome is told as tripped, and what has not been asked yet is never asked.
    """
    def one(path: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                reply = ask(path)
                error = fault(reply)
                if error is None:
                    return reply, None
            except Exception as problem:
                error = str(problem)[:300] or type(problem).__name__
        return None, error

    waiting: deque = deque()
    source, failures = iter(items), 0
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        while True:
            while len(waiting) < max(1, parallel) and (item := next(source, None)) is not None:
                waiting.append((item[0], item[1] and pool.submit(one, item[1])))
            if not waiting:
                return
            key, answer = waiting.popleft()
            reply, error = answer.result() if answer else (None, NO_FRAME)
            failures = 0 if reply is not None else failures + bool(answer)
            tripped = failures >= limit
            yield key, reply, error, tripped
            if tripped:
                return


def requested(rows: DataFrame, ask: Callable[[str], str], *, parallel: int = 2, limit: int = 5) -> DataFrame:
    """The outcomes of in_order over rows (key, position, id, frame_path): key, id, reply, error, tripped. Each key is asked by one task, in the order of position."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def keyed() -> Iterator[tuple]:
            for batch in batches:
                yield from batch[["key", "id", "frame_path"]].itertuples(index=False, name=None)

        source = keyed()
        first = next(source, None)
        while first is not None:
            key, following = first[0], []

            def own(start: tuple = first, key: object = key, following: list = following) -> Iterator[tuple]:
                yield start[1:]
                for row in source:
                    if row[0] != key:
                        following.append(row)
                        return
                    yield row[1:]

            items = own()
            out = [(key, *x) for x in in_order(items, ask, parallel=parallel, limit=limit)]
            for _ in items:  # past what the breaker left
                pass
            yield pd.DataFrame(out, columns=["key", "id", "reply", "error", "tripped"])
            first = following[0] if following else None

    return rows.repartition("key").sortWithinPartitions("key", "position").mapInPandas(run, "key string, id bigint, reply string, error string, tripped boolean")
