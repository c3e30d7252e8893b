"""Solution modifiers in emission order: by the arrival of the completing tuple, ties by the bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

REDUCED_CAPACITY = 1000


class SeenSet:
    """The REDUCED automaton: a seen-set that is emptied when it holds ``capacity`` solutions."""

    def __init__(self, capacity: int = REDUCED_CAPACITY) -> None:
        if capacity < 1:
            raise ValueError("the capacity must be at least 1")
        self.capacity, self.seen = capacity, set()

    def first(self, solution: tuple) -> bool:
        if solution in self.seen:
            return False
        if len(self.seen) >= self.capacity:
            self.seen.clear()
        self.seen.add(solution)
        return True


def sliced(df: DataFrame, columns: list[str], order: list[Column], offset: int, limit: int | None) -> DataFrame:
    """OFFSET, then LIMIT, of the emission order: a bounded top-n where there is a limit."""
    if limit is None and not offset:
        return df.select(*columns)
    if order:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(offset + limit)
    if offset:
        df = df.offset(offset)
    return df.select(*columns)
