"""Folds over the rows of a key in order, without a key's history in one place.

Rows are cut into ranges of key and order, so a key with half of all rows lies in
many ranges. A range is folded row by row; what it needs to know is only the
state in which the range before left its first key. All ranges first run as if
they began anew. Then those that consist of one key and began in another state
than assumed run again, until no state changes; a last run gives the rows. A
state that soon forgets settles in a round or two. In the worst case, a state
that remembers everything, a key's ranges run one after the other, each once
with the right state, which is what the definition of such a fold asks for.

The driver holds one state per range, and a task one state at a time.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import forget, stored

Step = Callable[..., tuple[Any, tuple]]
PART = "_part"
TOLD = "part int, first binary, last binary, state binary"
TOLD_ARROW = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in ("first", "last", "state"))])


BATCH = 10_000  # rows that are handed on together


def _steps(zero: Any, step: Step, incoming: dict[int, Any], batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(range, key, state, values, results) of every row; ranges come whole and
    in order of their rows."""
    part, key, state = None, None, zero
    for batch in batches:
        for part_, key_, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part_ != part:
                part, key, state = part_, key_, incoming.get(part_, zero)
            elif key_ != key:
                key, state = key_, zero
            state, out = step(state, *values)
            yield part, key, state, values, out


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class Folds:
    """Folds of ``rows`` per ``key`` in the order of ``order``.

    ``step(state, *values)`` gives the next state and a tuple of results;
    ``values`` are columns of ``rows``. States are small and picklable.
    ``order`` should tell the rows of a key apart; rows that it doesn't are
    taken in the order of their values. A null key is a key of its own.
    """

    def __init__(self, rows: DataFrame, key: str, order: list[str], values: list[str], zero: Any, step: Step, parts: int | None = None):
        self.key, self.values, self.zero, self.step = key, values, zero, step
        self.order = [key, *order, *(v for v in values if v not in order)]
        columns = list(dict.fromkeys([key, *order, *values]))
        cut = rows.select(*columns)
        cut = cut.repartitionByRange(*([parts] if parts else []), *self.order)
        self.cut = stored(cut.withColumn(PART, F.spark_partition_id()))
        self.types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        self.incoming, self.goes_on = self._settle()

    def _rows(self, parts: list[int] | None = None) -> DataFrame:
        rows = self.cut if parts is None else self.cut.where(F.col(PART).isin(parts))
        return rows.repartition(PART).sortWithinPartitions(PART, *self.order).select(PART, self.key, *(F.col(v).alias(f"v{i}") for i, v in enumerate(self.values)))

    def _settle(self) -> tuple[dict[int, Any], set[int]]:
        told: dict[int, tuple] = {}
        incoming: dict[int, Any] = {}
        todo: list[int] | None = None
        zero, step = self.zero, self.step
        while todo is None or todo:
            known = dict(incoming)

            def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                def ranges() -> Iterator[tuple]:
                    for part, rows in itertools.groupby(_steps(zero, step, known, batches), key=lambda r: r[0]):  # noqa: B023
                        first = last = next(rows)
                        for last in rows:  # noqa: B007
                            pass
                        yield part, *(pickle.dumps(x) for x in (first[1], last[1], last[2]))

                yield from _batches(ranges(), TOLD_ARROW)

            for r in self._rows(todo).mapInArrow(tell, TOLD).collect():  # one row per range
                told[r.part] = tuple(map(pickle.loads, (r.first, r.last, r.state)))
            order = sorted(told)
            follows = {p: before for before, p in zip(order, order[1:], strict=False) if told[before][1] == told[p][0]}
            fresh = {p: told[before][2] for p, before in follows.items()}
            todo = [p for p in order if fresh.get(p, zero) != incoming.get(p, zero) and told[p][0] == told[p][1]]
            incoming = fresh
        return incoming, set(follows.values())

    def rows(self, keep: list[str], out: str) -> DataFrame:
        """Every row: its key, the values named in ``keep``, and its results,
        whose names and types ``out`` says."""
        at = [self.values.index(k) for k in keep]
        zero, step, incoming = self.zero, self.step, self.incoming
        return self._made(", ".join([f"{k} {self.types[k]}" for k in (self.key, *keep)] + [out]), lambda batches: ((key, *(values[i] for i in at), *res) for _, key, _, values, res in _steps(zero, step, incoming, batches)))

    def states(self, out: str) -> DataFrame:
        """The last state of each key, a tuple that ``out`` names."""
        zero, step, incoming, goes_on = self.zero, self.step, self.incoming, self.goes_on

        def last(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
            before = None
            for row in _steps(zero, step, incoming, batches):
                if before is not None and (before[1] != row[1] if before[0] == row[0] else before[0] not in goes_on):
                    yield before[1], *before[2]
                before = row
            if before is not None and before[0] not in goes_on:
                yield before[1], *before[2]

        return self._made(f"{self.key} {self.types[self.key]}, {out}", last)

    def _made(self, schema: str, make: Callable[[Iterable[pa.RecordBatch]], Iterable[tuple]]) -> DataFrame:
        arrow = self.cut.sparkSession.createDataFrame([], schema).toArrow().schema

        def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(make(batches), arrow)

        return self._rows().mapInArrow(go, schema)

    def close(self) -> None:
        """Deletes the ranges; what ``rows`` and ``states`` gave must be written."""
        forget(self.cut)
