"""Providers: one way, of several, to answer a kind of request (OCR, classification, structuring, judgement).

A provider has a name, the columns that it asks for and the type of its answer. `answered` puts its answers beside
the rows, with an error column. A native provider is a column expression and stays in the JVM. A batch provider is a
function from a list of requests to a list of answers and runs in Arrow batches; if it raises, the batch is tried
again and then halved until the rows that it can't answer are alone (and tried again), so one bad row loses that row only.
Requests are rows, or the elements of a column of arrays, which then needs no row for each of them.

Providers are chosen by kind and name, so a plan is the same whichever is in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StructType

KINDS = ("ocr", "classify", "structure", "judge")


@dataclass(frozen=True)
class Provider:
    """asks: columns that a request has. answer: DDL type. Either `column` (native) or `call` (batches) answers.

    version: part of what a snapshot is kept under, to be changed with the provider's behaviour.
    """

    kind: str
    name: str
    asks: tuple[str, ...]
    answer: str
    column: Callable[[dict[str, Column]], Column] | None = None
    call: Callable[[list[dict]], list] | None = None
    batch: int = 64
    retries: int = 1
    version: str = "1"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no kind of provider {self.kind!r}; there are {', '.join(KINDS)}")
        if (self.column is None) == (self.call is None):
            raise ValueError(f"provider {self.name!r} needs a column or a call, and not both")


class Providers:
    """Providers by kind and name; the first one of a kind is its default."""

    def __init__(self, *some: Provider):
        self._held: dict[tuple[str, str], Provider] = {}
        for one in some:
            self.register(one)

    def register(self, one: Provider) -> None:
        if (one.kind, one.name) in self._held:
            raise ValueError(f"{one.kind} provider {one.name!r} is there already")
        self._held[one.kind, one.name] = one

    def names(self, kind: str) -> list[str]:
        return [name for k, name in self._held if k == kind]

    def chosen(self, kind: str, name: str = "") -> Provider:
        known = self.names(kind)
        if not known or (name and name not in known):
            raise ValueError(f"no {kind} provider {name!r}; there are {', '.join(sorted(known)) or 'none'}")
        return self._held[kind, name or known[0]]


def _called(provider: Provider, requests: list[dict], kind: pa.DataType, whole: bool = True) -> tuple[pa.Array, list]:
    """(answers, errors): whole batches first, then halves."""
    error = None
    for _ in range(1 + (provider.retries if whole or len(requests) == 1 else 0)):
        try:
            answers = list(provider.call(requests))
            if len(answers) != len(requests):
                raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
            return pa.array(answers, kind), [None] * len(requests)  # an answer of another type is an error of its row
        except Exception as raised:  # noqa: BLE001 - whatever a provider raises is its rows' error
            error = raised
    if len(requests) == 1:
        return pa.nulls(1, kind), [f"{provider.name}: {error}"]
    half = len(requests) // 2
    first, second = _called(provider, requests[:half], kind, False), _called(provider, requests[half:], kind, False)
    return pa.concat_arrays([first[0], second[0]]), first[1] + second[1]


def _answers(provider: Provider, asked: pa.Table, kind: pa.DataType) -> tuple[pa.Array, list]:
    parts = [_called(provider, asked.slice(k, provider.batch).to_pylist(), kind) for k in range(0, asked.num_rows, provider.batch)]
    return pa.concat_arrays([p[0] for p in parts]) if parts else pa.nulls(0, kind), [e for p in parts for e in p[1]]


def answered(rows: DataFrame, provider: Provider, into: str = "answer", error: str = "error", each: str = "") -> DataFrame:
    """rows with the provider's answer and, where there is none, why. No row is lost, none is shuffled.

    each: a column of arrays of structs whose elements are the requests, with what else is asked for from their row; the
    answer is then an array of theirs, null for those that have none, and the error the least of theirs.
    """
    inner = {f.name for f in rows.schema[each].dataType.elementType.fields} if each else set()
    missing = [c for c in provider.asks if c not in rows.columns and c not in inner]
    if missing:
        raise ValueError(f"{provider.name} asks for {', '.join(missing)}")
    answer = DataType.fromDDL(provider.answer)
    if provider.column is not None:
        one = lambda x: provider.column({c: x[c] if c in inner else F.col(c) for c in provider.asks}).cast(answer)
        return rows.withColumn(into, F.transform(each, one) if each else one(None)).withColumn(error, F.lit(None).cast("string"))
    kind = to_arrow_type(answer)
    listed = ArrayType(answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not each:
                answers, errors = _answers(provider, pa.Table.from_batches([batch.select(list(provider.asks))]), kind)
            else:
                held = batch.column(each)
                flat, owner = held.flatten(), pc.list_parent_indices(held)
                asked = pa.table({c: pc.struct_field(flat, c) if c in inner else batch.column(c).take(owner) for c in provider.asks})
                told, said = _answers(provider, asked, kind)
                ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(held), 0))
                answers = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), told, type=to_arrow_type(listed))
                errors = [None] * batch.num_rows
                for k, e in zip(owner.to_pylist(), said, strict=True):
                    if e is not None:
                        errors[k] = e if errors[k] is None else min(e, errors[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, answers, pa.array(errors, pa.string())], [*batch.schema.names, into, error])

    schema = StructType([*rows.schema.fields]).add(into, listed if each else answer).add(error, "string")
    return rows.mapInArrow(run, schema)
