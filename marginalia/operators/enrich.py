"""Hook for calls to an external text service, supplied by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Service = Callable[[list[str]], list[str]]
CALL_BYTES = 1 << 20  # of the prompts in one call; a longer prompt has a call of its own


class ConfigurationError(Exception):
    """The service can't work at all, for example without its key."""


def echo(prompts: list[str]) -> list[str]:
    """Deterministic stand-in: returns the prompts."""
    return list(prompts)


def _calls(batch: pa.RecordBatch, prompt: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose prompts have at most ``CALL_BYTES``, or are one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(prompt)), 0).to_numpy(), dtype=np.int64)
    start, sent = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, sent + CALL_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start, sent = stop, int(ends[stop - 1])


def enrich(requests: DataFrame, prompt: str, service: Service = echo, parallelism: int | None = None,
           retries: int = 1) -> DataFrame:
    """Send prompts in calls of bounded size; empty replies are asked again, then marked as failed.

    An Arrow batch is cut into calls of at most ``CALL_BYTES`` and a call's replies leave before the next
    one is made, so the other columns stay in Arrow and a task holds one batch and one call.

    A call that raises, or gives another number of replies than it got prompts, fails its own prompts
    only: they carry the message in ``error`` and the run goes on. A ``ConfigurationError`` is for
    mistakes that no other prompt could survive, and ends the run. Building prompts and reading
    replies stay column expressions around this call. ``parallelism`` caps how many calls run at the
    same time.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("reply", T.StringType()),
                           T.StructField("failed", T.BooleanType()), T.StructField("error", T.StringType())])

    def ask(prompts: list[str]) -> tuple[list[str | None], str | None]:
        try:
            replies = list(service(prompts))
        except ConfigurationError:
            raise
        except Exception as problem:
            return [None] * len(prompts), f"{type(problem).__name__}: {problem}"
        if len(replies) != len(prompts):
            return [None] * len(prompts), f"{len(replies)} replies to {len(prompts)} prompts"
        return replies, None

    def answer(prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
        replies, error = ask(prompts)
        errors = [error] * len(prompts)
        for _ in range(retries):
            empty = [i for i, r in enumerate(replies) if not (r or "").strip()]
            if not empty:
                break
            again, error = ask([prompts[i] for i in empty])
            for i, r in zip(empty, again):
                replies[i], errors[i] = r, error
        return replies, errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for call in _calls(batch, prompt):
                replies, errors = answer(call.column(prompt).to_pylist())
                failed = [not (r or "").strip() for r in replies]
                yield pa.RecordBatch.from_arrays([
                    *call.columns, pa.array(replies, pa.string()), pa.array(failed, pa.bool_()),
                    pa.array([e if f else None for e, f in zip(errors, failed)], pa.string())], names=schema.names)

    spread = requests.repartition(parallelism) if parallelism else requests
    out = spread.mapInArrow(run, schema)
    return out.withColumn("reply", F.coalesce("reply", F.lit("")))
