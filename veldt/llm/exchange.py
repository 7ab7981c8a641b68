"""Shuffles of packed arrays: one row carries all of a task's entries for a bucket.

A row per shingle or token would make the shuffle the cost of a job.  Instead
each task sorts its entries by bucket and sends a few binary columns per bucket.
Entries belong to runs: `owner` names the text, `total` is a number that goes
with it, `count` says how many of the keys that follow are its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A task sends what it holds after this many keys.
FLUSH_KEYS = 750_000

RUNS = "bucket int, owner binary, total binary, count binary, keys binary"
RUNS_ARROW = pa.schema([("bucket", pa.int32()), ("owner", pa.binary()), ("total", pa.binary()), ("count", pa.binary()), ("keys", pa.binary())])


class RunSender:
    """Collects runs of keys and turns them into one row per bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, [], 0

    def add(self, owner: np.ndarray, total: np.ndarray, count: np.ndarray, keys: np.ndarray, extra: np.ndarray | None = None) -> None:
        """Runs of one chunk: keys in run order; `extra` is a second number per key."""
        self.held.append((owner, total, count, keys, extra))
        self.n += len(keys)

    def full(self) -> bool:
        return self.n >= FLUSH_KEYS

    def flush(self, bucket_of=None) -> Iterator[dict]:
        """Rows of what is held; keys are bucketed by themselves, or runs by `bucket_of(owner)`."""
        if not self.held:
            return
        owner, total, count, keys, extra = (np.concatenate(x) if x[0] is not None else None for x in zip(*self.held))
        self.held, self.n = [], 0
        run = np.repeat(np.arange(len(owner)), count)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int32) if bucket_of is None else bucket_of(owner)[run]
        order = np.argsort(bucket, kind="stable")
        bucket, run, keys = bucket[order], run[order], keys[order]
        extra = extra[order] if extra is not None else None
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.r_[edges[1:], len(bucket)]):
            first = np.flatnonzero(np.r_[True, run[a + 1 : b] != run[a : b - 1]])
            own = run[a:b][first]
            row = {"bucket": int(bucket[a]), "owner": owner[own].tobytes(), "total": total[own].tobytes(), "count": np.diff(np.r_[first, b - a]).astype(np.uint32).tobytes(), "keys": keys[a:b].tobytes()}
            if extra is not None:
                row["extra"] = extra[a:b].tobytes()
            yield row


def received(table: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    """The concatenated arrays of a bucket's rows, one per column of `kinds`."""
    return [np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in kinds.items()]
