"""Problem 2: the history of an entity's attribute from several update streams.

Each stream is stored co-partitioned by entity and sorted by (entity, time), in
blocks of rows. One task per partition merges the k streams as iterators with a
heap of cursors and emits a version whenever the payload changes. At any moment
it holds one Arrow batch of packed blocks (Spark bounds it in rows and bytes),
the unpacked block each stream is at and the open version, never an entity's history.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 512
_BLOCK = "bucket int, stream int, k0 string, t0 long, k array<string>, t array<long>, o array<long>, v array<string>"
_VERSION = "k string, v string, valid_from long, valid_to long"


def _pack(bucket: int, stream: int, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({
        "bucket": [bucket], "stream": [stream], "k0": [rows.k.iloc[0]], "t0": [int(rows.t.iloc[0])],
        "k": [rows.k.tolist()], "t": [rows.t.tolist()], "o": [rows.o.tolist()], "v": [rows.v.tolist()],
    })


def _to_blocks(stream: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, part in batch.groupby("bucket", sort=False):
                for i in range(0, len(part), BLOCK_ROWS):
                    yield _pack(int(bucket), stream, part.iloc[i : i + BLOCK_ROWS])

    return pack


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(key, time, payload) in order. Blocks come by bucket and first row; a
    block is opened only when the merge reaches its first row."""
    heap: list[tuple] = []
    seq, bucket = 0, None

    def drained(limit: tuple | None) -> Iterator[tuple]:
        while heap and (limit is None or heap[0][:2] < limit):
            k, t, _, _, _, i, block = heap[0]
            yield k, t, block[3][i]
            if i + 1 < len(block[0]):
                heapq.heapreplace(heap, (block[0][i + 1], block[1][i + 1], block[2][i + 1], block[4], block[5], i + 1, block))
            else:
                heapq.heappop(heap)

    for batch in batches:
        for row in batch.itertuples(index=False):
            yield from drained(None if bucket != row.bucket else (row.k0, row.t0))
            bucket = row.bucket
            block = (list(row.k), [int(x) for x in row.t], [int(x) for x in row.o], list(row.v), row.stream, seq)
            seq += 1
            heapq.heappush(heap, (block[0][0], block[1][0], block[2][0], row.stream, block[5], 0, block))
    yield from drained(None)


def _versions(before_first: Callable[[str], tuple[int, str] | None], open_end: int):
    """Closed versions from an ordered stream of updates; carries one version."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key = held = since = None  # the version that now holds
        begun = False
        time = value = None  # the update not yet settled: the last one of an instant counts

        def settle():
            nonlocal held, since, begun
            if time is None:
                return
            if not begun:
                begun = True
                first = before_first(value)
                if first is not None and first[0] < time:
                    since, held = first
            if value == held:
                return
            if held is not None and since < time:
                out.append((key, held, since, time))
            held, since = value, time

        def finish():
            settle()
            if held is not None and since < open_end:
                out.append((key, held, since, open_end))

        for k, t, v in _merged(batches):
            if k != key:
                if key is not None:
                    finish()
                key, held, since, time, begun = k, None, None, None, False
            elif t != time:
                settle()
            time, value = t, v
            if len(out) >= BLOCK_ROWS:
                yield pd.DataFrame(out, columns=["k", "v", "valid_from", "valid_to"])
                out.clear()
        if key is not None:
            finish()
        if out:
            yield pd.DataFrame(out, columns=["k", "v", "valid_from", "valid_to"])

    return emit


def version_history(
    streams: list[DataFrame],
    open_end: int,
    before_first: Callable[[str], tuple[int, str] | None] = lambda v: None,
    partitions: int | None = None,
) -> DataFrame:
    """`k, v, valid_from, valid_to` from streams of `k string, t long, o long, v string`.

    Payload `v` holds from time `t` on; a null payload ends the version without
    starting another. An update that states what already holds starts no
    version. Of updates to one key at one time only the last counts, by order
    `o`, then by the later stream in the list. `before_first` may give (time,
    payload) of what held before a key's first update that counts. Rows without key or time
    are left out. Streams should hold at most one row per key, time and payload
    (aggregate before), so a key's rows are bounded by its distinct times. Keys
    are dealt to `partitions` buckets, by default as many as shuffles have.
    """
    spark = streams[0].sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = [
        s.where("k IS NOT NULL AND t IS NOT NULL")
        .select(F.pmod(F.xxhash64("k"), F.lit(n)).cast("int").alias("bucket"), "k", "t", F.coalesce("o", F.lit(0)).alias("o"), "v")
        .repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("bucket", "k", "t", "o")
        .mapInPandas(_to_blocks(i), _BLOCK)
        for i, s in enumerate(streams)
    ]
    return (
        reduce(DataFrame.unionByName, blocks)
        .repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("bucket", "k0", "t0", "stream")
        .mapInPandas(_versions(before_first, open_end), _VERSION)
    )
