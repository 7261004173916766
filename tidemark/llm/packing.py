"""Problem 7: documents into containers of fixed capacity.

Sum-of-squares online packing. N[h] counts the open containers filled to level
h. An item of size s goes to the level h (0: a new container) for which the sum
of N[h]**2 over the partly filled levels becomes least; a full container leaves
the levels. Nothing but the level array and the open containers' numbers is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

#: Items packed together, at every size of the input. Each group leaves a few containers partly filled; a group takes about 15 µs an item and capacity.
GROUP = 20_000
MAX_KINDS = 1_000


class SumOfSquares:
    """Containers of one capacity, filled one item at a time."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)  # [0] stays 0: empty containers aren't open
        self.open: dict[int, list[int]] = {}
        self.made = 0
        self.top = 0  # no open container is fuller

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> int:
        """The container of an item of 1 to capacity tokens."""
        if size == self.capacity:
            return self.new()
        n, full = self.levels, self.capacity
        best, cost = 0, 2 * n[size] + 1  # a new container
        last = min(full - size, self.top)
        if last > 0:
            # Change of the sum of squares if a container of level h moves to h + size; fullest first on ties.
            change = 2 * (n[1 + size : last + 1 + size] - n[1 : last + 1]) + 2
            if last == full - size:
                change[-1] = -2 * n[last] + 1  # it becomes full and leaves
            change = np.where(n[1 : last + 1] > 0, change, np.iinfo(np.int64).max)[::-1]
            i = int(change.argmin())
            if change[i] <= cost:
                best = last - i
        if best:
            self.levels[best] -= 1
            at = self.open[best].pop()
        else:
            at = self.new()
        level = best + size
        if level < full:
            self.levels[level] += 1
            self.open.setdefault(level, []).append(at)
            self.top = max(self.top, level)
        return at


def pack_group(doc: list, size: np.ndarray, kind: str, capacity: int, packer: SumOfSquares, group: str) -> pd.DataFrame:
    """Rows of one batch for one kind. A text over the capacity fills whole containers; its rest is an item."""
    whole = size // capacity
    rest = size - whole * capacity
    rest_at = np.full(len(size), -1, np.int64)
    for i in np.flatnonzero(rest):
        rest_at[i] = packer.place(int(rest[i]))
    pieces = whole + (rest > 0)
    rows = np.repeat(np.arange(len(size)), np.maximum(pieces, 1))
    piece = np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(pieces, 1)) - np.maximum(pieces, 1), np.maximum(pieces, 1))
    full = piece < whole[rows]
    at = rest_at[rows]
    at[full] = packer.made + np.arange(full.sum())
    packer.made += int(full.sum())
    return pd.DataFrame({
        "container_kind": kind, "container_id": [f"{kind}-{group}-{a}" if a >= 0 else None for a in at],
        "doc_id": [doc[r] for r in rows], "piece": piece.astype(np.int32),
        "token_from": piece * capacity, "n_tokens": np.where(full, capacity, rest[rows]),
    })


def pack(counts: DataFrame, containers: DataFrame, group: int = GROUP, name: str = "") -> DataFrame:
    """`container_kind, container_id, doc_id, piece, token_from, n_tokens`.

    `counts`: `doc_id, n_tokens`; `containers`: `container_kind,
    capacity_tokens`, at most MAX_KINDS kinds. Every document has rows for every
    kind. One no longer than the capacity is one piece; a longer one fills
    containers of its own and only its rest is packed with others. A document
    without tokens (null or empty text, or null count) needs no container: one
    row with null container and 0 tokens. Repeated rows are packed as often as
    they come; null ids are ids like others. Kinds without name or positive
    capacity, and repeated ones, are left out.

    Groups are a column, not the task's number, so neither `coalesce` nor a
    retry makes two groups share a container. Container ids start with `name`
    and a number made from the items, so packings of different items may be united;
    two packings of the same items need different names.
    """
    sizes = containers.where("container_kind IS NOT NULL AND capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct()
    kinds = [(r.container_kind, int(r.capacity_tokens)) for r in sizes.orderBy("container_kind", "capacity_tokens").limit(MAX_KINDS + 1).collect()]
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    stored = written(counts.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), "token-counts")
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(1 << 31))).alias("s")).first()
    groups, space = max(1, -(-size.n // group)), f"{name}{(size.s or 0) % (1 << 32):08x}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, packers = None, []
        for batch in batches:
            for g, b in batch.groupby("g", sort=False):
                if g != now:
                    now, packers = g, [SumOfSquares(capacity) for _, capacity in kinds]
                doc, size = b["doc_id"].astype(object).where(b["doc_id"].notna(), None).tolist(), b["n_tokens"].to_numpy(np.int64)
                for (kind, capacity), packer in zip(kinds, packers, strict=True):
                    yield pack_group(doc, size, kind, capacity, packer, f"{space}-{g}")

    id_kind = counts.schema["doc_id"].dataType.simpleString()
    # Rows of a stored table are dealt in turn, so groups are of equal size whatever the ids; sorting by hash mixes the sizes within each.
    dealt = stored.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
    return (
        dealt.repartitionById(groups, F.col("g")).sortWithinPartitions("g", F.xxhash64("doc_id", "n_tokens"), "doc_id", "n_tokens")
        .mapInPandas(run, f"container_kind string, container_id string, doc_id {id_kind}, piece int, token_from bigint, n_tokens bigint")
    )
