"""Problem 6: byte-level BPE of a whole corpus.

Texts are split by the tokenizer's pattern; each distinct piece of a task is
encoded once. Pieces of similar length form one padded matrix of byte ids. In
each round every row merges its leftmost pair of least rank; ranks come from a
hash table over pairs, only the two pairs beside a merge are looked up again,
and rows without a mergeable pair leave the matrix. A piece of more than
LONG bytes merges, per round, all occurrences of its least pair from the left.
That is the same result: a pair that contains the merged token always ranks
behind the merge that made the token, so the other occurrences come next anyway.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The published pattern of this tokenizer, with white space as the Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
LONG = 256
NONE = np.int32(2**31 - 1)
#: Distinct pieces kept by a task before its memory of them starts anew.
KEPT = 300_000


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte in the vocabulary: itself, or for the rest signs from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairTable:
    """Ranks of pairs (left id, right id) by open addressing in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        at, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == -1
            _, first = np.unique(np.where(free, at[todo], -1 - np.arange(len(todo))), return_index=True)
            won = first[free[first]]
            self.keys[at[todo[won]]] = key[todo[won]]
            self.ranks[at[todo[won]]] = todo[won]
            todo = np.delete(todo, won)
            at[todo] = (at[todo] + 1) & (size - 1)
        self.merged = merged.astype(np.int32)

    def parts(self) -> tuple:
        """The table as builtins and arrays: what is broadcast must load where this package isn't installed."""
        return self.bits, self.probes, self.keys, self.ranks, self.merged

    @classmethod
    def of(cls, parts: tuple) -> PairTable:
        table = cls.__new__(cls)
        table.bits, table.probes, table.keys, table.ranks, table.merged = parts
        return table

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it can't merge; a negative id is padding."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(key.shape, NONE, np.int32)
        flat = out.reshape(-1)
        key = key.reshape(-1)
        todo = np.flatnonzero((left.reshape(-1) >= 0) & (right.reshape(-1) >= 0))
        at = self._slot(key[todo])
        for _ in range(self.probes):
            if not len(todo):
                break
            there = self.keys[at]
            same = there == key[todo]
            flat[todo[same]] = self.ranks[at[same]]
            more = ~same & (there != -1)
            todo, at = todo[more], (at[more] + 1) & (len(self.keys) - 1)
        return out


def load_tokenizer(path: str = DEFAULT_PATH) -> tuple[np.ndarray, PairTable]:
    """The id of each byte, and the table of merges, from a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = np.array([vocab[a + b] for a, b in pairs])
    if len(np.unique(merged)) != len(merged):
        raise ValueError("two merges make the same token; pieces over LONG bytes would need single merges")
    table = PairTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), merged)
    return np.array([vocab[s] for s in _byte_signs()], np.int32), table


def _merge_matrix(m: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """All merges of the rows of a matrix padded with -1: final rows and their lengths."""
    done = m.copy()
    rows = np.arange(len(m))
    ranks = table.rank(m[:, :-1], m[:, 1:])
    cols = np.arange(m.shape[1])
    while len(rows):
        at = ranks.argmin(axis=1)
        i = np.arange(len(rows))
        best = ranks[i, at]
        live = best != NONE
        if not live.all():
            done[rows[~live], : m.shape[1]] = m[~live]
            done[rows[~live], m.shape[1] :] = -1
            rows, m, ranks, at, best = rows[live], m[live], ranks[live], at[live], best[live]
            i = np.arange(len(rows))
            if not len(rows):
                break
        # Compaction: everything behind the merged pair moves one place to the left.
        shift = cols[None, : m.shape[1]] + (cols[None, : m.shape[1]] > at[:, None])
        m = np.take_along_axis(np.pad(m, ((0, 0), (0, 1)), constant_values=-1), shift, axis=1)
        m[i, at] = table.merged[best]
        ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE), shift[:, :-1], axis=1)
        ranks[i, np.minimum(at, ranks.shape[1] - 1)] = NONE
        inner = at < m.shape[1] - 1
        ranks[i[inner], at[inner]] = table.rank(m[i[inner], at[inner]], m[i[inner], at[inner] + 1])
        left = at > 0
        ranks[i[left], at[left] - 1] = table.rank(m[i[left], at[left] - 1], m[i[left], at[left]])
        widest = int((m >= 0).sum(axis=1).max())
        if 1 < widest <= m.shape[1] // 2:
            m, ranks = m[:, :widest], ranks[:, : widest - 1]
        elif widest == 1:
            done[rows, 0], done[rows, 1:] = m[:, 0], -1
            break
    return done, (done >= 0).sum(axis=1)


def _merge_long(x: np.ndarray, table: PairTable) -> np.ndarray:
    """One long piece: each round merges all occurrences of its least pair."""
    ranks = table.rank(x[:-1], x[1:])
    while len(ranks):
        best = ranks.min()
        if best == NONE:
            break
        at = np.flatnonzero(ranks == best)
        if len(at) > 1 and (np.diff(at) == 1).any():  # a pair of equal ids overlaps itself: every second counts
            run = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
            begin = at[np.r_[True, np.diff(at) > 1]]
            at = at[(at - begin[run]) % 2 == 0]
        x = x.copy()
        x[at] = table.merged[best]
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x = x[keep]
        old = np.append(ranks, NONE)[keep][:-1]
        new = at - np.arange(len(at))
        for p in (new, new - 1):
            p = p[(p >= 0) & (p < len(old))]
            old[p] = table.rank(x[p], x[p + 1])
        ranks = old
    return x


def encode_pieces(pieces: list[bytes], byte_ids: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces end to end, and how many each piece has."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    whole = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    begin = np.cumsum(size) - size
    count = np.ones(n, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    for high in (1, 2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, LONG):
        rows = np.flatnonzero((size > low) & (size <= high))
        low = high
        for chunk in np.array_split(rows, len(rows) * high // 4_000_000 + 1) if len(rows) else []:
            place = np.arange(high)[None, :]
            inside = place < size[chunk][:, None]
            m = np.where(inside, whole[np.minimum(begin[chunk][:, None] + place, len(whole) - 1)], -1).astype(np.int32)
            if high > 1:
                m, count[chunk] = _merge_matrix(m, table)
            parts.append((chunk, m, count[chunk]))
    longs = {int(r): _merge_long(whole[begin[r] : begin[r] + size[r]], table) for r in np.flatnonzero(size > LONG)}
    for r, x in longs.items():
        count[r] = len(x)
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for chunk, m, c in parts:
        valid = np.arange(m.shape[1])[None, :] < c[:, None]
        out[(at[chunk][:, None] + np.arange(m.shape[1])[None, :])[valid]] = m[valid]
    for r, x in longs.items():
        out[at[r] : at[r] + len(x)] = x
    return out, count


class Encoder:
    """Encodes batches of texts; remembers the pieces it has seen."""

    def __init__(self, byte_ids: np.ndarray, table: PairTable):
        self.byte_ids, self.table = byte_ids, table
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.codes: defaultdict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: list[str | None], want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per text); without `want_ids` the first is empty."""
        if len(self.codes) > KEPT:
            self._forget()
        known = len(self.count)
        code, words = self.codes.__getitem__, np.zeros(len(texts), np.int64)
        all_codes: list[np.ndarray] = []
        for i, t in enumerate(texts):
            if t:
                found = self.split(t)
                words[i] = len(found)
                all_codes.append(np.fromiter(map(code, found), np.int64, len(found)))
        if len(self.codes) > known:
            new = [w.encode("utf-8", "surrogatepass") for w in list(self.codes)[known:]]
            ids, count = encode_pieces(new, self.byte_ids, self.table)
            start = len(self.flat) + np.cumsum(count) - count
            self.flat, self.start, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.start, start]), np.concatenate([self.count, count])
        codes = np.concatenate(all_codes) if all_codes else np.empty(0, np.int64)
        lengths = self.count[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        borders = np.concatenate([[0], np.cumsum(words)])
        per_text = np.diff(ends[borders])
        if not want_ids:
            return np.empty(0, np.int32), per_text
        ids = self.flat[np.repeat(self.start[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, per_text


#: Characters encoded at once; larger batches are taken in slices, single texts whole.
SLICE_CHARS = 4_000_000


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    part: list[str | None] = []
    begin = chars = 0
    for i in range(len(texts)):
        t = texts[i].as_py()
        if part and chars + len(t or "") > SLICE_CHARS:
            yield begin, part
            part, begin, chars = [], i, 0
        part.append(t)
        chars += len(t or "")
    if part:
        yield begin, part


def _apply(docs: DataFrame, key: str, text: str, path: str, build: Callable, result: str) -> DataFrame:
    byte_ids, table = load_tokenizer(path)
    shared = docs.sparkSession.sparkContext.broadcast((byte_ids, table.parts()))  # a vocabulary: its size doesn't follow the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_ids, parts = shared.value
        encode = Encoder(byte_ids, PairTable.of(parts))
        for batch in batches:
            for begin, texts in _slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), build(encode, texts)], [key, result.split()[0]])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {result}")


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """`key, ids`: the token ids of every row's text, special strings being
    ordinary text. An empty or null text has an empty list; repeated rows and
    null keys come out as they came in; other columns are ignored; a text is
    never cut, however long. No shuffle."""

    def build(encode: Encoder, texts: list[str | None]) -> pa.Array:
        ids, count = encode(texts)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))

    return _apply(docs, key, text, path, build, "ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """`key, n_tokens`: how many ids `token_ids` gives."""

    def build(encode: Encoder, texts: list[str | None]) -> pa.Array:
        return pa.array(encode(texts, want_ids=False)[1], pa.int64())

    return _apply(docs, key, text, path, build, "n_tokens long")
