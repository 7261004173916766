import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm.bpe import DEFAULT_PATH, LONG, PairTable, _merge_long, _merge_matrix, Encoder, load_tokenizer, token_counts, token_ids


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(DEFAULT_PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def split(ids, count):
    ends = np.cumsum(count)
    return [ids[e - c : e].tolist() for e, c in zip(ends, count, strict=True)]


def texts():
    rng = random.Random(1)
    signs = [chr(i) for i in range(0x3000)] + list("\U0001f600\U0001f468‍️\U0010ffff\U00020000漢字かなกขคعربी")
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    out += ["=" * 100_000, "ab" * 3000, "aaa" * 777, " " * 5000 + "x", "\n\n \t x  ", "<|endoftext|> hi", "漢字かな" * 500, "a\x1c b\x85c d"]
    out += ["".join(rng.choice("etaoins") for _ in range(rng.randint(1, 3 * LONG))) for _ in range(60)]
    return out


def test_equals_the_public_library(reference):
    t = texts()
    assert split(*Encoder(*load_tokenizer())(t)) == reference(t)


def test_long_pieces_equal_single_merges():
    ids, table = load_tokenizer()
    rng = random.Random(2)
    for _ in range(30):
        piece = "".join(rng.choice("aabcde") for _ in range(rng.randint(2, LONG))).encode()
        x = ids[np.frombuffer(piece, np.uint8)]
        m, n = _merge_matrix(x[None, :].copy(), table)
        assert _merge_long(x, table).tolist() == m[0, : n[0]].tolist()


def test_pair_table_finds_exactly_its_pairs():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 500, (3000, 2)), axis=0)
    table = PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    assert (table.rank(pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32)) == np.arange(len(pairs))).all()
    inside = {tuple(p) for p in pairs.tolist()}
    other = np.array([p for p in rng.integers(0, 500, (3000, 2)).tolist() if tuple(p) not in inside], np.int32)
    assert (table.rank(other[:, 0], other[:, 1]) == 2**31 - 1).all()


def test_operator_and_its_defined_cases(spark, reference):
    rows = [(1, "Hello world", 0), (2, "", 0), (3, None, 0), (None, "x", 0), (1, "Hello world", 0), (5, "y" * 120_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in token_ids(df).collect()))
    assert got == sorted((d or 0, reference([t])[0] if t else []) for d, t, _ in rows)
    counts = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(df).collect())
    assert counts == sorted((d, len(i)) for d, i in got)
    assert token_ids(df.limit(0)).count() == 0


def test_memory_of_pieces_starts_anew(monkeypatch, reference):
    monkeypatch.setattr("tidemark.llm.bpe.KEPT", 5)
    e = Encoder(*load_tokenizer())
    for t in (["one two three four five six seven"], ["eight two nine"], ["one one ten"]):
        assert split(*e(t)) == reference(t)
