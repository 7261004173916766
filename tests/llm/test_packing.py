import random
from collections import defaultdict

import numpy as np

from tidemark.llm.packing import SumOfSquares, pack

SIZES = "container_kind string, capacity_tokens int"


def kinds(spark, rows=(("short", 16), ("long", 100))):
    return spark.createDataFrame(list(rows), SIZES)


def check(got, docs, caps):
    fill, parts = defaultdict(int), defaultdict(list)
    for r in got:
        if r.container_id is not None:
            fill[(r.container_kind, r.container_id)] += r.n_tokens
        parts[(r.container_kind, r.doc_id)].append((r.piece, r.token_from, r.n_tokens))
    for (kind, _), n in fill.items():
        assert n <= caps[kind]
    for kind, cap in caps.items():
        for doc, n in docs:
            p = sorted(parts[(kind, doc)])
            assert sum(x[2] for x in p) == n
            assert [x[1] for x in p] == [i * cap for i in range(len(p))]
            assert len(p) == max(1, -(-n // cap))
    return fill


def test_valid_and_tight(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice([0, 1, 3, 5, 7, 8, 9, 13, 16, 40, 250])) for i in range(2000)]
    got = pack(spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, n_tokens bigint, piece string"), kinds(spark)).collect()
    fill = check(got, docs, {"short": 16, "long": 100})
    total = sum(n for _, n in docs)
    for kind, cap in (("short", 16), ("long", 100)):
        made = sum(k == kind for k, _ in fill)
        assert total / (made * cap) > 0.97


def test_several_groups_share_no_container(spark):
    docs = [(i, 1 + i % 15) for i in range(900)]
    got = pack(spark.createDataFrame(docs, "doc_id bigint, n_tokens bigint"), kinds(spark), group=200).collect()
    check(got, docs, {"short": 16, "long": 100})
    assert len({r.container_id.split("-")[2] for r in got}) == 5


def test_no_later_plan_overfills_a_container(spark):
    docs = [(i, 1 + i * 7 % 90) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id bigint, n_tokens bigint").repartition(3)
    packed = pack(df, kinds(spark), group=300)
    plain = check(packed.collect(), docs, {"short": 16, "long": 100})
    assert len(check(packed.coalesce(1).collect(), docs, {"short": 16, "long": 100})) == len(plain)
    assert len(check(packed.repartition(2).coalesce(1).collect(), docs, {"short": 16, "long": 100})) == len(plain)
    more = [(i, 1 + i % 50) for i in range(5000, 5700)]
    both = packed.union(pack(spark.createDataFrame(more, "doc_id bigint, n_tokens bigint"), kinds(spark), group=300))
    check(both.coalesce(2).collect(), docs + more, {"short": 16, "long": 100})
    same = packed.union(pack(df, kinds(spark), group=300, name="again-")).select("container_id", "n_tokens").groupBy("container_id").sum("n_tokens")
    assert same.where("container_id LIKE 'short%' AND `sum(n_tokens)` > 16").count() == 0
    assert [r.container_id for r in packed.orderBy("container_kind", "doc_id", "piece").collect()] == [r.container_id for r in pack(df, kinds(spark), group=300).orderBy("container_kind", "doc_id", "piece").collect()]


def test_hot_ids_make_groups_of_equal_size(spark):
    docs = [(None, 5)] * 400 + [(i, 9) for i in range(800)]
    got = pack(spark.createDataFrame(docs, "doc_id bigint, n_tokens bigint").repartition(4), kinds(spark, [("long", 100)]), group=100).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.container_id.split("-")[2]] += 1
    assert len(sizes) == 12 and max(sizes.values()) <= 104


def test_defined_cases(spark):
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(none, kinds(spark)).count() == 0
    df = spark.createDataFrame([(None, 5), (1, None), (2, 0), (3, 16), (3, 16), (4, 33)], "doc_id bigint, n_tokens bigint")
    got = pack(df, kinds(spark, [("short", 16), ("short", 16), (None, 5), ("bad", 0), ("bad2", None)])).collect()
    assert {r.container_kind for r in got} == {"short"}
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert len(empty) == 2 and all(r.container_id is None and r.n_tokens == 0 for r in empty)
    assert len({r.container_id for r in got if r.doc_id == 3}) == 2
    assert sorted(r.n_tokens for r in got if r.doc_id == 4) == [1, 16, 16]
    assert pack(df, kinds(spark, [])).count() == 0


def test_same_result_again(spark):
    df = spark.createDataFrame([(i, 1 + (i * 7) % 60) for i in range(500)], "doc_id bigint, n_tokens bigint")
    key = lambda: sorted((r.container_id, r.doc_id, r.piece) for r in pack(df, kinds(spark)).collect())
    assert key() == key()


def test_level_choice_minimises_the_sum_of_squares():
    rng = random.Random(4)
    p = SumOfSquares(20)
    for _ in range(400):
        s = rng.randint(1, 20)
        before = p.levels.copy()
        best = None
        for h in range(0, 20 - s + 1):
            if h and not before[h]:
                continue
            n = before.copy()
            if h:
                n[h] -= 1
            if h + s < 20:
                n[h + s] += 1
            cost = int((n[1:20] ** 2).sum())
            best = cost if best is None else min(best, cost)
        p.place(s)
        assert int((p.levels[1:20] ** 2).sum()) == best
        assert p.levels.sum() == sum(map(len, p.open.values()))
    assert np.all(p.levels >= 0)
