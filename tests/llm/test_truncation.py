import random

import numpy as np

from tidemark.llm.truncation import Closings, ends_inside, features, fit, length_limits, own_rows, score, source_rates, truncated

SCHEMA = "doc_id bigint, source string, text string, raw binary, declared_charset string, tail string, n int, score double, fold int"
WORDS = "market harbour quiet ledger auction narrow table report steady index keeper river cement group window early volatile spread".split()
HTML = "<html><body><p>{}</p></body></html>"


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 11))).capitalize() + "."


def page(rng):
    return " ".join(sentence(rng) for _ in range(rng.randint(6, 25)))


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    docs, cut = [], set()
    for i in range(n):
        whole = page(rng)
        source, text = rng.choice(["a", "b", None]), whole
        if rng.random() < 0.15:
            text = rng.choice(["Imprint · Terms", whole + "\nThe harbour group", whole + "\nHome | Markets"])
        elif source == "a" and len(whole) > 520:
            text = whole[:500]
        elif rng.random() < 0.04:
            text = whole[: rng.randrange(60, len(whole) - 20)]
            while not text[-1].isalpha() or not whole[len(text)].isalpha():
                text = text[:-1]
        if whole.startswith(text) and len(text) < len(whole) and whole[len(text) - 1] != ".":
            cut.add(i)
        docs.append((i, source, text, HTML.format(whole + ("" if whole.startswith(text) else "</p><p>" + text[len(whole):] if text.startswith(whole) else "")).encode(), "utf-8", "x", 0, 0.0, 0))
    return docs, cut


def test_finds_cut_texts(spark):
    docs, cut = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    out = truncated(df)
    got = {r.doc_id for r in out.where("truncated").collect()}
    assert len(got & cut) >= 0.93 * len(cut)
    assert len(got - cut) <= 0.05 * len(cut)
    alone = {r.doc_id for r in truncated(df, check_body=False).where("truncated").collect()}
    assert len(alone & cut) >= 0.93 * len(cut) and len(alone - cut) <= 0.1 * len(cut) and got <= alone
    again = truncated(df.repartition(7, "text"), check_body=False)
    assert {r.doc_id for r in again.where("truncated").collect()} == alone
    limits = {(r.source, r.measure, r.limit) for r in length_limits(df).collect()}
    assert ("a", "chars", 500) in limits and not [x for x in limits if x[0] == "b"]
    rates = {r.source: r for r in source_rates(out).collect()}
    assert rates["a"].rate > 0.4 > rates["b"].rate and sum(r.n_docs for r in rates.values()) == len(docs)


def test_defined_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert truncated(none).count() == 0
    rows = [(1, "a", None, None, None, "x", 0, 0.0, 0), (2, None, "", None, None, "x", 0, 0.0, 0), (None, "a", "Short text.", None, None, "x", 0, 0.0, 0), (1, "a", "same.", None, None, "x", 0, 0.0, 0), (1, "a", "same.", None, None, "x", 0, 0.0, 0),
            (7, "b", "z" * 150_000, b"\xff", "no-such-charset", "x", 0, 0.0, 0)]
    got = truncated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and not [r for r in got if r.doc_id in (1, 2) and r.truncated and r.score == 0]


def test_exact_check():
    whole = HTML.format("One two three four five six.</p><p>Seven eight nine ten eleven.").encode()
    assert ends_inside(whole, "utf-8", "One two three four fi") is True
    assert ends_inside(whole, None, "One two three four five six.") is False
    assert ends_inside(whole, None, "Seven eight nine ten eleven.") is False
    assert ends_inside(whole, None, "Seven eight nine ...") is True
    assert ends_inside(whole[:60], None, whole[30:60].decode().split(">")[-1]) is True
    assert ends_inside(b"<p>Caf\xe9 au lait du matin</p></html>", "latin-1", "Café au lait") is True
    assert ends_inside(whole, None, "not on this page at all") is None
    assert ends_inside(None, None, "abc") is None
    teaser = b"<html><ul><li>Salt works priced every pension board \xe2\x80\xa6</li><li>More</li></ul></html>"
    assert ends_inside(teaser, "utf-8", "Salt works priced every pension board \u2026") is False
    assert ends_inside(teaser, "utf-8", "Salt works priced every ...") is True


def test_held_out_accuracy_of_the_classifier():
    rng = random.Random(9)
    tails, y = [], []
    for _ in range(1500):
        t = page(rng)
        tails.append(t[-200:])
        y.append(0.0)
        at = rng.randrange(40, len(t) - 10)
        tails.append(t[max(0, at - 200) : at])
        y.append(1.0)
    y, n, gap = np.array(y), np.array([len(t) for t in tails]), np.full(len(tails), -1)
    c = Closings([t for t, v in zip(tails[:2000], y, strict=False) if v == 0])
    own = own_rows(tails, n, gap)
    p = score((fit(own[:2000], y[:2000], c), c), own[2000:])
    assert ((p > 0.5) == (y[2000:] > 0.5)).mean() > 0.95
    assert features("", 0, -1, c) and features("\ud800", 1, 0, c)
