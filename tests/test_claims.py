from tidemark.operators.claims import check_claims, open_places


def test_claims_and_placeholders():
    results = {"a": {"b": [1.0, 2.0]}, "n": None}
    got = [c["ok"] for c in check_claims(results, [("a.b.1", 2.004, 0.01), ("a.b.0", 2.0, 0.5), ("a.x", 1.0, 9.0), ("n", 0.0, 9.0), ("a.b.9", 0.0, 9.0)])]
    assert got == [True, False, False, False, False]
    assert open_places("fine\nmean {{value}}\nTODO later") == [2, 3]
