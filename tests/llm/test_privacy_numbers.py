from loomgraph.llm import privacy


def ids(text):
    return [text[s:e] for s, e, k in privacy.structured(text) if k == "ID_NUMBER"]


def test_identity_numbers_in_one_run():
    assert ids("born 811218-9876, also 8112189876 and 198112189876.") == ["811218-9876", "8112189876", "198112189876"]
    assert ids("8112189876") == ["8112189876"]


def test_wrong_digit_no_date_and_longer_runs_are_none():
    assert ids("8112189875 and 198112189875, 118112189876, 98112189876") == []
    assert privacy._control("8102308981") and ids("8102308981") == []
    assert ids("x8112189876 1.8112189876 8112189876.5 +8112189876") == []
