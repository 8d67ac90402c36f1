import random
import re

import numpy as np

from loomgraph.llm import leaks, neardups
from loomgraph.llm.words import Words

ODD = ["", None, "İstanbul straße_x ÄÖ 12", "a b_c\td-e", "日本語 テキスト", "x" * 100_000, "\x00 a\u0301b \ud7ff"]


def test_words_equal_pattern_words():
    w = Words(ODD, True)
    for i, t in enumerate(ODD):
        assert [w.word(j) for j in range(w.first[i], w.first[i + 1])] == re.findall(r"[^\W_]+", (t or "").lower())
    a, b = Words(["one Two three"], True), Words(["x", "TWO"], True)
    assert a.hashes[1] == b.hashes[1] and len(set(a.hashes.tolist())) == 3


def test_winnowing_meets_every_long_span(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(30))) for i in range(20)] + [(90, None), (91, ""), (92, "short one")]
    docs = []
    for i in range(60):
        body, (_, p) = text(40), items[i % 20]
        words = p.split()
        n = rnd.choice([10, 11, 12, 13, 30])
        at = rnd.randrange(0, len(words) - n + 1)
        docs.append((i, " ".join(body[:15] + words[at : at + n] + body[15:]).upper()))
    docs += [(100, None), (101, ""), (3, docs[3][1])]
    want = set()
    for d, t in docs:
        w = (t or "").lower().split()
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, p in items:
            q = (p or "").split()
            if any(tuple(q[k : k + 12]) in grams for k in range(len(q) - 11)):
                want.add((d, i))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    assert want and {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it, max_broadcast_chars=400).collect()} == want
    assert leaks.find_leaks(df.limit(0), it).count() == 0 and leaks.find_leaks(df, it.limit(0)).count() == 0


def _edited(rnd, base, n):
    w = list(base)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return w


def _brute(rows, k, t):
    sets = {}
    for key, text in rows:
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", text or "")]
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        if s and key is not None:
            sets[key] = s
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_pairs_against_all_pairs_with_a_hot_group(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(_edited(rnd, base, rnd.randrange(0, 8)))) for i in range(60)]
    rows += [(100 + i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(50))) for i in range(60)]
    rows += [(200 + i, "same text in every copy of it") for i in range(12)] + [(300, None), (301, ""), (302, "two words"), (5, rows[5][1]), (None, "x y z")]
    df = spark.createDataFrame(rows, "key long, text string").selectExpr("key", "text", "'z' as bits", "1 as rep")
    want = _brute(rows, 3, 0.6)
    got = {(r["a"], r["b"]) for r in neardups.similar_pairs(df, 3, 0.6).collect()}
    assert got <= want and len(got) >= 0.995 * len(want)
    real = neardups.split_hot
    monkeypatch.setattr(neardups, "split_hot", lambda r, k, s, most: real(r, k, s, 5))
    assert {(r["a"], r["b"]) for r in neardups.similar_pairs(df, 3, 0.6).collect()} == got
    assert neardups.similar_pairs(df.limit(0), 3, 0.6).count() == 0


def test_blocks_of_a_hot_key_hold_every_pair_once(spark):
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [("c", i) for i in range(4)], "key string, v int")
    got = neardups.split_hot(rows, "key", "v", 10).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["key"], r["block"]), []).append((r["v"], r["side"]))
    pairs = [(min(x, y), max(x, y)) for (k, _), m in groups.items() if k == "h" for i, (x, s) in enumerate(m) for y, t in m[i + 1 :] if s == 3 or s != t]
    assert len(pairs) == len(set(pairs)) == 50 * 49 // 2 and max(len(m) for m in groups.values()) <= 30
    assert [len(m) for (k, _), m in groups.items() if k == "c"] == [4]


def test_links_and_members_hold_every_pair(spark):
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(_edited(rnd, base, rnd.randrange(0, 5)))) for i in range(30)] + [(100 + i, "one text in many copies") for i in range(5)]
    df = spark.createDataFrame(rows, "key long, text string")
    links, members = neardups.links_and_members(df, 3, 0.6)
    of = {r["key"]: r["rep"] for r in members.collect()}
    linked = {(r["a"], r["b"]) for r in links.collect()}
    full = {(x, y) for x in of for y in of if x < y and (of[x] == of[y] or (min(of[x], of[y]), max(of[x], of[y])) in linked)}
    assert full == {(r["a"], r["b"]) for r in neardups.similar_pairs(df, 3, 0.6).collect()}


def test_trie_join_finds_all_pairs_within_the_budget():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (1, 128))
    bits = np.concatenate([(base ^ (rng.random((60, 128)) < 0.1)), rng.integers(0, 2, (60, 128))]).astype(np.uint8)
    packed = np.packbits(bits, axis=1)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if (bits[i] != bits[j]).sum() <= 30}
    got = neardups.trie_self_join(packed, 30)
    assert set(got) == want and len(got) == len(want)


def test_groups_are_one_row_per_key(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "something else entirely in here now")]
    got = {r["key"]: (r["group"], r["class"], r["n_links"]) for r in neardups.groups(spark.createDataFrame(rows, "key long, text string"), 5, 0.8).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (1, 3, 1)}
