"""Jaccard join, decontamination, fingerprints and licences against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from skyloom.llm import components, decontamination, fingerprints, jaccard, licences

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, n int, ha string, extra string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, i = [(0, None), (1, ""), (2, "  \n"), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three four five")], 6
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 1)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w[at:at] = passage
            rows.append((i, " ".join(w)))
            i += 1
    base = " ".join(rng.choice(words) for _ in range(80))
    rows += [(i + k, base if k % 3 else base.upper()) for k in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_trees_of_several_blocks_find_what_their_offers_miss(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "HUB_PAIRS", 2)
    words = [f"x{i}" for i in range(200)]
    chain = [(k, " ".join(words[k * 6 : k * 6 + 90])) for k in range(15)]  # each like its neighbours only
    rng = random.Random(3)
    base = [f"y{i}" for i in range(100)]
    near = []
    for k in range(60):  # copies that are only sometimes near enough to each other
        w = list(base)
        w[rng.randrange(len(w))] = f"z{k}"
        w[rng.randrange(len(w))] = f"u{k}"
        near.append((100 + k, " ".join(w)))
    rows = chain + near
    for limit, listed in ((500_000, 10_000), (0, 0)):
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(jaccard, "LISTED_KEYS", listed)
        got = {r.doc_id: r.component_id for r in jaccard.similar_components(table(spark, rows)).collect()}
        assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def test_many_ids_are_neither_broadcast_nor_is_a_text_shuffled(spark, monkeypatch):
    n, plans = 21_000, {}
    docs = spark.range(n).selectExpr("id as doc_id", "concat('one two three four five six ', id) as text")
    docs = docs.union(spark.createDataFrame([(None, "one two three four five"), (n + 5, "")], "doc_id long, text string"))
    pairs = spark.range(n - 1).where("id % 3 > 0").selectExpr("id as a", "id + 1 as b")

    def noted(df, name, real=jaccard.stored):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(jaccard, "stored", noted)
    got = jaccard.overlaps(docs, pairs).selectExpr("count(*)", "min(shared)", "max(shared)", "min(total)", "max(total)").first()
    assert tuple(got) == (pairs.count(), 2, 2, 4, 4)
    assert "Broadcast" not in plans["jaccard-sets"] and "Exchange" not in plans["jaccard-sets"]


def test_a_table_of_ids_holds_them_all(spark):
    ids = np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 70_000)
    held = jaccard.id_table(spark.createDataFrame([(int(i),) for i in ids[:50_000]], "id long"), 50_000)
    bit = jaccard._bit(ids, 8 * len(held))
    hit = np.unpackbits(held)[bit].astype(bool)
    assert len(held) == 1 << 17 and hit[:50_000].all() and hit[50_000:].mean() < 0.1


def test_a_tree_joined_with_itself_or_another_gives_all_pairs_within_the_bound(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rng = np.random.default_rng(7)
    sets = []
    for n in (40, 60, 700, 1500):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[rng.random(n) > drop], rng.integers(0, 1 << 63, int(n * drop) + 1, dtype=np.uint64)))) for drop in (0, 0.02, 0.05, 0.1, 0.3, 0.6) for _ in range(4)]
    vec, n = [jaccard._vector(s) for s in sets], np.array([len(s) for s in sets])
    docs, comp = np.arange(len(sets)), rng.integers(0, 3, len(sets))
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            g = min(len(jaccard._counts(x)) for x in (vec[i], vec[j]))
            u, v = (jaccard._fold(jaccard._counts(x), g) for x in (vec[i], vec[j]))
            if comp[i] != comp[j] and np.minimum(u, v).sum() >= jaccard.needed(n[i], n[j]):
                want.add((j, i))
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                assert np.minimum(u, v).sum() >= jaccard.needed(n[i], n[j])  # the bound loses no link
    tree = jaccard.Tree(docs, n, comp, vec)
    got = [tuple(sorted(p)) for a, b in jaccard.tree_pairs(tree, tree) for p in zip(a.tolist(), b.tolist(), strict=True)]
    size = [min(n[i], n[j]) * 100 >= 80 * max(n[i], n[j]) for i, j in sorted(want)]
    assert len(got) == len(set(got)) and set(got) <= want and {p for p, ok in zip(sorted(want), size, strict=True) if ok} <= set(got)
    half = len(sets) // 2
    one, two = (jaccard.Tree(docs[s], n[s], comp[s], vec[s]) for s in (slice(0, half), slice(half, None)))
    crossing = {tuple(sorted(p)) for a, b in jaccard.tree_pairs(one, two) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert crossing == {(i, j) for i, j in got if i < half <= j}


def test_members_that_can_have_no_link_at_a_key_leave_it(spark):
    def prefix(*hashes):
        return np.array(hashes, dtype=np.uint64).tobytes()

    low, high = -(1 << 63), (1 << 63) - 1
    early, late, unequal = 5, 1 << 60, 6
    own = [(k << 20) + 7 for k in range(1, 80)]
    rows = [
        # sets of 100: needed is 89, so a first shared key has at most 11 before it in either
        (low, 100, low, prefix(early, *own[:20])),
        (high, 100, -4, prefix(early, *own[20:40])),
        (3, 100, 3, prefix(*own[40:60], late)),  # the twenty-first key of both: they share 80 shingles at most
        (4, 100, 4, prefix(*own[60:79], own[0] + 1, late)),
        (5, 100, 5, prefix(unequal)),
        (6, 126, 6, prefix(unequal)),  # too large for 5
    ]
    frame = spark.createDataFrame(rows, "doc long, n long, comp long, keys binary").coalesce(1)
    for buckets in (1, 7):
        got = jaccard._rare_members(frame, buckets).collect()
        assert sorted(r.doc for r in got) == [low, high] and len({r.key for r in got}) == 1


def test_a_key_keeps_the_rows_that_some_other_row_suits():
    rng = np.random.default_rng(11)
    for largest in (3, 30, 300):
        keys, ns = np.sort(rng.integers(0, 40, 150)), rng.integers(1, largest + 1, 150)
        order = np.lexsort((ns, keys))
        keys, ns = keys[order], ns[order]
        at = np.array([rng.integers(0, jaccard.prefix_length(int(n))) for n in ns])
        rest = ns - at
        want = [any(i != j and keys[i] == keys[j] and jaccard.needed(int(ns[i]), int(ns[j])) <= min(rest[i], rest[j]) for j in range(150)) for i in range(150)]
        assert jaccard._can_link(keys, ns, at).tolist() == want
    assert not len(jaccard._can_link(keys[:0], ns[:0], at[:0]))
    # the first shared key of linked sets keeps both, in any order of keys
    for _ in range(200):
        x = rng.choice(1000, int(rng.integers(1, 60)), replace=False)
        y = np.concatenate((rng.permutation(x)[: len(x) - int(rng.integers(0, 1 + len(x) // 6))], 1000 + np.arange(int(rng.integers(0, 1 + len(x) // 6)))))
        x, y = np.sort(x), np.sort(y)
        both = np.intersect1d(x, y)
        if 100 * len(both) >= 80 * len(np.union1d(x, y)):
            two = sorted((len(s), int(np.searchsorted(s, both[0]))) for s in (x, y))
            assert jaccard._can_link(np.zeros(2, np.int64), np.array([t[0] for t in two]), np.array([t[1] for t in two])).all()


def test_keys_whose_pairs_have_all_been_offered_are_not_searched_again(spark, monkeypatch):
    rng, searched = random.Random(9), []
    rows = []
    for k in range(30):  # pairs that share half of their shingles and so, mostly, some of their first ones
        base = [f"v{k}_{i}" for i in range(60)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:44], *(f"o{k}_{i}" for i in range(16))]))]
    real = jaccard.tree_search

    def spy(members, hot):
        searched.extend(r.doc for r in members.select("doc").distinct().collect())
        return real(members, hot)

    monkeypatch.setattr(jaccard, "tree_search", spy)
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(table(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}
    assert not searched


def test_a_tree_whose_offers_leave_out_pairs_is_known():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate((np.delete(base, k), rng.integers(0, 1 << 63, 1, dtype=np.uint64)))) for k in range(40)]
    ids, n = np.arange(40), np.array([len(x) for x in sets])
    tree = jaccard.Tree(ids, n, ids, [jaccard._vector(x) for x in sets])
    a, b = (np.concatenate(x) for x in zip(*jaccard.tree_pairs(tree, tree), strict=True))
    assert len(a) == 40 * 39 // 2 and jaccard._all_offered(tree, b, a)
    assert not jaccard._all_offered(tree, a[1:], b[1:]) and not jaccard._all_offered(tree, *tree.offers())


def test_jaccard_edges(spark):
    assert jaccard.similar_components(table(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F")]
    got = sorted((r.doc_id is None, r.component_id) for r in jaccard.similar_components(table(spark, rows)).collect())
    assert got == [(False, 1), (False, 1), (False, 1), (True, None)]


def test_keep_first_keeps_one_of_each_group(spark):
    rows = corpus(5)
    want = {c for _, c in brute_components(rows).values()}
    kept = jaccard.keep_first(spark, table(spark, [*rows, *rows[:20]]), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == ["doc_id", "text", "n", "ha", "extra"]


def test_contracted_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 103: 100}
    assert components.components(links.limit(0)).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame(
        [(1, "If Alice buys 12 kg of rice for 5 dollars each, how much does Alice pay?"), (2, "short one here ok"), (3, None), (4, ""), (None, "the quick brown fox jumps over the lazy dog near the old river bank")],
        "item_id long, text string",
    )
    rows = [
        (1, "Foo. If Alice buys 12 kg of rice for 5 dollars each, how much does Alice pay? bar"),
        (2, "Well. If Carol buys 7 kg of rice for 9 dollars each, how much does Carol pay? bar"),
        (3, "If Carol buys 7 kg of rice for 9 dollars each, how much does Mallory pay?"),
        (4, "a short one here ok then"), (5, None), (6, ""), (7, "nothing of the kind is said in this text at all"),
        (8, "and the quick brown fox jumps over the lazy dog near the old river bank today"), (8, "and the quick brown fox jumps over the lazy dog near the old river bank today"),
    ]
    docs = table(spark, rows)
    got = {(r.key, r.item_id): r.exact for r in decontamination.matches(docs, "doc_id", items).collect()}
    assert got == {(1, 1): True, (2, 1): False, (4, 2): True, (8, None): True}
    assert decontamination.matches(docs.limit(0), "doc_id", items).count() == 0
    assert decontamination.matches(docs, "doc_id", items.limit(0)).count() == 0


def test_words_put_in_and_longer_names_and_numbers(spark):
    w = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    question = "if Ann buys 950 bags of rice and sells 4 of them to her friend Bob, how many bags of rice does Ann have left over"
    items = spark.createDataFrame([(1, " ".join(w)), (2, question)], "item_id long, text string")
    other = question.replace("Ann", "Mary Jane").replace("950", "1,200").replace("4", "3.5").replace("Bob", "Jean-Luc")
    rows = [(1, " ".join([*w[:20], "more", *w[20:]])), (2, " ".join([*w[:20], *w[21:]])), (3, other), (4, other.replace("Mary Jane", "Eve", 1)), (5, " ".join([*w[:20], *["gap"] * 30, *w[20:]])), (6, " ".join(w[:20]))]
    got = {(r.key, r.item_id): (r.cover, r.exact) for r in decontamination.matches(table(spark, rows), "doc_id", items).collect()}
    assert got == {(1, 1): (1.0, False), (2, 1): (0.975, False), (3, 2): (1.0, False)}


def test_items_full_of_numbers_and_names(spark):
    items = spark.createDataFrame([(1, "In 2019 Ann paid 40 dollars and Bob paid 55 dollars"), (2, "1 2 3 4 5 6 7 8 9 and 10 11 12 13"), (3, "Then in 2019 Ann Lee paid 40 dollars, 30 cents, Bob paid 55 dollars")], "item_id long, text string")
    rows = [
        (1, "In 1987 Eve paid 12 dollars and Max paid 7 dollars"), (2, "In 1987 Eve paid 12 dollars and Max paid 12 cents"), (3, "x 2 2 3 4 5 6 7 8 9 and 10 11 12 14"), (4, "see 1 2 3 4 5 6 7 8 9 and 10 11 12 13"),
        (5, "so in 2019 ann paid 40 dollars and bob paid 55 dollars"), (6, "In 1987 Eve paid 12 dollars and Eve paid 7 dollars"),
    ]
    got = {(r.key, r.item_id): r.exact for r in decontamination.matches(table(spark, rows), "doc_id", items).collect()}
    assert got == {(1, 1): False, (3, 2): False, (4, 2): True, (5, 1): True, (6, 1): False}


def test_planted_passages_and_clean_texts(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(50)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(15, 60))) for i in range(20)]
    rows, want = [], set()
    for d in range(60):
        body = text(rng.randrange(5, 300)).split()
        if d % 3 == 0:
            i, t = rng.choice(items)
            at = rng.randrange(len(body))
            body[at:at] = t.split()
            want.add((d, i))
        rows.append((d, " ".join(body)))
    got = {(r.key, r.item_id) for r in decontamination.matches(table(spark, rows), "doc_id", spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_fingerprints(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 200)))) for i in range(40)] + [(41, None), (42, ""), (43, "é b"), (44, "é b"), (45, " ")]
    got = {r.doc_id: r for r in fingerprints.compare_edits(table(spark, rows)).collect()}
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        following, own = texts[order[(k + 1) % len(order)]], texts[i]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[43].fingerprint == got[44].fingerprint != "" and got[44].near_next == 1.0
    assert got[41].fingerprint == "" and got[42].near_next == 1.0 and got[43].near_next == 0.0
    assert fingerprints.compare_edits(table(spark, [])).count() == 0
    one = fingerprints.compare_edits(table(spark, [(9, "a b c d e f g h")])).first()
    assert one.near_next == 1.0


QUESTIONS = {
    1: "A train leaves Boston at 9 and travels 300 km to Denver. If Alice drives at 60 km per hour from the same station, how many hours later does Alice arrive in Denver than the train that travels at 75 km per hour?",
    2: "Maria has 12 apples and gives 5 of them to Peter. How many apples does Maria have left after she buys 7 more at the market for 3 dollars each?",
}
VARIANTS = [
    (1, {}), (1, {"300": "1,200", "60": "62.5"}), (1, {"Boston": "New York", "Alice": "Mary Ann", "Denver": "San Diego"}), (1, {"Alice": "Zoë", "Denver": "Łódź"}), (1, {"km": "miles"}),
    (2, {"Maria": "Émilie", "12": "40", "5 of": "15 of", "7 more": "9 more"}), (2, {"Maria": "Anna Lee", "12": "40"}), (2, {"at the market": "at the big old market", "12": "13"}),
    (2, {"Maria": "Jean Paul", "Peter": "Łukasz", "12": "1,250", "5 of": "3.5 of", "7 more": "19 more", "dollars": "euros"}), (2, {"Maria": "tom", "Peter": "ann"}), (2, {"12": "twelve", "5": "five"}),
]
CLEAN = [
    "The market sells apples and pears every day and many people buy them for a few dollars each, but nobody knows how many are left.",
    "In 1999 Tom gave 3 books to Ann and 4 books to Bob, and in 2004 Ann gave 2 books to Tom and 7 books to Eve.",
    "How many hours later does the next train leave? It travels at 75 km per hour, and nobody arrives in time.",
]


def test_questions_with_other_values_are_found(spark):
    rows, want = [], {}
    for i, (item, change) in enumerate(VARIANTS):
        text = QUESTIONS[item]
        for a, b in change.items():
            text = text.replace(a, b)
        rows += [(i, text), (100 + i, "Some words that come before it. " + text + " And some words that follow."), (200 + i, "word " * 30_000 + text)]
        want |= {k + i: item for k in (0, 100, 200)}
    rows += [(300 + i, c) for i, c in enumerate(CLEAN)] + [(400, None), (401, ""), (None, QUESTIONS[1]), (0, rows[0][1])]
    items = spark.createDataFrame([*QUESTIONS.items(), (3, None), (4, "")], "item_id long, text string")
    got = {(r.key, r.item_id) for r in decontamination.matches(table(spark, rows), "doc_id", items).collect()}
    assert got == {*want.items(), (None, 1)}
    assert decontamination.matches(table(spark, []), "doc_id", items).count() == 0
    assert decontamination.matches(table(spark, rows), "doc_id", items.limit(0)).count() == 0


def test_verbatim_items_by_brute_force(spark):
    """Every text that holds all words of an item in a row, and no text that shares none of its windows."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + rng.choice(["", "1", "on", "ar"])
    items = [(k, " ".join(word() for _ in range(rng.choice([6, 9, 20, 60])))) for k in range(12)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 80))) for _ in range(2)]
        rows.append((i, f"{parts[0]} {rng.choice(items)[1].upper() if i % 7 == 0 else rng.choice(items)[1] if i % 3 else ''} {parts[1]}"))
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    held = lambda a, b: any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))
    windows = lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    got = {(r.key, r.item_id): r for r in decontamination.matches(table(spark, rows), "doc_id", spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in rows:
        for k, item in items:
            a, b = split(item), split(text)
            if held(a, b):
                assert got[i, k].cover == 1.0 and (got[i, k].exact or i % 7 == 0)
            elif len(a) < 8 or not windows(a) & windows(b):
                assert (i, k) not in got


def brute_fingerprint(text):
    """Shingle hashes below an eighth of the range, else the smallest."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def h(words):
        x = 42
        for v in words:
            x = xxhash.xxh64(v.encode(), seed=x).intdigest()
        return x & 0x7FFFFFFFFFFFFFFF

    every = {h(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {h([" ".join(w)])} if w else set()
    below = {x for x in every if x < (1 << 63) // 8}
    return below or ({min(every)} if every else set())


def brute_likeness(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / min(len(a), len(b))


@pytest.mark.parametrize("range_rows", [3, 2_000_000])
def test_fingerprints_by_brute_force(spark, monkeypatch, range_rows):
    """Ids beyond 2 ** 53, ties of ids, ids that are null, repeated rows, long texts, several ranges."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
    rng = random.Random(5)

    def text(n):
        return " ".join(rng.choice(["ab", "c", "é", "dd"]) + str(rng.randrange(9)) for _ in range(n))

    rows = [((1 << 53) + i, text(rng.randrange(0, 60))) for i in range(12)] + [(i, text(30)) for i in range(8)]
    rows += [(3, text(12)), (3, text(9)), (None, text(20)), (None, "x"), (None, None), (5, text(4000)), *[(7, "same text of some words here")] * 3, *[(None, "x")] * 2]
    key = lambda r: (r[0] is None, -(r[0] or 0), (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()))
    order = [(i, t or "") for i, t in sorted(rows, key=key)]
    want = collections.Counter()
    for k, (i, own) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        f, g, h = map(brute_fingerprint, (own, edited, following))
        written = [",".join(f"{x:x}" for x in sorted(s)) for s in (f, g)]
        want[(i, len(own), hashlib.sha256(edited.encode()).hexdigest(), *written, round(brute_likeness(f, g), 9), round(brute_likeness(f, h), 9))] += 1
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.compare_edits(table(spark, rows)).collect())
    assert got == want


def test_fingerprint_of_a_union(spark):
    from pyspark.sql import functions as F

    a, b = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"))
    r = row.select("x", "y", fingerprints.merge(F.col("x"), F.col("y")).alias("m"), fingerprints.likeness(F.col("x"), fingerprints.merge(F.col("x"), F.col("y"))).alias("l")).first()
    assert r.m == sorted(set(r.x) | set(r.y)) and r.l == 1.0


def test_licences(spark):
    rows = [
        (1, "x CC-BY y. General Public\nLicense! cc by"), (2, None), (3, ""), (4, "ccby general public"), (5, "Licensed under the Apache License, Version 2.0."),
        (6, "z Released under the MIT License and ALL RIGHTS RESERVED"), (7, "Ünder cc é by"), (8, "a " * 3000 + "cc by"), (8, "a " * 3000 + "cc by"),
        (9, "Permission is hereby granted, free of all charge, to any person obtaining a copy of this software and the associated documentation files"),
    ]
    got = collections.defaultdict(list)
    for r in licences.scan(table(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        w = licences.words_of(t or "")
        places, labels = [], set()
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        for r in got[i]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
            assert r.base_labels == ",".join(sorted(labels)) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
    assert got[5][0].labels == "apache" and got[6][0].labels == "mit,reserved" and len(got[8]) == 2 and got[9][0].labels == "mit"
    assert licences.scan(table(spark, [])).count() == 0
