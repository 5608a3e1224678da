"""Near-duplicates against brute force: groups of copies around the threshold, repeated rows, growth of the pairs."""

import random

import pytest

from lodestone.llm import common, minhash


def shingles(text, k):
    w = text.split()
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else {tuple(w)} if w else set()


def links_of(texts, k):
    sets = [shingles(t, k) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                yield j, i


def components_of(texts, k):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links_of(texts, k):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return {i: find(i) for i in range(len(texts))}


def group(r, members, edits, words=150, centre=True):
    """Copies of one text, each with some of its words exchanged, now and then for words of the text itself."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    base, out = [word() for _ in range(words)], []
    for i in range(members):
        t = list(base)
        for _ in range(r.randint(*edits) if i or not centre else 0):
            at, how = r.randrange(len(t)), r.random()
            t[at : at + 1] = [] if how < 0.1 else [r.choice(base)] if how < 0.3 else [word()]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("k, edits, centre", [(2, (0, 20), True), (5, (0, 10), True), (2, (4, 9), False)])
def test_group_around_the_threshold(spark, k, edits, centre):
    r = random.Random(k + len(edits) + centre)
    texts = group(r, 120, edits, centre=centre) + group(r, 5, edits, words=9) + [t for _ in range(20) for t in group(r, 2, (1, 6), words=40, centre=False)]
    r.shuffle(texts)
    want = components_of(texts, k)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=k).collect()}
    assert got == want and 20 < sum(i != c for i, c in want.items()) < len(texts)


def test_pairs_grow_with_the_group(spark, monkeypatch):
    """Members beyond the threshold of all others: the pairs that are compared grow in proportion."""
    compared, verified, sketched = [], minhash._Search.verified, minhash._Search.with_sketches
    monkeypatch.setattr(minhash._Search, "verified", lambda self, pairs: compared.append(pairs.count()) or verified(self, pairs))
    monkeypatch.setattr(minhash._Search, "with_sketches", lambda self, pairs: compared.append(pairs.count()) or sketched(self, pairs))
    for members in (150, 300):
        compared.clear()
        texts = group(random.Random(members), members, (9, 20))
        minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2).collect()
        assert 0 < sum(compared) < 10 * members


def test_links_at_the_threshold_are_found(spark):
    """Recall of links of 0.80 to 0.82, measured on pairs that only have each other."""
    r, texts = random.Random(8), []
    while len(texts) < 400:
        pair = group(r, 2, (6, 9), words=160)
        both = [shingles(t, 2) for t in pair]
        if 0.8 <= len(both[0] & both[1]) / len(both[0] | both[1]) < 0.82:
            texts += pair
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 400, 2)) == 200


def test_repeated_doc_ids(spark):
    """Every row comes back once; a doc_id with two texts is in one component; repeated rows make no pairs."""
    r = random.Random(5)
    a, b = " ".join(group(r, 1, (0, 0))), " ".join(group(r, 1, (0, 0)))
    rows = [(1, a), (2, b), (5, a), (5, b), (5, b), (7, None), (7, a + " x"), (7, None), (None, a), (None, None)] + [(8, a + " y")] * 30
    got = minhash.near_duplicates(spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, pick int")).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert all(len({x.component_id for x in v}) == 1 for v in by.values())
    assert sorted(x.n_shingles for x in by[5]) == sorted(len(shingles(t, 5)) for i, t in rows if i == 5)
    assert sorted(x.n_shingles for x in by[7]) == [0, 0, len(shingles(a + " x", 5))]
    assert by[8][0].component_id == 1 and all(not x.kept for x in by[8]) and by[None][0].component_id is None
    assert by[5][0].component_id in (1, 2)


def test_pairs_of_a_hub_cost_few_tables(spark, monkeypatch):
    """A hub's pairs meet their two texts by pair, with pairs that are sent to all tasks and with pairs that are not."""
    texts = group(random.Random(4), 40, (0, 12))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(3, 5)], "a long, b long")
    want = {x for x in links_of(texts, 2) if x in {(r.a, r.b) for r in pairs.collect()}}
    cuts, cut = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda *a: cuts.append(1) or cut(*a))
    search = minhash._Search(rows, None, 2, 80, 64)
    for few in (True, False):
        if not few:
            monkeypatch.setattr(minhash, "small", lambda df: df)
        got = [(r.a, r.b) for r in search.verified(pairs).collect()]
        assert sorted(got) == sorted(want) and 0 < len(want) < 40
    assert len(cuts) == 2


def test_a_large_group_takes_few_jobs(spark, monkeypatch):
    """A group of near copies: rounds of components and of hubs write few tables (26; 32 before components had a driver's way)."""
    cuts, cut = [], common.cut
    for module in (common, minhash):
        monkeypatch.setattr(module, "cut", lambda *a: cuts.append(1) or cut(*a))
    texts = group(random.Random(150), 150, (9, 20))
    minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2).collect()
    assert len(cuts) <= 28
