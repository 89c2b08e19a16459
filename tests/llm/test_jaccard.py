import pytest

from textcluster.llm import jaccard
from textcluster.llm.common import components

from .helpers import awkward, docs, empty, grams, groups, rng, words


def varied(r, base, n, rate):
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, int(rate * len(own)))):
            own[r.randrange(len(own))] = "".join(words(r, 2))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("how", [jaccard.Similarity(3, 90, 100), jaccard.Similarity(5, 80, 100)])
def test_matches_all_pairs(spark, how):
    r = rng(5)
    texts = awkward(r)
    for size in (8, 30, 120, 121):
        texts += varied(r, words(r, size), 25, 0.08)
    passage = words(r, 40)  # shared by documents that are otherwise different
    texts += [" ".join(passage + words(r, r.randint(1, 60))) for _ in range(40)]
    texts += [texts[20]] * 3
    found = {x["doc"]: x for x in jaccard.components_of(docs(spark, texts), how).collect()}
    sets = {i: grams(t, how.k) for i, t in enumerate(texts)}
    want = groups(sets, how.num, how.den)
    assert {i: x["component"] for i, x in found.items()} == want
    assert {i: x["n_grams"] for i, x in found.items()} == {i: len(s) for i, s in sets.items()}
    kept = jaccard.keep_one(docs(spark, texts), how)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({want[i] for i in want})
    assert kept.columns == docs(spark, ["x"]).columns


def test_null_and_repeated_ids(spark):
    text = " ".join(words(rng(7), 60))
    rows = jaccard.components_of(docs(spark, [text, text, text, "other words here", text], [4, None, 9, 2, 9]), jaccard.Similarity()).collect()
    assert sorted(((x["doc"], x["component"]) for x in rows), key=str) == sorted([(4, None), (None, None), (9, None), (2, 2), (9, None)], key=str)


def kept_rows(spark, texts, ids):
    return sorted(((x["doc_id"], x["text"]) for x in jaccard.keep_one(docs(spark, texts, ids), jaccard.Similarity()).collect()), key=str)


def test_groups_are_of_texts_where_an_id_has_several(spark):
    a, b = (" ".join(words(rng(i), 60)) for i in (1, 2))
    assert kept_rows(spark, [a, b, b, a], [5, 5, 2, 7]) == sorted([(5, a), (2, b)], key=str)
    # near copies of both texts of one id lie in different documents
    rows = kept_rows(spark, [a, b, a + " end", b + " end"], [3, 3, 1, 9])
    assert rows == sorted([(1, a + " end"), (3, b)], key=str)


def test_one_row_of_repeated_rows_and_of_null_ids_stays(spark):
    a, b, c = (" ".join(words(rng(i), 60)) for i in (3, 4, 5))
    rows = kept_rows(spark, [a, a, b, c, c, c, "", "", None], [None, None, None, 4, 4, 6, 7, 7, None])
    assert rows == sorted([(None, a), (None, b), (4, c), (7, ""), (7, ""), (None, None)], key=str)


def test_kept_rows_match_brute_force_by_row(spark):
    r = rng(21)
    base = [words(r, 40) for _ in range(4)]
    texts, ids = [], []
    for _ in range(150):
        texts += varied(r, r.choice(base), 1, 0.1)
        ids.append(r.choice([None, *range(40)]))
    sets = {i: grams(t, 5) for i, t in enumerate(texts)}
    found = groups(sets, 80, 100)
    members = {}
    for i in sets:
        members.setdefault(found[i], []).append(i)
    low = lambda i: -1 if ids[i] is None else ids[i]
    rows = kept_rows(spark, texts, ids)
    assert len(rows) == len(members)
    for m in members.values():
        least = min(map(low, m))
        assert sum(row in [(ids[i], texts[i]) for i in m if low(i) == least] for row in rows) == 1


def test_empty_table(spark):
    assert jaccard.components_of(empty(spark), jaccard.Similarity()).count() == 0


def test_prefix_lengths_reach_every_partner():
    for how in (jaccard.Similarity(3, 90, 100), jaccard.Similarity(5, 80, 100)):
        for n in range(1, 200):
            for m in range(n, 260):
                least = -(-how.num * (n + m) // (how.num + how.den))  # overlap of a linked pair
                if least <= n:
                    assert how.prefix(n) >= n - least + 1 and how.prefix(m) >= m - least + 1


def test_components_of_chains_and_stars(spark):
    r = rng(11)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(300, 301), (301, 300), (302, 302)]
    edges = [(a * 7 % 1009, b * 7 % 1009) for a, b in edges]
    r.shuffle(edges)
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: top(n) for n in linked}
