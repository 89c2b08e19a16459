import re
from collections import Counter

import pytest

from textcluster.llm import line_rules

from .helpers import awkward, docs, empty, rng, words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def norm(line):
    return " ".join(WORD.findall(low(line)))


def brute(rows, rules):
    """rows: (id, text, host) -> sorted (id, counts, removed words, failed, kept, text left)."""
    held, per_host = {}, {}
    for i, t, h in rows:
        per_host.setdefault(h, set()).add(i)
        for line in (t or "").split("\n"):
            if norm(line):
                held.setdefault((h, norm(line)), set()).add(i)
    common = {k for k, v in held.items() if len(v) >= rules.min_docs and 100 * len(v) > rules.max_share * len(per_host[k[0]])}
    out = []
    for i, t, h in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if norm(x)]
        times = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + d for j in range(len(w) - 2) if times[tuple(w[j : j + 3])] > 1 for d in range(3)}
        gone = sum(len(WORD.findall(x)) for x in lines if (h, norm(x)) in common)
        failed = len(w) < rules.min_words or 100 * len(covered) > rules.max_repeated * len(w)
        left = len(w) - gone
        kept = not failed and left >= rules.min_left and 100 * left >= rules.min_left_share * len(w)
        rest = "\n".join(x for x in t.split("\n") if not norm(x) or (h, norm(x)) not in common)
        counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        out.append((i, *counts, gone, failed, kept, rest))
    return out


@pytest.fixture(scope="module")
def case(spark):
    r = rng(5)
    menu = ["Home  About É", "home about\té #1", "Terms & Conditions | Imprint " + " ".join(words(r, 30))]
    texts, hosts = awkward(r), []
    for i in range(120):
        lines = [" ".join(words(r, r.randint(1, 30))) for _ in range(r.randint(0, 6))]
        lines += [m.upper() if r.random() < 0.3 and m.isascii() else m for m in r.sample(menu, r.randint(0, 3))]
        lines += [lines[0]] * r.randint(0, 2) if lines else []
        r.shuffle(lines)
        texts.append("\n".join(lines) + "\n" * r.randint(0, 2))
    texts += ["same page of one host " * 3 + "\n" + " ".join(words(rng(8), 60))] * 30
    ids = list(range(len(texts)))
    ids[2], ids[3], ids[20] = None, None, ids[21]
    for i in range(len(texts)):
        hosts.append(None if i % 17 == 0 else "big" if i % 3 else "small")
    frame = docs(spark, texts, ids)
    by_id = spark.createDataFrame([(i, t, h) for i, t, h in zip(ids, texts, hosts, strict=True)], "doc_id long, text string, source string")
    wide = by_id.selectExpr("*", "'x' as row", "1 as host", "2 as kept", "3 as lines")
    assert set(frame.columns) >= {"doc_id", "text", "source"}
    return wide.repartition(3), list(zip(ids, texts, hosts, strict=True))


RULES = line_rules.Rules(min_docs=4, max_share=10)


def test_counts_and_verdicts_match_brute_force(case):
    frame, rows = case
    got = sorted((tuple(x) for x in line_rules.judge(frame, RULES).collect()), key=str)
    want = sorted((x[:-1] for x in brute(rows, RULES)), key=str)
    assert got == want
    assert {x[-1] for x in got} == {True, False} and any(x[6] for x in got)


def test_cleaned_texts_match_brute_force(case):
    frame, rows = case
    cleaned = line_rules.clean(frame, RULES)
    assert cleaned.columns == frame.columns
    got = sorted(((x["doc_id"], x["text"], x["kept"]) for x in cleaned.collect()), key=str)
    assert got == sorted(((x[0], x[-1], 2) for x in brute(rows, RULES) if x[-2]), key=str)


def test_limits_follow_the_host(spark):
    body = [" ".join(words(rng(i), 60)) for i in range(40)]
    rows = [(i, ("a line of the big host\n" if i < 5 else "") + body[i], "big" if i < 36 else "tiny") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = lambda share: sum(x["n_removed_words"] for x in line_rules.judge(frame, line_rules.Rules(min_docs=5, max_share=share)).collect())
    assert removed(13) == 5 * 6 and removed(14) == 0


def test_empty_table(spark):
    assert line_rules.judge(empty(spark)).count() == 0
    assert line_rules.clean(empty(spark)).count() == 0
