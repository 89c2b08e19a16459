import random
import re

from textcluster.llm import pii

from .helpers import awkward, docs, empty, rng, words

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in double) % 10 == 0


def brute(text):
    bare = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int("0" + x.lstrip("0")[:4]) <= 255 for x in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(bare(m)) <= 19 and luhn(bare(m))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(bare(m)) <= 15]


def test_patterns_match_plain_regular_expressions():
    r = random.Random(4)
    for _ in range(20000):
        text = "".join(r.choice("a1.@-+ %_()9é25.@1.") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("4532015112830366 4532-0151-1283-0366", "+1 (415) 555-2671 x", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "a@b.c._x@d.e", "0" * 5000 + ".1.1.1"):
        assert pii.base_spans(text) == brute(text), text


def corpus(r, n=400):
    texts = []
    for i in range(n):
        own = words(r, 60)
        if i % 3 == 0:
            own[30:30] = ["mailbox", f"user{i}@mail.example.com"]
        if i % 5 == 0:
            own[10:10] = ["callme", "+1 (415) 555-26%02d" % (i % 100)]
        texts.append(" ".join(own))
    return texts


def statistics(texts):
    """Words, and words in contexts by kind, counted one by one."""
    whole, near, size = {}, {}, {}
    for text in texts:
        spans = brute(text or "")
        found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", text or "")]
        for *_, w in found:
            whole[w] = whole.get(w, 0) + 1
        free = [w for w in found if not any(w[0] < b and w[1] > a for _, a, b in spans)]
        for kind in range(4):
            own = set()
            for k, a, b in spans:
                if k == kind:
                    left, right = sum(w[0] < a for w in free), sum(w[0] < b for w in free)
                    own |= set(range(max(0, left - pii.RADIUS), left)) | set(range(left, min(len(free), right + pii.RADIUS)))
            for i in own:
                near[kind, free[i][2]] = near.get((kind, free[i][2]), 0) + 1
                size[kind] = size.get(kind, 0) + 1
    return whole, near, size


def test_terms_that_reveal_an_entity_are_found(spark):
    texts = corpus(rng(6)) + awkward(rng(7))
    got = pii.disclosing_terms(docs(spark, texts))
    assert {k: len(v) for k, v in got.items() if k in (0, 3)}.keys() == {0, 3}
    rows = {x["doc_id"]: x for x in pii.mark(docs(spark, texts), terms=got).collect()}
    for i, text in enumerate(texts):
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in rows[i]["__pii"] if s["kind"] in pii.KINDS]
        assert base == brute(text or "")
        terms = {(text[s["start"] : s["end"]], s["kind"]) for s in rows[i]["__pii"] if s["kind"] not in pii.KINDS}
        assert (("mailbox", "remove") in terms) == (i < 400 and i % 3 == 0) and (("callme", "remove") in terms) == (i < 400 and i % 5 == 0)
    # the disclosure rule, from counts made one by one
    import math

    import numpy as np

    from textcluster.llm import scan

    whole, near, size = statistics(texts)
    total = sum(whole.values())
    want = {}
    for (kind, w), n in near.items():
        if n >= max(3, math.ceil(pii.SUPPORT * size[kind] / (2 * pii.RADIUS))):
            share = size[kind] / total
            told = math.log2(n / whole[w] / share) / -math.log2(share)
            if told >= pii.GENERALISE:
                data = np.frombuffer(w.encode(), np.uint8)
                h = scan.run_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0]
                want.setdefault(kind, {})[int(h)] = "remove" if told >= pii.REMOVE else "generalise"
    assert got == want


def test_a_rare_term_is_found_whatever_the_corpus(spark):
    # 5 of 12,000 e-mail contexts: always beside an e-mail, but in far less than 0.2 % of them
    r = rng(12)
    texts = [" ".join([*words(r, 40), "raremailer" if i < 5 else "write", f"user{i}@mail.example.com", *words(r, 40)]) for i in range(12000)]
    rows = pii.mark(docs(spark, texts)).filter("doc_id < 5").collect()
    assert len(rows) == 5
    for x in rows:
        assert ("raremailer", "remove") in {(x["text"][s["start"] : s["end"]], s["kind"]) for s in x["__pii"]}


def test_joined_terms_equal_broadcast_terms(spark):
    frame = docs(spark, (texts := corpus(rng(6)) + awkward(rng(7)) + [None, corpus(rng(6))[0]]), [(None, 7, i)[i % 3] for i in range(len(texts))])
    got = [sorted(repr((x["doc_id"], x["text"], x["__pii"])) for x in pii.mark(frame, max_bytes=n).collect()) for n in (32 << 20, 0)]
    assert got[0] == got[1] and any("remove" in x for x in got[0])


def test_spans_are_ordered_by_kind_then_start(spark):
    texts = ["x weak a@b.c strong y strong weak 1.2.3.4"]
    hashes = pii.disclosing_terms(docs(spark, ["strong a@b.c strong strong " + " ".join(words(rng(3), 40))]))
    strong = next(iter(hashes[0]))
    import numpy as np

    from textcluster.llm import scan

    weak = int(scan.run_hashes(np.frombuffer(b"weak", np.uint8), np.array([0]), np.array([4])).view(np.int64)[0])
    frame, order = docs(spark, texts), (*pii.KINDS, "generalise", "remove")
    table = spark.createDataFrame([(0, strong, "remove"), (0, weak, "generalise")], "kind int, term long, told string")
    for marked in (pii.mark(frame, terms={0: {strong: "remove", weak: "generalise"}}), pii._joined_mark(frame, "text", table)):
        spans = [(s["kind"], s["start"]) for s in marked.first()["__pii"]]
        assert spans == sorted(spans, key=lambda s: (order.index(s[0]), s[1]))
        assert [k for k, _ in spans] == ["email", "ip", "generalise", "generalise", "remove", "remove"]


def test_sanitised_texts(spark):
    texts = corpus(rng(6)) + [None, "", "no data"]
    out = {x["doc_id"]: x["text"] for x in pii.sanitise(docs(spark, texts)).collect()}
    assert "user0@" not in out[0] and "[EMAIL]" in out[0] and "mailbox" not in out[0] and "[PHONE]" in out[0]
    assert out[400] is None and out[401] == "" and out[402] == "no data" and out[1] == texts[1]


def test_empty_table(spark):
    assert pii.mark(empty(spark)).count() == 0
