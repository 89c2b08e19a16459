from textcluster.llm import line_dedup

from .helpers import awkward, docs, empty, rng


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_chars=40, min_docs=5):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(-(1 << 63) if i is None else i)
    last = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i if i is not None else -(1 << 63)) == (i if i is not None else -(1 << 63))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    r = rng(3)
    common = ["A shared line that is long enough to be a Key É " + str(i) for i in range(4)]
    texts = awkward(r)
    for i in range(60):
        lines = [f"line {i} {j} of its own, long enough to be a key" for j in range(3)]
        lines += [r.choice(("  ", "\t", "")) + c.upper() * (r.random() < 0.5) or c for c in r.sample(common, r.randint(0, 4))] * r.randint(1, 2)
        r.shuffle(lines)
        texts.append("\n".join(lines))
    ids = list(range(len(texts)))
    ids[3], ids[20] = None, ids[21]  # a null id, an id with two texts
    texts.append(texts[30])
    ids.append(ids[30])  # a repeated row
    frame = docs(spark, texts, ids)
    got = line_dedup.dedup_lines(frame)
    assert got.columns[: len(frame.columns)] == frame.columns
    rows = sorted(((x["doc_id"], x["__ld_lines"], x["__ld_dropped"], x["__ld_kept"] or "") for x in got.collect()), key=str)
    assert rows == brute(list(zip(ids, texts, strict=True)))


def test_many_lines_fill_several_words(spark):
    line = "this line is long enough to be held by documents "
    texts = ["\n".join([line] * 200 + [f"own {i}"]) for i in range(6)]
    rows = line_dedup.dedup_lines(docs(spark, texts)).collect()
    assert {x["doc_id"]: x["__ld_dropped"] for x in rows} == {**dict.fromkeys(range(5), 200), 5: 0}


def test_empty_table(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = line_dedup.dedup_lines(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
