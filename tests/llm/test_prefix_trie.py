import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcluster.llm import prefix_trie

from .helpers import rng

SCHEMA = "conv_id long, turn long, role string, text string, part string, n string, turns string"


def ordered(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    return {c: [t[3:] for t in sorted(v)] for c, v in out.items()}


def brute(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p in members:
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members[p]) if len(seqs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, ())), sum(q not in kids for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def nodes(found):
    return sorted((tuple(x) for x in found.collect()), key=str)


def conversations(r, n):
    rows = []
    menu = [("system", "You are é " * 3), ("user", "hi"), ("assistant", ""), (None, "hi"), ("user", None), ("user", "\U0001f600 ok")]
    for c in range(n):
        seq = [r.choice(menu[: 2 + k]) for k in range(r.randint(0, 5))] if c % 4 else menu[:3]
        for k, (role, text) in enumerate(seq):
            rows.append((c - 5, None if k == 0 and c % 3 == 0 else k, role, text))
    return rows + rows[:6] + [(None, 0, "user", "lost"), (900, 0, "user", "long " * 20000)] + [(901, k, "user", str(k % 3)) for k in range(300)]


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_matches_brute_force_over_any_partitioning(spark, parts):
    rows = conversations(rng(parts), 90)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes(prefix_trie.trie(prefix_trie.sequences(frame(spark, rows)))) == brute(ordered(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_conversation_held_by_a_third_spans_partitions(spark):
    same = [(0, "system", "s"), (1, "user", "a")]
    rows = [(c, *t) for c in range(1500) for t in (same if c % 3 == 0 else [*same, (2, "user", str(c % 50))])]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes(prefix_trie.trie(prefix_trie.sequences(frame(spark, rows)))) == brute(ordered(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_rebuilt_takes_the_first_turns_of_the_base(spark):
    rows = conversations(rng(9), 60)
    own = prefix_trie.sequences(frame(spark, rows))
    head = (F.abs("conv_id") % 4).cast("int")
    found = prefix_trie.trie(prefix_trie.rebuilt(own, F.col("conv_id") - F.col("conv_id") % 10, head, 3))
    seqs = ordered(rows)
    base = lambda c: c - int(np.fmod(c, 10))
    want = {c: seqs.get(base(c), [])[: abs(c) % 4] + s[abs(c) % 4 :] for c, s in seqs.items()}
    assert nodes(found) == brute(want)
    assert [] in want.values()


def test_union_find_makes_one_node_per_branch():
    # a, ab, ab, abc | abd | b   as lengths and neighbour LCPs
    depth, parent, lo, hi, low, children = prefix_trie.forest(np.array([0, 1, 2, 2, 2, 0]), np.array([1, 2, 2, 3, 3, 1]), np.array([9, 8, 7, 6, 5, 4]))
    found = sorted(zip(depth.tolist(), lo.tolist(), hi.tolist(), low.tolist(), children.tolist(), strict=True))
    assert found == [(0, 0, 5, 4, 2), (1, 0, 4, 5, 1), (1, 5, 5, 4, 0), (2, 1, 4, 5, 2), (3, 3, 3, 6, 0), (3, 4, 4, 5, 0)]
    assert [depth[p] if p >= 0 else None for p in parent[np.argsort(depth, kind="stable")]] == [None, 0, 0, 1, 2, 2]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.sequences(empty)).count() == 0
