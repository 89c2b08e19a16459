"""N-gram Jaccard join by multiple-global-order prefix filtering.

Documents are sets of word n-gram hashes. Under any global order of the n-grams, two sets that are
similar enough share an n-gram among the first few of each (the prefix). Candidates come from shared
prefix n-grams under a first order, must also share prefix n-grams under two more orders, and are
then verified with their whole sets. All orders put frequent n-grams last (a fixed-size counting
sketch over the whole corpus gives the frequency class) and break ties by differently keyed hashes;
a sketch collision only changes the order, never the result. N-grams before the first common one are
not common, which bounds a pair's overlap by the places of a shared n-gram before it is verified.

Dense groups do not give all pairs. Equal sets are one node. In a first round each node is compared
only with one hub per shared prefix n-gram; the links found join nodes into components. In the
second round, an n-gram's nodes outside its largest component meet the nodes of other components, a
pair as a rule at its first common n-gram only.
Pairs inside a component need no comparison, all other candidate pairs get one: the components equal
those of the complete join.

N-grams are 64-bit hashes and sets are identified by 128 bits and their size.

Defined results: a null or empty text, or one without words, has an empty set and links with
nothing; a text of fewer than ``k`` words is one n-gram of all its words; groups are of texts, so an id
with several texts gives a row per text, each in its own text's group (two groups may then have the
same smallest id); a null id sorts below all ids and is returned as null; an empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import MIN_LONG, bitmap, components, lookup, maybe_in, total, written

SKETCH_BITS = 22
BLOCK = 1 << 14
STRETCH = 32
ORDER_SEEDS = (0x0A11CE, 0x0B0B, 0x0CA501)
PROFILE = "struct<n:int,f1:bigint,f2:bigint,heat:int,pre1:array<bigint>,pre2:array<int>,pre3:array<int>>"


@dataclass(frozen=True)
class Similarity:
    """Two sets link when den * intersection >= num * union; n-grams have k words."""

    k: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        """Prefix length that holds the first common n-gram with every partner."""
        return n - -(-self.num * n // self.den) + 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of text i are first[i] .. first[i + 1], with repeats."""
    starts, ends, first = scan.runs(data, offsets, ~scan.SPACE[data])
    words = scan.run_hashes(data, starts, ends)
    count = np.diff(first)
    windows = scan.window_hashes(words, k)
    last = np.repeat(first[1:], count)[: len(windows)]
    kept = windows[np.arange(len(windows)) + k <= last]
    sizes = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.concatenate([[0], np.cumsum(sizes)])[short]
        kept = np.insert(kept, at, [scan.window_hashes(words[first[i] : first[i + 1]], int(count[i]))[0] for i in short.tolist()])
        sizes[short] = 1
    return kept, np.concatenate([[0], np.cumsum(sizes)])


def frequency_levels(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """log2 classes of n-gram counts over all documents, by hash bucket: 2 ** SKETCH_BITS bytes."""

    def count(batches):
        seen = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, data, offsets in scan.texts(batch.column(0), 1 << 20):
                hashes, _ = shingle_hashes(data, offsets, k)
                where, n = np.unique((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
                seen[where] += n.astype(np.uint32)
        blocks = [(b // BLOCK, zlib.compress(part.tobytes(), 1)) for b in range(0, len(seen), BLOCK) if (part := seen[b : b + BLOCK]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], ["block", "counts"])

    def add(frames):
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for block, counts in zip(frame["block"], frame["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                sums[block] = sums[block] + part if block in sums else part
        yield pd.DataFrame({"block": list(sums), "levels": [np.log2(s + 1.0).astype(np.uint8).tobytes() for s in sums.values()]})

    parts = docs.select(text_col).mapInArrow(count, "block int, counts binary")
    merged = parts.repartition(64, "block").mapInPandas(add, "block int, levels binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in merged.collect():  # 256 blocks of 16 KB, whatever the input
        out[row[0] * BLOCK : (row[0] + 1) * BLOCK] = np.frombuffer(row[1], np.uint8)
    return out


def _profile_udf(shared, how: Similarity):
    @F.arrow_udf(PROFILE)
    def profile(column: pa.Array) -> pa.Array:
        levels = shared.value
        rows = []
        for _, data, offsets in scan.texts(column, 1 << 20):
            hashes, first = shingle_hashes(data, offsets, how.k)
            for i in range(len(offsets) - 1):
                own = np.unique(hashes[first[i] : first[i + 1]])
                n = len(own)
                if not n:
                    rows.append({"n": 0})
                    continue
                level = levels[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                prefixes, p = [], how.prefix(n)
                for seed in ORDER_SEEDS:
                    order = (level.astype(np.uint64) << np.uint64(58)) | (scan.mixed(own ^ np.uint64(seed)) >> np.uint64(6))
                    at = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                    prefixes.append(own[at[np.argsort(order[at])]])
                f1, f2 = (int(scan.mixed(own + np.uint64(s)).sum().view(np.int64)) for s in (1, 2))
                rows.append({"n": n, "f1": f1, "f2": f2, "heat": -int(100 * level.mean()), "pre1": prefixes[0].view(np.int64), "pre2": _short(prefixes[1]), "pre3": _short(prefixes[2])})
        ints = pa.list_(pa.int32())
        kind = pa.struct([("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("heat", pa.int32()), ("pre1", pa.list_(pa.int64())), ("pre2", ints), ("pre3", ints)])
        found = pa.array(rows, kind)
        rows.clear()
        scan.release()
        return found

    return profile.asNondeterministic()


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits are enough for a filter: a collision only passes one more pair to the verification."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _set_udf(k: int):
    @F.arrow_udf("array<bigint>")
    def whole_set(column: pa.Array) -> pa.Array:
        sets = []
        for _, data, offsets in scan.texts(column, 1 << 20):
            hashes, first = shingle_hashes(data, offsets, k)
            sets += [np.unique(hashes[first[i] : first[i + 1]]).view(np.int64) for i in range(len(offsets) - 1)]
        return pa.array(sets, pa.list_(pa.int64()))

    return whole_set.asNondeterministic()


def profiles(docs: DataFrame, how: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per document: id and text hash, set size and identity, and its prefixes under three orders."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, text_col, how.k))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc")
    rows = docs.select(doc, F.xxhash64(text_col).alias("th"), _profile_udf(levels, how)(F.col(text_col)).alias("p"))
    return written(rows.select("doc", "th", "p.*"), "jaccard-profiles")


def _enough(overlap, a: str, b: str, how: Similarity):
    """Whether an overlap of that size can link sets of sizes a and b."""
    return overlap * (how.num + how.den) >= (F.col(a) + F.col(b)) * how.num


def _in_reach(a: str, b: str, how: Similarity):
    """Whether a shared n-gram at these prefix places can be the first common one of a linked pair: all
    that is common then stands at or behind it, in both sets."""
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    return _enough(rest, f"{a}n", f"{b}n", how)


def _bound(one: str, two: str, n: str):
    """Most n-grams of a set of size n that can be common, by the first common one of its prefix."""
    return F.col(n) - F.array_position(one, F.get(F.array_intersect(one, two), 0)) + 1


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, how: Similarity, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes that share prefix n-grams under the other orders too and are similar enough."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("pre2").alias(f"{x}2"), F.col("pre3").alias(f"{x}3")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b")
    for order in "23":
        met = met.filter(F.arrays_overlap(f"a{order}", f"b{order}"))
        met = met.filter(_enough(F.least(_bound(f"a{order}", f"b{order}", "an"), _bound(f"b{order}", f"a{order}", "bn")), "an", "bn", how))
    met = written(met.select("a", "b").distinct(), "jaccard-candidates")
    # a node's set is made from one text; a bitmap of fixed size keeps most other texts out of the shuffle
    wanted = met.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc", "th"), "node")
    wanted = written(wanted, "jaccard-wanted")
    key = ["doc", "th"]
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("body"))
    own = maybe_in(own, bitmap(wanted, key), [F.col(c) for c in key]).filter("__maybe")
    own = own.groupBy(*key).agg(F.first("body").alias("body"))
    sets = written(own.join(wanted, key).select("node", _set_udf(how.k)(F.col("body")).alias("grams")), "jaccard-sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"{x}s")) for x in "ab")
    both = met.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("as", "bs")))
    return both.filter(F.col("shared") * how.den >= (F.size("as") + F.size("bs") - F.col("shared")) * how.num).select("a", "b").distinct()


def _with_grams_before(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``posts`` with ``before``: the n-grams that stand before it in its stretch of STRETCH places of the
    prefix. Two nodes with one of them in common also meet there, at smaller places, so that the pair is in
    reach there too."""
    posts = written(posts, "jaccard-mixed-posts")
    own = maybe_in(nodes.select("node", "pre1"), bitmap(posts, ["node"]), [F.col("node")]).filter("__maybe")
    places = F.sequence(F.lit(0), F.floor((F.size("pre1") - 1) / STRETCH).cast("int"))
    stretches = F.transform(places, lambda s: F.slice("pre1", s * STRETCH + 1, STRETCH))
    own = own.select("node", F.posexplode(stretches).alias("stretch", "grams"))
    met = posts.withColumn("stretch", F.floor(F.col("pos") / STRETCH).cast("int")).join(own, ["node", "stretch"])
    return met.select(*posts.columns, F.slice("grams", F.lit(1), F.col("pos") % STRETCH).alias("before"))


def linked(docs: DataFrame, how: Similarity, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(profiles, members): members has one row per set identity (f1, f2, n), which is a node: its number
    of rows ``copies``, and of all rows linked with it the smallest document ``component`` with the
    smallest text hash ``component_th``."""
    profile = profiles(docs, how, id_col, text_col)
    keys = ["f1", "f2", "n"]
    full = profile.filter("n > 0")
    reps = full.groupBy(*keys).agg(F.min(F.struct("doc", "th")).alias("rep"), F.count("*").alias("copies"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), *keys, "rep.doc", "rep.th", "copies"), "jaccard-reps")
    row = [*keys, "doc", "th"]  # one exchange for the join and for rows that repeat
    nodes = full.join(reps.select("node", *row), row).dropDuplicates(row)
    nodes = written(nodes.select("node", "doc", "th", "n", "heat", "pre1", "pre2", "pre3"), "jaccard-nodes")
    # read off the nodes where needed: most are of n-grams that no other set has in its prefix
    posts = nodes.select("node", "n", "heat", F.posexplode("pre1").alias("pos", "gram")).select("gram", "node", "n", "heat", "pos")
    hubs = posts.groupBy("gram").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.min(F.struct("heat", "node", "n", "pos")).alias("hub"))
    hubs = written(hubs.filter("x < y").select("gram", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "n", "pos")]), "jaccard-hubs")
    posts = written(posts.drop("heat").join(hubs, "gram"), "jaccard-posts")

    # round 1: every node against the hub of each n-gram
    met = posts.filter("node <> hub_node").filter(_in_reach("", "hub_", how))
    first = written(met.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct(), "jaccard-pairs")
    links = written(_verified(first, nodes, docs, how, id_col, text_col), "jaccard-links")
    found = components(links)

    # round 2: nodes outside an n-gram's largest component against the nodes of other components
    own = posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = written(own.select("gram", "node", "n", "pos", "component"), "jaccard-posts")
    parts = own.groupBy("gram", "component").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("gram").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("gram", F.col("top.component").alias("main"))
    mixed = written(mixed, "jaccard-mixed")
    rest = written(_with_grams_before(own.join(mixed, "gram"), nodes), "jaccard-rest")
    x, y = (rest.select("gram", "main", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "pos", "component", "before")]) for s in "xy")
    second = x.filter("x_component <> main").join(y.drop("main"), "gram").filter("x_component <> y_component").filter(_in_reach("x_", "y_", how))
    # a pair once, not from both sides, and not again at an n-gram behind one where it has met
    second = second.filter("y_component = main or x_node < y_node").filter(~F.arrays_overlap("x_before", "y_before"))
    second = second.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    second = written(second.join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = _verified(second, nodes, docs, how, id_col, text_col)
    all_links = written(links.unionByName(more), "jaccard-links")
    grouped = reps.join(components(all_links).withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    grouped = written(grouped, "jaccard-grouped")
    tops = grouped.groupBy("group").agg(F.min(F.struct("doc", "th")).alias("top"), F.count("*").alias("size"))
    tops = written(tops.select("group", "size", F.col("top.doc").alias("component"), F.col("top.th").alias("component_th")), "jaccard-tops")
    members = lookup(grouped.select(*keys, "copies", "group"), tops, ["group"], "size", ["component", "component_th"], total(tops, "size"))
    return profile, written(members.drop("group"), "jaccard-members")


def _grouped_rows(docs: DataFrame, how: Similarity, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, n, component, component_th) per document row; an empty set is its own component."""
    profile, members = linked(docs, how, id_col, text_col)
    plain = profile.select("doc", "th", "f1", "f2", "n")
    found = lookup(plain, members, ["f1", "f2", "n"], "copies", ["component", "component_th"], total(members, "copies"))
    return found.select("doc", "th", "n", F.coalesce("component", "doc").alias("component"), F.coalesce("component_th", "th").alias("component_th"))


def components_of(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_grams, component) per document row; an empty set is its own component."""
    found = _grouped_rows(docs, how, id_col, text_col)
    real = lambda c: F.when(F.col(c) != MIN_LONG, F.col(c))
    return found.select(real("doc").alias("doc"), F.col("n").cast("long").alias("n_grams"), real("component").alias("component"))


def keep_one(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of texts: the one with the smallest id, of its texts in the
    group that with the smallest hash, and one of rows that repeat both. Documents with an empty set stay.
    Only texts that go or repeat are shuffled; a bitmap tells them from the others."""
    key, own = ["doc", "th"], ["__jc_doc", "__jc_th"]
    rows = _grouped_rows(docs, how, id_col, text_col).filter("n > 0")
    lost = (F.col("doc") != F.col("component")) | (F.col("th") != F.col("component_th"))
    touched = rows.withColumn("lost", lost).groupBy(*key, "lost").agg(F.count("*").alias("copies")).filter("lost or copies > 1")
    touched = written(touched.select(*[F.col(c).alias(o) for c, o in zip(key, own, strict=True)], F.col("lost").alias("__jc_lost")), "jaccard-touched")
    values = [F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)), F.xxhash64(text_col)]
    marked = maybe_in(docs, bitmap(touched, own), values)
    same = marked.filter(~F.col("__maybe")).select(*docs.columns)
    other = marked.filter("__maybe").select(*docs.columns, *[v.alias(f"{o}_own") for v, o in zip(values, own, strict=True)])
    met = other.join(touched, [F.col(f"{o}_own") == F.col(o) for o in own], "left").filter(~F.coalesce("__jc_lost", F.lit(False)))
    repeated = met.filter("__jc_lost is not null").dropDuplicates(own).select(*docs.columns)
    return same.unionByName(met.filter("__jc_lost is null").select(*docs.columns)).unionByName(repeated)
