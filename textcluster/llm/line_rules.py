"""Quality rules with cross-document line frequency.

Every line is normalised (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, joined by one space) and
hashed; the distinct documents that hold it are counted on each host. A line held by more documents
than the host's limit (``min_docs``, or ``max_share`` percent of the host's documents if that is
more) is boilerplate: its occurrences are removed from all documents of that host, and a document
that keeps too few of its words is depleted and rejected. Rules on the text alone (too few words, too
many words in repeated 3-word windows) come first.

Texts are read once, by an Arrow function that gives each document's statistics and its distinct
lines as two hashes of 64 bits; only these narrow rows are shuffled. Counts are partial sums over
(host, line, document), hosts and lines of any size are looked up with hot keys dealt out, and a
bitmap of fixed size keeps lines that are no boilerplate out of the last shuffle.

Defined results: a null or empty text has no words and fails the base rules; lines without a word are
neither counted nor removed; a null host is a host of its own; all rows with a null id count as one
document, as do rows that repeat an id; repeated rows give one result each; an empty table gives no
rows. Only the id, text and host columns are read; other columns are carried through by ``judge`` and
``clean`` whatever their names (results are named ``__lr_...``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import MIN_LONG, bitmap, fingerprint, lookup, maybe_in, total, written

SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SECOND = np.uint64(0x2545F4914F6CDD1D)
WINDOW = 3
LINE = ["host", "h1", "h2"]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Limits; shares are percentages."""

    min_words: int = 50
    max_repeated: int = 50
    min_docs: int = 10
    max_share: int = 1
    min_left: int = 25
    min_left_share: int = 30


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive bounds."""
    done = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return done[bounds[1:]] - done[bounds[:-1]]


def _tagged(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a text."""
    return scan.mixed(hashes + scan.mixed(text.astype(np.uint64) + np.uint64(1)))


def _lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first_word: np.ndarray):
    """(text, first byte, end byte, first word, end word) of every line that has a word."""
    begin, end, bounds = scan.runs(data, offsets, data != 0x0A)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    full = b > a
    return text[full], begin[full], end[full], a[full], b[full]


def _line_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the words a .. b of every line."""
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * scan.powers(scan.BASE, len(words)), out=prefix[1:])
    return scan.span_hashes(prefix, a, b)


def _normalised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = scan.run_hashes(data, starts, ends)
    return tuple(_line_hashes(w, a, b).view(np.int64) for w in (words, scan.mixed(words ^ SECOND)))


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], tuple]:
    """(one array for each of COUNTS, (lines per text, h1, h2, words) of the distinct lines)."""
    n = len(offsets) - 1
    starts, ends, first = scan.runs(data, offsets, ~scan.SPACE[data])
    points = scan.code_points(data)
    n_words = np.diff(first)
    chars = _per_text(points[ends] - points[starts], first)
    symbols = _per_text(SYMBOL[data], offsets)

    exact = scan.prefix_sums(data, scan.EXACT)
    windows = scan.window_hashes(scan.span_hashes(exact, starts, ends), WINDOW)
    text = np.repeat(np.arange(n), n_words)
    at = np.flatnonzero(np.arange(len(windows)) + WINDOW <= first[1:][text[: len(windows)]])
    _, which, times = np.unique(_tagged(windows[at], text[at]), return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + WINDOW, -1)
    repeated = _per_text(np.cumsum(step)[:-1] > 0, first)

    of, begin, end, a, b = _lines(data, offsets, starts, first)
    raw = np.unique(_tagged(scan.span_hashes(exact, begin, end), of), return_index=True)[1]
    distinct = np.bincount(of[raw], minlength=n)
    n_dup = np.bincount(of, minlength=n) - distinct

    h1, h2 = _normalised(data, starts, ends, a, b)
    order = np.lexsort((h2, h1, of))
    of, h1, h2, size = of[order], h1[order], h2[order], (b - a)[order]
    fresh = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(of) else np.zeros(0, np.int64)
    size = np.add.reduceat(size, fresh) if len(fresh) else size
    return [n_words, chars, symbols, n_dup, repeated], (np.bincount(of[fresh], minlength=n), h1[fresh], h2[fresh], size)


def _profile_udf():
    line = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.int64())])
    kinds = ",".join(f"{c}:bigint" for c in COUNTS)

    @F.arrow_udf(f"struct<{kinds},lines:array<struct<h1:bigint,h2:bigint,words:bigint>>>")
    def profile(column: pa.Array) -> pa.Array:
        counts, lines, sizes = [[np.zeros(0, np.int64)] for _ in COUNTS], [[np.zeros(0, np.int64)] for _ in range(3)], [np.zeros(1, np.int64)]
        for _, data, offsets in scan.texts(column, 1 << 20):
            own, (n, *parts) = measure(data, offsets)
            for to, x in zip([*counts, *lines], [*own, *parts], strict=True):
                to.append(x)
            sizes.append(n)
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in lines], fields=list(line))
        held = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), rows)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in counts] + [held], [*COUNTS, "lines"])

    return profile.asNondeterministic()


def _cut_udf():
    @F.arrow_udf("string")
    def cut(column: pa.Array, gone: pa.Array) -> pa.Array:
        """The texts without the lines whose (h1, h2) are listed."""
        lists, out = gone.to_pylist(), []
        for i, data, offsets in scan.texts(column, 1 << 20):
            starts, ends, first = scan.runs(data, offsets, ~scan.SPACE[data])
            of, begin, end, a, b = _lines(data, offsets, starts, first)
            h1, h2 = _normalised(data, starts, ends, a, b)
            bounds, body = np.searchsorted(of, np.arange(len(offsets))), data.tobytes()
            for k in range(len(offsets) - 1):
                drop = {(x["h1"], x["h2"]) for x in lists[i + k] or ()}
                own = range(bounds[k], bounds[k + 1])
                spans = [(begin[j], end[j]) for j in own if (int(h1[j]), int(h2[j])) in drop]
                kept, at = [], offsets[k]
                for x, y in spans:
                    kept.append(body[at:x])
                    at = min(y + 1, offsets[k + 1])  # the line goes with the break behind it
                kept.append(body[at : offsets[k + 1]])
                whole = b"".join(kept)
                out.append((whole[:-1] if spans and spans[-1][1] == offsets[k + 1] and whole.endswith(b"\n") else whole).decode())
        return pa.array(out, pa.string())

    return cut.asNondeterministic()


def _host(col: Column) -> Column:
    return F.when(col.isNull(), 0).otherwise(F.xxhash64(col.cast("string")))


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One written row per document row: ``row``, ``doc``, ``host``, the text's identity, COUNTS, lines."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc")
    f1, f2 = fingerprint(F.col(text_col))
    seen = docs.select(doc, _host(F.col(host_col)).alias("host"), f1.alias("f1"), f2.alias("f2"), _profile_udf()(F.col(text_col)).alias("p"))
    return written(seen.select(F.monotonically_increasing_id().alias("row"), "doc", "host", "f1", "f2", "p.*"), "line-profiles")


def boilerplate(profile: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(host, h1, h2, n): the lines above their host's limit and the documents that hold them."""
    held = profile.select("host", "doc", F.explode("lines").alias("l")).select("host", "l.h1", "l.h2", "doc").distinct()
    groups = held.groupBy(*LINE).agg(F.count("*").alias("n")).filter(F.col("n") >= rules.min_docs)
    groups = written(groups, "line-groups")
    hosts = written(profile.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("n_docs")), "line-hosts")
    limited = lookup(groups, hosts, ["host"], "n_docs", ["n_docs"], total(hosts, "n_docs"))
    return written(limited.filter(F.col("n") * 100 > F.col("n_docs") * rules.max_share).select(*LINE, "n"), "line-boilerplate")


def removed_lines(profile: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(row, h1, h2, words): the lines to remove from each row, with all words that they hold there."""
    common = boilerplate(profile, rules)
    lines = profile.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*")
    near = maybe_in(lines, bitmap(common, LINE), [F.col(c) for c in LINE]).filter("__maybe").drop("__maybe")
    found = lookup(near, common.withColumn("hit", F.lit(1)), LINE, "n", ["hit"], total(common, "n"))
    return found.filter("hit = 1").select("row", "h1", "h2", "words")


def verdicts(profile: DataFrame, gone: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``profile`` with n_removed_words, base_failed and kept."""
    sums = gone.groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    joined = profile.drop("lines").join(sums, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeated * F.col("n_words"))
    depleted = (left < rules.min_left) | (100 * left < rules.min_left_share * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc, COUNTS, n_removed_words, base_failed, kept) per document row; a null id comes back as null."""
    profile = profiles(docs, id_col, text_col, host_col)
    found = verdicts(profile, removed_lines(profile, rules), rules)
    real = F.when(F.col("doc") != MIN_LONG, F.col("doc"))
    return found.select(real.alias("doc"), *COUNTS, "n_removed_words", "base_failed", "kept")


def clean(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept documents without their boilerplate lines, with the columns of ``docs``. Texts that lose
    nothing and stay are not moved: a bitmap tells them from the others."""
    profile = profiles(docs, id_col, text_col, host_col)
    gone = written(removed_lines(profile, rules), "line-removed")
    found = verdicts(profile, gone, rules).select("row", "doc", "host", "f1", "f2", "kept")
    lists = gone.groupBy("row").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    key = ["doc", "host", "f1", "f2"]
    touched = found.join(lists, "row", "left").filter(~F.col("kept") | F.col("gone").isNotNull()).dropDuplicates(key)
    touched = written(touched.select(*[F.col(c).alias(f"__lr_{c}") for c in key], F.col("kept").alias("__lr_kept"), F.col("gone").alias("__lr_gone")), "line-touched")
    names = [f"__lr_{c}" for c in key]
    f1, f2 = fingerprint(F.col(text_col))
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)), _host(F.col(host_col)), f1, f2]
    marked = maybe_in(docs, bitmap(touched, names), own)
    same = marked.filter(~F.col("__maybe")).select(*docs.columns)
    other = marked.filter("__maybe").select(*docs.columns, *[x.alias(f"__own_{c}") for x, c in zip(own, key, strict=True)])
    met = other.join(touched, [F.col(f"__own_{c}") == F.col(f"__lr_{c}") for c in key], "left").filter(F.coalesce("__lr_kept", F.lit(True)))
    text = F.when(F.col("__lr_gone").isNull(), F.col(text_col)).otherwise(_cut_udf()(F.col(text_col), F.col("__lr_gone")))
    met = met.withColumn("__lr_text", text).select(*[F.col("__lr_text").alias(c) if c == text_col else F.col(c) for c in docs.columns])
    return same.unionByName(met)
