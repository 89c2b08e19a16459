"""The registered ``opN_<name>`` queries and their SQL. Each applies its operator, with production
parameters, to the whole of its table and derives the contract's columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, decontaminate, jaccard, lexical, line_dedup, line_rules, pieces, pii, prefix_trie, quality, topk, toxicity, warc
from .common import table, written
from .labelled import fold


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as gzip streams, normalised to one member per record and read back by offset."""
    index, base = warc.archive_pages(table(spark, sf_dir, "pages"))
    found = warc.read_archives(index, base)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept text digest per document after line deduplication."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.col("__ld_lines").alias("n_lines"), F.col("__ld_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("__ld_kept", F.lit("")), 256).alias("kept_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.score_column(spark, model, F.col("text")).alias("found"))
    score = F.col("found.score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document, with the terms that reveal them."""
    marked = pii.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("__pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("__pii", lambda s: s["kind"].isin(*pii.KINDS))
    return marked.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__pii")).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality probability of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.score_column(spark, model, F.col("text")).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document under merge-dropout, and whether they decode to its text."""
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.load(), seed=7, rate=0.1)
    return encoded.select("doc_id", "n_pieces", F.col("piece_ids").alias("ids"), "round_trip")


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that repeats one of a document with a smaller id, with that document."""
    found = chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "start", "end", "n_chunks", F.col("kept_in").alias("kept_doc_id"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("__dc_items", lambda i: i.cast("string")))
    return marked.select(
        "doc_id", F.col("__dc_n_words").alias("n_words"), F.col("__dc_n_hit").alias("n_hit"),
        F.size("__dc_items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("__dc_n_hit") > 0).alias("contaminated"),
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 3-word shingles and a similarity of 0.9 or more."""
    found = jaccard.components_of(table(spark, sf_dir, "documents"), jaccard.Similarity(k=3, num=90, den=100))
    return found.select(F.col("doc").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document, with the lines that are frequent on its source."""
    found = line_rules.judge(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), *line_rules.COUNTS, "base_failed", "kept")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie over the conversations, rebuilt with shared openings."""
    own = written(prefix_trie.sequences(table(spark, sf_dir, "conversations")), "trie-sequences")
    conv, most = F.col("conv_id"), 5
    head = (F.crc32(conv.cast("string")) % (most + 1)).cast("int")
    return prefix_trie.trie(prefix_trie.rebuilt(own, conv - conv % 100, head, most))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents with the highest scores for every benchmark item."""
    found = lexical.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


OPERATORS = (
    op1_warc, op2_line_dedup, op3_toxicity, op4_exact_topk, op5_pii, op6_quality, op7_pieces, op8_chunk_dedup,
    op9_decontamination, op10_ngram_jaccard, op11_line_rules, op12_prefix_trie, op13_lexical_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}
