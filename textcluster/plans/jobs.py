"""End-to-end clustering jobs.

One path serves every input size: records are read and parsed by Spark tasks, optionally staged
as Parquet parts, vectorised row-locally, clustered over vectors written to the shared checkpoint
folder, and the membership / keyword / collated tables are exported one folder each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as cn
from ..operators.counts import first_n, number_records
from ..operators import features as fe
from ..operators import minibatch as mb
from ..operators import models as md
from ..operators import parse as ps
from ..operators import report as rp
from ..operators import restarts as rs
from ..operators import vectors as vz
from ..sinks import export as ex
from ..session import materialize, scratch_path
from ..sinks import staged as sg
from ..sources.files import TEXT_EXTENSIONS, XML_EXTENSIONS, validate_file
from ..sources.text import read_text_records_by_lines
from ..sources.xml import read_xml_records

ALGORITHMS = ("kmeans", "kmeans_one_scan", "kmeans_pp", "minibatch")
IN_FORMATS = ("xml", "txt")


@dataclass
class JobConfig:
    """Defaults equal the reference settings (k 20, 30 iterations, 3 restarts, batch 50,000,
    20 keywords, tfidf with L1 rows)."""

    k: int = md.DEFAULT_K
    max_iter: int = md.DEFAULT_ITER
    n_init: int = md.DEFAULT_INIT
    batch_size: int = md.DEFAULT_BATCH
    n_terms: int = 20
    vectorizer: str = "tfidf"
    algorithm: str = "kmeans"
    gen_keywords: bool = True
    collate: bool = False
    base_url: str = rp.DEFAULT_SEARCH_URL
    out_format: str = "csv"
    require_title: bool = True
    seed: int = 1
    materialize: str = "checkpoint"
    num_docs: int = 0  # L1 / L2: keep only the first n records in read order (0 = all)
    hash_features: int = 1 << 20  # M2: width of hashing vectors
    count_terms_by: str = "grouping"  # F8: or "summary" (two passes, no shuffle of all distinct terms)
    max_no_improvement: int | None = 10  # M4: steps without a lower average inertia before the end (None: all epochs)
    reassignment_ratio: float = 0.01  # M4: share of the largest centre's members below which a centre restarts
    on_bad: str = "error"  # S5: "error" or "skip" for files with another extension
    parser: ps.RecordParser | None = None  # X1
    segment_sep: str = ps.SEGMENT_SEP
    content_segment: int = ps.CONTENT_SEGMENT
    title_segment: int = ps.TITLE_SEGMENT
    params: fe.TfidfParams = field(default_factory=fe.TfidfParams)

    def check(self) -> "JobConfig":
        fe.check_vectorizer(self.vectorizer)
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {ALGORITHMS}")
        if self.gen_keywords and self.vectorizer == "hashing":
            raise ValueError("keywords need the tfidf vocabulary; hashing vectors have none")
        if self.count_terms_by not in fe.COUNTED_BY:
            raise ValueError(f"count_terms_by must be one of {fe.COUNTED_BY}")
        if self.k < 1:
            raise ValueError("k must be positive")
        if self.num_docs < 0:
            raise ValueError("num_docs must be 0 (all) or positive")
        return self


@dataclass
class JobResult:
    membership: DataFrame
    keywords: DataFrame | None
    collated: DataFrame | None
    vectorizer: vz.Vectorizer
    runs: list
    vectors: DataFrame


def load_records(spark: SparkSession, source: str, in_format: str = "xml", cfg: JobConfig | None = None, single_file: bool = False) -> DataFrame:
    """P3 dispatch by format: ``(source_file, seq, title, content, permalink, reject_reason)`` of every
    record read, parsed once and written to the shared folder; ``seq`` is 0..n-1 in read order over
    all files."""
    cfg = cfg or JobConfig()
    if in_format not in IN_FORMATS:
        raise ValueError(f"input format must be one of {IN_FORMATS}")
    if single_file:
        validate_file(source, XML_EXTENSIONS if in_format == "xml" else TEXT_EXTENSIONS)
    keep = ("source_file", "block", "seq")
    if in_format == "xml":
        records = ps.apply_parser(read_xml_records(spark, source, on_bad=cfg.on_bad), cfg.parser)
        cleaned = cn.finalize(ps.parse_xml(records, keep=keep), cfg.require_title)
    else:
        records = read_text_records_by_lines(spark, source, on_bad=cfg.on_bad).withColumn("block", F.lit(0).cast("bigint"))
        parsed = ps.parse_text(
            ps.apply_parser(records, cfg.parser), sep=cfg.segment_sep, content_idx=cfg.content_segment, title_idx=cfg.title_segment, keep=keep
        )
        cleaned = cn.finalize(parsed, cfg.require_title, title_fallback=False)
    path = scratch_path(spark, "parsed")
    cleaned.drop("title_as_content").write.parquet(path)
    return number_records(spark.read.parquet(path))


def load_articles(
    spark: SparkSession,
    source: str,
    in_format: str = "xml",
    require_title: bool = True,
    staged_path: str | None = None,
    single_file: bool = False,
    cfg: JobConfig | None = None,
) -> DataFrame:
    """The valid records of ``load_records``: ``(source_file, seq, title, content, permalink)``.
    With ``staged_path``, records are staged once as Parquet parts and replayed afterwards (S7)."""
    cfg = cfg or JobConfig(require_title=require_title)
    build = lambda: cn.valid(load_records(spark, source, in_format, cfg, single_file))
    return sg.load_or_stage(spark, staged_path, build) if staged_path else build()


def ingest_directory(spark: SparkSession, source: str, out: str, in_format: str = "xml", cfg: JobConfig | None = None) -> DataFrame:
    """S4 + K2: every file of a directory parsed and staged in its own folder; returns the A7 counts."""
    records = load_records(spark, source, in_format, cfg)
    sg.write_per_source(cn.valid(records), out)
    return cn.ingest_counts(records)


def features_saved(spark: SparkSession, features_path: str | None) -> bool:
    """A saved vectorizer and its vectors are present."""
    return bool(features_path) and sg.staged_exists(spark, f"{features_path}/model/metadata") and sg.staged_exists(spark, f"{features_path}/vectors")


def cluster_articles(
    spark: SparkSession, arts: DataFrame | Callable[[], DataFrame], cfg: JobConfig, features_path: str | None = None
) -> JobResult:
    """Vectorise (or reuse saved vectors, K3 / S8: then ``arts`` is not needed), cluster, label
    every record, and build keywords and collated URLs when asked."""
    cfg.check()
    keep = ("doc_id", "seq", "permalink")
    if features_saved(spark, features_path):
        vec = vz.Vectorizer.load(f"{features_path}/model", cfg.params)
        vectors = spark.read.parquet(f"{features_path}/vectors").persist(StorageLevel.MEMORY_AND_DISK)
    else:
        arts = arts() if callable(arts) else arts
        arts = arts.withColumn("doc_id", F.col("seq")) if "doc_id" not in arts.columns else arts
        counts = None
        if cfg.vectorizer == "hashing":  # the fit and the vectors are made of the same counts: texts are read once
            counts = vz.hashed_counts(arts, cfg.params, cfg.hash_features, keep).persist(StorageLevel.MEMORY_AND_DISK)
        vec = vz.fit_vectorizer(arts, cfg.vectorizer, cfg.params, cfg.hash_features, cfg.count_terms_by, counts=counts)
        vectors = vec.transform(arts, keep=keep) if counts is None else vec.transform_counts(counts, keep)
        if features_path:
            vec.save(f"{features_path}/model")
            vz.write_features(vectors, f"{features_path}/vectors")
            vectors = spark.read.parquet(f"{features_path}/vectors").persist(StorageLevel.MEMORY_AND_DISK)
        else:  # restarts and batch steps re-read vectors, never re-tokenise
            vectors = materialize(vectors, cfg.materialize)
        if counts is not None:
            vectors.count()  # the vectors are held now
            counts.unpersist()
    runs: list = []
    try:
        if cfg.algorithm in ("kmeans", "kmeans_pp"):
            n_init = cfg.n_init if cfg.algorithm == "kmeans" else 1
            model, runs = md.kmeans_restarts(vectors, cfg.k, n_init, cfg.max_iter, cfg.seed)
            centres = md.centers_of(model)
            membership = md.assign_model(model, vectors, keep=("doc_id", "seq", "permalink"))
        elif cfg.algorithm == "kmeans_one_scan":
            fitted = rs.fit(vectors, cfg.k, cfg.n_init, cfg.max_iter, cfg.seed)
            centres, runs = fitted.centres, fitted.costs
            membership = md.assign_with_centres(spark, vectors, centres, keep=("doc_id", "seq", "permalink")).drop("dist2")
        else:
            res = mb.fit(
                vectors, cfg.k, cfg.batch_size, cfg.max_iter, cfg.n_init, cfg.seed,
                max_no_improvement=cfg.max_no_improvement, reassignment_ratio=cfg.reassignment_ratio,
            )
            runs = res.init_costs
            membership = mb.assign(vectors, res.centres, keep=("doc_id", "seq", "permalink")).drop("dist2")
        keywords = None
        if cfg.gen_keywords:
            vocab = vec.vocabulary_df(spark)
            if cfg.algorithm == "minibatch":
                cents = res.centres.weights().join(F.broadcast(vocab), "term_idx").select("cluster_id", "term", "weight")
            else:
                cents = md.centroid_terms(spark, centres, vocab)
            clusters = spark.range(cfg.k).select(F.col("id").cast("int").alias("cluster_id"))
            keywords = rp.top_terms(cents, cfg.n_terms, "cluster_id", clusters=clusters, vocab=vocab)
        collated = rp.collate(membership, cfg.k, cfg.base_url) if cfg.collate else None
    except Exception:
        vectors.unpersist()
        raise
    return JobResult(membership, keywords, collated, vec, runs, vectors)


def export(result: JobResult, out_root: str, cfg: JobConfig) -> dict[str, str]:
    """K8 + K7: ``clusters`` (membership or collated) and ``cluster_keywords`` folders."""
    members = result.membership.select("cluster_id", "permalink")
    tables = ex.assemble_output(members, result.keywords, cfg.gen_keywords, result.collated)
    return ex.export_tables(out_root, tables, cfg.out_format)


def run(
    spark: SparkSession,
    source: str,
    out_root: str,
    in_format: str = "xml",
    cfg: JobConfig | None = None,
    staged_path: str | None = None,
    features_path: str | None = None,
) -> dict[str, str]:
    """The whole job: load, cluster, export. Returns the exported folders by table name. Unless the
    records or their vectors are reused, ``rejected`` (F9) and ``ingest_counts`` (A7) are exported too."""
    cfg = (cfg or JobConfig()).check()
    extra: dict[str, DataFrame] = {}

    def articles() -> DataFrame:
        if staged_path and sg.staged_exists(spark, staged_path):
            arts = sg.read_staged(spark, staged_path)
        else:
            records = load_records(spark, source, in_format, cfg)
            extra.update(rejected=cn.rejected(records), ingest_counts=cn.ingest_counts(records))
            arts = cn.valid(records)
            if staged_path:
                arts = sg.load_or_stage(spark, staged_path, lambda: cn.valid(records))
        if cfg.num_docs > 0:
            arts = first_n(arts, cfg.num_docs, *(["part", "seq"] if "part" in arts.columns else ["seq"]))
        return arts

    result = cluster_articles(spark, articles, cfg, features_path)
    try:
        paths = export(result, out_root, cfg)
    finally:
        result.vectors.unpersist()
    return paths | ex.export_tables(out_root, extra, cfg.out_format)
