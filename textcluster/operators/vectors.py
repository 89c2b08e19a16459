"""Document vectors for the clustering models (M1 ML form, M2, M9, M10, K3, S8).

Fitting needs one pass with a partial aggregation by term, and no exchange of text (the
vocabulary, at most ``max_features`` terms, and their idf); transforming is row-local: Spark ML stages look each token up in a
broadcast vocabulary, scale by the broadcast idf vector and normalise, with no shuffle at all.

  tfidf   : CountVectorizerModel(vocabulary) -> ElementwiseProduct(idf + 1) -> Normalizer(p)
  hashing : signed counts by MD5 over 2^20 buckets, divided by their norm (``hashing``) ->
            ElementwiseProduct(idf + 1) -> Normalizer(p). There is no vocabulary, so no keywords.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame

from . import features as fe
from . import hashing as hs
from .hashing import HASH_FEATURES
from .heavy import frequent_term_stats
from .tokens import add_tokens, term_stats_from_docs


def _p(norm: str) -> float:
    return {"l1": 1.0, "l2": 2.0}[norm]


@dataclass
class Vectorizer:
    """A fitted vectorizer: a Spark ``PipelineModel`` over the token column, plus the vocabulary
    (empty for hashing)."""

    kind: str
    pipeline: PipelineModel
    vocabulary: list[str]
    params: fe.TfidfParams

    def transform(self, df: DataFrame, text_col: str = "content", keep=("doc_id", "permalink")) -> DataFrame:
        cols = [c for c in keep if c in df.columns]
        if self.kind == "hashing":
            return self.transform_counts(hashed_counts(df, self.params, self.width, cols, text_col), cols)
        tok = add_tokens(df.select(*cols, text_col), text_col, "tokens", self.params.stop_words)
        return self.pipeline.transform(tok).select(*cols, "features")

    def transform_counts(self, counts: DataFrame, keep=("doc_id", "permalink")) -> DataFrame:
        """Hashing vectors of documents whose ``hashed_counts`` are made already."""
        return self.pipeline.transform(counts).select(*[c for c in keep if c in counts.columns], "features")

    @property
    def width(self) -> int:
        """Entries of a vector."""
        return len(self.vocabulary) if self.kind == "tfidf" else self.pipeline.stages[0].getScalingVec().size

    def vocabulary_df(self, spark) -> DataFrame:
        """``(term_idx, term)``."""
        if not self.vocabulary:
            raise ValueError("hashing vectors have no vocabulary; keywords need the tfidf vectorizer")
        return spark.createDataFrame(list(enumerate(self.vocabulary)), "term_idx bigint, term string")

    def save(self, path: str) -> None:
        """K3: the fitted pipeline (vocabulary and idf included)."""
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, params: fe.TfidfParams = fe.TfidfParams()) -> "Vectorizer":
        """Reuse a saved vectorizer."""
        pm = PipelineModel.load(path)
        first = pm.stages[0]
        vocab = list(first.vocabulary) if isinstance(first, CountVectorizerModel) else []
        return cls("tfidf" if vocab else "hashing", pm, vocab, params)


def corpus_stats(docs: DataFrame, params: fe.TfidfParams, text_col: str = "content", by: str = "grouping") -> DataFrame:
    """``(term, df, cf)`` for a vocabulary: ``by`` a grouping over all terms (one pass), or by a
    ``summary`` of the frequent terms (two passes, shuffles bounded by its counters)."""
    if by not in fe.COUNTED_BY:
        raise ValueError(f"terms are counted by one of {fe.COUNTED_BY}, got {by!r}")
    if by == "summary":
        return frequent_term_stats(docs, params, text_col)
    return term_stats_from_docs(docs, text_col, params.stop_words)


def fit_tfidf(
    docs: DataFrame,
    params: fe.TfidfParams = fe.TfidfParams(),
    id_col="doc_id",
    text_col="content",
    by: str = "grouping",
    stats: DataFrame | None = None,
) -> Vectorizer:
    """M1 fit: relational vocabulary and idf (bounded by ``max_features``) into ML stages. ``stats`` are
    the ``corpus_stats`` of ``docs`` where a caller has them already."""
    # Corpus statistics come straight from the documents: no text is shuffled to fit.
    stats = corpus_stats(docs, params, text_col, by) if stats is None else stats
    n = fe.doc_count(docs)
    idf = fe.idf_table(fe.vocabulary_from_stats(stats, n, params), n)
    rows = idf.orderBy("term_idx").select("term", "idf").collect()  # <= max_features rows
    vocab = [r["term"] for r in rows]
    stages = [
        CountVectorizerModel.from_vocabulary(vocab, inputCol="tokens", outputCol="tf"),
        ElementwiseProduct(scalingVec=DenseVector([r["idf"] for r in rows]), inputCol="tf", outputCol="w"),
        Normalizer(p=_p(params.norm), inputCol="w", outputCol="features"),
    ]
    return Vectorizer("tfidf", PipelineModel(stages), vocab, params)


def hashed_counts(
    docs: DataFrame, params: fe.TfidfParams = fe.TfidfParams(), num_features: int = HASH_FEATURES, keep=("doc_id", "permalink"), text_col="content"
) -> DataFrame:
    """M2: the ``keep`` columns and the signed hashed ``counts``, normalised, that a fit and the vectors are made of."""
    return hs.signed_counts(docs, num_features, params.norm, keep, text_col, params.stop_words, "counts")


def fit_hashing(
    docs: DataFrame, params: fe.TfidfParams = fe.TfidfParams(), num_features: int = HASH_FEATURES, text_col="content", counts: DataFrame | None = None
) -> Vectorizer:
    """M2 fit: signed hashed counts, normalised, and the idf (+1) of their buckets from one pass. ``counts``
    are the ``hashed_counts`` of ``docs`` where a caller has them already."""
    counts = hashed_counts(docs, params, num_features, (), text_col) if counts is None else counts
    return hashing_vectorizer(hs.idf_of(hs.bucket_df(counts, num_features, "counts"), num_features), params)


def hashing_vectorizer(idf, params: fe.TfidfParams = fe.TfidfParams()) -> Vectorizer:
    """M2 from the idf of every bucket (its length is the width), e.g. one read from a stream's state."""
    return Vectorizer("hashing", PipelineModel(idf_stages(idf, params.norm, "counts")), [], params)


def idf_stages(idf, norm: str, in_col: str, out_col: str = "features") -> list:
    """Scale normalised counts by the idf, then normalise again."""
    scaled = ElementwiseProduct(scalingVec=DenseVector(idf), inputCol=in_col, outputCol="w")
    return [scaled, Normalizer(p=_p(norm), inputCol="w", outputCol=out_col)]


def fit_vectorizer(
    docs: DataFrame,
    kind: str = "tfidf",
    params: fe.TfidfParams = fe.TfidfParams(),
    num_features: int = HASH_FEATURES,
    by: str = "grouping",
    stats: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> Vectorizer:
    """M9: choose the vectorizer; anything but tfidf / hashing is an error."""
    fe.check_vectorizer(kind)
    return fit_tfidf(docs, params, by=by, stats=stats) if kind == "tfidf" else fit_hashing(docs, params, num_features, counts=counts)


def tfidf_rows(vec: Vectorizer, docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """M1 (long form): ``(id_col, term_idx, term, tf, weight)`` of the non-zero vector entries, read
    off each row's vectors: no exchange of text or term rows. The vocabulary (at most
    ``max_features`` terms) travels with the tasks."""
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()
    tok = add_tokens(docs.select(id_col, text_col), text_col, "tokens", vec.params.stop_words)
    terms = docs.sparkSession.sparkContext.broadcast(vec.vocabulary)

    def run(batches):
        from .models import flatten_vectors, in_slices, vector_sizes

        vocabulary = pa.array(terms.value, pa.string())
        for b in in_slices(batches, vector_sizes()):
            _, rows, idx, weight = flatten_vectors(b.column("features"))
            tf = flatten_vectors(b.column("tf"))[3]
            cols = [b.column(id_col).take(pa.array(rows)), pa.array(idx.astype("int64")), vocabulary.take(pa.array(idx)), pa.array(tf.astype("int64")), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "term_idx", "term", "tf", "weight"])

    return vec.pipeline.transform(tok).select(id_col, "tf", "features").mapInArrow(
        run, f"{id_col} {id_type}, term_idx bigint, term string, tf bigint, weight double"
    )


def counts_pipeline(vec: Vectorizer) -> PipelineModel:
    """Raw term counts over the same vocabulary (the LDA input)."""
    if not vec.vocabulary:
        raise ValueError("LDA needs the tfidf vocabulary")
    return PipelineModel([CountVectorizerModel.from_vocabulary(vec.vocabulary, inputCol="tokens", outputCol="features")])


def write_features(vectors: DataFrame, path: str) -> None:
    """K3: vectors with their ids as Parquet (reloadable, S8)."""
    vectors.write.mode("overwrite").parquet(path)


def _stats_fn(id_col: str, features_col: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .models import flatten_vectors

        for b in batches:
            n, rows, _, val = flatten_vectors(b.column(features_col))
            nnz = np.bincount(rows, weights=(val != 0).astype(float), minlength=n).astype(np.int64)
            l1 = np.bincount(rows, weights=np.abs(val), minlength=n)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(nnz), pa.array(l1)], names=[id_col, "n_buckets", "l1"])

    return run


def vector_stats(vectors: DataFrame, id_col: str = "doc_id", features_col: str = "features") -> DataFrame:
    """``(id, n_buckets, l1)`` read from the sparse form (no densifying of wide vectors)."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, features_col).mapInArrow(
        _stats_fn(id_col, features_col), f"{id_col} {id_type}, n_buckets bigint, l1 double"
    )
