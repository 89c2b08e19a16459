"""Structured Streaming forms.

Every query is checkpointed under the shared folder and can run with ``availableNow`` (drain what
is there, then stop) or a processing-time trigger. Sinks are idempotent per micro-batch: a batch
that is replayed after a failure overwrites its own output instead of appending twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean as cn
from ..operators import hashing as hs
from ..operators import minibatch as mb
from ..operators import models as md
from ..operators import parse as ps
from ..operators import vectors as vz
from ..sinks.staged import staged_exists
from ..sources.files import TEXT_EXTENSIONS, XML_EXTENSIONS, with_source
from ..sources.xml import cut_records

STAGED_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("permalink", T.StringType()),
        T.StructField("part", T.LongType()),
    ]
)


def replay(spark: SparkSession, staged_path: str, schema: T.StructType = STAGED_SCHEMA, files_per_batch: int = 1) -> DataFrame:
    """Staged Parquet parts as a stream, ``files_per_batch`` files per micro-batch (bounded
    memory, oldest first)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(staged_path)


def drain(stream: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Run ``stream`` with ``availableNow`` into a file sink (exactly-once through the checkpoint)."""
    q = (
        stream.writeStream.format(fmt)
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def xml_file_stream(spark: SparkSession, in_dir: str, record_tag: str = ps.RECORD_TAG, files_per_batch: int = 1) -> DataFrame:
    """S1 as a stream: raw records of arriving XML files."""
    raw = (
        spark.readStream.option("lineSep", f"</{record_tag}>")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(in_dir)
    )
    return cut_records(with_source(raw.select("value", "_metadata"), XML_EXTENSIONS).drop("_metadata"), record_tag)


def text_file_stream(spark: SparkSession, in_dir: str, files_per_batch: int = 1) -> DataFrame:
    """S3 as a stream: records of arriving delimited text files (each file read whole)."""
    from ..sources.text import split_records

    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(in_dir, wholetext=True)
    return with_source(raw.select("value", "_metadata"), TEXT_EXTENSIONS).select(
        "source_file",
        F.posexplode(split_records(F.col("value"))).alias("pos", "record"),
    )


def stage_arriving(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    require_title: bool = True,
    files_per_batch: int = 1,
    in_format: str = "xml",
) -> None:
    """Parse each micro-batch of arriving XML (or delimited text) files and stage the valid
    records as Parquet, one folder per batch id (a replayed batch overwrites its folder). Rejected
    records go the same way to ``<out_dir>_rejected``, with their reason. (batch_id, seq) is unique."""
    if in_format not in ("xml", "txt"):
        raise ValueError("in_format must be 'xml' or 'txt'")
    stream = (
        xml_file_stream(spark, in_dir, files_per_batch=files_per_batch)
        if in_format == "xml"
        else text_file_stream(spark, in_dir, files_per_batch)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        recs = batch.withColumn("seq", F.monotonically_increasing_id())
        if in_format == "xml":
            cleaned = cn.finalize(ps.parse_xml(recs), require_title)
        else:
            cleaned = cn.finalize(ps.parse_text(recs), require_title, title_fallback=False)
        cleaned = cleaned.drop("title_as_content").persist()  # parsed once for both outputs
        try:
            cn.valid(cleaned).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
            cn.rejected(cleaned).write.mode("overwrite").parquet(f"{out_dir}_rejected/batch_id={batch_id}")
        finally:
            cleaned.unpersist()

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def hash_stream(articles_stream: DataFrame, width: int = hs.HASH_FEATURES, norm: str = "l1", keep=("doc_id", "permalink")) -> DataFrame:
    """The signed hashed counts of streamed documents, with no state and no fit."""
    return hs.signed_counts(articles_stream, width, norm, keep)


def hash_arriving(
    articles_stream: DataFrame,
    state_dir: str,
    checkpoint: str,
    width: int = hs.HASH_FEATURES,
    norm: str = "l1",
    keep=("doc_id", "permalink"),
    stop_words=None,
) -> None:
    """Every micro-batch's signed hashed counts, and the document frequency of every bucket over all
    batches so far (the state: at most ``width`` + 1 rows), each one folder per batch id. A replayed batch
    starts from the state before it and overwrites its own folders, so nothing counts twice."""
    stream = hs.signed_counts(articles_stream, width, norm, keep, stop_words=stop_words)

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = _part(state_dir, "counts", batch_id)
        batch.write.mode("overwrite").parquet(counts)
        df = hs.bucket_df(spark.read.parquet(counts), width)
        if batch_id:
            df = hs.add_df(spark.read.schema(hs.DF_TABLE).parquet(_part(state_dir, "df", batch_id - 1)), df)
        df.write.mode("overwrite").parquet(_part(state_dir, "df", batch_id))

    q = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def last_batch(spark: SparkSession, state_dir: str) -> int:
    """The last batch whose document frequencies are written."""
    done = 0
    while staged_exists(spark, _part(state_dir, "df", done)):
        done += 1
    if not done:
        raise ValueError(f"no batch is written in {state_dir}")
    return done - 1


def idf_after(spark: SparkSession, state_dir: str, batch_id: int | None = None, width: int = hs.HASH_FEATURES):
    """The idf (+1) of every bucket as of a batch (default: the last), read from the state: equal to a fit
    over the documents of batches 0..``batch_id``."""
    at = last_batch(spark, state_dir) if batch_id is None else batch_id
    return hs.idf_of(spark.read.parquet(_part(state_dir, "df", at)), width)


def finish_hashing(
    spark: SparkSession, state_dir: str, batch_id: int | None = None, norm: str = "l1", width: int = hs.HASH_FEATURES
) -> DataFrame:
    """The vectors of batches 0..``batch_id`` (default: the last) under the idf of that batch's state: the
    batch hashing vectors of those documents, without a pass to fit."""
    from pyspark.ml import PipelineModel

    at = last_batch(spark, state_dir) if batch_id is None else batch_id
    counts = spark.read.parquet(*[_part(state_dir, "counts", i) for i in range(at + 1)])
    stages = PipelineModel(vz.idf_stages(idf_after(spark, state_dir, at, width), norm, "features", "scaled"))
    return stages.transform(counts).drop("features", "w").withColumnRenamed("scaled", "features")


def _part(state_dir: str, kind: str, batch_id: int) -> str:
    return f"{state_dir}/{kind}/batch_id={batch_id:012d}"


def centres_after(spark: SparkSession, state_dir: str, batch_id: int, k: int = md.DEFAULT_K) -> mb.Centres:
    """The centres as they were after a batch."""
    return mb.load(spark.read.schema(mb.TABLE).parquet(_part(state_dir, "centres", batch_id)), k)


def minibatch_stream(
    spark: SparkSession,
    vectors_stream: DataFrame,
    state_dir: str,
    checkpoint: str,
    k: int = md.DEFAULT_K,
    seed: int = 1,
    n_init: int = md.DEFAULT_INIT,
    init_size: int = 3 * md.DEFAULT_BATCH,
    id_col: str = "doc_id",
    keep=("doc_id", "permalink"),
) -> None:
    """T4: one mini-batch k-means step per micro-batch, and its documents labelled.

    State is written per batch id: ``waiting`` (vectors of the batches before there are centres),
    ``centres`` (the table of sums after the batch) and ``members`` (``keep``, cluster_id, dist2 and
    centres_batch, the batch whose centres labelled the document), the last of which marks the batch
    as applied. Vectors wait until ``k`` distinct ones have come; then they seed the centres, are
    folded in and labelled together. A replayed batch finds the state before it unchanged and
    writes the same again; an applied one is skipped."""
    schema = T.StructType([vectors_stream.schema[c] for c in keep])
    names = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, cluster_id int, dist2 double, centres_batch bigint"

    def label(rows: DataFrame, centres: mb.Centres, batch_id: int) -> None:
        found = mb.assign(rows, centres, keep, id_col).withColumn("centres_batch", F.lit(batch_id).cast("bigint"))
        found.write.mode("overwrite").parquet(_part(state_dir, "members", batch_id))

    def step(batch: DataFrame, batch_id: int) -> None:
        if staged_exists(spark, _part(state_dir, "members", batch_id)):
            return  # already applied
        own = _part(state_dir, "centres", batch_id)
        if batch_id > 0 and staged_exists(spark, _part(state_dir, "centres", batch_id - 1)):  # batch ids are consecutive
            rows = batch.persist()
            try:
                label(rows, mb.fold(rows, centres_after(spark, state_dir, batch_id - 1, k), own, id_col, keep=True), batch_id)
            finally:
                rows.unpersist()
            return
        batch.write.mode("overwrite").parquet(_part(state_dir, "waiting", batch_id))
        rows = spark.read.schema(batch.schema).parquet(*[_part(state_dir, "waiting", b) for b in range(batch_id + 1)])
        if rows.select(F.xxhash64("features").alias("h")).distinct().limit(k).count() < k:
            spark.createDataFrame([], names).write.mode("overwrite").parquet(_part(state_dir, "members", batch_id))
            return
        centres, _ = mb.seed_centres(rows, k, n_init, seed, init_size, _part(state_dir, "seed", batch_id), id_col)
        label(rows, mb.fold(rows, centres, own, id_col, keep=True), batch_id)

    q = vectors_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
    q.awaitTermination()


def streamed_members(spark: SparkSession, state_dir: str) -> DataFrame:
    """Every labelled document of the stream so far, once."""
    return spark.read.parquet(f"{state_dir}/members").drop("batch_id")


def final_centres(spark: SparkSession, state_dir: str, k: int = md.DEFAULT_K) -> mb.Centres:
    """Centres after the last applied batch."""
    last = spark.read.schema(mb.TABLE + ", batch_id bigint").parquet(f"{state_dir}/centres").agg(F.max("batch_id")).first()[0]
    if last is None:
        raise ValueError("no batch has been applied")
    return centres_after(spark, state_dir, int(last), k)
