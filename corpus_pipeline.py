"""From raw documents to packed training sequences: five stages over the operators of stridegrid.llm."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridegrid.llm.common import shared_path, small, staged
from stridegrid.llm.decontaminate import decontaminate, judged
from stridegrid.llm.jaccard_join import jaccard_components
from stridegrid.llm.packing import pack
from stridegrid.llm.queries import TOKENIZER
from stridegrid.llm.suffix_repeats import remove_repeats
from stridegrid.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _told(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_tid``, the fingerprint of the text: decisions on texts follow it, whatever the doc_id."""
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_tid"))


def _worded() -> Column:
    return F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _without(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``rejected``."""
    return docs.join(small(staged(rejected.select(key).distinct(), "rejected")), key, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels of all folds, does not call toxic.

    A text decides for all its rows, also without doc_id, and for no other text
    of its id. Null texts and texts of white space hold nothing toxic and stay;
    an empty table gives an empty one; columns beyond those of documents go.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    docs = _told(docs)
    found = score_toxicity(docs.where(_worded()), model, key="_tid").where("toxic")
    return _without(docs, found, "_tid").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id, one row of it.

    A row is told by doc_id and text: of texts that share an id only those go
    that repeat others, and rows without doc_id take part behind all others.
    Texts without words, null ones too, are no duplicates of anything and stay;
    columns beyond those of documents go.
    """
    row = F.struct(
        F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), F.col("_tid").alias("tid")
    )
    docs = _told(docs).withColumn("_row", row)
    found = jaccard_components(docs, key="_row")
    kept = _without(docs, found.where("n_shingles > 0 AND component_id <> _row"), "_row")
    twice = kept.where(_worded()).groupBy("_row").agg(F.count("*").alias("n"))
    twice = small(staged(twice.where("n > 1").select("_row"), "repeated-rows"))
    # of rows that repeat id and text one stays; only such rows are compared
    again = kept.join(twice, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.join(twice, "_row", "left_anti").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that occur more than once among them.

    Characters of which only a part of the bytes repeats are kept whole, and
    n_chars follows the text. A document of which nothing is left goes. Null
    and empty texts stay; rows that share a text lose the same passages;
    columns beyond those of documents go.
    """
    marked = _told(docs)
    found = remove_repeats(marked.select(F.col("_tid").alias("key"), "text"), key="key").where("n_removed > 0")
    # spans belong to a text: copies share them
    spans = staged(found.groupBy("key").agg(F.first("spans").alias("spans")), "passages")
    rest = [c for c in COLUMNS if c != "text"]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, runs in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                texts.append(body if runs is None else without_spans(body, [(r["start"], r["end"]) for r in runs]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), batch.column("changed"), *(batch.column(c) for c in rest)],
                names=["text", "changed", *rest],
            )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    joined = marked.join(small(spans, 200_000), F.col("_tid") == F.col("key"), "left")
    joined = joined.select("text", "spans", F.col("spans").isNotNull().alias("changed"), *rest)
    out = joined.mapInArrow(rewrite, ", ".join(["text string", "changed boolean", *(f"{c} {kinds[c]}" for c in rest)]))
    length = F.when(F.col("changed"), F.char_length("text").cast(kinds["n_chars"])).otherwise(F.col("n_chars"))
    return out.where("NOT changed OR text <> ''").withColumn("n_chars", length).select(*COLUMNS)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without spans of its UTF-8 bytes; characters only partly in a span stay."""
    data = text.encode("utf-8", "surrogatepass")
    at, parts = 0, []
    for start, end in spans:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while start < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows of 13 words.

    A text decides for all its rows, also without doc_id. Null and empty texts
    have no words and stay; columns beyond those of documents go.
    """
    docs = _told(docs)
    found = judged(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_tid"))
    return _without(docs, found.where("contaminated"), "_tid").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens with the sources mixed by their shares: a row per piece.

    Null texts are packed as empty ones, repeated rows each; no rows give no pieces.
    """
    return pack(docs, TOKENIZER).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: The model of the first stage and the tokenizer of the last have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
