"""Whole extraction jobs composed from the operators."""

from __future__ import annotations

import functools
import hashlib
import inspect

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import taxonomy
from fitweave.functions import text as T
from fitweave.functions import urls
from fitweave.operators import metadata, quality, seniority, structure
from fitweave.operators.skew import balanced_join, sized_join
from fitweave.session import materialize
from fitweave.sources import pages as P


def extract_jobs(texts: DataFrame) -> DataFrame:
    """Metadata, structure, seniority and role of ads; narrow, no shuffle.

    ``texts``: job_id, content, source_filename, source_url and any other columns.
    """
    jobs = structure.with_structure(metadata.with_metadata(texts))
    jobs = jobs.withColumn("seniority", seniority.seniority(F.col("content")))
    return jobs.withColumn("role", seniority.job_role(F.col("title"), F.col("content"))).withColumn(
        "requirements", seniority.ensure_seniority_requirement(F.col("requirements"), F.col("seniority"))
    )


HASH_KINDS = ("markdown", "raw")


def import_pages(pages: DataFrame, hash_kind: str = "markdown") -> DataFrame:
    """HTML pages to extracted jobs; insufficient pages keep their warnings only.

    ``hash_kind`` says what ``content_hash`` is of: the Markdown, as for fetched pages, or the raw bytes, as
    for uploads.  Copies across the two kinds do not meet, so one job table should keep to one kind.
    """
    if hash_kind not in HASH_KINDS:
        raise ValueError(f"hash_kind must be one of {HASH_KINDS}")
    cleaned = P.clean_pages(P.recognizable_html(pages)).withColumnRenamed("title", "page_title")
    gated = cleaned.withColumns(quality.quality_columns(F.col("plain_text"), F.col("page_title")))
    gated = gated.withColumn(
        "import_warnings",
        quality.with_missing_description(F.col("warnings"), F.col("related_removed"), F.col("sufficient")),
    )
    texts = gated.where("sufficient").select(
        F.col("page_id").alias("import_id"),
        (F.col("raw_hash") if hash_kind == "raw" else T.content_hash(F.col("markdown"))).alias("content_hash"),
        F.lit(hash_kind).alias("hash_kind"),
        F.col("markdown").alias("content"), F.col("url").alias("source_url"),
        F.lit(None).cast("string").alias("source_filename"), F.lit("url").alias("source_type"),
        F.lit("native_html").alias("retrieval_method"), F.lit(False).alias("replace_existing"),
        "page_title", "import_warnings",
    ).withColumn("job_id", F.col("import_id"))
    return extract_jobs(texts).withColumn("title", F.coalesce("title", "page_title"))


# all that an extraction depends on
INPUTS = ["content", "source_filename", "source_url"]


@functools.cache
def rule_version() -> str:
    """Digest of the code and word lists that extraction rests on; any change of them makes results stale."""
    sources = [inspect.getsource(m) for m in (vocab, T, taxonomy, urls, metadata, structure, seniority)]
    return hashlib.sha256("\0".join([*sources, inspect.getsource(extract_jobs)]).encode()).hexdigest()[:16]


def input_key() -> Column:
    """Digest of the inputs of an extraction; a null differs from an empty value."""
    return F.sha2(F.to_json(F.struct(*INPUTS)), 256)


def extract_incremental(texts: DataFrame, folder: str, batch_id: int, version: str | None = None) -> DataFrame:
    """``extract_jobs`` that computes only what no earlier batch has computed under the same rules.

    ``texts``: job_id (unique), the ``INPUTS`` and any other columns; a column with the name of an extracted field
    is replaced.  Adds ``fresh``: whether this batch extracted the row's text.  Results are kept by input key in
    ``folder``, a part per rule version and batch, so equal texts are extracted once and a repeated
    batch overwrites its own part.  Keys decide before any text moves: only texts that are extracted meet a join.
    """
    spark = texts.sparkSession
    version = version or rule_version()
    place = f"{folder}/version={version}"
    keys = materialize(texts.select("job_id", input_key().alias("_key")), "extraction-keys")
    fresh = keys.groupBy("_key").agg(F.min("job_id").alias("job_id"))
    try:
        known = spark.read.parquet(place).where(F.col("batch") < batch_id)
        fresh = fresh.join(known.select("_key"), "_key", "left_anti")
    except AnalysisException:  # nothing was extracted under these rules yet
        pass
    fresh = materialize(fresh, "fresh-keys")
    inputs = sized_join(texts.select("job_id", *INPUTS), fresh, ["job_id"], [*INPUTS[:1]])
    extracted = extract_jobs(inputs).drop("job_id", *INPUTS)
    extracted.write.mode("overwrite").parquet(f"{place}/batch={batch_id}")
    results = spark.read.schema(f"{_ddl(extracted)}, batch long").parquet(place).where(F.col("batch") <= batch_id)
    results = results.withColumn("fresh", F.col("batch") == batch_id).drop("batch")
    kept = [c for c in texts.columns if c not in results.columns]
    keyed = texts.select(*kept, input_key().alias("_key"))
    return balanced_join(keyed, results, ["_key"], ["job_id"], counted=keys.select("_key")).drop("_key")


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def reimport_incremental(stored: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """``reimport_jobs`` over kept results, with ``fresh`` for the rows whose text was extracted now."""
    return _reimported(extract_incremental(stored, folder, batch_id))


def reimport_jobs(stored: DataFrame) -> DataFrame:
    """Extraction repeated on stored text, keeping the job id."""
    return _reimported(extract_jobs(stored))


def _reimported(fresh: DataFrame) -> DataFrame:
    return fresh.withColumn(
        "import_warnings",
        quality.merged_warnings(F.col("import_warnings"), T.empty_words(), reimport=True),
    ).withColumn("status", F.lit("analyzing"))
