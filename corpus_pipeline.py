"""The training-text pipeline: five stages, each an operator of ``ledgerline.llm``.

Each stage is written as Parquet in the shared folder and read again before the next, so a lost executor
repeats part of one stage; what a stage read is deleted once its result is written. All but the last return the
columns of ``documents``; the last returns token ids.

Cases, in every stage: a null or empty text counts as empty; a null id is kept as any other row is; a very long text is
one row like any other; repeated rows share their fate, but of near copies only rows of the smallest id stay; ties are cut by
rule (equal keys stay together, the smallest id wins, overlapping secrets are one); extra columns pass through untouched
whatever their names, but for the last stage, which drops them; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.bpe import encode_documents
from ledgerline.llm.common import remove, shared_dir, table
from ledgerline.llm.decontaminate import drop_contaminated
from ledgerline.llm.quality import accept
from ledgerline.llm.secrets import redact
from ledgerline.llm.simhash import drop_near_copies


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accept(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest id stays."""
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids`` of every document."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

#: The classifier, the fingerprints and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
