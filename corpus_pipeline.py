"""Corpus pipeline: filters and encodes ``documents`` in stages, each written as Parquet and read again by the next.

Quality classifier, toxicity, n-gram Jaccard join (five words, 0.8: one document of each group stays), benchmark
decontamination, SentencePiece encoding with merge-dropout. Filtering stages return the columns of ``documents``; the last
one returns doc_id, n_pieces, ids_crc32 and restored. Nulls, empty tables and repeated rows are handled as each operator
documents; rows without id are never near-duplicates of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table, written
from lodestone.llm.decontam import drop_contaminated
from lodestone.llm.jaccard_join import one_of_each
from lodestone.llm.merge_dropout import encode_stage
from lodestone.llm.quality import filter_quality
from lodestone.llm.toxicity import filter_toxic

STAGES = [
    ("quality", filter_quality),
    ("toxicity", filter_toxic),
    ("jaccard_join", one_of_each),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_stage),
]
#: Classifiers and BPE merges aren't SQL; tests hold the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table ``documents``; every stage's rows go through a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}-{name}")
    return docs
