"""From raw documents to pieces: five stages, each a whole operator, each written and read again by its caller.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of documents; the last one
adds what it has encoded. An empty or null text passes the stages as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfield.llm.common import stored, table
from nearfield.llm.decontaminate import remove_contamination
from nearfield.llm.line_dedup import without_boilerplate
from nearfield.llm.near_dedup import keep_one
from nearfield.llm.quality import keep_good
from nearfield.llm.sentencepiece_nbest import Vocabulary, encode
from nearfield.shared import remove, written


#: Limit of the near-dedup stage on five-word shingles, in hundredths.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all but their first document; n_chars follows the text."""
    return without_boilerplate(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; groups are linked from NEAR hundredths of the union upwards."""
    return keep_one(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents lose the benchmark's passages, or go where these are most of them."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, and how its best segmentations differ."""
    out = encode(docs.select("doc_id", "lang", "source", "text"), Vocabulary.load())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", "n_best", "exact")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: None: suffix automata, signatures and segmentations are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again, and what it was made of is removed."""
    docs = table(spark, sf_dir, "documents")
    with written() as paths:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = stored(docs, name)
                for path in paths[:-1]:
                    remove(spark, path)
                del paths[:-1]
    return docs
