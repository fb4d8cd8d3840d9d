"""Corpus pipeline: from raw documents to token digests.

Every stage takes what the one before kept and returns the columns of the
documents table (the last one: the digests of operator 5). ``run`` writes each
stage's rows to the shared folder and reads them again, so a lost executor
costs one stage at most.

1. toxicity: documents that the classifier predicts toxic go (operator 6);
2. line dedup: lines of 10 or more documents are cut, n_chars follows (3);
3. n-gram Jaccard join: of each component one document stays, that of the
   smallest id, of repeated rows one (2); a stage's word shingles have five words and
   link from 80 percent on, op2's contract (four, 85) is its query's;
4. benchmark decontamination: documents with a benchmark window go (1);
5. byte-level BPE: the ids' and decoded bytes' digests (5).

Rows with a null id or text pass through every stage by the rules of its
operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parityframe.llm.bpe import coded
from parityframe.llm.common import read_table, stored
from parityframe.llm.decontamination import without_contaminated
from parityframe.llm.lines import dedup_lines
from parityframe.llm.ngram_join import near_duplicates, one_of_each
from parityframe.llm.toxicity import scored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return scored(docs, sf_dir).filter("predicted = 0").select(docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = dedup_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, near_duplicates(docs, shingle=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return coded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenise),
]

#: A trained classifier and a tokenizer are beyond SQL; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
