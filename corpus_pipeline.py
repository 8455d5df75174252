"""From raw documents to packed training sequences: four stages over whole tables.

Each stage takes (spark, docs, sf_dir). ``run`` writes the result of each to the
shared checkpoint folder as Parquet and reads it again as the next one's documents.
The classifier learns from ``labels`` of the same folder, so SQL can't state the
rows of a run; ``tests/llm`` compares a whole run with brute force.

Every stage decides row by row, whatever the ids: a null id is an id like any other, and several
texts may stand under one. Columns other than the id and the text, of any name, are carried along but
not looked at, apart from ``n_chars``, which the rules bring up to date. An empty table gives
no rows in any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rosterlake.llm import jaccard, packing, quality, rules
from rosterlake.llm.common import Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier scores 0.5 or more, row by row.

    Null, empty and blank texts score 0 and go. Repeated rows score alike and stay or go
    together. Without labels of both classes every text with words scores 0.5 and stays. Texts
    are scored whole, however long.
    """
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines.

    Null, empty and blank texts have fewer than ten words and go; repeated rows share their verdict. A
    share of lost text that just reaches the limit passes.
    """
    return rules.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies; every text of an id is one of its own.

    A row without an id stays only where no row of its group has one; of rows equal in id
    and text one stays. Texts without a word are linked with nothing.
    """
    return jaccard.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    A null text is empty: one piece, the end id alone. Repeated rows are packed each; texts are cut
    into pieces but never shortened. Pieces of equal length are ordered by id, piece and start, so a rerun packs alike.
    """
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", keep_quality),
    ("quality rules", clean_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
