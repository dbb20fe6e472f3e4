"""Corpus pipeline: reject poor documents, take out repeated lines, keep one of each group of near copies, drop what
holds benchmark passages, and encode the rest.

Every stage takes (spark, docs, sf_dir), works on all rows it is given, and returns a DataFrame that is written as
Parquet and read again for the next, after which the one before it is deleted. All but the last return the columns of
``documents``; further columns of the input are dropped. No documents give none in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, pieces, quality, simhash
from tidemark.llm.common import discard, read, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark, docs, sf_dir):
    """Documents that the classifier does not reject (score of 0.3 or more).

    Null and empty texts are scored like any others; repeated rows have one fate; without usable labels all stay.
    """
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=tuple(COLUMNS), with_text=True)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark, docs, sf_dir):
    """Of lines that are alike one stays, in the first document; documents that lose all lines go.

    Empty lines, empty texts and null ones stay as they are; equal rows keep the same lines; rows without an id come last.
    """
    return lines.clean(docs, min_chars=1).select(*COLUMNS)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group whose 5-word shingles have a Jaccard of 0.8 or more stays, that of the smallest id.

    Null texts count as empty, and empty ones are alike; of repeated rows one stays; rows without an id stay only where
    no row of their group has one.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without any benchmark window of ten words (or whole shorter item).

    Null and word-less texts stay; repeated rows stay or go together; an empty benchmark drops none.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark, docs, sf_dir):
    """doc_id, lang, source and the piece ids of each text, with the digest of what they decode to. Null texts are empty."""
    import public_tokenizers

    return pieces.with_ids(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding", encode),
]
#: A learned classifier and MinHash candidates can't be stated in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; what the last one returns."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}")
        if i:
            discard(docs)
        docs = spark.read.parquet(f"{base}/{i}")
