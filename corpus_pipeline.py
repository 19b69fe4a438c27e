"""The corpus pipeline, part of the corpus operators (pairloom.llm).

Five stages, each over all that the one before kept: toxic documents go; of each
group of near duplicates one document stays; secrets are taken out of the texts;
sources are mixed to their target weights; and what is taken is encoded into
SentencePiece ids. A stage takes (spark, docs, sf_dir) and returns a DataFrame,
which run() writes as Parquet in the shared folder and reads as the next one's
docs. All stages but the last return the columns of documents. A stage sends rows to
Python in small batches (common.small_batches), which holds for the session from then on.

Defined cases: each stage takes nulls in every column, empty and very long texts,
ties, repeated rows, empty tables and further columns of any name, as its
operator states; what a stage keeps has all columns of its input.
"""

from __future__ import annotations

from pairloom.llm import mixing, secret_scan, sentencepiece_fst, simhash, toxicity
from pairloom.llm.common import small_batches, table, written


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score is under the threshold, as labelled documents teach it."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group whose five-word shingles are alike at 0.8 or more."""
    small_batches(spark)
    return simhash.keep_one_of_each(docs)


def remove_secrets(spark, docs, sf_dir):
    """All documents, with each secret in the text replaced by its kind."""
    small_batches(spark)
    return secret_scan.redact_documents(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix of their sources takes them."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark, docs, sf_dir):
    """Ids of each document: doc_id, ids, n_ids, n_byte_ids, ids_crc32 and round_trip."""
    small_batches(spark)
    return sentencepiece_fst.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("secrets", remove_secrets), ("mixing", mix_sources), ("encoding", encode)]

#: SQL expresses neither the learnt lexicon nor the transducer; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
