"""Labelled rows for the classifiers: folds by a checksum, and a bounded sample to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(key: Column, folds: int) -> Column:
    """The key's fold: CRC-32 of its text, modulo ``folds``; null is in none."""
    return (F.crc32(key.cast("string").cast("binary")) % folds).cast("int")


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents with ``learn``, drawn by hash.

    The drawn ids are bounded, so they are broadcast; the texts never leave the executors.  Rows with a null id or label
    are not learned from; a document labelled or stored twice is drawn once.
    """
    drawn = (labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(learn)
             .filter("doc_id is not null and label is not null").dropDuplicates(["doc_id"])
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return (docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]))
