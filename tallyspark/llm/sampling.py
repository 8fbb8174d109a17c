"""Bounded, balanced samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut


def place():
    """A row's place in the sampling order, from 0 to 1."""
    return F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 32)) / float(1 << 32)


def balanced(rows: DataFrame, label: str, per_label: int, most_rows: int) -> DataFrame:
    """About ``per_label`` rows of each label of ``rows(doc_id, label, ...)``, chosen by hash of the id.

    Each label's rows under its share of the hash range form the sample, and the label's first
    row in any case. With so many labels that about ``most_rows`` rows would not do, each has
    fewer rows, but every label has one. Counts meet their rows in a join, however many labels
    there are.
    """
    placed = rows.where(F.col(label).isNotNull()).withColumn("place", place())
    counts = cut(placed.groupBy(label).agg(F.count("*").alias("__n"), F.min("place").alias("__least")))
    per = max(1, min(per_label, most_rows // max(1, counts.count())))
    taken = placed.join(broadcast_if_small(counts), label).where(F.col("place") <= F.greatest("__least", F.lit(float(per)) / F.col("__n")))
    return taken.select(*rows.columns, "place")
