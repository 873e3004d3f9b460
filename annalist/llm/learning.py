"""Bounded samples of labelled rows, the only thing in this subpackage that is fitted on less than all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier learns from, for each label, at most (in expectation).
MAX_TRAINING_ROWS = 2000
#: Labels that a classifier can have; more raise, so none is left out unseen.
MAX_LABELS = 1024


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread(*columns: str, seed: int = 7) -> Column:
    """A number from 0 to 1 that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def label_counts(labelled: DataFrame, label: str) -> dict:
    """Rows of each label, from one aggregation over the label column alone; more than MAX_LABELS labels raise."""
    counts = labelled.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} values of {label}")
    return {r[label]: r["count"] for r in counts}


def bounded_sample(labelled: DataFrame, label: str, key: str, rows: int = MAX_TRAINING_ROWS, counts: dict | None = None) -> DataFrame:
    """About `rows` rows of each label at most, chosen by a hash of the key, the same ones on every run."""
    counts = label_counts(labelled, label) if counts is None else counts
    if not counts:
        return labelled.where(F.lit(False))
    # one flat map, as a chain of conditions overflows the planner's stack long before MAX_LABELS
    shares = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows / n))))
    return labelled.where(spread(key) < shares[F.col(label)])
