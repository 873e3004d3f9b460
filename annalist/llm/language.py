"""Language identification: multinomial naive Bayes over hashed character n-grams.

The matrix of log-probabilities (buckets x languages) is the only thing broadcast; its size is fixed by parameters
and not by the data. Documents are scored in slices: n-grams of the whole text are hashed in numpy, summed to sparse
(row, bucket, count) triples, and multiplied with the matrix. No shuffle.

Defined results: null texts and texts without a letter (Unicode category L) are `und` with score 0; a text that has
letters always gets a learned language, ties going to the first in sort order; with nothing to learn from every text is
`und`; rows are scored one by one, repeated or not; a very long text is scored whole, its n-grams counted in one pass in
memory linear in it; an empty table gives no rows; extra columns pass through, and the columns added win over columns of
the same names (keep_identified keeps all columns, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.arrays import slices
from annalist.llm.learning import MAX_TRAINING_ROWS, bounded_sample, label_counts
from annalist.llm.shared import names_aside

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 15
_LETTER = regex.compile(r"\p{L}")
_SPREAD = np.uint32(2654435761)
_SLICE = 1 << 19


@dataclass(frozen=True)
class Model:
    """languages in sort order; weights: log P(bucket | language) as float32; prior: log P(language), from all rows that
    are usable and not only those sampled."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray


def sparse_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the hashed character n-grams of lower-cased texts, sorted by row and bucket."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(p) for p in points], np.int64)
    c = np.concatenate(points) if points else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    digits = (c >= 0x30) & (c <= 0x39)
    c = np.where(digits | ((c < 0x41) & (c != 0)) | ((c > 0x5A) & (c < 0x61)), np.uint32(0x20), c)  # digits and marks are as good as blanks
    h = np.zeros(len(c), np.uint32)
    keys = []
    for j in range(max(ORDERS)):
        if len(c) <= j:
            break
        h = h[: len(c) - j] * np.uint32(0x01000193) + c[j:] + np.uint32(j + 1)
        if j + 1 in ORDERS:
            inside = row[: len(row) - j] == row[j:]
            bucket = ((h[inside] * _SPREAD) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
            keys.append((row[: len(row) - j][inside] << BUCKET_BITS) | bucket)
    counts = np.bincount(np.concatenate(keys), minlength=1) if keys else np.zeros(0, np.int64)
    cells = np.flatnonzero(counts)
    return cells >> BUCKET_BITS, cells & ((1 << BUCKET_BITS) - 1), counts[cells]


def runs(texts: list[str], chars: int = _SLICE, rows: int = 128) -> Iterator[list[str]]:
    """Consecutive texts, cut by characters and rows to bound the dense counters."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and (total + len(t) > chars or i - start >= rows):
            yield texts[start:i]
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield texts[start:]


def train(documents: DataFrame, usable: Column, label: str = "lang", text: str = "text", key: str = "doc_id", rows: int = MAX_TRAINING_ROWS) -> Model:
    """Learns from about `rows` whole documents of each language at most, among those that are usable.

    Counts are summed on the executors; the driver gets buckets x languages numbers.
    """
    labelled = documents.where(usable & F.col(label).isNotNull() & F.col(text).isNotNull())
    totals = label_counts(labelled, label)
    chosen = bounded_sample(labelled, label, key, rows, totals).select(F.col(label).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            by: dict[str, list[str]] = {}
            for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                sums = total.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for some in runs(texts):
                    _, bucket, n = sparse_counts(some)
                    np.add.at(sums, bucket, n)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], names=["lang", "bucket", "n"])

    cells = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(cells["lang"].unique().to_pylist())
    place = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((1 << BUCKET_BITS, len(languages)))
    counts[cells["bucket"].to_numpy(), np.array([place[lang] for lang in cells["lang"].to_pylist()], np.int64)] = cells["n"].to_numpy()
    smooth = counts + 0.5
    shares = np.array([totals[lang] for lang in languages], dtype=float)
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log(shares / max(1.0, shares.sum())).astype(np.float32))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and its posterior probability for each text."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return langs, scores
    begin = 0
    for some in runs([t or "" for t in texts]):
        row, bucket, n = sparse_counts(some)
        edges = np.searchsorted(row, np.arange(len(some)))
        sums = np.add.reduceat(model.weights[bucket] * n[:, None].astype(np.float32), edges, axis=0) + model.prior
        sums -= sums.max(axis=1, keepdims=True)
        odds = np.exp(sums.astype(np.float64))
        best = odds.argmax(axis=1)
        for i, t in enumerate(some):
            if _LETTER.search(t):
                langs[begin + i] = model.languages[best[i]]
                scores[begin + i] = odds[i, best[i]] / odds[i].sum()
        begin += len(some)
    return langs, scores


def identify_language(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with lang_pred and score (0 to 1)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(*(F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "score")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            langs, scores = predict(shared.value, part.column(part.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), "lang_pred string", "score double"]))


def keep_identified(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Drops documents in which no language can be identified; columns stay as they were."""
    aside = names_aside(documents.columns, ("lang_pred", "score"))
    found = identify_language(documents.withColumnsRenamed(aside), model, aside.get(text, text)).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in documents.columns))
