"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics are counts over a whole text (byte classes, words, distinct words, repeats), taken with numpy from an Arrow column and
turned into smoothed log ratios, so that every text, the empty one too, has finite ones. Fitting sums counts, sums and outer products
per class over all labelled rows in Spark; what reaches the driver is 1 + d + d*d numbers a class. Each class's covariance is
shrunk towards a scaled identity and kept as a Cholesky factor; a score is the logistic of the difference of the classes' log densities
(Mahalanobis distance and log determinant from the factor) plus log prior odds, over a temperature that keeps far scores apart.

Defined results: null text counts as empty; labels other than 0 and 1 are left out, and so are those of a null doc_id; a doc_id that is
labelled several times, or repeated among the documents, counts with each pair; with a class unseen all scores are the smoothed share of
label 1; rows that repeat a doc_id each get a score; equal texts get equal scores; very long texts count whole, in slices of a few MB (a
longer text is a slice of its own, and counting takes about four times its bytes beside it); an empty table gives no rows; extra columns, whatever their names, are ignored. Only the text enters a
score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import written
from ledgerloom.llm.words import cut_words, raw_bytes, slices
from ledgerloom.llm.workers import map_batches

_SLICE, _PIECE = 4 << 20, 1 << 20
#: Byte classes counted: each is a set of ASCII characters; non-ASCII bytes count as letters.
_CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "stop": ".,;:?'\"()-",
    "symbol": "!#$%&*+/<=>@[\\]^_`{|}~",
    "space": " \t\r",
    "line": "\n",
}
N_STATISTICS = 12


def _class_of_byte() -> np.ndarray:
    """The number of each byte's class, and that after the last for bytes of none."""
    table = np.full(256, len(_CLASSES), np.int64)
    for i, members in enumerate(_CLASSES.values()):
        table[[ord(c) for c in members]] = i
    return table


def _class_counts(texts: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Each text's bytes, and how many are of each class; counted in pieces, as a byte takes a number of eight while it is counted."""
    data, offsets = raw_bytes(texts)
    table, kinds = _class_of_byte(), len(_CLASSES) + 1
    found = np.zeros((len(texts), kinds), np.int64)
    for at in range(int(offsets[0]), int(offsets[-1]), _PIECE):
        end = min(at + _PIECE, int(offsets[-1]))
        low, high = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        lengths = np.diff(np.clip(offsets[low : high + 1], at, end))
        place = np.repeat(np.arange(high - low) * kinds, lengths) + table[data[at:end]]
        found[low:high] += np.bincount(place, minlength=(high - low) * kinds).reshape(-1, kinds)
    return np.diff(offsets).astype(float), {name: found[:, i].astype(float) for i, name in enumerate(_CLASSES)}


def _word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words, different words, words equal to the one before, and its most frequent word's number."""
    words = cut_words(texts)
    hashes, n_rows = words.hashes, len(texts)
    n = np.diff(words.offsets).astype(float)
    if n_rows == 1:  # a long text needs no row numbers beside its words
        repeats = np.array([np.count_nonzero(hashes[1:] == hashes[:-1])], float)
        hashes >>= np.uint64(24)
        hashes.sort()
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        most = np.diff(starts, append=len(hashes)).max(initial=0)
        return n, np.array([len(starts)], float), repeats, np.array([most], float)
    rows = words.rows()
    repeats = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])], minlength=n_rows).astype(float)
    keys = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    owner = (keys[starts] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n_rows)
    np.maximum.at(most, owner, np.diff(starts, append=len(keys)).astype(float))
    return n, np.bincount(owner, minlength=n_rows).astype(float), repeats, most


def _statistics(texts: pa.Array) -> np.ndarray:
    """One row of N_STATISTICS transformed statistics for each text."""
    size, counts = _class_counts(texts)
    n, distinct, repeats, most = _word_counts(texts)
    letters = size - sum(counts[k] for k in counts if k != "upper")

    def ratio(a: np.ndarray, b: np.ndarray, pull: float = 1.0) -> np.ndarray:
        return np.log((a + pull) / (b + 20 * pull))

    return np.column_stack(
        [
            np.log1p(n),
            ratio(letters, n),
            ratio(counts["upper"], letters),
            ratio(counts["digit"], size),
            ratio(counts["stop"], n),
            ratio(counts["symbol"], n),
            ratio(counts["space"], n),
            ratio(counts["line"], n),
            ratio(distinct, n),
            ratio(distinct, np.sqrt(n)),
            ratio(repeats, n),
            ratio(most, n),
        ]
    )


@dataclass
class Discriminant:
    """Class means, Cholesky factors with their inverses, and log determinants over standardised statistics; prior is log odds of label 1."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    inverses: list[np.ndarray]
    log_dets: list[float]
    prior: float
    temperature: float

    def scores(self, statistics: np.ndarray) -> np.ndarray:
        x = (statistics - self.shift) / self.scale
        margin = np.full(len(x), self.prior)
        if self.factors:
            density = []
            for mean, inverse, log_det in zip(self.means, self.inverses, self.log_dets, strict=True):
                z = (x - mean) @ inverse.T
                density.append(-0.5 * (z * z).sum(axis=1) - 0.5 * log_det)
            margin = margin + density[1] - density[0]
        return 1.0 / (1.0 + np.exp(-np.clip(margin / self.temperature, -700, 700)))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for low, high in slices(batch.column(column), _SLICE):
        yield low, high, _statistics(batch.column(column)[low:high])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the transformed statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, x in _texts(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return map_batches(docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text"), run, "doc_id long, x array<double>")


def fit(labelled: DataFrame, shrinkage: float = 0.1, temperature: float = 4.0) -> Discriminant:
    """A discriminant from (label, x); every labelled row counts, through per-class sums."""
    d = N_STATISTICS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                label = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
                x = batch.column(1).flatten().to_numpy().reshape(-1, d)
                for k in (0, 1):
                    own = x[label == k]
                    total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        place = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(total.ravel())], ["place", "value"])

    known = labelled.filter("label IN (0, 1)").select(F.col("label").cast("int").alias("label"), "x")
    gathered = known.mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for row in gathered:
        total[row.place] = row.value
    total = total.reshape(2, -1)
    n = total[:, 0]
    if n.sum() == 0 or n.min() == 0:
        return Discriminant(np.zeros(d), np.ones(d), [], [], [], [], float(np.log((n[1] + 1) / (n[0] + 1))), 1.0)
    shift = total[:, 1 : 1 + d].sum(axis=0) / n.sum()
    square = total[:, 1 + d :].sum(axis=0).reshape(d, d) / n.sum() - np.outer(shift, shift)
    scale = np.sqrt(np.maximum(np.diag(square), 1e-9))
    means, factors, inverses, log_dets = [], [], [], []
    for k in (0, 1):
        mean = total[k, 1 : 1 + d] / n[k]
        cov = (total[k, 1 + d :].reshape(d, d) / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
        amount = max(shrinkage, min(1.0, d / n[k]))
        cov = (1 - amount) * cov + amount * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append((mean - shift) / scale)
        factors.append(factor)
        inverses.append(np.tril(np.linalg.solve(factor, np.eye(d))))
        log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(shift, scale, means, factors, inverses, log_dets, float(np.log(n[1] / n[0])), temperature)


def train(statistics: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits statistics (doc_id, x) to labels (doc_id, quality); held-out rows, crc32 of the id's text mod 3 equal to 1, are left out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).filter(~held_out("doc_id"))
    return fit(statistics.join(usable, "doc_id"))


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(statistics: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of statistics (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return map_batches(statistics, run, "doc_id long, score double")


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every text; each text is read once, its statistics stay in the shared folder."""
    statistics = written(document_statistics(docs), "statistics")
    return score(statistics, train(statistics, labels))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that score at least threshold; no text is shuffled."""
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, x in _texts(batch, column):
                yield batch.slice(low, high - low).filter(pa.array(model.scores(x) >= threshold))

    return map_batches(docs, run, docs.schema)
