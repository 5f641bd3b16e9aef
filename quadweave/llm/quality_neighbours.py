"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is described by its byte trigrams, hashed into BUCKETS, and by how many words
equal the word before; the counts are damped, weighted by inverse document frequency, and projected on the leading
singular directions of a labelled sample, found by block power iteration. The sample's vectors (at most
MAX_LABELLED of RANK numbers) are sent to every task, which computes all cosine
products of its documents in blocks. The K most similar neighbours
vote with their similarity to the power SHARPNESS.

Defined results: null, empty and very short texts (no trigram) get the share of
positive labels; without labelled rows the score is 0; repeated rows are scored
alike; of neighbours with equal similarity those of the smaller id come first, then of the smaller
text hash; of several labels of one id the largest counts; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave.llm.common import documents, held_out, labels, slices, text_buffers, word_hashes
from quadweave.llm.toxicity import labelled_rows

#: Bound of the labelled sample; it fixes the size of all that is broadcast.
MAX_LABELLED = 4_000
BUCKETS, RANK, K, SHARPNESS = 4096, 48, 25, 4.0
FEATURES = BUCKETS + 1
REPEATS = 32


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of every three bytes in a row."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def raw_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, how many trigrams each bucket has, and in the last column REPEATS times r * r / n, where r of its n words equal the word before."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.int64)
    bucket = trigram_buckets(data)
    words, pointers = word_hashes(data, offsets[:-1], fold=True)
    again = np.concatenate([[False], words[1:] == words[:-1]])
    for k in range(n):
        lo, hi = offsets[k], offsets[k + 1] - 2
        if hi > lo:
            out[k, :BUCKETS] = np.bincount(bucket[lo:hi], minlength=BUCKETS)
        size = int(pointers[k + 1] - pointers[k])
        out[k, BUCKETS] = REPEATS * np.count_nonzero(again[pointers[k] + 1 : pointers[k + 1]]) ** 2 // max(size, 1)
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """raw_counts(), damped."""
    return np.sqrt(raw_counts(data, offsets), dtype=np.float32)


def leading_directions(x: np.ndarray, rank: int, rounds: int = 8, spare: int = 16) -> np.ndarray:
    """The rank leading right singular directions of x, as columns: block power iteration from a fixed start."""
    rng = np.random.Generator(np.random.PCG64(1))
    width = min(rank + spare, *x.shape)
    q, _ = np.linalg.qr(rng.standard_normal((x.shape[1], width)).astype(np.float32))
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    small = x @ q
    _, turn = np.linalg.eigh((small.T @ small).astype(np.float64))
    return (q @ turn[:, ::-1][:, :rank]).astype(np.float32)


class Voter:
    """Labelled vectors with what is needed to place a text among them.

    rows: (bucket numbers as uint16, their counts as uint32, label) of each labelled text.
    """

    def __init__(self, rows: list[tuple[bytes, bytes, int]]):
        self.prior = float(np.mean([y for *_, y in rows])) if rows else 0.0
        rows = [r for r in rows if r[0]]
        self.labels = np.array([y for *_, y in rows], np.float32)
        x = np.zeros((len(rows), FEATURES), np.float32)
        for k, (buckets, n, _) in enumerate(rows):
            x[k, np.frombuffer(buckets, "<u2")] = np.sqrt(np.frombuffer(n, "<u4"))
        self.idf = np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1)).astype(np.float32) + np.float32(0.1)
        if not len(x):
            return
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        self.projection = leading_directions(x, RANK)
        self.vectors = self._unit(x @ self.projection)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.full(n, self.prior)
        if not len(self.labels):
            return out
        x = counts(data, offsets)
        has = np.flatnonzero(x.any(axis=1))
        for lo in range(0, len(has), 512):
            rows = has[lo : lo + 512]
            similar = self._unit(self._weigh(x[rows]) @ self.projection) @ self.vectors.T
            k = min(K, similar.shape[1])
            near = np.argpartition(similar, -k, axis=1)[:, -k:] if k < similar.shape[1] else np.tile(np.arange(k), (len(rows), 1))
            least = np.take_along_axis(similar, near, axis=1).min(axis=1)
            for i in np.flatnonzero((similar >= least[:, None]).sum(axis=1) > k):  # a tie for the last place
                near[i] = np.argsort(-similar[i], kind="stable")[:k]
            weight = np.maximum(np.take_along_axis(similar, near, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
            out[rows] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, voter: Voter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(voter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                found = [own.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a in range(lo, hi, 512) for b in [min(a + 512, hi)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.concatenate(found))], [id_col, "score"])

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, score double")


def labelled_counts(rows: DataFrame) -> list[tuple[bytes, bytes, int]]:
    """What Voter needs of (__id, text, __label), counted on the executors: at most 6 bytes a bucket and row reach the driver."""
    src = rows.select("__id", F.col("text").cast("string").alias("text"), "__label", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            found = []
            for k in range(batch.num_rows):
                n = raw_counts(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))[0]
                at = np.flatnonzero(n)
                found.append((at.astype("<u2").tobytes(), n[at].astype("<u4").tobytes()))
            both = [pa.array([f[i] for f in found], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *both, batch.column(2)], ["id", "th", "buckets", "n", "label"])

    kind = src.schema["__id"].dataType.simpleString()
    found = src.mapInArrow(run, f"id {kind}, th long, buckets binary, n binary, label int").toArrow().to_pylist()
    found.sort(key=lambda r: (r["id"], r["th"]))
    return [(r["buckets"], r["n"], r["label"]) for r in found]


def fit(docs: DataFrame, marks: DataFrame, limit: int = MAX_LABELLED) -> Voter:
    """A voter of at most limit labelled ids outside the held-out fold."""
    return Voter(labelled_counts(labelled_rows(docs, marks, "quality", limit)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: quality of every text."""
    docs = documents(spark, sf_dir)
    voter = fit(docs, labels(spark, sf_dir))
    return score(docs, voter).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
