"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from scorewright.llm.tables import bounded_batches
from scorewright.llm.toxicity import hash_share, held_out
from scorewright.llm.words import Words, grams, mix, slices

MAX_LABELLED = 4_000  # labelled texts whose vectors are broadcast, as a hash share of them
WORD_TERMS = 2_048
SHAPE_TERMS = 2_048
RANK = 64
NEIGHBOURS = 15
FOLDS, FOLD = 3, 1
_BLOCK = 512

# the form of a byte: capitals, other letters (with all of UTF-8's longer forms) and digits each become one
_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91] = 1
_FORM[97:123] = 2
_FORM[128:] = 2
_FORM[48:58] = 3


def _forms(words: Words) -> Words:
    """The same words with runs of one form cut to one, such as ``Aa.`` or ``A!``."""
    form = _FORM[words.data]
    keep = np.ones(len(form), bool)
    keep[1:] = form[1:] != form[:-1]
    keep[words.start] = True
    at = np.zeros(len(form) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return Words(form[keep], at[words.offsets])


def term_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts in the slice, text number, term, count): hashed words, word forms and pairs of forms next to each other."""
    for at, words in slices(texts):
        n = len(words.first) - 1
        row = np.repeat(np.arange(n), np.diff(words.first))
        forms = _forms(words)
        shape = forms.hashes()
        pair = grams(shape, 2)
        inside = row[:-1] == row[1:]
        terms = np.concatenate([
            (words.hashes() >> np.uint64(20)) % np.uint64(WORD_TERMS),
            (mix(shape) >> np.uint64(20)) % np.uint64(SHAPE_TERMS) + np.uint64(WORD_TERMS),
            (pair[inside] >> np.uint64(20)) % np.uint64(SHAPE_TERMS) + np.uint64(WORD_TERMS)])
        rows = np.concatenate([row, row, row[:-1][inside]])
        key, count = np.unique(rows * np.int64(WORD_TERMS + SHAPE_TERMS) + terms.astype(np.int64), return_counts=True)
        yield n, key // (WORD_TERMS + SHAPE_TERMS), key % (WORD_TERMS + SHAPE_TERMS), count


def _weighted(n: int, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Dense rows of log counts times rarity; words and forms are each scaled to length one, so neither outweighs the other."""
    x = np.zeros((n, WORD_TERMS + SHAPE_TERMS), np.float32)
    x[rows, terms] = np.log1p(counts) * rarity[terms]
    for part in (x[:, :WORD_TERMS], x[:, WORD_TERMS:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


class Neighbours:
    """Unit latent vectors of the labelled texts, the projection that made them, and their labels."""

    def __init__(self, rarity: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.rarity, self.axes, self.vectors, self.labels = rarity, axes, vectors, labels

    @staticmethod
    def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, seed: int = 5) -> Neighbours:
        """Axes by randomised subspace iteration on the weighted term matrix of the labelled texts."""
        rows = np.repeat(np.arange(len(texts)), [len(t) for t, _ in texts])
        terms, counts = np.concatenate([t for t, _ in texts]), np.concatenate([c for _, c in texts])
        seen = np.bincount(terms, minlength=WORD_TERMS + SHAPE_TERMS)
        rarity = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
        x = _weighted(len(texts), rows, terms, counts, rarity)
        axes = np.random.Generator(np.random.PCG64(seed)).standard_normal((x.shape[1], min(rank + 16, len(texts)))).astype(np.float32)
        for _ in range(4):
            axes, _ = np.linalg.qr(x.T @ (x @ axes))
        _, _, right = np.linalg.svd(x @ axes, full_matrices=False)
        axes = (axes @ right.T)[:, :rank].astype(np.float32)
        return Neighbours(rarity, axes, _unit(x @ axes), labels.astype(np.float32))

    def scores(self, texts: pa.Array, nearest: int = NEIGHBOURS) -> np.ndarray:
        parts = []
        for n, rows, terms, counts in term_counts(texts):
            for at in range(0, n, _BLOCK):
                own = (rows >= at) & (rows < at + _BLOCK)
                x = _weighted(min(_BLOCK, n - at), rows[own] - at, terms[own], counts[own], self.rarity)
                cosine = _unit(x @ self.axes) @ self.vectors.T
                k = min(nearest, cosine.shape[1])
                top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(cosine, top, 1), 0).astype(np.float64) + 1e-9
                score = (weight * self.labels[top]).sum(1) / weight.sum(1)
                # a text without words has no neighbours
                parts.append(np.where(np.bincount(rows[own] - at, minlength=len(score)) > 0, score, float(self.labels.mean())))
        return np.concatenate(parts) if parts else np.zeros(0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for n, rows, terms, counts in term_counts(batch.column(2)):
            offsets = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), *columns], ["rank", "yes", "terms", "counts"])
            at += n


def _fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> tuple[Neighbours | None, float]:
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.max(label) == 1).alias("yes"))
    known = known.where(~held_out(doc_id, FOLDS, FOLD))
    n_known, n_yes = known.agg(F.count("*"), F.count_if("yes")).first()
    prior = (n_yes + 1) / (n_known + 2)
    if not n_known:
        return None, prior
    # at most about MAX_LABELLED ids, whatever the input
    drawn = known.where(hash_share(doc_id, MAX_LABELLED / n_known, 4)).select(F.col(doc_id).alias("__id"), "yes")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("__id"))
    rows = rows.where(F.trim("text") != "").select(F.xxhash64("id", "text").alias("rank"), "yes", "text")
    found = rows.mapInArrow(_features, "rank long, yes boolean, terms array<int>, counts array<int>").toArrow().sort_by("rank")
    texts = [(np.asarray(t, np.int64), np.asarray(c, np.int64)) for t, c in zip(found["terms"].to_numpy(), found["counts"].to_numpy())]
    if not texts:
        return None, prior
    return Neighbours.fit(texts, found["yes"].to_numpy().astype(np.float32)), prior


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep_text: bool = True) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (score >= 0.5) added.

    A score is the share of label 1 among the NEIGHBOURS labelled texts with the largest cosine, each weighted by it. Vectors are log counts of
    hashed words and word forms, scaled by rarity and projected on the leading axes of the labelled texts. At most MAX_LABELLED labelled texts,
    chosen by a hash of the id outside the held-out fold, are learned from and broadcast; cosines are exact, block by block, for every whole
    text. A null or wordless text scores the share of label 1; so does every text when nothing is labelled. Null labels and ids teach nothing; of
    repeated labels the largest counts. Columns of ``docs`` named like an added one are replaced.
    """
    bounded_batches(docs.sparkSession)
    fitted, prior = _fit(docs, labels, doc_id, text, label)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*kept).withColumn("held_out", held_out(doc_id, FOLDS, FOLD))
    if fitted is None:
        scored = rows.withColumn("score", F.lit(prior))
        scored = scored if keep_text else scored.drop(text)
    else:
        model = docs.sparkSession.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = dict(zip(batch.schema.names, batch.columns))
                score = np.clip(model.value.scores(columns[text]), 0, 1)
                if not keep_text:
                    del columns[text]
                yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(score.astype(np.float64))})

        schema = StructType([f for f in rows.schema if keep_text or f.name != text])
        scored = rows.mapInArrow(run, schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
