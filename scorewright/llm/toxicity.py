"""Toxicity scores by non-negative positive-unlabelled learning over hashed word and word-beginning features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from scorewright.llm.tables import bounded_batches
from scorewright.llm.words import mix, slices

PREFIXES = (4, 5, 6, 7)  # bytes of a word's beginning that are features of their own
TIMES = 3  # occurrences of a feature that are told apart
MAX_POSITIVE = 6_000  # confirmed examples the classifiers learn from, as a hash share of them
MAX_UNLABELLED = 12_000  # unlabelled texts they learn from, likewise
CLASSIFIERS = 3
LEAST_CONFIRMED = 300  # confirmed texts for each classifier, else there are fewer
LEAST_SHARE = 0.01  # of the confirmed texts that have a feature: rarer ones come from copies and shared passages
LEAST_RATIO = 3.0  # how much more often confirmed texts have a feature than unlabelled ones, which hold the class too
MAX_FEATURES = 50_000
FOLDS = 5
_SCALE = 1 << 30


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Rows that labels are never learned from: those whose crc32(id as text) leaves ``fold``, and those without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def hash_share(doc_id: str, share: float, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(_SCALE)) < int(share * _SCALE)


def text_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, feature hashes) of a slice of texts, each once a text: every word and the beginnings of longer words, and the same again for
    those that occur again, up to TIMES times."""
    for at, words in slices(texts):
        row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first)) + at
        found = [words.hashes()]
        rows = [row]
        for size in PREFIXES:
            longer, prints = words.prefixes(size)
            found.append(prints)
            rows.append(row[longer])
        rows, prints = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((prints, rows))
        rows, prints = rows[order], prints[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (prints[1:] != prints[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(rows)))
        rows, prints = rows[first], prints[first]
        again = [times >= n for n in range(2, TIMES + 1)]
        yield np.concatenate([rows, *(rows[a] for a in again)]), np.concatenate([prints, *(mix(prints[a] + np.uint64(n)) for n, a in enumerate(again, 2))])


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, prints in text_features(batch.column(2)):
            order = np.argsort(rows, kind="stable")
            rows, prints = rows[order], prints[order]
            present, starts = np.unique(rows, return_index=True)
            offsets = pa.array(np.append(starts, len(rows)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(present)), batch.column(1).take(pa.array(present)), pa.ListArray.from_arrays(offsets, pa.array(prints.view(np.int64)))],
                ["bag", "confirmed", "features"])


class Classifier:
    """A linear score over the features that confirmed texts have more often than unlabelled ones."""

    def __init__(self, prints: np.ndarray, weights: np.ndarray, bias: float):
        self.prints, self.weights, self.bias = prints, weights, bias

    @staticmethod
    def fit(confirmed: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 60, rate: float = 0.1, decay: float = 1e-6, seed: int = 11) -> Classifier:
        """Minimise prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]) with the logistic loss, by Adam over small batches.

        The bracket estimates the risk on texts outside the class; where it falls below zero it is overfitted and gives no slope.
        """
        every = confirmed + unlabelled
        prints, index = np.unique(np.concatenate(every), return_inverse=True)
        ends = np.cumsum([len(x) for x in every])
        split = ends[len(confirmed) - 1]
        n_p, n_u = len(confirmed), len(unlabelled)
        in_p = np.bincount(index[:split], minlength=len(prints))
        in_u = np.bincount(index[split:], minlength=len(prints))
        share = (in_p + in_u + 1) / (n_p + n_u + 2)
        z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
        # only features that speak for the class: in a long text the many others would outweigh a few clear words
        ranked = np.argsort(-z, kind="stable")[:MAX_FEATURES]
        clear = in_p / n_p >= LEAST_RATIO * in_u / n_u
        chosen = np.sort(ranked[(z[ranked] >= 5) & (in_p[ranked] >= max(3, LEAST_SHARE * n_p)) & clear[ranked]])
        place = np.full(len(prints), -1)
        place[chosen] = np.arange(len(chosen))
        index = place[index]
        texts = [x[x >= 0] for x in np.split(index, ends[:-1])]
        weights = np.zeros(len(chosen) + 1)
        weights[-1] = np.log(prior / (1 - prior))
        # start at the log ratio of the feature's rate in the class to its prior-corrected rate outside it
        rate_p, rate_u = in_p[chosen] / n_p, in_u[chosen] / n_u
        outside = np.maximum((rate_u - prior * rate_p) / (1 - prior), 1 / n_u)
        weights[:-1] = np.maximum(np.log(rate_p / outside), 0) / 2
        m, v, step = np.zeros_like(weights), np.zeros_like(weights), 0
        rng = np.random.Generator(np.random.PCG64(seed))
        batches = max(1, n_u // 256)
        for _ in range(epochs):
            p_parts, u_parts = np.array_split(rng.permutation(n_p), batches), np.array_split(rng.permutation(n_u) + n_p, batches)
            for ps, us in zip(p_parts, u_parts):
                if not len(ps):
                    ps = rng.integers(0, n_p, 32)
                rows = [texts[i] for i in (*ps, *us)]
                flat, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
                score = np.bincount(owner, weights[flat], len(rows)) + weights[-1]
                yes = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
                softplus = np.logaddexp(0, score)
                a, b = len(ps), len(us)
                bracket = softplus[a:].mean() - prior * softplus[:a].mean()
                # slopes of the losses: l(+) = softplus(-s), l(-) = softplus(s)
                slope = np.zeros(len(rows))
                if bracket >= 0:
                    slope[:a] = prior / a * (yes[:a] - 1) - prior / a * yes[:a]
                    slope[a:] = yes[a:] / b
                else:
                    slope[:a] = prior / a * (yes[:a] - 1)
                g = np.bincount(flat, slope[owner], len(weights)).astype(np.float64)
                g[-1] = slope.sum()
                g[:-1] += decay * weights[:-1]
                step += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                np.maximum(weights[:-1], 0, out=weights[:-1])  # evidence speaks for the class or not at all
        return Classifier(prints[chosen], weights[:-1], float(weights[-1]))


def _train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int, fold: int) -> tuple[list[Classifier], float]:
    """Classifiers from disjoint bags of the sampled rows, each trained in its own task, and the class prior."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.max(label) == 1).alias("yes"))
    known = known.where(~held_out(doc_id, folds, fold))
    n_known, n_yes = known.agg(F.count("*"), F.count_if("yes")).first()
    prior = (n_yes + 1) / (n_known + 2)
    if not n_yes:
        return [], prior
    n_docs = docs.count()
    sure = known.where(F.col("yes") & hash_share(doc_id, MAX_POSITIVE / n_yes, 1)).select(F.col(doc_id).alias("__sure"))
    # the list of confirmed ids is bounded by MAX_POSITIVE
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(~held_out("id", folds, fold))
    rows = rows.join(F.broadcast(sure), F.col("id") == F.col("__sure"), "left")
    bags = max(1, min(CLASSIFIERS, n_yes // LEAST_CONFIRMED))
    spread = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(bags)).cast("int")
    drawn = hash_share("id", MAX_UNLABELLED / max(n_docs, 1), 2)
    confirmed = F.col("__sure").isNotNull()
    # a confirmed text that is also drawn counts on both sides, as the risk asks
    rows = rows.where(confirmed | drawn).select(spread.alias("bag"), F.explode(F.filter(F.array(F.when(confirmed, True), F.when(drawn, False)), lambda x: x.isNotNull())).alias("confirmed"), "text")
    found = rows.mapInArrow(_presence, "bag int, confirmed boolean, features array<long>")

    def fit(bag: pd.DataFrame) -> pd.DataFrame:
        own = bag["confirmed"].to_numpy(bool)
        texts = [np.sort(np.asarray(x, np.int64)).view(np.uint64) for x in bag["features"]]
        # rows reach a task in any order: learn from them in a fixed one
        ranked = sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i].tobytes()))
        sides = [[texts[i] for i in ranked if own[i] == side] for side in (True, False)]
        if not sides[0] or not sides[1]:
            return pd.DataFrame({"prints": [], "weights": [], "bias": []})
        c = Classifier.fit(sides[0], sides[1], prior)
        return pd.DataFrame({"prints": [c.prints.view(np.int64)], "weights": [c.weights], "bias": [c.bias]})

    fitted = found.groupBy("bag").applyInPandas(fit, "prints array<long>, weights array<double>, bias double")
    return [Classifier(np.array(r.prints, np.int64).view(np.uint64), np.array(r.weights), r.bias) for r in fitted.orderBy("bias").collect()], prior


def _merged(classifiers: list[Classifier]) -> Classifier:
    """The mean of linear scores is a linear score."""
    prints, index = np.unique(np.concatenate([c.prints for c in classifiers]), return_inverse=True)
    weights = np.bincount(index, np.concatenate([c.weights for c in classifiers]), len(prints)) / len(classifiers)
    return Classifier(prints, weights, float(np.mean([c.bias for c in classifiers])))


def _scores(c: Classifier, texts: pa.Array, maybe: np.ndarray) -> np.ndarray:
    """Linear scores; ``maybe`` marks the leading 22 bits that some feature has, which spares most searches."""
    out = np.full(len(texts), c.bias)
    for rows, prints in text_features(texts):
        near = maybe[(prints >> np.uint64(42)).astype(np.int64)]
        rows, prints = rows[near], prints[near]
        at = np.searchsorted(c.prints, prints)
        at[at == len(c.prints)] = 0
        hit = c.prints[at] == prints
        out += np.bincount(rows[hit], c.weights[at[hit]], len(texts))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, fold: int = 0,
             keep_text: bool = True) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (score >= 0.5) added.

    Classifiers learn from texts that ``labels`` confirms as 1 and from texts taken as unlabelled, both outside the held-out fold; the class prior
    is the share of 1 among the labelled rows outside it. A label that is null or lacks an id is no label; of repeated ones the largest
    counts. At most MAX_POSITIVE and MAX_UNLABELLED texts, chosen by a hash of the id, are learned from. Every whole text is scored, null texts as
    empty ones; with nothing confirmed each score is the prior. Columns of ``docs`` named like an added one are replaced.
    """
    bounded_batches(docs.sparkSession)
    classifiers, prior = _train(docs, labels, doc_id, text, label, folds, fold)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*kept).withColumn("held_out", held_out(doc_id, folds, fold))
    classifiers = [c for c in classifiers if len(c.prints)]
    if not classifiers:
        scored = rows.withColumn("score", F.lit(prior))
        scored = scored if keep_text else scored.drop(text)
    else:
        model = docs.sparkSession.sparkContext.broadcast(_merged(classifiers))  # at most CLASSIFIERS * MAX_FEATURES weights
        at = rows.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = model.value
            maybe = np.zeros(1 << 22, bool)
            maybe[(c.prints >> np.uint64(42)).astype(np.int64)] = True
            for batch in batches:
                score = 1 / (1 + np.exp(-np.clip(_scores(c, batch.column(at), maybe), -30, 30)))
                columns = dict(zip(batch.schema.names, batch.columns))
                if not keep_text:
                    del columns[text]
                yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(score)})

        schema = StructType([f for f in rows.schema if keep_text or f.name != text])
        scored = rows.mapInArrow(run, schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
