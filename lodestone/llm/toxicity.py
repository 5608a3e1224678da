"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are words of letters and word beginnings of 6, 7 and 9 bytes, lower-cased. The vocabulary is learned from the
labelled examples: all terms in at least `least_df` of them whose document frequencies differ between the labels by
`least_z` standard deviations. The cosine is exact over this vocabulary, without a cap on its size; over all words the
nearest examples would be those on the same subject, whatever their label. Examples
are held in an inverted index, blocks of 64 examples, with the largest weight of each term in each block. A query's
bound on a block is the sum of its weights times these maxima; blocks are visited by falling bound until none can hold
one of the k nearest, so the neighbours are exact. Their votes, weighted by similarity, are calibrated on the examples
themselves, each judged without itself.

The index is a bounded sample: at most `sample` labelled documents of at most `longest` bytes outside the held-out
third, the labels balanced. Every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_cnn import sample_rows
from .common import BYTE_HASH_LOWER, NO_LETTER, Words, bytes_of, held_out, mix, powers, slices

BLOCK, BEGINNINGS = 64, (6, 7, 9)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, text of each): words and the beginnings of longer words."""
    w = Words(*bytes_of(texts), white=NO_LETTER, values=BYTE_HASH_LOWER)
    doc = np.searchsorted(w.ptr, np.arange(len(w.hashes)), "right") - 1
    terms, docs = [w.hashes], [doc]
    if len(w.hashes):
        length, inv = w.ends - w.starts, powers(max(BEGINNINGS))
        head = np.zeros(len(w.hashes), np.uint64)
        for j in range(max(BEGINNINGS)):
            long = length > j
            head[long] += BYTE_HASH_LOWER[w.buf[w.starts[long] + j]] * inv[j]
            if j + 1 in BEGINNINGS:
                far = length > j + 1
                terms.append(mix(head[far] + np.uint64(j + 1)))
                docs.append(doc[far])
    return np.concatenate(terms), np.concatenate(docs)


class Index:
    """Vocabulary (sorted term hashes), idf, and for each block of examples a terms x 64 table of weights."""

    def __init__(self, texts: list[str], labels: np.ndarray, share: float, least_df: int = 4, least_z: float = 3.0, k: int = 15):
        self.k, self.labels, self.share = k, labels, share
        arr = pa.array(texts, pa.string())
        t, d = terms_of(arr)
        pairs = np.unique(np.stack([t, d.astype(np.uint64)], 1), axis=0) if len(t) else np.zeros((0, 2), np.uint64)
        vocab, at = np.unique(pairs[:, 0], return_inverse=True)
        df = np.bincount(at, minlength=len(vocab)).astype(float)
        pos = np.bincount(at, labels[pairs[:, 1].astype(np.int64)], len(vocab))
        n, n1 = max(1, len(texts)), max(1.0, labels.sum())
        expect = df * n1 / n
        z = (pos - expect) / np.sqrt(np.maximum(expect * (1 - n1 / n), 1e-9)) if len(vocab) else df
        good = np.flatnonzero((df >= least_df) & (np.abs(z) >= least_z))
        self.vocab, self.idf = vocab[good], np.log(n / df[good]) + 1
        self.use(self.vectors(arr), len(texts))
        self.calibrate()

    def vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its terms (places in the vocabulary) and unit-length TF-IDF weights, tf as 1 + log."""
        t, d = terms_of(texts)
        n = len(texts)
        if not len(self.vocab) or not len(t):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        at = np.minimum(np.searchsorted(self.vocab, t), len(self.vocab) - 1)
        hit = self.vocab[at] == t
        key, tf = np.unique(d[hit] * len(self.vocab) + at[hit], return_counts=True)
        doc, term = key // len(self.vocab), key % len(self.vocab)
        w = (1 + np.log(tf)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, w * w, n))
        w = w / np.maximum(norm[doc], 1e-12)
        ends = np.searchsorted(doc, np.arange(n + 1))
        return [(term[a:b], w[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def use(self, vectors: list, n: int) -> None:
        """Examples without any term can be nobody's neighbour; the others go to blocks, like ones together."""
        self.rows = np.array(sorted((i for i in range(n) if len(vectors[i][0])), key=lambda i: (vectors[i][0][np.argmax(vectors[i][1])], i)), np.int64)
        self.sparse = [vectors[i] for i in self.rows]

    def open(self) -> "Index":
        """Lay out the posting blocks: in a task, once."""
        blocks = -(-len(self.rows) // BLOCK)
        self.postings = np.zeros((blocks, len(self.vocab), BLOCK), np.float32)
        for j, (t, w) in enumerate(self.sparse):
            self.postings[j // BLOCK, t, j % BLOCK] = w
        self.maxima = self.postings.max(2) if blocks else np.zeros((0, len(self.vocab)), np.float32)
        return self

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (above zero) and their cosines; ties by place in the index."""
        w = weights.astype(np.float32)
        bound = self.maxima[:, terms] @ w
        best, rows = np.zeros(0, np.float32), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == self.k and bound[b] < best[-1] - 1e-5:
                break
            s = w @ self.postings[b, terms]
            at = np.flatnonzero(s > 0)
            at = at[self.rows[np.minimum(b * BLOCK + at, len(self.rows) - 1)] != without]
            best, rows = np.concatenate([best, s[at]]), np.concatenate([rows, b * BLOCK + at])
            order = np.lexsort((rows, -best))[: self.k]
            best, rows = best[order], rows[order]
        return self.rows[rows], best

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Log odds of the distance-weighted votes; one vote's weight of doubt keeps few neighbours moderate."""
        w = sims.astype(float) ** 2
        p = (w @ self.labels[rows] + 0.25) / (w.sum() + 0.5)
        return float(np.log(p / (1 - p)))

    def calibrate(self) -> None:
        """Scale and shift of the votes by logistic regression over the examples, each judged without itself; examples
        are weighted back to the labels' shares. Texts without terms get the share of label 1 among such examples."""
        self.open()
        y, n = self.labels, len(self.labels)
        n1 = y.sum()
        if not n or n1 in (0, n):
            self.scale, self.shift, self.none = 0.0, _logit(self.share), self.share
            return
        weight = np.where(y == 1, self.share / n1, (1 - self.share) / (n - n1)) * n
        x = np.array([self.vote(*self.nearest(t, w, i)) for i, (t, w) in zip(self.rows, self.sparse)])
        yy, ww = y[self.rows], weight[self.rows]
        a, c = 1.0, 0.0
        for _ in range(50):  # Newton steps, with a weak pull towards scale 1
            p = 1 / (1 + np.exp(-(a * x + c)))
            g = np.array([(ww * (p - yy) * x).sum() + (a - 1), (ww * (p - yy)).sum() + 0.01 * c])
            v = ww * p * (1 - p)
            hess = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
            da, dc = np.linalg.solve(hess, g)
            a, c = a - np.clip(da, -1, 1), c - np.clip(dc, -1, 1)
        self.scale, self.shift = float(a), float(c)
        rest = np.setdiff1d(np.arange(n), self.rows)
        self.none = float((weight[rest] @ y[rest] + self.share) / (weight[rest].sum() + 1))
        del self.postings, self.maxima

    def score(self, rows: np.ndarray, sims: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-(self.scale * self.vote(rows, sims) + self.shift)))) if len(rows) else self.none


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 2000, longest: int = 20_000, **how) -> tuple[Index, list[int]]:
    """The index and the doc_ids of its examples."""
    rows = sample_rows(docs, labels, label, sample, longest)
    share = labels.where(F.col(label).isin(0, 1) & ~held_out()).agg(F.avg(label)).first()[0]
    return Index([r.text for r in rows], np.array([r.label for r in rows], float), 0.5 if share is None else share, **how), [r.doc_id for r in rows]


def score(docs: DataFrame, model: tuple[Index, list[int]], threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, neighbours, evidence (doc_ids of the nearest examples, nearest first), similarity.

    Null and empty texts, and texts without a term of the vocabulary, get the share of label 1 among labelled examples
    without one. Null doc_ids and repeated rows keep their rows. Equal texts get equal scores. Neighbours of equal cosine
    are taken in the order of the index. Very long texts are read whole, one at a time. Empty table: empty result. Other
    columns, whatever their names, are not read.
    """
    index, ids = docs.sparkSession.sparkContext.broadcast(model[0]), np.array(model[1], np.int64)

    def run(batches):
        ix = index.value.open()
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for t, w in ix.vectors(batch.column("text")):
                    near, sims = ix.nearest(t, w) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
                    rows.append((ix.score(near, sims), len(near), ids[near[:3]].tolist(), float(sims[0]) if len(sims) else None))
                s, n, e, m = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(e, pa.list_(pa.int64())), pa.array(m, pa.float64())],
                    names=["doc_id", "score", "neighbours", "evidence", "similarity"],
                )

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, neighbours long, evidence array<long>, similarity double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
