"""Quality classifier: a byte-level convolutional network in numpy.

Filters of 8 bytes move in steps of two over the UTF-8 bytes of the whole text. Their outputs are max-pooled over
overlapping chunks of 256 bytes (half of each chunk lies in the next), and the chunks' pooled outputs are combined by
their mean and their maximum into one probability. Filter weights factor into a byte embedding and a kernel; for
scoring they are multiplied out to tables indexed by two bytes at once, so a filter costs four look-ups a step.

Learning is by Adam on the logistic loss, over a bounded sample of labelled rows: at most `sample` documents of at most
`longest` bytes, drawn by the hash of their doc_id. Scoring reads every byte of every text in bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, held_out, slices

WIDTH, BLOCK, EMBED = 8, 64, 8  # bytes of a filter; steps of half a chunk; size of the byte embedding


@dataclass
class Model:
    """tables[j, byte, filter]: the multiplied-out weights; out: weights of means, maxima and chunk-count-free bias."""

    tables: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    intercept: float

    def paired(self) -> np.ndarray:
        """[WIDTH / 2, 65536, filters]: the tables for two bytes, the first in the low half of the index."""
        t = self.tables.astype(np.float32)
        return np.stack([(t[2 * j + 1][:, None] + t[2 * j][None]).reshape(65536, -1) for j in range(WIDTH // 2)])


#: Steps at the end of a text's last block whose filters would read the next text: left out, they hold only filling.
BEYOND = WIDTH // 2 - 1


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of all texts, each filled up with BEYOND pairs of zero bytes or more to whole blocks, and the number of
    blocks of each."""
    n = np.diff(offsets)
    blocks = np.maximum(1, -(-(n + 2 * BEYOND) // (2 * BLOCK)))
    out = np.zeros((int(blocks.sum()) * BLOCK + WIDTH) * 2, np.uint8)
    at = np.concatenate([[0], np.cumsum(blocks)[:-1]]) * 2 * BLOCK
    for i in range(len(n)):
        out[at[i] : at[i] + n[i]] = raw[offsets[i] : offsets[i + 1]]
    return out.view("<u2"), blocks


def block_maxima(pairs: np.ndarray, counts: np.ndarray, paired: np.ndarray, piece: int = 512) -> np.ndarray:
    """Largest output of each filter in each block, [blocks, filters], of texts with counts blocks each."""
    total = (len(pairs) - WIDTH) // BLOCK
    out = np.empty((total, paired.shape[2]), np.float32)
    last = np.zeros(total, bool)
    last[np.cumsum(counts) - 1] = True
    for a in range(0, total, piece):
        b = min(a + piece, total)
        x = pairs[a * BLOCK : b * BLOCK + WIDTH]
        n = (b - a) * BLOCK
        y = paired[0][x[:n]]
        for j in range(1, WIDTH // 2):
            y += paired[j][x[j : j + n]]
        y = y.reshape(b - a, BLOCK, -1)
        y[last[a:b], -BEYOND:] = -np.inf
        out[a:b] = y.max(1)
    return out


def chunk_features(blocks: np.ndarray, counts: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean and maximum over a text's chunks of max(0, pooled + bias): [texts, 2 * filters]."""
    last = np.cumsum(counts) - 1
    after = np.minimum(np.arange(len(blocks)) + 1, np.repeat(last, counts))
    pooled = np.maximum(0, np.maximum(blocks, blocks[after]) + bias)
    first = last - counts + 1
    return np.hstack([np.add.reduceat(pooled, first, 0) / counts[:, None], np.maximum.reduceat(pooled, first, 0)])


def scores(model: Model, paired: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    pairs, counts = padded(raw, offsets)
    x = chunk_features(block_maxima(pairs, counts, paired), counts, model.bias)
    # summed row by row: a matrix product may round differently with other numbers of rows
    return 1 / (1 + np.exp(-np.clip((x * model.out).sum(1) + model.intercept, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, filters: int = 16, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 5, share: float | None = None) -> Model:
    """Fit the network, both labels weighted alike; then shift its odds to `share`, label 1's part of all labelled rows.

    Without rows of both labels the score is label 1's share of the rows given (0.5 without rows)."""
    r = np.random.RandomState(seed)
    emb, ker = r.normal(0, 1, (256, EMBED)), r.normal(0, 0.3, (WIDTH, EMBED, filters))
    bias, out, inter = np.zeros(filters), r.normal(0, 0.3, 2 * filters), np.zeros(1)
    if len(set(labels.tolist())) < 2:
        share = min(max(float(labels.mean()) if len(labels) else 0.5, 0.01), 0.99)
        return Model(np.zeros((WIDTH, 256, filters)), bias, out * 0, float(np.log(share / (1 - share))))
    odds = 0.0 if share is None else float(np.log(share / (1 - share)))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    params = [emb, ker, bias, out, inter]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    order = np.arange(len(texts))
    for epoch in range(epochs):
        r.shuffle(order)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            pairs, counts = padded(np.frombuffer(b"".join(texts[i] for i in rows), np.uint8), off)
            raw = pairs.view(np.uint8)
            tables = np.einsum("be,jef->jbf", emb, ker).astype(np.float32)
            total = (len(pairs) - WIDTH) // BLOCK
            starts = np.arange(total * BLOCK) * 2
            y = tables[0][raw[starts]]
            for j in range(1, WIDTH):
                y += tables[j][raw[starts + j]]
            y = y.reshape(total, BLOCK, filters)
            y[np.cumsum(counts) - 1, -BEYOND:] = -np.inf
            arg = y.argmax(1)
            blocks = np.take_along_axis(y, arg[:, None], 1)[:, 0]
            last = np.cumsum(counts) - 1
            first = last - counts + 1
            after = np.minimum(np.arange(total) + 1, np.repeat(last, counts))
            later = blocks[after] > blocks
            pooled = np.where(later, blocks[after], blocks) + bias
            live = np.maximum(pooled, 0)
            mean, most = np.add.reduceat(live, first, 0) / counts[:, None], np.maximum.reduceat(live, first, 0)
            x = np.hstack([mean, most])
            p = 1 / (1 + np.exp(-np.clip(x @ out + inter, -30, 30)))
            g = (p - labels[rows]) * weight[rows] / len(rows)
            dx = g[:, None] * out
            doc = np.repeat(np.arange(len(rows)), counts)
            dl = dx[doc, :filters] / counts[doc][:, None]
            top = live == most[doc]
            dl += np.where(top, dx[doc, filters:] / np.maximum(1, np.add.reduceat(top.astype(float), first, 0))[doc], 0)
            dl *= pooled > 0
            db = dl.sum(0)
            source = np.where(later, after[:, None], np.arange(total)[:, None])
            at = (source * BLOCK + np.take_along_axis(arg, source, 0)) * 2
            f = np.broadcast_to(np.arange(filters), at.shape)
            dt = np.zeros((WIDTH, 256 * filters))
            for j in range(WIDTH):
                dt[j] = np.bincount((raw[at + j].astype(np.int64) * filters + f).ravel(), dl.ravel(), 256 * filters)
            dt = dt.reshape(WIDTH, 256, filters)
            grads = [np.einsum("jbf,jef->be", dt, ker), np.einsum("be,jbf->jef", emb, dt), db, x.T @ g + 1e-4 * out, np.array([g.sum()])]
            step += 1
            lr = rate * (1 - 0.9 * epoch / epochs)
            for q, d, a, b in zip(params, grads, m, v):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                q -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(np.einsum("be,jef->jbf", emb, ker), bias, out, float(inter[0]) + odds)


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int) -> list:
    """(doc_id, text, label) of at most rows / 2 labelled documents of each label outside the held-out third."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).alias("label"))
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = [ids.where(f"label = {v}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for v in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most `rows` rows of two numbers
    got = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.octet_length("text") <= longest)
    return got.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 2000, longest: int = 20_000, **how) -> Model:
    rows = sample_rows(docs, labels, label, sample, longest)
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).agg(F.avg(label)).first()[0]
    share = None if known is None else min(max(known, 0.01), 0.99)
    return train([r.text.encode() for r in rows], np.array([r.label for r in rows], float), share=share, **how)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text).

    A score is a function of the text alone, whatever texts stand beside it. Null and empty texts are scored as one block
    of zero bytes, very long texts whole, one at a time. Null doc_ids and repeated rows keep their rows, with equal scores
    for equal texts. A score at the threshold is accepted. Empty table: empty result. Other columns, whatever their names,
    are not read.
    """

    def run(batches):
        paired = model.paired()
        for whole in batches:
            for batch in slices(whole):
                s = scores(model, paired, *bytes_of(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s.astype(float))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text reaches the threshold: rows pass through the network's tasks as they are.

    Null doc_ids and repeated rows are judged as any other; null and empty texts as in `score`."""

    def run(batches):
        paired = model.paired()
        for whole in batches:
            for batch in slices(whole):
                s = scores(model, paired, *bytes_of(batch.column("text")))
                yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
