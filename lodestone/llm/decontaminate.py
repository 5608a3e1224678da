"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman alignment scores them.

Words are lower-cased runs of letters and digits. Documents are scanned for the n-grams of the items; all of them are seeds, however
many documents hold them. A document with two seeds of an item (one, where the item has no more) is aligned with it.
Items are taken in blocks that fit a task's memory; documents never move unless they have seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH_LOWER, NO_WORD, Words, bytes_of, cut, lists, powers, prefix, slices, small, span

MATCH, MISS, GAP = 2, -1, -1
BITS = 20


def words_of(texts: pa.Array) -> Words:
    return Words(*bytes_of(texts), white=NO_WORD, values=BYTE_HASH_LOWER)


class Index:
    """The n-grams of some items: words of each item, sorted distinct n-grams, a bitmap that rules most others out."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        w = words_of(pa.array(texts, pa.string()))
        self.n, self.ids = n, ids
        self.items = [w.hashes[w.ptr[i] : w.ptr[i + 1]] for i in range(len(ids))]
        grams = grams_of(w, n)
        self.of = [np.unique(g) for g in grams]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> np.ndarray:
        """Positions in g of the index's n-grams."""
        at = np.flatnonzero(self.bitmap[(g >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return at[:0]
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        return at[self.grams[k] == g[at]]


def grams_of(w: Words, n: int) -> list[np.ndarray]:
    """The n-grams of each text; a text of fewer words has one, all its words, which no longer text has."""
    p, inv, at = prefix(w.hashes), powers(len(w.hashes) + 1, True), np.arange(max(0, len(w.hashes) - n + 1))
    g = span(p, at, at + n, inv) if len(at) else np.zeros(0, np.uint64)
    size = np.diff(w.ptr)
    whole = span(p, w.ptr[:-1], w.ptr[1:], inv) ^ (size.astype(np.uint64) + np.uint64(1)) if len(w.hashes) else np.zeros(len(size), np.uint64)
    return [g[a : a + k - n + 1] if k >= n else whole[i : i + 1] if k else g[:0] for i, (a, k) in enumerate(zip(w.ptr[:-1], size))]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman with linear gaps: the best local score of a against b, and where in b it ends."""
    h = np.zeros(len(b) + 1, np.int64)
    steps, best, end = np.arange(len(b) + 1), 0, 0
    for x in a:
        t = np.maximum(0, h + GAP)
        t[1:] = np.maximum(t[1:], h[:-1] + np.where(b == x, MATCH, MISS))
        h = np.maximum.accumulate(t - GAP * steps) + GAP * steps
        top = int(h.argmax())
        if h[top] > best:
            best, end = int(h[top]), top
    return best, end


def _scan(index):
    def run(batches):
        ix = index.value
        for whole in batches:
            for batch in slices(whole):
                w = words_of(batch.column("text"))
                grams = grams_of(w, ix.n)
                g = np.concatenate(grams)
                hit = ix.find(g)
                if not len(hit):
                    continue
                doc = np.searchsorted(np.cumsum([len(x) for x in grams]), hit, "right")
                which, counts, values = [], [], []
                for i in np.unique(doc):
                    v = np.unique(g[hit[doc == i]])
                    which.append(i)
                    counts.append(len(v))
                    values.append(v)
                ids = batch.column("doc_id").take(pa.array(np.array(which)))
                yield pa.RecordBatch.from_arrays([ids, lists(np.concatenate(values), np.array(counts))], names=["doc_id", "grams"])

    return run


def _aligned(index, threshold: float, enough: int):
    def run(batches):
        ix = index.value
        for whole in batches:
            for batch in slices(whole):
                w, rows = words_of(batch.column("text")), []
                grams = grams_of(w, ix.n)
                for i, (doc_id, items) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("items").to_pylist())):
                    words = w.hashes[w.ptr[i] : w.ptr[i + 1]]
                    for place in items:
                        item, item_id = ix.items[place], ix.ids[place]
                        at = np.flatnonzero(np.isin(grams[i], ix.of[place]))
                        if not len(at):
                            continue
                        best = (0, 0, 0)
                        for part in np.split(at, np.flatnonzero(np.diff(at) > 2 * len(item)) + 1):
                            lo, hi = max(0, part[0] - 2 * len(item)), min(len(words), part[-1] + 2 * len(item) + ix.n)
                            score, end = align(item, words[lo:hi])
                            best = max(best, (score, lo, lo + end))
                        score, lo, end = best
                        if score >= threshold * MATCH * len(item) or score >= MATCH * enough:
                            back, length = align(item[::-1], words[lo:end][::-1])
                            rows.append((doc_id, item_id, score / (MATCH * len(item)), end - length, end))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, enough: int = 40, block: int = 20_000, block_chars: int = 16_000_000) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of each document that holds a copy of a test item.

    score is the alignment's share of a perfect one; a pair is returned from `threshold` on, or if it scores as much as
    `enough` equal words (parts of long items). start_word..end_word counts the document's words.

    Null or empty texts on either side match nothing. An item of fewer than n words is a copy where a document has these
    words and no others: a word or two inside a text say nothing. Null doc_ids and item_ids are left out. Repeated rows
    give one row for each doc_id and item_id, with the best score, also of rows that share an id and differ in text.
    Equal scores: the first place. Empty tables: an empty result. Hot items cost one alignment for each document that
    holds them. Very long texts are read whole, one at a time. Other columns are not read. Items go to the tasks in blocks
    of at most `block` items and block_chars characters, a longer item alone.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text").where("doc_id is not null")
    shape = "doc_id long, item_id long, score double, start_word long, end_word long"
    out = None
    for ids, texts in _blocks(benchmark, block, block_chars):
        ix = Index(ids, texts, n)
        index = spark.sparkContext.broadcast(ix)
        hits = cut(docs.mapInArrow(_scan(index), "doc_id long, grams array<long>").select("doc_id", F.explode("grams").alias("gram")))
        owned = [(i, int(g)) for i, of in enumerate(ix.of) for g in of.view(np.int64)]
        if not owned:
            continue
        # as many rows as the block has n-grams
        grams = cut(spark.createDataFrame(owned, "item long, gram long").repartition(8, "gram"))
        least = grams.groupBy("item").agg(F.least(F.lit(2), F.count("*")).alias("least"))
        seeds = cut(grams.join(least, "item"))
        found = hits.join(small(seeds), "gram").groupBy("doc_id", "item").agg(F.count_distinct("gram").alias("c"), F.first("least").alias("least")).where("c >= least")
        found = cut(found.groupBy("doc_id").agg(F.collect_list("item").alias("items")))
        texts = docs.join(small(found.select("doc_id")), "doc_id", "left_semi")
        got = texts.join(found.hint("shuffle_hash"), "doc_id").mapInArrow(_aligned(index, threshold, enough), shape)
        got = cut(got)
        out = got if out is None else out.union(got)
    if out is None:
        return spark.createDataFrame([], shape)
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def _blocks(benchmark: DataFrame, block: int, chars: int):
    rows = benchmark.where("item_id is not null and length(text) > 0").select("item_id", "text").distinct().orderBy("item_id", "text")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        if ids and (len(ids) >= block or size + len(r.text) > chars):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield ids, texts


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, without the documents that hold a copy of a test item.

    Null doc_ids stay; of rows with one doc_id all stay or go. Other cases as in `contaminated`."""
    found = cut(contaminated(docs, benchmark, **how).select("doc_id").distinct())
    return docs.join(small(found), "doc_id", "left_anti").select(*docs.columns)
