"""Substring dedup: Rabin-Karp hashes of every 13-word window; windows found in an earlier document are removed.

Counting all windows of a corpus in one shuffle moves three times the text. Equal windows have equal minimizers (the
smallest hash of their 5-word parts), so the count runs in two steps and stays exact:

1. each document sends the distinct minimizers of its windows, about a fifth of its words; a minimizer that only one
   document has rules out its windows;
2. the windows under the others are sent as runs, the consecutive windows of one minimizer. A run that occurs whole in
   an earlier document is repeated whole; where a minimizer has different runs, their windows are counted one by one.

A window is known by its own 64-bit hash and its minimizer's, so that 1e14 windows do not collide by chance. Repeated
windows merge into maximal intervals of words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bytes_of, cut, lists, long, powers, prefix, slices, small, span, unused

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Windows:
    """Every window of some documents: position and document of each, its minimizer and the run it belongs to."""

    def __init__(self, words: Words, size: int, part: int):
        h, ptr, self.p = words.hashes, words.ptr, prefix(words.hashes)
        self.inv, self.size = powers(len(h) + 1, True), size
        self.counts = np.maximum(np.diff(ptr) - size + 1, 0)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        base = np.cumsum(self.counts) - self.counts
        self.at = np.arange(len(self.doc)) - base[self.doc] + ptr[self.doc]
        if not len(self.at):
            self.least = np.zeros(0, np.uint64)
            return
        g = span(self.p, np.arange(len(h) - part + 1), np.arange(part, len(h) + 1), self.inv)
        width, have = size - part + 1, 1
        while have * 2 <= width:  # sliding minimum by doubling
            g = np.minimum(g[:-have], g[have:])
            have *= 2
        if have < width:
            g = np.minimum(g[: len(g) - (width - have)], g[width - have :])
        self.least = g[self.at]

    def firsts(self) -> np.ndarray:
        """Indexes of the windows that begin a run: another minimizer or another document than before."""
        if not len(self.least):
            return np.zeros(0, np.int64)
        new = np.ones(len(self.least), bool)
        new[1:] = (self.least[1:] != self.least[:-1]) | (self.doc[1:] != self.doc[:-1])
        return np.flatnonzero(new)


def text_keys(words: Words, p: np.ndarray) -> np.ndarray:
    """A hash of each text's word sequence: with doc_id it names a row, also where rows share a doc_id."""
    return span(p, words.ptr[:-1], words.ptr[1:], powers(len(words.hashes) + 1, True))


def _scan(size: int, part: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                buf, off = bytes_of(batch.column("text"))
                words = Words(buf, off)
                raw, n = buf.tobytes(), np.diff(words.ptr)
                sha = [hashlib.sha256(b" ".join(raw[off[i] : off[i + 1]].split())).hexdigest() for i in range(len(n))]
                w = Windows(words, size, part)
                first = w.firsts()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), long(n), pa.array(sha, pa.string()), long(text_keys(words, w.p)), lists(w.least[first], np.bincount(w.doc[first], minlength=len(n)))],
                    names=["doc_id", "n_words", "sha", "key", "parts"],
                )

    return run


def _runs(size: int, part: int):
    """For each document with its shared minimizers: the runs under them, with the hashes of their windows."""
    most = size - part + 1

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                words = Words(*bytes_of(batch.column("text")))
                w = Windows(words, size, part)
                first = w.firsts()
                if not len(first):
                    continue
                length = np.diff(np.append(first, len(w.least)))
                # a run is at most as long as a minimizer can reach; periodic texts would make longer ones
                pieces = -(-length // most)
                first, length = np.repeat(first, pieces), np.repeat(length, pieces)
                nth = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first, length = first + nth * most, np.minimum(most, length - nth * most)
                shared = batch.column("shared")
                values = np.asarray(shared.flatten()).view(np.uint64)
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(shared), 0))
                ends = np.cumsum(sizes)
                keep = np.zeros(len(first), bool)
                d, m = w.doc[first], w.least[first]
                bounds = np.searchsorted(d, np.arange(len(sizes) + 1))
                for i in range(len(sizes)):
                    a, b = bounds[i], bounds[i + 1]
                    if a < b:
                        mine = np.sort(values[ends[i] - sizes[i] : ends[i]])
                        at = np.minimum(np.searchsorted(mine, m[a:b]), len(mine) - 1)
                        keep[a:b] = mine[at] == m[a:b]
                first, length, d, m = first[keep], length[keep], d[keep], m[keep]
                if not len(first):
                    continue
                start = w.at[first]
                content = span(w.p, start, start + length + size - 1, w.inv)
                total = int(length.sum())
                each = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
                hashes = span(w.p, each, each + size, w.inv)
                ids = np.asarray(batch.column("doc_id"))[d]
                yield pa.RecordBatch.from_arrays(
                    [long(ids), long(text_keys(words, w.p)[d]), long(m), long(content), pa.array((start - words.ptr[d]).astype(np.int32)), pa.array(length.astype(np.int32)), lists(hashes, length)],
                    names=["doc_id", "key", "part", "run", "start", "n", "hashes"],
                )

    return run


def removed_words(n: int, starts: np.ndarray, masks: np.ndarray, size: int) -> np.ndarray:
    """For each of n words whether a window given by starts and masks covers it; a start of -1 covers all."""
    flags = np.zeros(n + 1, np.int32)
    if (starts < 0).any():
        return np.ones(n, bool)
    for bit in range(size):
        hit = starts[(masks >> bit) & 1 == 1] + bit
        np.add.at(flags, hit, 1)
        np.add.at(flags, np.minimum(hit + size, n), -1)
    return np.cumsum(flags[:-1]) > 0


def _each(batch, size: int, windows: str = "found"):
    """For each text of a batch with its windows, a column of this name: Words, their bytes, and which words go."""
    words = Words(*bytes_of(batch.column("text")))
    keys = text_keys(words, prefix(words.hashes)).view(np.int64)
    raw = words.buf.tobytes()
    for i, found in enumerate(batch.column(windows).to_pylist()):
        mine = np.array([(x["start"], x["mask"]) for x in found or () if x["key"] == keys[i]], np.int64).reshape(-1, 2)
        a, b = words.ptr[i], words.ptr[i + 1]
        yield words, raw, i, removed_words(b - a, mine[:, 0], mine[:, 1], size), keys[i]


def _digest(size: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                removed, sha, keys = [], [], []
                for words, raw, i, gone, key in _each(batch, size):
                    text = raw[words.offsets[i] : words.offsets[i + 1]].split()
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(b" ".join([x for x, g in zip(text, gone.tolist()) if not g])).hexdigest())
                    keys.append(key)
                cols = [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_removed", "kept_sha256"])

    return run


def _rewrite(size: int, columns: list[str], windows: str):
    """The rows without the removed words and the white space behind them; rows left without words go."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                texts, keep = [], []
                for words, raw, i, gone, _ in _each(batch, size, windows):
                    lo, hi, a = words.offsets[i], words.offsets[i + 1], words.ptr[i]
                    if not gone.any():
                        texts.append(batch.column("text")[i].as_py())
                        keep.append(True)
                        continue
                    edges, out, at = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))), [], lo
                    for first, last in edges.reshape(-1, 2):
                        out.append(raw[at : words.starts[a + first]])
                        at = words.starts[a + last] if last < len(gone) else hi
                    texts.append((b"".join(out) + raw[at:hi]).decode("utf-8", "replace"))
                    keep.append(not gone.all())
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
                yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    return run


def repeated_windows(docs: DataFrame, size: int = 13, part: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scan (doc_id, n_words, sha, key), later copies (doc_id, key) and repeated windows (doc_id, key, start, mask).

    Bit i of a mask says that the window `start + i` also starts in a document with a smaller doc_id. Copies of a word
    sequence are known by its digest: all but the smallest doc_id are repeated whole and need no windows.
    """
    docs = docs.select("doc_id", "text")
    scan = cut(docs.mapInArrow(_scan(size, part), "doc_id long, n_words long, sha string, key long, parts array<long>"))
    rows = scan.where(f"doc_id is not null and n_words >= {size}")
    owners = rows.groupBy("sha").agg(F.min("doc_id").alias("owner"), F.count("*").alias("c"))
    copied = cut(owners.where("c > 1").select("sha", "owner"))
    later = rows.select("doc_id", "sha", "key").join(small(copied), "sha").where("doc_id > owner").select("doc_id", "key").distinct()
    later = cut(later)
    own = rows.join(small(later), ["doc_id", "key"], "left_anti")
    parts = own.select("doc_id", F.explode("parts").alias("part"))
    shared = parts.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("part")
    wanted = parts.join(shared, "part", "left_semi").groupBy("doc_id").agg(F.collect_list("part").alias("shared"))
    wanted = cut(wanted)
    texts = _only(docs, wanted.select("doc_id"))
    runs = texts.join(wanted.hint("shuffle_hash"), "doc_id").mapInArrow(
        _runs(size, part), "doc_id long, key long, part long, run long, start int, n int, hashes array<long>"
    )
    runs = cut(runs)
    # a run that a smaller document has too is repeated whole
    whole = runs.groupBy("part", "run", "n").agg(F.min("doc_id").alias("owner"))
    mixed = whole.groupBy("part").agg(F.count("*").alias("c")).where("c > 1").select("part")
    heads = runs.join(whole, ["part", "run", "n"]).where("doc_id = owner")
    heads = heads.join(mixed, "part", "left_semi").select("doc_id", "part", "run", "n", "hashes").dropDuplicates(["part", "run", "n"])
    windows = heads.select("doc_id", "part", "run", "n", F.posexplode("hashes").alias("bit", "window"))
    first = windows.groupBy("part", "window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("part", "window", "a")
    again = windows.join(first, ["part", "window"]).where("doc_id > a")
    again = again.groupBy("part", "run", "n").agg(F.sum(F.expr("shiftleft(1L, bit)")).alias("some"))
    judged = runs.select("doc_id", "key", "part", "run", "start", "n").join(whole, ["part", "run", "n"]).join(again, ["part", "run", "n"], "left")
    mask = F.when(F.col("doc_id") > F.col("owner"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("some"))
    judged = judged.select("doc_id", "key", F.col("start").cast("long").alias("start"), mask.alias("mask")).where("mask is not null")
    return scan.drop("parts"), later, cut(judged)


def _found(judged: DataFrame) -> DataFrame:
    return cut(judged.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "mask")).alias("found")))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids; a short list of ids is broadcast so that other texts do not move."""
    return docs.join(small(ids), "doc_id", "left_semi")


def deduplicate(docs: DataFrame, size: int = 13) -> DataFrame:
    """Remove each word covered by a window of `size` words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for each row.

    Null or empty text: no words, nothing removed. Null doc_id: such a row is kept whole and repeats nothing for
    others. Rows with one doc_id: none repeats the other; each keeps its own result; equal rows get equal results.
    Windows that repeat only within a document stay. Columns besides doc_id and text are not read.
    """
    _check(size)
    docs = docs.select("doc_id", "text")
    scan, later, judged = repeated_windows(docs, size)
    found = _found(judged)
    texts = _only(docs, found.select("doc_id")).join(found.hint("shuffle_hash"), "doc_id")
    done = texts.mapInArrow(_digest(size), "doc_id long, key long, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "key"])
    out = scan.join(later.withColumn("whole", F.lit(True)), ["doc_id", "key"], "left").join(done, ["doc_id", "key"], "left")
    gone = F.col("whole").isNotNull()
    return out.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """The rows of docs, all columns, without the words that `deduplicate` removes; rows left without words go.

    White space between kept words stays as it was. Cases as for `deduplicate`; columns of any name pass through.
    """
    _check(size)
    _, later, judged = repeated_windows(docs, size)
    found = _found(judged.union(later.select("doc_id", "key", F.lit(-1).cast("long"), F.lit(-1).cast("long"))))
    windows = unused("found", docs.columns)
    return docs.join(found.withColumnRenamed("found", windows), "doc_id", "left").select(*docs.columns, windows).mapInArrow(_rewrite(size, docs.columns, windows), docs.schema)


def _check(size: int) -> None:
    if not 6 <= size <= 60:
        raise ValueError("size must be between 6 and 60 words")
