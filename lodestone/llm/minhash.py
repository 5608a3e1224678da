"""Near-duplicate documents from bottom-k sketches of one hash function.

One 64-bit hash orders all word shingles. A document keeps the smallest values of its set: its bottom-k sketch, and of
each residue class of the hash the smallest `depth` values. Inverted lists are kept of these class heads, not of single
values: a common pair of words has one value that a tenth of all documents retain, while `depth` values retained
together name a near-copy. Two sets of similarity 0.8 share a head with probability 0.8**depth in each class, so 32
classes of depth 4 miss such a pair with probability 5e-8, and likelier pairs less. The tests before the exact check
(sign bits 5.5, sketch estimate 5 standard deviations) lose another 3e-7 of the pairs that stand exactly at the
threshold: together less than one of a million such pairs is lost.

Pairs within a list are not expanded. Sets that are equal count as one. Then
1. each set is linked to the list leader with which it shares most lists, and the pair is verified; the components of
   these links leave most lists with a single component, and such lists are done;
2. in the others a set can only be linked through shingles that another of these sets has too. Its own shingles, that
   none else has, bound its similarity to any of them: where no member of a list can reach the threshold it leaves the
   list. The member with the smallest share of own shingles is the nearest to what the list has in common: it becomes
   the hub, all members are verified against it, and the lists are looked at again, for `rounds` times;
3. what is left are the members whose bound does not rule them out and that no hub has: they are joined with the
   members of other components on their rarest shingles. Sets that share o shingles share one of the n - o + 1 rarest
   of each, so this loses no pair, and a copy's rarest shingles are its own edits, not what the group has in common.

A copy with many edits falls out in step 2, one with few edits joins the hub, so the pairs of a group grow with its
members. Links inside a component that is already known change nothing and are not looked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_HASH_LOWER, Words, bytes_of, components, cut, lists, long, mix, powers, prefix, slices, small, span

_DEPTH_FACTORS = (np.random.RandomState(11).randint(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles (A-Z lower-cased); fewer words make one shingle."""
    w = Words(*bytes_of(texts), values=BYTE_HASH_LOWER)
    p, inv = prefix(w.hashes), powers(len(w.hashes) + 1, True)
    n = np.diff(w.ptr)
    all_at = np.arange(max(0, len(w.hashes) - words + 1))
    h = span(p, all_at, all_at + words, inv) if len(all_at) else np.zeros(0, np.uint64)
    out = []
    for i in range(len(n)):
        a, b = w.ptr[i], w.ptr[i + 1]
        if b - a >= words:
            v = np.sort(h[a : b - words + 1])
            keep = np.ones(len(v), bool)
            keep[1:] = v[1:] != v[:-1]
            out.append(v[keep])
        elif b > a:
            out.append(mix(span(p, np.array([a]), np.array([b]), inv) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def heads(values: np.ndarray, ptr: np.ndarray, classes: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the sorted sets values[ptr[i] : ptr[i + 1]]: one key for each residue class that has values, a hash of the
    class and its `depth` smallest values; and the number of keys of each set."""
    sets = len(ptr) - 1
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(sets, np.int64)
    c = np.repeat(np.arange(sets, dtype=np.int64) * classes, np.diff(ptr)) + (values & np.uint64(classes - 1)).astype(np.int64)
    order = np.argsort(c.astype(np.uint16) if sets * classes <= 1 << 16 else c, kind="stable")
    c = c[order]
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    rank = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
    top = rank < depth
    v = values[order[top]] * _DEPTH_FACTORS[rank[top]]
    c = c[start]
    keys = mix(np.add.reduceat(v, np.flatnonzero(rank[top] == 0)) + (c % classes).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return keys, np.bincount(c // classes, minlength=sets)


BITS = 256
#: Differing sign bits up to which a pair of large sets may still be similar: 5.5 standard deviations above the mean
#: for the least cosine that two sets of similarity 0.8 have. Sums of few signs tie, so small sets are allowed more.
BITS_APART, BITS_APART_SMALL = 70, 90


_LANES = np.uint64(0x0101010101010101)


def sign_bits(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """For each set values[ptr[i] : ptr[i + 1]], none empty, BITS bits in four integers: of each bit of four remixed
    hashes, which value most shingles have.

    Eight bits are counted in one sum: a byte of the sum counts one bit of up to 255 shingles.
    """
    out = np.zeros((len(ptr) - 1, 4), np.int64)
    if not len(out):
        return out
    n = np.diff(ptr)
    blocks = -(-n // 255)
    first = np.cumsum(blocks) - blocks
    start = np.repeat(ptr[:-1], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    for r in range(4):
        x = mix(values ^ _DEPTH_FACTORS[40 + r])
        ones = np.zeros((len(n), 8, 8), np.int64)  # set, byte, bit
        for bit in range(8):
            sums = np.add.reduceat((x >> np.uint64(7 - bit)) & _LANES, start)
            ones[:, :, bit] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        out[:, r] = np.packbits((2 * ones > n[:, None, None]).reshape(len(n), 64), axis=1).view(np.int64)[:, 0]
    return out


def least_size(threshold_percent: int) -> int:
    """Sets smaller than this are linked only with equal ones: n of n + 1 is below the threshold."""
    return next(n for n in range(1, 102) if 100 * n >= threshold_percent * (n + 1)) if threshold_percent < 100 else 1 << 60


def _sketch(words: int, k: int, classes: int, depth: int, least: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(batch.column("text"), words)
                n = np.array([len(s) for s in sets], np.int64)
                low = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                high = np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64)
                none = np.zeros(0, np.uint64)
                big = [s for s in sets if len(s) >= least]
                ptr = np.cumsum([0, *map(len, big)])
                values = np.concatenate(big) if big else none
                key, each = heads(values, ptr, classes, depth)
                counts = np.zeros((3, len(n)), np.int64)
                counts[:, n >= least] = each, np.minimum(n[n >= least], k), np.full(len(big), 4)
                parts = key, np.concatenate([s[:k] for s in big]) if big else none, sign_bits(values, ptr).reshape(-1).view(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("pick"), long(n), long(low), long(high)]
                    + [lists(x, c) for x, c in zip(parts, counts)],
                    names=["doc_id", "pick", "n", "low", "high", "keys", "sketch", "signs"],
                )

    return run


def _verify(words: int, percent: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "ta"):
                a, b = (shingle_sets(batch.column(c), words) for c in ("ta", "tb"))
                keep = []
                for x, y in zip(a, b):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tokens(words: int):
    """doc_id, pool, token for each shingle of each text."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(batch.column("text"), words)
                n = np.array([len(s) for s in sets], np.int64)
                ids, pools = (long(np.repeat(np.asarray(batch.column(c)), n)) for c in ("doc_id", "pool"))
                yield pa.RecordBatch.from_arrays([ids, pools, long(np.concatenate(sets))], names=["doc_id", "pool", "token"])

    return run


class _Search:
    """The pairs (a, b) of one search: `rows` is (doc_id, text), `sets` their sizes, sketches and sign bits."""

    def __init__(self, rows: DataFrame, sets: DataFrame, words: int, percent: int, k: int):
        self.rows, self.sets, self.words, self.percent, self.k = rows, sets, words, percent, k
        self.floor = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / k) ** 0.5

    def estimate(self) -> str:
        """Share of the k smallest values of both sketches together that both have: the union-sketch estimate."""
        # the union appears once: Spark would work out a repeated part for every pair, before the cheap tests
        size = f"least({self.k}, greatest(size(sa), size(sb)))"
        union = f"slice(array_sort(array_union(sa, sb)), 1, {size})"
        return f"size(array_intersect(array_intersect({union}, sa), sb)) >= {self.floor} * {size}"

    def likely(self) -> str:
        """The cheap tests that every similar pair passes: sizes and sign bits."""
        apart = " + ".join(f"bit_count(ba[{i}] ^ bb[{i}])" for i in range(4))
        signs = f" and {apart} <= if(least(na, nb) <= {self.k}, {BITS_APART_SMALL}, {BITS_APART})" if self.percent >= 80 else ""
        return f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)" + signs

    def reach(self, na: str, ua: str, nb: str, ub: str) -> str:
        """Whether sets of these sizes, with so many shingles of their own, can reach the threshold: what they share is at
        most the lesser rest, and must be percent / (100 + percent) of both sizes."""
        return f"(100 + {self.percent}) * least({na} - {ua}, {nb} - {ub}) >= {self.percent} * ({na} + {nb})"

    def both(self, pairs: DataFrame, side: DataFrame) -> DataFrame:
        """pairs (a, b), a cut table, with each column x of side (doc_id, ...) as xa for a and xb for b.

        The pairs are sent to the rows and what each side has meets by pair: a document in many pairs is no hot key."""
        ends = small(pairs)
        named = lambda end: side.select(F.col("doc_id").alias("id"), *(F.col(c).alias(f"{c}{end}") for c in side.columns if c != "doc_id"))
        one, two = (named(end).join(ends, F.col("id") == F.col(end)).drop("id") for end in "ab")
        return one.join(two, ["a", "b"])

    def with_sketches(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), a cut table, that pass the cheap tests and the estimate."""
        side = self.sets.select("doc_id", "n", F.col("sketch").alias("s"), F.col("signs").alias("b"))
        return cut(self.both(pairs, side).where(f"{self.likely()} and {self.estimate()}").select("a", "b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), a cut table, whose full sets reach the threshold."""
        both = self.both(pairs, self.rows.select("doc_id", F.col("text").alias("t")))
        return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verify(self.words, self.percent), "a long, b long"))

    def tokens(self, ids: DataFrame) -> DataFrame:
        """doc_id, pool, token for the shingles of the documents of ids(doc_id, pool), a cut table."""
        return self.rows.join(small(ids), "doc_id").select("doc_id", "pool", "text").mapInArrow(_tokens(self.words), "doc_id long, pool long, token long")

    def own(self, ids: DataFrame) -> DataFrame:
        """doc_id, n, u for the documents of ids(doc_id), a cut table: u of the n shingles are in no other of them."""
        alone = self.tokens(ids.withColumn("pool", F.lit(0).cast("long"))).groupBy("token").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id"))
        alone = alone.where("c = 1").groupBy("doc_id").agg(F.count("*").alias("u"))
        sizes = self.sets.select("doc_id", "n").join(small(ids), "doc_id")
        return cut(sizes.join(alone, "doc_id", "left").select("doc_id", "n", F.coalesce("u", F.lit(0)).alias("u")))

    def rarest(self, inside: DataFrame) -> DataFrame:
        """Pairs of documents of different components that have one of their rarest shingles in common; cut.

        inside(key, doc_id, n, c): a document with a list in common is in the same pool, so a link never leaves a pool, and
        the component with most members of a pool is not compared with itself. A shingle's rank in its document, from the
        rarest in the pool on, says with which sizes it counts: sizes are dealt in buckets of 3 %, and a shingle is sent
        to the buckets for which it may be the first common one.
        """
        heads = inside.groupBy("key").agg(F.min("doc_id").alias("a"))
        pools = components(inside.join(heads, "key").select("a", F.col("doc_id").alias("b"))).select(F.col("id").alias("doc_id"), F.col("component").alias("pool"))
        ids = cut(inside.select("doc_id", "n", "c").distinct().join(small(pools), "doc_id"))
        tokens = cut(self.tokens(ids.select("doc_id", "pool")))
        often = tokens.groupBy("pool", "token").agg(F.count("*").alias("df")).where("df > 1")
        shared = tokens.join(often, ["pool", "token"])
        # the shingles that a document has for itself alone come first, in any order
        last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("df"), "token"))
        shared = shared.withColumn("last", last).join(small(ids.drop("pool")), "doc_id").withColumn("rank", F.expr("n - last + 1"))
        bucket, p = lambda n: f"cast(floor(ln({n}) / ln(1.03)) as int)", self.percent
        rank_until = lambda n, m: f"{n} - cast(ceil({p} * ({n} + {m}) / {100 + p}) as long) + 1"
        low = f"greatest(cast(ceil(n * {p} / 100) as long), 1)"
        each = shared.withColumn("own", F.expr(bucket("n"))).withColumn("other", F.expr(f"explode(sequence({bucket(low)}, {bucket(f'(n * 100 / {p} + 1)')}))"))
        least = f"greatest({low}, cast(floor(pow(1.03, other)) as long) - 1)"
        each = cut(each.where(f"rank <= {rank_until('n', least)}").select("pool", "token", "doc_id", "n", "c", "rank", "own", "other"))
        one, two = (each.select("pool", "token", F.col(f).alias("f"), F.col(g).alias("g"), F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("rank").alias(f"r{x}")) for x, f, g in (("x", "own", "other"), ("y", "other", "own")))
        one = one.join(_main(ids, "pool"), "pool").where("cx <> main")
        fits = f"cx <> cy and (cy = main or x < y) and 100 * least(nx, ny) >= {p} * greatest(nx, ny) and rx <= {rank_until('nx', 'ny')} and ry <= {rank_until('ny', 'nx')}"
        return cut(one.join(two, ["pool", "token", "f", "g"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _mixed(lists_: DataFrame, comps: DataFrame) -> DataFrame:
    """key, doc_id, c (component) and the other columns of the lists that hold more than one component; cut."""
    rest = [x for x in lists_.columns if x not in ("key", "doc_id", "c")]
    inside = lists_.drop("c").join(comps, F.col("doc_id") == F.col("id"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"), *rest)
    split = inside.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
    return cut(inside.join(split, "key", "left_semi"))


def _main(members: DataFrame, group: str) -> DataFrame:
    """group, main: the component c with most members of each group."""
    return members.groupBy(group, "c").agg(F.count("*").alias("m")).groupBy(group).agg(F.max_by("c", F.struct("m", -F.col("c"))).alias("main"))


def _within_reach(inside: DataFrame, search: _Search) -> DataFrame:
    """The members of the lists that some size in their list, and at least percent of theirs, lets reach the threshold."""
    least = inside.groupBy("key").agg(F.min("n").alias("least"))
    other = f"greatest(least, cast(ceil(n * {search.percent} / 100) as long))"
    return inside.join(least, "key").where(search.reach("n", "u", other, "0")).drop("least")


def _pick(docs: DataFrame) -> DataFrame:
    """doc_id, text, pick: one row of each doc_id is picked, the text of the least hash where a doc_id has several."""
    docs = docs.select("doc_id", "text")
    twice = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    if twice.isEmpty():
        return docs.withColumn("pick", F.col("doc_id").isNotNull())
    again = docs.join(small(twice), "doc_id", "left_semi")
    again = again.groupBy("doc_id", "text").agg(F.count("*").alias("c"))
    first = cut(again.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("first")))
    again = again.join(first, "doc_id").withColumn("pick", F.xxhash64("text") == F.col("first"))
    again = again.select("doc_id", "text", F.explode(F.transform(F.sequence(F.lit(1), "c"), lambda i: F.col("pick") & (i == 1))).alias("pick"))
    return docs.join(small(twice), "doc_id", "left_anti").withColumn("pick", F.col("doc_id").isNotNull()).union(again)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 64, classes: int = 32, depth: int = 4, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets; component_id is the smallest
    doc_id that links reach, kept says that it is the document's own.

    Null or empty text, or only white space: an empty set, linked with nothing. Fewer words than a shingle: the whole
    sequence is the one shingle. Null doc_id: in no component (component_id null) and not kept. Repeated rows: each gets
    a row. Of rows with one doc_id and different texts the one of the least hash is looked at for links; all get its
    component, each its own n_shingles. Ties of hubs go to the smallest doc_id. An empty table gives an empty result.
    Very long texts are read whole, one at a time. Columns besides doc_id and text are not read.
    """
    docs = _pick(docs)
    shape = "doc_id long, pick boolean, n long, low long, high long, keys array<long>, sketch array<long>, signs array<long>"
    sets = cut(docs.mapInArrow(_sketch(words, k, classes, depth, least_size(percent)), shape))
    named = sets.where("pick and n > 0").select("doc_id", "n", "low", "high")
    groups = cut(named.groupBy("n", "low", "high").agg(F.min("doc_id").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c"))
    member = cut(named.join(small(groups), ["n", "low", "high"]).where("doc_id <> leader").select("doc_id", "leader"))
    distinct = sets.where("pick").join(small(member), "doc_id", "left_anti")
    keys = distinct.select("doc_id", F.explode("keys").alias("key"))
    tops = keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last")
    listed = cut(keys.join(tops.drop("last"), "key"))
    stars = listed.where("doc_id > leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("c"))
    search = _Search(docs.where("pick").select("doc_id", "text"), sets.where("pick").select("doc_id", "n", "sketch", "signs"), words, percent, k)

    best = cut(stars.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b"))
    links = search.verified(search.with_sketches(best))
    comps = components(links)
    inside = _mixed(listed.select("key", "doc_id"), small(comps))
    if not inside.isEmpty():
        inside = inside.join(small(search.own(cut(inside.select("doc_id").distinct()))), "doc_id")
        tried = best
        inside = _mixed(_within_reach(inside, search), small(comps))
        for turn in range(rounds):
            # later hubs are looked for outside the list's largest component, whose members had theirs
            hubs = inside.join(_main(inside, "key"), "key").where("c <> main") if turn else inside
            hubs = hubs.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "doc_id", "n", "u", "c")).alias("h"))
            pairs = inside.join(hubs, "key").where(f"c <> h.c and {search.reach('n', 'u', 'h.n', 'h.u')}")
            pairs = pairs.select(F.least("doc_id", "h.doc_id").alias("a"), F.greatest("doc_id", "h.doc_id").alias("b")).distinct()
            pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
            found = search.verified(search.with_sketches(pairs))
            tried = tried.union(pairs)
            if found.isEmpty():
                break
            links = links.union(found)
            comps = components(links)
            inside = _mixed(inside, small(comps))
        if not inside.isEmpty():
            rest = search.verified(search.with_sketches(cut(search.rarest(inside).join(tried, ["a", "b"], "left_anti"))))
            if not rest.isEmpty():
                comps = components(links.union(rest))

    where = member.withColumnRenamed("leader", "id").join(comps, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    where = where.union(comps.select("id", "component"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(where, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
