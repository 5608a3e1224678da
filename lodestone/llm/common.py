"""Shared parts of the training-data operators: tables, shared scratch folder, word hashing, components.

Words are runs of bytes outside a separator set. They are hashed from the Arrow buffers with numpy: a polynomial
(Rabin-Karp) prefix sum modulo 2**64 gives every word's hash without a Python object per word.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table may be broadcast, as it lies in a hash table: each row counts 48 bytes besides its columns.
BROADCAST_BYTES = 64 << 20
#: Edges up to which the driver finds components by itself: 8 MB. More are contracted by the executors.
DRIVER_EDGES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scratch tables in the folder that driver and executors share -------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; where that is unset (tests, one machine) a local folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_remove_local, base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _remove_local(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: its lineage ends there.

    Tasks put their files in place themselves, where else the driver renames one after the other: the path is new, and
    nobody reads it before the job is done."""
    path = path or scratch_dir(df.sparkSession)
    df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (a cut table) marked for broadcast if it takes at most `most` bytes, else df for a shuffled join.

    Fixed columns count 8 bytes, strings and arrays what they hold."""
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array")]
    fixed = 48 + 8 * len(df.columns)
    length = {f.name: F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else 8 * F.size(f.name) for f in df.schema.fields if f.name in wide}
    each = sum((F.coalesce(x, F.lit(0)) for x in length.values()), F.lit(fixed))
    size = df.agg(F.sum(each.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as make it differ from all columns."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def held_out(doc_id: str = "doc_id"):
    return (F.crc32(F.col(doc_id).cast("string")) % 3) == 1


# --- hashing ----------------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for words of letters: all ASCII but letters; and for words of letters and digits.
NO_LETTER = np.ones(256, bool)
NO_LETTER[0x80:] = False
for _c in range(26):
    NO_LETTER[65 + _c] = NO_LETTER[97 + _c] = False
NO_WORD = NO_LETTER.copy()
NO_WORD[48:58] = False
BYTE_HASH = np.random.RandomState(7).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_HASH_LOWER = BYTE_HASH.copy()
BYTE_HASH_LOWER[65:91] = BYTE_HASH[97:123]
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied in place to a fresh array."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix(h: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial whose coefficients are h; ranges are read with `span`."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=out[1:], dtype=np.uint64)
    return out


def span(p: np.ndarray, start: np.ndarray, end: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of the elements start..end-1: the same for equal sequences wherever they stand."""
    return mix((p[end] - p[start]) * inv[start])


class Words:
    """hashes, start and end byte of all words of some texts, and ptr: text i has the words ptr[i]..ptr[i+1]-1."""

    __slots__ = ("hashes", "starts", "ends", "ptr", "buf", "offsets")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, white=WHITE, values=BYTE_HASH, piece: int = 1 << 20):
        self.buf, self.offsets = buf, offsets
        hashes, starts, ends, a, n = [], [], [], 0, len(buf)
        while a < n:
            b = min(a + piece, n)
            if b < n:  # pieces end behind a separator, so that no word is cut
                back = np.flatnonzero(white[buf[a:b]])
                if len(back):
                    b = a + int(back[-1]) + 1
                else:
                    while b < n and not white[buf[b - 1]]:
                        ahead = np.flatnonzero(white[buf[b : b + piece]])
                        b = b + int(ahead[0]) + 1 if len(ahead) else min(b + piece, n)
            x = buf[a:b]
            word = ~white[x]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
            inner = inner[(inner > 0) & (inner < b - a)]
            first[inner] = word[inner]
            last[inner - 1] = word[inner - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            p = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(values[x] * powers(len(x)), out=p[1:], dtype=np.uint64)
            hashes.append(span(p, s, e, powers(len(x), True)))
            starts.append(s + a)
            ends.append(e + a)
            a = b
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.ptr = np.searchsorted(self.starts, offsets)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its texts; a null counts as an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20):
    """Parts of a batch whose texts have at most `most` bytes together (or one longer text)."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets = bytes_of(col)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo)
        lo = hi


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list<int64> array: counts[i] of the values go to row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64()))


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


# --- connected components ------------------------------------------------------------------------------------------


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, component) for every end of edges(a, b): component is the smallest id that can be reached. A cut table.

    Up to `most` edges (DRIVER_EDGES) are joined on the driver. Beyond, alternating large-star and small-star steps. Only
    minima are gathered for a node, never its neighbours, and they are combined before the shuffle; the joins on a hub's
    rows are sort-merge joins that AQE splits where a key has more rows than a task should. Empty input gives an empty
    table.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    if e.count() <= (DRIVER_EDGES if most is None else most):
        found = e.toArrow()
        ids, least = smallest_reached(*(found.column(c).to_numpy() for c in "uv"))
        return cut(e.sparkSession.createDataFrame(pa.table({"id": long(ids), "component": long(least)}), "id long, component long"))
    e = cut(e.distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return cut(stars.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the edges (u, v), and for each the smallest that can be reached."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)  # a root is hung below the least one it meets, so there are no cycles
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return ids, ids[root]


def _stars(e: DataFrame) -> bool:
    """Whether each u has one v and no v is a u as well: then v is the component of u."""
    ends = e.select("u", F.lit(1).alias("up")).union(e.select("v", F.lit(0)).distinct())
    return ends.groupBy("u").agg(F.count("*").alias("n"), F.sum("up").alias("up")).where("up > 1 or up = 1 and n > 1").isEmpty()


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list, value, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of the same keys that come before in (bucket, order).

    Rows are summed within (keys, bucket), buckets among themselves: a key with a third of all rows is spread over as
    many tasks as it has buckets. `bucket` must not decrease along the order and may not be null.
    """
    from pyspark.sql import Window

    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, bucket, F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    same = F.lit(True)
    left, right = df.withColumn("_inner", F.coalesce(inner, F.lit(0))).alias("l"), sums.alias("r")
    for k in [*keys, bucket]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).select("l.*", (F.col("l._inner") + F.col("r._before")).cast("long").alias(name)).drop("_inner")
