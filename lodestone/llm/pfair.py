"""Mixing sources to target weights by Pfair scheduling.

Time is cut in slots, one block of documents each. Block j of a source with weight w is released at slot
floor(j / w) and due by ceil((j + 1) / w); the earliest deadline among the released blocks goes next. The number of
blocks of a source in any prefix of the stream then differs from its weight's share by less than one.

Weights are taken as exact rationals, never rounded, so the bound holds against the target weights however long the
stream is and however many sources it has. The driver works the schedule out block by block, in exact integers: a heap
step and 8 bytes for each block, none for a document; each block finds its slot by its number. When a source has no
blocks left a new phase begins, in which the others' weights share the stream. All documents are placed, each once.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, small

ROWS_IN_A_BUCKET = 20_000


def integer_weights(weights: dict, slots: int) -> dict:
    """Integers of sum max(slots, len(weights)), at least 1 each, nearest to the weights (largest remainders)."""
    total, slots = sum(weights.values()), max(slots, len(weights))
    out = {k: max(1, int(Fraction(w) * slots / Fraction(total))) for k, w in weights.items()}
    order = sorted(weights, key=lambda k: (float(Fraction(weights[k]) * slots / Fraction(total)) - out[k], str(k)), reverse=True)
    while sum(out.values()) != slots:
        more = sum(out.values()) < slots
        for k in order if more else reversed(order):
            if sum(out.values()) == slots:
                break
            if more or out[k] > 1:
                out[k] += 1 if more else -1
    return out


def period(q: dict) -> list:
    """The sources of one period's slots: earliest pseudo-deadline first among the released blocks."""
    total, waiting, ready, slots = sum(q.values()), [], [], []
    for k, w in q.items():
        heapq.heappush(waiting, (0, str(k), k, 0))
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, name, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // q[k]), name, k, j))
        _, name, k, j = heapq.heappop(ready)
        slots.append(k)
        heapq.heappush(waiting, ((j + 1) * total // q[k], name, k, j + 1))
    return slots


def exact(weights: dict) -> dict:
    """Integers in the very proportions of the weights."""
    parts = {k: Fraction(w) for k, w in weights.items()}
    scale = math.lcm(*(p.denominator for p in parts.values()))
    return {k: p.numerator * (scale // p.denominator) for k, p in parts.items()}


def plan(blocks: dict, weights: dict) -> dict:
    """The slot of each block of each source, in the order of the blocks."""
    out = {k: array("q") for k, n in blocks.items() if n > 0}
    q = exact({k: weights[k] for k in out}) if out else {}
    total, at = sum(q.values()), 0
    # a phase's first blocks are all released at its start, due in this order: only those that are reached cost a step
    first = sorted(out, key=lambda k: (-q[k], str(k)))
    rank = {k: i for i, k in enumerate(first)}
    while first:
        waiting, ready, new, t = [], [], 0, 0
        while True:
            while waiting and waiting[0][0] <= t:
                _, i, k, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // q[k]), i, k, j))
            if new < len(first) and (not ready or -(-total // q[first[new]]) <= ready[0][0]):
                k, j, new = first[new], 0, new + 1
            else:
                _, _, k, j = heapq.heappop(ready)
            out[k].append(at + t)
            t += 1
            if len(out[k]) == blocks[k]:
                break
            heapq.heappush(waiting, ((j + 1) * total // q[k], rank[k], k, j + 1))
        first.remove(k)
        total -= q[k]
        at += t
    return out


def tempered(sizes: dict, power: float = 0.5) -> dict:
    """Target weights: sizes to a power below 1, so that small sources gain."""
    return {k: float(n) ** power for k, n in sizes.items()}


def mix(docs: DataFrame, weights: dict | None = None, block: int = 64, slots: int = 1024, power: float = 0.5, whole: bool = False) -> DataFrame:
    """doc_id, source, block, slot, place and position for each row of docs(doc_id, source).

    Documents of a source are dealt into blocks of `block` in the order of a hash of doc_id; `slot` is the block's
    place in the stream, `place` the document's in its block, position = slot * block + place orders the stream.
    weights: target weight of each source, all positive; sources that it does not name, and all by default, get their
    size to the power `power`. whole: all columns of docs are returned, but for any that have one of the new names.

    Null source: a source of its own. Null doc_id: last in its source. Rows with one doc_id stand next to each other in
    unspecified order; equal rows are interchangeable. Empty table: empty result. Only one number for each source goes
    to the driver, and one for each block comes back, in a table with `slots` blocks a row. A source with a third of all
    rows is numbered in buckets.
    """
    new = ["block", "slot", "place", "position"]
    mine = [c for c in docs.columns if c not in new] if whole else ["doc_id", "source"]
    rows = docs.select("doc_id", "source", F.struct(*mine).alias("row"))
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    if not sizes:
        return docs.select(*mine, *[F.lit(0).cast("int" if c == "place" else "long").alias(c) for c in new])
    target = tempered(sizes, power) | {k: w for k, w in (weights or {}).items() if k in sizes}
    placed = plan({k: -(-n // block) for k, n in sizes.items()}, target)
    buckets = max(1, sum(sizes.values()) // ROWS_IN_A_BUCKET)
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.expr(f"floor((h / 18446744073709551616D + 0.5D) * {buckets}L)"))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(buckets + 1)).otherwise(F.col("bucket")))
    rows = running_total(rows, ["source"], "bucket", ["h", "doc_id"], F.lit(1), "number")
    rows = rows.withColumns({"block": F.floor(F.col("number") / block), "place": (F.col("number") % block).cast("int")})
    data = [(k, i // slots, at[i : i + slots]) for k, at in placed.items() for i in range(0, len(at), slots)]
    names, types = ["s", "part", "places"], [pa.string(), pa.int64(), pa.list_(pa.int64())]
    table = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*data), types)], names=names))
    table = small(table)
    b = F.col("block")
    found = rows.join(table, F.col("source").eqNullSafe(F.col("s")) & (F.floor(b / slots) == F.col("part")))
    out = found.select("row.*", "block", F.get("places", (b % slots).cast("int")).alias("slot"), "place")
    return out.withColumn("position", F.col("slot") * block + F.col("place"))
