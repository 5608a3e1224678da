"""Quality rules: base rules on word statistics, then robust multivariate outliers per language and source.

For each (lang, source) the minimum-covariance-determinant estimate of location and scatter is looked for over all its
rows: from several deterministic starts, concentration steps take the rows with the smallest distances for the next mean
and covariance; after two steps the start whose covariance has the least determinant goes on until the determinant no
longer falls. Each step is an aggregate over all rows, combined before the shuffle, and the estimates are a table with a
row for each group: no group and no list of groups is gathered anywhere. Rows beyond a quantile of the chi-squared
distribution of the squared Mahalanobis distance are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Words, bytes_of, cut, long, powers, prefix, slices, small, span

SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Quantiles of the chi-squared distribution with 5 degrees of freedom: fixed values.
CHI2_5 = {0.5: 4.351, 0.75: 6.626, 0.975: 12.833, 0.999: 20.515, 0.9999: 25.745, 0.99999: 30.856, 0.999999: 35.888}


def _stats(batches):
    spaces = bytes(np.flatnonzero(WHITE).tolist())
    continued = bytes(range(0x80, 0xC0))
    for whole in batches:
        for batch in slices(whole):
            buf, off = bytes_of(batch.column("text"))
            w, raw = Words(buf, off), buf.tobytes()
            n = np.diff(w.ptr)
            chars, symbols, lines, repeats = (np.zeros(len(n), np.int64) for _ in range(4))
            at = np.arange(max(0, len(w.hashes) - 2))
            h = span(prefix(w.hashes), at, at + 3, powers(len(w.hashes) + 1, True))
            for i in range(len(n)):
                t = raw[off[i] : off[i + 1]]
                chars[i] = len(t.translate(None, spaces + continued))
                symbols[i] = len(t) - len(t.translate(None, SYMBOLS))
                if b"\n" in t:
                    full = [x for x in t.split(b"\n") if x.strip()]
                    lines[i] = len(full) - len(set(full))
                if n[i] >= 4:
                    g = h[w.ptr[i] : w.ptr[i + 1] - 2]
                    s = np.sort(g)
                    twice = s[1:][s[1:] == s[:-1]]
                    if len(twice):
                        first = twice[np.minimum(np.searchsorted(twice, g), len(twice) - 1)] == g
                        base = np.zeros(n[i], bool)
                        base[: len(g)] |= first
                        base[1 : len(g) + 1] |= first
                        base[2 : len(g) + 2] |= first
                        repeats[i] = int(base.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")] + [long(x) for x in (n, chars, symbols, lines, repeats)],
                names=["doc_id", "lang", "source", *STATS],
            )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of each whole text; null and empty texts have zeros."""
    shape = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS)
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(_stats, shape)


def transformed() -> list:
    """The statistic vector: log length, mean word length, and square-root shares of the three kinds of junk."""
    n = F.col("n_words").cast("double")
    return [
        F.log1p(n).alias("x0"),
        (F.col("word_chars") / n).alias("x1"),
        F.sqrt(F.col("n_symbols") / n).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / n).alias("x3"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x4"),
    ]


D = 5
GROUP = ["lang", "source"]
#: Least standard deviation of each coordinate: a constant statistic must not reject every other value. A twelfth of the
#: words in repeated lines, or 0.43 of them in repeated windows, reject a text where no other text has any.
FLOOR = [0.5, 0.75, 0.1, 0.05, 0.11]
ESTIMATE = "lang string, source string, start int, e array<double>, logdet double, before double"


def _distance():
    """Squared Mahalanobis distance of x0..x4, by a lookup of the group's mean and inverse covariance (column `e`)."""
    d = [F.col(f"x{i}") - F.col("e")[i] for i in range(D)]
    total, k = F.lit(0.0), D
    for i in range(D):
        for j in range(i, D):
            total = total + d[i] * d[j] * F.col("e")[k]
            k += 1
    return total


def _beside(rows: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with columns of a cut table that has a row for each value of the keys, nulls included: broadcast if small."""
    table = small(table.select(*[F.col(k).alias(f"{k}_") for k in keys], *columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return rows.join(table, same).drop(*[f"{k}_" for k in keys])


def packed(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], float]:
    """Mean and doubled upper triangle of the inverse covariance, and the logarithm of the determinant."""
    cov = np.array(cov, float)
    for i in range(D):
        cov[i, i] = max(cov[i, i], FLOOR[i] ** 2)
    # floors may have raised only some variances; shrinking the others' correlations keeps the matrix well conditioned
    s = np.sqrt(np.diag(cov))
    c = 0.9 * cov / np.outer(s, s) + 0.1 * np.eye(D)
    inv = np.linalg.inv(c) / np.outer(s, s)
    return [*map(float, mean), *(float(inv[i, j]) * (1 if i == j else 2) for i in range(D) for j in range(i, D))], float(np.linalg.slogdet(c)[1] + 2 * np.log(s).sum())


UPPER = [(i, j) for i in range(D) for j in range(i, D)]


def _sums() -> list:
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in UPPER]]


def _moments(r) -> tuple[np.ndarray, np.ndarray]:
    mean, cov = np.array([r[f"s{i}"] for i in range(D)]) / r["n"], np.zeros((D, D))
    for i, j in UPPER:
        cov[i, j] = cov[j, i] = r[f"p{i}{j}"] / r["n"] - mean[i] * mean[j]
    return mean, cov


def _estimates(make):
    """mapInArrow function: make(row) gives the (start, mean, covariance) triples of a group's row of sums."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for start, mean, cov in make(r):
                    out.append((r["lang"], r["source"], start, *packed(mean, cov), r.get("before", float("inf"))))
            if out:
                types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["lang", "source", "start", "e", "logdet", "before"])

    return run


def _starts(r):
    """Medians with the spread of the quartiles, all rows' mean and covariance, medians with the floors."""
    q = np.array([r[f"q{i}"] for i in range(D)])
    return [(0, q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2)), (1, *_moments(r)), (2, q[:, 1], np.diag(np.square(FLOOR)))]


def _concentrate(rows: DataFrame, est: DataFrame, keep: float) -> DataFrame:
    """The estimates from the rows that are nearest by the estimates before; cut."""
    # rows cut off at a quantile have too small a scatter: the factor for `keep` of a normal sample
    scale = keep / _chi2_share(keep)
    far = _beside(rows, est, GROUP, ["start", "e", "logdet"]).withColumn("d2", _distance()).drop("e")
    by = [*GROUP, "start"]
    bound = cut(far.groupBy(*by).agg(F.percentile_approx("d2", keep, 2000).alias("h")))
    near = _beside(far, bound, by, ["h"]).where("d2 <= h").groupBy(*by).agg(*_sums(), F.first("logdet").alias("before"))

    def next_one(r):
        mean, cov = _moments(r)
        return [(r["start"], mean, cov * scale)]

    return cut(near.mapInArrow(_estimates(next_one), ESTIMATE))


def fit(rows: DataFrame, keep: float = 0.75, steps: int = 12, tolerance: float = 0.01) -> DataFrame:
    """lang, source, start, e (packed estimate), logdet: a row for each group, from all the rows (lang, source, x0..x4), a
    cut table. Steps end when no logdet changes by more than tolerance, at the latest after `steps`."""
    quartiles = [F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i in range(D)]
    est = cut(rows.groupBy(*GROUP).agg(*quartiles, *_sums()).mapInArrow(_estimates(_starts), ESTIMATE))
    for step in range(steps):
        est = _concentrate(rows, est, keep)
        if step == 1:
            best = est.groupBy(*GROUP).agg(F.min_by(F.struct("start", "e", "logdet", "before"), F.struct("logdet", "start")).alias("b"))
            est = cut(best.select(*GROUP, "b.*"))
        if step > 1 and not (est.agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0] or 0) > tolerance:
            break
    return est


def _chi2_share(keep: float) -> float:
    """Share of the chi-squared (D + 2) mass below the `keep` quantile of chi-squared (D), by summing its density."""
    x = np.linspace(0, 60, 60_001)[1:]
    low = x ** (D / 2 - 1) * np.exp(-x / 2)
    high = x ** (D / 2) * np.exp(-x / 2)
    at = int(np.searchsorted(np.cumsum(low) / low.sum(), keep))
    return float(high[: at + 1].sum() / high.sum())


def judge(docs: DataFrame, limit: float = CHI2_5[0.999999], min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null where base_failed), kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated three-word windows.
    The others are rejected if their squared Mahalanobis distance within their lang and source is above limit.

    Null or empty text: no words, so base_failed. Null lang or source: a group of their own. A group whose statistics
    are constant gets floors for its variances, so ties do not reject. A distance at the limit is kept. Null doc_id and
    repeated rows keep their rows. Very long texts are read whole. An empty table gives an empty result. Columns besides
    doc_id, text, lang and source are not read.
    """
    stats = cut(statistics(docs)).withColumn("base_failed", F.expr(f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words"))
    rows = cut(stats.where("not base_failed").select(*GROUP, *transformed()))
    good = _beside(stats.where("not base_failed").select("*", *transformed()), fit(rows), GROUP, ["e"]).withColumn("distance", _distance())
    good = good.select("doc_id", *STATS, "base_failed", "distance", (F.col("distance") <= limit).alias("kept"))
    bad = stats.where("base_failed").select("doc_id", *STATS, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.union(bad)
