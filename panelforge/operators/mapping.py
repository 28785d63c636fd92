"""Mapping of old products to new ones: candidates by attributes, names, curves and co-movement; fusion; shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.metrics import pearson, slope

PREDECESSORS = ("Discontinued", "Declining")
#: Suffixes that mark a generation, in order of precedence.
MARKERS = (
    r"\s+mk\s*(?:ii|iii|iv|v|vi|\d+)$", r"\s+gen\s*\d+$", r"\s+v\s*\d+$", r"\s+plus$", r"\s+pro$", r"\s+(?:lite|sport)$",
    r"\s+(?:ii|iii|iv|v|vi)$", r"\s+\d+$", r"-20\d{2}$", r"-mk(?:ii|iii|iv|v|vi|\d+)$", r"-gen\d+$", r"-v\d+$",
)
OLDS, PAIRS, TABLE = 1024, 1 << 18, 1 << 22  # older products of a block, pairs compared at once, entries of a table of letters


def candidate_pairs(products: DataFrame, window_days: int = 365, segment: bool = True, status: bool = True) -> DataFrame:
    """Older products beside newer ones of the same family (and segment), launched within the window.

    The family blocks the self-join; the order and window of launches cut what is left.
    """
    keys = ["product_family"] + ["segment"] * segment
    old = products.where(F.col("status").isin(*PREDECESSORS)) if status else products
    cols = [c for c in products.columns if c not in keys]
    new = products.select(*keys, *[F.col(c).alias(f"{c}_new") for c in cols])
    gap = F.datediff("launch_date_new", "launch_date")
    return old.join(new, keys).where((gap > 0) & (gap <= window_days)).withColumn("gap_days", gap)


def attribute_candidates(products: DataFrame, window_days: int = 365) -> DataFrame:
    """Score .30, and more for equal price tier (.20), form factor (.20), category (.10), a gap under 90 days (.10)."""
    p = candidate_pairs(products, window_days).where(F.coalesce(F.arrays_overlap("country", "country_new"), F.lit(False)))
    same = lambda c, w: F.when(F.col(c) == F.col(f"{c}_new"), w).otherwise(0.0)
    score = 0.30 + same("price_tier", 0.20) + same("form_factor", 0.20) + same("product_category", 0.10) + F.when(F.col("gap_days") < 90, 0.10).otherwise(0.0)
    return p.select(F.col("sku_id").alias("old_sku"), F.col("sku_id_new").alias("new_sku"), F.lit("attribute").alias("method"), score.alias("score"))


def normalised(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def name_marker(name: Column) -> Column:
    """The first generation marker that ends a name, or null."""
    return marker_of(normalised(name))


def name_base(name: Column) -> Column:
    """The name without its marker."""
    return base_of(normalised(name))


def marker_of(n: Column) -> Column:
    """name_marker of a normalised name; most names have none, which one expression tells."""
    found = F.coalesce(*[F.trim(F.nullif(F.regexp_extract(n, f"({m})", 1), F.lit(""))) for m in MARKERS])
    return F.when(F.regexp_like(n, F.lit("|".join(MARKERS))), found)


def base_of(n: Column) -> Column:
    """name_base of a normalised name."""
    out = n
    for m in reversed(MARKERS):
        out = F.when(F.regexp_like(n, F.lit(m)), F.trim(F.regexp_replace(n, m, ""))).otherwise(out)
    return F.when(F.regexp_like(n, F.lit("|".join(MARKERS))), out).otherwise(n)


def subsequence(x: str, y: str) -> int:
    """Length of the longest common subsequence, by a bit-parallel recurrence."""
    at: dict[str, int] = {}
    for i, ch in enumerate(x):
        at[ch] = at.get(ch, 0) | (1 << i)
    full = (1 << len(x)) - 1
    s = full
    for ch in y:
        u = s & at.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(x) - s.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over both lengths."""

    def one(x, y):
        if x is None or y is None:
            return None
        return 2.0 * subsequence(x, y) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def letters(names: list[str]) -> np.ndarray:
    """A row of code points for each name, one more than they are, and zeros after its end."""
    size = np.array([len(x) for x in names])
    codes = np.array(names, dtype=f"<U{max(1, size.max())}").view(np.uint32).reshape(len(names), -1) + np.uint32(1)
    return np.where(np.arange(codes.shape[1]) < size[:, None], codes, np.uint32(0))


def subsequences(xs: list[str], ys: list[str]) -> np.ndarray:
    """subsequence of each y (rows) and x (columns); the recurrence runs over all pairs at once, in words as wide as the x need.

    Names of over 64 letters among the x meet the y one by one.
    """
    size = np.array([len(x) for x in xs])
    out = np.zeros((len(ys), len(xs)), np.uint8 if size.max() <= 64 else np.int32)
    for least, kind in ((1, np.uint8), (9, np.uint16), (17, np.uint32), (33, np.uint64)):
        bits = 8 * np.dtype(kind).itemsize
        which = np.flatnonzero((size >= least) & (size <= bits))
        while len(which):
            found = letters([xs[i] for i in which])
            alphabet = np.unique(found[found > 0])
            if len(which) > 1 and len(alphabet) * len(which) > TABLE:
                out[:, which[: len(which) // 2]] = subsequences([xs[i] for i in which[: len(which) // 2]], ys)
                which = which[len(which) // 2 :]
                continue
            table, columns = np.zeros((len(alphabet) + 1, len(which)), kind), np.arange(len(which))
            for i in range(found.shape[1]):
                table[np.where(found[:, i] > 0, np.searchsorted(alphabet, found[:, i]) + 1, 0), columns] |= kind(1 << i)
            table[0] = 0
            order = sorted(range(len(ys)), key=lambda j: len(ys[j]))
            while order:  # the shortest first, and few long ones at once
                n = max(1, min(len(order), PAIRS // max(1, len(ys[order[-1]]))))
                rows, order = order[-n:], order[:-n]
                codes = letters([ys[j] for j in rows])
                to = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
                codes = np.where(alphabet[to] == codes, to + 1, 0)
                s = np.full((n, len(which)), np.iinfo(kind).max, kind)
                m, u = np.empty_like(s), np.empty_like(s)
                for j in range(codes.shape[1]):
                    np.take(table, codes[:, j], axis=0, out=m, mode="clip")
                    np.bitwise_and(s, m, out=u)
                    np.add(s, u, out=m)
                    np.subtract(s, u, out=s)
                    np.bitwise_or(s, m, out=s)
                zeros = np.uint8(bits) - np.bitwise_count(s)
                if len(rows) == len(ys) and len(which) == len(xs):
                    whole = np.empty_like(zeros)
                    whole[rows] = zeros
                    return whole
                out[np.ix_(rows, which)] = zeros
            break
    for i in np.flatnonzero(size > 64):
        out[:, i] = [subsequence(xs[i], y) for y in ys]
    return out


def least_shared(most: int, least: float) -> np.ndarray:
    """For each sum of two lengths up to most, the shortest common subsequence that makes a ratio of at least `least`."""
    both = np.arange(most + 1)
    out = np.maximum(0, np.floor(least * both / 2) - 1)
    for _ in range(4):
        out += np.where(both > 0, 2.0 * out / np.maximum(both, 1), 1.0) < least
    return out.astype(np.int32)


class Names:
    """A column of names as numbers that are equal where names are, -1 for nulls."""

    def __init__(self, column: pa.Array, seen: dict[str, int] | None = None):
        d = column.dictionary_encode()
        seen = {} if seen is None else seen
        to = np.array([seen.setdefault(x, len(seen)) for x in d.dictionary.to_pylist()] + [-1])
        self.rows = to[d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)]
        self.names = list(seen)
        self.size = np.array([len(x) for x in seen], np.int64)

    def different(self, rows: slice) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different names of some rows, their lengths, and each row's place among them, -1 for nulls."""
        which, at = np.unique(self.rows[rows], return_inverse=True)
        nulls = int(len(which) > 0 and which[0] < 0)
        which = which[nulls:]
        return [self.names[i] for i in which], self.size[which], at - nulls


def widened(x: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
    """Rows or columns of x by their place; false where that is -1."""
    if len(at) == x.shape[axis] and (at == np.arange(len(at))).all():
        return x
    out = np.take(x, at, axis, mode="wrap")
    if (at < 0).any():
        out[at < 0 if axis == 0 else (slice(None), at < 0)] = False
    return out


def named_alike(old: list[tuple[Names, Names]], new: list[tuple[Names, Names]], low: np.ndarray, high: np.ndarray, news: slice, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new row, old row, score) of the pairs with similar names in a field; new row i meets the old rows from low[i] up to high[i]."""
    low, high = low[news].astype(np.int32), high[news].astype(np.int32)
    olds = slice(int(low[0]), int(high[-1]))
    compared, similar = [], None
    for (x, m), (y, n) in zip(old, new, strict=True):
        (xs, size_x, a), (ys, size_y, b) = x.different(olds), y.different(news)
        if not xs or not ys:
            continue
        shared = subsequences(xs, ys)
        sizes, length = np.unique(size_y, return_inverse=True)
        need = least_shared(size_x.max() + sizes[-1], least)
        need = need.astype(np.uint8 if need[-1] < 256 else np.int32)[sizes[:, None] + size_x]
        enough = widened(widened(shared >= np.take(need, length, 0), a, 1), b, 0)
        similar = enough if similar is None else similar | enough
        compared.append((enough, shared, size_x, size_y, a, b, m.rows[olds], n.rows[news]))
    if not compared:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    place = np.arange(olds.start, olds.stop, dtype=np.int32)
    r, c = np.nonzero(similar & (place < high[:, None]) & (place >= low[:, None]))
    best = np.full(len(r), np.nan)
    for enough, shared, size_x, size_y, a, b, m, n in compared:
        x, y = a[c], b[r]
        both = size_x[x] + size_y[y]
        ratio = np.where(both > 0, 2.0 * shared[y, x] / np.maximum(both, 1), 1.0)
        score = np.minimum(1.0, 0.5 * ratio + np.where((n[r] >= 0) & (m[c] != n[r]), 0.3, 0.0) + 0.2)
        best = np.fmax(best, np.where(enough[r, c], score, np.nan))
    return r + news.start, c + olds.start, best


def named_in_blocks(batches: Iterator[pa.RecordBatch], fields: int, window: int, least: float) -> Iterator[pa.RecordBatch]:
    """The similar pairs of rows sorted by family, block, old before new, and day."""
    held, last, out, ready = None, None, [], 0
    for batch in batches:
        if not len(batch):
            continue
        keys = [batch.column("product_family"), batch.column("block")]
        first = last != tuple(k[0].as_py() for k in keys)
        last = tuple(k[-1].as_py() for k in keys)
        turns = np.zeros(len(batch), np.int64)
        if len(batch) > 1:
            turns[1:] = np.cumsum(np.logical_or.reduce([pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) for k in keys]))
        # days of one block are as they were, those of two blocks more than any window apart
        days = batch.column("day").to_numpy().astype(np.int64) + (turns << 34)
        is_new = batch.column("new").to_numpy(zero_copy_only=False)
        old, old_days = batch.filter(pa.array(~is_new)), days[~is_new]
        if held is not None and not first:
            old, old_days = pa.Table.from_batches([held[0], old]).combine_chunks().to_batches(), np.concatenate([held[1], old_days])
            old = old[0] if old else held[0]
        open_ = old_days >= (turns[-1] << 34) - (1 << 33)
        held = old.filter(pa.array(open_)), old_days[open_] - (turns[-1] << 34)
        low, high = np.searchsorted(old_days, days[is_new] - window), np.searchsorted(old_days, days[is_new])
        fits = high > low
        new, low, high = batch.filter(pa.array(is_new)).filter(pa.array(fits)), low[fits], high[fits]
        parsed = []
        for k in range(fields):
            markers: dict[str, int] = {}
            parsed.append([(Names(rows.column(f"base_{k}")), Names(rows.column(f"marker_{k}"), markers)) for rows in (old, new)])
        p = 0
        while p < len(new):
            cost = np.arange(1, len(new) - p + 1) * (high[p:] - low[p])
            q = p + max(1, int(np.searchsorted(cost, PAIRS, "right")))
            r, c, score = named_alike([f[0] for f in parsed], [f[1] for f in parsed], low, high, slice(p, q), least)
            p = q
            if len(r):
                method = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(r), np.int32)), ["naming"]).cast(pa.string())
                out.append(pa.RecordBatch.from_arrays([old.column("sku_id").take(pa.array(c)), new.column("sku_id").take(pa.array(r)), method, pa.array(score)], names=["old_sku", "new_sku", "method", "score"]))
                ready += len(r)
            if ready >= PAIRS >> 3:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, ready = [], 0
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def naming_candidates(products: DataFrame, window_days: int = 365, min_similarity: float = 0.70) -> DataFrame:
    """Similar base names of a family; .5 of the similarity, .3 for a new marker, .2 for the family.

    Names are parsed once a product.  A family's products are numbered by launch and cut into blocks of OLDS;
    each is sent to its own block as an old one, and to all blocks up to its own as a new one.  Pairs exist only
    beside the sorted rows of a block, PAIRS at once, and only similar ones leave it.
    """
    fields = [c for c in ("sku_description", "sku_id") if c in products.columns]
    rows = products.where(F.col("product_family").isNotNull() & F.col("launch_date").isNotNull())
    rows = rows.select("product_family", "sku_id", F.unix_date(F.col("launch_date").cast("date")).alias("day"), *[normalised(F.col(c).cast("string")).alias(f"n_{k}") for k, c in enumerate(fields)])
    names = [f(F.col(f"n_{k}")).alias(f"{name}_{k}") for k in range(len(fields)) for name, f in (("base", base_of), ("marker", marker_of))]
    rows = rows.select("product_family", "sku_id", "day", *names)
    rest = rows.columns[1:]
    number = F.row_number().over(W.partitionBy("product_family").orderBy("day", *[c for c in rest if c != "day"]))
    rows = rows.withColumn("own", F.floor((number - 1) / OLDS).cast("int"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(-1), "own")))
    rows = rows.select("product_family", F.when(F.col("at") < 0, F.col("own")).otherwise(F.col("at")).alias("block"), (F.col("at") >= 0).alias("new"), *rest)
    n = len(fields)
    sku = products.schema["sku_id"].dataType
    schema = T.StructType([T.StructField("old_sku", sku), T.StructField("new_sku", sku), T.StructField("method", T.StringType(), False), T.StructField("score", T.DoubleType())])
    return rows.repartition("product_family", "block").sortWithinPartitions("product_family", "block", "new", "day").mapInArrow(lambda batches: named_in_blocks(batches, n, window_days, min_similarity), schema)


def curve_candidates(products: DataFrame, sales: DataFrame, window_days: int = 365, weeks: int = 13) -> DataFrame:
    """Old sales fall and new ones rise about the launch: decline .30, ramp .30, complement .25, scale .15.

    sales: (sku_id, week, quantity).
    """
    p = candidate_pairs(products, window_days).select(F.col("sku_id").alias("old_sku"), F.col("sku_id_new").alias("new_sku"), F.col("launch_date_new").alias("launch"))
    near = lambda c: (F.col("week") >= F.date_sub("launch", 7 * weeks)) & (F.col("week") < F.date_add("launch", 7 * weeks))
    side = lambda c: p.join(sales, F.col(c) == F.col("sku_id")).where(near(c)).withColumn("k", F.floor(F.datediff("week", "launch") / 7).cast("double"))
    keys = ["old_sku", "new_sku"]
    before, after = F.when(F.col("k") < 0, F.col("quantity")), F.when(F.col("k") >= 0, F.col("quantity"))
    old = side("old_sku").groupBy(*keys).agg(slope("quantity", "k").alias("so"), F.avg(before).alias("ob"), F.avg(after).alias("oa"), F.avg("quantity").alias("mo"))
    new = side("new_sku").groupBy(*keys).agg(slope("quantity", "k").alias("sn"), F.avg(after).alias("na"))
    x = old.join(new, keys)
    unit = lambda c: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), F.lit(0.0))
    decline = unit(-F.try_divide(F.col("so") * weeks, F.nullif("mo", F.lit(0.0))))
    ramp = unit(F.try_divide(F.col("sn") * weeks, F.nullif("na", F.lit(0.0))))
    lost = F.col("ob") - F.coalesce("oa", F.lit(0.0))
    complement = unit(1 - F.abs(F.try_divide(F.col("na") - lost, F.nullif(F.greatest(F.abs(lost), F.col("na")), F.lit(0.0)))))
    scale = unit(F.try_divide(F.least("ob", "na"), F.nullif(F.greatest("ob", "na"), F.lit(0.0))))
    score = 0.30 * decline + 0.30 * ramp + 0.25 * complement + 0.15 * scale
    return x.select(*keys, F.lit("curve").alias("method"), score.alias("score")).where("score > 0")


def comovement_candidates(products: DataFrame, sales: DataFrame, window_days: int = 365, min_weeks: int = 4) -> DataFrame:
    """Weekly changes of the two against each other .40, overlap of weeks .35, volume .25."""
    p = candidate_pairs(products, window_days).select(F.col("sku_id").alias("old_sku"), F.col("sku_id_new").alias("new_sku"))
    w = W.partitionBy("sku_id").orderBy("week")
    s = sales.withColumn("d", F.col("quantity") - F.lag("quantity").over(w))
    a = s.select(F.col("sku_id").alias("old_sku"), "week", F.col("quantity").alias("qo"), F.col("d").alias("do"))
    b = s.select(F.col("sku_id").alias("new_sku"), "week", F.col("quantity").alias("qn"), F.col("d").alias("dn"))
    both = p.join(a, "old_sku").join(b, ["new_sku", "week"])
    x = both.groupBy("old_sku", "new_sku").agg(pearson(-F.col("do"), "dn").alias("c"), F.count("*").alias("n"), F.avg("qo").alias("qo"), F.avg("qn").alias("qn"))
    x = x.where(F.col("n") >= min_weeks)
    volume = F.coalesce(F.try_divide(F.least("qo", "qn"), F.nullif(F.greatest("qo", "qn"), F.lit(0.0))), F.lit(0.0))
    score = 0.40 * F.greatest(F.lit(0.0), F.coalesce("c", F.lit(0.0))) + 0.35 * F.least(F.lit(1.0), F.col("n") / 26) + 0.25 * volume
    return x.select("old_sku", "new_sku", F.lit("temporal").alias("method"), score.alias("score"))


#: The weights of the methods, and the bands of confidence.
METHOD_WEIGHTS = {"attribute": 0.30, "naming": 0.25, "curve": 0.25, "temporal": 0.20}


def fuse(candidates: DataFrame, min_confidence: float = 0.30) -> DataFrame:
    """One row a pair: scores weighed over the methods that found it, .10 more for two or more."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in METHOD_WEIGHTS.items() for x in kv]), F.col("method"))
    x = candidates.withColumn("w", F.coalesce(weight, F.lit(0.2))).groupBy("old_sku", "new_sku").agg(
        (F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("s"), F.array_sort(F.collect_set("method")).alias("methods_matched"), F.countDistinct("method").alias("n_methods")
    )
    score = F.least(F.lit(1.0), F.col("s") + F.when(F.col("n_methods") >= 2, 0.10).otherwise(0.0))
    x = x.withColumn("confidence_score", F.round(score, 6)).where(F.col("confidence_score") >= min_confidence)
    band = F.when(F.col("confidence_score") >= 0.75, "High").when(F.col("confidence_score") >= 0.50, "Medium").when(F.col("confidence_score") >= 0.30, "Low").otherwise("Very Low")
    return mapping_types(x.select("old_sku", "new_sku", "confidence_score", band.alias("confidence_level"), "methods_matched"))


def mapping_types(pairs: DataFrame) -> DataFrame:
    """1-to-1, 1-to-Many, Many-to-1 or Many-to-Many, with equal shares."""
    out = pairs.withColumn("_o", F.count("*").over(W.partitionBy("old_sku"))).withColumn("_n", F.count("*").over(W.partitionBy("new_sku")))
    kind = F.when((F.col("_o") == 1) & (F.col("_n") == 1), "1-to-1").when(F.col("_n") == 1, "1-to-Many").when(F.col("_o") == 1, "Many-to-1").otherwise("Many-to-Many")
    share = F.when(F.col("_o") > 1, 1.0 / F.col("_o")).when(F.col("_n") > 1, 1.0 / F.col("_n")).otherwise(1.0)
    return out.withColumn("mapping_type", kind).withColumn("proportion", share).drop("_o", "_n")


def bayesian_proportions(pairs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Posterior mean shares of a Dirichlet prior with the scores as counts, to four places; the largest takes the rest.

    Shares are of the old product, or of the new one where several old ones go into it.
    """
    one = F.col("mapping_type") == "1-to-1"
    group = F.when(F.col("mapping_type") == "Many-to-1", F.struct(F.lit("new").alias("side"), F.col("new_sku").alias("sku"))).otherwise(F.struct(F.lit("old").alias("side"), F.col("old_sku").alias("sku")))
    x = pairs.withColumn("_g", group)
    w = W.partitionBy("_g")
    n = F.count("*").over(w)
    raw = (alpha / n + F.col("confidence_score")) / (alpha + F.sum("confidence_score").over(w))
    x = x.withColumn("_p", F.round(raw, 4)).withColumn("_rest", F.round(1 - F.sum("_p").over(w), 4))
    first = F.row_number().over(w.orderBy(F.desc("_p"), "old_sku", "new_sku")) == 1
    p = F.when(one, 1.0).otherwise(F.round(F.col("_p") + F.when(first, F.col("_rest")).otherwise(0.0), 4))
    return x.withColumn("proportion", p).drop("_g", "_p", "_rest")


def map_products(products: DataFrame, sales: DataFrame | None = None, window_days=365, min_similarity=0.70, min_confidence=0.30) -> DataFrame:
    """Attributes and names; with sales also curves, co-movement and posterior shares."""
    found = attribute_candidates(products, window_days).unionByName(naming_candidates(products, window_days, min_similarity))
    if sales is None:
        return fuse(found, min_confidence)
    found = found.unionByName(curve_candidates(products, sales, window_days)).unionByName(comovement_candidates(products, sales, window_days))
    return bayesian_proportions(fuse(found, min_confidence))
