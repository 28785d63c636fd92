"""Anchors: which regions of documents can hold a passage that also stands elsewhere.

Every window of `window` units (words or bytes) has a minimiser, the least hash among its
`gram`-unit pieces.  Equal windows have equal minimisers, so a window can recur only where its
minimiser does.  Consecutive windows with one minimiser form a run; a run is one row, about
a fifth of the words or a hundredth of the bytes.  Only runs whose minimiser recurs go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import BATCH_BYTES, BYTE_POWERS, SPACE, WORD_POWERS, PrefixHash, Texts, mix, ragged, sliding_min, text_chunks

RUN = "a long, k long, did long, start int, len int, twice boolean"


class Words:
    """Units are words; a region's text is its words joined by one space."""

    window, gram = 13, 5

    @staticmethod
    def hashes(t: Texts):
        starts, ends, first, h = t.word_hashes()
        return (starts, ends), first, h, WORD_POWERS


class Bytes:
    """Units are bytes."""

    window, gram = 200, 24

    @staticmethod
    def hashes(t: Texts):
        return None, t.offsets, t.data, BYTE_POWERS


def runs_of(t: Texts, units):
    """(document, first window, number of windows, minimiser, twice) of every run of windows.

    twice: the minimiser stands at two places close together, so that windows of one run may
    be equal.
    """
    _, first, values, powers = units.hashes(t)
    w = units.window
    count = np.maximum(0, np.diff(first) - w + 1)
    if not count.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(bool)
    grams = mix(PrefixHash(values, powers).fixed(units.gram))
    least = sliding_min(grams, w - units.gram + 1)
    back, cut = first[1:-1], np.zeros(len(least) + w, np.int32)
    np.add.at(cut, np.maximum(0, back - w + 1), 1)
    np.add.at(cut, back, -1)
    inside = np.cumsum(cut)[: len(least)] <= 0
    at = np.flatnonzero(inside)  # windows that stay in one document
    doc = np.searchsorted(first, at, "right") - 1
    low = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    d = doc[begin]
    least[~inside] = 0
    pad = np.zeros(w - units.gram, np.uint64)
    most = ~sliding_min(~np.concatenate([pad, least, pad]), w - units.gram + 1)
    place = np.flatnonzero(most == grams)  # grams that are some window's least
    again = np.flatnonzero((grams[place[1:]] == grams[place[:-1]]) & (np.diff(place) <= w))
    twice = np.isin(low[begin], np.unique(grams[place[again]]))
    return d, at[begin] - first[d], length, low[begin].view(np.int64), twice


def runs(docs: DataFrame, units) -> DataFrame:
    """One row per run of windows of keyed documents (k, did, text)."""

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch):
                doc, start, length, low, twice = runs_of(Texts(part.column("text")), units)
                if len(doc):
                    take = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(low), part.column("k").take(take), part.column("did").take(take), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(twice)],
                        ["a", "k", "did", "start", "len", "twice"],
                    )

    return docs.select("k", "did", "text").mapInArrow(run, RUN)


def groups_that(batches, confirmed, key="a", alike=False):
    """From batches sorted by key, the rows of groups that `confirmed(batch, starts)` accepts.

    A group is held back only until it is confirmed, so a group of any size passes through.  With
    alike, rows of a group not yet confirmed tell nothing beyond its first, which alone is held.
    """
    held, last, sure = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        a = batch.column(key).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
        ok = confirmed(batch, starts)
        if sure and a[0] == last:
            ok[0] = True
        held, last, sure = None, a[-1], bool(ok[-1])
        keep = np.repeat(ok, np.diff(np.append(starts, len(a))))
        if not sure:
            held = batch.slice(int(starts[-1]), 1 if alike else None)
            keep = keep[: int(starts[-1])]
            batch = batch.slice(0, int(starts[-1]))
        if keep.any():
            yield batch.filter(pa.array(keep))


def recurring(found: DataFrame, other_document: bool) -> DataFrame:
    """Runs whose minimiser also stands elsewhere: in another document, or anywhere at all.

    One shuffle by minimiser, then a pass over sorted rows that holds no group.
    """

    def confirmed(batch, starts):
        if other_document:
            did = batch.column("did").to_numpy()
            return np.minimum.reduceat(did, starts) != np.maximum.reduceat(did, starts)
        sizes = np.diff(np.append(starts, batch.num_rows))
        return (sizes > 1) | np.logical_or.reduceat(batch.column("twice").to_numpy(zero_copy_only=False), starts)

    def run(batches):
        return groups_that(batches, confirmed)

    return found.repartition("a").sortWithinPartitions("a").mapInArrow(run, RUN)


def by_document(found: DataFrame, *fields: str) -> DataFrame:
    """(k, runs): the rows of each document, at most as many as it has windows."""
    return found.groupBy("k").agg(F.collect_list(F.struct(*fields)).alias("runs"))


# ------------------------------------------------------------------ regions of runs
def region_bytes(t: Texts, units, doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The text of each run's windows together; words are joined by one space."""
    n = length + units.window - 1
    if units is not Words:
        begin = t.offsets[doc] + start
        return binaries(t.data, begin, n)
    starts, ends, first = t.words()
    spaced = np.where(SPACE[t.data], np.uint8(32), t.data)
    wide = np.zeros(len(starts) + 1, np.int64)  # words before each one that more than one byte parts from the next
    wide[1:-1] = np.cumsum(starts[1:] - ends[:-1] > 1)
    at = first[doc] + start
    out = binaries(spaced, starts[at], ends[at + n - 1] - starts[at])
    odd = wide[at + n - 1] > wide[at]
    if odd.any():
        out = pa.array([b" ".join(v.split()) if o else v for v, o in zip(out.to_pylist(), odd.tolist(), strict=True)], pa.binary())
    return out


def binaries(data: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Slices of an array as a column, without a Python object for each."""
    offsets = np.concatenate([[0], np.cumsum(lens)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(data[ragged(begin, lens)])]).cast(pa.binary())


def combined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(a, region, n, lo, hi) of each different region of the rows (a, did, region)."""
    out = pa.Table.from_batches(rows).group_by(["a", "region"], use_threads=False).aggregate([("did", "count"), ("did", "min"), ("did", "max")])
    cols = [out.column(c).combine_chunks() for c in ("a", "region", "did_count", "did_min", "did_max")]
    return pa.RecordBatch.from_arrays(cols, ["a", "region", "n", "lo", "hi"])


def regions(docs: DataFrame, found: DataFrame, units, text: bool) -> DataFrame:
    """The regions of recurring runs: with text (a, region, n, lo, hi), copies near each other in one row, else (a, k, did, start, r)."""
    import xxhash

    schema = "a long, region binary, n long, lo long, hi long" if text else "a long, k long, did long, start int, r long"

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for part in text_chunks(batch):
                t = Texts(part.column("text"))
                lists = part.column("runs")
                fields, off = lists.flatten(), np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), off)
                start, length = fields.field("start"), fields.field("len").to_numpy().astype(np.int64)
                out = region_bytes(t, units, doc, start.to_numpy().astype(np.int64), length)
                take, a = pa.array(doc), fields.field("a")
                did = part.column("did").take(take)
                if text:
                    rows.append(pa.RecordBatch.from_arrays([a, did, out], ["a", "did", "region"]))
                    size += out.nbytes
                    if size > BATCH_BYTES:
                        yield combined(rows)
                        rows, size = [], 0
                else:
                    r = np.fromiter((xxhash.xxh3_64_intdigest(o) for o in out.to_pylist()), np.uint64, len(out)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([a, part.column("k").take(take), did, start, pa.array(r)], ["a", "k", "did", "start", "r"])
        if rows:
            yield combined(rows)

    here = docs.join(by_document(found, "a", "start", "len"), "k")
    return here.select("k", "did", "text", "runs").mapInArrow(run, schema)


FACT = "a long, r long, at array<int>, len array<int>, least array<long>"
LOOSE = ", h1 long, h2 long, n long, lo long, hi long"
GROUP_REGIONS, SLICE_BYTES = 50_000, 1 << 20


def facts(distinct: DataFrame, units, solve) -> DataFrame:
    """What `solve` finds of each distinct region (a, region, n, lo, hi), dealt by minimiser, group by group.

    Rows arrive sorted by it.  Whole groups are gathered into slices of bounded size
    and solved.  A group of more regions than GROUP_REGIONS isn't gathered: its windows go out
    one by one as 128-bit hashes, and an aggregation, which has no such bound, settles them.
    """
    import xxhash

    from panelforge.llm.common import durable

    def loose(rows):
        out = [[] for _ in range(10)]
        for a, region, n, lo, hi in rows:
            r = xxhash.xxh3_64_intdigest(region)
            parts = region.split(b" ") if units is Words else region
            for i in range(len(parts) - units.window + 1):
                w = parts[i : i + units.window]
                h = xxhash.xxh3_128_intdigest(b" ".join(w) if units is Words else w)
                for col, v in zip(out, (a, signed(r), [i], [1], [0], signed(h >> 64), signed(h & (2**64 - 1)), n, lo, hi), strict=True):
                    col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], NAMES)

    def solved(rows):
        found = solve(rows)  # (row, [at], [len], [least])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        cols = [[rows[f[0]][0] for f in found], [signed(xxhash.xxh3_64_intdigest(rows[f[0]][1])) for f in found], *([f[i] for f in found] for i in (1, 2, 3))]
        none = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *[none] * 5], NAMES)

    def run(batches):
        whole, group, size, last, big = [], [], 0, None, False
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "region", "n", "lo", "hi")), strict=True):
                if row[0] != last:
                    whole += group
                    group, last, big = [], row[0], False
                    if size > SLICE_BYTES:
                        yield solved(whole)
                        whole, size = [], 0
                group.append(row)
                if big or len(group) > GROUP_REGIONS:
                    if not big:
                        size -= sum(len(x[1]) for x in group[:-1])
                    big = True
                    yield loose(group)
                    group = []
                else:
                    size += len(row[1])
        whole += group
        if whole:
            yield solved(whole)

    found = durable(distinct.sortWithinPartitions("a").mapInArrow(run, FACT + LOOSE))
    names = [c.split()[0] for c in FACT.split(", ")]
    sure, open_ = found.where("h1 IS NULL").select(names), found.where("h1 IS NOT NULL")
    if open_.limit(1).count():
        every = open_.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        every = every.where("lo < hi" if units is Words else "n > 1").select("h1", "h2", F.array("lo").alias("least"))
        sure = sure.unionByName(open_.drop("least").join(every, ["h1", "h2"]).select(names))
    return sure


NAMES = [c.split()[0] for c in (FACT + LOOSE).split(", ")]


def signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def covers(docs: DataFrame, units, other_document: bool, solve) -> DataFrame:
    """Documents (k, did, text) with covers: (start, at, len, least) of each recurring region, or null.

    The texts are dealt by document once and that exchange serves every join with them.
    """
    dealt = docs.repartition("k")
    found = recurring(runs(docs, units), other_document)
    from panelforge.llm.common import durable

    found = durable(found)
    # one exchange of the regions' bytes serves the sums and the groups
    distinct = regions(dealt, found, units, True).repartition("a").groupBy("a", "region").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if docs.sparkSession.conf.get("spark.sql.requireAllClusterKeysForDistribution") == "true":
        distinct = distinct.repartition("a")  # that session deals by all keys of a sum
    known = facts(distinct, units, solve)
    placed = regions(dealt, found, units, False).join(known, ["a", "r"])
    if units is Words:
        placed = placed.where(F.exists("least", lambda x: x < F.col("did")))
    by = placed.groupBy("k").agg(F.collect_list(F.struct("start", "at", "len", "least")).alias("covers"))
    return dealt.join(by, "k", "left")
