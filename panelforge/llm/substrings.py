"""Repeated byte strings: every byte under a 200-byte string that also starts elsewhere.

Regions around recurring minimisers are suffix-sorted: prefix polynomial hashes give the
hash of any slice, binary search on them the common extension of two suffixes, and a
mergesort compares suffixes by it in logarithmic time.  Neighbours that agree on 200 bytes
are verified byte by byte, so a hash collision cannot remove anything.

Defined cases: null text is empty; fewer than 200 bytes hold no string; equal rows are
documents of their own and so copies of each other; overlapping repeats in one document
count; a null id is kept as null; the kept bytes may cut a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import anchors
from panelforge.llm.common import BYTE_POWERS, PrefixHash, Texts, doc_id, keyed, mix, ragged, text_chunks

WIDTH = anchors.Bytes.window


class Suffixes:
    """Suffixes of a byte array, compared on their first WIDTH bytes by hashes of slices."""

    def __init__(self, data: np.ndarray):
        self.data, self.hash = data, PrefixHash(data, BYTE_POWERS)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, up to WIDTH, by binary search on hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), WIDTH, np.int64)
        same = self.hash.slices(x, x + WIDTH) == self.hash.slices(y, y + WIDTH)
        low[same] = WIDTH
        while True:
            go = np.flatnonzero(low < high)
            if not len(go):
                return low
            mid = (low[go] + high[go] + 1) // 2
            same = self.hash.slices(x[go], x[go] + mid) == self.hash.slices(y[go], y[go] + mid)
            low[go] = np.where(same, mid, low[go])
            high[go] = np.where(same, high[go], mid - 1)

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x is before, like or after suffix y."""
        n = self.common(x, y)
        out = np.zeros(len(x), np.int64)
        differ = n < WIDTH
        a, b = self.data[x[differ] + n[differ]].astype(np.int64), self.data[y[differ] + n[differ]].astype(np.int64)
        out[differ] = np.sign(a - b)
        return out

    def sort(self, order: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of each segment (equal, adjacent numbers) of suffix positions."""
        edge = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(edge, len(order)))
        base, total = np.repeat(edge, size), np.repeat(size, size)
        local = np.arange(len(order)) - base
        width = 1
        while width < (size.max() if len(size) else 0):
            block = local // width
            other = (block ^ 1) * width
            end = np.minimum(other + width, total)
            move = np.flatnonzero(other < total)
            low, high, odd = other[move], end[move].copy(), block[move] & 1
            low = low.copy()
            while True:
                go = np.flatnonzero(low < high)
                if not len(go):
                    break
                mid = (low[go] + high[go]) // 2
                c = self.compare(order[base[move[go]] + mid], order[move[go]])
                before = (c < 0) | ((c == 0) & (odd[go] == 1))
                low[go] = np.where(before, mid + 1, low[go])
                high[go] = np.where(before, high[go], mid)
            place = local.copy()
            pair = (block[move] // 2) * 2 * width
            place[move] = pair + (local[move] - block[move] * width) + (low - other[move])
            new = np.empty_like(order)
            new[base + place] = order
            order, width = new, 2 * width
        return order

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Verified equality of the first WIDTH bytes."""
        out = self.hash.slices(x, x + WIDTH) == self.hash.slices(y, y + WIDTH)
        maybe, reach = np.flatnonzero(out), np.arange(WIDTH)
        for at in range(0, len(maybe), 20_000):
            i = maybe[at : at + 20_000]
            out[i] = (self.data[x[i][:, None] + reach] == self.data[y[i][:, None] + reach]).all(1)
        return out


def sort_regions(rows) -> list[tuple[int, list[int], list[int], list[int]]]:
    """For each region (a, bytes, n, ...): the stretches of windows that also start elsewhere."""
    a = np.array([r[0] for r in rows], np.int64)
    n = np.array([r[2] for r in rows], np.int64)
    lens = np.array([len(r[1]) for r in rows], np.int64)
    alone = np.ones(len(rows), bool)
    if len(rows) > 1:
        same = a[1:] == a[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
    out = [(i, [0], [int(lens[i]) - WIDTH + 1], [0]) for i in np.flatnonzero(n > 1)]
    # regions that may hold something beyond whole copies of themselves
    look = np.flatnonzero(~alone | (n == 1))
    busy = np.zeros(len(rows), bool)
    busy[look] = True
    once = {x for x in a[busy & (n == 1)].tolist()}
    look = np.array([i for i in look.tolist() if int(a[i]) in once], np.int64)
    if not len(look):
        return out
    data = np.frombuffer(b"".join(rows[i][1] for i in look), np.uint8)
    s = Suffixes(data)
    begin = np.concatenate([[0], np.cumsum(lens[look])[:-1]])
    count = lens[look] - WIDTH + 1
    order = ragged(begin, count)
    owner = np.repeat(np.arange(len(look)), count)
    key = mix(s.hash.slices(order, order + anchors.Bytes.gram) ^ mix(a[look][owner].view(np.uint64)))
    by = np.argsort(key, kind="stable")
    order, key, owner = order[by], key[by], owner[by]
    several = np.zeros(len(key), bool)
    several[1:] = key[1:] == key[:-1]
    several[:-1] |= several[1:]
    order, key = order[several], key[several]
    order = s.sort(order, key)
    same = np.flatnonzero(key[1:] == key[:-1])
    like = same[s.equal(order[same], order[same + 1])]
    twice = np.zeros(len(data) + 1, bool)
    twice[order[like]] = True
    twice[order[like + 1]] = True
    for i, b, c in zip(look.tolist(), begin.tolist(), count.tolist(), strict=True):
        if n[i] == 1:
            flag = twice[b : b + c]
            if flag.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
                out.append((i, edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), [0] * (len(edge) // 2)))
    return out


def remove_substrings(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): documents without bytes that recur.

    Where ids are unique, columns named in carry follow.
    """

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch):
                t = Texts(part.column("text"))
                step = np.zeros(len(t.data) + 1, np.int32)
                for d, found in enumerate(part.column("covers").to_pylist()):
                    for c in found or ():
                        for at, n in zip(c["at"], c["len"], strict=True):
                            begin = int(t.offsets[d]) + c["start"] + at
                            step[begin] += 1
                            step[begin + n + WIDTH - 1] -= 1
                gone = np.cumsum(step)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = np.diff(total[t.offsets])
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                inner = t.offsets[:-1][np.diff(t.offsets) > 0]
                head[inner] = gone[inner]  # a run does not go on into the next document
                spans = np.diff(np.concatenate([[0], np.cumsum(head)])[t.offsets])
                kept_off = t.offsets - total[t.offsets]
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(kept_off.astype(np.int64)), pa.py_buffer(t.data[~gone])]).cast(pa.binary())
                cols = [part.column("did"), pa.array(np.diff(t.offsets)), pa.array(removed), pa.array(spans), kept]
                yield pa.RecordBatch.from_arrays([*cols, *(part.column(c) for c in carry)], ["did", "n_bytes", "n_removed", "n_spans", "kept", *carry])

    out = anchors.covers(keyed(docs), anchors.Bytes, False, sort_regions)
    fields = [T.StructField(c, t()) for c, t in (("did", T.LongType), ("n_bytes", T.LongType), ("n_removed", T.LongType), ("n_spans", T.LongType), ("kept", T.BinaryType))]
    if carry:
        rest = docs.select(F.col("doc_id").cast("long").alias("k"), *carry)
        out = out.join(rest, "k", "left")
        fields += rest.schema.fields[1:]
    out = out.select("did", "text", "covers", *carry).mapInArrow(run, T.StructType(fields))
    return out.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept", *carry)
