"""Repeated phrases: passages of 13 words that a document with a smaller id already has.

Regions around recurring minimisers are confirmed to stand in two documents, compiled into
Aho-Corasick automata over word numbers (one for each bounded shard of minimisers), and the
regions of all documents run through the automaton of their shard, which places every
occurrence.  Sharding and routing by minimiser keep the work proportional to the text: a
text meets only automata that hold a phrase it may contain.

Defined cases: null text has no words; fewer than 13 words have no window; documents with
the same id do not remove from each other; a null id orders after all ids; white space
between words does not matter; the kept words are joined by one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm import anchors
from panelforge.llm.common import Texts, doc_id, keyed, ragged, text_chunks

WINDOW = anchors.Words.window
NEVER = 2**63 - 1


def locate(rows) -> list[tuple[int, list[int], list[int], list[int]]]:
    """For each region (a, text, n, lo, hi): stretches of windows with the least id that has them."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    words = [tuple(numbers.setdefault(w, len(numbers)) for w in r[1].split(b" ")) for r in rows]
    phrases: dict[tuple[int, ...], int] = {}  # confirmed or candidate phrase: least id
    most: dict[tuple[int, ...], int] = {}
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        for i in range(at, end):
            w = words[i]
            # a minimiser with one region: the whole region is one phrase
            parts = [w] if end - at == 1 else [w[j : j + WINDOW] for j in range(len(w) - WINDOW + 1)]
            for p in parts:
                phrases[p] = min(phrases.get(p, NEVER), rows[i][3])
                most[p] = max(most.get(p, -NEVER - 1), rows[i][4])
        at = end
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for p, least in phrases.items():
        if most[p] > least:
            machine.add_word(p, (len(p), least))
    if not len(machine):
        return []
    machine.make_automaton()
    out = []
    for i, w in enumerate(words):
        least = [NEVER] * (len(w) - WINDOW + 1)
        for stop, (n, lo) in machine.iter(w):
            for j in range(stop - n + 1, stop - WINDOW + 2):
                if lo < least[j]:
                    least[j] = lo
        starts, lens, ids = [], [], []
        for j, lo in enumerate(least):
            if lo < rows[i][4]:
                if starts and ids[-1] == lo and starts[-1] + lens[-1] == j:
                    lens[-1] += 1
                else:
                    starts.append(j), lens.append(1), ids.append(lo)
        if starts:
            out.append((i, starts, lens, ids))
    return out


def remove_phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text): documents without the words of phrases seen before."""

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch):
                t = Texts(part.column("text"))
                starts, ends, first = t.words()
                gone = np.zeros(len(starts), bool)
                for d, (did, found) in enumerate(zip(part.column("did").to_pylist(), part.column("covers").to_pylist(), strict=True)):
                    for c in found or ():
                        for at, n, lo in zip(c["at"], c["len"], c["least"], strict=True):
                            if lo < did:
                                begin = int(first[d]) + c["start"] + at
                                gone[begin : begin + n + WINDOW - 1] = True
                keep = ~gone
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                texts = joined(t.data, starts[keep], ends[keep], doc[keep], part.num_rows)
                n = np.diff(first)
                removed = np.bincount(doc[gone], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("did"), pa.array(n), pa.array(removed.astype(np.int64)), texts], ["did", "n_words", "n_removed", "text"])

    out = anchors.covers(keyed(docs), anchors.Words, True, locate).select("did", "text", "covers")
    out = out.mapInArrow(run, "did long, n_words long, n_removed long, text string")
    return out.select(doc_id(), "n_words", "n_removed", "text")


def joined(data, starts, ends, doc, n_docs) -> pa.Array:
    """Each document's words joined by one space, without a Python object for a word."""
    lens = ends - starts
    gap = np.ones(len(starts), np.int64)
    if len(doc):
        gap[np.flatnonzero(np.append(doc[1:] != doc[:-1], True))] = 0  # none after a document's last
    size = lens + gap
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64))])
    out = np.full(int(offsets[-1]), 32, np.uint8)
    out[ragged(np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, lens)] = data[ragged(starts, lens)]
    return pa.StringArray.from_buffers(n_docs, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
