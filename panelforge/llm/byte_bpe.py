"""Byte-level BPE: encode texts to token ids with offsets, decode ids to bytes and text.

The merges run in the `tokenizers` library, over Arrow batches.  A model is built from a
rank file: bytes map to printable characters, and each token's splits into two known tokens
become merges in rank order, which merges as the rank file does.  Units (a run of
solid characters with one leading space, or white space) are independent of each other
under the split pattern, so their ids are kept in a bounded memo.

Defined cases: null text encodes as the empty text; an empty text has no ids; null ids
decode to empty bytes; an id outside the vocabulary is an error; repeated rows are
encoded alike.  Other columns of the input are not carried.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm.common import kept, small_batches, text_chunks

MEMO_UNITS, MEMO_CHARS = 200_000, 48
#: The white space of the Unicode standard.
WHITE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNITS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and byte table of one rank file."""

    loaded: dict[tuple[str, str], "Codec"] = {}

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, char = read_ranks(path), byte_characters()
        spell = lambda t: "".join(char[b] for b in t)
        merges = []
        for token in sorted(ranks, key=ranks.get):
            merges += [(spell(token[:i]), spell(token[i:])) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.memo: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls.loaded:
            cls.loaded[path, pattern] = cls(path, pattern)
            kept.append(("byte_bpe", cls.loaded.clear))
        return cls.loaded[path, pattern]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        memo, units = self.memo, [UNITS.findall(t) for t in texts]
        new = list({u for us in units for u in us} - memo.keys())
        fresh = {}
        for u, e in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False), strict=True):
            fresh[u] = np.array(e.ids, "<u4").tobytes()
        memo.update(fresh)
        out = [b"".join(map(memo.__getitem__, us)) for us in units]
        for u in new:
            if len(u) > MEMO_CHARS:
                del memo[u]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character range of each token; tokens inside one character share its range."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        starts = ends - self.lengths[np.frombuffer(ids, "<u4")]
        head = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        char = np.concatenate([[0], np.cumsum(head)])
        return (char[starts + 1] - 1 if len(starts) else starts), char[ends]


def encode(docs: DataFrame, ranks: str, pattern: str, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text): ids as packed little-endian u32.

    With offsets, also char_start and char_end: the characters each token covers.  With
    decoded, also bytes: the ids decoded again, in the same pass, to check the round trip.
    """
    names = ["doc_id", "ids"] + ["char_start", "char_end"] * offsets + ["bytes"] * decoded

    def run(batches):
        codec = Codec.of(ranks, pattern)
        for batch in batches:
            for part in text_chunks(batch, limit=1 << 21, owner="byte_bpe"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = codec.encode(texts)
                cols = [part.column("doc_id"), pa.array(ids, pa.binary())]
                if offsets:
                    spans = [codec.offsets(i, t) for i, t in zip(ids, texts, strict=True)]
                    cols += [pa.array([s[j].astype(np.int32) for s in spans], pa.list_(pa.int32())) for j in (0, 1)]
                if decoded:
                    cols.append(pa.array([codec.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, ids binary" + ", char_start array<int>, char_end array<int>" * offsets + ", bytes binary" * decoded
    return small_batches(docs).selectExpr("CAST(doc_id AS long) doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes, text) of packed ids; bytes that are no UTF-8 become U+FFFD in text.

    Characters split over tokens join before the text is read, so none is lost.
    """

    def run(batches):
        codec = Codec.of(ranks, pattern)
        for batch in batches:
            raw = [codec.decode(i or b"") for i in batch.column("ids").to_pylist()]
            text = [r.decode("utf-8", "replace") for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(raw, pa.binary()), pa.array(text, pa.string())], ["doc_id", "ids", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary, text string")
