"""Best-fit packing by hierarchical residual packing.

Documents become token ids (`tokenizers`, each different word of some megabytes once) and an end
id.  Full-length pieces are sequences of their own.  The rest is packed best-fit decreasing
in hash buckets; nearly full bins go out, underfull ones become items of the next level,
where groups of `fan` buckets are packed again, up to one bucket.  Each bucket holds a
bounded number of items: their number sets the number of buckets, and what goes up a
level is only what a bucket could not fill.

Defined cases: null text is the empty text and has the end id alone; ties are broken by
doc_id and piece; repeated rows are packed each; an empty table gives no rows; a null
doc_id is kept.  Only documents longer than the capacity are cut.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.byte_bpe import byte_characters
from panelforge.llm.common import durable, kept, ragged, small_batches, text_chunks

#: Precomposed Latin letters, which every normal form of composition keeps; ASCII marks are neither letters, digits nor white space.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0134-\u017e"
MARK = r"!-/:-@\[-`{-~"
CHUNK = 1 << 22  # bytes of text whose different words are encoded together
JOINED = 1024  # pieces that meet the tokenizer as one string
MEMO_BYTES = 16 << 20  # strings, and their ids, of one memo of a worker
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
BUCKET_ITEMS = 16384


class Memo:
    """The ids of strings that were met; it starts anew where it would outgrow its bound."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.known, self.ids, self.at = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def look_up(self, parts: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, which differ, and where each part's begin (with the total last); new ones by `encode`."""
        which = pc.fill_null(pc.index_in(parts, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = parts.filter(pa.array(which < 0))
        which[which < 0] = len(self.known) + np.arange(len(new))
        ids, at = encode(new)
        self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, at[1:] + len(self.ids)])
        self.known = pa.concat_arrays([self.known, new])
        out = picked(self.ids, self.at[which], np.diff(self.at)[which])
        if self.known.nbytes + self.ids.nbytes + self.at.nbytes > MEMO_BYTES:
            self.forget()
        return out


class WordCodec:
    """A tokenizer file whose words, split at ASCII white space, are independent.

    Each different word of a call is looked at once.  A word of Latin letters, or such a word with ASCII marks
    at its end, needs neither the normaliser nor the splitting pattern: its letters are lower-cased, and letters
    and marks are merged as one piece each.  Pieces not in the memo meet the tokenizer many at a time, joined by
    spaces; the ids of tokens that end a word tell them apart again.
    """

    loaded: dict[str, "WordCodec"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        bare = json.loads(self.model.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merger = Tokenizer.from_str(json.dumps(bare))
        vocabulary = self.merger.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith(bare["model"]["end_of_word_suffix"])]] = True
        self.shown = np.array([ord(c) for c in byte_characters()], "<u4")
        self.shown[0x20] = 0x20
        self.pieces, self.others = Memo(), Memo()

    @classmethod
    def of(cls, path: str) -> "WordCodec":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
            kept.append(("packing", cls.loaded.clear))
        return cls.loaded[path]

    def merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and where each piece's begin (with the total last)."""
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(pieces), JOINED), len(pieces)], pa.int32()), pieces)
        groups = [self.shown[np.frombuffer(g.encode(), np.uint8)].tobytes().decode("utf-32-le") for g in pc.binary_join(groups, " ").to_pylist()]
        ids = [np.array(e.ids, "<u4") for e in self.merger.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, "<u4"), *ids])
        at = np.concatenate([[0], np.flatnonzero(self.final[ids]) + 1])
        if len(at) != len(pieces) + 1 or at[-1] != len(ids):
            raise ValueError("the tokenizer does not end each word with a token of its end-of-word suffix")
        return ids, at

    def each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that need all of the tokenizer."""
        ids = [e.ids for e in self.model.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), "<u4"), np.cumsum([0, *map(len, ids)])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words."""
        parted = pc.replace_substring_regex(words, f"^([{LETTER}]+)([{MARK}]+)$", r"\1 \2")
        plain = pc.match_substring_regex(parted, f"^[{LETTER}]+( [{MARK}]+)?$")
        ids, at = each_once(pc.utf8_lower(parted.filter(plain)), lambda p: self.pieces.look_up(p, self.merge))
        plain = plain.to_numpy(zero_copy_only=False)
        more, more_at = self.others.look_up(words.filter(pa.array(~plain)), self.each)
        n, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        n[plain], n[~plain] = np.diff(at), np.diff(more_at)
        start[plain], start[~plain] = at[:-1], len(ids) + more_at[:-1]
        return picked(np.concatenate([ids, more]), start, n)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ids, at = each_once(pc.fill_null(texts, "").cast(pa.string()), self.words)
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(at.tolist())]


def picked(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in n places from each start, and where each one's begin (with the total last)."""
    return ids[ragged(start, n)], np.concatenate([[0], np.cumsum(n)])


def each_once(texts: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and where each text's begin, by encoding each different part, split at ASCII white space, once."""
    parts = pc.ascii_split_whitespace(texts)
    known = parts.flatten().dictionary_encode()
    ids, at = encode(known.dictionary)
    which, first = known.indices.to_numpy(), parts.offsets.to_numpy()
    ids, at = picked(ids, at[which], np.diff(at)[which])
    return ids, at[first - first[0]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (packed little-endian u32)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        codec = WordCodec.of(tokenizer)
        for batch in batches:
            for part in text_chunks(batch, limit=CHUNK, owner="packing"):
                rows = [[] for _ in range(6)]
                for d, ids in zip(part.column("doc_id").to_pylist(), codec.encode(part.column("text")), strict=True):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        for col, v in zip(rows, (d, p, at // 4, len(cut) // 4, zlib.crc32(cut), cut), strict=True):
                            col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return small_batches(docs).selectExpr("CAST(doc_id AS long) doc_id", "text").mapInArrow(run, PIECE + ", ids binary")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still holds it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = open_rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - s].append(b)
        open_rooms |= 1 << (room - s)
    return bins


MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "offset"))]))
MEMBER = PIECE.replace(", ", ",").replace(" ", ":") + ",offset:long"
ITEM = f"members array<struct<{MEMBER}>>, size long, bucket long"


def pack(items: DataFrame, capacity: int = 2048, nearly_full: float = 0.98) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id and offset, gapless.

    Levels end when one bucket holds all that is left, or when a level no longer joins a
    twentieth of its items: pieces over half a sequence may have no partner at all.
    """
    full = int(capacity * nearly_full)
    items = items.select(*[c.split()[0] for c in PIECE.split(", ")])
    whole = items.where(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", F.monotonically_increasing_id())
    rest = durable(items.where(F.col("length") < capacity).withColumn("offset", F.lit(0).cast("long")))
    left = rest.count()
    level = rest.select(F.array(F.struct(*rest.columns)).alias("members"), F.col("length").alias("size"), F.xxhash64("doc_id", "piece", "start").alias("place"))
    done, height = [], 0
    while left:
        buckets = -(-left // BUCKET_ITEMS)

        def run(table: pa.Table) -> pa.Table:
            members, sizes = table.column("members").combine_chunks(), table.column("size").to_numpy()
            rows = members.to_pylist()
            order = sorted(range(len(rows)), key=lambda i: (-sizes[i], rows[i][0]["doc_id"] is None, rows[i][0]["doc_id"] or 0, rows[i][0]["piece"]))
            rows, packed = [rows[i] for i in order], []
            for b in best_fit(sizes[order], capacity):
                at, bin_ = 0, []
                for m in (m for i in b for m in rows[i]):
                    bin_.append(m | {"offset": at})
                    at += m["length"]
                packed.append((bin_, at))
            return pa.table(
                {
                    "members": pa.array([b for b, _ in packed], MEMBERS),
                    "size": pa.array([f for _, f in packed], pa.int64()),
                    "bucket": pa.array([table.column("bucket")[0].as_py()] * len(packed), pa.int64()),
                    "bin": pa.array(range(len(packed)), pa.int64()),
                }
            )

        level = level.select("members", "size", F.pmod("place", F.lit(buckets)).alias("bucket"))
        out = durable(level.groupBy("bucket").applyInArrow(run, ITEM + ", bin long"))
        under = out.where(F.col("size") < full).count()
        last = buckets == 1 or under > 0.95 * left
        height += 1
        # the level from bit 56, the bucket from bit 24: unlike `whole`'s and other levels' numbers
        number = F.lit(height << 56) + F.shiftleft(F.col("bucket"), 24) + F.col("bin")
        done.append((out if last else out.where(F.col("size") >= full)).select("members", number.alias("sequence_id")))
        if last:
            break
        left = under
        level = out.where(F.col("size") < full).select("members", "size", F.xxhash64("bucket", "bin", F.lit(height)).alias("place"))
    for bins in done:
        whole = whole.unionByName(bins.select(F.explode("members").alias("m"), "sequence_id").select("m.*", "sequence_id"))
    return whole


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise and pack: one row per piece with its place."""
    cut = durable(pieces(docs, tokenizer, capacity, end_id).drop("ids"))
    return pack(cut, capacity)
