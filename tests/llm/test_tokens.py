import base64
import hashlib
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from panelforge.llm import byte_bpe, packing  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_as_the_rank_file_does(documents, odd_rows, reference):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = byte_bpe.encode(documents(odd_rows), path, pattern, offsets=True, decoded=True).collect()
    assert len(got) == len(odd_rows)
    want = sorted((i is None, i or 0, tuple(reference.encode_ordinary(t or ""))) for i, t in odd_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    texts = {hashlib.sha256((t or "").encode()).digest() for _, t in odd_rows}
    for r in got:
        assert hashlib.sha256(r.bytes).digest() in texts
        text = bytes(r.bytes).decode()
        assert len(r.char_start) == len(r.ids) // 4
        if r.char_start:
            assert r.char_start[0] == 0 and r.char_end[-1] == len(text)


def test_every_white_space_and_split_character(reference):
    codec = byte_bpe.Codec.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    spaces = "\t\n\v\f\r \x85\xa0     　\x1c\x1f"
    texts = [f"a{x}{y}b{x} {y}'s" for x in spaces for y in spaces] + ["<|endoftext|>", "🏳️‍🌈 é", "I'll I'LL 'tis  1st"]
    assert [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert [codec.decode(i).decode() for i in codec.encode(texts)] == texts


def test_decode_joins_split_characters(spark, documents):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(documents([(1, "𝔘𝔫𝔦 😀"), (2, None)]), path, pattern), path, pattern)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "𝔘𝔫𝔦 😀", 2: ""}


def test_packing_places_every_piece(documents, odd_rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    got = packing.pack_documents(documents(odd_rows), path, capacity=256).collect()
    want = []
    for i, t in odd_rows:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, p // 256, p, len(ids[p : p + 256]), zlib.crc32(ids[p : p + 256].tobytes())) for p in range(0, len(ids), 256)]
    none = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(none, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(none, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 1


def test_packing_encodes_words_together_and_as_whole_texts(monkeypatch):
    import re

    import tokenizers

    path, own = public_tokenizers.path("word_bpe_49k.json"), tokenizers.Tokenizer
    model = own.from_file(path)
    model.encode_special_tokens = True
    handed = []

    class Counting:
        """The library's tokenizer, which notes how many strings it is handed."""

        def __init__(self, inner):
            self.__dict__["inner"] = inner

        from_file = staticmethod(lambda p: Counting(own.from_file(p)))
        from_str = staticmethod(lambda p: Counting(own.from_str(p)))

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **options):
            handed.append(len(texts))
            return self.inner.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    codec = packing.WordCodec(path)
    check = lambda texts: [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    letters = "abcdefghij"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:3]]
    assert check([" ".join(words), "", " ".join(w.title() + "," for w in words), "\n".join(w + ".***" for w in words)])
    assert sum(handed) <= 20  # one string a word before: 9,003
    handed.clear()
    assert check([" ".join(w.upper() + "!!" for w in reversed(words)), "***"])  # pieces are remembered, "!!" and "***" are new
    assert sum(handed) <= 3
    handed.clear()
    assert check(["\u0434\u043e\u043c \u041b\u0435\u0441 l'eau"]) and check(["l'eau \u0434\u043e\u043c, \u041b\u0435\u0441 \u0434\u043e\u043c"])
    assert sum(handed) == 4  # so are words of other kinds

    plain = [chr(c) for c in range(0x250) if re.fullmatch(f"[{packing.LETTER}]", chr(c))]
    marks = [chr(c) for c in range(128)]
    odd = ["</w> a</w> <|endoftext|>.", "dogs' don't, DON'T 's", "a\u0338 =\u0338 A\u030a. e\u0301!", "\x1c\x1d \x85x\xa0y\u3000 a\x00b", "\u0130x. \u03a3\u03a3, \u212b"]
    assert check([f"{a}x{b}. {b}{a}" for a in plain for b in plain[::20]] + [f"ab{a}{b} {a}ab{b} \xc9{a}'s{b}" for a in marks for b in marks] + odd)

    monkeypatch.setattr(packing, "MEMO_BYTES", 20_000)
    for at in range(0, len(words), 300):
        assert check([" ".join(words[at : at + 600])])
        assert codec.pieces.known.nbytes + codec.pieces.ids.nbytes + codec.pieces.at.nbytes <= 20_000


def test_packing_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 16)
    rows = [(i, 0, 0, 1 + (i * 37) % 90, i) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECE), capacity=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    # buckets this small leave much underfull; whole bins then join as items
    assert len({r.sequence_id for r in got}) <= 1.15 * sum(r[3] for r in rows) / 100
    halves = [(i, 0, 0, 60, i) for i in range(100)]  # no two fit together: all come out, none is gathered
    assert len({r.sequence_id for r in packing.pack(spark.createDataFrame(halves, packing.PIECE), capacity=100).collect()}) == 100


def test_empty_tables(documents):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert byte_bpe.encode(documents([]), path, pattern).count() == 0
    assert packing.pack_documents(documents([]), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_a_worker_lets_go_of_other_kernels_memory():
    import pyarrow as pa

    from panelforge.llm import common

    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_pydict({"text": ["a", None]})
    packing.WordCodec.of(path).encode(["some words"])
    assert len(list(common.text_chunks(batch, owner="packing"))) == 1 and path in packing.WordCodec.loaded
    list(common.text_chunks(batch))
    assert not packing.WordCodec.loaded and not [k for k in common.kept if k[0] == "packing"]
    assert packing.WordCodec.of(path).encode(["some words"])
