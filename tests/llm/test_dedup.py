import collections
import hashlib
import re

import numpy as np
import pytest

from panelforge.llm import anchors, line_dedup, ngram_join, phrases, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LAST = 2**63 - 1


def order(i):
    return LAST if i is None else i


def corpus():
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[vocabulary[j] for j in r.integers(0, 400, r.integers(5, 160))] for _ in range(60)]
    shared = [vocabulary[j] for j in r.integers(0, 400, 40)]
    rows = []
    for i, t in enumerate(texts):
        if i % 5 == 0:
            t = t[:10] + shared + t[10:]
        if i % 7 == 3:
            t = list(texts[i - 1])
            t[int(r.integers(0, len(t)))] = "edited"
        sep = "\n" if i % 3 else " "
        rows.append((i, sep.join(" ".join(t[k : k + 9]) for k in range(0, len(t), 9))))
    return rows


def brute_phrases(rows):
    docs = [(order(i), WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, LAST), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("limit", [50_000, 3])
def test_phrases(documents, odd_rows, monkeypatch, limit):
    monkeypatch.setattr(anchors, "GROUP_REGIONS", limit)  # 3: groups settled window by window
    rows = odd_rows + [(100 + i, t) for i, t in corpus()]
    got = phrases.remove_phrases(documents(rows)).collect()
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == brute_phrases(rows)


def brute_substrings(rows, width=200):
    count = collections.Counter()
    data = [(order(i), (t or "").encode()) for i, t in rows]
    for _, b in data:
        count.update(b[j : j + width] for j in range(len(b) - width + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - width + 1):
            if count[b[j : j + width]] > 1:
                gone[j : j + width] = True
        spans = int((np.diff(np.concatenate([[0], gone[:-1].astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return sorted(out)


@pytest.mark.parametrize("limit", [50_000, 3])
def test_substrings(documents, odd_rows, monkeypatch, limit):
    monkeypatch.setattr(anchors, "GROUP_REGIONS", limit)
    rows = odd_rows + [(100 + i, t) for i, t in corpus()] + [(300, "ab" * 130), (301, "z" * 215), (302, "p" * 199), (303, ("q" * 30 + "r" * 30) * 5)]
    got = substrings.remove_substrings(documents(rows)).collect()
    assert sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_substrings(rows)


def test_suffix_sort():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[100:500]
    s = substrings.Suffixes(data)
    start = np.arange(len(data) - substrings.WIDTH + 1)
    got = s.sort(r.permutation(start), np.zeros(len(start), np.int64))
    keys = [data[i : i + substrings.WIDTH].tobytes() for i in got]
    assert keys == sorted(keys) and sorted(got.tolist()) == start.tolist()


def brute_components(rows):
    nodes = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        nodes.append((i, s))
    parent = list(range(len(nodes)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[top(a)] = top(b)
    least = {}
    for n, (i, _) in enumerate(nodes):
        least[top(n)] = min(least.get(top(n), LAST), order(i))
    return sorted((order(i), len(s), least[top(n)]) for n, (i, s) in enumerate(nodes))


@pytest.mark.parametrize("cell", [50_000, 2])
def test_ngram_join(documents, odd_rows, monkeypatch, cell):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    rows = odd_rows + [(100 + i, t) for i, t in corpus()] + [(i, " ".join(f"c{j + (i - 400) * 4}" for j in range(60))) for i in range(400, 412)]
    got = ngram_join.ngram_components(documents(rows)).collect()
    assert sorted((order(r.doc_id), r.n_shingles, order(r.component_id)) for r in got) == brute_components(rows)


def test_a_group_of_copies_is_held_as_one_row():
    import pyarrow as pa

    seen = []

    def spy(batch, starts):
        seen.append(batch.num_rows)
        return ngram_join.in_two_groups(batch, starts)

    same = [pa.RecordBatch.from_pydict({"tok": [7] * 1000, "g": [1] * 1000}) for _ in range(50)]
    last = pa.RecordBatch.from_pydict({"tok": [7, 8], "g": [2, 3]})
    got = list(anchors.groups_that(iter([*same, last]), spy, "tok", alike=True))
    assert max(seen) <= 1001 and {g for b in got for g in b.column("g").to_pylist()} == {1, 2}


def test_families_around_many_leaders(documents):
    """A chain of near copies, of which no single one is near to all."""
    r = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for j in r.integers(0, 120, 1 + i % 3):
            t[j] = f"x{r.integers(0, 40)}"
        rows.append((i, " ".join(t)))
    got = ngram_join.ngram_components(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows):
    docs = {}
    for i, t in rows:  # rows that repeat id and text are one document
        docs.setdefault((order(i), t or ""), 0)
        docs[order(i), t or ""] += 1
    assert len({i for i, _ in docs}) == len(docs)
    first = {}
    for i, t in sorted(docs):
        for n, line in enumerate(t.split("\n")):
            if len(line) >= 20:
                first.setdefault(line, (i, n))
    late = {a for a in first for b in first if a != b and first[b] < first[a] and abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2}
    out = []
    for (i, t), times in docs.items():
        lines = t.split("\n")
        kept = [x for n, x in enumerate(lines) if len(x) < 20 or (x not in late and first[x] == (i, n))]
        out += [(i, len(lines), len(lines) - len(kept), "\n".join(kept))] * times
    return sorted(out)


def test_lines(documents):
    base = "the quick brown fox jumps over the lazy dog"
    rows = [
        (0, f"{base}\nshort\nsome other line of enough length"),
        (1, f"{base}\nshort"),
        (2, f"{base}s\nthe quick brown fx jumps over the lazy dg\nthe quick brown fox jumps over a lazy dog"),
        (3, None),
        (4, ""),
        (5, "\n\n" + base[2:] + "\n"),
        (6, "ünïcödé line with accents, long enough\nünïcode line with accents, long enough"),
        (7, "x" * 5000 + "\n" + "x" * 5001),
        (8, f"{base}\n{base}"),
        (9, "repeated row with a line that is long enough"),
        (9, "repeated row with a line that is long enough"),
        (None, "some other line of enough lengths"),
    ]
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert sorted((order(r.doc_id), r.n_lines, r.n_removed, r.text) for r in got) == brute_lines(rows)


def test_short_copies_go_in_query_and_pipeline(spark, documents, tmp_path):
    long = "the quick brown fox jumps over the lazy dog"
    docs = documents([(1, f"Les.\n\nLes.\n{long}"), (2, f"a\nLes.\nLet.\n\n{long}s"), (3, f"a\n{long}\n"), (4, "Nt onor. The of it.\nNt onor. The of it"), (5, "Nt onor. The of it.")])
    kept = {1: f"Les.\n\n{long}", 2: "a\nLet.\n", 3: "", 4: "Nt onor. The of it.\nNt onor. The of it", 5: ""}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}
    assert {r.doc_id: r.n_removed for r in got} == {1: 1, 2: 2, 3: 2, 4: 0, 5: 1}
    staged = dict(pytest.importorskip("corpus_pipeline").STAGES)["line dedup"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in staged} == kept


@pytest.mark.parametrize("hot", [32, 1])
def test_line_join_finds_every_pair(documents, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)  # 1: nearly all segments go to the second level
    r = np.random.default_rng(3)
    rows = []
    for i in range(120):
        line = "".join(r.choice(list("ab"), 24))
        rows.append((i, line))
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert sorted((order(x.doc_id), x.n_lines, x.n_removed, x.text) for x in got) == brute_lines(rows)


@pytest.mark.parametrize("few, hot", [(1, 32), (1, 8), (4, 8)])
def test_warm_segments_meet_by_counts(documents, monkeypatch, few, hot):
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = np.random.default_rng(5)
    rows = [(i, "".join(r.choice(list("ab"), 24))) for i in range(80)]
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert sorted((order(x.doc_id), x.n_lines, x.n_removed, x.text) for x in got) == brute_lines(rows)


def test_segment_of_a_group_makes_few_pairs(documents):
    """Thirty lines share a segment and differ widely elsewhere: candidates are few, not all pairs."""
    r = np.random.default_rng(7)
    rows = [(i, "the segment that all share." + "".join(r.choice(list("etaoinshrd"), 54))) for i in range(30)] + [(30, "the segment that all share." + "x" * 54), (31, "the segment that all share." + "x" * 53 + "y")]
    lines = documents(rows).selectExpr("doc_id AS k", "0 AS at", "text AS line", "length(text) AS n")
    keys = line_dedup.keys(lines, line_dedup.index_moves(2), 2).groupBy("key").count()
    shared = [x.key for x in keys.where("count > 4").collect()]
    asked = lines.selectExpr("*", f"array({', '.join(f"struct({x}L AS key, false AS hot)" for x in shared)}) AS asked")
    pairs = {(x.k, x.k2) for x in line_dedup.second_pairs(asked, 2).collect()}
    assert {(30, 31), (31, 30)} <= pairs and len(pairs) < 30
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(documents(rows)).collect()}
    assert got == {i: int(i == 31) for i in range(32)}


def test_many_near_copies_of_one_line(documents):
    """Lines that share their segments, most of them further than two edits from each other."""
    r = np.random.default_rng(11)
    words = [str(w) for w in r.choice(["the", "river", "stone", "and", "house", "green", "light", "under", "walks", "of"], 24)]
    rows = []
    for i in range(150):
        line = list(words)
        for j in r.integers(0, 24, i % 3):
            line[j] = "".join(r.choice(list("etaoinshq"), 6))
        text = " ".join(line)
        at = int(r.integers(0, len(text)))
        rows.append((i, text if i % 4 else text[:at] + "z" + text[at + 1 :]))
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert sorted((order(x.doc_id), x.n_lines, x.n_removed, x.text) for x in got) == brute_lines(rows)


def test_empty_tables(documents):
    none = documents([])
    for f in (phrases.remove_phrases, substrings.remove_substrings, ngram_join.ngram_components, line_dedup.dedup_lines):
        assert f(none).count() == 0
    blank = documents([(1, None), (2, "")])
    assert [r.n_removed for r in substrings.remove_substrings(blank).collect()] == [0, 0]
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_components(blank).collect()} == {(1, 1), (2, 2)}


