"""N-gram Jaccard join: grouped prefix join over 5-word shingle sets.

Equal sets are one node, and nodes with the same size and the same prefix one group, so copies
meet nothing twice.  In each shingle's bucket groups first meet only a leader; verified, that
joins nearly all that belongs together at linear cost.  Then the buckets that groups of different
components share are read again, and only such groups make pairs, which position, size and a
sketch of each set prune before members are expanded and verified.  Shingles found frequent anywhere order last, so prefixes
hold rare ones.  Which are frequent affects speed only: any order gives the same links.

Defined cases: null text, or no word: an empty set linked with nothing; fewer than five words:
the whole sequence is the one shingle; repeated rows and ids are nodes by their sets; a null
id orders last and is null as a component's id only if the component has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.anchors import groups_that
from panelforge.llm.common import WORD_POWERS, PrefixHash, Texts, doc_id, durable, keyed, mix, text_chunks
from panelforge.llm.components import components

WORDS = 5
_U = np.uint64
HOT_BIT = _U(1 << 63)
HOT_LIMIT, HOT_COUNT, BLOCK = 200_000, 32, 1 << 21
TURNS, LARGE = 3, 32  # rounds of leaders after the first, in buckets of more rows than that


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every shingle, repeats included; the top bit is free."""
    _, _, first, h = t.word_hashes(lower=True)
    n = np.diff(first)
    grams = PrefixHash(h, WORD_POWERS).fixed(WORDS)
    at = np.arange(len(grams))
    doc = np.searchsorted(first, at, "right") - 1
    ok = at + WORDS <= first[doc + 1] if len(at) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    whole = PrefixHash(h, WORD_POWERS).slices(first[short], first[short + 1]) + n[short].astype(np.uint64)
    return np.concatenate([mix(grams[ok]), mix(whole)]) >> _U(1), np.concatenate([doc[ok], short])


def ordered_sets(t: Texts, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's set in the global order, frequent shingles last: (tokens, first of each document)."""
    h, doc = shingles(t)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        h = np.where(hot[at] == h, h | HOT_BIT, h)
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(t.offsets)))


def frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that stand out in some block of the input, by their counts over all blocks.

    The list is bounded by HOT_LIMIT; it orders shingles and decides nothing else.
    """

    def emit(parts):
        v, c = np.unique(np.concatenate(parts), return_counts=True)
        many = c >= 3
        return pa.RecordBatch.from_arrays([pa.array(v[many].view(np.int64)), pa.array(c[many])], ["h", "n"])

    def run(batches):
        parts, have = [], 0
        for batch in batches:
            for part in text_chunks(batch):
                h = shingles(Texts(part.column("text")))[0]
                parts.append(h)
                have += len(h)
                if have > BLOCK:
                    yield emit(parts)
                    parts, have = [], 0
        if have:
            yield emit(parts)

    found = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "h").limit(HOT_LIMIT).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().astype(np.int64).view(np.uint64))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def described(h, first, percent):
    """Per document: size, length of the prefix, set hash, group (of equal size and prefix)."""
    n = np.diff(first)
    p = np.minimum(prefix_length(n, percent), n)
    ph = PrefixHash(mix(h), WORD_POWERS)
    sig = mix(ph.slices(first[:-1], first[1:]) + mix(n.astype(np.uint64)))
    group = mix(ph.slices(first[:-1], first[:-1] + p) + mix(n.astype(np.uint64) + _U(1)))
    return n, p, sig.view(np.int64), group.view(np.int64)


RANGES, MOST_RANGES, ROUGH, SKETCH_LIMIT = 256, 1 << 16, 64, 16_000
FILTER_BITS, BITMAP = 1 << 26, 1 << 15  # bits of the filter before texts are dealt, at most 8 MB; bits of one of its rows
EARLIER = ("e1", "e2", "e3")


def sketches(h, first, ranges: np.ndarray) -> pa.Array:
    """How many shingles of each set fall into each of its ranges of hashes (a power of two), one byte each.

    The sum of the smaller counts bounds the overlap of two sets from above.  A set with a
    count over 254 has 255 throughout, which bounds nothing.
    """
    n = len(first) - 1
    start = np.concatenate([[0], np.cumsum(ranges)])
    doc = np.repeat(np.arange(n), np.diff(first))
    part = ((h >> _U(40)) & (ranges[doc] - 1).astype(np.uint64)).astype(np.int64)
    count = np.bincount(start[doc] + part, minlength=int(start[-1]))
    if n:
        count[np.repeat(np.maximum.reduceat(count, start[:-1]) > 254, ranges)] = 255
    flat = np.ascontiguousarray(count.astype(np.uint8))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(start.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def fine_ranges(n: np.ndarray) -> np.ndarray:
    """Ranges of each set's fine sketch: RANGES, and from there on at most four shingles a range.

    With many shingles to a range the smaller counts add up to nearly the whole set, whatever the sets hold.
    """
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 4)).clip(0).astype(np.int64), RANGES, MOST_RANGES)


NO_SKETCH, NO_ROUGH = b"\xff" * RANGES, b"\xff" * ROUGH


def nodes(docs: DataFrame, hot, percent: int) -> DataFrame:
    """(k, did, n, sig, g, sk, rough) of each document, with a fine and a rough sketch."""

    def run(batches):
        table = hot.value
        for batch in batches:
            for part in text_chunks(batch):
                h, first = ordered_sets(Texts(part.column("text")), table)
                n, _, sig, group = described(h, first, percent)
                cols = [part.column("k"), part.column("did"), pa.array(n), pa.array(sig), pa.array(group), sketches(h, first, fine_ranges(n)), sketches(h, first, np.full(len(n), ROUGH))]
                yield pa.RecordBatch.from_arrays(cols, ["k", "did", "n", "sig", "g", "sk", "rough"])

    return docs.mapInArrow(run, "k long, did long, n long, sig long, g long, sk binary, rough binary")


def prefixes(docs: DataFrame, hot, percent: int) -> DataFrame:
    """(tok, g, n, pos) of each shingle in each document's prefix."""

    def run(batches):
        table = hot.value
        for batch in batches:
            for part in text_chunks(batch):
                h, first = ordered_sets(Texts(part.column("text")), table)
                n, p, _, group = described(h, first, percent)
                _, one = np.unique(group, return_index=True)  # copies within the batch
                one = one[p[one] > 0]
                count = p[one]
                pos = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                tok = h[np.repeat(first[:-1][one], count) + pos]
                cols = [pa.array(tok.view(np.int64)), pa.array(np.repeat(group[one], count)), pa.array(np.repeat(n[one], count).astype(np.int32)), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["tok", "g", "n", "pos"])

    return docs.mapInArrow(run, "tok long, g long, n int, pos int")


PAIR = "x long, y long, nx int, ny int"


def stars(percent: int):
    """From rows sorted by shingle and any order within: each group with its bucket's leader of matching size.

    The first group of a bucket leads all that match its size, the first of the rest leads
    next, and so on: as many leaders as sizes differ, however many groups there are.
    """

    def run(batches):
        carry = None
        for batch in batches:
            tok, g, n = (batch.column(c).to_numpy() for c in ("tok", "g", "n"))
            if carry is not None:
                tok, g, n = (np.concatenate([c, v]) for c, v in zip(carry, (tok, g, n), strict=True))
            if not len(tok):
                continue
            n = n.astype(np.int64)
            out, leaders, left = [], [], np.arange(len(tok))
            while len(left):
                head = np.ones(len(left), bool)
                head[1:] = tok[left[1:]] != tok[left[:-1]]
                lead = left[np.maximum.accumulate(np.where(head, np.arange(len(left)), 0))]
                near = (np.minimum(n[left], n[lead]) * 100 >= np.maximum(n[left], n[lead]) * percent) | head
                pair = near & (g[lead] != g[left])
                out.append((g[lead[pair]], g[left[pair]], n[lead[pair]], n[left[pair]]))
                if tok[left[-1]] == tok[-1]:
                    leaders.append(int(lead[-1]))
                left = left[~near]
            # the last bucket may go on: its leaders open the next batch
            carry = (tok[leaders], g[leaders], n[leaders])
            x, y, nx, ny = (np.concatenate(v) for v in zip(*out, strict=True))
            if len(x):
                cols = [pa.array(x), pa.array(y), pa.array(nx.astype(np.int32)), pa.array(ny.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["x", "y", "nx", "ny"])

    return run


def crossings(percent: int):
    """From rows sorted by (cell, n, g): pairs of groups of different components.

    Two sets that link have a first common shingle, and at it both have room for the overlap they
    need; so a pair is made only where there is that room and their sketches allow the overlap.
    It is not made where the three shared shingles before this one (EARLIER) have one in common,
    as it was made further up.  A cell of two blocks pairs across them.
    """

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cell = batch.column("cell").to_numpy()
            end = int(np.argmax(cell == cell[-1])) if len(cell) else 0
            held = batch.slice(end)  # a cell has at most twice CELL rows
            yield from emit(batch.slice(0, end))
        if held is not None:
            yield from emit(held)

    def emit(batch):
        cell, g, n, pos, c, block, two = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "g", "n", "pos", "c", "block", "two"))
        sk = Texts(batch.column("rough")).data.reshape(-1, ROUGH)
        if not len(cell):
            return
        before = [batch.column(e).to_numpy(zero_copy_only=False) for e in EARLIER]
        keep = np.ones(len(cell), bool)
        keep[1:] = (cell[1:] != cell[:-1]) | (g[1:] != g[:-1])
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        mixed = np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
        keep &= np.repeat(mixed, np.diff(np.append(start, len(cell))))
        cell, g, c, block, two, sk, *before = (v[keep] for v in (cell, g, c, block, two, sk, *before))
        n, pos = n[keep].astype(np.int64), pos[keep].astype(np.int64)
        live, step = np.arange(len(cell)), 1
        while len(live):
            # every row with the row `step` further on
            live = live[live + step < len(cell)]
            other = live + step
            near = (cell[live] == cell[other]) & (n[other] * percent <= n[live] * 100)
            live, other = live[near], other[near]
            need = -(-(n[live] + n[other]) * percent // (100 + percent))
            room = np.minimum(n[live] - pos[live], n[other] - pos[other])
            go = (c[live] != c[other]) & (room >= need) & (~two[live] | (block[live] != block[other]))
            for a in before:
                for b in before:
                    go &= (a[live] != b[other]) | (a[live] == 0)
            some = np.flatnonzero(go & (np.maximum(n[live], n[other]) <= SKETCH_LIMIT))
            for at in range(0, len(some), 1 << 14):  # the sketches' bound, in pieces of bounded size
                i = some[at : at + (1 << 14)]
                most = np.minimum(sk[live[i]], sk[other[i]]).sum(1, dtype=np.int64)
                go[i[most < need[i]]] = False
            if go.any():
                yield pa.RecordBatch.from_arrays([pa.array(g[live[go]]), pa.array(g[other[go]])], ["x", "y"])
            step += 1

    return run


CELL, BIG = 50_000, 100_000  # rows of a cell; buckets cut into cells, the largest first


def in_cells(shared: DataFrame, of_group: DataFrame) -> DataFrame:
    """Rows (cell, g, n, pos, c, rough, EARLIER, block, two) of shared prefixes (tok, g, n, pos), sorted
    by cell and size; of_group: (g, c, rough).

    A bucket is a cell; one of over CELL rows is cut into blocks, and each pair of blocks is a cell.
    EARLIER are the group's shared shingles just before, 0 where there is none.
    """
    # a group whose copies were read in several batches has its rows several times
    rows = shared.repartition("g").groupBy("g", "pos").agg(F.min("tok").alias("tok"), F.min("n").alias("n"))
    up = Window.partitionBy("g").orderBy("pos")
    rows = rows.select("*", *[F.lag("tok", i + 1, 0).over(up).alias(e) for i, e in enumerate(EARLIER)]).join(of_group, "g")
    big = shared.groupBy("tok").count().where(F.col("count") > CELL).select("tok", F.ceil(F.col("count") / CELL).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(big.orderBy(F.desc("blocks"), "tok").limit(BIG)), "tok", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.col("tok")).otherwise(F.xxhash64("tok", F.least("block", "to"), F.greatest("block", "to")))
    rows = rows.select(cell.alias("cell"), "g", "n", "pos", "c", "rough", *EARLIER, "block", (F.col("block") != F.col("to")).alias("two"))
    return rows.repartition("cell").sortWithinPartitions("cell", "n", "g")


def plausible(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) of groups, those whose sketches (g, n, sk) allow the overlap they need."""

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            nx, ny = (batch.column(c).to_numpy().astype(np.int64) for c in ("nx", "ny"))
            need = -(-(nx + ny) * percent // (100 + percent))
            a, b = (Texts(batch.column(c)) for c in ("skx", "sky"))
            la, lb = np.diff(a.offsets), np.diff(b.offsets)
            for wa, wb in set(zip(la.tolist(), lb.tolist(), strict=True)):
                rows, small = np.flatnonzero((la == wa) & (lb == wb)), min(wa, wb)
                step = max(1, (1 << 21) // max(wa, wb))
                for i in (rows[at : at + step] for at in range(0, len(rows), step)):
                    one, two = (t.data[t.offsets[i][:, None] + np.arange(w)] for t, w in ((a, wa), (b, wb)))
                    open_ = (one[:, 0] == 255) | (two[:, 0] == 255)  # one that bounds nothing
                    # the larger sketch folds onto the ranges of the smaller one
                    one, two = (v.reshape(len(i), -1, small).sum(1, dtype=np.int64) for v in (one, two))
                    keep[i] = open_ | (np.minimum(one, two).sum(1) >= need[i])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("x", "y")], ["x", "y"]).filter(pa.array(keep))

    for side in "xy":
        pairs = pairs.join(sketch.select(F.col("g").alias(side), F.col("n").alias("n" + side), F.col("sk").alias("sk" + side)), side)
    return pairs.select("x", "y", "nx", "ny", "skx", "sky").mapInArrow(run, "x long, y long")


def maybe_named(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of docs whose k may be in named, so that the exchange before the exact join leaves out the rest.

    A bit array of FILTER_BITS hashed bits, at most FILTER_BITS / BITMAP rows of 4 KB however many
    keys there are; with more keys than bits it only lets more rows through.
    """
    bit = F.pmod(F.xxhash64("k"), F.lit(FILTER_BITS))
    bits = named.select(bit.alias("bit")).groupBy(F.expr(f"bit div {BITMAP}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"bit % {BITMAP}")).alias("bits"))
    docs = docs.withColumn("bit", bit).withColumn("part", F.expr(f"bit div {BITMAP}")).join(F.broadcast(bits), "part")
    byte = F.expr(f"cast(conv(hex(substring(bits, cast((bit % {BITMAP}) div 8 + 1 as int), 1)), 16, 10) as int)")
    return docs.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0).select("k", "text")


def linked(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v, ku, kv) of nodes and documents that hold them, those that link: (u, v).

    Only the texts of documents in a pair are dealt.
    """
    pairs = durable(pairs)

    def run(batches):
        for batch in batches:
            # one exchange row holds two texts; of equal ones in a slice one is read
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, fx, ix = sets_of(part.column("tx"))
                y, fy, iy = sets_of(part.column("ty"))
                ok = []
                for i, j in zip(ix, iy, strict=True):
                    a, b = x[fx[i] : fx[i + 1]], y[fy[j] : fy[j + 1]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(100 * both >= percent * (len(a) + len(b) - both))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("u").filter(keep), part.column("v").filter(keep)], ["u", "v"])

    def sets_of(column):
        coded = column.dictionary_encode()
        return *ordered_sets(Texts(coded.dictionary), np.zeros(0, np.uint64)), coded.indices.to_pylist()

    named = pairs.select(F.col("ku").alias("k")).unionByName(pairs.select(F.col("kv").alias("k"))).distinct()
    texts = maybe_named(docs.select("k", "text"), named).join(named, "k").repartition("k")
    with_v = pairs.join(texts.withColumnsRenamed({"k": "kv", "text": "ty"}), "kv").select("u", "v", "ku", "ty")
    both = with_v.join(texts.withColumnsRenamed({"k": "ku", "text": "tx"}), "ku").select("u", "v", "tx", "ty")
    return both.mapInArrow(run, "u long, v long")


def in_two_groups(batch, starts):
    g = batch.column("g").to_numpy()
    return np.minimum.reduceat(g, starts) != np.maximum.reduceat(g, starts)


def ngram_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    spark = docs.sparkSession
    docs = keyed(docs)
    hot = spark.sparkContext.broadcast(frequent(docs))
    node = durable(nodes(docs, hot, percent))
    some = node.where("n > 0")
    # equal sets are one node; a group's lead is its node with the least id
    sets = some.groupBy("sig", "g", "n").agg(F.min(F.struct("did", "k")).alias("at"), F.min("sk").alias("sk"), F.min("rough").alias("rough")).select("sig", "g", "n", "sk", "rough", "at.did", "at.k")
    sets = durable(sets)
    lead = sets.groupBy("g").agg(F.min(F.struct("did", "sig", "k")).alias("l")).select("g", F.col("l.sig").alias("sig"), F.col("l.k").alias("k"))

    # one shuffle of all prefixes keeps only the shingles that two groups share
    shared = prefixes(docs, hot, percent).repartition("tok").sortWithinPartitions("tok")
    shared = durable(shared.mapInArrow(lambda batches: groups_that(batches, in_two_groups, "tok", alike=True), "tok long, g long, n int, pos int"))
    # round 1: leaders only
    # smallest groups lead, and those in which the shingle stands first: a group of copies has its
    # source there, since what only a copy has orders before what all share
    dealt_again = shared.repartition("tok")
    met = dealt_again.sortWithinPartitions("tok", "n", "g").mapInArrow(stars(percent), PAIR)
    met = met.unionByName(dealt_again.sortWithinPartitions("tok", "pos", "n", "g").mapInArrow(stars(percent), PAIR))
    met = met.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("c"))
    need = F.expr(f"ceil((nx + ny) * {percent} / {100 + percent})")
    rest = F.expr(f"greatest(nx - (nx - ceil(nx * {percent} / 100) + 1), ny - (ny - ceil(ny * {percent} / 100) + 1))")
    best = met.where(F.col("c") >= need - rest).groupBy("y").agg(F.max(F.struct("c", "x")).alias("b")).select("y", F.col("b.x").alias("x"))
    # a group of several sets has no sketch that bounds each of them
    sketch = sets.groupBy("g", "n").agg(F.count("*").alias("m"), F.min("sk").alias("sk")).select("g", "n", F.when(F.col("m") == 1, F.col("sk")).otherwise(F.lit(NO_SKETCH)).alias("sk"))
    star = plausible(best, sketch, percent).join(lead.select(F.col("g").alias("x"), F.col("sig").alias("u"), F.col("k").alias("ku")), "x")
    star = star.join(sets.select(F.col("g").alias("y"), F.col("sig").alias("v"), F.col("k").alias("kv")), "y").select("u", "v", "ku", "kv")
    own = sets.join(lead.select("g", F.col("sig").alias("u"), F.col("k").alias("ku")), "g").where("sig <> u").select("u", F.col("sig").alias("v"), "ku", F.col("k").alias("kv"))
    first = durable(linked(docs, star.unionByName(own), percent))
    edges, large = first, None
    for turn in range(TURNS + 1):
        label = components(edges)
        marked = sets.select("sig", "g", "n", "k").join(label.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("c", F.coalesce("root", "sig")).drop("root")
        by_group = marked.groupBy("g").agg(F.min("c").alias("c"), F.max("c").alias("c2"))
        # a group whose members lie apart is apart from every group, itself included
        apart = F.col("c") != F.col("c2")
        by_group = durable(by_group.select("g", F.when(apart, F.xxhash64("g")).otherwise(F.col("c")).alias("c"), apart.alias("apart")))
        if turn == TURNS:
            break
        if large is None:  # small buckets make few pairs for each row
            at_hand = shared.repartition("tok")
            large = durable(at_hand.join(at_hand.groupBy("tok").count().where(F.col("count") > LARGE).select("tok"), "tok", "left_semi"))
        # one more round of leaders, drawn anew: each component tries the group it meets most often
        met = large.repartition("tok").sortWithinPartitions("tok", F.xxhash64("g", F.lit(turn)), "g").mapInArrow(stars(percent), PAIR)
        met = met.groupBy("x", "y").agg(F.count("*").alias("m"))
        for side in "xy":
            met = met.join(by_group.select(F.col("g").alias(side), F.col("c").alias("c" + side)), side)
        best = met.where("cx <> cy").groupBy("cy").agg(F.max(F.struct("m", "x", "y")).alias("b")).select("b.x", "b.y")
        best = plausible(best, sketch, percent)
        for side, u in (("x", "u"), ("y", "v")):
            best = best.join(lead.select(F.col("g").alias(side), F.col("sig").alias(u), F.col("k").alias("k" + u)), side)
        more = durable(linked(docs, best.select("u", "v", "ku", "kv"), percent))
        if not more.limit(1).count():
            break
        edges = edges.unionByName(more)

    # round 2: what the leaders left apart
    rough = sets.groupBy("g").agg(F.count("*").alias("m"), F.min("rough").alias("rough")).select("g", F.when(F.col("m") == 1, F.col("rough")).otherwise(F.lit(NO_ROUGH)).alias("rough"))
    across = in_cells(shared, by_group.select("g", "c").join(rough, "g")).mapInArrow(crossings(percent), "x long, y long").distinct()
    across = plausible(across, sketch, percent)
    across = across.unionByName(by_group.where("apart").select(F.col("g").alias("x"), F.col("g").alias("y")))
    for side, u in (("x", "u"), ("y", "v")):
        across = across.join(marked.select(F.col("g").alias(side), F.col("sig").alias(u), F.col("k").alias("k" + u), F.col("c").alias("c" + u)), side)
    second = durable(linked(docs, across.where("cu <> cv AND u <> v").select("u", "v", "ku", "kv").distinct(), percent))
    if second.limit(1).count():
        label = components(edges.unionByName(second))

    place = sets.select("sig", "did").join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = place.groupBy("root").agg(F.min("did").alias("least"))
    where = place.select("sig", "root").join(least, "root").select("sig", "least")
    out = node.select("did", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(where, "sig", "left")
    return out.select(doc_id(), F.col("n").alias("n_shingles"), doc_id(F.coalesce("least", "did")).alias("component_id"))
