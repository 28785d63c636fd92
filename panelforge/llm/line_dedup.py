"""Line dedup by segment-partition edit join, in DataFrame functions only.

Lines are the parts of a text between line feeds.  Equal lines are one line, placed where it
first stands.  Each line of length l is cut into TAU + 1 segments; a line within TAU edits has
one of them as a substring at a place that its length and the segment's number bound, so it
probes an index keyed by (length, number, segment).  Candidates are verified by edit distance.

Where more than FEW different lines share a segment, near copies as a rule, what lies left and
right of the segment is described by counts of LETTERS on each side; an edit changes two of them
at most, so lines whose counts differ by more than 2 TAU are no pair.  Where over HOT lines share
it, a second level replaces the key, too: of 2 TAU + 3 groups of counts all but 2 TAU are equal, and
the lines meet under every choice of that many groups.  Both are exact.

Equal lines are those with two equal hashes of 64 bits, drawn with independent seeds.

A line goes if it, or a line within TAU edits of it, stands earlier (by doc_id, then line
number).  Lines of fewer than min_chars characters are not compared by edits; equal ones are
counted from min_copy characters on, so with min_copy = 1 every copy of a line that is not empty goes.

Defined cases: null text is the empty text; an empty table gives no rows; null ids order last;
rows that repeat both id and text are one document and keep the same lines; rows that share an
id only are ordered by a hash of their texts; other columns are not carried.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import doc_id, durable, keyed

TAU, MIN_CHARS = 2, 20
FEW, HOT, LETTERS = 4, 32, "etaoinshrdlucmwfgypbvk ,."


def cuts(lines: DataFrame, moves: list[tuple[int, int, int]], tau: int) -> DataFrame:
    """lines (with line, n) and, for each (delta, i, move), a row with the place and size of the
    substring where segment i of a line shorter by delta (of length m) would lie, moved.

    Segments are even, the last ones longer by one where needed.  The moves are rows of a constant
    array, so the code stays small however many they are.
    """
    parts = tau + 1
    c = F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(i).alias("i"), F.lit(m).alias("move")) for d, i, m in moves])
    x = lines.withColumn("c", F.explode(c)).selectExpr("*", "n - c.delta AS m", f"CAST((n - c.delta) DIV {parts} AS int) AS short", f"{parts} - CAST((n - c.delta) % {parts} AS int) AS even")
    x = x.withColumns({"place": F.expr("short * c.i + greatest(0, c.i - even) + c.move"), "size": F.expr("short + IF(c.i >= even, 1, 0)")})
    return x.where("place >= 0 AND place + size <= n").withColumn("key", F.expr("xxhash64(m, c.i, substring(line, place + 1, size))"))


def keys(lines: DataFrame, moves: list[tuple[int, int, int]], tau: int) -> DataFrame:
    """(k, at, key) of lines (k, at, line, n)."""
    return cuts(lines, moves, tau).select("k", "at", "key")


def second_keys(lines: DataFrame, moves: list[tuple[int, int, int]], tau: int) -> DataFrame:
    """(k, at, key2, many, last, groups, counts) of lines (k, at, line, n, asked) under the keys asked for: a row
    for a warm key, and for a hot one (many) a row for each choice of groups of counts, of which last is the last."""
    of, n = 2 * tau + 3, 2 * len(LETTERS)

    def under(hot: bool) -> DataFrame:
        x = cuts(lines, moves, tau).where(F.array_contains("asked", F.struct(F.col("key"), F.lit(hot).alias("hot"))))
        sides = F.substring("line", F.lit(1), F.col("place")), F.substr("line", F.col("place") + F.col("size") + 1)
        counts = F.array(*[F.length(s) - F.length(F.translate(s, c, "")) for c in LETTERS for s in sides])
        x = x.select("k", "at", "key", once(counts).alias("counts"))
        return x.select("k", "at", "key", "counts", once(F.array(*[F.xxhash64(F.lit(g), *[F.col("counts")[i] for i in range(g, n, of)]) for g in range(of)])).alias("groups"))

    warm = under(False).select("k", "at", F.col("key").alias("key2"), F.lit(False).alias("many"), F.lit(0).alias("last"), "groups", "counts")
    chosen = [F.struct(F.xxhash64("key", *[F.col("groups")[j] for j in c]).alias("key2"), F.lit(c[-1]).alias("last")) for c in itertools.combinations(range(of), of - 2 * tau)]
    hot = under(True).select("k", "at", "counts", "groups", F.explode(F.array(*chosen)).alias("c"))
    return warm.unionByName(hot.select("k", "at", "c.key2", F.lit(True).alias("many"), "c.last", "groups", "counts"))


def second_pairs(lines: DataFrame, tau: int) -> DataFrame:
    """(k, at, k2, at2) of lines under a warm or hot key whose counts differ by no more than the edits allow;
    under a hot key a pair is made under the first choice of groups that agree."""
    one = second_keys(lines, index_moves(tau), tau)
    two = second_keys(lines, probe_moves(tau), tau).select(F.col("k").alias("k2"), F.col("at").alias("at2"), "key2", F.col("groups").alias("groups2"), F.col("counts").alias("counts2"))
    first = F.size(F.filter(F.sequence(F.lit(0), F.col("last")), lambda i: F.get("groups", i) == F.get("groups2", i))) == 3
    apart = F.aggregate(F.zip_with("counts", "counts2", lambda a, b: F.abs(a - b)), F.lit(0), lambda a, b: a + b)
    met = (one["key2"] == two["key2"]) & (F.struct("k", "at") != F.struct(F.col("k2").alias("k"), F.col("at2").alias("at"))) & (~F.col("many") | first) & (apart <= 2 * tau)
    return one.join(two, met).select("k", "at", "k2", "at2")


def index_moves(tau: int) -> list[tuple[int, int, int]]:
    return [(0, i, 0) for i in range(tau + 1)]


def probe_moves(tau: int) -> list[tuple[int, int, int]]:
    """Where a segment of a line no longer than this one can lie: multi-match-aware ranges."""
    return [(d, i, m) for d in range(tau + 1) for i in range(tau + 1) for m in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1)]


def once(value: Column) -> Column:
    """A value that later expressions read and don't compute again: a generator stands between."""
    return F.explode(F.array(value))


def other(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"k": "k2", "at": "at2"})


def near(line: Column, other: Column, tau: int) -> Column:
    return F.levenshtein(line, other, tau) >= 0


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, carry: tuple[str, ...] = (), min_copy: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): documents without the lines that stand earlier.

    Lines of min_copy characters go where equal ones stand earlier, those of min_chars (no less than
    min_copy) also where near ones do.  Where ids are unique, columns named in carry follow.
    """
    rest = docs
    docs = keyed(docs)
    dealt = docs.select("k", "text").repartition("k")
    ids = docs.select("k", "did").distinct()
    split = F.split("text", "\n", -1)
    places = docs.select("k", "did", F.posexplode(split).alias("at", "line"))
    size = F.char_length("line")
    places = places.select("k", "did", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), (size >= min_copy).alias("counted"), (size >= min_chars).alias("long"))
    first = places.where("counted").groupBy("h1", "h2").agg(F.min(F.struct("did", "k", "at", "long")).alias("first"), F.count("*").alias("n"))
    first = durable(first.select("h1", "h2", "n", "first.did", "first.k", "first.at", "first.long"))

    # the distinct long lines, read where they first stand; every use of `dealt` reads the same columns
    # in one query, so that one exchange of the texts serves all
    ats = first.where("long").groupBy("k").agg(F.collect_list("at").alias("ats"))
    here = dealt.join(ats.hint("shuffle_hash"), "k").select("k", "ats", once(split).alias("lines"))
    lines = here.select("k", F.explode(F.transform("ats", lambda a: F.struct(a.alias("at"), F.get("lines", a).alias("line")))).alias("l"))
    lines = lines.select("k", "l.at", "l.line", F.char_length("l.line").alias("n"))
    index, probe = keys(lines, index_moves(tau), tau), keys(lines, probe_moves(tau), tau)
    few = min(FEW, HOT)
    # a key over few is met in one row only: every line under it also probes it with its own segment
    of_key = Window.partitionBy("key")
    index = index.select("k", "at", "key", F.count("*").over(of_key).alias("m"), F.row_number().over(of_key.orderBy("k", "at")).alias("row")).where((F.col("m") <= few) | (F.col("row") == 1))
    a, b = F.struct("k", "at"), F.struct(F.col("k2").alias("k"), F.col("at2").alias("at"))
    many = F.col("m") > few
    met = index.join(other(probe), "key").where(many | (a != b)).select("k2", "at2", F.struct(F.when(many, F.col("key")).alias("key"), (F.col("m") > HOT).alias("hot"), F.when(~many, a).alias("a")).alias("met"))
    # one column, so that both uses read one exchange
    met = met.groupBy("k2", "at2").agg(F.collect_set("met").alias("met"))
    first_level = met.select("k2", "at2", F.explode("met").alias("m")).where("m.a IS NOT NULL").select("m.a.k", "m.a.at", "k2", "at2")
    # lines under warm and hot keys, read again; a line's such keys are at most as many as its moves
    keys_met = F.transform(F.filter("met", lambda x: x["key"].isNotNull()), lambda x: F.struct(x["key"].alias("key"), x["hot"].alias("hot")))
    by_line = met.select(F.col("k2").alias("k"), F.struct(F.col("at2").alias("at"), keys_met.alias("asked")).alias("line"))
    asked = by_line.where(F.size("line.asked") > 0).groupBy("k").agg(F.collect_list("line").alias("asked"))
    here = dealt.join(asked.hint("shuffle_hash"), "k").select("k", "asked", once(split).alias("lines"))
    again = here.select("k", F.explode(F.transform("asked", lambda a: F.struct(a["at"].alias("at"), a["asked"].alias("asked"), F.get("lines", a["at"]).alias("line")))).alias("l"))
    again = again.select("k", "l.at", "l.asked", "l.line", F.char_length("l.line").alias("n")).repartition("k", "at")
    pairs = first_level.unionByName(second_pairs(again, tau))
    pairs = pairs.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    pairs = pairs.select(F.col("a.k").alias("k"), F.col("a.at").alias("at"), F.col("b.k").alias("k2"), F.col("b.at").alias("at2"))
    pairs = pairs.join(dealt, "k").withColumn("line", F.get(split, F.col("at"))).drop("text")
    pairs = pairs.join(dealt.withColumnRenamed("k", "k2"), "k2").withColumn("line2", F.get(split, F.col("at2"))).drop("text")
    found = pairs.where(near(F.col("line"), F.col("line2"), tau)).select("k", "at", "k2", "at2")
    found = found.join(ids, "k").join(ids.withColumnsRenamed({"k": "k2", "did": "did2"}), "k2")
    a, b = F.struct("did", "k", "at"), F.struct(F.col("did2").alias("did"), F.col("k2").alias("k"), F.col("at2").alias("at"))
    late = found.select(F.greatest(a, b).alias("l")).select("l.k", "l.at", F.lit(True).alias("late")).distinct()

    verdict = first.join(late, ["k", "at"], "left").where("n > 1 OR late")
    verdict = verdict.select("h1", "h2", F.col("k").alias("fk"), F.col("at").alias("fat"), F.coalesce("late", F.lit(False)).alias("late"))
    judged = places.join(verdict, ["h1", "h2"], "left")
    gone = F.col("counted") & F.col("late").isNotNull() & (F.col("late") | (F.col("k") != F.col("fk")) | (F.col("at") != F.col("fat")))
    judged = judged.select("k", F.struct("at", F.coalesce(gone, F.lit(False)).alias("gone")).alias("flag"))
    flags = judged.groupBy("k").agg(F.array_sort(F.collect_set("flag")).alias("flags"), F.max("flag.gone").alias("some")).where("some")
    out = dealt.join(flags.select("k", "flags").hint("shuffle_hash"), "k", "left").select("k", "text", "flags", once(split).alias("lines"))
    out = out.join(ids.hint("shuffle_hash"), "k")
    if carry:
        out = out.join(rest.select(F.col("doc_id").cast("long").alias("k"), *carry), "k", "left")
    kept = F.filter(F.zip_with("lines", "flags", lambda x, f: F.when(~f["gone"], x)), lambda x: x.isNotNull())
    removed = F.coalesce(F.size(F.filter("flags", lambda f: f["gone"])), F.lit(0))
    removed = F.when(F.col("flags").isNull(), 0).otherwise(removed)
    text = F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(doc_id(), F.size("lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), text.alias("text"), *carry)
