"""Line deduplication by a segment-partition edit join. DataFrame functions only.

Two lines are alike if at most one edit (a character put in, left out or replaced) parts them. Of two
such lines, cut alike into two segments (the threshold plus one), one segment is the same in both. So a
line is indexed by both segments under its own length, and probes the index of its own length and of
lines one shorter. Keys are hashes of what is left when one segment is left out, from both ends of the
line, which makes them aware of length and place.

A key that more than ``CROWD`` lines share isn't expanded into pairs. Its lines are cut again, into
``FINER`` segments of which all but one agree, and where that leaves crowds, that one is cut again, down
to a single character: then lines under one key are all alike, and one link each to the least of them is
enough. So a line of any length is read some times for each cut, never once for each of its characters.

Candidates are verified by a banded bit-parallel edit distance: for each number of edits an integer
holds the diagonals of the band that are reached, and one step takes in a character.

Texts stay where they are: hashes of lines travel, and a line's text only if another may be like it.
Whole documents travel only if they lose lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, few, sifted, without
from .graph import components

THRESHOLD = 1
#: Shorter lines (headings, list marks, exclamations) recur in clean text, and are left alone; a parameter.
SHORTEST = 20
CROWD, FINER = 12, 16
OWN = ["n_lines", "n_dropped"]


def cut_at(j: Column, length: Column, segments: Column) -> Column:
    """Where segment ``j`` begins; the product can be beyond 32 bits."""
    return F.call_function("div", j.cast("long") * length, segments).cast("int")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def common(a: Column, b: Column, at_end: bool) -> Column:
    """Characters that two texts have in common at their start (or end): powers of two, the largest first."""
    most = F.least(F.length(a), F.length(b))
    take = (lambda x, k: F.right(x, k)) if at_end else (lambda x, k: F.left(x, k))
    # From the largest power of two that is no longer than the shorter text; a step that reaches beyond it is no step.
    steps = F.transform(F.sequence(F.length(F.bin(most)) - 1, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when((k <= most - n) & (take(a, n + k) == take(b, n + k)), n + k).otherwise(n))


def within(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Whether the edit distance of two texts is at most ``threshold``.

    What they have in common at both ends is cut off first; that leaves the distance as it is.
    """

    def cut(s: Column) -> Column:
        p = common(s["a"], s["b"], False)
        return let(p, lambda n: F.struct(F.substr(s["a"], n + 1).alias("a"), F.substr(s["b"], n + 1).alias("b")))

    def cut_end(s: Column) -> Column:
        q = common(s["a"], s["b"], True)
        return let(q, lambda n: F.struct(F.left(s["a"], F.length(s["a"]) - n).alias("a"), F.left(s["b"], F.length(s["b"]) - n).alias("b")))

    def distance(s: Column) -> Column:
        found = banded(s["a"], s["b"], threshold)
        # One edit leaves a character at most between the common ends; with more edits they may lie far apart.
        return F.when(F.greatest(F.length(s["a"]), F.length(s["b"])) > 1, F.lit(False)).otherwise(found) if threshold == 1 else found

    near = F.abs(F.length(a) - F.length(b)) <= threshold
    ends = let(F.struct(a.alias("a"), b.alias("b")), lambda s: let(cut(s), cut_end))
    return near & let(ends, distance)


def banded(a: Column, b: Column, threshold: int) -> Column:
    """The same by diagonals of a band in the bits of an integer for each number of edits."""
    width = 2 * threshold + 1

    def reached(v: Column) -> Column:
        x, y, n, m = v["x"], v["y"], v["n"], v["m"]

        def match(j: Column) -> Column:
            """Bit d: whether b's character j (from 1) is a's on diagonal d - threshold."""
            bits = F.lit(0)
            for d in range(width):
                bits = bits.bitwiseOR(F.when(F.get(x, j + (d - threshold - 1)) == F.get(y, j - 1), F.lit(1 << d)).otherwise(F.lit(0)))
            return bits

        def step(r: Column, hit: Column) -> Column:
            new, out = None, []
            for e in range(threshold + 1):
                state = r[e].bitwiseAND(hit)
                if e:
                    less = r[e - 1]
                    state = state.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new, 1).bitwiseAND(F.lit((1 << width) - 1)))
                out.append(state)
                new = state
            return F.array(*out)

        start = F.array(*[F.lit(sum(1 << (threshold + i) for i in range(e + 1))) for e in range(threshold + 1)])
        columns = F.when(m > 0, F.transform(F.sequence(F.lit(1), m), match)).otherwise(F.array().cast("array<int>"))
        end = F.aggregate(columns, start, step)[threshold]
        return F.call_function("shiftright", end, F.greatest(F.least(n - m + threshold, F.lit(width)), F.lit(0))).bitwiseAND(F.lit(1)) == 1

    chars = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("n"), F.length(b).alias("m"))
    return let(chars, reached)


def found(docs: DataFrame, text: str, shortest: int, *more: Column) -> DataFrame:
    """(..., line, a, b): the lines that are compared, each place of them, with their 128-bit hash in two parts."""
    lines = docs.select(*more, F.explode(F.split(F.col(text), "\n", -1)).alias("line")).filter(F.length("line") >= shortest)
    return lines.select(*[c for c in lines.columns], *name("line"))


def name(line: str) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")


def halves(line: Column) -> list[Column]:
    """Keys of the two segments of a line as an entry of the index (k0, k1) and as a probe of one shorter lines (p0, p1)."""
    out = []
    for led, less in (("k", 0), ("p", 1)):
        n = F.length(line) - less
        cut = F.call_function("div", n, F.lit(2)).cast("int")
        out += [F.xxhash64(F.lit(0), n, F.left(line, cut)).alias(f"{led}0"), F.xxhash64(F.lit(1), n, F.right(line, n - cut)).alias(f"{led}1")]
    return out


def shared(keys: DataFrame) -> DataFrame:
    """Keys (k) that can join two lines, and whether they are a crowd; ``own`` marks index entries, others probe."""
    seen = keys.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("o"))
    return seen.filter("o > 0 and n > 1").select("k", (F.col("n") > CROWD).alias("crowd"))


def pairs(some: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) under keys that are no crowd."""
    some = some.filter("not crowd")
    index, probe = some.filter("own").select("k", F.col("id").alias("u")), some.select("k", F.col("id").alias("v"), F.col("own").alias("vo"))
    return index.join(probe, "k").filter((F.col("u") < F.col("v")) | (~F.col("vo") & (F.col("u") != F.col("v")))).select("u", "v")


def narrowed(at: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, l, b, e, own, k): spans (b, e) that are left out, cut into up to FINER, with keys of all but each."""
    width = F.col("e") - F.col("b")
    count = F.least(F.lit(FINER), width)
    cuts = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct((F.col("b") + cut_at(j, width, count)).alias("b"), (F.col("b") + cut_at(j + 1, width, count)).alias("e")))
    cut = at.join(texts, "id").select("id", "line", "l", "own", F.explode(cuts).alias("c")).select("id", "line", "l", "own", "c.b", "c.e")
    return cut.select("id", "l", "b", "e", "own", F.xxhash64("l", "b", "e", F.left("line", F.col("b")), F.right("line", F.col("l") - F.col("e"))).alias("k"))


def linked(leaf: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) under keys that leave a single character out."""
    # Lines of one length that agree but for one character are all alike under that key.
    same = leaf.filter("own").select("id", "k")
    least = same.groupBy("k").agg(F.min("id").alias("u"), F.count("*").alias("n")).filter("n > 1").select("k", "u")
    # A line with one of the two characters left out is a line one shorter.
    l, b = F.col("l"), F.col("b")
    shorter = F.array_distinct(F.array(*[F.xxhash64(F.concat(F.left("line", b + k), F.right("line", l - b - k)), F.lit(-1)) for k in (0, 1)]))
    less = leaf.filter("not own").join(texts, "id").select("id", F.explode(shorter).alias("k"))
    whole = leaf.filter("own").select("id").distinct().join(texts, "id").select(F.xxhash64("line", F.lit(-1)).alias("k"), F.col("id").alias("u"))
    return same.join(least, "k").select("u", F.col("id").alias("v")).union(less.join(whole, "k").select("u", F.col("id").alias("v")))


def links(known: DataFrame, docs: DataFrame, text: str, shortest: int, d: Column, scratch: Scratch) -> DataFrame:
    """Links (u, v) of all lines that are alike; groups of mutually alike lines give at least a spanning star.

    ``known``: a, b, d (a document that holds the line), k0, k1, p0, p1 (keys). A line's id is (a, b).
    """
    key = lambda c, own: F.struct(F.col(c).alias("k"), F.lit(own).alias("own"))
    entry = F.explode(F.array(key("k0", True), key("k1", True), key("p0", False), key("p1", False))).alias("x")
    wanted = scratch.put(shared(known.select(entry).select("x.*")))
    keys = known.select("a", "b", entry).select("a", "b", "x.k", "x.own")
    some = scratch.put(sifted(keys, "k", bitmap(wanted, "k")).join(few(wanted), "k").select("k", F.struct("a", "b").alias("id"), "own", "crowd"))
    joined = [scratch.put(pairs(some).distinct())]
    crowd = some.filter("crowd").select("id")
    needed = scratch.put(joined[0].select(F.explode(F.array("u", "v")).alias("id")).union(crowd).distinct().select("id", "id.a", "id.b"))
    # The text of each is read from one document that holds it.
    at = scratch.put(sifted(known.select("a", "b", "d"), "a", bits := bitmap(needed, "a")).join(few(needed), ["a", "b"]).select("a", "b", "d", "id"))
    texts = sifted(found(docs, text, shortest, d), "a", bits).join(at, ["a", "b"]).filter(F.col("_d").eqNullSafe(F.col("d")))
    texts = scratch.put(texts.select("id", "line").dropDuplicates(["id"]))
    # What is left out of a line (own) of length l, or of one that is one longer (probe): first all of it.
    n, spans = F.length("line"), []
    for l, own in ((n, True), (n - 1, False)):
        spans.append(F.struct(l.alias("l"), F.lit(0).alias("b"), l.alias("e"), F.lit(own).alias("own")))
    at = crowd.distinct().join(texts, "id").select("id", F.explode(F.array(*spans)).alias("s")).select("id", "s.*")
    leaves = []
    while not at.isEmpty():
        keys = scratch.put(narrowed(at, texts))
        some = scratch.put(keys.join(few(scratch.put(shared(keys))), "k"))
        joined.append(scratch.put(pairs(some)))
        leaves.append(some.filter("crowd and e - b = 1"))
        at = some.filter("crowd and e - b > 1").select("id", "l", "b", "e", "own")
    joined += [linked(leaf, texts) for leaf in leaves]
    out = joined[0]
    for more in joined[1:]:
        out = out.union(more)
    out = out.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a, b = texts.select(F.col("id").alias("u"), F.col("line").alias("a")), texts.select(F.col("id").alias("v"), F.col("line").alias("b"))
    return out.join(a, "u").join(b, "v").filter(within(F.col("a"), F.col("b"))).select("u", "v")


def losses(docs: DataFrame, doc_id: str, text: str, shortest: int) -> DataFrame:
    """(d, t, gone): documents by id and hash of the text, with the places of the lines that they lose. A stored table."""
    d = F.col(doc_id).alias("_d")
    row = F.xxhash64(text).alias("_t")
    with Scratch(docs.sparkSession) as scratch:
        known = found(docs, text, shortest, d).select("a", "b", "_d", *halves(F.col("line")))
        # The keys follow from the line, so that they may stand among the grouping columns.
        known = scratch.put(known.groupBy("a", "b", "k0", "k1", "p0", "p1").agg(F.min("_d").alias("d"), F.count("*").alias("n")))
        groups = components(links(known, docs, text, shortest, d, scratch), scratch).select("node.a", "node.b", F.col("component").alias("g"))
        in_group = F.col("g").isNotNull()
        grouped = sifted(known.select("a", "b", "d"), "a", bitmap(groups, "a")).join(few(groups), ["a", "b"])
        first = scratch.put(grouped.groupBy("g").agg(F.min("d").alias("first")))
        grouped = scratch.put(groups.join(few(first), "g").select("a", "b", "g", "first"))
        # A line at one place that is like no other needs no look.
        often = known.filter("n > 1").join(grouped.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.struct("a", "b").alias("g"), F.col("d").alias("first"))
        at_stake = scratch.put(often.unionByName(grouped))
        places = docs.select(d, row, F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line")).filter(F.length("line") >= shortest)
        places = sifted(places.select("_d", "_t", "at", *name("line")), "a", bitmap(at_stake, "a"))
        met = places.join(few(at_stake), ["a", "b"]).groupBy("_d", "_t").agg(F.array_sort(F.collect_set(F.struct("g", "at", "first"))).alias("x"))
        # Of a class that begins in this document its first place stays.
        stays = lambda x, i: x["first"].eqNullSafe(F.col("_d")) & ((i == 0) | (F.get("x", i - 1)["g"] != x["g"]))
        gone = F.transform(F.filter("x", lambda x, i: ~F.coalesce(stays(x, i), F.lit(False))), lambda x: x["at"])
        return scratch.put(met.select("_d", "_t", gone.alias("gone")).filter(F.size("gone") > 0), stay=True)


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Each document with its text less the lines that are like an earlier one, n_lines and n_dropped.

    Lines of ``shortest`` or more characters that are equal, or linked through lines at most one edit
    apart, are a class. A class stays once: in the document of the smallest id, at its first place there.
    Other lines, and all line breaks between lines that stay, are kept. A null text stays null and has no
    lines; an empty one has one. A null id comes after all others. Repeated rows, and rows of one id, count
    as one document: a line that two of them share stays in both. An empty table gives an empty one. Very
    long texts and lines are read whole. Columns that clash with n_lines or n_dropped are replaced.
    """
    keep = without(docs, OWN)
    gone = losses(docs, doc_id, text, shortest)
    bits = bitmap(gone, "_t")
    # A row travels as one column, so that no name of its own meets those that are used here.
    x, every = F.col("row")[text], docs.select(F.struct(*keep).alias("row"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"))
    parts = F.split(x, "\n", -1)
    n_lines = F.when(x.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines")
    # Lines and the places that stay are worked out once for each text, not once for each line.
    rest = let(F.struct(parts.alias("x"), F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone").alias("at")), lambda s: F.array_join(F.transform(s["at"], lambda i: F.get(s["x"], i)), "\n"))
    left = F.when(F.col("gone").isNull(), x).otherwise(rest)
    whole = sifted(every, "h", bits, inside=False).select(*[F.col("row")[c].alias(c) for c in keep], n_lines, F.lit(0).cast("long").alias("n_dropped"))
    met = sifted(every, "h", bits).join(gone, F.col("row")[doc_id].eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_t")), "left")
    return whole.unionByName(met.select(*[(left if c == text else F.col("row")[c]).alias(c) for c in keep], n_lines, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")))


def cleaned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The documents with their repeated lines gone; those of which nothing but blanks is left go too."""
    keep = without(docs, OWN)
    out = deduplicated(docs, doc_id=doc_id, text=text, shortest=shortest)
    return out.filter((F.col("n_dropped") == 0) | (F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0)).select(*keep)
