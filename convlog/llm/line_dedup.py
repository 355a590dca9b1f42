"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines within `edits` edits of each other, cut at the same places, share one of edits + 1 segments: going from left to
right, the first segment i up to whose end no more than i - 1 edits have occurred is intact, with i - 1 edits left of it
and edits + 1 - i at most right of it (which bounds how far it can have moved). Places depend on a class of lengths, an
eighth of a doubling wide, so that lines of like length are cut alike; a line just above a class is cut by the one below
too. Hashes of segments are counted first, and only those that different lines share go on. Those are refined once more:
the rests left and right of the segment, with their bounds on edits, share a piece again. A segment that thousands of
variants of a line have so falls into many small keys, exactly.

A line goes if any near one comes earlier, so each line is first compared with the earliest of each of its buckets, over
some rounds; only lines that stay open are compared with all earlier ones of their buckets. The join itself compares the
parities of 64 sorts of character pairs, of which an edit changes four at most; pairs then pass a sieve of pieces,
are cut down to what lies between the first and the last place where they differ, and what is left is verified: with one
or two edits these are the ends themselves and all between must be equal, with more a banded bit-parallel edit distance
runs, one step of 64-bit operations a character.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from convlog.llm.common import dropped, small, stored, table

BLANK = " \t\r\x0b\x0c"
SIEVE = 24  # pieces in which two lines are compared before they are cut down
ROUNDS = 3  # in which open lines are compared with one line of each bucket


def _class(n: Column) -> Column:
    """The least length of the class of lengths that n is in."""
    width = F.call_function("shiftleft", F.lit(1), F.greatest(F.floor(F.log2(n)).cast("int") - 3, F.lit(0)))
    return n - F.pmod(n, width)


def _cuts(edits: int) -> list[tuple[int, int]]:
    """(segment, shift) of each key of a class; shift 0 is the segment where the class has it."""
    return [(i, s) for i in range(1, edits + 2) for s in range(-min(i - 1, edits + 1 - i), min(i - 1, edits + 1 - i) + 1)]


def _part(begin: Column, length: Column, k: int, pieces: int, shift: int, end: Column, text: Column) -> Column:
    """Piece k (from 1) of a stretch of text that ends at end: cut as if it had `length` characters, counted from the side
    that fewer edits can move."""
    low, high = (F.floor(length * (k - x) / pieces).cast("int") for x in (1, 0))
    at = begin + low if k - 1 <= pieces - k else end - length + low
    return F.substr(text, at + shift + 1, high - low)


def _keys(edits: int) -> Column:
    """Hashes of the segments of a line (columns n, line) for its own class, then for those just below."""
    line, n = F.col("line"), F.col("n")

    def of_class(c: Column) -> Column:
        return F.array(*(F.xxhash64(F.lit(i), c, _part(F.lit(0), c, i, edits + 1, s, n, line)) for i, s in _cuts(edits)))

    own = F.col("class")
    keys, lower = of_class(own), own
    for _ in range(edits):  # only short lines have several classes below
        before, lower = lower, _class(lower - 1)
        below = F.when((before - 1 >= n - edits) & (lower > edits), of_class(lower))
        keys = F.when((before - 1 >= n - edits) & (before - 1 > edits), F.concat(keys, F.coalesce(below, F.array().cast("array<bigint>")))).otherwise(keys)
    return F.when(own > edits, keys)


def _kinds(edits: int) -> Column:
    """By segment and shift, what to take for the finer keys: pieces a left and b right, shifted by ta and tb. A constant
    array whose size depends on the edits alone."""
    out = []
    for i, s in _cuts(edits):
        left = [(a, t) for a in range(1, i + 1) for t in range(-min(a - 1, i - a), min(a - 1, i - a) + 1)] if i > 1 else [(0, 0)]
        right = [(b, t) for b in range(1, edits + 3 - i) for t in range(-min(b - 1, edits + 2 - i - b), min(b - 1, edits + 2 - i - b) + 1)] if i <= edits else [(0, 0)]
        rows = [(i, s, *x, *y) for x in left for y in right]
        out.append(F.array(*(F.struct(*(F.lit(v).alias(name) for name, v in zip(("i", "s", "a", "ta", "b", "tb"), r, strict=True)), F.lit(not any((s, r[3], r[5]))).alias("own")) for r in rows)))
    return F.array(*out)


def _fine_key(edits: int) -> Column:
    """Hash of a line's key with the pieces of the rests that its kind names."""
    c = F.col
    low, high = (F.floor(c("class") * (c("i") - x) / (edits + 1)).cast("int") for x in (1, 0))
    leads = c("i") - 1 <= edits + 1 - c("i")
    begin = F.when(leads, low).otherwise(c("n") - c("class") + low) + c("s")
    end = begin + high - low
    fewest = F.lit(edits + 1) - c("i")  # edits right of the segment
    left, right = F.greatest(low - (c("i") - 1), F.lit(0)), F.greatest(c("class") - high - fewest, F.lit(0))

    def piece(start: Column, stop: Column, length: Column, k: Column, pieces: Column, shift: Column) -> Column:
        a, z = (F.floor(length * (k - x) / pieces).cast("int") for x in (1, 0))
        at = F.when(k - 1 <= pieces - k, start + a).otherwise(stop - length + a) + shift
        return F.when(k > 0, F.substr(c("line"), at + 1, z - a)).otherwise("")

    return F.xxhash64("key", "a", piece(F.lit(0), begin, left, c("a"), c("i"), c("ta")), "b", piece(end, c("n"), right, c("b"), F.lit(edits + 2) - c("i"), c("tb")))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of a and b (b no longer than a, at most `most` shorter) if it is `most` or less, else something more.

    Bit k of the vectors stands for the row k - most of the band around the diagonal; each character of b is one step.
    """
    # held in a lambda's variable, so that the characters are split once and not at each step
    held = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("la"), F.length(b).alias("lb")))
    return F.transform(held, lambda p: _banded(p["x"], p["y"], p["la"], p["lb"], most))[0]


def _banded(x: Column, y: Column, la: Column, lb: Column, most: int) -> Column:
    bits = 2 * most + 1
    mask, top = (1 << bits) - 1, 1 << (bits - 1)

    def step(state: Column, i: Column) -> Column:
        c = F.get(y, i)
        same = F.lit(0).cast("long")
        for k in range(bits):
            at = i - most + k
            same = same.bitwiseOR(F.when((at >= 0) & (at < la) & (F.get(x, F.greatest(at, F.lit(0))) == c), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), state["d"].alias("d"), same.alias("m"))

    def advance(state: Column, i: Column) -> Column:
        vp, vn, m = state["vp"], state["vn"], state["m"]
        d0 = ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(mask))
        return F.struct(vp.alias("vp"), vn.alias("vn"), state["d"].alias("d"), d0.alias("d0"))

    def close(state: Column, i: Column) -> Column:
        vp, vn, d0 = state["vp"], state["vn"], state["d0"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(mask))
        hn = d0.bitwiseAND(vp)
        right = F.shiftright(d0, 1)
        # along the lower edge of the band until it meets the last row of a, then along that row
        row = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(bits - 2) - (i - (la - most)), F.lit(0)))
        d = F.when(i < la - most, state["d"] + F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)).otherwise(
            state["d"] + F.when(hp.bitwiseAND(row) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(row) != 0, 1).otherwise(0)
        )
        return F.struct(hn.bitwiseOR(F.bitwise_not(right.bitwiseOR(hp)).bitwiseAND(F.lit(mask))).alias("vp"), right.bitwiseAND(hp).alias("vn"), d.cast("int").alias("d"))

    start = F.struct(F.lit(((1 << (most + 1)) - 1) << most).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(most).alias("d"))
    return F.aggregate(
        F.sequence(F.lit(0), F.greatest(lb - 1, F.lit(0))),
        start,
        lambda s, i: close(advance(step(s, i), i), i),
        lambda s: s["d"],
    )


def _possible(edits: int) -> Column:
    """Whether all but `edits` pieces of a line occur in a near one, no shorter, about where they must within so many edits.
    Plain expressions, compiled with the rest of the stage."""
    n, missing = F.length("line"), F.lit(0)
    for i in range(SIEVE):
        begin, end = (n * i / SIEVE).cast("int"), (n * (i + 1) / SIEVE).cast("int")
        low = F.greatest(begin - edits, F.lit(0))
        there = F.substr("near", low + 1, end + edits - low).contains(F.substr("line", begin + 1, end - begin))
        missing = missing + F.when(there, 0).otherwise(1)
    return missing <= edits


def _alike(a: Column, b: Column, la: Column, lb: Column, most: Column, from_end: bool) -> Column:
    """Characters, `most` at most, with which a and b both begin (or end). Halving steps: each compares one stretch."""
    powers = F.transform(F.sequence(F.length(F.bin(most)) - 1, F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def further(got: Column, p: Column) -> Column:
        x, y = (F.substr(t, (n - got - p if from_end else got) + 1, p) for t, n in ((a, la), (b, lb)))
        return F.when((got + p <= most) & (x == y), got + p).otherwise(got)

    return F.aggregate(powers, F.lit(0), further)


def _close(near: Column, line: Column, edits: int) -> Column:
    """Whether near, no shorter than line, is within `edits` edits of it. What the steps share is held in variables of
    lambdas, so that each is computed once for a pair, wherever the optimizer puts the condition."""

    def held(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.exists(F.array(value), then)

    def cut(p: Column, lead: Column) -> Column:
        trail = _alike(near, line, p["la"], p["lb"], p["lb"] - lead, True)

        def rest(t: Column) -> Column:
            left = F.struct(F.substr(near, lead + 1, p["la"] - lead - t).alias("a"), F.substr(line, lead + 1, p["lb"] - lead - t).alias("b"), (p["la"] - lead - t).alias("la"), (p["lb"] - lead - t).alias("lb"))
            return held(left, lambda q: _within(q["a"], q["b"], q["la"], q["lb"], edits))

        return held(trail, rest)

    sizes = F.struct(F.length(near).alias("la"), F.length(line).alias("lb"))
    return held(sizes, lambda p: held(_alike(near, line, p["la"], p["lb"], p["lb"], False), lambda lead: cut(p, lead)))


def _within(a: Column, b: Column, la: Column, lb: Column, edits: int) -> Column:
    """Whether a is within `edits` edits of b, which is no longer; both differ in their first and last characters."""
    if edits > 2:
        return (lb == 0) | (edit_distance(a, b, edits) <= edits)
    if edits == 1:
        return (la <= 1) & (lb <= 1)
    # the first and the last column of an alignment are edits, so all between is equal: x of a and y of b go at either side
    ends = [(x1, y1, x2, y2) for x1, y1 in ((1, 1), (1, 0), (0, 1)) for x2, y2 in ((1, 1), (1, 0), (0, 1))]
    out = (la <= 2) & (lb <= 2)
    for x1, y1, x2, y2 in ends:
        out = out | ((la - (x1 + x2) == lb - (y1 + y2)) & (lb >= y1 + y2) & (F.substr(a, F.lit(1 + x1), la - (x1 + x2)) == F.substr(b, F.lit(1 + y1), lb - (y1 + y2))))
    return out


def line_occurrences(docs: DataFrame, least: int, edits: int) -> DataFrame:
    """id, print (hash of the whole text), no, pos (order of all lines), n, h1, h2, keys of the lines that count."""
    lines = _lines(docs, least).withColumn("class", _class(F.col("n")))
    pos = F.col("id").cast("decimal(38,0)") * F.lit(Decimal(2**32)) + F.col("no")
    return lines.select("id", "print", "no", pos.cast("decimal(38,0)").alias("pos"), "n", "h1", "h2", _keys(edits).alias("keys"))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    lines = docs.select("id", F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.btrim("line", F.lit(BLANK)))
    lines = lines.withColumn("n", F.length("line")).filter(F.col("n") >= least)
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), F.col("line")))


LINE = ["h1", "h2"]


def _parities(line: Column) -> Column:
    """Bit k tells whether the line has an odd number of character pairs of sort k. An edit takes two pairs away and adds two
    at most, the last character with what is behind it counting as one."""
    chars = F.split(line, "")
    sorts = F.transform(F.array(chars), lambda c: F.zip_with(c, F.slice(c, 2, F.size(c)), lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(64)).cast("int")))[0]
    return F.aggregate(sorts, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))


def _like(a: Column, b: Column, edits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= 4 * edits


def _buckets(occurrences: DataFrame, docs: DataFrame, first: DataFrame, edits: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(fine, h1, h2, n, parities, own, first): lines by the finer keys that two lines share, one of them as its own; and the lines'
    texts (h1, h2, line)."""
    keyed = occurrences.select(*LINE, "n", F.posexplode("keys").alias("probe", "key"))
    shared = stored(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a < b").select("key"), "line-keys")
    hits = stored(keyed.join(small(shared, 1_000_000), "key").distinct(), "line-hits")
    wanted = stored(hits.select(*LINE).distinct(), "line-wanted")
    texts = stored(_lines(docs, least).select(*LINE, "line").join(small(wanted, 2_000_000), LINE).groupBy(*LINE, "line").agg(F.lit(1)).select(*LINE, "line", _parities(F.col("line")).alias("parities")), "line-texts")
    rows = hits.join(texts, LINE).withColumn("class", _class(F.col("n")))
    per_class = len(_cuts(edits))
    below = F.col("class")
    steps = [below]
    for _ in range(edits):
        below = _class(below - 1)
        steps.append(below)
    of_probe = F.floor(F.col("probe") / per_class).cast("int")
    rows = rows.withColumn("lower", of_probe).withColumn("class", F.get(F.array(*steps), of_probe))
    kinds = rows.withColumn("kind", F.explode(F.element_at(_kinds(edits), F.pmod(F.col("probe"), F.lit(per_class)) + 1))).select(*LINE, "n", "line", "parities", "key", "class", "lower", "kind.*")
    fine = kinds.select(*LINE, "n", "parities", _fine_key(edits).alias("fine"), (F.col("own") & (F.col("lower") == 0)).alias("own"))
    fine = stored(fine.groupBy("fine", *LINE, "n", "parities").agg(F.max("own").alias("own")), "line-fine")
    kept = fine.groupBy("fine").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("own").alias("any_own")).filter("low < high and any_own").select("fine")
    out = stored(fine.join(kept, "fine").join(first.select(*LINE, "first"), LINE), "line-buckets")
    dropped(shared, hits, wanted, fine)
    return out, texts


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (h1, h2, near1, near2) of different lines within `edits` edits."""
    other = texts.select(F.col("h1").alias("near1"), F.col("h2").alias("near2"), F.col("line").alias("other"))
    both = pairs.join(texts.select(*LINE, "line"), LINE).join(other, ["near1", "near2"])
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longer = F.length("line") > F.length("other")
    spread = both.repartition(parts, "h1", "near1")  # few bytes, much work
    spread = spread.select(*LINE, "near1", "near2", F.when(longer, F.col("other")).otherwise(F.col("line")).alias("line"), F.when(longer, F.col("line")).otherwise(F.col("other")).alias("near"))
    close = spread.filter(F.length("near") - F.length("line") <= edits).filter(_possible(edits))
    return close.filter(_close(F.col("near"), F.col("line"), edits)).select(*LINE, "near1", "near2")


def late_lines(occurrences: DataFrame, docs: DataFrame, first: DataFrame, edits: int, least: int) -> DataFrame:
    """h1, h2 of the lines that have a different line within `edits` edits and earlier in the corpus. Lines of fewer than
    edits + 1 characters have empty segments and aren't compared."""
    buckets, texts = _buckets(occurrences, docs, first, edits, least)
    here = F.struct("first", *LINE, "n", "parities")
    late, tested, after = None, None, {}
    open_ = buckets
    for _ in range(ROUNDS):
        # the earliest of a bucket that has not had its turn, among its own lines and among all
        turn = buckets.join(after, "fine") if isinstance(after, DataFrame) else buckets.withColumn("own_turn", F.lit(None).cast("decimal(38,0)")).withColumn("turn", F.lit(None).cast("decimal(38,0)"))
        least_ = stored(
            turn.groupBy("fine").agg(
                F.min(F.when(F.col("own") & (F.col("own_turn").isNull() | (F.col("first") > F.col("own_turn"))), here)).alias("own_line"),
                F.min(F.when(F.col("turn").isNull() | (F.col("first") > F.col("turn")), here)).alias("any_line"),
            ),
            "line-turns",
        )
        met = open_.join(least_, "fine")
        far = F.array(F.col("own_line"), F.when(F.col("own"), F.col("any_line")))
        met = met.select(*LINE, "n", "parities", "first", F.posexplode(far).alias("which", "e")).filter("e.first < first").filter(_like(F.col("parities"), F.col("e.parities"), edits))
        fits = F.when(F.col("which") == 0, F.col("n") - F.col("e.n")).otherwise(F.col("e.n") - F.col("n")).between(0, edits)
        pairs = met.filter(fits).select(*LINE, F.col("e.h1").alias("near1"), F.col("e.h2").alias("near2")).distinct()
        pairs = stored(pairs.join(tested, [*LINE, "near1", "near2"], "left_anti") if tested is not None else pairs, "line-pairs")
        found = stored(_verified(pairs, texts, edits).select(*LINE).distinct(), "line-late")
        late = found if late is None else late.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        open_ = stored(open_.join(small(found, 1_000_000), LINE, "left_anti"), "line-open")
        after = least_.select("fine", F.col("own_line.first").alias("own_turn"), F.col("any_line.first").alias("turn"))
    other = buckets.select("fine", F.col("h1").alias("near1"), F.col("h2").alias("near2"), F.col("n").alias("near_n"), F.col("own").alias("near_own"), F.col("first").alias("before"), F.col("parities").alias("near_parities"))
    apart = F.when(F.col("own"), F.col("near_n") - F.col("n")).between(0, edits) | F.when(F.col("near_own"), F.col("n") - F.col("near_n")).between(0, edits)
    pairs = open_.join(other, "fine").filter((F.col("before") < F.col("first")) & apart & _like(F.col("parities"), F.col("near_parities"), edits)).select(*LINE, "near1", "near2").distinct()
    pairs = stored(pairs.join(tested, [*LINE, "near1", "near2"], "left_anti"), "line-pairs")
    return late.unionByName(_verified(pairs, texts, edits).select(*LINE)).distinct()


def line_dedup(docs: DataFrame, edits: int = 2, least: int = 30, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, text, kept_text, n_lines, n_dropped and the columns to carry: one row per input row.

    A line (white space at its ends aside) of at least `least` characters is dropped if a line within `edits` edits of
    it, or equal to it, comes earlier in the corpus: in a document of smaller id, or above it in the same one. Lines of up
    to `edits` characters, all of which are within so many edits of each other, are dropped for equal ones only. Lines are
    judged on the input, not on what is left of it; blank lines and those shorter than `least` stay. Null text counts as
    empty; rows without id are left whole and drop nothing. Rows of equal id and text are one document. Very long lines
    and texts are treated like all others. Ids are integers, others raise a ValueError. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    if edits < 1 or least < 1:
        raise ValueError("at least one edit and one character")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError("ids must be integers")
    own = {c: f"carried_{k}" for k, c in enumerate(carry)}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(x) for c, x in own.items()))
    known = rows.select("id", "text").filter("id is not null")
    lines = stored(line_occurrences(known, least, edits), "line-occurrences")
    first = stored(lines.groupBy(*LINE).agg(F.min("pos").alias("first"), F.count("*").alias("copies")), "line-first")
    late = stored(late_lines(lines, known, first, edits, least), "line-late").withColumn("late", F.lit(True))
    status = stored(first.join(small(late, 1_000_000), LINE, "left").filter("late or copies > 1").select(*LINE, "first", F.coalesce("late", F.lit(False)).alias("late")), "line-status")
    gone = lines.select("id", "print", "no", "pos", *LINE).join(small(status, 1_000_000), LINE).filter("late or pos <> first")
    dropped_ = stored(gone.groupBy("id", "print").agg(F.collect_set("no").alias("gone")), "line-dropped")
    split = F.split("text", "\n")
    # the split text is held in a lambda's variable, so that it is split once
    held = F.array(F.struct(split.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone")).alias("stay")))
    stay = F.transform(held, lambda p: F.array_join(F.transform(p["stay"], lambda k: F.get(p["lines"], k)), "\n"))[0]
    marked = rows.withColumn("print", F.xxhash64("text")).join(small(dropped_, 500_000), ["id", "print"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(stay)
    return marked.select(F.col("id").alias(id_col), F.col("text").alias(text_col), kept.alias("kept_text"), F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), *(F.col(x).alias(c) for c, x in own.items()))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), least=1).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
