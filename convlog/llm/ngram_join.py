"""N-gram Jaccard join by a grouped prefix join.

A document is the set of its distinct word shingles. If two sets are similar enough, their prefixes under any common
order of shingles share a member. The order used here puts shingles that many documents have last: levels of document
frequency in a table of fixed size, then the hash. Any table gives right results; a good one keeps prefixes rare.

Documents with equal sets are one node; nodes with equal prefixes and sizes are one group, and the index holds groups.
Pairs of groups pass the length and position filters and are expanded to their members. Pairs of members are compared by
parity sketches first: bit k tells whether an odd number of a set's shingles fall on k, so two sketches differ in no more
bits than their sets do in members, and most unlike pairs go without a look at the sets. What is left is verified on whole
sets, each sent once to the place of the one that it is compared with.

Links are found in rounds: first the members of a bucket against one leader; then, where many rows of a bucket are still apart,
pairs inside parts of fixed size of it, dealt anew each time; then, between what is still apart, all pairs that the filters leave. Buckets
of few rows give their pairs at once, by lengths and positions, so only rows of larger ones carry sketches. So a bucket of near copies costs as many pairs as it has members, and no link is lost: two nodes
that are never compared are in one component already. In the last round the largest component of a bucket isn't paired
with itself, and the join itself compares sketches and asks for the first shingle that two groups share, so that it gives
each pair that may be similar once. Buckets full of texts that are nearly similar enough cost a comparison of sketches for
each pair of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.llm.common import components, dropped, small, stored, table
from convlog.llm.tokenize import slices
from convlog.llm.words import FOLD, SPACE, hashed_words, mixed

MIX = np.array([0xD6E8FEB86659FD93, 0xA5A3564E1D3B7C11, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
HELD = 500_000  # shingles that a task holds before it counts them
SLICE = 1 << 19  # bytes of text that a task cuts into shingles at once
SLOTS = 22  # bits of the table of levels
BITS = 24  # bits of the number of bits that mark repeated shingles
BRIEF, CARRIED = 8, 4  # longs of a sketch, and shingles before the one that two sets share, that a join carries
FEW = 16  # rows of a bucket whose pairs are found before sketches are looked at
SAMPLE = 256  # rows of a large bucket that are compared with each other before all are
PER_TASK = 256  # sets that are compared with one copy of a set


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text: its distinct shingles' hashes in ascending order."""
    word, row = hashed_words(texts, SPACE, FOLD)
    n = len(word) - words + 1
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    if n > 0:
        shingle = np.zeros(n, np.uint64)
        for k in range(words):
            shingle += word[k : k + n] * MIX[k]
        shingle = mixed(shingle)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(shingle[lo : hi - words + 1]))
        elif hi > lo:  # fewer words: the whole sequence is one
            out.append(mixed(np.array([(word[lo:hi] * MIX[: hi - lo]).sum() ^ np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _limit(percent: int) -> np.uint64:
    """Shingles below it are counted: somewhat more than prefixes reach when the hash alone orders them."""
    return np.uint64(min(2**64 - 1, int((100 - percent) / 100 * 1.5 * 2**64)))


def shingle_counts(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """token, n: documents that have each shingle, for the shingles that are counted and that two documents have."""
    limit = _limit(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

        for whole in batches:
            for batch in slices(whole, SLICE):
                for s in shingle_sets(batch.column(1), words):
                    held.append(s[: np.searchsorted(s, limit)].copy())  # a view would hold the whole set
                    size += len(held[-1])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")


def _slot(token: np.ndarray, bits: int) -> np.ndarray:
    return ((token * MIX[7]) >> np.uint64(64 - bits)).astype(np.int64)


def order_tables(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Level of each slot (0: no shingle of 16 documents or more) and the bits of shingles that two documents have. Their
    sizes are fixed, so what comes to the driver and goes to the tasks is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            level = np.maximum(np.log2(n).astype(np.int64) - 3, 0)
            bit = _slot(token, BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_slot(token, SLOTS)), pa.array(level.astype(np.int32)), pa.array(bit >> 6), pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))], ["slot", "level", "cell", "mask"]
            )

    rows = stored(counts.mapInArrow(run, "slot long, level int, cell long, mask long"), "shingle-slots")
    levels, marked = np.zeros(1 << SLOTS, np.uint8), np.zeros(1 << (BITS - 6), np.int64)
    found = rows.filter("level > 0").groupBy("slot").agg(F.max("level").alias("level")).toArrow()
    levels[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    found = rows.groupBy("cell").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    marked[found.column("cell").to_numpy()] = found.column("mask").to_numpy()
    dropped(rows)
    return levels, marked.view(np.uint64)


def _overlap(percent: int, a: int, b: int) -> int:
    """Least intersection of two similar sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of members that fall on each of 64 bits or more, two to four times as many as members. The
    sketch of half as many bits is its first half XOR its second."""
    bits = max(len(s) - 1, 31).bit_length() + 1
    odd = np.bincount((mixed(s * MIX[6]) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefixes(docs: DataFrame, words: int, percent: int, levels: np.ndarray, marked: np.ndarray) -> DataFrame:
    """id, n (set size), full and prefix (digests of the set and of its prefix), tokens and places of the prefix's members
    that another document may have, and the set's sketch."""
    limit = _limit(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE):
                n, full, prefix, tokens, places, sketches = [], [], [], [], [], []
                for s in shingle_sets(batch.column(1), words):
                    size = len(s)
                    head = size - -(-percent * size // 100) + 1 if size else 0
                    level = np.where(s < limit, levels[_slot(s, SLOTS)], 0)
                    chosen = s[np.argsort(level, kind="stable")[:head]] if level.any() else s[:head]
                    bit = _slot(chosen, BITS)
                    shared = (chosen >= limit) | ((marked[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                    n.append(size)
                    full.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    prefix.append(hashlib.blake2b(chosen.tobytes(), digest_size=16).digest())
                    tokens.append(chosen[shared].view(np.int64))
                    places.append(np.flatnonzero(shared).astype(np.int32))
                    sketches.append(sketch(s))
                lists = [pa.array(tokens, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(full, pa.binary()), pa.array(prefix, pa.binary()), *lists],
                    ["id", "n", "full", "prefix", "tokens", "places", "sketch"],
                )

    return docs.mapInArrow(run, "id long, n long, full binary, prefix binary, tokens array<long>, places array<int>, sketch array<long>")


def _near(n: Column, n2: Column, sketch1: Column, sketch2: Column, percent: int) -> Column:
    """Whether two sets' sizes and sketches leave it possible that they are similar: sketches differ in no more bits than
    sets do in members. Sizes of similar sets differ by less than half, so their sketches by one folding at most."""

    def folded(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    apart = F.aggregate(F.zip_with(folded(sketch1, sketch2), folded(sketch2, sketch1), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(64)))
    return (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & (apart <= n + n2 - 2 * F.ceil(percent * (n + n2) / (100 + percent)))


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and sketches leave possible; sketches has node, n, sketch."""
    one, two = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    c = F.col
    return pairs.join(one, "a").join(two, "b").filter(_near(c("n_a"), c("n_b"), c("sketch_a"), c("sketch_b"), percent)).select("a", "b").distinct()


def _whole_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE):
                sets = [s.tobytes() for s in shingle_sets(batch.column(1), words)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    return docs.mapInArrow(run, "node long, set binary")


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b), a stored table, whose whole sets are similar enough; docs has (id, text).

    Each set of b goes to a copy of the set of a, and there are as many copies of that as PER_TASK sets of b need. A task
    reads a copy first and then what is compared with it, a row at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            a, b = [], []
            for hub, salt, node, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (hub, salt) != now:
                    now, sets = (hub, salt), []
                x = np.frombuffer(x, np.uint64)
                if node is None:
                    sets.append(x)
                    continue
                for y in sets:
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        a.append(hub)
                        b.append(node)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    counted = stored(pairs.groupBy("a").agg(F.count("*").alias("c")), "shingle-hubs")
    spread = pairs.join(small(counted), "a")
    spread = stored(spread.select("a", "b", F.pmod(F.xxhash64("b"), F.floor(F.col("c") / PER_TASK) + 1).alias("salt")), "shingle-spread")
    needed = stored(spread.select(F.col("a").alias("node")).union(spread.select(F.col("b").alias("node"))).distinct(), "shingle-needed")
    sets = stored(_whole_sets(docs.join(small(needed.select(F.col("node").alias("id")), 2_000_000), "id").select("id", "text"), words), "shingle-sets")
    hubs = sets.join(small(spread.select(F.col("a").alias("node"), "salt").distinct()), "node").select(F.col("node").alias("a"), "salt", F.lit(None).cast("long").alias("b"), "set")
    others = small(spread, 2_000_000).join(sets.select(F.col("node").alias("b"), "set"), "b").select("a", "salt", "b", "set")
    placed = hubs.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    found = stored(placed.mapInArrow(run, "a long, b long").distinct(), "shingle-links")
    dropped(counted, spread, needed, sets)
    return found


def _least(n: str, n2: str, percent: int) -> Column:
    """Least intersection of two similar sets of sizes n and n2."""
    return F.ceil(percent * (F.col(n) + F.col(n2)) / (100 + percent))


def _leaders(open_: DataFrame, mixed_: DataFrame, percent: int) -> DataFrame:
    """group and the leaders (group2) of its buckets, of those that the filters leave."""
    met = open_.join(mixed_.select("token", F.col("lead.group").alias("group2"), F.col("lead.n").alias("n2"), F.col("lead.place").alias("place2")), "token")
    return met.filter(F.col("group") != F.col("group2")).filter(_fits(percent)).select("group", "group2").distinct()


def _fits(percent: int) -> Column:
    """Sizes and places leave a pair possible whose first common shingle this is."""
    rest = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    return (rest >= _least("n", "n2", percent)) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))


def _brief(sketch: Column) -> Column:
    """A sketch folded to BRIEF longs at most."""
    folded = F.transform(F.sequence(F.lit(0), F.lit(BRIEF - 1)), lambda j: F.aggregate(F.sequence(j, F.size(sketch) - 1, F.lit(BRIEF)), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.get(sketch, i))))
    return F.when(F.size(sketch) > BRIEF, folded).otherwise(sketch)


def _open(open_: DataFrame, at: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The rows of buckets: members, their places and components; of each bucket its rows and its largest component; and the
    most rows outside that one that a bucket has."""
    rows = stored(open_.select("token", "place", "group", "n").join(at, "group").select("token", "place", "node", "n", "component"), "shingle-rest")
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("c"))
    largest = F.max_by("component", F.struct("c", "component")).alias("largest")
    largest = stored(sizes.groupBy("token").agg(largest, F.sum("c").alias("rows"), (F.sum("c") - F.max("c")).alias("apart")), "shingle-largest")
    return rows, largest, largest.agg(F.max("apart")).first()[0] or 0


def _few(rows: DataFrame, largest: DataFrame, percent: int) -> DataFrame:
    """The pairs of members (a, b) that share a bucket of FEW rows at most, by lengths and positions, and aren't in one component."""
    met = rows.join(largest.filter(F.col("rows") <= FEW).select("token"), "token")
    one = met.select("token", *(F.col(x).alias(f"{x}2") for x in ("place", "node", "n", "component")))
    met = met.join(one, "token").filter("node < node2 and component <> component2").filter(_fits(percent))
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _many(rows: DataFrame, largest: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """The rows of larger buckets with what their join needs, whether they are outside the bucket's largest component, and a
    salt that deals the bucket into parts of SAMPLE rows."""
    c = F.col
    salt = F.pmod(F.xxhash64("node", "token", F.lit(seed)), F.ceil(c("rows") / SAMPLE))
    rows = rows.join(largest.filter(c("rows") > FEW), "token").withColumn("outside", c("component") != c("largest")).withColumn("salt", salt).drop("largest", "rows", "apart")
    rows = rows.join(nodes.select("node", "tokens", "places", "sketch"), "node")
    ahead = F.array_position("places", c("place")).cast("int") - 1
    before = F.when(ahead > 0, F.slice("tokens", F.greatest(ahead - (CARRIED - 1), F.lit(1)), F.least(ahead, F.lit(CARRIED)))).otherwise(F.array().cast("array<bigint>"))
    return stored(rows.select("token", "place", "node", "n", "component", "outside", "salt", _brief(c("sketch")).alias("sketch"), before.alias("before")), "shingle-many")


def _rest(rows: DataFrame, percent: int, sampled: bool) -> DataFrame:
    """The pairs of members (a, b) that share a large bucket, or if sampled a part of it, may be similar and aren't in one
    component."""
    c = F.col
    one = rows.filter("outside").select(c("token").alias("t"), *(c(x).alias(f"{x}2") for x in ("place", "node", "n", "component", "sketch", "before", "salt")))
    apart = (c("component") != c("component2")) & (~c("outside") | (c("node") < c("node2")))
    near = _near(c("n"), c("n2"), c("sketch"), c("sketch2"), percent)
    place = (c("token") == c("t")) & (c("salt") == c("salt2")) if sampled else c("token") == c("t")
    met = rows.join(one, place & apart & _fits(percent) & near & ~F.arrays_overlap("before", "before2"))
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def ngram_join(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", stars: int = 1) -> DataFrame:
    """id, n_shingles, component_id: one row per input row.

    Words are runs without white space, A-Z lower-cased. Two documents link when 100 * intersection >= percent * union of
    their sets of distinct shingles; component_id is the smallest id reachable by links. Fewer words than a shingle make
    one shingle of all; null, empty or blank texts have none and link with nothing. Very long texts are one set like any
    other; a task holds two of them at a time. Ids are integers; rows of one id are taken as one document in the links,
    rows without id link with nothing and have no component. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and 100 at most")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = stored(shingle_counts(rows, words, percent), "shingle-counts")
    tables = order_tables(counts)
    dropped(counts)
    sets = stored(prefixes(rows, words, percent, *tables), "shingle-prefixes")
    same = ["full", "prefix", "n", "tokens", "places", "sketch"]
    nodes = stored(sets.filter("id is not null and n > 0").groupBy(*same).agg(F.min("id").alias("node")), "shingle-nodes")
    groups = stored(nodes.groupBy("prefix", "n", "tokens", "places").agg(F.min("node").alias("group"), F.count("*").alias("members")), "shingle-groups")
    at = stored(nodes.select("node", "prefix", "n").join(groups.select("prefix", "n", "group"), ["prefix", "n"]).select("group", "node", F.col("node").alias("component")), "shingle-members")
    entries = groups.select("group", "n", "members", F.explode(F.arrays_zip("tokens", "places")).alias("e")).select(F.col("e.tokens").alias("token"), F.col("e.places").alias("place"), "group", "n", "members")
    # a group of three and more has a bucket even if no other group shares a shingle with it: its members meet there
    shared = entries.groupBy("token").agg(F.count("*").alias("c"), F.max(F.when(F.col("place") == 0, F.col("members"))).alias("alone")).filter("c > 1 or alone > 2").select("token")
    index = stored(entries.drop("members").join(shared, "token"), "shingle-index")
    dropped(groups)
    whole, sets = sets, stored(sets.select("id", "n", "full"), "shingle-rows")
    dropped(whole)
    sketches = nodes.select("node", "n", "sketch")

    def linked(likely: DataFrame) -> DataFrame:
        """Members with their components after the links among pairs (a, b)."""
        likely = stored(likely, "shingle-likely")
        if likely.isEmpty():
            dropped(likely)
            return at
        links = verified(likely, rows, words, percent)
        placed = small(at, 500_000)
        named = links.join(placed.select(F.col("node").alias("a"), F.col("component").alias("one")), "a").join(placed.select(F.col("node").alias("b"), F.col("component").alias("two")), "b")
        moved = stored(components(named.select(F.col("one").alias("a"), F.col("two").alias("b"))), "shingle-moved")
        now = at.join(small(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), 500_000), "component", "left")
        now = stored(now.select("group", "node", F.coalesce("to", "component").alias("component")), "shingle-members")
        dropped(likely, links, moved, at)
        return now

    heads = at.filter("group <> node").select(F.col("group").alias("a"), F.col("node").alias("b"))
    if not stars:
        at = linked(plausible(heads, sketches, percent))
    seed, most, sampled = 0, None, True
    while seed < stars or sampled:
        tops = stored(at.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")), "shingle-tops")
        lead = F.min(F.struct(F.xxhash64("group", "token", F.lit(seed)).alias("r"), "group", "n", "place")).alias("lead")
        mixed_ = stored(index.join(small(tops, 500_000), "group").groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h"), lead).filter("l <> h"), "shingle-mixed")
        before, index = index, stored(index.join(small(mixed_.select("token"), 500_000), "token"), "shingle-index")  # the other buckets stay settled
        dropped(tops, before)
        if seed < stars:  # members of a group against its head, at first, and against the heads of its leaders
            placed = small(at, 500_000)
            one, two = placed.select("group", F.col("node").alias("b"), F.col("component").alias("c1")), placed.select(F.col("group").alias("group2"), F.col("node").alias("a"), F.col("component").alias("c2"))
            pairs = _leaders(index, small(mixed_, 500_000), percent).join(one, "group").join(two.filter("group2 = a"), "group2").filter("c1 <> c2").select("a", "b")
            at = linked(plausible(pairs if seed else pairs.unionByName(heads), sketches, percent))
        else:  # buckets of few rows, once; large ones in parts first, as long as that leaves half as many rows apart
            members, largest, now = _open(index, small(at, 500_000))
            sampled, most, first = now > 2 * SAMPLE and (most is None or 2 * now <= most), now, most is None
            many = _many(members, largest, nodes, seed)
            pairs = _rest(many, percent, sampled)
            at = linked(plausible(pairs.unionByName(_few(members, largest, percent)) if first else pairs, sketches, percent))
            if sampled:
                before, index = index, stored(index.join(small(largest.filter(F.col("rows") > FEW).select("token"), 500_000), "token"), "shingle-index")
                dropped(before)
            dropped(members, largest, many)
        dropped(mixed_)
        seed += 1
    named = stored(nodes.select("full", "node").join(at.select("node", F.col("component").alias("component_id")), "node").select("full", "component_id"), "shingle-named")
    dropped(nodes, index, at)
    placed = sets.select("id", "n", "full").join(named, "full", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
