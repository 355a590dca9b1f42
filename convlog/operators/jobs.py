"""Jobs made of the operators: prompts and summaries of chunks, rebuilds that resume, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlog.functions.text import summary_text, token_estimate, visible_text
from convlog.operators.chunks import chunk_rows, plan_chunks, ready_chunks
from convlog.operators.lineage import RECORD, frontier_signature, ordered_text, payload, range_hashes
from convlog.operators.rollup import joined_texts
from convlog.operators.turns import ready_target
from convlog.store import stored


def extractive(chars: int = 40) -> Callable[[Column], Column]:
    """The default summariser: the head of each visible message, in order. Any function from the array of a chunk's visible
    texts to a string column can stand in its place."""
    return lambda texts: F.array_join(F.transform(texts, lambda t: F.substring(t, 1, chars)), "\n")


def chunk_prompts(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, prompt: a JSON array of the chunk's visible messages, for batch inference."""
    rows = chunk_rows(messages, chunks).withColumn("content", visible_text(F.coalesce("text", F.lit("")), F.col("is_user"))).filter("content <> '' and not is_system")
    one = F.to_json(F.struct(F.col("message_id").alias("id"), F.when(F.col("is_user"), "user").otherwise("assistant").alias("role"), F.col("name").alias("speaker"), "content"))
    return rows.groupBy("conv_id", "chunk").agg(F.concat(F.lit("["), ordered_text(one, F.col("message_id"), ","), F.lit("]")).alias("prompt"))


def summarise(messages: DataFrame, chunks: DataFrame, summariser: Callable[[Column], Column] | None = None, most_chars: int = 64_000) -> DataFrame:
    """Level-1 entries (conv_id, level, start_id, end_id, deleted, text, source_hash) of chunks; those whose summary is empty
    or too long are left out, for another run."""
    rows = chunk_rows(messages, chunks).withColumn("content", visible_text(F.coalesce("text", F.lit("")), F.col("is_user"))).filter("content <> '' and not is_system")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("message_id", "content"))), lambda x: x["content"])
    made = rows.groupBy("conv_id", "chunk").agg(texts.alias("texts")).withColumn("text", summary_text((summariser or extractive())(F.col("texts"))))
    hashed = range_hashes(messages, chunks.select("conv_id", "chunk", "start_id", "end_id"))
    done = hashed.join(made.filter(F.length("text") <= most_chars), ["conv_id", "chunk"])
    return done.select("conv_id", F.lit(1).alias("level"), "start_id", "end_id", F.lit(False).alias("deleted"), "text", "source_hash")


def plan_ready(messages: DataFrame, size: int, turns: int, chars: int, visible: Column, boundary: Column | None = None) -> DataFrame:
    """conv_id, chunk, start_id, end_id: the chunks of each log that may be summarised now. Rows up to the one that may leave
    a window of `size` turns are planned in chunks of so many turns and characters, phases cut them, and a chunk waits
    until it is ready, with all behind it."""
    leaving = messages.join(ready_target(messages, size), "conv_id").filter("message_id <= target").select(*messages.columns)
    return ready_chunks(leaving, plan_chunks(leaving, turns, chars, boundary), turns, chars, visible)


def rollup_prompts(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """conv_id, level, start_id, end_id, prompt for each parent: a JSON array of its children in order, with the text of
    deleted ones empty, for batch inference."""
    p = parents.select("conv_id", "level", "start_id", "end_id")
    child = entries.select("conv_id", (F.col("level") + 1).alias("level"), F.col("start_id").alias("from"), F.col("end_id").alias("to"), F.when(F.col("deleted"), "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    inside = child.join(p, ["conv_id", "level"]).filter("from >= start_id and to <= end_id")
    one = F.to_json(F.struct("from", "to", "text"))
    return inside.groupBy("conv_id", "level", "start_id", "end_id").agg(F.concat(F.lit("["), ordered_text(one, F.col("from"), ","), F.lit("]")).alias("prompt"))


def rebuild(entries: DataFrame, messages: DataFrame, chunks: DataFrame, drafts: DataFrame, summariser: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, drafts) after another run of a rebuild of each log's level-1 entries from its chunks (with source_hash).

    Drafts that still hold are kept, the chunks behind them summarised. A log is swapped whole or not at all: when all its
    chunks have an entry, these replace what it had; otherwise its entries stay and the drafts wait for the next run.
    """
    open_ = unfinished(chunks, drafts)
    made = summarise(messages, open_, summariser)
    held = drafts.join(chunks.select("conv_id", "start_id", "end_id", "source_hash"), ["conv_id", "start_id", "end_id", "source_hash"], "left_semi").join(open_.select("conv_id", "start_id"), ["conv_id", "start_id"], "left_anti")
    now = held.select(*made.columns).unionByName(made)
    wanted, there = chunks.groupBy("conv_id").agg(F.count("*").alias("n")), now.groupBy("conv_id").agg(F.count("*").alias("n"))
    whole = wanted.join(there, ["conv_id", "n"]).select("conv_id")
    swapped = entries.join(whole, "conv_id", "left_anti").unionByName(now.join(whole, "conv_id", "left_semi").select(*entries.columns))
    return swapped, now.join(whole, "conv_id", "left_anti")


def regenerate(requests: DataFrame, entries: DataFrame, messages: DataFrame, children: DataFrame, summariser: Callable[[Column], Column] | None = None, merge: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, refused) of making single entries anew: requests (conv_id, level, start_id, end_id, updated_at).

    An entry must be live, undeleted and as it was when it was asked for (updated_at). One of level 1 is made from its rows,
    whose hash must be the one it has (or it has none); a higher one from its saved children (conv_id, parent_level,
    parent_start, level, start_id, end_id, source_hash, text, deleted), which must be neighbours that cover its range and
    have its digest, and of whom one at least isn't deleted. results have the entry's fields with the new text, and the
    signature of the log's entries now, for still_valid when they are written; refused are the requests with a reason. What
    is held, read and made is stored, as several steps ask for it.
    """
    lock = ["conv_id", "level", "start_id", "end_id"]
    held = stored(requests.join(entries.filter("not deleted").select(*lock, "updated_at", "source_hash"), [*lock, "updated_at"]))
    told = [requests.join(held.select(*lock, "updated_at"), [*lock, "updated_at"], "left_anti").withColumn("reason", F.lit("changed"))]
    # level 1
    first = held.filter("level = 1")
    now = range_hashes(messages, first.select("conv_id", "start_id", "end_id")).withColumnRenamed("source_hash", "now").distinct()
    size = messages.groupBy("conv_id").agg(F.max("message_id").alias("last"))
    read = stored(first.join(now, ["conv_id", "start_id", "end_id"], "left").join(size, "conv_id", "left"))
    same = F.coalesce((F.col("end_id") <= F.col("last")) & F.col("now").isNotNull() & ((F.coalesce("source_hash", F.lit("")) == "") | (F.col("source_hash") == F.col("now"))), F.lit(False))
    told.append(read.filter(~same).select(*requests.columns, F.lit("source").alias("reason")))
    chunks = read.filter(same).select("conv_id", F.col("start_id").alias("chunk"), "start_id", "end_id").distinct()
    made = summarise(messages, chunks, summariser).select("conv_id", F.lit(1).alias("level"), "start_id", "end_id", "text", "source_hash")
    # higher levels
    higher = held.filter("level > 1")
    kin = children.select("conv_id", F.col("parent_level").alias("p_level"), F.col("parent_start").alias("p_start"), F.struct("start_id", "end_id", "level", "source_hash", "text", "deleted").alias("c"))
    kin = kin.groupBy("conv_id", F.col("p_level").alias("level"), F.col("p_start").alias("start_id")).agg(F.sort_array(F.collect_list("c")).alias("c"))
    own = higher.join(kin, ["conv_id", "level", "start_id"], "left")
    c = F.col("c")
    steps = F.forall(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i)["start_id"] == F.get(c, i - 1)["end_id"] + 1)
    ranged = (F.size(c) >= 2) & F.forall(c, lambda x: x["level"] == F.col("level") - 1) & (F.get(c, F.lit(0))["start_id"] == F.col("start_id")) & (F.element_at(c, -1)["end_id"] == F.col("end_id")) & F.when(F.size(c) >= 2, steps)
    lines = F.transform(c, lambda x: payload(x["level"], x["start_id"], x["end_id"], x["source_hash"], x["text"], x["deleted"]))
    whole = F.coalesce(ranged & (F.sha2(F.array_join(lines, RECORD), 256) == F.col("source_hash")) & F.exists(c, lambda x: ~x["deleted"]), F.lit(False))
    told.append(own.filter(~whole).select(*requests.columns, F.lit("children").alias("reason")))
    texts = F.transform(c, lambda x: F.when(x["deleted"], "").otherwise(x["text"]))
    parents = own.filter(whole).select(*lock, summary_text((merge or joined_texts)(texts)).alias("text"), "source_hash").filter("text is not null")
    results = stored(made.unionByName(parents))
    told.append(held.join(results.select(*lock), lock, "left_anti").join(told[1].unionByName(told[2]).select(*lock), lock, "left_anti").select(*requests.columns, F.lit("empty").alias("reason")))
    refused = told[0].select(*requests.columns, "reason")
    for more in told[1:]:
        refused = refused.unionByName(more)
    return results.withColumn("deleted", F.lit(False)).join(frontier_signature(entries), "conv_id"), refused


def unfinished(chunks: DataFrame, drafts: DataFrame) -> DataFrame:
    """Chunks (conv_id, chunk, start_id, end_id, source_hash) not among the drafts that still hold: the leading ones of each
    log with the same range and hash."""
    same = chunks.join(drafts.select("conv_id", "start_id", "end_id", "source_hash", F.lit(True).alias("held")), ["conv_id", "start_id", "end_id", "source_hash"], "left")
    first_open = F.min(F.when(F.col("held").isNull(), F.col("chunk"))).over(Window.partitionBy("conv_id"))
    return same.withColumn("first_open", first_open).filter(F.col("chunk") >= F.col("first_open")).drop("held", "first_open")


def still_valid(results: DataFrame, messages: DataFrame, entries: DataFrame) -> DataFrame:
    """results (conv_id, start_id, end_id, source_hash, signature, ...) whose rows and whose log's entries are as they were when
    the work on them began; to be asked when they are written, as either may have changed meanwhile."""
    now = range_hashes(messages, results.select("conv_id", "start_id", "end_id").distinct())
    same = results.join(now, ["conv_id", "start_id", "end_id", "source_hash"], "left_semi")
    return same.join(frontier_signature(entries), ["conv_id", "signature"], "left_semi")


def preferred_snapshots(logs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """conv_id, snapshot_id of the prompt that stands for the last row of each log (conv_id, last_id, run_id, sequence).

    snapshots: conv_id, snapshot_id, run_id (null: a standard one), expected_id, sequence, captured_at. The snapshot of the last
    row's own run is taken unless a standard one for that row has a later sequence; without a run the newest one for that
    row and of the current sequence; and where there is none of these the standard one, if its sequence is current.
    """
    joined = snapshots.join(logs.select("conv_id", "last_id", F.col("run_id").alias("own_run"), F.col("sequence").alias("current")), "conv_id")
    standard, here = F.col("run_id").isNull(), F.col("expected_id") == F.col("last_id")
    newest = F.struct("captured_at", "snapshot_id")
    picked = joined.groupBy("conv_id").agg(
        F.max(F.when(standard & here, F.struct("sequence", "captured_at", "snapshot_id"))).alias("standard"),
        F.max(F.when(F.col("run_id") == F.col("own_run"), F.struct("captured_at", "sequence", "snapshot_id"))).alias("own"),
        F.max(F.when(~standard & here & (F.col("sequence") == F.col("current")), newest)).alias("latest"),
        F.first("own_run").alias("own_run"), F.first("current").alias("current"),
    )
    own = F.when(F.col("own").isNotNull() & ~F.coalesce(F.col("standard.sequence") > F.col("own.sequence"), F.lit(False)), F.col("own.snapshot_id"))
    agent = F.when(F.col("own_run").isNotNull(), own).otherwise(F.col("latest.snapshot_id"))
    chosen = F.coalesce(agent, F.when(F.col("standard.sequence") == F.col("current"), F.col("standard.snapshot_id")))
    return picked.select("conv_id", chosen.alias("snapshot_id")).filter("snapshot_id is not null")


def splice(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """entries with the children of each parent (conv_id, level, start_id, end_id) replaced by it."""
    p = parents.select("conv_id", (F.col("level") - 1).alias("level"), F.col("start_id").alias("p_start"), F.col("end_id").alias("p_end"))
    on = ["conv_id", "level"]
    inside = entries.join(p, on).filter("start_id >= p_start and end_id <= p_end").select("conv_id", "level", "start_id", "end_id")
    return entries.join(inside, ["conv_id", "level", "start_id", "end_id"], "left_anti").unionByName(parents.select(*entries.columns))


def frontiers_differ(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """conv_id of logs whose entries differ in number or in some field."""

    def digest(e: DataFrame, name: str) -> DataFrame:
        return e.groupBy("conv_id").agg(ordered_text(payload(*map(F.col, fields)), F.col("start_id"), "\x1e").alias(name))

    return digest(a, "one").join(digest(b, "two"), "conv_id", "full").filter(~F.col("one").eqNullSafe(F.col("two"))).select("conv_id")


def report_counts(entries: DataFrame) -> DataFrame:
    """conv_id, active, deleted, levels, covered, tokens."""
    return entries.groupBy("conv_id").agg(
        F.count_if(~F.col("deleted")).alias("active"), F.count_if("deleted").alias("deleted_entries"), F.count_distinct("level").alias("levels"), F.max("end_id").alias("covered"), F.sum(token_estimate(F.col("text"))).alias("tokens")
    )


def valid_provenance(parents: DataFrame) -> DataFrame:
    """parents (conv_id, level, start_id, end_id, sources: array of (level, start_id, end_id)) with sources emptied unless
    there are two at least, all one level below, neighbours, and covering just the parent's range."""
    s = F.col("sources")
    steps = F.forall(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i)["start_id"] == F.get(s, i - 1)["end_id"] + 1)
    ok = (F.size(s) >= 2) & F.forall(s, lambda x: x["level"] == F.col("level") - 1) & (F.get(s, F.lit(0))["start_id"] == F.col("start_id")) & (F.element_at(s, -1)["end_id"] == F.col("end_id")) & F.when(F.size(s) >= 2, steps).otherwise(False)
    return parents.withColumn("sources", F.when(ok, s))


def whole_checkpoints(drafts: DataFrame) -> DataFrame:
    """Drafts (conv_id, seq, start_id, end_id, text) of the logs in which none is blank, reversed or out of place."""
    w = Window.partitionBy("conv_id")
    gap = F.col("start_id") != F.coalesce(F.lag("end_id").over(w.orderBy("seq")) + 1, F.lit(0))
    bad = gap | (F.col("end_id") < F.col("start_id")) | (F.coalesce("text", F.lit("")) == "")
    return drafts.withColumn("bad", bad).withColumn("any_bad", F.max("bad").over(w)).filter("not any_bad").drop("bad", "any_bad")
