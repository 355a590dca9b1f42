"""Incremental refresh: a stream of changes to logs, work for the logs that they touch alone.

Current rows, live entries and logs that still have something due are tables in buckets of conv_id; a pass reads and
rewrites the buckets that its changes touch, under the number of its batch. There is no watermark: an edit may come at any
time, and it counts from the row that it changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlog.operators.chunks import plan_by_turns, plan_chunks, ready_chunks
from convlog.operators.frontier import branch
from convlog.operators.jobs import still_valid, summarise
from convlog.operators.lineage import changed_from
from convlog.operators.rollup import roll_up_once, rollup_due
from convlog.operators.state import guarded
from convlog.operators.turns import ready_target
from convlog.params import Params
from convlog.sources.messages import COLUMNS, from_events
from convlog.store import dropped, shared_folder, stored
from convlog.streaming.buckets import Buckets

ROWS = "conv_id long, message_id long, is_user boolean, is_system boolean, name string, text string"
ENTRIES = "conv_id long, level int, start_id long, end_id long, deleted boolean, text string, source_hash string"
CHANGES = f"{ROWS}, changed_at long, kind string, new_id long, upto long"
KINDS = ["row", "delete", "branch", "rename"]


def typed(changes: DataFrame) -> DataFrame:
    """Changes with all columns of CHANGES: where there is no kind a row with a null text is a deletion."""
    kind = F.coalesce("kind", F.lit("row")) if "kind" in changes.columns else F.when(F.col("text").isNull(), "delete").otherwise("row")
    more = [F.col(c).cast("long") if c in changes.columns else F.lit(None).cast("long").alias(c) for c in ("new_id", "upto")]
    return changes.select(*COLUMNS, F.col("changed_at").cast("long").alias("changed_at"), kind.alias("kind"), *more).filter(F.col("kind").isin(KINDS))


def touched_logs(changes: DataFrame) -> DataFrame:
    """conv_id of the logs that changes read or write, those that branches and renames make included."""
    return changes.select(F.explode(F.array("conv_id", "new_id")).alias("conv_id")).filter("conv_id is not null").distinct()


def _others(changes: DataFrame, kind: str) -> DataFrame:
    """One change of a kind a log, the last."""
    last = F.max_by(F.struct("new_id", "upto"), "changed_at")
    return changes.filter(F.col("kind") == kind).groupBy("conv_id").agg(last.alias("c")).select("conv_id", "c.*").filter("new_id is not null")


def applied(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows (ROWS) after changes: of each row the last change counts (new, edited or swiped rows, and deletions, behind which
    the rows of a log close up); then branches copy the rows up to `upto` to a new log, and renames move a log, either only
    where there is no such log. Ids are those before the changes."""
    w = Window.partitionBy("conv_id", "message_id").orderBy(F.col("changed_at").desc(), "kind")
    last = changes.filter(F.col("kind").isin("row", "delete")).withColumn("k", F.row_number().over(w)).filter("k = 1")
    kept = rows.join(last.select("conv_id", "message_id"), ["conv_id", "message_id"], "left_anti")
    now = kept.select(*COLUMNS).unionByName(last.filter("kind = 'row'").select(*COLUMNS))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("message_id")) - 1
    shrunk = last.filter("kind = 'delete'").select("conv_id").distinct()
    closed = now.join(shrunk, "conv_id", "left_semi").withColumn("message_id", place.cast("long"))
    now = now.join(shrunk, "conv_id", "left_anti").unionByName(closed)
    return _moved(_branched(now, changes, "message_id"), changes)


def _branched(table: DataFrame, changes: DataFrame, end: str) -> DataFrame:
    there = table.select(F.col("conv_id").alias("new_id")).distinct()
    new = _others(changes, "branch").join(there, "new_id", "left_anti")
    return branch(table.withColumn("end_id", F.col(end)), new).select(*table.columns)


def _moved(table: DataFrame, changes: DataFrame) -> DataFrame:
    there = table.select(F.col("conv_id").alias("new_id")).distinct()
    names = _others(changes, "rename").join(there, "new_id", "left_anti").select("conv_id", F.col("new_id").alias("other"))
    return table.join(names, "conv_id", "left").withColumn("conv_id", F.coalesce("other", "conv_id")).select(*table.columns)


def surviving(entries: DataFrame, before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """entries of logs whose rows went from before to after: those that end before a log's first row that changed; branches
    and renames take theirs along."""
    inside = changes.filter(F.col("kind").isin("row", "delete"))
    changed = changed_from(before, applied(before, inside)).select("conv_id", "changed_from")
    kept = entries.join(changed, "conv_id", "left").filter("changed_from is null or end_id < changed_from").select(*entries.columns)
    return _moved(_branched(kept, changes, "end_id"), changes)


class Refresher:
    """For foreachBatch: takes a batch of changes in, then makes at most max_chunks chunks' summaries (None: all) and one
    roll-up for each log touched, or left due by the pass before. What is due after it is in the table `due`.

    A batch that runs again finds its commit made and changes nothing; one that failed half-way left nothing named.
    """

    def __init__(self, spark: SparkSession, folder: str, params: Params, max_chunks: int | None = 1, boundary: Column | None = None, visible: Column | None = None, summariser: Callable[[Column], Column] | None = None, buckets: int = 64):
        self.store = Buckets(spark, folder, {"rows": ROWS, "entries": ENTRIES, "due": "conv_id long"}, buckets)
        self.params, self.max_chunks, self.boundary, self.visible, self.summariser = params, max_chunks, boundary, visible, summariser

    def __call__(self, batch: DataFrame, number: int) -> None:
        store = self.store
        if number <= store.last():
            return
        changes = stored(typed(batch))
        due = store.read("due")
        logs = stored(touched_logs(changes).unionByName(due).distinct())
        buckets = store.touched(logs)
        rows, entries = store.read("rows", buckets), store.read("entries", buckets)
        mine, others = rows.join(logs, "conv_id", "left_semi"), rows.join(logs, "conv_id", "left_anti")
        now = stored(applied(mine, changes))
        live = stored(surviving(entries.join(logs, "conv_id", "left_semi"), mine, now, changes))
        made, more = self.summarised(now, live)
        rolled = stored(roll_up_once(live.unionByName(made), self.params.group_1, self.params.group_n))
        waiting = rollup_due(rolled, self.params.group_1, self.params.group_n).select("conv_id").unionByName(more).distinct()
        kept = entries.join(logs, "conv_id", "left_anti")
        store.commit(number, {"rows": others.unionByName(now), "entries": kept.unionByName(rolled.select(*kept.columns)), "due": waiting}, buckets)
        dropped(changes, logs, now, live, rolled)

    def summarised(self, rows: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """New level-1 entries behind what is covered; and the logs that have more chunks ready."""
        p = self.params
        covered = entries.groupBy("conv_id").agg(F.max("end_id").alias("covered"))
        open_ = rows.join(ready_target(rows, p.window_size, p.window_unit), "conv_id").join(covered, "conv_id", "left")
        open_ = stored(open_.filter("message_id <= target and message_id > coalesce(covered, -1)").select(*COLUMNS))
        plan = plan_chunks(open_, p.turns_per_chunk, p.chunk_chars, self.boundary)
        ready = stored(ready_chunks(open_, plan, p.turns_per_chunk, p.chunk_chars, self.visible if self.visible is not None else F.lit(True)))
        first = ready if self.max_chunks is None else ready.filter(F.col("chunk") < self.max_chunks)
        more = ready.join(first, ["conv_id", "chunk"], "left_anti").select("conv_id").distinct()
        return stored(summarise(open_, first, self.summariser, p.stored_chars)), more

    def drained(self) -> int:
        """Passes without changes until nothing is due; how many there were."""
        spark, n = self.store.spark, 0
        while not self.store.read("due").isEmpty():
            before = self.store.last()
            self(spark.createDataFrame([], CHANGES), before + 1)
            n += 1
        return n


def publish(store: Buckets, number: int, results: DataFrame, owners: DataFrame) -> tuple[bool, DataFrame]:
    """Commit results (ENTRIES, owner, signature of the log's entries when the work began) as entries in place of those that
    they overlap, under `number`: only those whose owner still is the log's (conv_id, owner), and whose rows and whose log's
    entries are as they were. Returns whether it was committed, and the results refused; nothing to keep, nothing is written."""
    results = stored(results)
    buckets = store.touched(results)
    rows, entries = store.read("rows", buckets), store.read("entries", buckets)
    kept = stored(still_valid(guarded(results, owners)[0], rows, entries))
    refused = results.join(kept.select("conv_id", "start_id", "end_id"), ["conv_id", "start_id", "end_id"], "left_anti")
    if kept.isEmpty():
        return False, refused
    # a range is replaced by its first row's entry: ranges of live entries don't overlap
    new = kept.select("conv_id", F.col("start_id").alias("from"), F.col("end_id").alias("to"))
    met = entries.join(new, "conv_id").filter("start_id <= to and end_id >= from").select("conv_id", "level", "start_id").distinct()
    after = entries.join(met, ["conv_id", "level", "start_id"], "left_anti").unionByName(kept.select(*entries.columns))
    return store.commit(number, {"entries": after}, buckets), refused


class PlanRefresher:
    """For foreachBatch: current rows and plans by turns of the logs that a batch touches."""

    def __init__(self, spark: SparkSession, folder: str, turns: int, buckets: int = 64):
        self.store = Buckets(spark, folder, {"rows": ROWS, "plans": "conv_id long, chunk long, start_id long, end_id long, turns_done long"}, buckets)
        self.turns = turns

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.store.last():
            return
        changes = stored(typed(batch))
        logs = stored(touched_logs(changes))
        buckets = self.store.touched(logs)
        rows, plans = self.store.read("rows", buckets), self.store.read("plans", buckets)
        now = stored(applied(rows.join(logs, "conv_id", "left_semi"), changes))
        plan = plans.join(logs, "conv_id", "left_anti").unionByName(plan_by_turns(now, self.turns).select(*plans.columns))
        self.store.commit(number, {"rows": rows.join(logs, "conv_id", "left_anti").unionByName(now), "plans": plan}, buckets)
        dropped(changes, logs, now)


def run_changes(spark: SparkSession, source: str, folder: str, taker: Callable[[DataFrame, int], None]) -> None:
    """Take in the change files of a folder that are new since the last call, all in one batch."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = stream.writeStream.foreachBatch(taker).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def run_refresh(spark: SparkSession, source: str, folder: str, turns: int) -> DataFrame:
    """The plans of all logs once the new change files are taken in."""
    refresher = PlanRefresher(spark, folder, turns)
    run_changes(spark, source, folder, refresher)
    return refresher.store.read("plans")


def _arriving(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The logs of the events table in three parts; every row 5 comes edited in the second."""
    m = from_events(spark, sf_dir).withColumn("part", F.least(F.floor(F.col("message_id") / 25), F.lit(2)))
    edit = m.filter("message_id = 5").withColumn("is_user", ~F.col("is_user") & ~F.col("is_system")).withColumn("part", F.lit(1))
    rows = m.unionByName(edit)
    return [rows.filter(F.col("part") == k).select(*COLUMNS, F.lit(k).cast("long").alias("changed_at")) for k in range(3)]


def r1_incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the logs after the last part: row 5 stays as it was edited."""
    folder = shared_folder(spark)
    for part in _arriving(spark, sf_dir):
        part.write.mode("append").parquet(f"{folder}/source")
        plans = run_refresh(spark, f"{folder}/source", folder, 2)
    return plans
