"""Dictionary entries whose keys occur in a text, picked under a budget.

Keys are found by equal parts: a text's words and the longest word of a key are cut into short grams, so that a word of
the corpus meets only the keys whose longest word it may hold; each text then checks only the keys that its own words
lead to. Keys without any word, and those that are patterns, are tried on every text: a small part of a dictionary.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from convlog.functions.text import CJK, escaped, token_estimate, trim
from convlog.store import stored

SENT = 16 << 20  # bytes of a table that is sent to every task
PATTERNS = 10_000  # patterns that a task tries on each text
WORD = r"[\p{L}\p{N}_]+"
GRAM = 3  # characters


def _few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if the optimizer counts no more than SENT bytes for it: of a stored table the size of its
    files, of others an upper estimate. No job is run for it."""
    return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SENT else df


def available(entries: DataFrame) -> DataFrame:
    """Entries that are on, have content, aren't switched off by a decorator and fire on normal requests."""
    off = F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d.startswith("@@dont_activate"))
    fires = F.coalesce(F.size("triggers"), F.lit(0)) <= 0
    return entries.filter(~F.coalesce("disable", F.lit(False)) & (trim(F.coalesce("content", F.lit(""))) != "") & ~off & (fires | F.array_contains("triggers", "normal")))


def participates(names: Column, tags: Column, only_names: Column, only_tags: Column, exclude: Column) -> Column:
    """Whether a filter lets a text through: by the names that are active in it, then by their tags; an empty list asks
    for nothing, an excluding filter turns both tests around."""
    none = F.array().cast("array<string>")

    def passes(active: Column, wanted: Column) -> Column:
        wanted = F.coalesce(wanted, none)
        return (F.size(wanted) == 0) | (F.arrays_overlap(F.coalesce(active, none), wanted) != F.coalesce(exclude, F.lit(False)))

    return passes(names, only_names) & passes(tags, only_tags)


def active_tags(texts: DataFrame, tags: DataFrame) -> DataFrame:
    """text_id, tags: those of the names (text_id, names) that the table (name, tag) knows."""
    named = texts.select("text_id", F.explode("names").alias("name"))
    return named.join(_few(tags), "name").groupBy("text_id").agg(F.collect_set("tag").alias("tags"))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalised(text: Column) -> Column:
    """Compatibility forms composed (NFKC), for which Spark has no function."""
    return _composed(text)


def key_matches(text: Column, needle: Column, whole_words: Column) -> Column:
    """A needle as a substring; whole words only where asked for, unless it has blanks or CJK characters. Both come
    normalised, and lower-cased where case is of no matter."""
    loose = ~whole_words | needle.rlike(CJK) | needle.rlike(r"\s")
    quoted = F.regexp_replace(needle, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    edge = r"[^\p{L}\p{N}_]"
    strict = F.rlike(text, F.concat(F.lit(f"(?:^|{edge})"), quoted, F.lit(f"(?:$|{edge})")))
    return (needle != "") & text.contains(needle) & (loose | strict)


def pattern(key: str) -> tuple[str, int, bool] | None:
    """Source, flags and whether it must match at the start, of a key /source/flags that is a valid pattern."""
    end = key.rfind("/")
    flags = key[end + 1 :]
    if not key.startswith("/") or end <= 0 or set(flags) - set("dgimsuvy") or len(set(flags)) < len(flags):
        return None
    source = re.sub(r"\(\?<(?![=!])", "(?P<", key[1:end])
    try:
        re.compile(source)
    except re.error:
        return None
    return source, sum(v for f, v in (("i", re.I), ("m", re.M), ("s", re.S)) if f in flags), "y" in flags


def _by_pattern(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, list[str]]:
    """(text_id, raw) of the keys that are patterns and found in a text as it is written; and those keys. They are
    compiled in the tasks, so they go there whole."""
    listed = keys.filter(F.col("raw").startswith("/")).select("raw").distinct().limit(PATTERNS + 1).collect()
    if len(listed) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns")
    found = [(k, p) for k, p in ((r.raw, pattern(r.raw)) for r in listed) if p]

    @F.pandas_udf(ArrayType(StringType()))
    def hits(text: pd.Series) -> pd.Series:
        tests = [(k, re.compile(p[0], p[1]).match if p[2] else re.compile(p[0], p[1]).search) for k, p in found]
        return text.map(lambda t: [k for k, test in tests if test(t or "")])

    return texts.select("text_id", F.explode(hits(F.col("text"))).alias("raw")), [k for k, _ in found]


def _grams(word: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - k + 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(k)))


def _numbered(keys: Column, primary: bool) -> Column:
    return F.transform(keys, lambda k, i: F.struct(F.lit(primary).alias("primary"), i.alias("no"), trim(k).alias("raw")))


def _by_words(folded: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, key) of the keys that may occur in a text: some word of it holds the key's longest, and begins and ends with
    it where the key (or its being a whole word) asks for it."""
    words = folded.select("text_id", F.explode("words").alias("word"))
    grams = F.flatten(F.array(*(_grams(F.col("word"), k) for k in range(1, GRAM + 1))))
    keyed = _few(needles.select("key", "longest", "begins", "ends", F.substr("longest", F.lit(1), F.lit(GRAM)).alias("gram")))
    met = words.select("word").distinct().select("word", F.explode(F.array_distinct(grams)).alias("gram")).join(keyed, "gram")
    c = F.col
    held = F.when(c("begins") & c("ends"), c("word") == c("longest")).when(c("begins"), c("word").startswith(c("longest"))).when(c("ends"), c("word").endswith(c("longest"))).otherwise(c("word").contains(c("longest")))
    met = met.filter(held).select("word", "key")
    return words.join(_few(stored(met)), "word").select("text_id", "key").distinct()


def _longest(needle: Column, strict: Column) -> Column:
    """n, w (a key's longest word), begins, ends: whether a word of a text that holds it must begin and end with it."""
    runs, edge = F.regexp_extract_all(F.lower(needle), F.lit(WORD), 0), lambda p: ~F.lower(needle).rlike(p)
    one = lambda x, i: F.struct(F.length(x).alias("n"), x.alias("w"), ((i > 0) | edge(f"^{WORD}") | strict).alias("begins"), ((i < F.size(runs) - 1) | edge(f"{WORD}$") | strict).alias("ends"))
    return F.array_max(F.transform(runs, one))


def key_hits(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_id, raw, cased, whole): the keys (raw, cased, whole) that occur in each text (text_id, text). Texts are composed
    once, into a stored table; at most PATTERNS keys may be patterns."""
    keys = stored(keys.filter("raw <> ''").distinct())
    by_pattern, patterns = _by_pattern(texts, keys)
    plain = keys.filter(~F.col("raw").isin(patterns)) if patterns else keys
    composed = normalised(F.col("raw"))
    plain = plain.withColumn("needle", composed).withColumn("needle", F.when(F.col("cased"), F.col("needle")).otherwise(F.lower("needle")))
    strict = F.col("whole") & ~F.col("needle").rlike(CJK) & ~F.col("needle").rlike(r"\s")
    plain = plain.withColumn("l", _longest(F.col("needle"), strict)).withColumns({"longest": F.col("l.w"), "begins": F.col("l.begins"), "ends": F.col("l.ends")}).drop("l")
    folded = texts.select("text_id", normalised(F.col("text")).alias("whole_text")).withColumn("words", F.array_distinct(F.regexp_extract_all(F.lower("whole_text"), F.lit(WORD), 0)))
    folded = stored(folded).withColumn("lower", F.lower("whole_text"))
    plain = stored(plain)
    needles = plain.filter("longest is not null").select("needle", "cased", "whole", "longest", "begins", "ends").distinct()
    needles = stored(needles.withColumn("key", F.monotonically_increasing_id()))
    key, three = F.struct("needle", "cased", "whole"), ["text_id", "needle", "cased", "whole"]
    led = stored(_by_words(folded, needles)).join(_few(needles), "key")
    sure = ~F.col("cased") & (F.col("needle") == F.col("longest"))  # such a key is in the text if it is in the word
    likely = led.filter(~sure).groupBy("text_id").agg(F.collect_list(key).alias("likely"))
    wordless = plain.filter("longest is null").select("needle", "cased", "whole").distinct()
    tried = folded.drop("words").join(likely, "text_id").unionByName(folded.drop("words").join(_few(wordless), F.col("whole_text").contains(F.col("needle")) | F.col("lower").contains(F.col("needle"))).select("text_id", "whole_text", "lower", F.array(key).alias("likely")))
    # a text's keys are tried in its own row, so that a text is sent once and not once a key
    met = F.filter("likely", lambda k: key_matches(F.when(k["cased"], F.col("whole_text")).otherwise(F.col("lower")), k["needle"], k["whole"]))
    found = tried.select("text_id", F.explode(met).alias("k")).select("text_id", "k.*").unionByName(led.filter(sure).select(*three))
    hits = found.join(_few(plain.select("raw", "needle", "cased", "whole")), ["needle", "cased", "whole"]).select("text_id", "raw", "cased", "whole")
    return hits.unionByName(by_pattern.join(_few(keys), "raw").select("text_id", "raw", "cased", "whole"))


def selected(primary: Column, secondary: Column, all_secondary: Column, selective: Column, logic: Column) -> Column:
    """Any of the primary keys; and, of an entry that is selective and has secondary keys, of those by logic: 0 any, 1 not
    all, 2 none, 3 all. The three counts are of primary and secondary keys found and of secondary keys."""
    second = F.when(~selective | (all_secondary == 0), True).when(logic == 1, secondary < all_secondary).when(logic == 2, secondary == 0).when(logic == 3, secondary == all_secondary).otherwise(secondary > 0)
    return (primary > 0) & second


IDENTITY = ["world", "uid", "comment", "content"]


def _identity() -> Column:
    """What tells entries apart: equal in these fields, blanks at their ends aside, they are one."""
    return F.sha2(F.concat_ws("\0", *(trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in IDENTITY)), 256)


def match(texts: DataFrame, entries: DataFrame, most: int, tags: DataFrame | None = None) -> DataFrame:
    """text_id, uid, identity, place, constant, matched_keys, truncated: the entries that fit each text (text_id, text, names):
    constants, then at most `most` by key, each in the host's order (pos; without it uid); truncated says that there were more.

    entries: uid, world, comment, content, key, keysecondary, selective, selectiveLogic, constant, caseSensitive,
    matchWholeWords, only_names, only_tags, exclude. All are matched; of those that fit a text and are one (identity) a
    constant counts before others, then the first. tags (name, tag) are those of names. Empty and null texts have the
    constants alone.
    """
    none, off = F.array().cast("array<string>"), F.lit(False)
    pos = F.col("pos") if "pos" in entries.columns else F.col("uid")
    book = entries.select(
        "uid", pos.alias("pos"), _identity().alias("identity"), F.coalesce("key", none).alias("key"), F.coalesce("keysecondary", none).alias("keysecondary"), F.coalesce("selective", off).alias("selective"), F.coalesce("selectiveLogic", F.lit(0)).alias("logic"), F.coalesce("constant", off).alias("constant"),
        F.coalesce("caseSensitive", off).alias("cased"), F.coalesce("matchWholeWords", off).alias("whole"), "only_names", "only_tags", "exclude",
    )
    book = stored(book.withColumn("eid", F.monotonically_increasing_id()))  # a row of its own for each entry
    numbered = F.concat(*(_numbered(F.col(c), p) for c, p in (("key", True), ("keysecondary", False))))
    listed = book.filter("not constant").select("eid", "cased", "whole", F.explode(numbered).alias("k"))
    listed = stored(listed.select("eid", "cased", "whole", "k.*"))
    hits = key_hits(texts, listed.select("raw", "cased", "whole")).join(_few(listed), ["raw", "cased", "whole"])
    counted = hits.groupBy("text_id", "eid").agg(F.count_if("primary").alias("one"), F.count_if(~F.col("primary")).alias("two"), F.sort_array(F.collect_list(F.when(F.col("primary"), F.struct("no", "raw")))).alias("found"))
    by_key = counted.filter("one > 0").join(_few(book.drop("key", "constant")), "eid").filter(selected(F.col("one"), F.col("two"), F.size("keysecondary"), F.col("selective"), F.col("logic")))
    columns = ["uid", "pos", "identity", "only_names", "only_tags", "exclude"]
    by_key = by_key.select("text_id", *columns, F.lit(False).alias("constant"), F.transform("found", lambda x: x["raw"]).alias("matched_keys"))
    # constants go with every text: there are as many rows as the result has
    constants, ids = _few(book.filter("constant").select(*columns)), texts.select("text_id")
    if "names" in texts.columns:
        with_tags = texts.select("text_id", "names").join(active_tags(texts, tags), "text_id", "left") if tags is not None else texts.select("text_id", "names", none.alias("tags"))
        ids = stored(with_tags)
        lets = participates(F.col("names"), F.col("tags"), F.col("only_names"), F.col("only_tags"), F.col("exclude"))
        by_key, fixed = by_key.join(ids, "text_id").filter(lets), ids.crossJoin(constants).filter(lets)
    else:
        fixed = ids.crossJoin(constants)
    shown = ["text_id", "uid", "pos", "identity", "constant", "matched_keys"]
    found = by_key.select(*shown).unionByName(fixed.withColumns({"constant": F.lit(True), "matched_keys": none}).select(*shown)).repartition("text_id")  # one exchange for all windows
    same = Window.partitionBy("text_id", "identity").orderBy(F.col("constant").desc(), "pos")
    found = found.withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    w, per = Window.partitionBy("text_id", "constant"), Window.partitionBy("text_id")
    ranked = found.withColumn("rn", F.row_number().over(w.orderBy("pos", "identity"))).withColumn("n", F.count("*").over(w))
    kept = ranked.filter(F.col("constant") | (F.col("rn") <= most)).withColumn("cut", ~F.col("constant") & (F.col("n") > most))
    place = F.col("rn") + F.when(F.col("constant"), F.lit(0)).otherwise(F.count_if("constant").over(per))
    return kept.select("text_id", "uid", "identity", place.cast("long").alias("place"), "constant", "matched_keys", F.max("cut").over(per).alias("truncated"))


def budgeted(blocks: DataFrame, most: int | Column, separator: int = 2) -> DataFrame:
    """The leading blocks (text_id, place, chars) whose running length, separators counted, fits; stops at the first misfit."""
    w = Window.partitionBy("text_id").orderBy("place")
    total = F.sum(F.col("chars") + F.when(F.col("place") > 1, separator).otherwise(0)).over(w)
    return blocks.withColumn("used", total).filter(F.col("used") <= most)


def block_text(header: Column, content: Column) -> Column:
    """A block of a header and a content that is escaped already."""
    return F.concat(F.lit("["), escaped(header), F.lit("]\n"), content)


def references(matched: DataFrame, entries: DataFrame, budget: int) -> DataFrame:
    """text_id, text, tokens, constant_chars, matched_chars, n_entries, truncated: the blocks of the entries matched, constants
    first and the rest within what they leave of the budget; whole blocks only."""
    matched = stored(matched)  # read three times below
    book = entries.select(_identity().alias("identity"), "uid", "world", "comment", escaped(trim("content")).alias("body")).dropDuplicates(["identity"])  # contents are escaped once an entry
    nth = F.row_number().over(Window.partitionBy("text_id", "constant").orderBy("place"))
    header = F.concat_ws("|", F.concat(F.lit("entry "), nth.cast("string")), F.concat(F.coalesce(F.nullif(trim("world"), F.lit("")), F.lit("unnamed")), F.lit("#"), F.col("uid").cast("string")), F.nullif(trim("comment"), F.lit("")), F.when(F.col("constant"), F.lit("constant")).otherwise(F.concat(F.lit("keys="), F.array_join("matched_keys", ","))))
    blocks = matched.drop("uid").join(_few(book), "identity").select("text_id", nth.cast("long").alias("place"), "constant", "truncated", block_text(header, F.col("body")).alias("block")).withColumn("chars", F.length("block"))
    fixed = budgeted(blocks.filter("constant"), budget)
    spent = fixed.groupBy("text_id").agg(F.max("used").alias("spent"))
    rest = budgeted(blocks.filter("not constant").join(spent, "text_id", "left"), F.lit(budget) - F.coalesce("spent", F.lit(0))).drop("spent")
    kept = fixed.unionByName(rest).groupBy("text_id").agg(
        F.sort_array(F.collect_list(F.struct((~F.col("constant")).alias("side"), "place", "block"))).alias("b"), F.coalesce(F.max(F.when(F.col("constant"), F.col("used"))), F.lit(0)).alias("constant_chars"), F.coalesce(F.max(F.when(~F.col("constant"), F.col("used"))), F.lit(0)).alias("matched_chars"), F.count("*").alias("n_entries"),
    )
    told = blocks.groupBy("text_id").agg(F.count("*").alias("n"), F.max("truncated").alias("over")).join(kept, "text_id", "left")
    text = F.coalesce(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit(""))
    return told.select("text_id", text.alias("text"), token_estimate(text).alias("tokens"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("constant_chars", "matched_chars", "n_entries")), (F.col("over") | (F.col("n") > F.coalesce("n_entries", F.lit(0)))).alias("truncated"))
