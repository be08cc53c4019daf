"""Quality rules in DataFrame operations only.

Per document: words, symbols, repeated lines and repeated three-word windows. Across documents: normalised lines are
hashed, and for each host (``source``) the distinct documents that hold a line are counted; a line in more than
``max_docs`` of them is boilerplate. A document is depleted, and rejected, if boilerplate makes up more than
``max_removed_share`` percent of its words.

Copies of one document count once: a document is known by the whole set of its line hashes, so a group of copies does
not turn its own prose into boilerplate. One line of its own makes a document a different one.

Defined cases: null text has no words and fails the base rules; null source is the host ''; null doc_id and repeated
rows are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialize, spread_join

#: What parts words, and what counts as a symbol.
SPACES = " \t\n\x0b\f\r"
_GAPS, _WORD = r"[ \t\n\x0B\f\r]+", r"[^ \t\n\x0B\f\r]+"
_SYMBOL = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_DOCS, MAX_REMOVED_PERCENT = 20, 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAPS), "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def line_hash(line: Column) -> Column:
    """64 bits of the line in lower case, without outer space, digits made alike."""
    return F.xxhash64(F.regexp_replace(F.lower(F.btrim(line, F.lit(SPACES))), "[0-9]+", "0"))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from ``words``: windows are hashed with their places and sorted, so equal ones are neighbours;
    the places of those that have one, sorted again, cover three words each, less their overlap."""
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    places = F.sequence(F.lit(0), F.size("words") - 3)
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.withColumn("_sorted", F.when(F.size("words") >= 4, F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("h"), i.alias("p"))))).otherwise(none))
    at = lambda k: F.get("_sorted", k)["h"]
    twice = lambda x, k: (x["h"].eqNullSafe(at(k - 1)) | x["h"].eqNullSafe(at(k + 1)))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", twice), lambda x: x["p"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
    return df.withColumn("n_repeat_words", F.aggregate("_at", start, step, lambda acc: acc["n"]).cast("long")).drop("_sorted", "_at")


def row_key() -> list[Column]:
    """Tells rows apart; equal rows share a key and a verdict."""
    return [F.col("doc_id"), F.xxhash64("doc_id", "source", "text").alias("row_hash")]


def measure(docs: DataFrame) -> DataFrame:
    """Base measures of every row: doc_id, row_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*row_key(), text.alias("text")).withColumn("words", words_of(F.col("text"))).withColumn("lines", lines_of(F.col("text")))
    df = _with_repeats(df).select(
        "doc_id", "row_hash",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def line_uses(docs: DataFrame) -> DataFrame:
    """One row a line: doc_id, row_hash, host, doc (hash of its set of lines), pos, line (hash), words in it."""
    df = docs.select(*row_key(), F.coalesce("source", F.lit("")).alias("host"), lines_of(F.coalesce("text", F.lit(""))).alias("lines"))
    held = lambda x: F.struct(line_hash(x).alias("line"), F.regexp_count(x, F.lit(_WORD)).alias("words"))
    df = df.select("doc_id", "row_hash", "host", F.transform("lines", held).alias("held"))
    known = F.xxhash64(F.array_sort(F.array_distinct(F.col("held.line"))))
    df = df.select("doc_id", "row_hash", "host", known.alias("doc"), F.posexplode("held").alias("pos", "held"))
    return df.select("doc_id", "row_hash", "host", "doc", "pos", "held.line", "held.words")


def boilerplate_lines(uses: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, line, n_docs of lines in more than ``max_docs`` distinct documents of a host.

    Distinct (host, line, doc) rows are formed first, which spreads a very common line over all tasks.
    """
    held = uses.select("host", "line", "doc").distinct()
    return held.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def boilerplate_uses(uses: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, row_hash, removed_words and removed (hashes) of rows that hold boilerplate; equal rows give one.

    A line that very many rows hold, as boilerplate does, is met in as many parts as its uses ask for.
    """
    known = boilerplate_lines(uses, max_docs).select("host", "line")
    held = spread_join(uses.select("doc_id", "row_hash", "host", "pos", "line", "words"), known, ["host", "line"], ["row_hash", "pos"], uses.count())
    # dealt by row once: both groupings use that
    once = held.repartition("doc_id", "row_hash").groupBy("doc_id", "row_hash", "pos").agg(F.max("words").alias("words"), F.max("line").alias("line"))
    return once.groupBy("doc_id", "row_hash").agg(F.sum("words").cast("long").alias("removed_words"), F.collect_set("line").alias("removed"))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))


def _judged(docs: DataFrame, max_docs: int, max_removed_percent: int) -> DataFrame:
    """Measures, verdict and boilerplate (``removed``) of every row of ``docs``, which are read twice."""
    uses = materialize(line_uses(docs), "line-uses")
    found = boilerplate_uses(uses, max_docs).select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "removed_words", "removed")
    rows = measure(docs)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["row_hash"] == F.col("_hash")), "left")
    joined = joined.select(rows["*"], F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), "removed")
    depleted = 100 * F.col("removed_words") > max_removed_percent * F.col("n_words")
    return joined.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge_quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text, source). Write the result before filtering on it."""
    return _judged(_columns(docs), max_docs, max_removed_percent).drop("removed")


def apply_quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """Kept rows of ``docs``, boilerplate lines taken out of ``text`` (and ``n_chars``, if there, counted anew)."""
    # written first: a filter on the verdict would be pushed into, and repeat, the expressions that measure a text
    judged = materialize(_judged(_columns(docs), max_docs, max_removed_percent).select("doc_id", "row_hash", "kept", "removed"), "verdicts")
    verdict = judged.where("kept").groupBy("doc_id", "row_hash").agg(F.first("removed").alias("removed"))
    # the row in one struct, so that no name of its columns meets ours
    own = F.col("row.doc_id").cast("long"), F.col("row.source").cast("string"), F.col("row.text").cast("string")
    rows = docs.select(F.struct("*").alias("row")).withColumn("key", F.xxhash64(*own))
    kept = rows.join(verdict, own[0].eqNullSafe(verdict["doc_id"]) & (F.col("key") == verdict["row_hash"])).select("row", "removed")
    rest = F.array_join(F.filter(F.split(own[2], "\n"), lambda x: ~F.array_contains("removed", line_hash(x))), "\n")
    whole = F.col("removed").isNull()
    kept = kept.withColumn("rest", F.when(whole, own[2]).otherwise(rest))
    changed = {"text": F.col("rest"), "n_chars": F.when(whole, F.col("row")["n_chars"]).otherwise(F.length("rest")) if "n_chars" in docs.columns else None}
    return kept.select(*(changed.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
