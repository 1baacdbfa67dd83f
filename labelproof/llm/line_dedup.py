"""Line dedup in DataFrame operations only: a suffix array over line ids, built by distributed prefix doubling.

The lines of all documents, in order of (document, line), are one long sequence of line ids with a break after each
document. Prefix doubling ranks all positions by their next 1, 2, 4, ... lines: the rank by 2n lines is the order of
the pairs (rank by n lines here, rank by n lines n further on). Positions whose rank nobody shares leave the doubling,
for no longer run from there repeats. Positions of equal rank are an interval of the suffix array in which neighbours
have a common prefix of that many lines.

A run of lines is a passage when it has ``min_words`` words or more. Every copy of a passage but the first is deleted
(one that overlaps the first in the same document is no copy), and with it all of the maximal repeated run around it. To find those runs it is enough to look, at each line, at the
shortest passage that begins there and the shortest that ends there: a line belongs to a repeated run of enough words
exactly if it lies in one of these that is repeated. A passage of n lines is named by the ranks of its first and its
last 2^k lines, 2^k <= n < 2^(k+1), so its copies are the positions with the same two ranks: an interval of common
prefix n. As every line has a word, no passage is longer than ``min_words`` lines, and doubling ends there.

No step holds a group in one task: copies are counted by partial aggregates and joined by rank, and ranks are places
in a range-partitioned order. Each order is written once before it is read, so that a lost executor cannot deal it
out differently.

Defined cases: lines are cut at line feeds; lines without words are no part of the sequence, and are deleted only
inside a deleted run. A null text has no lines and stays null. Rows with equal id and equal text are one document.
A null id comes first. An empty table gives no rows. Other columns pass through unread. Lines are told apart by 128 hashed bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelproof.llm.columns import by_place
from labelproof.session import stored

WORD = "[^\\x20\\x09-\\x0D]+"
MIN_WORDS = 51
DOC = ["d1", "d2"]


def _doc_keys(key: str, text: str) -> list[Column]:
    return [F.xxhash64(key).alias("d1"), F.xxhash64(F.lit("text"), text).alias("d2")]


def sequence(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """One row per line with words: its document and place, its hash, and the two shortest passages at it."""
    lines = (
        docs.filter(F.col(text).isNotNull())
        .select(F.col(key).alias("id"), *_doc_keys(key, text), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select(
            "id",
            *DOC,
            "pos",
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit("line"), "line").alias("h2"),
            F.regexp_count("line", F.lit(WORD)).cast("long").alias("w"),
        )
        .filter("w > 0")
        # equal rows are one document; the windows below use the same partitioning
        .repartition(*DOC)
        .dropDuplicates([*DOC, "pos"])
    )
    here = Window.partitionBy(*DOC)
    counted = lines.withColumn("j", F.row_number().over(here.orderBy("pos"))).withColumn(
        "upto", F.sum("w").over(here.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    )
    counted = counted.withColumn("before", F.col("upto") - F.col("w"))
    ahead = here.orderBy("before").rangeBetween(0, min_words - 1)
    behind = here.orderBy("upto").rangeBetween(-(min_words - 1), 0)

    def passage(first, last, first_pos, last_pos, words):
        return F.when(
            words >= min_words,
            F.struct(
                first.alias("a"), (last - first + 1).alias("n"), first_pos.alias("from_pos"), last_pos.alias("to_pos")
            ),
        )

    return counted.select(
        "id",
        *DOC,
        "j",
        "h1",
        "h2",
        passage(
            F.col("j"), F.max("j").over(ahead), F.col("pos"), F.max("pos").over(ahead),
            F.max("upto").over(ahead) - F.col("before"),
        ).alias("onward"),
        passage(
            F.min("j").over(behind), F.col("j"), F.min("pos").over(behind), F.col("pos"),
            F.col("upto") - F.min("before").over(behind),
        ).alias("back"),
    )


def _ranked(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, rank) of the values that occur twice or more; ranks follow the order of the values."""
    shared = rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1").select(*keys)
    order = shared.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # partition number and place within: rising along the order; written at once, so it stays as it is
    return stored(order.withColumn("rank", F.monotonically_increasing_id()), label)


def suffix_ranks(lines: DataFrame, most_lines: int) -> list[DataFrame]:
    """Per level k: (document, j, rank) of all positions that share their next 2^k lines with another."""
    names = _ranked(lines, ["h1", "h2"], "line-ids")
    level = stored(lines.join(names, ["h1", "h2"]).select(*DOC, "j", "rank"), "ranks-0")
    levels, size = [level], 1
    while 2 * size <= most_lines:
        further = level.select(*DOC, (F.col("j") - size).alias("j"), F.col("rank").alias("second"))
        pairs = level.withColumnRenamed("rank", "first").join(further, [*DOC, "j"])
        names = _ranked(pairs, ["first", "second"], f"pairs-{size}")
        if names.isEmpty():
            break
        level = stored(pairs.join(names, ["first", "second"]).select(*DOC, "j", "rank"), f"ranks-{2 * size}")
        levels.append(level)
        size *= 2
    return levels


def _named(passages: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Passages that may have copies, with their name and place; all levels are joined at once, by their number.

    A join for each level would make a plan that takes the driver more memory than the rows take the executors.
    """
    ranks = reduce(DataFrame.unionAll, [level.withColumn("level", F.lit(k)) for k, level in enumerate(levels)])
    head = ranks.select("level", *DOC, F.col("j").alias("a"), F.col("rank").alias("head_rank"))
    tail = ranks.select("level", *DOC, F.col("j").alias("tail"), F.col("rank").alias("tail_rank"))
    # the number of the highest bit: 2^level <= n < 2^(level + 1)
    own = passages.withColumn("level", F.length(F.bin("n")) - 1)
    own = own.withColumn("tail", F.col("a") + F.col("n") - F.expr("shiftleft(1, level)"))
    found = own.join(head, ["level", *DOC, "a"]).join(tail, ["level", *DOC, "tail"])
    # a rank means something within its level only, which the number of lines tells
    return found.select(*DOC, "from_pos", "to_pos", "n", "head_rank", "tail_rank", F.struct("id", *DOC, "a").alias("place"))


def later_copies(docs: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(d1, d2, deleted): per document the numbers of the lines in later copies of repeated passages."""
    lines = stored(sequence(docs, key, text, min_words), "lines")
    levels = suffix_ranks(lines, min_words)
    first_line = levels[0].select(*DOC, F.col("j").alias("a"))
    last_line = levels[0].select(*DOC, F.col("j").alias("b"))
    passages = (
        lines.select("id", *DOC, F.explode(F.array("onward", "back")).alias("p"))
        .filter("p IS NOT NULL")
        .select("id", *DOC, "p.*")
        .withColumn("b", F.col("a") + F.col("n") - 1)
        # most passages have a line at their ends that occurs once
        .join(first_line, [*DOC, "a"], "left_semi")
        .join(last_line, [*DOC, "b"], "left_semi")
        .dropDuplicates([*DOC, "a", "n"])
    )
    passages = stored(passages, "passages")
    named = stored(_named(passages, levels), "named")
    name = ["n", "head_rank", "tail_rank"]
    firsts = named.groupBy(*name).agg(F.min("place").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    same_doc = (F.col("place.d1") == F.col("first.d1")) & (F.col("place.d2") == F.col("first.d2"))
    overlaps = same_doc & (F.col("place.a") < F.col("first.a") + F.col("n"))
    later = named.join(firsts.drop("copies"), name).filter((F.col("place") > F.col("first")) & ~overlaps)
    deleted = later.select(*DOC, F.explode(F.sequence("from_pos", "to_pos")).alias("pos"))
    return deleted.groupBy(*DOC).agg(F.collect_set("pos").alias("deleted"))


def deduplicated(
    docs: DataFrame, key: str, text: str, min_words: int = MIN_WORDS, lines: str = "n_lines", removed: str = "n_removed"
) -> DataFrame:
    """``docs`` with the later copies cut out of ``text``, and two columns: numbers of lines, and of lines cut out."""
    rows, place = by_place(docs)
    value = F.col(place[text])
    cuts = later_copies(rows, place[key], place[text], min_words)
    marked = rows.select("*", *_doc_keys(place[key], place[text])).join(cuts, DOC, "left")
    parts = F.split(value, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("deleted"))
    # the lambda variable holds the lines, so that they are split once
    chosen = F.transform(F.array(parts), lambda held: F.transform(kept, lambda i: F.get(held, i)))[0]
    cut_text = F.when(F.col("deleted").isNotNull(), F.array_join(chosen, "\n")).otherwise(value)
    return marked.select(
        *(cut_text if c == place[text] else F.col(c) for c in place.values()),
        F.when(value.isNull(), 0).otherwise(F.size(parts)).cast("long"),
        F.when(F.col("deleted").isNull(), 0).otherwise(F.size("deleted")).cast("long"),
    ).toDF(*docs.columns, lines, removed)
