"""Spelling variants: words one edit apart, found through a reduced alphabet.

Every letter of a word is hashed to one of a few symbols, which turns the vocabulary into far fewer reduced words. For
each distinct reduced word its full neighbourhood of one edit (itself, and every deletion, replacement and insertion
over the symbols) is generated and joined with the reduced vocabulary. One edit of a word is at most one edit of its
reduced word, so no pair is missed; the candidates are then verified on the original words. A word's form is its most
frequent near word, if that is frequent enough, and forms are followed to the root.

Work grows with the vocabulary, not with the texts, once words are counted; counts are added up before the shuffle, so a
frequent word is one row per task. No join is left to a guess of sizes: Spark takes an array that is exploded for one row,
and would send all neighbourhoods through the driver. More ``symbols`` make more neighbours of a reduced word and fewer
candidates of a word: about 100 and 60 at six symbols and 300,000 words. Buckets of reduced words are never capped. Forms at least double in
frequency, so chains are short and are followed by doubling steps.

Defined cases: texts that are null or hold no letter give no word. A null key writes as an empty one. Repeated rows count
again. Ties of frequency go to the word that is smaller in code-point order. Characters count as code points. An empty
table gives no words. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.session import shuffle_width, stored

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
SYMBOLS = 6


def counted_words(
    docs: DataFrame, key: str, text: str, least_points: int = 5, least_count: int = 3, slip_every: int = 97
) -> DataFrame:
    """(word, n): the words of all texts, where one in ``slip_every`` has lost a code point by the hash of key and word."""
    lowered = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"({LETTERS})"), F.lit(1))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    slipped = F.when(F.pmod("h", F.lit(slip_every)) == 0, cut).otherwise(F.col("run"))
    words = hashed.select(slipped.alias("word")).filter(F.char_length("word") >= least_points)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def reduced(word: str, symbols: int) -> Column:
    """The word with each code point hashed to one of the first ``symbols`` small letters."""
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.char(F.ascii(c) % symbols + ord("a"))), "")


def neighbourhood(word: str, symbols: int) -> Column:
    """A reduced word and all that one edit makes of it, without repeats."""
    text = F.col(word)
    size = F.char_length(text)
    alphabet = F.array(*[F.lit(chr(ord("a") + i)) for i in range(symbols)])

    def head(i: Column) -> Column:
        return F.substring(text, F.lit(1), i)

    def tail(i: Column) -> Column:
        return F.substring(text, i + 1, size)

    def at_all(last: Column, edited) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), last), edited))

    replaced = at_all(size - 1, lambda i: F.transform(alphabet, lambda s: F.concat(head(i), s, tail(i + 1))))
    inserted = at_all(size, lambda i: F.transform(alphabet, lambda s: F.concat(head(i), s, tail(i))))
    deleted = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.concat(head(i), tail(i + 1)))
    return F.array_distinct(F.concat(F.array(text), replaced, inserted, deleted))


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, other, other_n): every two words of ``words`` (word, n, reduced) that one edit parts, both ways."""
    # few bytes, much work: these are dealt to a fixed number of tasks, which adaptive execution does not merge
    width = max(shuffle_width(words.sparkSession), words.sparkSession.sparkContext.defaultParallelism)
    distinct = words.select("reduced").repartition(width, "reduced").distinct()
    reach = distinct.select("reduced", F.explode(neighbourhood("reduced", symbols)).alias("near")).repartition(width, "near")
    others = words.select(F.col("reduced").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # a broadcast that is planned by the size before the explode is not undone by adaptive execution
    met = reach.join(others.hint("merge"), "near").drop("near").repartition(width, "reduced")
    candidates = words.select("reduced", "word").join(met.hint("merge"), "reduced")
    return candidates.filter(F.levenshtein("word", "other", 1) == 1).select("word", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of ``forms`` (word, form); forms must not go round in a circle."""
    chains = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(
            chains.join(onward.hint("merge"), "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        chains = after.drop("moved")
        if after.filter("moved").isEmpty():
            return chains


def variants(words: DataFrame, times: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n; each word once).

    The form is the near word of largest n, where that is at least ``times`` (2 or more) the word's own n.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than the word")
    known = stored(words.select("word", "n", reduced("word", symbols).alias("reduced")), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("falling"), F.col("other").alias("form")))
    near = near_pairs(known, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.falling") >= times * F.col("n")
    judged = stored(
        known.join(near.hint("merge"), "word", "left").select(
            "word",
            F.when(frequent, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, -F.col("best.falling")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
