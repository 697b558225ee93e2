"""Benchmark decontamination by a distributed positional inverted index.

Postings ``(term, doc, pos)`` are stored for the terms a search asks for. A test window of consecutive words is looked
up from its rarest terms: their lists are shifted by the terms' offsets and intersected, and the starts that remain are
compared word by word with the text. Frequencies cover the whole corpus, so a window with a term that the corpus lacks
is known to be absent. Documents are known by a digest of their text, so copies are searched once.

Nulls: a null text has no words; a null ``item_id`` counts as the empty id. Repeated benchmark rows and windows that
items share are searched once. Empty tables give no hits or no rows. Other columns are ignored. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import lower_ascii, written

# Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text``: the key stands for the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.md5(text.cast("binary")).alias("key"), text.alias("text"))


def test_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item_id, phrase, words``: each ``width`` consecutive words of an item; all of a shorter one."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                         words_of(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - F.lit(width - 1), F.lit(1)))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s, F.lit(width)))).alias("words"))
    return windows.select("item_id", F.array_join("words", " ").alias("phrase"), "words").distinct()


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` occurs in all ``texts``; absent terms are not listed."""
    return (texts.select(F.explode(words_of(F.col("text"))).alias("term")).join(terms, "term")
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, key, pos`` (from 0) of every occurrence of ``terms`` in ``texts`` (``key, text``)."""
    return texts.select("key", F.posexplode(words_of(F.col("text"))).alias("pos", "term")).join(terms, "term").select(
        "term", "key", "pos")


def rarest_terms(windows: DataFrame, counts: DataFrame, take: int = 2) -> DataFrame:
    """``window, term, offset, nth``: each window's ``take`` rarest places. A window with an absent term has no row."""
    places = windows.select("window", "length", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    rarity = Window.partitionBy("window").orderBy("n", "offset")
    whole = Window.partitionBy("window")
    return (places.withColumn("nth", F.row_number().over(rarity)).withColumn("found", F.count(F.lit(1)).over(whole))
            .filter((F.col("found") == F.col("length")) & (F.col("nth") <= take))
            .select("window", "length", "term", "offset", "nth"))


def intersect(lists: DataFrame, anchors: DataFrame, take: int = 2) -> DataFrame:
    """``window, key, start`` at which all of a window's anchors stand at their offsets."""
    shifted = lists.join(anchors, "term").select(
        "window", "key", (F.col("pos") - F.col("offset")).alias("start"), "nth",
        F.least("length", F.lit(take)).alias("asked")).filter("start >= 0")
    return (shifted.groupBy("window", "key", "start", "asked")
            .agg(F.bit_or(F.expr("shiftleft(1, nth - 1)")).alias("met"))
            .filter(F.expr("met = shiftleft(1, asked) - 1")).select("window", "key", "start"))


def phrase_matches(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """``window, key, start, length``: every occurrence of ``windows`` (``window, phrase, words``) in ``texts``."""
    windows = windows.withColumn("length", F.size("words"))
    terms = written(windows.select(F.explode("words").alias("term")).distinct())
    anchors = written(rarest_terms(windows, written(term_counts(texts, terms))))
    index = written(postings(texts, written(anchors.select("term").distinct())))
    found = written(intersect(index, anchors))
    per_text = found.groupBy("key").agg(F.collect_list(F.struct("window", "start")).alias("starts"))
    needed = written(found.select("key").distinct())
    held = texts.join(needed, "key").groupBy("key").agg(F.first("text").alias("text"))
    placed = held.join(per_text, "key").select("key", words_of(F.col("text")).alias("all"), "starts").select(
        "key", F.explode(F.transform("starts", lambda s: F.struct(
            s["window"].alias("window"), s["start"].alias("start"),
            F.slice("all", s["start"] + 1, F.lit(WINDOW)).alias("seen")))).alias("at"))
    return placed.select("key", "at.window", "at.start", "at.seen").join(
        windows.select("window", "words", "length"), "window").filter(
        F.slice("seen", F.lit(1), F.col("length")) == F.col("words")).select("window", "key", "start", "length")


def covered(hits: DataFrame) -> DataFrame:
    """``key, n_hit``: words inside any of ``hits`` (``key, start, length``); overlaps count once."""
    longest = hits.groupBy("key", "start").agg(F.max("length").alias("length"))
    earlier = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    reached = F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0)))
    return (longest.withColumn("fresh", F.greatest(end - reached, F.lit(0)))
            .groupBy("key").agg(F.sum("fresh").cast("bigint").alias("n_hit")))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: ``doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated``; ``key`` as in ``keyed``."""
    texts = keyed(docs)
    named = written(test_windows(items))
    windows = written(named.select("phrase", "words").distinct().withColumn("window", F.monotonically_increasing_id()))
    hits = written(phrase_matches(texts.select("key", "text"), windows))
    met = hits.select("key", "window").distinct().join(windows.select("window", "phrase"), "window").join(
        named.select("phrase", "item_id"), "phrase").select("key", "item_id").distinct()
    listed = met.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"),
                                    F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    facts = written(covered(hits).join(listed, "key").select(
        "key", "n_hit", "n_items", F.sha2(F.col("ids").cast("binary"), 256).alias("items_sha256")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return texts.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words")).join(
        facts, "key", "left").select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


def proximity_matches(lists: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """``left_term, right_term, key, left_pos, right_pos`` of ``pairs`` at most ``within`` words apart, in any order.

    Positions meet in strips of ``within + 1`` words, each with its neighbours, so a frequent pair costs what it
    yields and no list is paired whole with another.
    """
    strip = F.floor(F.col("pos") / (within + 1))
    left = lists.join(pairs, lists["term"] == pairs["left_term"]).select(
        "left_term", "right_term", "key", F.col("pos").alias("left_pos"),
        F.explode(F.array(strip - 1, strip, strip + 1)).alias("strip"))
    right = lists.select(F.col("term").alias("right_term"), "key", F.col("pos").alias("right_pos"), strip.alias("strip"))
    return left.join(right, ["right_term", "key", "strip"]).filter(
        (F.abs(F.col("left_pos") - F.col("right_pos")) <= within)
        & ~((F.col("left_term") == F.col("right_term")) & (F.col("left_pos") >= F.col("right_pos")))).select(
        "left_term", "right_term", "key", "left_pos", "right_pos")
