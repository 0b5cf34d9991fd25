"""Benchmark decontamination over a positional inverted index.

Words are maximal runs of letters, digits and non-ASCII characters; A-Z count
as a-z.  A benchmark item's windows are its runs of ``size`` consecutive words
(an item with fewer words is one window).  Every window is looked for from its
rarest term: corpus counts of the benchmark's terms decide which.  The index
stores one posting for each occurrence of such a term: document, position and
the terms at the neighbouring positions, so the lists of the window's other
terms, adjusted by their offsets, are intersected with it without reading the
texts again.  A window that matches at all offsets is an exact phrase; one with
enough of its terms nearby is a proximity match.

Frequent terms are posted only if a window holds nothing rarer; counts are
partial before they move, and the joins on terms are equi-joins that adaptive
execution can split.

Defined results: a null or empty text has no words and no hits; an item without
words has no windows; repeated documents and repeated items are each answered;
an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallylens.llm.tables import text_key, unused
from rallylens.storage import landed

#: What separates words; capitals stay in and are folded later.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def raw_words(text: str) -> Column:
    """The words of a whole text; the ends may hold an empty string."""
    return F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS, -1)


def folded(word: Column) -> Column:
    return F.translate(word, CAPITALS, CAPITALS.lower())


def word_count(words: Column) -> Column:
    """Number of non-empty entries of ``raw_words``."""
    n = F.size(words)
    ends = (F.element_at(words, 1) == "").cast("long") + ((n > 1) & (F.element_at(words, -1) == "")).cast("long")
    return n.cast("long") - ends


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """item_id, window (first word's number), words: every window of every item."""
    words = F.filter(F.transform(raw_words("text"), folded), lambda w: w != "")
    found = items.select("item_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = found.select("item_id", "w", F.explode(starts).alias("window"))
    return each.select("item_id", "window", F.slice("w", F.col("window") + 1, size).alias("words"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms (column term, lower-cased) occurs in the corpus."""
    said = docs.select(F.explode(raw_words("text")).alias("word")).select(F.lower("word").alias("term"))
    return said.join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def anchors(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The windows with their rarest term, its offset, and the order of the others."""
    told = found.select("item_id", "window", "words", F.posexplode("words").alias("offset", "word"))
    told = told.withColumn("term", F.lower("word")).join(counts, "term", "left")
    key = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")
    ranked = told.groupBy("item_id", "window", "words").agg(F.sort_array(F.collect_list(key)).alias("rare"))
    return ranked.select(
        "item_id", "window", "words", F.col("rare")[0]["term"].alias("term"), F.col("rare")[0]["offset"].alias("offset"),
        F.transform("rare", lambda r: r["offset"]).alias("order"), F.col("rare")[0]["n"].alias("n"),
    )


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The index: doc_id, text_key, term, position, and the terms ``reach`` before and after.

    ``around`` starts at position ``position - before``.
    """
    words = docs.select("doc_id", text_key().alias("text_key"), raw_words("text").alias("w"))
    each = words.select("doc_id", "text_key", "w", F.posexplode("w").alias("position", "word"))
    each = each.withColumn("term", F.lower("word")).join(terms, "term")
    before = F.least(F.col("position"), F.lit(reach))
    return each.select(
        "doc_id", "text_key", "term", "position", before.alias("before"),
        F.slice("w", F.col("position") - before + 1, before + reach + 1).alias("around"),
    )


def matches(docs: DataFrame, items: DataFrame, size: int = 10, proximity: int | None = None) -> DataFrame:
    """doc_id, text_key, item_id, window, start, length, same: windows found in documents.

    ``start`` counts entries of ``raw_words``.  ``same`` is the number of offsets
    at which the terms agree; without ``proximity`` only exact phrases are
    returned, with it also windows of which that many terms lie nearby.
    """
    sought = landed(windows(items, size), "windows")
    terms = landed(sought.select(F.explode("words").alias("w")).select(F.lower("w").alias("term")).distinct(), "terms")
    counts = landed(term_counts(docs, terms), "term_counts")
    seek = landed(anchors(sought, counts).where(F.col("n") > 0), "anchors")
    rare = landed(seek.select("term").distinct(), "anchor_terms")
    index = landed(postings(docs, rare, size - 1), "postings")
    met = index.join(seek, "term")
    first = F.col("before") - F.col("offset")  # of the window within ``around``, from 0
    inside = (first >= 0) & (first + F.size("words") <= F.size("around"))
    # Offset-adjusted lists, rarest terms first: the first that lacks the position ends it.
    agrees = F.forall("order", lambda o: F.lower(F.get(F.col("around"), first + o)) == F.lower(F.get(F.col("words"), o)))
    there = F.transform(F.slice("around", F.greatest(first, F.lit(0)) + 1, F.size("words")), folded)
    exact = F.coalesce(inside & agrees, F.lit(False)) & (there == F.col("words"))
    nearby = F.size(F.array_intersect(F.transform("around", folded), F.col("words")))
    kept = met.where(exact if proximity is None else exact | (nearby >= proximity))
    return kept.select(
        "doc_id", "text_key", "item_id", "window", (F.col("position") - F.col("offset")).alias("start"),
        F.size("words").alias("length"), F.when(exact, F.size("words")).otherwise(nearby).alias("same"),
    )


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted strings) of every document."""
    hits = matches(docs, items, size)
    words = hits.select("doc_id", "text_key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
    covered = words.distinct().groupBy("doc_id", "text_key").agg(F.count("*").alias("n_hit"))
    named = hits.select("doc_id", "text_key", "item_id").distinct().groupBy("doc_id", "text_key").agg(
        F.count("item_id").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids")
    )
    both = landed(covered.join(named, covered["doc_id"].eqNullSafe(named["doc_id"]) & (covered["text_key"] == named["text_key"])).select(
        covered["doc_id"].alias("_id"), covered["text_key"].alias("_key"), "n_hit", "n_items", "item_ids"), "hits")
    every = docs.select("doc_id", text_key().alias("text_key"), word_count(raw_words("text")).alias("n_words"))
    told = every.join(both, every["doc_id"].eqNullSafe(both["_id"]) & (every["text_key"] == both["_key"]), "left")
    return told.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any benchmark window."""
    bad = landed(matches(docs, items, size).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    key = unused(docs, "text_key")
    marked = docs.withColumn(key, text_key())
    left = marked.join(bad, marked["doc_id"].eqNullSafe(bad["_id"]) & (marked[key] == bad["_key"]), "left_anti")
    return left.select(*docs.columns)
