"""The registered queries: one per operator family, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallylens.functions import text as tx
from rallylens.learn import bayes, metrics, response, scorer, topics
from rallylens.operators import actors, corrections, places, rows, sampling, summaries
from rallylens.operators import tokens as tok
from rallylens.operators.lookup import computed_per_value, lookup_join
from rallylens.rules import decisions, index, keywords, packs
from rallylens.sources import files
from rallylens.sources.incidents import COUNTRIES, incidents, reported, table
from rallylens.storage import passing_tables, scratch_path, settle, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ID = "event_id_cnty"
RULES = packs.SMALL_PACK
SAMPLE_SEED, SPLIT_SEED = 123, 42


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _presence(spark: SparkSession, sf: str) -> DataFrame:
    events = reported(spark, sf)
    return decisions.police_presence(events, counted=events)


def _documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(*columns))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return actors.classify_events(reported(spark, sf), RULES)


def _classified_present(spark: SparkSession, sf: str) -> DataFrame:
    events = reported(spark, sf)
    return decisions.police_presence(actors.classify_events(events, RULES), counted=events)


# --- sources and sinks -----------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    events = incidents(spark, sf)
    path = scratch_path(spark, "csv")
    files.write_table(events, path, ["country"])
    back = files.read_table(spark, path).select(*events.columns)
    return back.withColumn("country_slug", tx.slug("country"))


@query
def csv_keep_empty(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_table(incidents(spark, sf), path)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in incidents(spark, sf).schema)
    back = files.read_table_keep_empty(spark, path, columns)
    return back.select(ID, "admin1", "assoc_actor_1", "interaction", "fatalities")


@query
def paged_landing_union(spark, sf):
    path = scratch_path(spark, "landing")
    files.land_pages(incidents(spark, sf), path)
    return summaries.country_year_summary(files.read_pages(spark, path))


@query
def landed_responses(spark, sf):
    """Pages as a service answers them, some failed, and what became of them."""
    events = incidents(spark, sf).withColumn("page", F.substring(ID, 4, 20).cast("long") % 4)
    inner = [c for c in events.columns if c not in ("country", "year", "page")]
    full = events.groupBy("country", "year", "page").agg(F.collect_list(F.struct(*inner)).alias("data"))
    last = events.select("country", "year").distinct().withColumns({"page": F.lit(99), "data": F.array().cast(full.schema["data"].dataType)})
    status = F.when((F.col("page") != 99) & ((F.col("year") + F.col("page")) % 5 == 0), 500).otherwise(200)
    pages = full.unionByName(last).select("country", "year", status.alias("status"), "data")
    path = scratch_path(spark, "responses")
    pages.write.partitionBy("country", "year").json(path, ignoreNullFields=False)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*inner).schema)
    return files.page_report(files.response_pages(spark, path, schema), ["country", "year"], 100)


@query
def combine_country_tables(spark, sf):
    path = scratch_path(spark, "countries")
    events = incidents(spark, sf)
    files.write_table(events, path, ["country"])
    order = [c for c in events.columns if c != "country"]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*order).schema)
    tables = {
        c: files.read_table(spark, f"{path}/country={c}", columns) for c in COUNTRIES
    }
    return summaries.frequency(rows.stack_tagged(tables, "country_source"), "country_source", "sub_event_type")


@query
def hand_coding_sheet(spark, sf):
    present = _presence(spark, sf).where("police_presence")
    picked = sampling.sample_fraction(present, 0.1, ID, SAMPLE_SEED)
    return files.coding_sheet(picked)


# --- filters ---------------------------------------------------------------


@query
def filter_country(spark, sf):
    events = incidents(spark, sf)
    return events.where(F.col("country") == "France").select(ID, "event_date", "country", "notes")


@query
def filter_not_in_keep_null(spark, sf):
    out = rows.without_values(incidents(spark, sf), "admin1", ["Northern Ireland", "Scotland", "Wales"])
    return out.select(ID, "admin1")


@query
def filter_regex(spark, sf):
    events = rows.with_text(reported(spark, sf), "assoc_actor_1")
    name = F.lower(F.col("assoc_actor_1"))
    return events.where(tx.found(name, "france|labour") & ~tx.found(name, "liberal")).select(
        ID, "assoc_actor_1"
    )


# --- actors ----------------------------------------------------------------


@query
def actor_dictionary(spark, sf):
    return actors.actor_dictionary(reported(spark, sf))


@query
def actor_labels(spark, sf):
    return actors.label_dictionary(actors.actor_dictionary(reported(spark, sf)), RULES)


@query
def stage_coverage(spark, sf):
    return actors.stage_coverage(actors.actor_dictionary(reported(spark, sf)), RULES)


@query
def party_family_lean(spark, sf):
    leans = spark.createDataFrame(list(packs.PARTY_FAMILIES), "family int, family_name string, lean string")
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 14).cast("int").alias("family"))
    return actors.lean_of_family(parts, "family", leans).select("p_partkey", "family", "lean")


@query
def field_flags(spark, sf):
    flagged = actors.map_partisanship(reported(spark, sf), RULES)
    flags = [f"{p}_{c}" for p in actors.ACTOR_FIELDS.values() for c in actors.FLAGS]
    return flagged.select(ID, *flags)


@query
def field_flags_inline(spark, sf):
    flagged = actors.inline_field_flags(reported(spark, sf), RULES)
    flags = [f"{p}_{c}" for p in actors.ACTOR_FIELDS.values() for c in actors.FLAGS]
    return flagged.select(ID, *flags)


@query
def dictionary_lookup(spark, sf):
    events = reported(spark, sf)
    dictionary = actors.label_dictionary(actors.actor_dictionary(events), RULES)
    flagged = actors.map_partisanship(events, dictionary=dictionary)
    return flagged.select(ID, *[f"{p}_{c}" for p in actors.ACTOR_FIELDS.values() for c in actors.FLAGS])


@query
def field_flags_shuffled(spark, sf):
    """As field_flags, by the join for tables too large to broadcast."""
    flagged = actors.map_partisanship(reported(spark, sf), RULES, limit=0)
    return flagged.select(ID, *[f"{p}_{c}" for p in actors.ACTOR_FIELDS.values() for c in actors.FLAGS])


@query
def event_partisan_type(spark, sf):
    return _classified(spark, sf).select(
        ID, "event_left", "event_right", "event_centre", "event_partisan_type"
    )


@query
def partisan_share(spark, sf):
    shares = summaries.share(_classified(spark, sf), "event_partisan_type")
    return shares.orderBy(F.desc("n"), "event_partisan_type")


@query
def partisan_freq_by_country(spark, sf):
    return summaries.frequency(_classified(spark, sf), "country", "event_partisan_type")


@query
def type_by_country_pack(spark, sf):
    """One run for all countries, each with its own pack from a rule table."""
    path = scratch_path(spark, "rules")
    written = spark.createDataFrame(packs.pack_rows(packs.COUNTRY_PACKS), packs.PACK_SCHEMA)
    written.write.csv(path, header=True, nullValue="NA", escape='"', quote='"')
    typed = actors.classify_events(reported(spark, sf), packs.read_label_packs(spark, path), scope="country")
    return typed.select(ID, "country", "event_partisan_type")


@query
def stacked_countries(spark, sf):
    """Labelled tables of the countries stacked again, without the unknown flags."""
    typed = _classified(spark, sf)
    stacked = rows.stack_tables([typed.where(F.col("country") == c) for c in COUNTRIES])
    kept = actors.drop_suffix(stacked, "_unknown")
    return kept.select(ID, *[c for c in kept.columns if c.split("_")[-1] in packs.LABELS])


@query
def partisan_share_by_country(spark, sf):
    return summaries.share_within(_classified(spark, sf), ["country"], "event_partisan_type")


@query
def unclassified_actor_topk(spark, sf):
    unknown = _classified(spark, sf).where(F.col("event_partisan_type") == "unknown")
    long = summaries.stacked(unknown, list(actors.ACTOR_FIELDS), "actor_field", "actor")
    return summaries.top_counts(long, ["actor"], 50)


@query
def conflict_examples(spark, sf):
    conflicts = _classified(spark, sf).where(F.col("event_partisan_type") == "left_vs_right")
    kept = conflicts.select(
        ID, "event_date", "actor1", "actor2", "event_type", "sub_event_type", "event_partisan_type"
    )
    return summaries.first_rows(kept, ["event_date", ID], 20)


# --- police presence -------------------------------------------------------


@query
def presence_rule(spark, sf):
    return _presence(spark, sf).select(ID, "presence_step", "police_presence")


@query
def presence_step_counts(spark, sf):
    return summaries.frequency(_presence(spark, sf), "presence_step", "police_presence")


@query
def presence_on_documents(spark, sf):
    documents = _documents(spark, sf, "doc_id", "text", "source")
    return decisions.decide(documents, "text", packs.PROSE_STEPS, "presence").select("doc_id", "step", "presence")


@query
def presence_by_country(spark, sf):
    return summaries.rate_by(_presence(spark, sf), "police_presence", "country")


@query
def presence_by_year(spark, sf):
    return summaries.rate_by_year(_presence(spark, sf), "police_presence")


@query
def presence_type_topk(spark, sf):
    present = _presence(spark, sf).where("police_presence")
    return summaries.top_counts(present, ["event_type", "sub_event_type"], 10)


@query
def presence_crosstab(spark, sf):
    return summaries.crosstab(
        _presence(spark, sf), "interaction", "police_presence", [False, True], ["absent", "present"]
    )


@query
def presence_pattern_hits(spark, sf):
    """How many notes each pattern of the presence steps is found in; equal notes are searched once."""
    texts = reported(spark, sf).groupBy("notes").agg(F.count(F.lit(1)).alias("copies"))
    notes = rows.computed_once(texts, {"low": F.lower("notes")})
    each = [(s.name, p) for s in packs.PRESENCE_STEPS for p in s.patterns]
    found = [F.when(tx.found("low", p), F.col("copies")).otherwise(0) for _, p in each]
    hits = notes.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f"p{i}") for i, f in enumerate(found)])
    named = [F.struct(F.lit(s).alias("step"), F.lit(p).alias("pattern"), F.col(f"p{i}").alias("n")) for i, (s, p) in enumerate(each)]
    return hits.select(F.inline(F.array(*named)))


@query
def keyword_response(spark, sf):
    return reported(spark, sf).select(ID, keywords.response_flag("notes").alias("response"))


# --- samples ---------------------------------------------------------------


@query
def validation_sample(spark, sf):
    present = _presence(spark, sf).where("police_presence")
    picked = sampling.sample_rows(present, 20, ID, SAMPLE_SEED)
    return picked.select(ID, "country", "event_date", "interaction", "notes")


@query
def large_sample(spark, sf):
    """A sample of two in three events, drawn by the same cut as a small one."""
    events = incidents(spark, sf).select(ID, "country")
    return sampling.sample_rows(events, 2 * events.count() // 3, ID, SAMPLE_SEED)


@query
def sample_per_group(spark, sf):
    picked = sampling.sample_per_group(_ideology(spark, sf), "final_ideology", 3, ID, SAMPLE_SEED)
    return picked.select(ID, "event_date", "assoc_actor_1", "assoc_actor_2", "notes", "final_ideology")


@query
def train_test_split(spark, sf):
    return sampling.train_test_flag(table(spark, sf, "labels"), 0.2, "doc_id", SPLIT_SEED).select(
        "doc_id", "is_test"
    )


@query
def numbered_rows(spark, sf):
    return sampling.dense_id(incidents(spark, sf).select(ID), ID)


# --- summaries -------------------------------------------------------------


@query
def yearly_summary(spark, sf):
    return summaries.yearly_summary(incidents(spark, sf))


@query
def country_year_summary(spark, sf):
    return summaries.country_year_summary(incidents(spark, sf))


@query
def global_stats(spark, sf):
    return summaries.global_stats(incidents(spark, sf))


@query
def missing_counts(spark, sf):
    return summaries.missing_counts(incidents(spark, sf), "assoc_actor_1", "assoc_actor_2", "notes")


@query
def text_dates(spark, sf):
    """Dates written day/month/year, parsed before min and max are taken."""
    written = incidents(spark, sf).select(F.date_format("event_date", "dd/MM/yyyy").alias("written"))
    dated = written.withColumn("event_date", tx.day_month_year("written"))
    return dated.groupBy(F.year("event_date").alias("year")).agg(
        F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), F.count(F.lit(1)).alias("n")
    )


# --- keyword ideology ------------------------------------------------------


def _named(spark, sf):
    names = {
        "actor1_std": tx.standardise_actor("assoc_actor_1"),
        "actor2_std": tx.standardise_actor("assoc_actor_2"),
    }
    return rows.computed_once(reported(spark, sf), names)


def _sides(spark, sf):
    """Events with the ideology of their two associated actors."""
    left, right = packs.LEFT_KEYS, packs.RIGHT_KEYS
    return _named(spark, sf).withColumns(
        {
            "actor1_ideology": keywords.actor_ideology("actor1_std", left, right),
            "actor2_ideology": keywords.actor_ideology("actor2_std", left, right),
        }
    )


def _ideology(spark, sf):
    """Events with all labels; notes that many events share are searched once."""
    keys = {"left": packs.LEFT_KEYS, "right": packs.RIGHT_KEYS}
    hits = tx.let(tx.clean_note("notes"), lambda t: F.struct(*[keywords.keyword_hits(t, k).alias(s) for s, k in keys.items()]))
    events = computed_per_value(_sides(spark, sf), "notes", {"hits": hits}, reported(spark, sf))
    events = events.withColumns({f"{s}_hits": F.col("hits")[s] for s in keys}).drop("hits")
    events = events.withColumn("context_ideology", keywords.larger_side("left_hits", "right_hits"))
    return events.withColumn(
        "final_ideology",
        keywords.first_classified("actor1_ideology", "actor2_ideology", "context_ideology"),
    )


@query
def standardise_actors(spark, sf):
    return _named(spark, sf).select(ID, "actor1_std", "actor2_std")


@query
def actor_ideology(spark, sf):
    return _sides(spark, sf).select(ID, "actor1_ideology", "actor2_ideology")


@query
def unclassified_events(spark, sf):
    """Events whose two associated actors are both without an ideology."""
    left, right = packs.LEFT_KEYS, packs.RIGHT_KEYS
    named = _named(spark, sf)
    no_side = [
        keywords.actor_ideology(c, left, right) == keywords.UNCLASSIFIED for c in ("actor1_std", "actor2_std")
    ]
    return named.where(no_side[0] & no_side[1]).select(ID, "assoc_actor_1", "assoc_actor_2")


@query
def context_ideology(spark, sf):
    return _ideology(spark, sf).select(ID, "left_hits", "right_hits", "context_ideology")


@query
def final_ideology(spark, sf):
    return _ideology(spark, sf).select(ID, "final_ideology")


@query
def ideology_share(spark, sf):
    return summaries.share(_ideology(spark, sf), "final_ideology", percent_name="percentage")


@query
def ideology_by_year(spark, sf):
    return summaries.label_by_year(_ideology(spark, sf), "final_ideology")


# --- text ------------------------------------------------------------------


@query
def clean_notes(spark, sf):
    return _documents(spark, sf, "doc_id", "text").select("doc_id", tx.clean_note("text").alias("text_clean"))


@query
def note_tokens(spark, sf):
    # Only ids are shuffled to number the rows, and only labelled texts are read on.
    numbered = sampling.dense_id(table(spark, sf, "documents").select("doc_id"), "doc_id")
    wanted = numbered.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    labelled = lookup_join(_documents(spark, sf, "doc_id", "text"), settle(wanted), "doc_id", "inner")
    return tok.tokens(labelled, "text", ["row_id", "doc_id"])


@query
def stop_table_tokens(spark, sf):
    """Words left by a stop table made from the texts, joined by shuffle."""
    texts = _documents(spark, sf, "doc_id", "text")
    common = settle(tok.common_words(tok.tokens(texts, "text", ["doc_id"], ()), "doc_id", 0.1))
    words = tok.tokens(texts, "text", [], common, limit=0)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def doc_term_counts(spark, sf):
    words = tok.tokens(_documents(spark, sf, "doc_id", "text"), "text", ["doc_id"])
    return tok.term_counts(words, "doc_id")


@query
def top_terms_per_group(spark, sf):
    words = tok.tokens(_documents(spark, sf, "lang", "text"), "text", ["lang"])
    return summaries.top_per_group(tok.term_counts(words, "lang"), ["lang"], "n", 15)


@query
def stem_vocabulary(spark, sf):
    return tok.stem_vocabulary(tok.tokens(_documents(spark, sf, "text"), "text", []))


@query
def stemmed_term_counts(spark, sf):
    words = tok.tokens(_documents(spark, sf, "doc_id", "text"), "text", ["doc_id"])
    return tok.stemmed_counts(words, ["doc_id"])


# --- naive Bayes and metrics -----------------------------------------------


def _split_words(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    marked = sampling.train_test_flag(labels, 0.25, "doc_id", SPLIT_SEED)
    documents = lookup_join(_documents(spark, sf, "doc_id", "text"), settle(marked), "doc_id", "inner")
    return marked, tok.tokens(documents, "text", ["doc_id", "quality", "is_test"])


def _predicted(spark, sf):
    marked, words = _split_words(spark, sf)
    model = bayes.train(words.where(~F.col("is_test")), "word", "quality")
    test = marked.where("is_test").select("doc_id", "quality")
    return bayes.predict(words.where("is_test"), model, test, "doc_id")


@query
def naive_bayes_predict(spark, sf):
    return _predicted(spark, sf)


@query
def naive_bayes_train_stems(spark, sf):
    """Training words are stemmed, test words are not (as published)."""
    marked, words = _split_words(spark, sf)
    train = tok.stemmed_counts(words.where(~F.col("is_test")), ["quality"], stemmed="word_stem")
    model = bayes.train(train.withColumnRenamed("word_stem", "word"), "word", "quality", n="n")
    test = marked.where("is_test").select("doc_id", "quality")
    return bayes.predict(words.where("is_test"), model, test, "doc_id")


@query
def vocabulary_match(spark, sf):
    _, words = _split_words(spark, sf)
    vocabulary = settle(words.where(~F.col("is_test")).select("word").distinct())
    known = bayes.match_vocabulary(words.where("is_test"), vocabulary)
    return known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("known_words"))


@query
def confusion_counts(spark, sf):
    return metrics.confusion_counts(_predicted(spark, sf), "quality", "predicted")


@query
def confusion_stats(spark, sf):
    return metrics.confusion_stats(_predicted(spark, sf), "quality", "predicted")


@query
def label_prep(spark, sf):
    sheet = table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 0, "").otherwise("1").alias("quality"),
        F.when(F.col("toxic") == 1, "1").alias("toxic"),
    )
    # Texts of labelled rows alone, found by their few ids; then the sheet keeps every row.
    wanted = table(spark, sf, "labels").select("doc_id").distinct()
    texts = lookup_join(table(spark, sf, "documents").select("doc_id", "text"), wanted, "doc_id", "left_semi")
    noted = sheet.join(texts, "doc_id", "left")
    ready = scorer.prepare_labels(noted, "text", ["quality", "toxic"])
    return ready.select(
        "doc_id", "text", "quality", "toxic",
        F.col("labels")[0].alias("label_0"), F.col("labels")[1].alias("label_1"),
    )


@query
def label_totals(spark, sf):
    return summaries.label_totals(table(spark, sf, "labels"), ["quality", "toxic"])


def _derived_scores(spark, sf):
    return table(spark, sf, "labels").withColumns(
        {
            "quality_score": tx.logistic((F.col("doc_id") % 7 - 2).cast("double")),
            "toxic_score": tx.logistic((F.col("doc_id") % 5 - 3).cast("double")),
        }
    )


@query
def score_summary(spark, sf):
    return summaries.score_summary(_derived_scores(spark, sf), ["quality_score", "toxic_score"])


@query
def multilabel_metrics(spark, sf):
    return metrics.multilabel_metrics(
        _derived_scores(spark, sf), ["quality", "toxic"], ["quality_score", "toxic_score"]
    )


@query
def severity_scores(spark, sf):
    labels = ["quality", "toxic"]
    documents = _documents(spark, sf, "doc_id", "text")
    coded = lookup_join(documents, table(spark, sf, "labels"), "doc_id", "inner")
    path = scratch_path(spark, "severity-model")
    scorer.save_model(scorer.fit_severity(coded, "text", labels), path)
    scored = scorer.score_severity(documents, scorer.load_model(path), "text", labels)
    return scored.select("doc_id", "quality_score", "toxic_score")


@query
def severity_invariants(spark, sf):
    """Every document scored, scores from 0 to 1, blank texts 0."""
    scores = severity_scores(spark, sf).join(table(spark, sf, "documents").select("doc_id", tx.is_blank("text").alias("blank")), "doc_id")
    kept = F.col("quality_score").between(0, 1) & F.col("toxic_score").between(0, 1)
    zero = (F.col("quality_score") == 0) & (F.col("toxic_score") == 0)
    return scores.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(kept).alias("in_range"),
        F.count_if("blank").alias("blank"), F.count_if(F.col("blank") & zero).alias("blank_zero"),
    )


def _hits_scorer(texts: pd.Series) -> pd.DataFrame:
    lowered = texts.str.lower()
    return pd.DataFrame(
        {
            "coercion": lowered.str.count("tear gas|cordon") / 2.0,
            "arrest": lowered.str.count("arrest") / 2.0,
            "brutality": lowered.str.count("brutal") / 2.0,
        }
    )


@query
def batch_scores(spark, sf):
    events = reported(spark, sf).select(ID, "notes")
    return scorer.score_batches(events, "notes", _hits_scorer, scorer.SEVERITY_LABELS)


# --- topics ----------------------------------------------------------------


def _topic_model(spark, sf):
    """Topics of the notes of events whose two associated actors have no side."""
    left, right = packs.LEFT_KEYS, packs.RIGHT_KEYS
    sides = {f"{c}_side": keywords.actor_ideology(c, left, right) for c in ("actor1_std", "actor2_std")}
    placed = rows.computed_once(_named(spark, sf), sides)
    unplaced = placed.where(" AND ".join(f"{c} = '{keywords.UNCLASSIFIED}'" for c in sides))
    with passing_tables(spark) as passing:
        members, texts = topics.by_text(unplaced, ID, "notes")
        by = [topics.STANDS, topics.PIECE]
        counts = tok.stemmed_counts(tok.tokens(texts, "notes", by), by, together=True)
        return topics.fit_topics(counts, ID, members=members, passing=passing)


@query
def topic_dominant(spark, sf):
    return _topic_model(spark, sf).dominant()


@query
def topic_terms(spark, sf):
    return _topic_model(spark, sf).top_terms()


@query
def topic_invariants(spark, sf):
    """Every document with words has shares that add up to 1; every topic has its terms; the bound never falls."""
    model = _topic_model(spark, sf)
    bounds = model.fitted.bounds
    rising = all(b >= a - 1e-5 * abs(a) for a, b in zip(bounds, bounds[1:]))
    sums = model.topic_shares().groupBy(ID).agg(F.sum("gamma").alias("s"), F.count(F.lit(1)).alias("n"))
    shares = sums.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.abs(F.col("s") - 1) < 1e-6).alias("whole"),
        F.max("n").alias("topics"),
    )
    listed = model.top_terms().groupBy("topic").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") >= 15).alias("with_terms"))
    return shares.withColumns({"with_terms": listed.scalar(), "rising": F.lit(rising), "several_passes": F.lit(len(bounds) > 2)})


# --- place, time, models ---------------------------------------------------


@query
def grid_month_rate(spark, sf):
    return response.grid_month_rate(_presence(spark, sf), "police_presence")


@query
def presence_spatial_lag(spark, sf):
    cells = response.spatial_lag(settle(response.cell_rates(_presence(spark, sf), "police_presence")))
    return cells.select("cell_lat", "cell_lon", "events", "flagged", "neighbours", F.round("lag", 9).alias("lag"))


@query
def presence_morans_i(spark, sf):
    told = response.morans_i(settle(response.cell_rates(_presence(spark, sf), "police_presence")))
    return told.select("cells", "pairs", *[F.round(c, 6).alias(c) for c in ("morans_i", "expected", "z_score")])


@query
def response_on_grid(spark, sf):
    """Presence on cell and month, fitted on the grouped rows."""
    cells = _presence(spark, sf).select(
        (F.floor("latitude") - 40).cast("double").alias("cell_lat"),
        (F.floor("longitude") + 5).cast("double").alias("cell_lon"),
        F.month("event_date").cast("double").alias("month"),
        F.col("police_presence").cast("double").alias("present"),
    )
    features = ["cell_lat", "cell_lon", "month"]
    grouped = settle(response.grouped_counts(cells, features, "present"))
    model, _ = response.fit_binary(grouped, features, "y", weight="w")
    return response.coefficient_table(spark, features, model)


@query
def nearest_site_distance(spark, sf):
    sites = table(spark, sf, "customer").select(
        (36 + F.col("c_custkey") % 499 / 16.0).cast("double").alias("latitude"),
        (F.col("c_custkey") % 1009 / 16.0 - 30).cast("double").alias("longitude"),
    )
    placed = places.nearest_site_distance(incidents(spark, sf), sites)
    return placed.select(ID, F.round("distance_km", 3).alias("distance_km"))


@query
def nearest_road_distance(spark, sf):
    """Segments between places made from the customers' keys, some of length zero, some across half a country."""
    k = F.col("c_custkey")
    lat, lon = 36 + k % 499 / 16.0, k % 1009 / 16.0 - 30
    roads = table(spark, sf, "customer").select(
        lat.cast("double").alias("lat1"), lon.cast("double").alias("lon1"),
        (lat + (k % 7 - 3) / 8.0).cast("double").alias("lat2"), (lon + (k % 11 - 5) / 4.0).cast("double").alias("lon2"),
    )
    placed = places.nearest_road_distance(incidents(spark, sf), roads)
    return placed.select(ID, F.round("distance_km", 3).alias("distance_km"))


@query
def region_class_join(spark, sf):
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    regions = nations.select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.when(F.col("r_name").isin("EUROPE", "AMERICA"), "urban").otherwise("rural").alias("region_class"),
    )
    placed = places.region_class(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), regions, "c_nationkey")
    return summaries.frequency(placed, "region_class")


def _design(spark, sf):
    """Presence, event flags and country indicators, with numeric types."""
    events = _classified_present(spark, sf)
    flags = {f"event_{c}": F.col(f"event_{c}").cast("double") for c in packs.LABELS}
    indicators = response.indicator_columns("country", COUNTRIES)
    features = [*flags, *indicators]
    return events.withColumns({**flags, **indicators}), features


@query
def presence_logit_fe(spark, sf):
    design, features = _design(spark, sf)
    grouped = settle(response.grouped_counts(design, features, "police_presence"))
    model, _ = response.fit_binary(grouped, features, "y", weight="w")
    return response.coefficient_table(spark, features, model)


@query
def presence_logit_countries(spark, sf):
    """Country alone: the coefficients are differences of log odds."""
    indicators = response.indicator_columns("country", COUNTRIES)
    design = _presence(spark, sf).withColumns(indicators)
    grouped = settle(response.grouped_counts(design, list(indicators), "police_presence"))
    model, _ = response.fit_binary(grouped, list(indicators), "y", weight="w")
    terms = response.coefficient_table(spark, list(indicators), model)
    return terms.select("term", F.round("coefficient", 4).alias("coefficient"))


@query
def clustered_pair(spark, sf):
    """One indicator, errors clustered by region: both have a closed form."""
    design = _presence(spark, sf).withColumn("is_france", (F.col("country") == "France").cast("double"))
    grouped = settle(response.grouped_counts(design, ["is_france", "admin1"], "police_presence"))
    model, _ = response.fit_binary(grouped, ["is_france"], "y", weight="w")
    found = response.clustered_errors(grouped, ["is_france"], "y", "admin1", model, weight="w")
    rounded = [(t, round(c, 4), round(e, 4)) for t, c, e in found]
    return spark.createDataFrame(rounded, "term string, coefficient double, std_error double")


def _selection(spark, sf):
    design, features = _design(spark, sf)
    design = design.withColumn("violent", (F.coalesce("fatalities", F.lit(0)) > 0).cast("double"))
    grouped = settle(
        design.groupBy(*features, F.col("police_presence").cast("double").alias("y"), "violent").agg(
            F.count(F.lit(1)).cast("double").alias("w")
        )
    )
    return grouped, features, [f"event_{c}" for c in packs.LABELS]


@query
def selection_two_step(spark, sf):
    grouped, features, outcome_features = _selection(spark, sf)
    _, outcome, names = response.two_step_selection(
        grouped, features, "y", outcome_features, "violent", weight="w"
    )
    return response.coefficient_table(spark, names, outcome)


@query
def selection_two_step_errors(spark, sf):
    """The outcome's terms with errors that know the ratio was estimated."""
    grouped, features, outcome_features = _selection(spark, sf)
    found = response.two_step_errors(grouped, features, "y", outcome_features, "violent", weight="w")
    return spark.createDataFrame(found, "term string, coefficient double, std_error double")


@query
def clustered_se(spark, sf):
    design, _ = _design(spark, sf)
    features = [f"event_{c}" for c in packs.LABELS]
    # Counts per cluster and design cell carry the same sums as the rows.
    grouped = settle(response.grouped_counts(design, [*features, "admin1"], "police_presence"))
    model, _ = response.fit_binary(grouped, features, "y", weight="w")
    rows_ = response.clustered_errors(grouped, features, "y", "admin1", model, weight="w")
    return spark.createDataFrame(rows_, "term string, coefficient double, std_error double")


@query
def mean_equivalence(spark, sf):
    events = _classified_present(spark, sf)
    out = response.mean_equivalence(
        events, F.col("police_presence").cast("int"), "event_partisan_type", "left_only", "right_only"
    )
    decimals = ["difference", "error", "t_lower", "t_upper"]
    return out.select("n1", "n2", *[F.round(c, 6).alias(c) for c in decimals])


@query
def label_override(spark, sf):
    """Labels of 200 events per 1,000 corrected by a table of corrections."""
    events = _classified(spark, sf).select(ID, "event_partisan_type")
    corrections = (
        table(spark, sf, "orders")
        .where(F.col("o_orderkey") % 5 == 0)
        .select(
            F.concat(F.lit("EVT"), F.col("o_orderkey").cast("string")).alias(ID),
            F.when(F.col("o_orderkey") % 2 == 0, "left_only").otherwise("right_only").alias("corrected"),
        )
    )
    return actors.override_labels(events, corrections, ID, "event_partisan_type")


# --- rule tables of any size -----------------------------------------------


def _made_pack(spark, sf):
    """A rule for every third customer: endings, patterns, exceptions and exact names; and two that need no plain piece."""
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 3, "eq").when(k % 5 == 2, "regex_not").otherwise("regex")
    low = F.lower("c_name")
    pattern = (
        F.when(k % 5 == 0, F.concat(F.right(low, F.lit(6)), F.lit("|zz"), k.cast("string")))
        .when(k % 5 == 1, F.concat(F.lit("stomer#0+"), k.cast("string"), F.lit("( |$)")))
        .when(k % 5 == 2, F.right(low, F.lit(7)))
        .when(k % 5 == 3, F.col("c_name"))
        .otherwise(F.concat(F.lit("^customer#[0-9]*"), F.right(low, F.lit(5)), F.lit(" .*r")))
    )
    pattern = F.regexp_replace(pattern, r"\( \|\$\)", " ")  # a group would hide the plain piece
    label = F.element_at(F.array(*map(F.lit, packs.LABELS)), (F.floor(k / 3) % 3 + 1).cast("int"))
    made = table(spark, sf, "customer").where(k % 3 == 0).select(label.alias("label"), kind.alias("kind"), pattern.alias("pattern"), F.when(kind == "regex_not", "red|wid").alias("unless"))
    free = spark.createDataFrame([("centre", "regex", "supplier#0+(1|2)[0-9]$", None), ("left", "regex", "[xyz]{2}|q.", None)], made.schema)
    return made.unionByName(free)


@query
def labels_by_rule_index(spark, sf):
    customers, parts = table(spark, sf, "customer"), table(spark, sf, "part")
    both = customers.join(parts, F.col("c_custkey") == F.col("p_partkey")).select(F.concat_ws(" ", "c_name", "p_name").alias("actor_clean"))
    names = both.union(customers.select("c_name")).union(table(spark, sf, "supplier").select("s_name")).union(parts.select("p_name"))
    return index.label_names(names, _made_pack(spark, sf))


# --- rounds of corrections -------------------------------------------------


def _versions(spark, sf):
    """Every third event corrected in one of four rounds, every sixth once more later."""
    k = F.col("o_orderkey")
    first = table(spark, sf, "orders").where(k % 3 == 0).select(k, (k % 4 + 1).alias("round"), F.when(k % 2 == 0, "left_only").otherwise("right_only").alias("corrected"))
    again = table(spark, sf, "orders").where(k % 6 == 0).select(k, (k % 4 + 3).alias("round"), F.lit("unknown").alias("corrected"))
    return first.union(again).select(F.concat(F.lit("EVT"), k.cast("string")).alias(ID), "round", "corrected")


@query
def labels_after_two_rounds(spark, sf):
    events = _classified(spark, sf).select(ID, "event_partisan_type")
    return corrections.labels_as_of(events, _versions(spark, sf), ID, "event_partisan_type", 2)


@query
def accuracy_by_round(spark, sf):
    """Against the last version where there is one, else against the first label but for every tenth event."""
    events = settle(_classified(spark, sf).select(ID, "event_partisan_type"))
    last = corrections.latest(_versions(spark, sf), ID).withColumnRenamed("corrected", "last")
    other = F.when(F.substring(ID, 4, 20).cast("long") % 10 != 0, F.col("event_partisan_type")).otherwise("centre_only")
    told = events.join(last, ID, "left").withColumn("truth", F.coalesce("last", other))
    rounds = corrections.accuracy_by_round(told, _versions(spark, sf), ID, "event_partisan_type", "truth")
    return rounds.withColumn("accuracy", F.round("accuracy", 9))


def _judged(spark, sf):
    """Documents whose length says another quality than their label."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return docs.select("doc_id", ((F.col("n_chars") >= 600).cast("int") != F.col("quality")).alias("wrong"))


@query
def error_terms(spark, sf):
    words = tok.tokens(_documents(spark, sf, "doc_id", "text"), "text", ["doc_id"])
    return corrections.error_terms(words, settle(_judged(spark, sf)), "doc_id")


@query
def next_to_code(spark, sf):
    """Five documents per language and source nearest to a length score of one half, none of them labelled."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", (F.col("n_chars") / (F.col("n_chars") + 600.0)).alias("score"))
    chosen = corrections.next_to_code(docs, table(spark, sf, "labels"), "doc_id", ["lang", "source"], "score", 5)
    return chosen.select("doc_id", "lang", "source", "doubt", "place")
