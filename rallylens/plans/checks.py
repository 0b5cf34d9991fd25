"""SQL with the same result as each registered query, for the driver's check.

Written for DuckDB over the given tables.  Rule texts come from the rule
tables; the logic is spelled out again in plain SQL.
"""

from __future__ import annotations

from rallylens.functions import stem
from rallylens.functions.text import CONTRACTIONS, FILLER_PATTERN, PREFIX_PATTERN, REMARK_PATTERN, WORD_END
from rallylens.rules import packs
from rallylens.sources.incidents import COUNTRIES, INCIDENTS_SQL, REPORTED_SQL

CHECKS: dict[str, str] = {}
INC = INCIDENTS_SQL.replace("{orders}", "orders")
ID = "event_id_cnty"
PREFIXES = {"actor1": "actor1", "actor2": "actor2", "assoc_actor_1": "assoc_actor1", "assoc_actor_2": "assoc_actor2"}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(patterns) -> str:
    return q("|".join(f"(?:{p})" for p in patterns))


def with_(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n"


inc = ("inc", INC)
rep = ("inc", REPORTED_SQL.format(orders="orders", benchmark="benchmark", documents="documents", supplier="supplier"))

# --- shared pieces ---------------------------------------------------------


def parsed(c: str) -> str:
    out = f"regexp_replace({c}, {q(REMARK_PATTERN)}, '', 'g')"
    out = f"regexp_replace({out}, {q(PREFIX_PATTERN)}, '')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def rule_sql(rules, name: str = "actor_clean") -> str:
    tests = []
    for r in rules:
        if r.kind == "eq":
            tests.append(f"{name} = {q(r.pattern)}")
        elif r.kind == "regex":
            tests.append(f"regexp_matches(lower({name}), {q(r.pattern)})")
        else:
            tests.append(
                f"(regexp_matches(lower({name}), {q(r.pattern)}) AND NOT regexp_matches(lower({name}), {q(r.unless)}))"
            )
    return "CAST((" + " OR ".join(tests or ["false"]) + ") AS INT)"


def flag_sql() -> str:
    return ", ".join(
        f"{rule_sql([r for r in packs.SMALL_PACK if r.label == l])} AS \"{l}\"" for l in packs.LABELS
    )


stackd = ("raws", "SELECT DISTINCT actor_raw FROM (" + " UNION ALL ".join(
    f"SELECT {f} AS actor_raw FROM inc" for f in PREFIXES) + ") WHERE actor_raw IS NOT NULL")
names = (
    "names",
    f"SELECT actor_raw, trim(part) AS actor_clean FROM (SELECT actor_raw, unnest(string_split({parsed('actor_raw')}, ';')) AS part FROM raws)",
)
dictionary = (
    "dictionary",
    "SELECT DISTINCT actor_clean, lower(actor_clean) AS actor_clean_lower FROM names WHERE actor_clean <> ''",
)
labelled = (
    "labelled",
    f"SELECT *, 1 - greatest(\"left\", \"right\", centre) AS unknown FROM (SELECT *, {flag_sql()} FROM dictionary)",
)
by_raw = (
    "by_raw",
    "SELECT actor_raw, max(coalesce(\"left\", 0)) AS l, max(coalesce(\"right\", 0)) AS r, max(coalesce(centre, 0)) AS c "
    "FROM names LEFT JOIN labelled USING (actor_clean) GROUP BY actor_raw",
)
flag_columns = ", ".join(
    f"CAST(coalesce(t_{p}.l, 0) AS INT) AS {p}_left, CAST(coalesce(t_{p}.r, 0) AS INT) AS {p}_right, "
    f"CAST(coalesce(t_{p}.c, 0) AS INT) AS {p}_centre, "
    f"CAST(1 - greatest(coalesce(t_{p}.l, 0), coalesce(t_{p}.r, 0), coalesce(t_{p}.c, 0)) AS INT) AS {p}_unknown"
    for p in PREFIXES.values()
)
flagged = (
    "flagged",
    f"SELECT inc.*, {flag_columns} FROM inc "
    + " ".join(f"LEFT JOIN by_raw t_{p} ON inc.{f} = t_{p}.actor_raw" for f, p in PREFIXES.items()),
)
event_flags = ", ".join(
    f"greatest({', '.join(f'{p}_{l}' for p in PREFIXES.values())}) AS event_{l}" for l in packs.LABELS
)
typed = (
    "typed",
    "SELECT *, CASE WHEN event_left = 1 AND event_right = 1 THEN 'left_vs_right' "
    "WHEN event_left = 1 AND event_centre = 1 THEN 'left_vs_centre' "
    "WHEN event_right = 1 AND event_centre = 1 THEN 'right_vs_centre' "
    "WHEN event_left = 1 THEN 'left_only' WHEN event_right = 1 THEN 'right_only' "
    "WHEN event_centre = 1 THEN 'centre_only' ELSE 'unknown' END AS event_partisan_type "
    f"FROM (SELECT *, {event_flags} FROM flagged)",
)
PARTISAN = (rep, stackd, names, dictionary, labelled, by_raw, flagged, typed)


def decision_sql(text: str, steps) -> str:
    cases = [f"WHEN {text} IS NULL OR length(trim({text}, chr(32) || chr(9) || chr(13) || chr(10))) < {packs.MIN_NOTE_LENGTH} THEN '0'"]
    for s in steps:
        tests = [
            f"{t.column} = {q(t.value)}" if t.op == "eq" else f"regexp_matches({t.column}, {q('(?i)' + t.value)})"
            for t in s.tests
        ]
        if s.patterns:
            tests.append(f"regexp_matches(lower({text}), {any_of(s.patterns)})")
        cases.append(f"WHEN {' AND '.join(tests)} THEN {q(s.name)}")
    return "CASE " + " ".join(cases) + " ELSE 'none' END"


def positive(steps) -> str:
    return ", ".join(q(s.name) for s in steps if s.result)


pres = (
    "pres",
    f"SELECT *, presence_step IN ({positive(packs.PRESENCE_STEPS)}) AS police_presence "
    f"FROM (SELECT *, {decision_sql('notes', packs.PRESENCE_STEPS)} AS presence_step FROM inc)",
)
PRESENCE = with_(rep, pres)
HASH = f"md5(concat_ws('|', '123', {ID}))"


def pct(a: str, b: str) -> str:
    return f"CAST(round_even(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * CAST(100 AS DOUBLE), 2) AS DOUBLE)"


# --- sources and sinks -----------------------------------------------------

CHECKS["csv_roundtrip"] = with_(inc) + "SELECT *, lower(replace(country, ' ', '_')) AS country_slug FROM inc"
CHECKS["csv_keep_empty"] = with_(inc) + (
    f"SELECT {ID}, coalesce(admin1, '') AS admin1, coalesce(assoc_actor_1, '') AS assoc_actor_1, "
    "coalesce(interaction, '') AS interaction, fatalities FROM inc"
)
COUNTRY_YEAR = with_(inc) + (
    "SELECT country, year, count(*) AS events, CAST(coalesce(sum(fatalities), 0) AS BIGINT) AS total_fatalities "
    "FROM inc GROUP BY country, year"
)
CHECKS["paged_landing_union"] = COUNTRY_YEAR
CHECKS["landed_responses"] = with_(
    inc,
    ("n", "SELECT *, CAST(substring(event_id_cnty, 4) AS BIGINT) % 4 AS page FROM inc"),
    (
        "pages",
        "SELECT country, year, page, count(*) AS n, (year + page) % 5 = 0 AS failed FROM n GROUP BY ALL "
        "UNION ALL SELECT DISTINCT country, year, 99, 0, false FROM n",
    ),
) + (
    "SELECT country, year, count(*) AS pages, count(*) FILTER (failed) AS failed, 0::BIGINT AS broken, count(*) FILTER (n = 0) AS empty, "
    "count(*) FILTER (NOT failed AND n > 0 AND n < 100) AS short, coalesce(sum(n) FILTER (NOT failed), 0)::BIGINT AS events FROM pages GROUP BY country, year"
)
CHECKS["combine_country_tables"] = with_(inc) + (
    "SELECT country AS country_source, sub_event_type, count(*) AS n FROM inc "
    f"WHERE country IN ({', '.join(q(c) for c in COUNTRIES)}) GROUP BY ALL"
)
CHECKS["hand_coding_sheet"] = PRESENCE + (
    "SELECT country, event_date, interaction, notes, 0 AS presence, 0 AS coercion, 0 AS arrest, 0 AS brutality "
    f"FROM (SELECT *, row_number() OVER (ORDER BY {HASH}, {ID}) AS rn, count(*) OVER () AS total FROM pres WHERE police_presence) "
    "WHERE rn <= round_even(CAST(total AS DOUBLE) * CAST(0.1 AS DOUBLE), 0)"
)

# --- filters ---------------------------------------------------------------

CHECKS["filter_country"] = with_(inc) + f"SELECT {ID}, event_date, country, notes FROM inc WHERE country = 'France'"
CHECKS["filter_not_in_keep_null"] = with_(inc) + (
    f"SELECT {ID}, admin1 FROM inc WHERE admin1 IS NULL OR admin1 NOT IN ('Northern Ireland', 'Scotland', 'Wales')"
)
CHECKS["filter_regex"] = with_(rep) + (
    f"SELECT {ID}, assoc_actor_1 FROM inc WHERE assoc_actor_1 <> '' "
    "AND regexp_matches(lower(assoc_actor_1), 'france|labour') AND NOT regexp_matches(lower(assoc_actor_1), 'liberal')"
)

# --- actors ----------------------------------------------------------------

CHECKS["actor_dictionary"] = with_(rep, stackd, names) + dictionary[1]
CHECKS["actor_labels"] = with_(rep, stackd, names, dictionary) + labelled[1]


def stage_sql() -> str:
    firsts = " ".join(
        f"WHEN {rule_sql([r for r in packs.SMALL_PACK if r.stage == s])} = 1 THEN {n}"
        for n, s in enumerate(packs.STAGES, start=1)
    )
    per_stage = " UNION ALL ".join(
        f"SELECT {n} AS stage_no, {q(s)} AS stage, count(*) FILTER (hit <= {n}) AS classified, "
        f"count(*) - count(*) FILTER (hit <= {n}) AS unknown FROM hits"
        for n, s in enumerate(packs.STAGES, start=1)
    )
    return with_(rep, stackd, names, dictionary, ("hits", f"SELECT CASE {firsts} END AS hit FROM dictionary")) + per_stage


CHECKS["stage_coverage"] = stage_sql()
CHECKS["party_family_lean"] = (
    "WITH leans(family, lean) AS (VALUES "
    + ", ".join(f"({n}, {q(lean)})" for n, _, lean in packs.PARTY_FAMILIES)
    + ") SELECT p_partkey, CAST(p_size % 14 AS INT) AS family, coalesce(lean, 'unknown') AS lean "
    "FROM part LEFT JOIN leans ON p_size % 14 = leans.family"
)
FIELD_FLAGS = f"SELECT {ID}, " + ", ".join(
    f"{p}_{f}" for p in PREFIXES.values() for f in (*packs.LABELS, "unknown")
)
CHECKS["field_flags"] = with_(*PARTISAN[:-1]) + FIELD_FLAGS + " FROM flagged"
CHECKS["field_flags_inline"] = CHECKS["field_flags"]
CHECKS["dictionary_lookup"] = CHECKS["field_flags"]
CHECKS["field_flags_shuffled"] = CHECKS["field_flags"]
CHECKS["stacked_countries"] = with_(*PARTISAN) + f"SELECT {ID}, " + ", ".join(
    [f"{p}_{l}" for p in PREFIXES.values() for l in packs.LABELS] + [f"event_{l}" for l in packs.LABELS]
) + f" FROM typed WHERE country IN ({', '.join(q(c) for c in COUNTRIES)})"
CHECKS["event_partisan_type"] = with_(*PARTISAN) + (
    f"SELECT {ID}, event_left, event_right, event_centre, event_partisan_type FROM typed"
)
CHECKS["partisan_share"] = with_(*PARTISAN) + (
    "SELECT event_partisan_type, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * CAST(100 AS DOUBLE) AS percent "
    "FROM (SELECT event_partisan_type, count(*) AS n FROM typed GROUP BY 1)"
)
CHECKS["partisan_freq_by_country"] = with_(*PARTISAN) + (
    "SELECT country, event_partisan_type, count(*) AS n FROM typed "
    "WHERE country IS NOT NULL AND event_partisan_type IS NOT NULL GROUP BY 1, 2"
)
CHECKS["partisan_share_by_country"] = with_(*PARTISAN) + (
    "SELECT country, event_partisan_type, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY country) AS DOUBLE) * CAST(100 AS DOUBLE) AS percent "
    "FROM (SELECT country, event_partisan_type, count(*) AS n FROM typed GROUP BY 1, 2)"
)


def country_pack_sql() -> str:
    """Labels per event and name, each country with its own rules."""
    by_country = packs.COUNTRY_PACKS
    flags = ", ".join(
        "max(CASE country "
        + " ".join(f"WHEN {q(c)} THEN {rule_sql([r for r in rules if r.label == l])}" for c, rules in by_country.items())
        + f" ELSE 0 END) AS event_{l}"
        for l in packs.LABELS
    )
    long = " UNION ALL ".join(f"SELECT {ID}, country, {f} AS actor_raw FROM inc" for f in PREFIXES)
    parts = (
        f"SELECT {ID}, country, trim(part) AS actor_clean FROM "
        f"(SELECT {ID}, country, unnest(string_split({parsed('actor_raw')}, ';')) AS part FROM long WHERE actor_raw IS NOT NULL)"
    )
    found = f"SELECT {ID}, {flags} FROM parts GROUP BY {ID}"
    all_events = (
        f"SELECT inc.{ID}, inc.country, coalesce(event_left, 0) AS event_left, coalesce(event_right, 0) AS event_right, "
        f"coalesce(event_centre, 0) AS event_centre FROM inc LEFT JOIN found USING ({ID})"
    )
    case = typed[1].split(" FROM (SELECT")[0].replace("SELECT *,", f"SELECT {ID}, country,", 1)
    return with_(rep, ("long", long), ("parts", parts), ("found", found), ("flags", all_events)) + case + " FROM flags"


CHECKS["type_by_country_pack"] = country_pack_sql()
CHECKS["unclassified_actor_topk"] = with_(*PARTISAN) + (
    "SELECT actor, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT {f} AS actor FROM typed WHERE event_partisan_type = 'unknown'" for f in PREFIXES)
    + ") WHERE actor IS NOT NULL GROUP BY actor ORDER BY n DESC, actor LIMIT 50"
)
CHECKS["conflict_examples"] = with_(*PARTISAN) + (
    f"SELECT {ID}, event_date, actor1, actor2, event_type, sub_event_type, event_partisan_type FROM typed "
    f"WHERE event_partisan_type = 'left_vs_right' ORDER BY event_date, {ID} LIMIT 20"
)

# --- police presence -------------------------------------------------------

CHECKS["presence_rule"] = PRESENCE + f"SELECT {ID}, presence_step, police_presence FROM pres"
CHECKS["presence_step_counts"] = PRESENCE + (
    "SELECT presence_step, police_presence, count(*) AS n FROM pres GROUP BY 1, 2"
)
CHECKS["presence_on_documents"] = (
    f"SELECT doc_id, step, step IN ({positive(packs.PROSE_STEPS)}) AS presence "
    f"FROM (SELECT doc_id, {decision_sql('text', packs.PROSE_STEPS)} AS step FROM documents)"
)
CHECKS["presence_by_country"] = PRESENCE + (
    f"SELECT country, total, with_police, {pct('with_police', 'total')} AS pct FROM "
    "(SELECT country, count(*) AS total, count(*) FILTER (police_presence) AS with_police FROM pres GROUP BY country)"
)
CHECKS["presence_by_year"] = PRESENCE + (
    f"SELECT year, events_with_police, total_events_that_year, {pct('events_with_police', 'total_events_that_year')} AS pct "
    "FROM (SELECT year, count(*) FILTER (police_presence) AS events_with_police, count(*) AS total_events_that_year "
    "FROM pres GROUP BY year) WHERE events_with_police > 0"
)
CHECKS["presence_type_topk"] = PRESENCE + (
    "SELECT event_type, sub_event_type, count(*) AS n FROM pres WHERE police_presence GROUP BY 1, 2 "
    "ORDER BY n DESC, event_type, sub_event_type LIMIT 10"
)
CHECKS["presence_crosstab"] = PRESENCE + (
    "SELECT interaction, count(*) FILTER (NOT police_presence) AS absent, count(*) FILTER (police_presence) AS present "
    "FROM pres GROUP BY interaction"
)
CHECKS["presence_pattern_hits"] = with_(rep) + " UNION ALL ".join(
    f"SELECT {q(s.name)} AS step, {q(p)} AS pattern, count(*) FILTER (regexp_matches(lower(notes), {q(p)})) AS n FROM inc"
    for s in packs.PRESENCE_STEPS
    for p in s.patterns
)
CHECKS["keyword_response"] = with_(rep) + (
    f"SELECT {ID}, CAST(coalesce(regexp_matches(notes, {q('(?i)' + '|'.join(packs.RESPONSE_KEYS))}), false) AS INT) AS response FROM inc"
)

# --- keyword ideology ------------------------------------------------------


def expanded(c: str) -> str:
    out = f"coalesce({c}, '')"
    for short, full in CONTRACTIONS:
        put = (full + f"${short.count('(') + 1}").replace("$", chr(92))
        out = f"regexp_replace({out}, {q('(?i)' + short + WORD_END)}, {q(put)}, 'g')"
    return out


def cleaned(c: str) -> str:
    out = f"regexp_replace({expanded(c)}, {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{Nd} ]')}, ' ', 'g')"
    return f"trim(regexp_replace(lower({out}), '\\s+', ' ', 'g'))"


def standardised(c: str) -> str:
    out = f"regexp_replace(lower(coalesce({c}, '')), {q(FILLER_PATTERN)}, ' ', 'g')"
    out = f"regexp_replace({out}, '\\p{{P}}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def side(c: str) -> str:
    def hit(keys):
        return f"regexp_matches({c}, {q(chr(92) + 'b(?:' + '|'.join(keys) + ')' + chr(92) + 'b')})"

    return f"CASE WHEN {hit(packs.LEFT_KEYS)} THEN 'Left' WHEN {hit(packs.RIGHT_KEYS)} THEN 'Right' ELSE 'Unclassified' END"


def hits(c: str, keys) -> str:
    return "CAST(" + " + ".join(
        f"length(regexp_extract_all({c}, {q(chr(92) + 'b' + k + chr(92) + 'b')}))" for k in keys
    ) + " AS INT)"


LARGER = "CASE WHEN left_hits > right_hits THEN 'Left' WHEN right_hits > left_hits THEN 'Right' ELSE 'Unclassified' END"
named = (
    "named",
    f"SELECT *, {standardised('assoc_actor_1')} AS actor1_std, {standardised('assoc_actor_2')} AS actor2_std, "
    f"{cleaned('notes')} AS notes_clean FROM inc",
)
keyed = (
    "keyed",
    f"SELECT *, {side('actor1_std')} AS actor1_ideology, {side('actor2_std')} AS actor2_ideology, "
    f"{hits('notes_clean', packs.LEFT_KEYS)} AS left_hits, {hits('notes_clean', packs.RIGHT_KEYS)} AS right_hits FROM named",
)
final = (
    "final",
    "SELECT *, coalesce(nullif(actor1_ideology, 'Unclassified'), nullif(actor2_ideology, 'Unclassified'), context_ideology) "
    f"AS final_ideology FROM (SELECT *, {LARGER} AS context_ideology FROM keyed)",
)
IDEOLOGY_PARTS = (rep, named, keyed, final)
IDEOLOGY = with_(*IDEOLOGY_PARTS)
CHECKS["standardise_actors"] = with_(rep, named) + f"SELECT {ID}, actor1_std, actor2_std FROM named"
CHECKS["actor_ideology"] = IDEOLOGY + f"SELECT {ID}, actor1_ideology, actor2_ideology FROM final"
CHECKS["unclassified_events"] = IDEOLOGY + (
    f"SELECT {ID}, assoc_actor_1, assoc_actor_2 FROM final WHERE actor1_ideology = 'Unclassified' AND actor2_ideology = 'Unclassified'"
)
CHECKS["context_ideology"] = IDEOLOGY + f"SELECT {ID}, left_hits, right_hits, context_ideology FROM final"
CHECKS["final_ideology"] = IDEOLOGY + f"SELECT {ID}, final_ideology FROM final"
CHECKS["ideology_share"] = IDEOLOGY + (
    "SELECT final_ideology, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * CAST(100 AS DOUBLE) AS percentage "
    "FROM (SELECT final_ideology, count(*) AS n FROM final GROUP BY 1)"
)
CHECKS["ideology_by_year"] = IDEOLOGY + (
    "SELECT CAST(year(event_date) AS INT) AS year, final_ideology, count(*) AS n FROM final GROUP BY ALL"
)

# --- samples ---------------------------------------------------------------

CHECKS["validation_sample"] = PRESENCE + (
    f"SELECT {ID}, country, event_date, interaction, notes FROM pres WHERE police_presence ORDER BY {HASH}, {ID} LIMIT 20"
)
CHECKS["large_sample"] = with_(inc) + (
    f"SELECT {ID}, country FROM (SELECT *, row_number() OVER (ORDER BY {HASH}, {ID}) AS rn, count(*) OVER () AS total FROM inc) WHERE rn <= 2 * total // 3"
)
CHECKS["sample_per_group"] = IDEOLOGY + (
    f"SELECT {ID}, event_date, assoc_actor_1, assoc_actor_2, notes, final_ideology FROM final "
    f"QUALIFY row_number() OVER (PARTITION BY final_ideology ORDER BY {HASH}, {ID}) <= 3"
)


def split_sql(fraction: str) -> str:
    return (
        "SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id) "
        f"<= ceil(CAST(count(*) OVER () AS DOUBLE) * CAST({fraction} AS DOUBLE)) AS is_test FROM labels"
    )


CHECKS["train_test_split"] = f"SELECT doc_id, is_test FROM ({split_sql('0.2')})"
CHECKS["numbered_rows"] = with_(inc) + (
    f"SELECT {ID}, row_number() OVER (ORDER BY md5(concat_ws('|', '0', {ID})), {ID}) AS row_id FROM inc"
)

# --- summaries -------------------------------------------------------------

CHECKS["yearly_summary"] = with_(inc) + (
    "SELECT year, count(*) AS events, CAST(coalesce(sum(fatalities), 0) AS BIGINT) AS total_fatalities, "
    "count(DISTINCT location) + CAST(max(CAST(location IS NULL AS INT)) AS BIGINT) AS unique_locations FROM inc GROUP BY year"
)
CHECKS["country_year_summary"] = COUNTRY_YEAR

CHECKS["text_dates"] = with_(inc) + (
    "SELECT CAST(year(event_date) AS INT) AS year, min(event_date) AS first_date, max(event_date) AS last_date, count(*) AS n FROM inc GROUP BY 1"
)


def distinct_null(c: str) -> str:
    return f"count(DISTINCT {c}) + CAST(max(CAST({c} IS NULL AS INT)) AS BIGINT)"


CHECKS["global_stats"] = with_(inc) + (
    f"SELECT count(*) AS total_records, {distinct_null('country')} AS countries, min(year) AS first_year, max(year) AS last_year, "
    f"min(event_date) AS first_date, max(event_date) AS last_date, {distinct_null('assoc_actor_1')} AS primary_actors, "
    f"{distinct_null('assoc_actor_2')} AS secondary_actors FROM inc"
)
CHECKS["missing_counts"] = with_(inc) + "SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER ({c} IS NULL OR {c} = '') AS {c}_missing" for c in ("assoc_actor_1", "assoc_actor_2", "notes")
) + " FROM inc"

# --- text ------------------------------------------------------------------

STOPS = ", ".join(q(w) for w in packs.STOP_WORDS)


def token_sql(source: str, keep: str, stops: str = STOPS) -> str:
    lead = f"{keep}, " if keep else ""
    dropped = f" AND word NOT IN ({stops})" if stops else ""
    return (
        f"SELECT {lead}word FROM (SELECT {lead}unnest(string_split({cleaned('text')}, ' ')) AS word FROM {source}) "
        f"WHERE word <> '' AND NOT regexp_matches(word, '^[0-9]+$'){dropped}"
    )


CHECKS["clean_notes"] = f"SELECT doc_id, {cleaned('text')} AS text_clean FROM documents"
CHECKS["note_tokens"] = with_(
    (
        "numbered",
        "SELECT doc_id, text, row_number() OVER (ORDER BY md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR))), doc_id) AS row_id FROM documents",
    ),
    ("kept", "SELECT numbered.* FROM numbered JOIN (SELECT doc_id FROM labels) USING (doc_id)"),
) + token_sql("kept", "row_id, doc_id")
CHECKS["stop_table_tokens"] = with_(
    ("words", token_sql("documents", "doc_id", "")),
    ("d", "SELECT count(DISTINCT doc_id) AS n FROM words"),
    ("stops", "SELECT word FROM words, d GROUP BY word, d.n HAVING count(DISTINCT doc_id) > CAST(0.1 AS DOUBLE) * d.n"),
) + "SELECT word, count(*) AS n FROM words WHERE word NOT IN (SELECT word FROM stops) GROUP BY word"
CHECKS["doc_term_counts"] = with_(("words", token_sql("documents", "doc_id"))) + (
    "SELECT doc_id, word, count(*) AS n FROM words GROUP BY 1, 2"
)
CHECKS["top_terms_per_group"] = with_(("words", token_sql("documents", "lang"))) + (
    "SELECT lang, word, n, CAST(rank() OVER (PARTITION BY lang ORDER BY n DESC) AS INT) AS rank "
    "FROM (SELECT lang, word, count(*) AS n FROM words GROUP BY 1, 2) QUALIFY rank() OVER (PARTITION BY lang ORDER BY n DESC) <= 15"
)


def stem_sql(source: str, word: str = "word") -> list[tuple[str, str]]:
    """One CTE per step; each replaces column w."""

    def rest(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def swap(rules) -> str:
        cases = []
        for suffix, condition, new in sorted(rules, key=lambda r: -len(r[0])):
            changed = f"{rest(len(suffix))} || {q(new)}"
            if condition is not None:
                changed = f"CASE WHEN regexp_matches({rest(len(suffix))}, {q(condition)}) THEN {changed} ELSE w END"
            cases.append(f"WHEN ends_with(w, {q(suffix)}) THEN {changed}")
        return "CASE " + " ".join(cases) + " ELSE w END"

    m1, m2 = stem.MEASURE_1, stem.MEASURE_2
    ion = ("ion", f"{m2}.*[st]$|{stem.VOWEL}{stem.CONSONANT}+{stem.VOWEL}+[st]$", "")
    last_e = (
        f"CASE WHEN ends_with(w, 'e') AND (regexp_matches({rest(1)}, {q(m2)}) OR (regexp_matches({rest(1)}, {q(m1)}) "
        f"AND NOT regexp_matches({rest(1)}, {q(stem.SHORT_END)}))) THEN {rest(1)} ELSE w END"
    )
    tidy = (
        "CASE WHEN NOT (length(w) < length(before) AND NOT ends_with(before, 'eed')) THEN w "
        "WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' "
        f"WHEN regexp_matches(w, {q(stem.DOUBLE_END)}) THEN {rest(1)} "
        f"WHEN regexp_matches(w, {q(stem.ONE_CHANGE)}) AND regexp_matches(w, {q(stem.SHORT_END)}) THEN w || 'e' ELSE w END"
    )
    mark = f"regexp_replace(regexp_replace({word}, '^y', 'Y'), '({stem.VOWEL})y', '\\1Y', 'g')"
    steps = [
        ("s0", f"SELECT *, {mark} AS w FROM {source}"),
        ("s1", f"SELECT * REPLACE ({swap([(s, None, n) for s, n in stem.STEP_1A])} AS w) FROM s0"),
        ("s2", f"SELECT * REPLACE ({swap(stem.STEP_1B)} AS w), w AS before FROM s1"),
        ("s3", f"SELECT * REPLACE ({tidy} AS w) FROM s2"),
        ("s4", f"SELECT * REPLACE (CASE WHEN regexp_matches(w, '{stem.VOWEL}.*[yY]$') THEN {rest(1)} || 'i' ELSE w END AS w) FROM s3"),
        ("s5", f"SELECT * REPLACE ({swap([(s, m1, n) for s, n in stem.STEP_2])} AS w) FROM s4"),
        ("s6", f"SELECT * REPLACE ({swap([(s, m1, n) for s, n in stem.STEP_3])} AS w) FROM s5"),
        ("s7", f"SELECT * REPLACE ({swap([*[(s, m2, '') for s in stem.STEP_4], ion])} AS w) FROM s6"),
        ("s8", f"SELECT * REPLACE ({last_e} AS w) FROM s7"),
        ("s9", f"SELECT *, replace(CASE WHEN ends_with(w, 'll') AND regexp_matches({rest(1)}, {q(m2)}) THEN {rest(1)} ELSE w END, 'Y', 'y') AS stem FROM s8"),
    ]
    return steps


CHECKS["stem_vocabulary"] = with_(
    ("words", token_sql("documents", "")), ("vocabulary", "SELECT DISTINCT word FROM words"), *stem_sql("vocabulary")
) + "SELECT word, stem FROM s9"
CHECKS["stemmed_term_counts"] = with_(
    ("words", token_sql("documents", "doc_id")),
    ("vocabulary", "SELECT DISTINCT word FROM words"),
    *stem_sql("vocabulary"),
) + "SELECT doc_id, stem, count(*) AS n FROM words JOIN s9 USING (word) GROUP BY 1, 2"

# --- naive Bayes and metrics -----------------------------------------------

bayes_parts = (
    ("marked", f"SELECT doc_id, quality, is_test FROM ({split_sql('0.25')})"),
    ("texts", "SELECT doc_id, text, quality, is_test FROM documents JOIN marked USING (doc_id)"),
    ("words", token_sql("texts", "doc_id, quality, is_test")),
    (
        "per_word",
        "SELECT word, count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1 FROM words WHERE NOT is_test GROUP BY word",
    ),
    ("sums", "SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM per_word"),
    (
        "model",
        "SELECT word, "
        + ", ".join(
            f"CAST(round(ln((CAST(n{c} AS DOUBLE) + 1) / CAST(t{c} + v AS DOUBLE)) * CAST(1000000 AS DOUBLE)) AS BIGINT) AS log{c}"
            for c in (0, 1)
        )
        + " FROM per_word, sums",
    ),
)
predicted_part = (
    "predicted",
    "SELECT doc_id, quality, CAST(m0 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS score0, CAST(m1 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS score1, "
    "CAST(m1 > m0 AS INT) AS predicted FROM (SELECT marked.doc_id, marked.quality, coalesce(s.m0, 0) AS m0, coalesce(s.m1, 0) AS m1 FROM marked LEFT JOIN "
    "(SELECT doc_id, sum(log0) AS m0, sum(log1) AS m1 FROM words JOIN model USING (word) WHERE is_test GROUP BY doc_id) s "
    "ON marked.doc_id = s.doc_id WHERE marked.is_test)",
)
CHECKS["naive_bayes_predict"] = with_(*bayes_parts, predicted_part) + "SELECT * FROM predicted"
stem_parts = (
    *bayes_parts[:3],
    ("vocabulary", "SELECT DISTINCT word FROM words WHERE NOT is_test"),
    *stem_sql("vocabulary"),
    (
        "per_word",
        "SELECT stem AS word, count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1 "
        "FROM words JOIN s9 USING (word) WHERE NOT is_test GROUP BY stem",
    ),
    *bayes_parts[4:],
)
CHECKS["naive_bayes_train_stems"] = with_(*stem_parts, predicted_part) + "SELECT * FROM predicted"
CHECKS["vocabulary_match"] = with_(*bayes_parts) + (
    "SELECT doc_id, count(*) AS known_words FROM words WHERE is_test AND word IN (SELECT word FROM model) GROUP BY doc_id"
)
CHECKS["confusion_counts"] = with_(*bayes_parts, predicted_part) + (
    "SELECT quality, predicted, count(*) AS n FROM predicted GROUP BY 1, 2"
)


def over(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


CHECKS["confusion_stats"] = with_(
    *bayes_parts,
    predicted_part,
    (
        "c",
        "SELECT count(*) FILTER (quality = 1 AND predicted = 1) AS tp, count(*) FILTER (quality <> 1 AND predicted = 1) AS fp, "
        "count(*) FILTER (quality = 1 AND predicted <> 1) AS fn, count(*) FILTER (quality <> 1 AND predicted <> 1) AS tn FROM predicted",
    ),
    (
        "d",
        f"SELECT *, {over('(tp + tn)', '(tp + fp + fn + tn)')} AS accuracy, {over('tp', '(tp + fp)')} AS \"precision\", "
        f"{over('tp', '(tp + fn)')} AS recall, {over('(2 * tp)', '(2 * tp + fp + fn)')} AS f1, "
        f"{over('tn', '(tn + fp)')} AS specificity, {over('tn', '(tn + fn)')} AS negative_predictive_value, "
        f"{over('(tp + fn)', '(tp + fp + fn + tn)')} AS prevalence, {over('tp', '(tp + fp + fn + tn)')} AS detection_rate, "
        f"{over('(tp + fp)', '(tp + fp + fn + tn)')} AS detection_prevalence, "
        f"{over('((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))', '((tp + fp + fn + tn) * (tp + fp + fn + tn))')} AS expected FROM c",
    ),
) + "SELECT * EXCLUDE (expected), (recall + specificity) / CAST(2 AS DOUBLE) AS balanced_accuracy, (accuracy - expected) / nullif(CAST(1 AS DOUBLE) - expected, 0) AS kappa FROM d"
CHECKS["label_prep"] = (
    "SELECT labels.doc_id, coalesce(text, '') AS text, CASE WHEN quality = 0 THEN 0 ELSE 1 END AS quality, "
    "CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic, CAST(CASE WHEN quality = 0 THEN 0 ELSE 1 END AS DOUBLE) AS label_0, "
    "CAST(CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS DOUBLE) AS label_1 FROM labels LEFT JOIN documents ON labels.doc_id = documents.doc_id"
)
CHECKS["label_totals"] = " UNION ALL ".join(
    f"SELECT '{c}' AS label, CAST(coalesce(sum({c}), 0) AS BIGINT) AS positive, avg({c}) AS mean FROM labels"
    for c in ("quality", "toxic")
)
scores = (
    "scores",
    "SELECT *, 1 / (1 + exp(-CAST(doc_id % 7 - 2 AS DOUBLE))) AS quality_score, 1 / (1 + exp(-CAST(doc_id % 5 - 3 AS DOUBLE))) AS toxic_score FROM labels",
)
CHECKS["score_summary"] = with_(scores) + " UNION ALL ".join(
    f"SELECT '{c}' AS label, count(*) FILTER ({c} > 0.5) AS cases, {over(f'count(*) FILTER ({c} > 0.5)', 'count(*)')} AS share FROM scores"
    for c in ("quality_score", "toxic_score")
)
CHECKS["multilabel_metrics"] = with_(
    scores,
    (
        "long",
        " UNION ALL ".join(f"SELECT {c} = 1 AS truth, {c}_score > 0.5 AS said FROM scores" for c in ("quality", "toxic")),
    ),
    (
        "c",
        "SELECT count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn FROM long",
    ),
    (
        "e",
        "SELECT count(*) FILTER ((quality = 1) = (quality_score > 0.5) AND (toxic = 1) = (toxic_score > 0.5)) AS exact, count(*) AS total FROM scores",
    ),
) + (
    f"SELECT tp, fp, fn, {over('(2 * tp)', '(2 * tp + fp + fn)')} AS f1, {over('tp', '(tp + fp)')} AS \"precision\", "
    f"{over('tp', '(tp + fn)')} AS recall, {over('exact', 'total')} AS accuracy FROM c, e"
)


def half_count(pattern: str) -> str:
    return (
        f"CASE WHEN trim(coalesce(notes, '')) = '' THEN CAST(0 AS DOUBLE) "
        f"ELSE CAST(length(regexp_extract_all(lower(notes), {q(pattern)})) AS DOUBLE) / 2 END"
    )


CHECKS["batch_scores"] = with_(rep) + (
    f"SELECT {ID}, notes, {half_count('tear gas|cordon')} AS coercion, {half_count('arrest')} AS arrest, "
    f"{half_count('brutal')} AS brutality, false AS failed FROM inc"
)

# --- place, time, models ---------------------------------------------------

CHECKS["grid_month_rate"] = PRESENCE + (
    "SELECT cell_lat, cell_lon, month, events, flagged, CAST(flagged AS DOUBLE) / CAST(events AS DOUBLE) AS rate FROM "
    "(SELECT CAST(floor(latitude) AS INT) AS cell_lat, CAST(floor(longitude) AS INT) AS cell_lon, "
    "CAST(date_trunc('month', event_date) AS DATE) AS month, count(*) AS events, count(*) FILTER (police_presence) AS flagged "
    "FROM pres GROUP BY 1, 2, 3)"
)


def haversine(la: str, lo: str) -> str:
    dlat, dlon = f"radians(CAST({la} AS DOUBLE) - latitude) / 2", f"radians(CAST({lo} AS DOUBLE) - longitude) / 2"
    a = f"sin({dlat}) * sin({dlat}) + cos(radians(latitude)) * cos(radians(CAST({la} AS DOUBLE))) * sin({dlon}) * sin({dlon})"
    return f"2 * 6371 * asin(least(1, sqrt({a})))"


CHECKS["nearest_site_distance"] = with_(
    inc,
    ("spots", "SELECT DISTINCT latitude, longitude FROM inc"),
    ("sites", "SELECT DISTINCT CAST(36 + c_custkey % 499 / 16.0 AS DOUBLE) AS la, CAST(c_custkey % 1009 / 16.0 - 30 AS DOUBLE) AS lo FROM customer"),
    ("best", f"SELECT latitude, longitude, min({haversine('la', 'lo')}) AS km FROM spots, sites GROUP BY 1, 2"),
) + f"SELECT {ID}, round(km, 3) AS distance_km FROM inc JOIN best USING (latitude, longitude)"
_ROAD_LAT, _ROAD_LON = "(36 + c_custkey % 499 / 16.0)", "(c_custkey % 1009 / 16.0 - 30)"


def vector(lat: str, lon: str, name: str) -> str:
    return (
        f"cos(radians({lat})) * cos(radians({lon})) AS {name}_x, cos(radians({lat})) * sin(radians({lon})) AS {name}_y, sin(radians({lat})) AS {name}_z"
    )


CHECKS["nearest_road_distance"] = with_(
    inc,
    ("spots", f"SELECT *, {vector('latitude', 'longitude', 'p')} FROM (SELECT DISTINCT latitude, longitude FROM inc)"),
    ("ends", f"SELECT DISTINCT CAST({_ROAD_LAT} AS DOUBLE) AS la, CAST({_ROAD_LON} AS DOUBLE) AS lo, "
             f"CAST({_ROAD_LAT} + (c_custkey % 7 - 3) / 8.0 AS DOUBLE) AS lc, CAST({_ROAD_LON} + (c_custkey % 11 - 5) / 4.0 AS DOUBLE) AS ld FROM customer"),
    ("roads", f"SELECT *, a_y * b_z - a_z * b_y AS nx, a_z * b_x - a_x * b_z AS ny, a_x * b_y - a_y * b_x AS nz "
              f"FROM (SELECT *, {vector('la', 'lo', 'a')}, {vector('lc', 'ld', 'b')} FROM ends)"),
    ("sized", "SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n FROM roads"),
    ("km", f"SELECT latitude, longitude, CASE WHEN n > 1e-12 "
           "AND (ny * a_z - nz * a_y) * p_x + (nz * a_x - nx * a_z) * p_y + (nx * a_y - ny * a_x) * p_z >= 0 "
           "AND (b_y * nz - b_z * ny) * p_x + (b_z * nx - b_x * nz) * p_y + (b_x * ny - b_y * nx) * p_z >= 0 "
           "THEN 6371.0 * asin(least(1.0, abs((p_x * nx + p_y * ny + p_z * nz) / n))) "
           f"ELSE least({haversine('la', 'lo')}, {haversine('lc', 'ld')}) END AS km FROM spots, sized"),
    ("best", "SELECT latitude, longitude, min(km) AS km FROM km GROUP BY 1, 2"),
) + f"SELECT {ID}, round(km, 3) AS distance_km FROM inc JOIN best USING (latitude, longitude)"
CHECKS["region_class_join"] = (
    "SELECT region_class, count(*) AS n FROM (SELECT CASE WHEN r_name IN ('EUROPE', 'AMERICA') THEN 'urban' "
    "WHEN r_name IS NULL THEN 'unclassified' ELSE 'rural' END AS region_class FROM customer "
    "LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey) GROUP BY 1"
)
PAIR = (
    rep,
    pres,
    ("x", "SELECT admin1, CAST(country = 'France' AS INT) AS f, CAST(police_presence AS INT) AS y FROM pres"),
    ("g", "SELECT f, avg(y) AS p, count(*) AS n FROM x GROUP BY f"),
    ("b", "SELECT max(p) FILTER (f = 0) AS p0, max(p) FILTER (f = 1) AS p1, max(n * p * (1 - p)) FILTER (f = 0) AS a0, max(n * p * (1 - p)) FILTER (f = 1) AS a1 FROM g"),
    ("c", "SELECT admin1, sum(y - p0) FILTER (f = 0) AS s0, sum(y - p1) FILTER (f = 1) AS s1 FROM x, b GROUP BY admin1"),
    ("v", "SELECT CAST(count(*) AS DOUBLE) / (count(*) - 1) AS k, sum((coalesce(s0, 0) / a0) ^ 2) AS v0, "
          "sum((coalesce(s1, 0) / a1 - coalesce(s0, 0) / a0) ^ 2) AS v1 FROM c, b"),
)
CHECKS["clustered_pair"] = with_(*PAIR) + (
    "SELECT '(intercept)' AS term, round(ln(p0 / (1 - p0)), 4) AS coefficient, round(sqrt(k * v0), 4) AS std_error FROM b, v "
    "UNION ALL SELECT 'is_france', round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4), round(sqrt(k * v1), 4) FROM b, v"
)
CHECKS["presence_logit_countries"] = with_(rep, pres, ("g", "SELECT country, avg(CAST(police_presence AS INT)) AS p FROM pres GROUP BY country")) + (
    "SELECT '(intercept)' AS term, round(ln(p / (1 - p)), 4) AS coefficient FROM g WHERE country = 'France' UNION ALL "
    "SELECT 'country=' || g.country, round(ln(g.p / (1 - g.p)) - ln(b.p / (1 - b.p)), 4) FROM g, g b WHERE b.country = 'France' AND g.country <> 'France'"
)
CHECKS["severity_invariants"] = (
    "SELECT count(*) AS documents, count(*) AS in_range, count(*) FILTER (trim(coalesce(text, '')) = '') AS blank, "
    "count(*) FILTER (trim(coalesce(text, '')) = '') AS blank_zero FROM documents"
)
CHECKS["topic_invariants"] = with_(
    *IDEOLOGY_PARTS,
    ("texts", f"SELECT {ID}, notes AS text FROM final WHERE actor1_ideology = 'Unclassified' AND actor2_ideology = 'Unclassified'"),
    ("words", token_sql("texts", ID)),
) + f"SELECT count(DISTINCT {ID}) AS documents, count(DISTINCT {ID}) AS whole, CAST(3 AS BIGINT) AS topics, CAST(3 AS BIGINT) AS with_terms, true AS rising, true AS several_passes FROM words"
CHECKS["mean_equivalence"] = with_(
    *PARTISAN,
    ("pairs", f"SELECT typed.event_partisan_type AS t, CAST(typed_step IN ({positive(packs.PRESENCE_STEPS)}) AS INT) AS x "
             f"FROM (SELECT *, {decision_sql('notes', packs.PRESENCE_STEPS)} AS typed_step FROM typed) typed"),
    ("m", "SELECT count(*) FILTER (t = 'left_only') AS n1, count(*) FILTER (t = 'right_only') AS n2, "
          "avg(x) FILTER (t = 'left_only') AS m1, avg(x) FILTER (t = 'right_only') AS m2, "
          "var_samp(x) FILTER (t = 'left_only') AS v1, var_samp(x) FILTER (t = 'right_only') AS v2 FROM pairs"),
    ("e", "SELECT n1, n2, m1 - m2 AS difference, sqrt(v1 / n1 + v2 / n2) AS error FROM m"),
) + (
    "SELECT n1, n2, round(difference, 6) AS difference, round(error, 6) AS error, "
    "round((difference + CAST(0.184 AS DOUBLE)) / error, 6) AS t_lower, round((difference - CAST(0.184 AS DOUBLE)) / error, 6) AS t_upper FROM e"
)
CHECKS["label_override"] = with_(
    *PARTISAN,
    (
        "corrections",
        "SELECT concat('EVT', CAST(o_orderkey AS VARCHAR)) AS event_id_cnty, "
        "CASE WHEN o_orderkey % 2 = 0 THEN 'left_only' ELSE 'right_only' END AS corrected FROM orders WHERE o_orderkey % 5 = 0",
    ),
) + (
    f"SELECT {ID}, coalesce(corrected, event_partisan_type) AS event_partisan_type FROM typed LEFT JOIN corrections USING ({ID})"
)

_CELLS = (
    "cells",
    "SELECT CAST(floor(latitude) AS INT) AS cell_lat, CAST(floor(longitude) AS INT) AS cell_lon, count(*) AS events, count(*) FILTER (police_presence) AS flagged, "
    "CAST(count(*) FILTER (police_presence) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rate FROM pres WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2",
)
_TOUCH = "abs(a.cell_lat - b.cell_lat) <= 1 AND abs(a.cell_lon - b.cell_lon) <= 1 AND (a.cell_lat <> b.cell_lat OR a.cell_lon <> b.cell_lon)"
CHECKS["presence_spatial_lag"] = with_(rep, pres, _CELLS) + (
    f"SELECT a.cell_lat, a.cell_lon, a.events, a.flagged, count(b.rate) AS neighbours, round(avg(b.rate), 9) AS lag "
    f"FROM cells a LEFT JOIN cells b ON {_TOUCH} GROUP BY 1, 2, 3, 4"
)
CHECKS["presence_morans_i"] = with_(
    rep, pres, _CELLS,
    ("z", "SELECT *, rate - (SELECT avg(rate) FROM cells) AS z FROM cells"),
    ("k", f"SELECT a.cell_lat, a.cell_lon, count(*) AS k, sum(a.z * b.z) AS zz FROM z a JOIN z b ON {_TOUCH} GROUP BY 1, 2"),
    ("t", "SELECT CAST(sum(k) AS DOUBLE) AS w, sum(zz) AS c, CAST(sum(k * k) AS DOUBLE) AS q FROM k"),
    ("v", "SELECT count(*) AS cells, CAST(count(*) AS DOUBLE) AS n, sum(z * z) AS v FROM z"),
    ("m", "SELECT cells, CAST(w AS BIGINT) AS pairs, n * c / (w * v) AS i, -1.0::DOUBLE / (n - 1) AS e, "
          "(n * n * 2 * w - n * 4 * q + 3 * w * w) / (w * w * (n * n - 1)) AS s FROM t, v"),
) + "SELECT cells, pairs, round(i, 6) AS morans_i, round(e, 6) AS expected, round((i - e) / sqrt(s - e * e), 6) AS z_score FROM m"
_VERSIONS = (
    "versions",
    "SELECT concat('EVT', CAST(o_orderkey AS VARCHAR)) AS event_id_cnty, o_orderkey % 4 + 1 AS round, CASE WHEN o_orderkey % 2 = 0 THEN 'left_only' ELSE 'right_only' END AS corrected "
    "FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT concat('EVT', CAST(o_orderkey AS VARCHAR)), o_orderkey % 4 + 3, 'unknown' FROM orders WHERE o_orderkey % 6 = 0",
)
CHECKS["labels_after_two_rounds"] = with_(
    *PARTISAN, _VERSIONS, ("last", f"SELECT {ID}, max_by(corrected, round) AS corrected FROM versions WHERE round <= 2 GROUP BY 1")
) + f"SELECT {ID}, coalesce(corrected, event_partisan_type) AS event_partisan_type FROM typed LEFT JOIN last USING ({ID})"
CHECKS["accuracy_by_round"] = with_(
    *PARTISAN, _VERSIONS,
    ("last", f"SELECT {ID}, max_by(corrected, round) AS l FROM versions GROUP BY 1"),
    ("told", f"SELECT {ID}, event_partisan_type AS was, coalesce(l, CASE WHEN CAST(substring({ID}, 4) AS BIGINT) % 10 <> 0 THEN event_partisan_type ELSE 'centre_only' END) AS truth FROM typed LEFT JOIN last USING ({ID})"),
    ("rounds", "SELECT DISTINCT CAST(round AS BIGINT) AS round FROM versions UNION SELECT 0"),
    ("known", f"SELECT rounds.round, v.{ID}, max_by(v.corrected, v.round) AS now FROM rounds JOIN versions v ON v.round <= rounds.round GROUP BY 1, 2"),
) + (
    f"SELECT r.round, count(*) AS n, count(*) FILTER (coalesce(now, was) = truth) AS \"right\", "
    f"round(CAST(count(*) FILTER (coalesce(now, was) = truth) AS DOUBLE) / count(*), 9) AS accuracy "
    f"FROM rounds r CROSS JOIN told LEFT JOIN known ON known.round = r.round AND known.{ID} = told.{ID} GROUP BY 1"
)
CHECKS["error_terms"] = with_(
    ("words", token_sql("documents", "doc_id")),
    ("judged", "SELECT doc_id, CAST(n_chars >= 600 AS INT) <> quality AS wrong FROM documents JOIN labels USING (doc_id)"),
    ("c", "SELECT word, count(*) FILTER (wrong) AS n_wrong, count(*) FILTER (NOT wrong) AS n_right FROM (SELECT DISTINCT doc_id, word FROM words) JOIN judged USING (doc_id) GROUP BY 1"),
    ("t", "SELECT count(*) FILTER (wrong) AS w, count(*) FILTER (NOT wrong) AS r FROM judged"),
) + (
    "SELECT word, n_wrong, n_right, round(ln(CAST(n_wrong + 0.5 AS DOUBLE) / CAST(n_right + 0.5 AS DOUBLE)) - ln(CAST(w - n_wrong + 0.5 AS DOUBLE) / CAST(r - n_right + 0.5 AS DOUBLE)), 6) AS log_odds "
    "FROM c, t WHERE n_wrong + n_right >= 5 ORDER BY log_odds DESC, word LIMIT 20"
)
CHECKS["next_to_code"] = (
    "SELECT doc_id, lang, source, doubt, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doubt DESC, doc_id) AS place FROM "
    "(SELECT doc_id, lang, source, round(1 - 2 * abs(CAST(n_chars AS DOUBLE) / (n_chars + CAST(600 AS DOUBLE)) - CAST(0.5 AS DOUBLE)), 6) AS doubt FROM documents "
    "WHERE n_chars IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels))) WHERE place <= 5"
)

CHECKS["labels_by_rule_index"] = with_(
    ("rules", "SELECT ['left', 'right', 'centre'][CAST(floor(c_custkey / 3) AS BIGINT) % 3 + 1] AS label, "
              "CASE c_custkey % 5 WHEN 3 THEN 'eq' WHEN 2 THEN 'regex_not' ELSE 'regex' END AS kind, "
              "CASE c_custkey % 5 WHEN 0 THEN concat(right(lower(c_name), 6), '|zz', c_custkey) WHEN 1 THEN concat('stomer#0+', c_custkey, ' ') "
              "WHEN 2 THEN right(lower(c_name), 7) WHEN 3 THEN c_name ELSE concat('^customer#[0-9]*', right(lower(c_name), 5), ' .*r') END AS pattern "
              "FROM customer WHERE c_custkey % 3 = 0 "
              "UNION ALL SELECT 'centre', 'regex', 'supplier#0+(1|2)[0-9]$' UNION ALL SELECT 'left', 'regex', '[xyz]{2}|q.'"),
    ("names", "SELECT concat_ws(' ', c_name, p_name) AS actor_clean FROM customer JOIN part ON c_custkey = p_partkey "
              "UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part"),
    ("hits", "SELECT DISTINCT actor_clean, label FROM names, rules WHERE actor_clean <> '' AND CASE kind WHEN 'eq' THEN actor_clean = pattern "
             "WHEN 'regex_not' THEN regexp_matches(lower(actor_clean), pattern) AND NOT regexp_matches(lower(actor_clean), 'red|wid') "
             "ELSE regexp_matches(lower(actor_clean), pattern) END"),
    ("f", "SELECT actor_clean, CAST(coalesce(bool_or(label = 'left'), false) AS INT) AS l, CAST(coalesce(bool_or(label = 'right'), false) AS INT) AS r, "
          "CAST(coalesce(bool_or(label = 'centre'), false) AS INT) AS c FROM names LEFT JOIN hits USING (actor_clean) WHERE actor_clean IS NOT NULL GROUP BY 1"),
) + 'SELECT actor_clean, l AS "left", r AS "right", c AS centre, 1 - greatest(l, r, c) AS unknown FROM f'
