"""The event table: its schema, and the view the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallylens.storage import spread

EVENT_SCHEMA = (
    "event_id_cnty string, event_date date, year int, country string, admin1 string, "
    "location string, latitude double, longitude double, event_type string, "
    "sub_event_type string, interaction string, actor1 string, actor2 string, "
    "assoc_actor_1 string, assoc_actor_2 string, fatalities int, notes string"
)
COUNTRIES = ("France", "Germany", "Italy", "Spain", "United Kingdom")

# Portable: the same text runs in Spark and in the SQL check.
INCIDENTS_SQL = """
SELECT
  concat('EVT', CAST(o_orderkey AS STRING)) AS event_id_cnty,
  CAST(o_orderdate AS DATE) AS event_date,
  CAST(year(o_orderdate) AS INT) AS year,
  CASE o_custkey % 5 WHEN 0 THEN 'France' WHEN 1 THEN 'Germany' WHEN 2 THEN 'Italy'
       WHEN 3 THEN 'Spain' ELSE 'United Kingdom' END AS country,
  CASE o_custkey % 6 WHEN 0 THEN 'England' WHEN 1 THEN 'Scotland' WHEN 2 THEN 'Wales'
       WHEN 3 THEN 'Northern Ireland' WHEN 4 THEN NULL ELSE 'Bavaria' END AS admin1,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL
       ELSE concat('loc', CAST(o_custkey % 40 AS STRING)) END AS location,
  40 + CAST(o_custkey % 48 AS DOUBLE) / 4 AS latitude,
  CAST(o_orderkey % 64 AS DOUBLE) / 4 - 5 AS longitude,
  'Protests' AS event_type,
  CASE o_orderstatus WHEN 'O' THEN 'Peaceful protest' WHEN 'F' THEN 'Protest with intervention'
       ELSE 'Excessive force against protesters' END AS sub_event_type,
  CASE o_orderkey % 5 WHEN 0 THEN 'State forces-Protesters' WHEN 2 THEN NULL
       WHEN 3 THEN 'Protesters-Protesters' ELSE 'Protesters only' END AS interaction,
  CASE o_orderkey % 7 WHEN 0 THEN 'Protesters (France)' WHEN 1 THEN 'Police Forces of France (2017-)'
       WHEN 2 THEN NULL WHEN 3 THEN 'members of Antifa [North];  BLM: Black Lives Matter'
       WHEN 4 THEN 'Government of France (2017-)' WHEN 5 THEN 'GJ: Yellow Vests'
       ELSE 'Green Tide;; Sea Watch ' END AS actor1,
  CASE o_orderkey % 9 WHEN 1 THEN 'National Rally' WHEN 2 THEN 'Rioters (Italy)'
       WHEN 3 THEN 'members of The Republicans; members of Antifa' ELSE NULL END AS actor2,
  CASE o_orderkey % 11 WHEN 0 THEN 'SOS Racism; Students (France)' WHEN 1 THEN 'Renaissance'
       WHEN 2 THEN 'Palestinian Group (France)' WHEN 3 THEN 'the Socialist Party; Labour Group (France)'
       WHEN 4 THEN 'Liberal Labour Club' ELSE NULL END AS assoc_actor_1,
  CASE o_orderkey % 17 WHEN 0 THEN 'Oxfam [Paris]' WHEN 5 THEN 'Farmers (France)' ELSE NULL END AS assoc_actor_2,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 3 END AS INT) AS fatalities,
  CASE o_orderkey % 17
    WHEN 0 THEN 'Police officers gathered outside the town hall.'
    WHEN 1 THEN 'People protest in the square against police brutality.'
    WHEN 2 THEN 'Marchers opposed the amendment on police custody rules.'
    WHEN 3 THEN 'Residents marched; no police intervention was noted.'
    WHEN 4 THEN 'Police used tear gas on the crowd.'
    WHEN 5 THEN 'Police on site later arrested protesters near the station.'
    WHEN 6 THEN 'Students walked under police presence.'
    WHEN 7 THEN 'Short'
    WHEN 8 THEN NULL
    WHEN 9 THEN concat('Police came', chr(10), 'and arrested protesters.')
    WHEN 10 THEN 'A JUSAPOL rally saw police cordon lines.'
    WHEN 11 THEN '12 people were ARRESTED BY POLICE after a sit-in.'
    WHEN 12 THEN 'Riot police were deployed near the socialist workers union.'
    WHEN 13 THEN 'Nationalist and patriotic groups waved socialist flags about Brexit.'
    WHEN 14 THEN 'Climate activists blocked a road, solidarity with a pharmacy.'
    WHEN 15 THEN '    '
    ELSE 'Farmers gathered in the centre to ask for higher prices.' END AS notes
FROM {orders}
"""


# Own phrases for the notes: number, text, whether the text stands alone.
PHRASES = (
    "Police officers gathered outside the town hall.",
    "People protest in the square against police brutality.",
    "Marchers opposed the amendment on police custody rules.",
    "Residents marched; no police intervention was noted.",
    "Police used tear gas on the crowd.",
    "Police on site later arrested protesters near the station.",
    "Students walked under police presence.",
    "Short",
    None,
    "Police came\nand arrested protesters.",
    "A JUSAPOL rally saw police cordon lines.",
    "12 people were ARRESTED BY POLICE after a sit-in.",
    "Riot police were deployed near the socialist workers union.",
    "Nationalist and patriotic groups waved socialist flags about Brexit.",
    "Climate activists blocked a road, solidarity with a pharmacy.",
    "    ",
    "Farmers gathered in the centre to ask for higher prices.",
    "A police union protested at the ministry.",
    "Some police dropped their handcuffs at the gate.",
    "Crowds demonstrated in the park against police tactics.",
    "The march denounced racism and police brutality.",
    "The plan would prohibit the publication of images from police custody.",
    "People spoke against the law on custody orders.",
    "There was no report of any police intervention.",
    "It ended without any police intervention.",
    "The police did not intervene.",
    "Police intervened after an hour.",
    "The police later removed several demonstrators.",
    "Officers dispersed the group.",
    "Water cannon were used at dusk.",
    "Police physically had to remove two men.",
    "Police blocked the main road.",
    "Police detained several protesters.",
    "Scuffles broke out with the police.",
    "A few clashed with police.",
    "Police charged at protesters.",
    "There was a baton charge.",
    "Several people were kettled.",
    "Police formed a thick cordon.",
    "The police were present all day.",
    "The march was escorted by police.",
    "A police escort led the way.",
    "Police monitored the rally.",
    "Police observed the rally.",
    "They don't like it, so they'd leave; it's late and he's tired.",
)


def _literal(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS STRING)"
    parts = ["'" + part.replace("'", "''") + "'" for part in text.split("\n")]
    return parts[0] if len(parts) == 1 else f"concat({', chr(10), '.join(parts)})"


def _phrase_rows() -> str:
    return ", ".join(f"({k}, {_literal(t)}, {int(t is None or len(t.strip()) < 10)})" for k, t in enumerate(PHRASES))


# Notes and names that only exist once tables are joined, so no rule can be
# worked out while a query is planned: phrases stand between whole texts of
# other tables, and names of suppliers join the names in the actor fields.
REPORTED_SQL = f"""
SELECT event_id_cnty, event_date, year, country, admin1, location, latitude, longitude, event_type, sub_event_type, interaction,
  CASE WHEN n % 3 = 0 AND s_name IS NOT NULL THEN concat(coalesce(actor1, 'Rioters'), '; ', s_name) ELSE actor1 END AS actor1,
  CASE WHEN n % 2 = 0 THEN coalesce(actor2, s_name)
       WHEN n % 8 = 3 THEN concat(CASE country WHEN 'France' THEN 'General Confederation' WHEN 'Germany' THEN 'Verdi' WHEN 'Italy' THEN 'CGIL'
         WHEN 'Spain' THEN 'Workers'' Commissions' ELSE 'UNISON' END, CASE WHEN s_name IS NULL THEN '' ELSE concat('; ', s_name) END)
       ELSE actor2 END AS actor2,
  CASE WHEN n % 5 = 0 AND s_name IS NOT NULL THEN concat('the ', s_name, ' [', sub_event_type, ']; ', coalesce(assoc_actor_1, '')) ELSE assoc_actor_1 END AS assoc_actor_1,
  CASE WHEN n % 7 = 1 AND s_name IS NOT NULL THEN concat(s_name, ' Group') ELSE assoc_actor_2 END AS assoc_actor_2,
  fatalities,
  CASE WHEN p.alone = 1 THEN p.phrase
       ELSE concat(CASE WHEN b.text IS NULL THEN '' ELSE concat(b.text, ' ') END, p.phrase,
                   CASE WHEN d.text IS NULL THEN '' ELSE concat(' ', d.text) END) END AS notes
FROM (SELECT *, CAST(substring(event_id_cnty, 4) AS BIGINT) AS n FROM ({INCIDENTS_SQL})) e
JOIN (VALUES {_phrase_rows()}) AS p(k, phrase, alone) ON e.n % {len(PHRASES)} = p.k
LEFT JOIN {{benchmark}} b ON b.item_id = e.n % 40
LEFT JOIN {{documents}} d ON d.doc_id = e.n
LEFT JOIN {{supplier}} s ON s.s_suppkey = e.n % 100 + 1
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over ``orders``; Spark prunes the columns a query does not use."""
    return spark.sql(INCIDENTS_SQL, orders=table(spark, sf_dir, "orders"))


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with long notes and many names, for the rules.

    The side tables are joined on their keys; the small ones are broadcast if
    the planner finds them small, and unused columns are never read.
    """
    used = {name: table(spark, sf_dir, name) for name in ("benchmark", "documents", "supplier")}
    return spark.sql(REPORTED_SQL, orders=spread(table(spark, sf_dir, "orders")), **used)
