import json

import pytest

from rallylens.sources import files
from rallylens.streaming.classify import classify, classify_new_files
from rallylens.rules import packs
from rallylens.sources.incidents import incidents

SCHEMA = "id int, country string, notes string"
ROWS = [
    (1, "France", 'a "quoted" line,\nand a second one \\ with backslash'),
    (2, "United Kingdom", None),
    (3, "France", "   padded "),
    (4, None, "NA in words"),
]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "t")
    files.write_table(df, path)
    assert sorted(map(tuple, files.read_table(spark, path, SCHEMA).collect())) == ROWS
    kept = files.read_table_keep_empty(spark, path, SCHEMA)
    assert {r.id: r.notes for r in kept.collect()}[2] == ""


def test_csv_partitions_and_row_bound(spark, tmp_path):
    df = spark.range(10).selectExpr("cast(id as int) id", "'x y' country", "'n' notes").coalesce(1)
    path = tmp_path / "t"
    files.write_table(df, str(path), ["country"], rows_per_file=4)
    parts = list((path / "country=x y").glob("*.csv"))
    assert len(parts) == 3
    assert files.read_table(spark, str(path), SCHEMA).count() == 10


def test_empty_and_na_are_missing(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,country,notes\n1,NA,\n2,,x\n")
    got = [tuple(r) for r in files.read_table(spark, str(path), SCHEMA).collect()]
    assert got == [(1, None, None), (2, None, "x")]


def test_responses(spark, tmp_path):
    for country, pages in {"France": [2, 1], "Spain": [1]}.items():
        folder = tmp_path / f"country_source={country}"
        folder.mkdir()
        for page, n in enumerate(pages):
            body = {"status": 200, "data": [{"id": 10 * page + i, "notes": "n"} for i in range(n)]}
            (folder / f"page{page}.json").write_text(json.dumps(body))
    (tmp_path / "country_source=Spain" / "page9.json").write_text('{"status": 500, "message": "no"}')
    got = files.read_responses(spark, str(tmp_path), "id int, notes string")
    assert sorted((r.country_source, r.id) for r in got.collect()) == [
        ("France", 0), ("France", 1), ("France", 10), ("Spain", 0),
    ]


def test_quoted_empty_is_missing_and_broken_rows_are_told(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,country,notes\n1,"",x\n2,Spain,y,too many\nno number,Spain,z\n3,Spain,ok\n')
    good, bad = files.read_table_checked(spark, str(path), SCHEMA)
    assert sorted(map(tuple, good.collect())) == [(1, None, "x"), (3, "Spain", "ok")]
    assert sorted(r[0] for r in bad.collect()) == ["2,Spain,y,too many", "no number,Spain,z"]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_table(spark, str(path), SCHEMA).collect()


def test_page_report(spark, tmp_path):
    lines = ['{"status": 200, "data": [{"id": 1}, {"id": 2}]}', '{"status": 200, "data": [{"id": 3}]}', '{"status": 200, "data": []}', '{"status": 500}', '{"status": 200, "da']
    (tmp_path / "year=2020").mkdir()
    (tmp_path / "year=2020" / "p.json").write_text("\n".join(lines))
    pages = files.response_pages(spark, str(tmp_path), "id int")
    row = files.page_report(pages, ["year"], 2).first()
    assert (row.pages, row.failed, row.broken, row.empty, row.short, row.events) == (5, 1, 1, 1, 1, 3)
    assert [r[0] for r in pages.where("rejected_record is not null").select("rejected_record").collect()] == [lines[-1]]


def test_sheet(spark, sf):
    sheet = files.coding_sheet(incidents(spark, sf))
    assert sheet.columns == [
        "country", "event_date", "interaction", "notes", "presence", "coercion", "arrest", "brutality",
    ]
    assert sheet.selectExpr("max(presence + coercion + arrest + brutality) m").first().m == 0


def test_stream_equals_batch(spark, sf, tmp_path):
    landing, output, progress = (str(tmp_path / n) for n in ("landing", "output", "progress"))
    events = incidents(spark, sf)
    files.land_pages(events.where("year < 1998"), landing)
    classify_new_files(spark, landing, output, progress, packs.SMALL_PACK).awaitTermination()
    events.where("year >= 1998").write.mode("append").partitionBy("country", "year").json(landing)
    classify_new_files(spark, landing, output, progress, packs.SMALL_PACK).awaitTermination()
    columns = ["event_id_cnty", "event_partisan_type", "presence_step", "police_presence"]
    streamed = spark.read.parquet(output).select(columns)
    batch = classify(events, packs.SMALL_PACK).select(columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
