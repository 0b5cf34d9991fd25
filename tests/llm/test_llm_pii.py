import re

from pyspark.sql import functions as F

from rallylens.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def confirmed(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if confirmed(k, m.group())]


TEXTS = [
    None, "", "é a@b.c_y@d.e +1 (456) 555-2186 4111 1111 1111 1111", "1.2.3.4.5.6.7.8 300.1.2.3.4 0001.2.3.255", "4111-1111-1111-1111-1 41111111 11111111",
    "ééé +12 345 6789- +1 +12345678901234567", "a@b a@b.c.d.e@f.g x@@y.z", "1.2.3.4 " * 500, "é x@y.zz\n" * 300, "9" * 5000, ("a." * 3000) + "@x" + ".y" * 3000,
]


def test_base_spans_are_those_of_the_patterns(spark, documents):
    docs = documents([(i, t, "en", None) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None, None)])
    rows = pii.find(docs).select("doc_id", pii.named(F.filter("spans", lambda s: s["kind"].isin(pii.BASE))).alias("s")).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert [s for s in r.s.split(",") if s] == base_spans(TEXTS[r.doc_id]), r.doc_id


def test_added_kinds_need_checksum_or_context(documents):
    texts = ["DE89 3704 0044 0532 0130 00 And", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "no 123-45-6789", "ssn 000-45-6789"]
    rows = pii.find(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.stop) for s in r.spans] for r in rows] == [[("iban", 0, 27)], [], [("ssn", 4, 15)], [], []]


def test_redaction_masks_overlaps_once_and_keeps_columns(documents):
    docs = documents([(1, "é +1.2.3.45678 a@b.c!", "en", "s"), (2, None, "en", "s"), (3, "plain", None, None), (4, "", "en", "s")])
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[1].text in ("é [PHONE] [EMAIL]!", "é +[IP] [EMAIL]!")
    assert rows[2].text is None and rows[3].text == "plain" and rows[4].text == ""
    assert pii.redact(docs).columns == docs.columns and rows[3].spans == "y"


def test_empty_table(empty):
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []


def spans_of(documents, texts):
    rows = pii.find(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    return [[(s.kind, t[s.start : s.stop]) for s in r.spans] for r, t in zip(rows, texts)]


def test_account_number_before_capitals_or_digits(documents):
    good, other = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    texts = [
        f"{good} BIC COBADEFFXXX", f"{good} 2024", f"{good} {other} OK", f"XX12 {good}", f"{good.replace(' ', '')} 2024 A", f"é {good}", f"{good}X", f"{good} {good} BIC", f"AB12 CD34 {other}",
    ]
    want = [[good], [good], [good, other], [good], [good.replace(" ", "")], [good], [], [good, good], [other]]
    assert spans_of(documents, texts) == [[("iban", v) for v in values] for values in want]
    masked = pii.redact(documents([(1, texts[0], "en", "s")])).first().text
    assert masked == "[IBAN] BIC COBADEFFXXX"


def test_context_reaches_over_other_matches(documents):
    first, second = "123-45-6789", "234-56-7890"
    texts = [
        f"SSN: {first}, {second}", f"{first}, {second} is the ssn", f"{first} " * 30 + "ssn", f"ssn {'x' * 37}{first}", f"ssn {'x ' * 18} {first}", f"ssn {'x ' * 16} {first}",
    ]
    got = spans_of(documents, texts)
    assert got[:2] == [[("ssn", first), ("ssn", second)]] * 2
    assert got[2] == [("ssn", first)] * 4
    whole = [m for t in texts for m in re.finditer(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", t) if re.search("(^|[^a-z])ssn", (t[max(m.start() - 40, 0) : m.start()] + " " + t[m.end() : m.end() + 40]).lower())]
    assert sum(map(len, got)) == len(whole)


def test_sql_follows_the_operator_on_numbers_behind_words_years_and_headings(spark, documents, tmp_path):
    import duckdb

    from check_queries import normal
    from rallylens.llm import checks, registry

    texts = [
        "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 in 2024", "GB82 WEST 1234 5698 7654 32 2024 and DE89 3704 0044 0532 0130 00",
        "SSN: 123-45-6789, 234-56-7890", "123-45-6789 alone", "x" * 50 + " ssn 123-45-6789", "ssn " + "x" * 50 + " 123-45-6789", "GB82WEST12345698765433", "é DE89 3704 0044 0532 0130 00é", None, "",
        "mail a@b.co, 10.0.0.1, +49 30 123456, 4111 1111 1111 1111",
    ]
    documents([(i, t, "en", "s") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    made = registry.op1_pii(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = db.execute(checks.PII)
    rows = [tuple(r) for r in made.collect()]
    assert normal(made.columns, rows) == normal([c[0] for c in result.description], result.fetchall())
    told = {r[0]: r[-1] for r in rows}
    assert told[0] == "iban:0:27" and told[3].count("ssn") == 2 and "ssn" not in told[4] and "ssn" not in told[6] and told[2].count("iban") == 2
