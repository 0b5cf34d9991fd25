from collections import Counter

from rallylens.functions.stem import stem
from rallylens.operators import tokens

# Examples printed with the published algorithm.
EXAMPLES = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre
plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size
hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi
sky:sky relational:relat conditional:condit rational:ration digitizer:digit radicalli:radic
vietnamization:vietnam operator:oper feudalism:feudal decisiveness:decis hopefulness:hope
callousness:callous sensibiliti:sensibl triplicate:triplic formative:form electrical:electr
goodness:good revival:reviv allowance:allow airliner:airlin adjustable:adjust replacement:replac
adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ effective:effect
probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener
oscillators:oscil""".split()


def test_published_examples(spark):
    df = spark.createDataFrame([e.split(":") for e in EXAMPLES], "word string, want string")
    wrong = df.withColumn("got", stem("word")).where("got <> want").collect()
    assert wrong == []


def test_frequent_words_never_meet_the_vocabulary(spark, monkeypatch):
    """A vocabulary too large to send out is joined by shuffle for rare words only; doc ids repeat or are null."""
    docs = [(k % 7 if k % 5 else None, w) for k in range(200) for w in ("running", "runs", f"word{chr(97 + k % 26)}s", f"rare{'x' * (k % 40)}ing")]
    words = spark.createDataFrame(docs, "doc long, word string")
    monkeypatch.setattr(tokens, "fits_broadcast", lambda *a: False)
    monkeypatch.setattr(tokens, "FREQUENT", 40)
    got = tokens.stemmed_counts(words, ["doc"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and plan.count("Join ") == 3
    stems = {r.word: r.stem for r in tokens.stem_vocabulary(words).collect()}
    assert stems["running"] == stems["runs"] == "run"
    assert {(r.doc, r.stem): r.n for r in got.collect()} == Counter((d, stems[w]) for d, w in docs)
    monkeypatch.undo()
    few = tokens.stemmed_counts(words, ["doc"])
    assert sorted(map(str, few.collect())) == sorted(map(str, got.collect()))
