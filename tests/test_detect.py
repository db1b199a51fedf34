import dataclasses
import random
import time

import pytest
from pyspark.sql import functions as F

import model
from privacyframes.functions import recognizers
from privacyframes.functions.detect import candidates, findings
from privacyframes.functions.recognizers import DEFAULT
from privacyframes.functions.mask import sanitize_struct

FRAGMENTS = """आधार: 1234 5678 9012|આધાર 123456789012|पैन: ABCDE1234F|PAN ABCDE1234F|પાન-abcde1234f|मोबाइल: +91 9876543210
ફોન 9876543210|સંપર્ક: 9876543210|जन्म तिथि: 01/02/1990|જન્મ તારીખ 1-2-1990|पता: 12 गांधी रोड अहमदाबाद|સરનામું: ૧૨ મહાત્મા માર્ગ
पिन 380001|PIN: 380001|Pincode-380001|પિનકોડ: 380001|12 नगर|सड़क|रोड़ा|é|ß|ñame|José Díaz|१२३४|９８|٣| |\x1f|\t|\n|_|-|+91|‍|ſt 12 Ave
a.b@c.co|user1@okaxis|9876543210|+91-9876543210|10.1.2.3|999.1.1.1|ABCDE1234F|2345 6789 0123|VID 12345678-90123456|DOB: 01/02/1990
born 12 March 1990|Date of Birth 3 may 2001|Asha Mehta|Face Template|12 Market Road|7 the fast lane|Address: somewhere far|addreſs here it is long
380001|4111 1111 1111 1111 |4000-0000-0000-0002|M1234567|q1234567|12345678901234|HDFC0123456|android-abc123|ios-123456|fp_hash_abcdef|face_tmp_123456
HDFC  Bank|SBI Bank|Delhi|john|२ नगर में|KOTAK bank|vİd 1234 5678 9012 3456|ıos-abcdef|.x@y.org|%a+b@c-d.com|0000 0000 0000 0000|12 34|😀|𝟗876543210|PIN१२३४५६"""


def corpus(n, seed=7):
    rng = random.Random(seed)
    parts = [p for line in FRAGMENTS.split("\n") for p in line.split("|")]
    return [rng.choice(["", " ", "\n", ", "]).join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(n)]


def as_tuples(found):
    return [(f.start, f.end, f.entity_type, f.value) for f in found]


GOLDEN = [
    ("4111 1111 1111 1111 ok", [(0, 20, "CREDIT_CARD")], "411111******1111ok"),
    ("+919876543210", [(1, 13, "IN_AADHAAR")], "+XXXX XXXX 3210"),
    ("x+91 9876543210", [(1, 15, "PHONE_NUMBER")], "x**********10"),
    ("born 01/02/1990", [(4, 15, "DATE_OF_BIRTH")], "bornXX/XX/1990"),
    ("D.O.B: 01/02/1990", [], "D.O.B: 01/02/1990"),
    ("DOB - 01-02-1990", [], "DOB - 01-02-1990"),
    ("380001", [], "380001"),
    ("PIN 380001", [(0, 10, "IN_ADDRESS")], "P** 380001"),
    ("VID: 1234 5678 9012 3456", [(5, 19, "IN_AADHAAR")], "VID: XXXX XXXX 9012 3456"),
    ("999.1.1.1", [], "999.1.1.1"),
    ("0000 0000 0000 0000", [(0, 14, "IN_AADHAAR")], "XXXX XXXX 0000 0000"),
    ("", [], ""),
]
DEMO = (
    "﻿CREATE TABLE users (id INT, name TEXT, email TEXT);\n"
    "INSERT (ip_address, address)\nVALUES ('Rahul Sharma', 'rahul.sharma@example.com', '+91 9876543210', "
    "'ABCDE1234F', '1234 5678 9012', '192.168.10.25', '221B Baker Street');"
)


def test_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "i int, t string")
    for r in df.select("i", sanitize_struct("t").alias("s")).collect():
        text, spans, masked = GOLDEN[r.i]
        assert [(f.start, f.end, f.entity_type) for f in r.s.findings] == spans, text
        assert r.s.sanitized == masked


def test_demo_masks(spark):
    df = spark.createDataFrame([(DEMO,)], "t string")
    out = df.select(sanitize_struct("t").sanitized.alias("s")).first().s
    for want in ["R**** S*****", "r***@example.com", "+91 ********10", "AB****4F", "XXXX XXXX 9012", "192.168.***.***",
                 "221B B**** S*****", "a****** a******"]:
        assert want in out


def test_null_text(spark):
    row = spark.createDataFrame([(None,)], "t string").select(
        findings("t").alias("f"), sanitize_struct("t").alias("s")
    ).first()
    assert row.f == [] and row.s is None


@pytest.mark.parametrize("strict", [False, True])
def test_mixed_script_matches_model(spark, strict):
    texts = corpus(4000)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = df.select("i", findings("t", strict_aadhaar=strict).alias("f")).collect()
    for r in got:
        assert as_tuples(r.f) == model.spans(texts[r.i], strict), repr(texts[r.i])


def test_guards_change_nothing(spark):
    import dataclasses

    bare = tuple(dataclasses.replace(r, guard=None) for r in recognizers.DEFAULT)
    df = spark.createDataFrame([(t,) for t in corpus(3000, seed=11)], "t string").repartition(8)
    diff = df.filter(candidates("t") != candidates("t", recognizers=bare)).count()
    assert diff == 0


@pytest.mark.parametrize("mode", ["mask", "redact", "tokenize"])
def test_sanitize_matches_model(spark, mode):
    texts = corpus(2500, seed=3)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    for r in df.select("i", sanitize_struct("t", mode).sanitized.alias("s")).collect():
        assert r.s == model.sanitize(texts[r.i], mode), repr(texts[r.i])


@pytest.mark.parametrize("table,col", [("documents", "text"), ("pages", "html"), ("conversations", "text")])
def test_tables_match_model(spark, sf, table, col):
    df = spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(col).alias("t")).repartition(8)
    for r in df.select("t", sanitize_struct("t").alias("s")).collect():
        assert as_tuples(r.s.findings) == model.spans(r.t)
        assert r.s.sanitized == model.sanitize(r.t, "mask")


def test_long_document_uses_block_scan(spark):
    text = "Asha Mehta wrote a.b@c.co from 10.1.2.3; " * 2000
    r = spark.createDataFrame([(text,)], "t string").select(sanitize_struct("t", "tokenize").alias("s")).first()
    assert as_tuples(r.s.findings) == model.spans(text)
    assert r.s.sanitized == model.sanitize(text, "tokenize")


@pytest.mark.parametrize("kind", ["12 ab ", "12 34 ", "a.b", "12 road x "])
def test_long_runs_cost_what_prose_costs(spark, kind):
    """A line of 400,000 characters in which a pattern could start everywhere; it took hours when every start read to the end."""
    line = (kind * 400_000)[:400_000] + " street"
    began = time.monotonic()
    spark.createDataFrame([(line,)], "text string").select(findings("text")).collect()
    assert time.monotonic() - began < 40


def test_skipped_runs_hide_nothing(spark):
    """The same findings with and without skipping, on texts in which digits, words and line breaks meet at the ends of runs."""
    random_ = random.Random(5)
    words = ["12", "345", "ab", "Road", "St", "Nagar", "x,", "-", "é", "\n", "  ", "99999", "7\n", "Roadé", "1", "a@b.co", "me@ybl", "@", "a.b" * 30, "\t"]
    rows = [(i, " ".join(random_.choice(words) + (random_.choice(words) if random_.random() < 0.1 else "") for _ in range(random_.randint(1, 40)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, text string")
    skipping = [r for r in DEFAULT if r.skip]
    plain = [dataclasses.replace(r, skip=None, guard=None) for r in skipping]
    got = df.select(findings("text", recognizers=skipping).alias("a"), findings("text", recognizers=plain).alias("b")).collect()
    assert all(r.a == r.b for r in got) and any(r.a for r in got)


def test_function_recognizers_stand_in_the_order_given(spark):
    """Equal spans go to the earlier recogniser; hits out of the text are dropped; a rule of the entity is checked unless it says not to."""
    from pyspark.sql import functions as F

    from privacyframes.functions.detect import findings, resolution
    from privacyframes.functions.mask import sanitize, sanitize_cells
    from privacyframes.functions.recognizers import DEFAULT, FUNCTION_HITS, FunctionRecognizer, named

    def hit(start, end, entity=None, score=None):
        return F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(entity).cast("string").alias("entity_type"), F.lit(score).cast("double").alias("score"))

    mail = lambda t: F.array(hit(3, 9), hit(-1, 4), hit(4, 400), hit(5, 5))
    early = FunctionRecognizer("early", "EMAIL_ADDRESS", mail, source="early")
    df = spark.createDataFrame([("to a@b.co now",), (None,), ("",)], "text string")

    def found(*recognizers, **options):
        rows = df.select(findings("text", recognizers=recognizers, **options).alias("f")).collect()
        return [[(x.start, x.end, x.entity_type, x.score, x.value, x.source) for x in r.f] for r in rows]

    patterns = named("EMAIL_ADDRESS")
    assert found(early, *patterns) == [[(3, 9, "EMAIL_ADDRESS", 0.5, "a@b.co", "early")], [], []]
    assert found(*patterns, early) == [[(3, 9, "EMAIL_ADDRESS", 0.5, "a@b.co", "regex")], [], []]
    card = FunctionRecognizer("card", "CREDIT_CARD", lambda t: F.array(hit(3, 9, None, 0.9)))
    assert found(card) == [[], [], []]
    loose = FunctionRecognizer("card", "CREDIT_CARD", lambda t: F.array(hit(3, 9, None, 0.9)), checked=False)
    assert found(loose, *DEFAULT)[0] == [(3, 9, "CREDIT_CARD", 0.9, "a@b.co", "custom")]

    @F.pandas_udf(FUNCTION_HITS)
    def now(texts):
        return texts.map(lambda t: [{"start": t.index("now"), "end": t.index("now") + 3, "entity_type": None, "score": None}] if "now" in t else None)

    udf = FunctionRecognizer("now", "TIME", now)
    assert df.select(sanitize("text", "redact", recognizers=(*DEFAULT, udf)).alias("s")).collect()[0].s == "to [REDACTED_EMAIL_ADDRESS] [REDACTED_TIME]"
    both = df.select(resolution("text", recognizers=(loose, *DEFAULT)).alias("r")).collect()[0].r
    assert [x.entity_type for x in both.unique] == ["CREDIT_CARD", "EMAIL_ADDRESS"] and [x.entity_type for x in both.kept] == ["CREDIT_CARD"]
    with pytest.raises(ValueError):
        sanitize_cells(F.array("text"), recognizers=(early,))
