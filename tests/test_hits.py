import dataclasses

from pyspark.sql import functions as F

from privacyframes.functions.columns import accepted, luhn_check, verhoeff_check
from privacyframes.functions.detect import findings
from privacyframes.functions.recognizers import DEFAULT, Recognizer, named
from privacyframes.operators import chunks as C
from privacyframes.functions.text import utf8_text
from privacyframes.operators.governance import incremental_sanitize
from privacyframes.operators.sanitization import sanitize_nested
from privacyframes.operators.detection import attach_hits, document_summaries, parse_model_reply

HIT = "array<struct<start:int,end:int,label:string,score:double>>"
LATE = "array<struct<start:int,end:int,entity_type:string,value:string>>"


def run(spark, text, external=None, late=None, **options):
    df = spark.createDataFrame([(text, external or [], late or [])], f"t string, e {HIT}, l {LATE}")
    found = findings("t", external=F.col("e"), late=F.col("l"), **options)
    return [(f.start, f.end, f.entity_type, f.score, f.source) for f in df.select(found.alias("f")).first().f]


def test_external_hits_come_first(spark):
    text = "write to a.b@c.co about Surat city"
    assert run(spark, text, [(9, 17, "EMAIL_ADDRESS", 0.9)]) == [(9, 17, "EMAIL_ADDRESS", 0.9, "presidio")]
    assert run(spark, text, [(9, 17, "EMAIL_ADDRESS", 0.69)])[0][3] == 0.5
    assert run(spark, text, [(24, 34, "LOCATION", 0.8)])[1] == (24, 34, "IN_ADDRESS", 0.8, "presidio")
    # Too short for an address, and an unmapped label without rules.
    assert len(run(spark, text, [(24, 29, "LOCATION", 0.8)])) == 1
    assert run(spark, text, [(24, 29, "ORG", 0.8)])[1][2] == "ORG"


def test_late_hits(spark):
    text = "write to a.b@c.co about Surat city"
    assert run(spark, text, late=[(24, 29, "CITY", "")])[1] == (24, 29, "CITY", 0.6, "llm")
    assert len(run(spark, text, late=[(-1, 3, "CITY", ""), (5, 5, "CITY", ""), (30, 35, "CITY", "x")])) == 1
    # Same rank and entity, higher score: only a span not yet seen may win.
    assert run(spark, text, late=[(9, 17, "EMAIL_ADDRESS", "")])[0][4] == "regex"
    assert run(spark, text, late=[(9, 16, "EMAIL_ADDRESS", "")])[0][:2] == (9, 16)


def test_late_hit_seen_but_lost_stays_out(spark):
    # The card's inner 12 digits are proposed as a number and lose; the same span must not come back.
    text = "4111 1111 1111 1111"
    assert [x[2] for x in run(spark, text, late=[(0, 14, "IN_AADHAAR", "")])] == ["CREDIT_CARD"]
    assert [x[2] for x in run(spark, text, late=[(0, 13, "IN_AADHAAR", "1111 1111 1111")])] == ["IN_AADHAAR"]


def test_scored_recognizers(spark):
    got = run(spark, "pan ABCDE1234F id 123456789012", use_scored=True)
    assert [(x[2], x[3]) for x in got] == [("IN_PAN", 0.8), ("IN_AADHAAR", 0.85)]


def test_custom_and_selected_recognizers(spark):
    code = Recognizer("CODE", "CODE", r"\bX-\d{3}\b", validator=lambda v: v != "X-000")
    df = spark.createDataFrame([("X-123 X-000 a@b.co 10.1.1.1",)], "t string")
    f = df.select(findings("t", recognizers=(*named("EMAIL_ADDRESS"), code)).alias("f")).first().f
    assert [x.value for x in f] == ["X-123", "a@b.co"]
    slow = tuple(dataclasses.replace(r, guard=None) for r in DEFAULT)
    assert df.select(findings("t", recognizers=slow) == findings("t")).first()[0]


def test_attach_hits_keeps_chunks_without_hits(spark):
    chunks = spark.createDataFrame([(1, 0, "Asha lives in Surat"), (2, 0, "none")], "doc_id int, chunk_ord int, text string")
    hits = spark.createDataFrame(
        [(1, 0, 2, 14, 19, "ORG", 0.9, "", 1), (1, 0, 1, 0, 4, "PERSON", 0.9, "", 1), (1, 0, 1, 14, 19, "CITY", 0.0, "", 2)],
        "doc_id int, chunk_ord int, hit_no int, start int, end int, label string, score double, value string, stage int",
    )
    rows = {r.doc_id: r for r in attach_hits(chunks, hits, ["doc_id", "chunk_ord"]).collect()}
    assert [h.label for h in rows[1].external_hits] == ["PERSON", "ORG"] and len(rows[1].late_hits) == 1
    assert rows[2].external_hits is None


def test_model_reply(spark):
    replies = [
        ('```json\n[{"start": 1, "end": 3, "entity_type": " X ", "value": "ab"}]\n```', [(1, 3, "X", "ab")]),
        ('[{"start": "1", "end": 3, "entity_type": "X"}, {"end": 3}]', [(1, 3, "X", "")]),
        ('{"start": 1}', []),
        ("", []),
        (None, []),
        ("[1, 2", []),
        ('\n [{"start": 1, "end": 5, "entity_type": "A"}]', [(1, 5, "A", "")]),
        ('[1, {"start": 1, "end": 5, "entity_type": "A"}, null]', [(1, 5, "A", "")]),
        ('[{"start": 1.0, "end": 5.9, "entity_type": "A", "value": null}]', [(1, 5, "A", "None")]),
        ('[{"start": 1, "end": 5, "entity_type": "A"}] trailing', []),
        ('[{"start": "1.5", "end": 2, "entity_type": "A"}, {"start": true, "end": "7", "entity_type": 3}]', [(1, 7, "3", "")]),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(replies)], "i int, r string")
    for r in df.select("i", parse_model_reply(F.col("r")).alias("h")).collect():
        assert [tuple(x) for x in (r.h or [])] == replies[r.i][1], replies[r.i]


def test_column_validators(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "236"), ("0000000000000", "237")], "c string, v string")
    a, b = df.select(luhn_check("c").alias("l"), verhoeff_check("v").alias("v"), accepted(F.lit("CREDIT_CARD"), "c").alias("a")).collect()
    assert (a.l, a.v, a.a) == (True, True, True) and (b.l, b.v, b.a) == (False, False, False)


def test_one_document_with_most_chunks(spark):
    chunks = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("a@b.co and Asha Mehta").alias("text")
    )
    docs = chunks.select("doc_id").distinct().unionByName(spark.createDataFrame([(-1,)], "doc_id long"))
    got = {r.doc_id: r for r in document_summaries(docs, chunks, "doc_id").filter("doc_id < 2").collect()}
    assert got[1].summary == {"EMAIL_ADDRESS": 2000, "PERSON_NAME": 2000} and got[1].pii_count == 4000
    assert got[-1].summary == {} and got[-1].pii_count == 0


def test_pages_and_payloads(spark):
    pages = spark.createDataFrame([(1, 2, " a@b.co \n"), (1, 1, "  "), (1, 3, "end")], "doc_id int, page int, text string")
    codes = spark.createDataFrame([(1, 1, 1, "plain"), (1, 1, 2, "x@y.zz"), (1, 2, 1, " q@r.ss")], "doc_id int, page int, payload_no int, text string")
    row = C.sanitize_pages(pages, codes, "mask").first()
    assert row.sanitized_text == "[QR_2] x***@y.zz\n\na***@b.co\n[QR_1] q***@r.ss\n\nend" and row.pii_count == 3


def test_box_scale(spark):
    df = spark.createDataFrame([(10, 20, 0, 5)], "left int, top int, width int, height int")
    r = C.scale_boxes(df, C.page_scale(F.lit(50.0), F.lit(100)), C.page_scale(F.lit(9.0), F.lit(0))).first()
    assert (r.x0, r.y0, r.x1, r.y1) == (5.0, 180.0, 5.5, 225.0)


def test_bad_bytes_go_and_real_replacement_characters_stay(spark):
    raw = ["41efbfbd42ff", "41efb79042ff", "e282efbfbd41", "ffefb790efb791"]
    df = spark.createDataFrame([(bytes.fromhex(x),) for x in raw], "b binary")
    got = [r.t for r in df.select(utf8_text(F.col("b")).alias("t")).collect()]
    assert got == [bytes.fromhex(x).decode("utf-8", "ignore") for x in raw]


def test_a_table_without_strings_has_no_findings(spark):
    row = sanitize_nested(spark.createDataFrame([(1, [2])], "a int, b array<int>")).first()
    assert (row.a, row.summary, row.pii_count) == (1, {}, 0)


def test_an_unknown_mode_does_not_stop_the_others(spark):
    files = spark.createDataFrame([(1, "a.txt", "mask", "h", "a@b.co"), (2, "b.txt", "wrong", "h", "a@b.co")], "id long, filename string, sanitization_mode string, file_sha256 string, text string")
    stored = spark.createDataFrame([], "id long, cache_key string, mode string, sanitized_text string, summary map<string,bigint>, pii_count long")
    got = {r.id: r for r in incremental_sanitize(files, stored).collect()}
    assert got[1].pii_count == 1 and (got[2].sanitized_text, got[2].pii_count, got[2].mode) == (None, None, "wrong")
