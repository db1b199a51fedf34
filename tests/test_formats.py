import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

import model
from privacyframes.functions.mask import restore, sanitize_csv, sanitize_json, sanitize_struct
from privacyframes.operators.files import sanitize_files
from privacyframes.operators.sanitization import sanitize_columns, sanitize_nested, token_map
from privacyframes.sources import readers, writers


def csv_model(text, mode="mask"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for row in csv.reader(io.StringIO(text, newline="")):
        w.writerow([model.sanitize(c, mode) for c in row])
    return out.getvalue()


CSVS = [
    "",
    "a,b\n",
    "a,b",
    "a,",
    ",\n,",
    "\n\na\n",
    'name,note\n"Asha Mehta","call 9876543210, or a.b@c.co"\n"say ""hi""",x\r\ny,"two\nlines"\n',
    '""\n"",1\n',
    'mid"quote,"closed"tail,"open to the end\n a.b@c.co',
    "x;y\rz,10.1.2.3\r",
    "é,आधार: 1234 5678 9012\n",
    '"He said, Asha Mehta",   lead ,trail  \n',
]


def test_csv_text(spark):
    rng = random.Random(5)
    made = ["".join(rng.choices([",", "\n", '"', "a", " ", "a@b.co", "\r\n"], k=rng.randint(0, 9))) for _ in range(1500)]
    # A lone quote inside a later part of a quoted cell is read leniently by both.
    texts = CSVS + made
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    wrong = []
    for r in df.select("i", sanitize_csv("t").alias("s")).collect():
        if r.s.sanitized != csv_model(texts[r.i]):
            wrong.append((texts[r.i], r.s.sanitized, csv_model(texts[r.i])))
    assert not wrong, (len(wrong), wrong[:5])


def walk(v):
    if isinstance(v, str):
        return model.sanitize(v, "mask")
    if isinstance(v, list):
        return [walk(x) for x in v]
    return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v


def test_json_text(spark):
    docs = [
        {"a.b@c.co": "a.b@c.co", "n": 1.5, "deep": [{"x": ["Asha Mehta", None, True, "é \u0001 \\ \" 10.1.2.3"]}]},
        [],
        "Asha Mehta",
        {"long": "Asha Mehta\n" * 3000, "esc": "\\" * 20000},
    ]
    texts = [json.dumps(d, ensure_ascii=e, indent=i) for d in docs for e in (False, True) for i in (None, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", sanitize_json("t").alias("s")).collect():
        assert json.loads(r.s.sanitized) == walk(json.loads(texts[r.i]))


def test_mixed_files(spark):
    eicar = b"%PDF-1.4 \xff\xfe"
    rows = [
        (1, "a.txt", "mask", b"\xef\xbb\xbfAsha Mehta \xff a.b@c.co"),
        (2, "b.CSV", "redact", b"h,a.b@c.co\n"),
        (3, "c.json", "tokenize", b'{"k": "a.b@c.co", "a.b@c.co": 1}'),
        (4, "d.json", "mask", b"{broken"),
        (5, "e.pdf", "mask", eicar),
        (6, "noext", None, b"call 9876543210"),
        (7, "f.sql", "shred", b"x"),
        (8, "g.bin", "mask", bytes([0xFF, 0, 1, 2] * 40)),
    ]
    df = spark.createDataFrame(rows, "id int, filename string, sanitization_mode string, content binary")
    out = {r.id: r for r in sanitize_files(df, ["id"]).collect()}
    assert out[1].sanitized_text == "﻿A*** M****  a***@c.co" and out[1].pii_count == 2
    assert out[2].sanitized_text == "h,[REDACTED_EMAIL_ADDRESS]\n" and out[2].summary == {"EMAIL_ADDRESS": 1}
    assert out[3].sanitized_text == '{"k": "TOKEN_EMAIL_ADDRESS_0001", "a.b@c.co": 1}'
    assert out[4].error == "Invalid JSON" and out[4].sanitized_text is None
    assert out[5].error.startswith("Unsupported") and out[5].mode == "redact"
    assert out[6].parser == "generic_text" and out[6].sanitized_text == "call ********10"
    assert out[7].error == "Invalid mode: shred"
    assert out[8].error.startswith("Unsupported")


def test_csv_files_keep_header_as_data(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text('Asha Mehta,note\n"a, b",9876543210\n', encoding="utf-8")
    df = readers.read_csv_cells(spark, str(tmp_path / "in"))
    writers.write_csv(sanitize_columns(df.coalesce(1), "mask"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == 'A*** M****,note\n"a, b",********10\n'


def test_read_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfok\xff\xe2\x82 end")
    row = readers.read_text_documents(spark, str(tmp_path)).first()
    assert (row.filename, row.text) == ("a.txt", b"\xef\xbb\xbfok\xff\xe2\x82 end".decode("utf-8", errors="ignore"))


def test_columns_and_nested(spark):
    df = spark.createDataFrame(
        [(1, ("Asha Mehta", ["a.b@c.co", None]), {"Ravi Kumar": "Ravi Kumar"}, 5), (2, None, None, 6)],
        "id int, user struct<name:string,tags:array<string>>, attrs map<string,string>, n long",
    )
    one, two = sanitize_nested(df, "mask").orderBy("id").collect()
    assert one.user.name == "A*** M****" and one.user.tags == ["a***@c.co", None]
    assert one.attrs == {"Ravi Kumar": "R*** K****"} and one.n == 5 and one.pii_count == 3
    assert two.user is None and two.attrs is None and two.pii_count == 0
    flat = spark.createDataFrame([("a.b@c.co", 9876543210, None)], "s string, n long, `odd.name` string")
    assert sanitize_columns(flat).first() == ("a***@c.co", 9876543210, None)


def test_tokens_round_trip(spark):
    text = "a@b.co then Asha Mehta, c@d.co and a@b.co; 10.1.1.1 " * 40
    df = spark.createDataFrame([(1, text)], "id int, t string")
    s = df.select(sanitize_struct("t", "tokenize").alias("s"))
    assert s.select(restore(F.col("s.sanitized"), F.col("s.findings"), F.col("s.tokens"))).first()[0] == text
    vault = {r.token: r.original_value for r in token_map(df, ["id"], "t").collect()}
    assert vault == {
        "TOKEN_IP_ADDRESS_0001": "10.1.1.1",
        "TOKEN_EMAIL_ADDRESS_0002": "a@b.co",
        "TOKEN_EMAIL_ADDRESS_0003": "c@d.co",
        "TOKEN_PERSON_NAME_0004": "Asha Mehta",
    }


def test_mode_is_checked(spark):
    with pytest.raises(ValueError):
        sanitize_struct("t", "shred")
    df = spark.createDataFrame([("x", "shred")], "t string, m string")
    with pytest.raises(Exception, match="Invalid mode"):
        df.select(sanitize_struct("t", F.col("m"))).collect()


@pytest.mark.parametrize("mode", ["mask", "redact", "tokenize"])
def test_mode_column_equals_constant(spark, mode):
    df = spark.createDataFrame([("Asha Mehta a@b.co a@b.co",)], "t string")
    a = df.select(sanitize_struct("t", mode)).first()
    b = df.select(sanitize_struct("t", F.lit(mode))).first()
    assert a == b


def test_redact_is_idempotent(spark):
    df = spark.createDataFrame([("call 9876543210, card 4111111111111111",)], "t string")
    once = sanitize_struct("t", "redact")["sanitized"]
    r = df.select(once.alias("a")).select("a", sanitize_struct("a", "redact")["sanitized"].alias("b")).first()
    assert r.a == r.b == "call [REDACTED_PHONE_NUMBER], card [REDACTED_CREDIT_CARD]"
