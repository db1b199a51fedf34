"""Queries: masking, redaction, tokens, tables, nested records, multi-chunk documents, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.mask import csv_rows, mask_value, restore, sanitize_csv, sanitize_json, sanitize_struct
from ..operators import chunks as C
from ..operators.detection import findings_table
from ..operators.sanitization import sanitize_columns, sanitize_documents, sanitize_nested, token_map
from ..session import checkpoint_dir
from ..sources import readers, writers
from . import inputs, masks_sql, oracle
from .detection_queries import KEYS
from .inputs import DUCK_CORPUS, DUCK_TEXTS, table
from .registry import query

_MASKED = {
    "m01_mask_email": "EMAIL_ADDRESS",
    "m02_mask_phone": "PHONE_NUMBER",
    "m03_mask_aadhaar": "IN_AADHAAR",
    "m04_mask_vid": "IN_VID",
    "m05_mask_birth_date": "DATE_OF_BIRTH",
    "m06_mask_pan": "IN_PAN",
    "m07_mask_ip": "IP_ADDRESS",
    "m08_mask_address": "IN_ADDRESS",
    "m09_mask_bank_account": "BANK_ACCOUNT",
    "m10_mask_ifsc": "IFSC_CODE",
    "m11_mask_passport": "PASSPORT_NUMBER",
    "m12_mask_device": "DEVICE_ID",
    "m12_mask_fingerprint": "FINGERPRINT_TEMPLATE",
    "m12_mask_face": "FACE_TEMPLATE",
    "m13_mask_bank_name": "BANK_NAME",
    "m14_mask_card": "CREDIT_CARD",
    "m15_mask_upi": "UPI_ID",
    "m16_mask_person": "PERSON_NAME",
}


def _mask_query(name: str, entity: str) -> None:
    from ..functions import fixed
    from ..functions.recognizers import named
    from ..operators.detection import candidates_table

    labels = [label for label, _, _ in fixed.PATTERNS if fixed.LABEL_ENTITY.get(label, label) == entity]

    def run(spark, sf):
        hits = candidates_table(inputs.texts(spark, sf), KEYS, recognizers=named(*labels))
        masked = mask_value(F.lit(entity), "value")
        return hits.select("src", "doc_id", "start", "end", "value", masked.alias("masked"))

    sql = (
        f"with {oracle.candidates_cte(DUCK_TEXTS, labels)} select src, doc_id, \"start\", \"end\", value, "
        f"{masks_sql.mask(repr(entity), 'value')} as masked from hits"
    )
    query(name, sql)(run)


for _name, _entity in _MASKED.items():
    _mask_query(_name, _entity)


@query(
    "m16_mask_other",
    f"select c_custkey, v, {masks_sql.mask(repr('OTHER'), 'v')} as masked from (select c_custkey, substring(c_name, 9, cast(c_custkey % 6 + 1 as int)) as v from customer)",
)
def mask_other(spark, sf):
    v = F.substring("c_name", F.lit(9), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", v.alias("v"), mask_value(F.lit("OTHER"), v).alias("masked"))


# Splice: text between kept spans unchanged, spans replaced.
def _spliced(texts: str, replacement: str, scored: bool = False) -> str:
    """CTEs ending in ``clean`` (src, doc_id, sanitized_text, pii_count) for a (src, doc_id, text) select."""
    return (
        f"with recursive {oracle.candidates_cte(texts, scored=scored)},\n{oracle.resolve_cte()},\n"
        f"swapped as (select k.*, {replacement} as new, lag(\"end\", 1, 0) over (partition by src, doc_id order by \"start\") as prev from kept k),\n"
        "joined as (select s.src, s.doc_id, string_agg(substring(t.text, s.prev + 1, s.\"start\" - s.prev) || s.new, '' order by s.\"start\") as head, "
        "max(s.\"end\") as last_end, count(*) as n from swapped s join shaped t on s.src = t.src and s.doc_id = t.doc_id group by s.src, s.doc_id),\n"
        "clean as (select t.src, t.doc_id, coalesce(j.head, '') || substring(t.text, coalesce(j.last_end, 0) + 1) as sanitized_text, coalesce(j.n, 0) as pii_count "
        "from shaped t left join joined j on t.src = j.src and t.doc_id = j.doc_id)\n"
    )


_MASK = masks_sql.mask("entity_type", "value")
_REDACT = "'[REDACTED_' || entity_type || ']'"


def _token_sql(texts: str) -> str:
    """Token numbers counted from the right; equal (entity, value) share the first number."""
    return (
        f"with recursive {oracle.candidates_cte(texts)},\n{oracle.resolve_cte()},\n"
        "firsts_r as (select *, max(\"start\") over (partition by src, doc_id, entity_type, value) as lead from kept),\n"
        "numbered as (select *, dense_rank() over (partition by src, doc_id order by lead desc) as no from firsts_r),\n"
        "tokens as (select *, 'TOKEN_' || entity_type || '_' || lpad(cast(no as varchar), cast(greatest(4, length(cast(no as varchar))) as int), '0') as token from numbered),\n"
        "swapped as (select k.*, token as new, lag(\"end\", 1, 0) over (partition by src, doc_id order by \"start\") as prev from tokens k),\n"
        "joined as (select s.src, s.doc_id, string_agg(substring(t.text, s.prev + 1, s.\"start\" - s.prev) || s.new, '' order by s.\"start\") as head, "
        "max(s.\"end\") as last_end from swapped s join shaped t on s.src = t.src and s.doc_id = t.doc_id group by s.src, s.doc_id)\n"
    )


def _clean(df):
    return df.select("src", "doc_id", "sanitized_text", "pii_count")


@query("m17_redact", _spliced(DUCK_TEXTS, _REDACT) + "select src, doc_id, sanitized_text, pii_count from clean")
def redact(spark, sf):
    return _clean(sanitize_documents(inputs.texts(spark, sf), KEYS, mode="redact"))


@query(
    "m18_tokenize",
    _token_sql(DUCK_TEXTS)
    + "select t.src, t.doc_id, coalesce(j.head, '') || substring(t.text, coalesce(j.last_end, 0) + 1) as sanitized_text from shaped t left join joined j on t.src = j.src and t.doc_id = j.doc_id",
)
def tokenize(spark, sf):
    return sanitize_documents(inputs.texts(spark, sf), KEYS, mode="tokenize").select("src", "doc_id", "sanitized_text")


@query(
    "m19_token_map",
    _token_sql(DUCK_TEXTS) + "select distinct src, doc_id, token, entity_type, value as original_value from tokens",
)
def tokens(spark, sf):
    return token_map(inputs.texts(spark, sf), KEYS)


@query(
    "m19_round_trip",
    f"select src, doc_id, 'see TOKEN_EMAIL_ADDRESS_0001 and TOKEN_IN_PAN_00015, ' || text as restored from ({DUCK_TEXTS})",
)
def token_round_trip(spark, sf):
    """Tokenized and restored, where the text held names of tokens before."""
    marked = inputs.texts(spark, sf).withColumn("text", F.concat(F.lit("see TOKEN_EMAIL_ADDRESS_0001 and TOKEN_IN_PAN_00015, "), "text"))
    done = sanitize_documents(marked, KEYS, mode="tokenize")
    return done.select(*KEYS, restore("sanitized_text", "findings", "tokens").alias("restored"))


@query("m20_mask_splice", _spliced(DUCK_TEXTS, _MASK) + "select src, doc_id, sanitized_text, pii_count from clean")
def mask(spark, sf):
    return _clean(sanitize_documents(inputs.texts(spark, sf), KEYS, mode="mask"))


# --- tables and nested records ----------------------------------------------------------------------------
_CELLS = f"""select 'name' as src, c_custkey as doc_id, 'Mr Rao Patel ' || c_name as text from customer
 union all select 'note', doc_id, text from ({DUCK_CORPUS}) union all select 'segment', c_custkey, c_mktsegment from customer"""
_PIVOT = (
    "select doc_id, {bal} max(case when src = 'name' then sanitized_text end) as name, max(case when src = 'note' then sanitized_text end) as note, "
    "max(case when src = 'segment' then sanitized_text end) as segment, cast(sum(pii_count) as bigint) as pii_count from clean {join} group by doc_id{by}"
)


def _record(spark, sf):
    customers = inputs.customers(spark, sf).withColumnRenamed("c_custkey", "doc_id")
    return inputs.corpus(spark, sf).join(customers, "doc_id").select(
        "doc_id",
        "c_acctbal",
        F.concat(F.lit("Mr Rao Patel "), "c_name").alias("name"),
        F.col("text").alias("note"),
        F.col("c_mktsegment").alias("segment"),
    )


@query(
    "m21_sanitize_table",
    _spliced(_CELLS, _MASK)
    + _PIVOT.format(bal="c_acctbal,", join="join customer on c_custkey = doc_id", by=", c_acctbal"),
)
def sanitize_table(spark, sf):
    return sanitize_columns(_record(spark, sf), "mask", with_summary=True).drop("summary")


@query("m22_sanitize_nested", _spliced(_CELLS, _REDACT) + _PIVOT.format(bal="", join="", by=""))
def nested(spark, sf):
    record = _record(spark, sf).select(
        "doc_id",
        F.struct(F.col("name"), F.array("note").alias("notes")).alias("person"),
        F.create_map(F.lit("Asha Mehta"), "segment").alias("attrs"),
    )
    out = sanitize_nested(record, "redact")
    return out.select(
        "doc_id",
        "person.name",
        F.col("person.notes")[0].alias("note"),
        F.col("attrs")["Asha Mehta"].alias("segment"),
        "pii_count",
    )


@query(
    "s3_json_text",
    _spliced(
        f"select 'v' as src, doc_id, text from ({DUCK_CORPUS}) union all select 'n', c_custkey, c_name || '; Asha Mehta' from customer", _MASK
    )
    + """select a.doc_id, '{"Asha Mehta": ' || a.doc_id || ', "note" : ' || to_json(a.sanitized_text) || ', "more": [' || to_json(b.sanitized_text) || ', null, true]}' as sanitized,
 cast(a.pii_count + b.pii_count as int) as pii_count from clean a join clean b on a.doc_id = b.doc_id and a.src = 'v' and b.src = 'n'""",
)
def json_text(spark, sf):
    names = inputs.customers(spark, sf).select(F.col("c_custkey").alias("doc_id"), "c_name")

    def quoted(c):
        return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")

    doc = F.concat(
        F.lit('{"Asha Mehta": '), F.col("doc_id").cast("string"), F.lit(', "note" : '), quoted(F.col("text")),
        F.lit(', "more": ['), quoted(F.concat("c_name", F.lit("; Asha Mehta"))), F.lit(", null, true]}"),
    )
    joined = inputs.corpus(spark, sf).join(names, "doc_id").select("doc_id", sanitize_json(doc).alias("s"))
    return joined.select("doc_id", "s.sanitized", F.size("s.findings").alias("pii_count"))


@query(
    "s1_text_scan",
    oracle.findings_sql("select 'page' as src, page_id as doc_id, html as text from pages",
                        'select doc_id, "start", "end", entity_type, value from kept'),
)
def text_scan(spark, sf):
    from ..functions.text import utf8_text

    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("content"))
    text = pages.select("doc_id", utf8_text(F.concat("content", F.unhex(F.lit("FF")))).alias("text"))
    return findings_table(text, ["doc_id"]).drop("score", "source")


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


@query(
    "s2_csv_round_trip",
    _spliced(_CELLS, _MASK) + _PIVOT.format(bal="", join="", by="").replace(", cast(sum(pii_count) as bigint) as pii_count", ""),
)
def csv_round_trip(spark, sf):
    """Write the table as CSV, read it without header, sanitize every cell, write and read it again."""
    base = _scratch(spark)
    record = _record(spark, sf).select(F.col("doc_id").cast("string"), "name", "note", "segment")
    writers.write_csv(record, f"{base}/in")
    cells = readers.read_csv_cells(spark, f"{base}/in", rows_per_task=inputs.SENTENCES)
    writers.write_csv(sanitize_columns(cells, "mask", ["_c1", "_c2", "_c3"]), f"{base}/out")
    back = readers.read_csv_cells(spark, f"{base}/out")
    return back.select(F.col("_c0").cast("long").alias("doc_id"), F.col("_c1").alias("name"), F.col("_c2").alias("note"), F.col("_c3").alias("segment"))


# CSV text of one customer: a short row, a longer one, a blank line, a quoted cell with line breaks, a row of one cell.
_CSV_CLEAN = """select a.doc_id, 'id,note' || chr(10) || a.doc_id || ',' || {a} || ',Face Template,' || {b} || chr(10) || chr(10) || '"two' || chr(10) || 'lines"' || chr(10) || '5' || chr(10) as sanitized,
 cast(a.pii_count + b.pii_count as int) as pii_count from clean a join clean b on a.doc_id = b.doc_id and a.src = 'v' and b.src = 'n'"""
for _side in "ab":
    _text = f"{_side}.sanitized_text"
    _CSV_CLEAN = _CSV_CLEAN.replace(
        "{" + _side + "}", f"""case when regexp_matches({_text}, '[,"\\r\\n]') then '"' || replace({_text}, '"', '""') || '"' else {_text} end"""
    )
_CSV_CHECK = (
    _spliced(f"select 'v' as src, doc_id, text from ({DUCK_CORPUS}) union all select 'n', c_custkey, '98765' || lpad(cast(c_custkey as varchar), 5, '0') from customer", _MASK)
    + _CSV_CLEAN
)


def _csv_documents(spark, sf):
    phone = F.concat(F.lit("98765"), F.lpad(F.col("doc_id").cast("string"), 5, "0"))

    def quoted(c):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    doc = F.concat(
        F.lit("id,note\r\n"), F.col("doc_id").cast("string"), F.lit(","), quoted(F.col("text")), F.lit(",Face Template,"), phone,
        F.lit('\n\n"two\nlines"\n5'),
    )
    return inputs.corpus(spark, sf).select("doc_id", doc.alias("document"))


@query("s2_csv_text", _CSV_CHECK)
def csv_text(spark, sf):
    """Ragged, blank and quoted rows: a phone number stands in a cell beyond the first row's width."""
    done = _csv_documents(spark, sf).select("doc_id", sanitize_csv("document").alias("s"))
    return done.select("doc_id", "s.sanitized", F.size("s.findings").alias("pii_count"))


@query(
    "s2_csv_rows",
    f"""with rows as (select doc_id, unnest([0, 1, 2, 3, 4]) as row from ({DUCK_CORPUS}))
 select doc_id, cast(row as int) as row, cast(case row when 0 then 2 when 1 then 4 when 2 then 0 else 1 end as int) as n_cells,
 case row when 0 then 'note' when 1 then '98765' || lpad(cast(doc_id as varchar), 5, '0') when 3 then 'two' || chr(10) || 'lines' when 4 then '5' end as last_cell from rows""",
)
def csv_rows_of_files(spark, sf):
    """The same texts row by row: no cell, short row or blank line is lost."""
    rows = _csv_documents(spark, sf).select("doc_id", F.posexplode(csv_rows("document")).alias("row", "cells"))
    return rows.select("doc_id", "row", F.size("cells").alias("n_cells"), F.get("cells", F.size("cells") - 1).alias("last_cell"))


@query(
    "s2_mixed_files",
    _spliced(
        f"select 'v' as src, doc_id, text from ({DUCK_CORPUS}) where doc_id % 4 != 3 union all "
        "select 'n', c_custkey, '98765' || lpad(cast(c_custkey as varchar), 5, '0') from customer where c_custkey % 4 = 1",
        _MASK,
    )
    + """select a.doc_id, case a.doc_id % 4 when 0 then 'txt' when 1 then 'csv' else 'json' end as parser, case a.doc_id % 4
 when 0 then a.sanitized_text
 when 2 then '{"note": ' || to_json(a.sanitized_text) || '}'
 else c.sanitized end as sanitized_text, cast(a.pii_count + coalesce(b.pii_count, 0) as bigint) as pii_count, cast(null as varchar) as error
 from clean a left join clean b on a.doc_id = b.doc_id and b.src = 'n' left join (""" + _CSV_CLEAN + """) c on a.doc_id = c.doc_id
 where a.src = 'v' union all select c_custkey, 'json', null, 0, 'Invalid JSON' from customer where c_custkey % 4 = 3""",
)
def mixed_files(spark, sf):
    """Plain text, ragged CSV, JSON and broken JSON through the router of raw files, each back in its own format."""
    from ..operators.files import sanitize_files

    docs = _csv_documents(spark, sf).join(inputs.corpus(spark, sf), "doc_id")
    kind = F.col("doc_id") % 4
    note = F.concat(F.lit('{"note": '), F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", ""), F.lit("}"))
    content = F.when(kind == 0, F.col("text")).when(kind == 1, F.col("document")).when(kind == 2, note).otherwise('{"note": ')
    ending = F.when(kind == 0, ".txt").when(kind == 1, ".csv").otherwise(".json")
    files = docs.select("doc_id", F.concat(F.lit("file"), ending).alias("filename"), F.lit("mask").alias("sanitization_mode"), content.cast("binary").alias("content"))
    return sanitize_files(files, ["doc_id"]).select("doc_id", "parser", "sanitized_text", "pii_count", "error")


@query(
    "s20_json_sink",
    _spliced(_CELLS, _MASK) + _PIVOT.format(bal="", join="", by="").replace(", cast(sum(pii_count) as bigint) as pii_count", ""),
)
def json_sink(spark, sf):
    base = _scratch(spark)
    record = _record(spark, sf).select("doc_id", "name", "note", "segment")
    writers.write_json(sanitize_columns(record, "mask"), base)
    return readers.read_json_records(spark, base, "doc_id bigint, name string, note string, segment string")


# Documents of 40 customers each. Spreadsheet: sheet per segment, a row per customer: key, note, blank.
def _document(key):
    return F.floor(key / 40)


_SHEET_CELLS = f"select 'note' as src, doc_id, text from ({DUCK_CORPUS})"


@query(
    "s4_spreadsheet_preview",
    _spliced(_SHEET_CELLS, _MASK)
    + """, rows as (select c_custkey // 40 as doc_id, c_mktsegment as sheet, c_custkey as r, cast(c_custkey as varchar) || ' | ' || sanitized_text || ' | ' as line
   from clean join customer on c_custkey = doc_id),
 lines as (select doc_id, sheet, r, line from rows union all select distinct doc_id, sheet, -1, '[Sheet: ' || sheet || ']' from rows)
 select cast(doc_id as bigint) as doc_id, string_agg(line, chr(10) order by sheet, r) as sanitized_text from lines group by doc_id""",
)
def spreadsheet(spark, sf):
    customers = inputs.customers(spark, sf).withColumnRenamed("c_custkey", "id")
    base = inputs.corpus(spark, sf).withColumnRenamed("doc_id", "id").join(customers, "id")
    cell = F.inline(
        F.array(
            F.struct(F.lit(0).alias("col"), F.col("id").cast("string").alias("value"), F.lit(False).alias("is_string")),
            F.struct(F.lit(1).alias("col"), F.col("text").alias("value"), F.lit(True).alias("is_string")),
            F.struct(F.lit(2).alias("col"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("is_string")),
        )
    )
    cells = base.select(
        _document(F.col("id")).alias("doc_id"),
        F.col("c_mktsegment").alias("sheet_no"),
        F.col("c_mktsegment").alias("sheet"),
        F.col("id").alias("row"),
        cell,
    )
    return C.sanitize_sheets(cells, "mask")


@query(
    "s5_paragraphs",
    _spliced(f"select 'p' as src, doc_id, text from ({DUCK_CORPUS}) union all select 'c', c_custkey, c_name || ' Asha Mehta' from customer", _MASK)
    + """select c_custkey // 40 as doc_id,
   string_agg(a.sanitized_text, chr(10) order by c_custkey) || chr(10) || string_agg(b.sanitized_text || ' | ' || c_mktsegment, chr(10) order by c_custkey) as sanitized_text
 from customer join clean a on a.src = 'p' and a.doc_id = c_custkey join clean b on b.src = 'c' and b.doc_id = c_custkey group by c_custkey // 40""",
)
def paragraphs(spark, sf):
    customers = inputs.customers(spark, sf).withColumnRenamed("c_custkey", "id")
    base = inputs.corpus(spark, sf).withColumnRenamed("doc_id", "id").join(customers, "id")
    piece = F.inline(
        F.array(
            F.struct(F.lit("paragraph").alias("chunk_kind"), F.lit(0).alias("col"), F.col("text").alias("text")),
            F.struct(F.lit("paragraph").alias("chunk_kind"), F.lit(1).alias("col"), F.lit("").alias("text")),
            F.struct(F.lit("cell").alias("chunk_kind"), F.lit(0).alias("col"), F.concat("c_name", F.lit(" Asha Mehta")).alias("text")),
            F.struct(F.lit("cell").alias("chunk_kind"), F.lit(1).alias("col"), F.col("c_mktsegment").alias("text")),
        )
    )
    pieces = base.select(_document(F.col("id")).alias("doc_id"), F.col("id").alias("chunk_ord"), piece)
    return C.sanitize_paragraphs(pieces, "mask")


_PAGED = f"""select 'text' as src, doc_id, trim(text) as text from ({DUCK_CORPUS})
 union all select 'qr', c_custkey, case when c_custkey % 3 = 0 then 'pay u' || c_custkey || '@ybl' else 'nothing here' end from customer"""


@query(
    "s6_pages",
    _spliced(_PAGED, _REDACT)
    + """, page as (select t.doc_id, t.sanitized_text || case when q.pii_count > 0 then chr(10) || '[QR_2] ' || q.sanitized_text else '' end as line, t.pii_count + q.pii_count as n
   from clean t join clean q on t.doc_id = q.doc_id and t.src = 'text' and q.src = 'qr')
 select c_custkey // 40 as doc_id, string_agg(line, chr(10) || chr(10) order by c_custkey) as sanitized_text, cast(sum(n) as bigint) as pii_count
 from page join customer on c_custkey = doc_id group by c_custkey // 40""",
)
def pages(spark, sf):
    page_rows, payloads = _paged(spark, sf)
    return C.sanitize_pages(page_rows, payloads, "redact")


def _paged(spark, sf):
    nation = inputs.customers(spark, sf).select(F.col("c_custkey").alias("page"), _document(F.col("c_custkey")).alias("doc_id"))
    page_rows = inputs.corpus(spark, sf).withColumnRenamed("doc_id", "page").join(nation, "page")
    code = F.when(F.col("page") % 3 == 0, F.concat(F.lit(" pay u"), F.col("page").cast("string"), F.lit("@ybl\n"))).otherwise("nothing here")
    payloads = nation.select("doc_id", "page", F.inline(F.array(
        F.struct(F.lit(1).alias("payload_no"), F.lit(" ").alias("text")),
        F.struct(F.lit(2).alias("payload_no"), code.alias("text")),
    )))
    return page_rows, payloads


@query(
    "s7_payload_blocks",
    _spliced(_PAGED, _REDACT)
    + """select c_custkey // 40 as doc_id, q.doc_id as page, '[QR_2] ' || q.sanitized_text as block, k."start", k.entity_type, 'qr' as source
 from clean q join customer on c_custkey = q.doc_id join kept k on k.src = 'qr' and k.doc_id = q.doc_id where q.src = 'qr'""",
)
def payload_blocks(spark, sf):
    _, payloads = _paged(spark, sf)
    blocks = C.sanitize_payloads(payloads, "redact").select("doc_id", "page", "block", F.inline("findings"))
    return blocks.select("doc_id", "page", "block", "start", "entity_type", "source")


@query(
    "s24_previews",
    _spliced("select 'doc' as src, doc_id, text from documents", _MASK)
    + "select c.doc_id, substring(d.text, 1, 5000) as raw_preview, substring(c.sanitized_text, 1, 5000) as sanitized_preview, substring(c.sanitized_text, 1, 350) as search_preview from clean c join documents d on c.doc_id = d.doc_id",
)
def previews(spark, sf):
    docs = inputs.documents(spark, sf).select("doc_id", "text", sanitize_struct("text").alias("s"))
    clean = F.col("s.sanitized")
    return docs.select(
        "doc_id",
        readers.preview(F.col("text")).alias("raw_preview"),
        readers.preview(clean).alias("sanitized_preview"),
        readers.preview(clean, 350).alias("search_preview"),
    )


@query(
    "s25_plain_rows",
    "select c_custkey // 40 as doc_id, string_agg(c_custkey || ',' || c_name || ',' || c_mktsegment || ',', chr(10) order by c_custkey) as text from customer group by c_custkey // 40",
)
def plain_rows(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("a"), F.col("c_name").alias("b"), F.col("c_mktsegment").alias("c"), F.lit(None).cast("string").alias("d"),
        _document(F.col("c_custkey")).alias("doc_id"),
    )
    line = readers.plain_csv_line(rows.drop("doc_id"))
    return C.join_in_order(rows.withColumn("line", line), ["doc_id"], ["a"], "line", "\n", "text")
