"""Queries: recognisers, validators, outside hits, overlap resolution."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import accepted, verhoeff_check
from ..functions.detect import findings
from ..functions.recognizers import DEFAULT, FUNCTION_HITS, FunctionRecognizer, Recognizer, named
from ..operators import chunks as C
from ..operators.detection import (
    attach_hits,
    candidates_table,
    chunk_entity_counts,
    document_summaries,
    findings_table,
    parse_model_reply,
    resolution_table,
)
from . import inputs, oracle
from .inputs import DUCK_CORPUS, DUCK_TEXTS, table
from .registry import query

KEYS = ["src", "doc_id"]
SPAN = ["src", "doc_id", "start", "end", "entity_type", "value"]
SPAN_SQL = 'src, doc_id, "start", "end", entity_type, value'
CORPUS_TEXTS = f"select 'corpus' as src, doc_id, text from ({DUCK_CORPUS})"


def corpus_texts(spark, sf):
    return inputs.corpus(spark, sf).select(F.lit("corpus").alias("src"), "doc_id", "text")


def _recognizer_query(number: int, label: str) -> None:
    def run(spark, sf):
        found = candidates_table(inputs.texts(spark, sf), KEYS, recognizers=named(label))
        return found.select(*SPAN)

    sql = f"with {oracle.candidates_cte(DUCK_TEXTS, [label])} select {SPAN_SQL} from hits"
    query(f"d{number:02d}_{label.lower()}", sql)(run)


for _i, (_label, _, _) in enumerate(fixed.PATTERNS, start=1):
    _recognizer_query(_i, _label)


@query(
    "d29_label_entities",
    f"with {oracle.candidates_cte(DUCK_TEXTS)} select entity_type, count(*) as n_hits, count(distinct value) as n_values from hits group by entity_type",
)
def label_entities(spark, sf):
    return candidates_table(inputs.texts(spark, sf), KEYS).groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("n_hits"), F.countDistinct("value").alias("n_values")
    )


@query(
    "e1_scored_recognizers",
    oracle.findings_sql(DUCK_TEXTS, f"select {SPAN_SQL}, score, source from kept", scored=True),
)
def scored(spark, sf):
    return findings_table(inputs.texts(spark, sf), KEYS, use_scored=True).select(*SPAN, "score", "source")


# Outside hits derived from the numbers of all texts, the same in both dialects.
_HITS = """
select src, doc_id, hit_no, "start", "start" + 8 + hit_no as "end", label, 0.6 + 0.05 * ((doc_id + hit_no) % 6) as score, '' as value, stage from (
 select src, doc_id, hit_no, cast((doc_id * (hit_no + 3)) % 14 as int) as "start", stage,
  case cast((doc_id + hit_no) % 5 as int) when 0 then 'PERSON' when 1 then 'LOCATION' when 2 then 'DATE_TIME' when 3 then 'CREDIT_CARD' else 'ORG' end as label
 from ({texts}) as c, (values (0, 1), (1, 1), (2, 2), (3, 2)) as h(hit_no, stage))"""


def outside_hits(spark, sf):
    # A constant array per row instead of a join with a list of four.
    kinds = F.array(*[F.struct(F.lit(n).alias("hit_no"), F.lit(s).alias("stage")) for n, s in ((0, 1), (1, 1), (2, 2), (3, 2))])
    base = inputs.texts(spark, sf).select("src", "doc_id", F.inline(kinds))
    names = F.array(*[F.lit(x) for x in ("PERSON", "LOCATION", "DATE_TIME", "CREDIT_CARD", "ORG")])
    start = ((F.col("doc_id") * (F.col("hit_no") + 3)) % 14).cast("int")
    turn = F.col("doc_id") + F.col("hit_no")
    return base.select(
        "src",
        "doc_id",
        "hit_no",
        start.alias("start"),
        (start + 8 + F.col("hit_no")).alias("end"),
        F.get(names, (turn % 5).cast("int")).alias("label"),
        (F.lit(0.6) + F.lit(0.05) * (turn % 6)).alias("score"),
        F.lit("").alias("value"),
        "stage",
    )


_ENTITY = (
    "case label when 'PERSON' then 'PERSON_NAME' when 'LOCATION' then 'IN_ADDRESS' when 'DATE_TIME' then 'DATE_OF_BIRTH' else label end"
)


def _outside_cte(name: str, stage: int, late: bool) -> str:
    """Valid outside hits; validity depends on the entity, so one branch per entity."""
    value = 'substring(text, "start" + 1, "end" - "start")'
    entity = "label" if late else _ENTITY
    score = str(fixed.LATE_SCORE) if late else "score"
    floor = 'and "end" <= length(text)' if late else f"and score >= {fixed.EXTERNAL_MIN_SCORE}"
    rules = " ".join(
        f"when '{e}' then {oracle.valid(e, 'v')}" for e in ("PERSON_NAME", "IN_ADDRESS", "DATE_OF_BIRTH", "CREDIT_CARD")
    )
    shift = "1000 +" if late else "-1000 +"
    source = "llm" if late else "presidio"
    return f"""{name} as (select src, doc_id, {shift} hit_no as ord, entity_type, cast({score} as double) as score, '{source}' as source, "start", cast("end" as int) as "end", value
  from (select * exclude (value), {entity} as entity_type, {value} as value, {oracle.trimmed(value)} as v
        from ({_HITS.replace("{texts}", DUCK_TEXTS)}) join shaped using (src, doc_id) where stage = {stage} {floor})
  where case entity_type {rules} else {oracle.valid('OTHER', 'v')} end)"""


@query(
    "e2_external_hits",
    f"with recursive {oracle.candidates_cte(DUCK_TEXTS)},\n{_outside_cte('outside', 1, False)},\n"
    f"merged as (select * from outside union all by name select * from hits),\n{oracle.resolve_cte('merged')}\n"
    f"select {SPAN_SQL}, score, source from kept",
)
def external_hits(spark, sf):
    hits = outside_hits(spark, sf).filter("stage = 1")
    joined = attach_hits(inputs.texts(spark, sf), hits, KEYS)
    return findings_table(joined, KEYS, external=F.col("external_hits")).select(*SPAN, "score", "source")


@query(
    "e3_late_hits",
    f"with recursive {oracle.candidates_cte(DUCK_TEXTS)},\n{_outside_cte('outside', 1, False)},\n{_outside_cte('late', 2, True)},\n"
    f"merged as (select * from outside union all by name select * from hits),\n{oracle.resolve_cte('merged')},\n"
    "fresh as (select * from late l anti join firsts f on l.src = f.src and l.doc_id = f.doc_id and l.\"start\" = f.\"start\" and l.\"end\" = f.\"end\" and l.entity_type = f.entity_type),\n"
    "again as (select src, doc_id, ord, entity_type, score, source, \"start\", \"end\", value from kept union all by name select * from fresh),\n"
    f"{oracle.resolve_cte('again', 'second_')}\nselect {SPAN_SQL}, score, source from second_kept",
)
def late_hits(spark, sf):
    joined = attach_hits(inputs.texts(spark, sf), outside_hits(spark, sf), KEYS)
    found = findings_table(joined, KEYS, external=F.col("external_hits"), late=F.col("late_hits"))
    return found.select(*SPAN, "score", "source")


_REPLY = """
select doc_id, case cast(doc_id % 5 as int)
 when 0 then 'Sure! ```json [{"start": ' || cast(doc_id % 9 as {STR}) || ', "end": ' || cast(doc_id % 9 + 6 as {STR}) || ', "entity_type": " CITY ", "value": "Surat"}] ``` done'
 when 1 then '[{"start": 1, "end": "7", "entity_type": "ORG"}, {"start": "x", "end": 3, "entity_type": "ORG"}]'
 when 2 then '{"start": 1, "end": 7, "entity_type": "ORG"}'
 when 3 then 'no data found'
 else '[]' end as reply from {customer}"""


@query(
    "e4_model_reply",
    f"""select doc_id, cast("start" as int) as "start", cast("end" as int) as "end", entity_type, value from (
 select doc_id, try_cast(json_extract_string(j, '$.start') as int) as "start", try_cast(json_extract_string(j, '$.end') as int) as "end",
        trim(json_extract_string(j, '$.entity_type')) as entity_type, coalesce(json_extract_string(j, '$.value'), '') as value
 from (select doc_id, unnest(from_json(body, '["json"]')) as j from (
   select doc_id, case when reply like '%```%' then trim(regexp_extract(reply, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1)) else reply end as body
   from ({_REPLY.replace("{STR}", "varchar").replace("{customer}", "(select c_custkey as doc_id from customer)")})) where body like '[%'))
 where "start" is not null and "end" is not null and entity_type is not null""",
)
def model_reply(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    text = _REPLY.replace("{STR}", "string").replace("{", "{{").replace("}", "}}").replace("{{customer}}", "{customer}")
    replies = spark.sql(text, customer=base)
    return replies.select("doc_id", F.inline(parse_model_reply(F.col("reply"))))


CUSTOMER_CODE = Recognizer(
    name="CUSTOMER_CODE",
    entity="CUSTOMER_CODE",
    pattern=r"\bcustomer#\d{9}\b",
    ignore_case=True,
    score=0.9,
    source="custom",
    validator=lambda v: ~v.rlike("#0+$"),
    guard=lambda p: p.digits.rlike("[0-9]{9}"),
)


@query(
    "e5_custom_recognizer",
    """select c_custkey, cast(strpos(t, 'Customer#') - 1 as int) as "start", cast(strpos(t, 'Customer#') + 17 as int) as "end",
 'CUSTOMER_CODE' as entity_type, c_name as value from (select c_custkey, c_name, 'for ' || c_name || ', ' || c_mktsegment as t from customer)
 where not regexp_matches(c_name, '#0+$')""",
)
def custom_recognizer(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("for "), "c_name", F.lit(", "), "c_mktsegment").alias("text")
    )
    return findings_table(df, ["c_custkey"], recognizers=(CUSTOMER_CODE,)).drop("score", "source")


def _first_places(text):
    """The first place of "license", and the text's first two characters under another entity: built-in functions only."""
    at = F.instr(F.lower(text), "license")
    none = F.lit(None).cast("string")
    hits = [(at - 1, at + 6, none, F.lit(0.8)), (F.lit(0), F.lit(2), F.lit("HEAD"), F.lit(None).cast("double"))]
    structs = [F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), e.alias("entity_type"), s.alias("score")) for a, b, e, s in hits]
    return F.filter(F.array(*structs), lambda h: h["start"] >= 0)


def _all_places(text):
    """Every place of "license" in lower case, found by Python on Arrow batches."""

    @F.pandas_udf(FUNCTION_HITS)
    def find(texts):
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "entity_type": None, "score": None} for m in re.finditer("license", t.lower() if t.isascii() else t)])

    return find(text)


_ORDER = len(fixed.PATTERNS)
_FIRST_SQL = f"""own as (select src, doc_id, {_ORDER} as ord, 'WORD' as entity_type, 0.8::double as score, 'custom' as source, cast(pos - 1 as int) as "start", cast(pos + 6 as int) as "end",
  substring(text, pos, 7) as value from (select *, strpos(lower(text), 'license') as pos from shaped) where pos > 0
 union all select src, doc_id, {_ORDER}, 'HEAD', {fixed.PATTERN_SCORE}::double, 'custom', 0, 2, substring(text, 1, 2) from shaped
  where length(text) >= 2 and {oracle.valid('HEAD', oracle.trimmed('substring(text, 1, 2)'))}),
merged as (select * from hits union all by name select * from own)"""
_ALL_SQL = f"""own as (select src, doc_id, -1 as ord, 'WORD' as entity_type, 0.7::double as score, 'custom' as source, cast(s as int) as "start", cast(s + 7 as int) as "end", 'LICENSE' as value, text from
 (select src, doc_id, text, list_sum([length(q) + 7 for q in p[1:i]]) - 7 as s from (select src, doc_id, text, p, unnest(range(1, len(p))) as i from
  (select src, doc_id, text, string_split(case when length(text) = octet_length(encode(text)) then lower(text) else text end, 'license') as p from shaped) where len(p) > 1))),
merged as (select * from hits union all by name select * exclude (value, text), substring(text, "start" + 1, 7) as value from own)"""


def _with_own(own: str) -> str:
    return f"with recursive {oracle.candidates_cte(DUCK_TEXTS)},\n{own},\n{oracle.resolve_cte('merged')}\nselect {SPAN_SQL}, score, source from kept"


@query("e5_function_recognizer", _with_own(_FIRST_SQL))
def function_recognizer(spark, sf):
    """A recogniser made of built-in functions, behind the patterns."""
    own = FunctionRecognizer("first license", "WORD", _first_places)
    return findings_table(inputs.texts(spark, sf), KEYS, recognizers=(*DEFAULT, own)).select(*SPAN, "score", "source")


@query("e5_udf_recognizer", _with_own(_ALL_SQL))
def udf_recognizer(spark, sf):
    """A recogniser in Python, before the patterns."""
    own = FunctionRecognizer("all licenses", "WORD", _all_places, score=0.7)
    return findings_table(inputs.texts(spark, sf), KEYS, recognizers=(own, *DEFAULT)).select(*SPAN, "score", "source")


# --- validators: candidate values of every kind, some good and some bad, one per customer -----------------
_VALUE = """
select c_custkey as doc_id, case cast(c_custkey % 12 as int)
 when 0 then 'PERSON_NAME' when 1 then 'IN_ADDRESS' when 2 then 'IP_ADDRESS' when 3 then 'IN_AADHAAR' when 4 then 'IN_PAN' when 5 then 'BANK_ACCOUNT'
 when 6 then 'IFSC_CODE' when 7 then 'PASSPORT_NUMBER' when 8 then 'CREDIT_CARD' when 9 then 'DATE_OF_BIRTH' when 10 then 'BLANK' else 'PLACE' end as entity,
 case cast(c_custkey % 12 as int)
 when 0 then case cast(c_custkey % 5 as int) when 0 then 'Asha Mehta' when 1 then 'Face Template' when 2 then 'Asha' when 3 then 'Asha M3hta' else ' Asha  Devi Ben Shah ' end
 when 1 then repeat('ab', cast(c_custkey % 7 as int)) || ' '
 when 2 then '10.0' || cast(c_custkey % 100 as {STR}) || '.' || cast(c_custkey % 400 as {STR}) || '.7'
 when 3 then lpad(cast(c_custkey * 7919 % 1000000000 as {STR}), cast(11 + c_custkey % 3 as int), '2')
 when 4 then case when c_custkey % 5 = 0 then 'PAN: ' else '' end || 'abcd-e' || lpad(cast(c_custkey as {STR}), 4, '0') || 'f'
 when 5 then lpad(cast(c_custkey * 104729 as {STR}), cast(9 + c_custkey % 11 as int), '3')
 when 6 then case when c_custkey % 5 = 0 then 'hdfc1' else 'hdfc0' end || lpad(cast(c_custkey as {STR}), 6, '0')
 when 7 then case when c_custkey % 5 = 0 then 'q' else 'm' end || cast(c_custkey % 10 as {STR}) || lpad(cast(c_custkey as {STR}), 6, '0')
 when 8 then lpad(cast(c_custkey as {STR}), cast(12 + c_custkey % 8 as int), case when c_custkey % 5 = 0 then '0' else '4' end)
 when 9 then case cast(c_custkey % 5 as int) when 0 then 'D.O.B: 01/02/1990' when 1 then 'born 1 march 1990' when 2 then '01-02.1990' when 3 then 'March 1990' else '12/ 1990' end
 when 10 then case when c_custkey % 5 = 0 then 'x' else '  ' end
 else case cast(c_custkey % 5 as int) when 0 then ' Delhi ' when 1 then 'MUMBAI' when 2 then 'Surat' when 3 then 'John' else 'johnny' end end as value
from {customer}"""
_RULES = {
    "v01_empty_value": "BLANK",
    "v02_never_pii": "PLACE",
    "v03_person_name": "PERSON_NAME",
    "v04_address_length": "IN_ADDRESS",
    "v05_ipv4": "IP_ADDRESS",
    "v06_aadhaar": "IN_AADHAAR",
    "v07_pan": "IN_PAN",
    "v08_bank_account": "BANK_ACCOUNT",
    "v11_ifsc": "IFSC_CODE",
    "v11_passport": "PASSPORT_NUMBER",
    "v10_luhn_card": "CREDIT_CARD",
    "v12_birth_date": "DATE_OF_BIRTH",
}


def _validator_query(name: str, entity: str, strict: bool = False) -> None:
    def run(spark, sf):
        values = spark.sql(_VALUE.replace("{STR}", "string"), customer=table(spark, sf, "customer"))
        ok = accepted(F.col("entity"), F.col("value"), strict)
        return values.filter(F.col("entity") == entity).select("doc_id", "value", ok.alias("ok"))

    source = _VALUE.replace("{STR}", "varchar").replace("{customer}", "customer")
    rule = oracle.valid(entity, oracle.trimmed("value"), strict)
    query(name, f"select doc_id, value, {rule} as ok from ({source}) where entity = '{entity}'")(run)


for _name, _entity in _RULES.items():
    _validator_query(_name, _entity)
_validator_query("v06_aadhaar_strict", "IN_AADHAAR", True)


@query(
    "v09_verhoeff",
    f"select c_custkey, n, {oracle.verhoeff('n')} as ok from (select c_custkey, lpad(cast(c_custkey * 7919 + 200000000000 as varchar), 12, '0') as n from customer)",
)
def verhoeff(spark, sf):
    n = F.lpad((F.col("c_custkey") * 7919 + F.lit(200000000000)).cast("string"), 12, "0")
    return table(spark, sf, "customer").select("c_custkey", n.alias("n"), verhoeff_check(n).alias("ok"))


@query(
    "v13_unicode_digits",
    "select c_custkey, cast(c_custkey as varchar) as digits from customer",
)
def unicode_digits(spark, sf):
    from ..functions.columns import normalized_digits

    indic = F.translate(F.col("c_custkey").cast("string"), "0123456789", "०१२३४૫૬૭૮૯")
    return table(spark, sf, "customer").select(
        "c_custkey", normalized_digits(F.concat(F.lit("no. "), indic, F.lit("-"))).alias("digits")
    )


# --- merge, overlap, summary ------------------------------------------------------------------------------
@query(
    "r1_dedupe_by_span",
    f"with {oracle.candidates_cte(DUCK_TEXTS, scored=True)} select {SPAN_SQL}, first(score order by ord) as score, first(source order by ord) as source "
    "from hits group by all",
)
def dedupe(spark, sf):
    """Every hit once; of equal spans the first inserted: scored patterns come before the others."""
    return resolution_table(inputs.texts(spark, sf), KEYS, use_scored=True).filter("not kept").select(*SPAN, "score", "source")


@query(
    "r2_rank_counts",
    oracle.findings_sql(
        DUCK_TEXTS,
        "select r.prio as entity_rank, count(*) as n_candidates, count(k.doc_id) as n_kept from ranked r left join kept k "
        "on r.src = k.src and r.doc_id = k.doc_id and r.\"start\" = k.\"start\" and r.\"end\" = k.\"end\" and r.entity_type = k.entity_type group by r.prio",
    ),
)
def rank_counts(spark, sf):
    ranks = F.create_map(*[F.lit(x) for kv in fixed.ENTITY_RANK.items() for x in kv])
    rank = F.coalesce(F.try_element_at(ranks, F.col("entity_type")), F.lit(fixed.DEFAULT_RANK))
    both = resolution_table(inputs.texts(spark, sf), KEYS).withColumn("entity_rank", rank.cast("int"))
    return both.groupBy("entity_rank").agg(F.count_if(~F.col("kept")).alias("n_candidates"), F.count_if("kept").alias("n_kept"))


@query("r3_overlap_resolution", oracle.findings_sql(DUCK_TEXTS, f"select {SPAN_SQL} from kept"))
def resolution(spark, sf):
    return findings_table(inputs.texts(spark, sf), KEYS).select(*SPAN)


@query(
    "r3_strict_aadhaar",
    oracle.findings_sql(DUCK_TEXTS, f"select {SPAN_SQL} from kept", strict=True),
)
def resolution_strict(spark, sf):
    return findings_table(inputs.texts(spark, sf), KEYS, strict_aadhaar=True).select(*SPAN)


@query(
    "r4_findings_table",
    oracle.findings_sql(
        "select 'chat' as src, conv_id * 1000 + turn as doc_id, text from conversations union all " + CORPUS_TEXTS,
        f"select {SPAN_SQL}, score, source from kept",
    ),
)
def long_table(spark, sf):
    chat = table(spark, sf, "conversations").select(
        F.lit("chat").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"
    )
    return findings_table(chat.unionByName(corpus_texts(spark, sf)), KEYS).select(*SPAN, "score", "source")


# One document per market segment and nation: many chunks per document.
_MULTI = "select c_nationkey as doc_id, text from customer join ({corpus}) on c_custkey = doc_id"


@query(
    "r5_document_summary",
    oracle.findings_sql(
        f"select cast(c_nationkey as varchar) as src, d.doc_id, text from ({DUCK_CORPUS}) d join customer on c_custkey = d.doc_id",
        "select cast(src as int) as nation, entity_type, count(*) as n from kept group by src, entity_type",
    ),
)
def document_summary(spark, sf):
    nation = inputs.customers(spark, sf).select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("nation"))
    chunks = inputs.corpus(spark, sf).join(nation, "doc_id")
    return chunk_entity_counts(chunks, "nation")


@query(
    "r5_summary_with_clean_documents",
    oracle.findings_sql(
        "select 'doc' as src, doc_id, text from documents",
        "select d.doc_id, count(k.doc_id) as pii_count, count(distinct k.entity_type) as n_entities from documents d left join kept k on d.doc_id = k.doc_id group by d.doc_id",
    ),
)
def summary_with_clean(spark, sf):
    docs = inputs.documents(spark, sf)
    full = document_summaries(table(spark, sf, "documents"), docs, "doc_id")
    return full.select("doc_id", "pii_count", F.size("summary").cast("long").alias("n_entities"))


# Words of each corpus document laid out on a page, 40 per line.
_WORDS_SQL = rf"""
words as (select doc_id, i - 1 as word_no, w as text, cast(((i - 1) % 40) * 10 as int) as "left", cast(((i - 1) // 40) * 12 as int) as top, cast(length(w) as int) as width, 10 as height
  from (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from (select doc_id, list_filter(string_split(text, ' '), lambda x: x != '') as ws from ({DUCK_CORPUS})))),
segments as (select *, cast(coalesce(sum(length(text) + 1) over (partition by doc_id order by word_no rows between unbounded preceding and 1 preceding), 0) as int) as "start" from words),
pages as (select 'page' as src, doc_id, string_agg(text, ' ' order by word_no) as text from words group by doc_id)"""


def _segments(spark, sf):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    raw = inputs.corpus(spark, sf).select("doc_id", F.posexplode(words).alias("word_no", "text"))
    boxed = raw.select(
        "doc_id",
        "word_no",
        "text",
        ((F.col("word_no") % 40) * 10).alias("left"),
        (F.floor(F.col("word_no") / 40) * 12).cast("int").alias("top"),
        F.length("text").alias("width"),
        F.lit(10).alias("height"),
    )
    segments = C.text_segments(boxed, ["doc_id"])
    pages = C.join_in_order(segments, ["doc_id"], ["word_no"], "text", " ", "text")
    found = pages.select("doc_id", findings("text").alias("findings"))
    return segments, found


def _page_sql(select: str) -> str:
    inner = oracle.findings_sql("select src, doc_id, text from pages", select)
    return inner.replace("with recursive", f"with recursive {_WORDS_SQL},", 1)


@query(
    "r6_segments_to_hide",
    _page_sql(
        'select distinct s.doc_id, s.word_no, s.text, s."start", s."left", s.top, s.width, s.height from segments s join kept k on s.doc_id = k.doc_id '
        'and k."start" < s."start" + length(s.text) and s."start" < k."end"'
    ),
)
def segments_hidden(spark, sf):
    segments, found = _segments(spark, sf)
    hidden = C.segments_to_hide(segments, found, ["doc_id"])
    return hidden.select("doc_id", F.col("word_no").cast("long").alias("word_no"), "text", "start", "left", "top", "width", "height")


@query(
    "r7_scaled_boxes",
    _page_sql(
        'select distinct s.doc_id, s.word_no, s."left" * (595.0 / 1190)::double as x0, s.top * (842.0 / 1684)::double as y0, '
        '(s."left" + greatest(1, s.width)) * (595.0 / 1190)::double as x1, (s.top + greatest(1, s.height)) * (842.0 / 1684)::double as y1 '
        'from segments s join kept k on s.doc_id = k.doc_id and k."start" < s."start" + length(s.text) and s."start" < k."end"'
    ),
)
def boxes(spark, sf):
    segments, found = _segments(spark, sf)
    hidden = C.segments_to_hide(segments, found, ["doc_id"])
    x = C.page_scale(F.lit(595.0), F.lit(1190))
    y = C.page_scale(F.lit(842.0), F.lit(1684))
    return C.scale_boxes(hidden, x, y).select("doc_id", F.col("word_no").cast("long").alias("word_no"), "x0", "y0", "x1", "y1")


@query(
    "r8_values_to_hide",
    oracle.findings_sql(
        DUCK_TEXTS,
        "select src, doc_id, array_to_string(list(value order by s), chr(10)) as hide_values from "
        "(select src, doc_id, value, min(\"start\") as s from kept group by src, doc_id, value) group by src, doc_id",
    ),
)
def values_hidden(spark, sf):
    found = inputs.texts(spark, sf).select("src", "doc_id", findings("text").alias("findings"))
    out = C.values_to_hide(found, KEYS).select("src", "doc_id", F.explode_outer(F.array(F.array_join("hide_values", "\n"))).alias("hide_values"))
    return out.filter("hide_values != ''")
