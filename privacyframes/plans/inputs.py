"""Input tables of the registered queries: the given tables, and text and metadata derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# One sentence per customer, 14 shapes, so that every kind of personal data occurs. The same text works in
# both SQL dialects; {STR} is the string type.
CORPUS_SQL = """
select c_custkey as doc_id, case cast(c_custkey % 14 as int)
 when 0 then 'PAN is ' || chr(cast(65 + c_custkey % 26 as int)) || 'BCDE' || {k37} || 'F, Aadhaar ' || {k13} || ' ' || {k29} || ' ' || {k31} || '.'
 when 1 then 'Call 9' || lpad(cast((c_custkey * 104729) % 1000000000 as {STR}), 9, '0') || ' or pay user' || cast(c_custkey as {STR}) || '@okaxis today'
 when 2 then 'DOB: ' || {day} || '/' || {month} || '/' || cast(1950 + c_custkey % 50 as {STR}) || ' passport M' || cast(1 + c_custkey % 9 as {STR}) || {k6}
 when 3 then 'HDFC Bank IFSC HDFC0' || {k6} || ' acct ' || lpad(cast(10000000000 + c_custkey * 7919 as {STR}), 11, '0')
 when 4 then 'device android-' || lpad(cast(c_custkey as {STR}), 8, '0') || ' fp_hash_' || lpad(cast(c_custkey * 3 as {STR}), 8, '0') || ' face_tmp_' || lpad(cast(c_custkey * 5 as {STR}), 8, '0')
 when 5 then 'host 10.' || cast(c_custkey % 256 as {STR}) || '.' || cast((c_custkey * 7) % 300 as {STR}) || '.1 mail u' || cast(c_custkey as {STR}) || '@mail.example.com'
 when 6 then 'Ship to ' || cast(1 + c_custkey % 999 as {STR}) || ' Market Road, PIN ' || lpad(cast(100000 + c_custkey % 800000 as {STR}), 6, '0') || ' for Asha Mehta'
 when 7 then 'card 4' || lpad(cast((c_custkey * 982451653) % 1000000000000000 as {STR}), 15, '0') || ' end; VID: 1234 5678 9012 ' || {k1}
 when 8 then 'आधार: ' || {k13} || ' ' || {k29} || ' ' || {k31} || ', मोबाइल: +91 9' || lpad(cast((c_custkey * 7919) % 1000000000 as {STR}), 9, '0') || '.'
 when 9 then 'पैन: ' || chr(cast(65 + c_custkey % 26 as int)) || 'BCDE' || {k37} || 'F, जन्म तिथि: ' || {day} || '-' || {month} || '-' || cast(1950 + c_custkey % 50 as {STR})
 when 10 then 'સરનામું: ઘર ' || cast(1 + c_custkey % 99 as {STR}) || ', પિન ' || lpad(cast(100000 + c_custkey % 800000 as {STR}), 6, '0')
 when 11 then 'Meera Shah born ' || cast(1 + c_custkey % 28 as {STR}) || ' March ' || cast(1950 + c_custkey % 50 as {STR}) || ' at Kotak  Bank. Address: flat ' || cast(c_custkey as {STR}) || ' behind the mill'
 when 12 then 'VID 12345678-9012' || {k1} || ' and ios-' || lpad(cast(c_custkey as {STR}), 7, '0') || ', twice u1@x.org u1@x.org, pay u@ybl or me@ybl'
 else 'Ravi Kumar, ' || cast(1 + c_custkey % 200 as {STR}) || ' गांधी नगर के पास' end as text
from customer"""
for _name, _expr in {
    "k1": "lpad(cast(c_custkey % 10000 as {STR}), 4, '0')",
    "k6": "lpad(cast(c_custkey % 1000000 as {STR}), 6, '0')",
    "k37": "lpad(cast((c_custkey * 37) % 10000 as {STR}), 4, '0')",
    "k13": "lpad(cast(2000 + (c_custkey * 13) % 8000 as {STR}), 4, '0')",
    "k29": "lpad(cast((c_custkey * 29) % 10000 as {STR}), 4, '0')",
    "k31": "lpad(cast((c_custkey * 31) % 10000 as {STR}), 4, '0')",
    "day": "lpad(cast(1 + c_custkey % 28 as {STR}), 2, '0')",
    "month": "lpad(cast(1 + c_custkey % 12 as {STR}), 2, '0')",
}.items():
    CORPUS_SQL = CORPUS_SQL.replace("{" + _name + "}", _expr)

SPARK_CORPUS = CORPUS_SQL.replace("{STR}", "string")
DUCK_CORPUS = CORPUS_SQL.replace("{STR}", "varchar")

# Metadata of the corpus documents, in both dialects.
FILES_COLUMNS = """
 doc_id as id,
 case cast(doc_id % 6 as int) when 0 then 'note_' when 1 then 'Report_' else 'file_' end || cast(doc_id as {STR}) ||
 case cast(doc_id % 6 as int) when 0 then '.txt' when 1 then '.PDF' when 2 then '.csv' when 3 then '.json' when 4 then '.png' else '.log' end as filename,
 case cast(doc_id % 6 as int) when 0 then 'text/plain' when 1 then 'application/pdf' when 2 then 'text/csv' when 3 then 'application/json' when 4 then 'image/png' else 'application/octet-stream' end as content_type,
 doc_id % 20 as uploaded_by,
 TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '{HOURS}' HOUR as upload_time,
 case cast(doc_id % 4 as int) when 0 then 'redact' when 1 then 'tokenize' when 2 then '' else null end as sanitization_mode,
 doc_id % 7 = 0 as legal_hold,
 case when doc_id % 11 = 0 then null else TIMESTAMP '2024-01-01 00:00:00' + (doc_id * {HOURS} + 720) * INTERVAL '1' HOUR end as retention_expires_at"""
HOURS_APART = 6
SPARK_FILES = (
    "select text, sha2(text, 256) as file_sha256,"
    + FILES_COLUMNS.replace("INTERVAL '{HOURS}' HOUR", "make_interval(0, 0, 0, 0, {HOURS})")
    .replace("INTERVAL '1' HOUR", "make_interval(0, 0, 0, 0, 1)")
    .replace("{HOURS}", str(HOURS_APART))
    .replace("{STR}", "string")
    + " from {texts}"
)
DUCK_FILES = (
    "select text, sha256(text) as file_sha256,"
    + FILES_COLUMNS.replace("{HOURS}", str(HOURS_APART)).replace("{STR}", "varchar")
    + " from ({texts})"
)


# Rows that one task scans: seconds of work each, for sentences and for whole texts.
SENTENCES, TEXTS = 20_000, 1_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deals rows out to tasks of about ``rows`` rows, by ``keys`` where a join on them follows.

    The splits of a file do not do: its rows lie in as few of them as it has row groups, however many rows a group has. Counting
    reads the footers alone.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *keys)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Dealt out like the corpus, so that a join of the two keeps their tasks, whichever side is broadcast."""
    return spread(table(spark, sf, "customer"), SENTENCES, "c_custkey")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(SPARK_CORPUS.replace("from customer", "from {customer}"), customer=customers(spark, sf))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), TEXTS)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """All free text: documents, page sources, turns of conversations, and the derived corpus."""
    docs = documents(spark, sf).select(F.lit("doc").alias("src"), "doc_id", "text")
    pages = spread(table(spark, sf, "pages"), TEXTS).select(F.lit("page").alias("src"), F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    turn = (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")
    chat = spread(table(spark, sf, "conversations"), SENTENCES).select(F.lit("chat").alias("src"), turn, "text")
    made = corpus(spark, sf).select(F.lit("corpus").alias("src"), "doc_id", "text")
    return docs.unionByName(pages).unionByName(chat).unionByName(made)


DUCK_TEXTS = (
    "select 'doc' as src, doc_id, text from documents union all "
    "select 'page', page_id, html from pages union all "
    "select 'chat', conv_id * 1000 + turn, text from conversations union all "
    f"select 'corpus', doc_id, text from ({DUCK_CORPUS})"
)


def files(spark: SparkSession, sf: str) -> DataFrame:
    """File metadata plus text for each corpus document."""
    return spark.sql(SPARK_FILES, texts=corpus(spark, sf))


DUCK_FILES_SQL = DUCK_FILES.replace("{texts}", DUCK_CORPUS)


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty uploaders less two, so that the fallback name occurs."""
    return spark.sql(
        SPARK_USERS, customer=table(spark, sf, "customer")
    )


_USERS = (
    "select c_custkey % 20 as user_id, 'name' || cast(c_custkey % 20 as {STR}) as username, "
    "case when c_custkey % 20 = 1 then 'admin' else 'user' end as role, max(c_acctbal) as balance "
    "from {customer} where c_custkey % 20 not in (3, 11) group by c_custkey % 20"
)
SPARK_USERS = _USERS.replace("{STR}", "string")
DUCK_USERS = _USERS.replace("{STR}", "varchar").replace("{customer}", "customer")
