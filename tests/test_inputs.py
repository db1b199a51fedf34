import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from privacyframes.plans import inputs


@pytest.fixture
def many_splits(spark):
    """Splits of a few kilobytes, so that a small file has many of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "4k")
    yield
    for name in names:
        spark.conf.unset(name)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, many_splits):
    n = 60_000
    pq.write_table(pa.table({"c_custkey": range(n), "c_name": [f"Customer {i}" for i in range(n)]}), tmp_path / "customer.parquet", row_group_size=n)
    pq.write_table(pa.table({"doc_id": range(5000), "text": [f"text {i}" for i in range(5000)]}), tmp_path / "documents.parquet", row_group_size=5000)
    table = inputs.table(spark, tmp_path, "customer")
    assert table.rdd.getNumPartitions() > 1 and most_in_a_task(table.select("c_custkey", "c_name")) == n
    corpus = inputs.corpus(spark, tmp_path)
    assert most_in_a_task(corpus) < 24_000
    assert corpus.count() == corpus.distinct().count() == n
    joined = corpus.join(inputs.customers(spark, tmp_path).withColumnRenamed("c_custkey", "doc_id"), "doc_id")
    assert most_in_a_task(joined.select("text", "c_name")) < 24_000
    docs = inputs.documents(spark, tmp_path)
    assert most_in_a_task(docs) < 1_200 and docs.count() == 5000


def test_catalog_sorts_stored_scans(spark, tmp_path):
    """A sort takes samples of its input: the list's plan must not hold the detection."""
    from privacyframes.plans.governance_queries import catalog

    pq.write_table(pa.table({"c_custkey": pa.array([12, 26, 5, None], pa.int64())}), tmp_path / "customer.parquet")
    listed = catalog(spark, str(tmp_path))
    assert "fp_hash_" not in listed._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r.id, r.pii_count, r.entities, r.malware_scan_status, r.malware_scan_source) for r in listed.collect()]
    assert [r[0] for r in rows] == [26, 12, 5, None] and [r[3] for r in rows[:3]] == ["clean", "unknown", "clean"]
    assert rows[0][1] > 0 and "UPI_ID=" in rows[0][2] and rows[3][1:3] == (0, "")


def test_csv_rows_of_one_file_are_dealt_out(spark, tmp_path):
    from privacyframes.sources import readers

    (tmp_path / "one.csv").write_text("".join(f'{i},"a ""{i}"""\n' for i in range(8000)) + "8000,x,long\n")
    plain = readers.read_csv_cells(spark, str(tmp_path))
    dealt = readers.read_csv_cells(spark, str(tmp_path), rows_per_task=500)
    assert most_in_a_task(plain) == 8001 and most_in_a_task(dealt) < 600
    assert dealt.columns == ["_c0", "_c1", "_c2"] and dealt.exceptAll(plain).count() == 0 and dealt.count() == 8001


def test_pages_as_files_need_no_folder_each(spark, tmp_path):
    """A folder for each page is made, and listed, by processes and tasks of its own; 30 files a task are as many tasks again."""
    import hashlib
    import os

    from privacyframes.plans.governance_queries import unread_files

    n = 1200
    html = [None if i % 50 == 0 else f"<p>{i}</p>\n é" + "x" * (1990 if i % 3 == 0 else 0) for i in range(n)]
    ids = [i - 600 for i in range(n)] + [None, 7]
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "html": html + ["lost", html[607]]}), tmp_path / "pages.parquet", row_group_size=2 * n)
    pq.write_table(pa.table({"c_custkey": pa.array([1, 2], pa.int64()), "c_name": ["a", "b"]}), tmp_path / "customer.parquet")
    done = unread_files(spark, str(tmp_path))
    assert len({os.path.dirname(f) for f in done.inputFiles()}) <= 8 and done.rdd.getNumPartitions() <= 8
    bodies = {i - 600: (x or "").encode() + b"\n" for i, x in enumerate(html)}
    bodies[7] *= 2
    want = {k: (len(b), "TOO_LARGE", None) if len(b) > 2000 else (len(b), "ACCEPT", hashlib.sha256(b).hexdigest()) for k, b in bodies.items()}
    got = [(r.page_id, (r.n_bytes, r.admission_status, r.content_sha256)) for r in done.collect()]
    assert len(got) == n and dict(got) == want
