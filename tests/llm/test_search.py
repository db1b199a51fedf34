"""Ranked search, centroid clusters and license notices against brute force."""

import math
import random

import brute_search
import numpy as np
import pytest
from pyspark.sql import functions as F

from privacyframes.llm import centroids, lexical_search, licenses

ITEMS = [(1, "the quick brown fox"), (1, "the quick brown fox"), (2, "Fox fox FOX é😀"), (2, "house"), (3, None), (4, ""), (5, "no such words anywhere"), (None, "old river bank"), (6, "x y")]


def found(rows):
    return {tuple(r) for r in rows.collect()}


def test_search_on_given_documents(spark, sf_small, small):
    items = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    want = brute_search.lexical_search([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(lexical_search.lexical_search(small, items)) == want


def test_search_on_edges(spark, edge):
    items = spark.createDataFrame([(i, t, i) for i, t in ITEMS], "item_id long, text string, score long")
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    got = lexical_search.lexical_search(edge, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == brute_search.lexical_search(docs, [x for x in ITEMS if x[1]])


def test_search_on_no_rows(spark, edge):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.lexical_search(edge.limit(0), items).collect() == []
    assert lexical_search.lexical_search(edge, items.limit(0)).collect() == []


def test_search_with_ties_counts_and_passes(spark, monkeypatch):
    """Hundreds of equal texts, long ones, counts on every step of the ladder; queries in several passes, candidates joined instead of broadcast."""
    monkeypatch.setattr(lexical_search, "QUERIES", 200)
    monkeypatch.setattr(lexical_search, "CANDIDATES", 10)
    monkeypatch.setattr(lexical_search, "TOGETHER", 8)
    pick = random.Random(4)
    words = ["".join(pick.choices("abcde", k=3)) for _ in range(120)]
    docs = [(i, " ".join(pick.choices(words, k=pick.choice((1, 5, 40, 900))))) for i in range(400)] + [(1000 + i, words[0] + " and " + words[1]) for i in range(300)]
    docs += [(2000 + n, " ".join([words[2]] * n + words[3:5])) for n in range(1, 40)]
    items = [(i, " ".join(pick.choices(words, k=pick.choice((1, 3, 20))))) for i in range(30)] + [(99, f"{words[0]} {words[1]}"), (98, words[2])]
    got = lexical_search.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == brute_search.lexical_search(docs, items)


def test_bounds_are_bounds_and_tight():
    pick = random.Random(8)
    words = [f"w{i}".encode() for i in range(300)]
    bodies = [b" ".join(pick.choices(words, k=pick.choice((3, 50)))) for _ in range(256)]
    n, row, h, tf = lexical_search._counted(bodies)
    width, signatures = 1024, []
    for j in range(len(bodies)):
        own, reach = h[row == j], np.searchsorted(lexical_search.LADDER, tf[row == j], "right")
        bits = np.zeros(width, np.uint8)
        step = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        bits[lexical_search.places(np.repeat(own, reach), step, width).ravel()] = 1
        signatures.append(np.packbits(bits))
    queries = lexical_search.Queries(["w1 w2 w3 w4", "w9", "absent"])
    queries.weigh(256, {})
    slices = np.frombuffer(lexical_search._transposed(signatures), np.uint8).reshape(width, -1)
    m = 25 + 75 * n * 256 // int(n.sum())
    (run,) = queries.batches()
    bounds = lexical_search.upper_bounds(slices, width, 12, n, m, run[2], run[3])
    exact = np.array([[sum(int(queries.weight[i]) * c * int(lexical_search.impact(b.split().count(queries.terms[i]), m[d])) for i, c in zip(*own, strict=True)) for d, b in enumerate(bodies)] for own in queries.own])
    assert (bounds >= exact).all()
    assert (bounds == exact).mean() > 0.9


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int")


def clusters(df):
    rows, found = centroids.centroid_clusters(df)
    return sorted((tuple(r) for r in rows.withColumn("centroid_sha256", centroids.centroid_sha256(found)).collect()), key=str)


def test_clusters_on_given_vectors(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    assert clusters(rows) == brute_search.centroid_clusters([(r.vec_id, r.embedding) for r in rows.collect()])


def test_clusters_on_edges(spark):
    random = np.random.default_rng(2)
    base = [[float(np.float32(x)) for x in random.normal(size=64)] for _ in range(40)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [math.nan] + [1.0] * 63, [math.inf] * 64]
    rows = [*enumerate(base), *((i, base[0]) for i in range(3)), (3, base[5]), (None, base[7]), (None, base[8]), *((100 + i, b) for i, b in enumerate(bad))]
    assert clusters(vectors(spark, rows)) == brute_search.centroid_clusters(rows)
    # Equal vectors: all distances tie.
    same = [(i, [0.5] * 64) for i in range(30)]
    assert clusters(vectors(spark, same)) == brute_search.centroid_clusters(same)
    few = rows[:5]
    assert clusters(vectors(spark, few)) == brute_search.centroid_clusters(few)
    large = [*few, (77, [3e6] * 64), (78, [-1e6] * 63 + [2.0])]
    assert clusters(vectors(spark, large)) == brute_search.centroid_clusters(large)
    assert clusters(vectors(spark, rows).limit(0)) == [] and clusters(vectors(spark, rows[-7:])) == []


def test_search_eliminates_centroids():
    random = np.random.default_rng(6)
    signs = centroids.walsh_hadamard(np.eye(64, dtype=np.int64))
    assert (signs @ signs.T == 64 * np.eye(64)).all() and (np.diff((np.diff(signs[centroids.sequency(64)], axis=1) != 0).sum(1)) >= 0).all()
    centres = random.integers(-90, 90, (16, 64))
    rows = centres[random.integers(0, 16, 900)] + random.integers(-20, 20, (900, 64))
    rows[:50] = random.integers(-90, 90, (50, 64))
    at, distance, compared = centroids.nearest(rows, centres)
    apart = ((rows[:, None] - centres) ** 2).sum(2)
    assert (at == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    assert compared < 0.5 * 900 * 16 * 64, compared / (900 * 16 * 64)


TEXTS = [
    None,
    "",
    " \n",
    "Released under the MIT License.",
    "released under the MIT licence, MIT-License; mit\nlicense",
    "permit license",
    "The Apache   License (Version 2.0); GNU General Public Licens",
    "general public general public license license",
    "GNU Affero General Public License and GNU lessr General Publc License",
    "é MIT😀 License MIT License é",
    "Permision is hereby granted, free of charge, to any person obtaining a copy of this softwar",
    "All right reserved. All rights preserved. Al rights reserved",
    "licensed under cc by-nc 4.0",
    "mit " * 50 + "license " * 50,
    "x" * 5000 + " mit license " + "y" * 5000,
]


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


def check(scanner, text):
    n, base, close = scanner.scan(text)
    want = brute_search.license_scan(text, licenses.PHRASES, licenses.NOTICES, licenses.allowed)
    least = {}
    for label, notice, first, words, edits in close:
        least[(label, notice)] = min(edits, least.get((label, notice), 99))
        run = " ".join(w.decode() for w in licenses.words_of(text)[first : first + words])
        assert brute_search.edit_distance(run, notice) == edits
    assert (n, sorted(base), least) == want


def test_notices_on_edges(scanner):
    for text in TEXTS:
        check(scanner, text)


def test_notices_with_random_edits(scanner):
    pick = random.Random(12)
    for _ in range(150):
        text = " ".join(pick.choice(licenses.NOTICES)[1] for _ in range(3))
        chars = list("in the " + text + " end")
        for _ in range(pick.randrange(9)):
            at = pick.randrange(len(chars))
            chars[at : at + pick.randrange(2)] = pick.choices("abl s", k=pick.randrange(2))
        check(scanner, "".join(chars))


def test_notices_in_long_texts(scanner):
    n, base, close = scanner.scan("all rights reserved " * 50_000)
    assert n == 150_000 and not base and len(close) == 50_000
    assert scanner.verify.cache_info().misses < 1000
    assert scanner.scan("license " * 200_000)[0] == 200_000


def test_scan_of_a_table(spark, edge):
    got = licenses.digest(licenses.license_scan(edge.withColumn("n_words", F.lit(1))))
    assert got.count() == edge.count()
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert licenses.license_scan(edge.limit(0)).collect() == []
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.digest(licenses.license_scan(rows)).collect():
        n, base, close = brute_search.license_scan(TEXTS[r.doc_id], licenses.PHRASES, licenses.NOTICES, licenses.allowed)
        places = [i for _, i in base]
        want = (n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted({x for x, _ in base} | {x for x, _ in close})))
        assert tuple(r)[1:7] == want
        assert r.score == (1 if base else max((1 - e / len(notice) for (_, notice), e in close.items()), default=0))
