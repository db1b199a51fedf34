"""Exact dedups and near-duplicates against brute force."""

import numpy as np
import pyarrow as pa
import pytest

import brute
from privacyframes.llm import near_dedup, substring_dedup, suffix_dedup, windows

EXACT = [
    (lambda d: suffix_dedup.digest(suffix_dedup.suffix_dedup(d)), brute.suffix_dedup),
    (lambda d: substring_dedup.digest(substring_dedup.substring_dedup(d)), brute.substring_dedup),
]


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("operator, check", EXACT)
def test_exact_on_given_documents(small, operator, check):
    assert {r[0]: tuple(r)[1:] for r in operator(small).collect()} == check(rows(small))


@pytest.mark.parametrize("operator, check", EXACT)
def test_exact_on_edges(edge, known, operator, check):
    got = operator(edge).collect()
    assert len(got) == edge.count()
    assert {r[0]: tuple(r)[1:] for r in got if r[0] is not None} == check(known)
    assert all(r[2] == 0 for r in got if r[0] is None)


@pytest.mark.parametrize("operator, check", EXACT)
def test_exact_on_no_rows(edge, operator, check):
    assert operator(edge.limit(0)).collect() == []


@pytest.mark.parametrize("operator, check", EXACT)
def test_passage_with_many_surroundings(spark, operator, check, monkeypatch):
    """A common passage whose neighbours differ in every document, with the heavy minimizers cut into single windows."""
    monkeypatch.setattr(windows, "HEAVY", 3)
    random = np.random.default_rng(5)
    words = ["".join(random.choice(list("abcdefgh"), 6)) for _ in range(400)]
    common = " ".join(words[:15])
    docs = [(i, " ".join(random.choice(words, 9)) + " " + common + " " + " ".join(random.choice(words, 9))) for i in range(150)]
    got = operator(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == check(docs)


def test_suffix_classes_are_in_order():
    random = np.random.default_rng(3)
    text = random.choice(np.frombuffer(b"ab", np.uint8), 3000)
    text[500:900] = text[1500:1900]
    text[2000:2400] = ord("a")
    starts = np.arange(len(text) - 50)
    order, group = suffix_dedup.suffix_classes(text, starts)
    strings = [text[i : i + 50].tobytes() for i in order]
    assert strings == sorted(strings)
    assert all((a == b) == (g == h) for a, b, g, h in zip(strings, strings[1:], group, group[1:], strict=False))


def test_factors_over_a_border():
    """The window over the end of the first factor occurs elsewhere in the reference."""
    w = [f"w{i}".encode() for i in range(40)]
    keys = lambda x: [b" ".join(x[i : i + 13]) for i in range(len(x) - 12)]
    reference = substring_dedup.Reference()
    for part in (w[:20], w[14:30]):
        reference.add(part, keys(part))
    marks = substring_dedup.parse(w, keys(w), reference)
    assert marks.tolist() == [b" ".join(w[i : i + 13]) in reference.at for i in range(28)]


def test_near_on_given_documents(small):
    got = {r[0]: tuple(r)[1:] for r in near_dedup.near_dedup(small, words=2).collect()}
    assert got == brute.near_dedup(rows(small))


def test_near_on_edges(edge, known):
    got = near_dedup.near_dedup(edge, words=2).collect()
    assert len(got) == edge.count()
    assert {r[0]: tuple(r)[1:] for r in got if r[0] is not None} == brute.near_dedup(known)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.near_dedup(edge.limit(0)).collect() == []


def test_near_chains_in_a_large_list(spark, monkeypatch):
    """Each document changes a few words of the one before: neighbours are linked, ends are not, and no hub is near all."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    random = np.random.default_rng(2)
    words = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(70):
        docs.append((i, " ".join(words)))
        for j in random.choice(100, 4, replace=False):
            words[j] = f"n{i}_{j}"
    docs += [(100 + i, "some other text " + " ".join(f"q{i}_{j}" for j in range(60))) for i in range(20)]
    got = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()
    want = brute.near_dedup(docs)
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert len({x[1] for x in want.values()}) < 60


def test_near_lists_hold_numbers_and_no_table_of_sketches_stays(spark, small, monkeypatch):
    """Digests and sketches are long and random: rows of lists, pairs and links hold neither, and only one stored table keeps sketches."""
    seen, put = [], near_dedup.Work.table
    monkeypatch.setattr(near_dedup.Work, "table", lambda work, rows: seen.append(put(work, rows)) or seen[-1])
    near_dedup.near_dedup(small, words=2).collect()
    lists = [t for t in seen if {"lid", "key"} <= set(t.columns)]
    assert lists and all(kind != "binary" for t in lists for _, kind in t.dtypes)
    assert all(dict(t.dtypes)[c] == "bigint" for t in seen for c in ("key", "a", "b", "label") if c in t.columns)
    there = []
    for t in seen:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.inputFiles()[0]) if "sketch" in t.columns and t.inputFiles() else None
        there.append(path is not None and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))
    assert sum(there) == 1


def test_near_blocks_of_one_list_travel_as_one_row_each(spark, monkeypatch):
    """A list of texts that are alike but not near: rows sent grow with its blocks, not with its members times its blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    sent, across = spark.sparkContext.accumulator(0), near_dedup._across_packed

    def counted(group):
        assert group.num_rows <= 2
        sent.add(group.num_rows)
        return across(group)

    monkeypatch.setattr(near_dedup, "_across_packed", counted)
    common = [f"c{i}" for i in range(60)]
    docs = [(i, " ".join(common + [f"own{i}_{j}" for j in range(20)])) for i in range(80)]
    docs += [(200 + i, " ".join(common + [f"pair{i // 2}_{j}" for j in range(20)] + [f"last{i}"])) for i in range(6)]
    got = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.near_dedup(docs)
    assert 0 < sent.value


def test_many_small_lists_are_looked_at_together():
    """Most lists have two or three members: a call for each costs more than its pairs. The pairs are those of ``_across`` on each list."""
    random = np.random.default_rng(2)
    rows, last = [], 0
    for lid in range(300):
        base = random.integers(0, 1 << 62, 90).astype(np.uint64)
        for _ in range(int(random.integers(1, 9)) if lid % 50 else 60):
            n = int(random.integers(3, 90))
            own = np.unique(np.concatenate((random.choice(base, n, replace=False), random.integers(0, 1 << 62, n // 8).astype(np.uint64))))
            lists = sorted({lid, *random.integers(0, 300, 3).tolist(), *((1 << 32) + random.integers(0, 300, 2)).tolist()})
            rows.append((lid, last, len(own), bool(random.integers(0, 2)), int(random.integers(0, 4)), own[: near_dedup.SKETCH].tobytes(), lists))
            last += 1
    lists = pa.Table.from_pylist([dict(zip(("lid", *near_dedup.MEMBER), r, strict=True)) for r in rows])
    near = np.array([near_dedup.estimate(np.frombuffer(a[5], np.uint64), np.frombuffer(b[5], np.uint64)) for a, b in zip(rows, rows[1:])])
    padded, row = near_dedup._padded([r[5] for r in rows]), np.arange(len(rows) - 1)
    assert (near_dedup.estimates(*padded, *padded, row, row + 1, at_once=64) == near).all()

    def pairs(tables):
        out = {}
        for t in tables:
            for place, keys, mask in zip(*(t[c].to_pylist() for c in ("near", "keys", "mask")), strict=True):
                held = np.argwhere(np.unpackbits(np.frombuffer(mask, np.uint8), count=len(keys) ** 2).reshape(len(keys), -1))
                assert out.setdefault(place, {frozenset((keys[a], keys[b])) for a, b in held})
        return out

    alone = []
    for lid in range(300):
        one = lists.filter(pa.compute.equal(lists["lid"], lid))
        for c, v in (("side", 2), ("i", 0), ("j", 0)):
            one = one.append_column(c, pa.array([v] * one.num_rows, pa.int64()))
        alone.append(near_dedup._across(one))
    together = list(near_dedup._across_lists(lists.to_batches(max_chunksize=37)))
    assert pairs(together) == pairs(alone) and len(pairs(alone)) > 50 > len(list(near_dedup._across_lists(lists.to_batches())))


def test_estimate_is_close():
    random = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        both = random.integers(0, 1 << 62, 2000).astype(np.uint64)
        own = lambda: random.integers(0, 1 << 62, int(1000 * (1 - share) / share)).astype(np.uint64)
        a, b = (np.unique(np.concatenate((both, own()))) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(a[:64], b[:64]) - true) < 0.25


def test_near_copies_with_an_unlucky_sketch_reach_the_exact_check():
    """Jaccard 0.8, but only 33 of the 64 least values of the union are in both sets."""
    both = np.arange(1_000, 1_400, dtype=np.uint64)
    a = np.sort(np.concatenate([both, np.arange(0, 32, 2, dtype=np.uint64), np.arange(5_000, 5_034, dtype=np.uint64)]))
    b = np.sort(np.concatenate([both, np.arange(1, 31, 2, dtype=np.uint64), np.arange(6_000, 6_035, dtype=np.uint64)]))
    assert 5 * len(np.intersect1d(a, b)) == 4 * len(np.union1d(a, b))
    sketches = [x[: near_dedup.SKETCH] for x in (a, b)]
    assert near_dedup.estimate(*sketches) == 33 / 64
    pair = pa.RecordBatch.from_pydict({"a": [b"a"], "b": [b"b"], "n_a": [len(a)], "n_b": [len(b)], "sketch_a": [sketches[0].tobytes()], "sketch_b": [sketches[1].tobytes()]})
    assert [x.num_rows for x in near_dedup._estimated([pair])] == [1]
