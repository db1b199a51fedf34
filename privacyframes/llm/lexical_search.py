"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature holds its terms, and a term once more for every step of a ladder of counts it reaches (2, 3, 4, 6, 8, ...).
Signatures of one width lie together as slices: one bitmap over the documents for every bit. The slices of a term, joined by AND, are
a bitmap that never misses a document that holds it; summed with the weights of their steps they bound every document's score from above.
Documents whose bound cannot reach the k-th exact score found so far are excluded; all others are scored exactly on their whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Shelf, parts, text_bytes
from .registry import query, table
from .substring_dedup import word_hashes, word_places

#: Bits of a signature for each entry it can hold, and bits set by an entry.
BITS, SET = 8, 4
#: Bits of a block's slices, documents of a block at most and at least.
BLOCK, DOCS, LEAST = 1 << 25, 2048, 8
#: Counts a term's entries stand for: an entry for each step up to its count.
LADDER = np.array([1, *sorted(x << a for x in (2, 3) for a in range(30))], np.int64)
#: Distinct hashes gathered before they are counted, bytes of text looked at together.
TERMS, SLICE = 1 << 20, 1 << 19
#: Bytes of queries that go to every task (more are searched in several passes) and terms bounded together.
QUERIES, TOGETHER = 1 << 23, 1024
#: Candidates, and pairs of them with queries, that may go to every task; beyond, they are joined.
CANDIDATES, PAIRS = 1 << 18, 1 << 22

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of terms as they are, A-Z in lower case, blanks for what stands between terms.
_FOLDED = np.array([c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)], np.uint8)

BLOCKS = "width int, steps int, ids binary, lengths binary, slices binary, terms binary, counts binary, docs long, tokens long"


def terms_of(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode().lower())


def hashes_of(terms: list[bytes]) -> np.ndarray:
    """The hash of every term, as the signatures have it."""
    text, ends = np.frombuffer(b" ".join(terms), np.uint8), np.cumsum([len(t) + 1 for t in terms], dtype=np.int64)
    return word_hashes(text, ends - [len(t) + 1 for t in terms], ends - 1) if terms else np.zeros(0, np.uint64)


def places(hashes: np.ndarray, step: np.ndarray | int, width: np.ndarray | int) -> np.ndarray:
    """The bits of every entry (term, step) in signatures of ``width`` bits, a power of two."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(step).astype(np.uint64) + np.uint64(1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
    mask = np.asarray(width).astype(np.uint64) - np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & mask for i in range(SET)], axis=-1).astype(np.int64)


def _counted(bodies: list[bytes]):
    """Terms of texts: number of terms per text, and for every (text, distinct term) the text, the hash and the count."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies], dtype=np.int64)
    text = _FOLDED[raw]
    start, stop = word_places(text, ends)
    h = word_hashes(text, start, stop)
    row = np.searchsorted(ends, start, "right")
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    return np.bincount(row, minlength=len(bodies)), row[new], h[new], np.diff(np.append(new, len(h)))


def _transposed(signatures: list[np.ndarray]) -> bytes:
    rows = np.stack(signatures)
    rows = np.concatenate((rows, np.zeros((-len(rows) % 8, rows.shape[1]), np.uint8)))
    return np.packbits(np.unpackbits(rows, axis=1).T, axis=1).tobytes()


def signature_blocks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Blocks of slices, and rows of distinct hashes with the number of documents that hold them. Nothing is shuffled."""

    def build(batches):
        open_blocks: dict[int, list] = {}
        held, total = [], [0, 0]

        def counts():
            terms, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            values = (None, None, None, None, None, terms.tobytes(), n.astype(np.int64).tobytes(), *total)
            held.clear()
            total[:] = 0, 0
            return _row(values)

        def close(width):
            rows = open_blocks.pop(width)
            ids, lengths = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            return _row((width, max(r[3] for r in rows), ids.tobytes(), lengths.tobytes(), _transposed([r[2] for r in rows]), None, None, None, None))

        for batch in batches:
            bodies, ids = batch["body"].to_pylist(), batch["id"].to_pylist()
            first, size = 0, 0
            for i, body in enumerate(bodies):
                size += len(body)
                if size < SLICE and i + 1 < len(bodies):
                    continue
                n, row, h, tf = _counted(bodies[first : i + 1])
                steps = np.searchsorted(LADDER, tf, "right")
                cut = np.searchsorted(row, np.arange(len(n) + 1))
                held.append(h)
                total[0] += int((n > 0).sum())
                total[1] += int(n.sum())
                for j in np.flatnonzero(n).tolist():
                    if ids[first + j] is None:
                        continue
                    own, reach = h[cut[j] : cut[j + 1]], steps[cut[j] : cut[j + 1]]
                    entries = int(reach.sum())
                    width = BITS << max(5, (entries - 1).bit_length())
                    bits = np.zeros(width, np.uint8)
                    step = np.arange(entries) - np.repeat(np.cumsum(reach) - reach, reach)
                    bits[places(np.repeat(own, reach), step, width).ravel()] = 1
                    rows = open_blocks.setdefault(width, [])
                    rows.append((ids[first + j], int(n[j]), np.packbits(bits), int(reach.max())))
                    if len(rows) >= max(LEAST, min(DOCS, BLOCK // width)):
                        yield close(width)
                first, size = i + 1, 0
                if sum(map(len, held)) >= TERMS:
                    yield counts()
        for width in list(open_blocks):
            yield close(width)
        yield counts()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("body"))
    return rows.mapInArrow(build, BLOCKS)


_KIND = pa.schema([("width", pa.int32()), ("steps", pa.int32()), *((c, pa.binary()) for c in ("ids", "lengths", "slices", "terms", "counts")), ("docs", pa.int64()), ("tokens", pa.int64())])


def _row(values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _KIND, strict=True)], schema=_KIND)


def impact(count, length):
    """What one occurrence list of a term adds to a score, before its weight."""
    return (1_000_000_000 * count) // (1000 * count + 8 * length)


class Queries:
    """Queries of one pass: their distinct terms and, for every query, places and weights of its terms. Small; goes to every task."""

    def __init__(self, texts: list[str | None]):
        counts = [Counter(terms_of(t)) for t in texts]
        self.terms = sorted({t for c in counts for t in c})
        place = {t: i for i, t in enumerate(self.terms)}
        self.hashes = hashes_of(self.terms)
        self.own = [(np.array([place[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.terms))], np.int64)

    def batches(self):
        """Runs of queries with a bounded number of terms, which are renumbered: (first, last, hashes, [(places, weights)])."""
        first = 0
        while first < len(self.own):
            last, terms = first, set()
            while last < len(self.own) and (last == first or len(terms | set(self.own[last][0].tolist())) <= TOGETHER):
                terms |= set(self.own[last][0].tolist())
                last += 1
            known = np.array(sorted(terms), np.int64)
            yield first, last, self.hashes[known], [(np.searchsorted(known, at), (self.weight[at] * often).astype(np.float64)) for at, often in self.own[first:last]]
            first = last


def upper_bounds(slices: np.ndarray, width: int, steps: int, lengths: np.ndarray, m: np.ndarray, hashes: np.ndarray, own) -> np.ndarray:
    """A bound of the score of every query (rows) and document of the block (columns): weighted sums of slices.

    A bitmap of step s says that the term may occur LADDER[s] times; without the next one, it occurs less often than that step says.
    """
    n = len(lengths)
    # Whole numbers below 2**53, so sums of floats are exact.
    total = np.zeros((len(hashes), n))
    alive, before = np.arange(len(hashes)), np.zeros(n, np.int64)
    bits = None
    for s in range(steps):
        at = places(hashes[alive], s, width)
        found = slices[at[:, 0]]
        for i in range(1, SET):
            found &= slices[at[:, i]]
        # A document that reaches a step has reached those below.
        bits = found if bits is None else found & bits
        some = bits.any(axis=1)
        alive, bits = alive[some], bits[some]
        if not len(alive):
            break
        most = impact(np.minimum(LADDER[s + 1] - 1, lengths), m)
        total[alive] += np.unpackbits(bits, axis=1, count=n) * (most - before).astype(np.float64)
        before = most
    return np.stack([weight @ total[at] if len(at) else np.zeros(n) for at, weight in own])


def _blocks(batches, shared):
    """(first query, bounds, ids) of every block and run of queries."""
    queries, n_docs, n_tokens = shared
    runs = list(queries.batches())
    for batch in batches:
        for r in range(batch.num_rows):
            x = {c: batch[c][r].as_py() for c in ("width", "steps", "ids", "lengths", "slices")}
            ids, lengths = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["lengths"], np.int64)
            m = 25 + (75 * lengths * n_docs) // n_tokens
            slices = np.frombuffer(x["slices"], np.uint8).reshape(x["width"], -1)
            for first, _, hashes, own in runs:
                yield first, upper_bounds(slices, x["width"], x["steps"], lengths, m, hashes, own), ids


def _exact(candidates: DataFrame, docs: DataFrame, shared, k: int) -> DataFrame:
    """The k best of the candidates (id, asked: numbers of queries), scored on whole texts: q, doc, score, place."""
    size = candidates.agg(F.count("*"), F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()
    few = F.broadcast(candidates) if size[0] <= CANDIDATES and size[1] <= PAIRS else candidates

    def score(batches):
        queries, n_docs, n_tokens = shared.value
        number = {t: i for i, t in enumerate(queries.terms)}
        own = [list(zip(at.tolist(), (queries.weight[at] * often).tolist(), strict=True)) for at, often in queries.own]
        for batch in batches:
            out = []
            for doc, text, asked in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["asked"].to_pylist(), strict=True):
                terms = terms_of(text)
                tf = {number[t]: n for t, n in Counter(terms).items() if t in number}
                m = 25 + (75 * len(terms) * n_docs) // n_tokens
                part = {i: impact(n, m) for i, n in tf.items()}
                for q in asked:
                    found = sum(weight * part[i] for i, weight in own[q] if i in part)
                    if found > 0:
                        out.append((q, doc, found))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["q", "doc", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    found = docs.join(few, "id").select("id", "text", "asked").mapInArrow(score, "q int, doc long, score long")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """The k documents with the highest scores above 0 for every item: (item id, rank from 1, document id, score), equal scores by document id.

    Terms are runs of digits, letters and characters that are not ASCII, only A-Z lower-cased; a null text has none. N counts the documents with a
    term, L all terms, n one document's, df the documents that hold a term, tf its occurrences in one. With the weight
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 25 + (75 n N) div L the score sums w * ((10**9 tf) div (1000 tf + 8 m)) over the
    item's terms, repeats included. df is counted on 64-bit hashes of the terms; scores are counted on the terms themselves.

    Documents without an id count in N, L and df but have no rank; rows with one id are documents of their own. Items with the same id
    and text are one; an item without terms has no rows. Extra columns are ignored; without documents or items there are no rows.

    The signatures (about 12 bits for each distinct term of a document) are written to the checkpoint folder and dropped at the end. Items go
    to every task in passes of 8 MB; a task's memory is a block of slices and the bounds of about a thousand terms over it. What is not excluded is
    scored whatever its number: up to 2**18 candidates are broadcast, more are joined.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "lexical-search")
    out = None
    index = shelf.put(signature_blocks(docs, id_column, text_column))
    n_docs, n_tokens = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    asked = items.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    passes = parts(text_bytes(asked, "text"), QUERIES, 1)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    slices = index.filter("slices is not null").select("width", "steps", "ids", "lengths", "slices")
    kind = items.schema[item_column].dataType
    for p in range(passes if n_tokens else 0):
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p).collect()
        if not rows:
            continue
        queries = Queries([r["text"] for r in rows])
        queries.weigh(n_docs, _frequencies(index, queries.hashes))
        shared = spark.sparkContext.broadcast((queries, n_docs, n_tokens))

        # Bounds alone give the first candidates, their exact scores the threshold of each query.
        best = slices.mapInArrow(_leading(shared, k), "q int, id long, bound double")
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "id")
        first = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
        first = shelf.put(first.groupBy("id").agg(F.sort_array(F.collect_set("q")).alias("asked")))
        marks = {r["q"]: (float(r["score"]), r["doc"]) for r in _exact(first, texts, shared, k).filter(F.col("place") == k).select("q", "score", "doc").collect()}

        rest = shelf.put(slices.mapInArrow(_reaching(shared, marks), "id long, asked array<int>").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked")))
        found = _exact(rest, texts, shared, k)
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"q int, item {kind.simpleString()}")
        done = shelf.put(found.join(F.broadcast(names), "q").select(F.col("item").alias(item_column), F.col("place").cast("int").alias("rank"), F.col("doc").alias(id_column), "score"))
        out = done if out is None else out.union(done)
        shelf.drop(first, rest)
        shared.unpersist()
    shelf.drop(index)
    return out if out is not None else spark.createDataFrame([], f"`{item_column}` {kind.simpleString()}, rank int, `{id_column}` long, score long")


def _frequencies(index: DataFrame, hashes: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the terms."""
    order = np.argsort(hashes)
    wanted = hashes[order]

    def count(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts in zip(batch["terms"], batch["counts"], strict=True):
                have, n = np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int64)
                if len(have):
                    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                    total += np.where(have[at] == wanted, n[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(order[some], pa.int32()), pa.array(total[some], pa.int64())], ["i", "n"])

    found = index.filter("terms is not null").select("terms", "counts").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    return {r["i"]: r["n"] for r in found.collect()}


def _leading(shared, k: int):
    """Each query's k highest bounds of a task."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for first, bounds, ids in _blocks(batches, shared.value):
            for q, row in enumerate(bounds, first):
                at = np.flatnonzero(row > 0)
                held = best.get(q)
                if held is not None and len(held[0]) == k:
                    at = at[(row[at] > held[0][-1]) | (row[at] == held[0][-1]) & (ids[at] < held[1][-1])]
                if len(at):
                    value, doc = (row[at], ids[at]) if held is None else (np.append(held[0], row[at]), np.append(held[1], ids[at]))
                    top = np.lexsort((doc, -value))[:k]
                    best[q] = value[top], doc[top]
        for q, (value, doc) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), q), pa.int32()), pa.array(doc, pa.int64()), pa.array(value, pa.float64())], ["q", "id", "bound"])

    return run


def _reaching(shared, marks: dict[int, tuple[float, int]]):
    """Documents that are not provably worse than a query's k-th exact score, with their queries."""

    def run(batches):
        for first, bounds, ids in _blocks(batches, shared.value):
            score = np.array([marks.get(q, (0.0, 0))[0] for q in range(first, first + len(bounds))])[:, None]
            last = np.array([marks.get(q, (0.0, 0))[1] for q in range(first, first + len(bounds))])[:, None]
            query, doc = np.nonzero((bounds > 0) & ((bounds > score) | (bounds == score) & (ids <= last)))
            order = np.argsort(doc, kind="stable")
            query, doc = query[order] + first, doc[order]
            cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc[cut]], pa.int64()), pa.ListArray.from_arrays(np.append(cut, len(doc)).astype(np.int32), pa.array(query, pa.int32()))], ["id", "asked"])

    return run


CHECK = """
with d as materialized (select row_number() over () as row, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x != '') as terms from documents),
total as (select count(*) filter (len(terms) > 0) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from d),
t as materialized (select row, term, count(*) as tf from (select row, unnest(terms) as term from d) group by all),
q as (select item_id, term, count(*) as often from (select item_id, unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x != '')) as term from (select distinct item_id, text from benchmark)) group by all),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(t.row) as df from (select distinct term from q) left join t using (term) group by term), total),
s as (select q.item_id, t.row, sum(q.often * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * len(d.terms) * n_docs) // n_terms)))) as score
 from q join w using (term) join t using (term) join d using (row), total group by q.item_id, t.row),
r as (select s.item_id, d.doc_id, cast(s.score as bigint) as score, row_number() over (partition by s.item_id order by s.score desc, d.doc_id) as rank from s join d using (row) where s.score > 0 and d.doc_id is not null)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 10"""


@query("op11_lexical_search", CHECK)
def op11_lexical_search(spark, sf_dir):
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
