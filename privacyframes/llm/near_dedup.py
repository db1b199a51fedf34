"""Near-duplicate documents by bottom-k sketches of one hash function.

Steps: documents with one set of shingles become one class; the retained values of the sketches are put into inverted lists, the
rarest first, as many as any pair of near-duplicates must share one of; lists are cut by set size, since sets that differ more than
that are no near-duplicates; members of a list are paired with a few hubs, its most central member among them, then, where a list still spans several components, those of
different components with each other in blocks; the union sketch of a pair estimates its similarity, and what passes is verified on the
full sets. Components are found by spreading the least label along the verified links.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Shelf, pack, unpack
from .registry import query, table
from .substring_dedup import word_hashes, word_places

#: Values of a sketch; values a pair at the threshold shares at least (51 of 64 are expected at 0.8: 32 is six deviations below);
#: estimate under which a pair is dropped (31 of 64 are needed, so this loses no more than the lists do); members of a block.
SKETCH, SHARED, ESTIMATE, BLOCK = 64, 32, 0.47, 256
#: Pairs verified together; partners of one set among them at most; blocks verified together.
PAIRS, SETS, TOGETHER = 2048, 256, 8
#: What a list knows of its members.
MEMBER = ("key", "n", "top", "label", "sketch", "own")
#: Ids that may go to every task (16 MB); beyond, they are joined.
BROADCAST = 1 << 20


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text: A-Z in lower case, words split at blank and 0x09-0x0D.

    A text with fewer words than a shingle is one shingle; without words it is empty.
    """
    joined = b"".join(t or b"" for t in texts)
    text = np.frombuffer(joined, np.uint8)
    text = np.where((text >= 65) & (text <= 90), text | 32, text)
    ends = np.cumsum([len(t or b"") for t in texts], dtype=np.int64)
    start, stop = word_places(text, ends)
    h = word_hashes(text, start, stop)
    first, last = np.searchsorted(start, np.append(0, ends[:-1])[: len(ends)]), np.searchsorted(start, ends)
    whole = _mix(_combine(h, words), words)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            own = np.sort(whole[a : b - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(_mix(_combine(h[a:b], b - a), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _combine(h: np.ndarray, words: int) -> np.ndarray:
    n = len(h) - words + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(words if n > 0 else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return total


def _mix(h: np.ndarray, words: int) -> np.ndarray:
    """The one hash function: its smallest values are the sketch."""
    h = (h + np.uint64(words)) ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _pieces(batch, most=1 << 19):
    """Rows of a batch whose ``body`` together has about ``most`` bytes, so that no more texts than these are taken out of it at once."""
    first, size = 0, 0
    for i, length in enumerate(pc.binary_length(batch["body"]).fill_null(0).to_pylist()):
        size += length
        if size >= most:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity from the union sketch: the share of its values that both sketches hold."""
    union = np.union1d(a, b)[: max(min(len(a), len(b)), min(SKETCH, max(len(a), len(b))))]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / max(1, len(union))


def _padded(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of one width, filled up with the largest number, and their lengths."""
    lengths = np.array([len(x) >> 3 for x in sketches], np.int64)
    rows = np.full((len(sketches), SKETCH), np.iinfo(np.uint64).max, np.uint64)
    rows[np.arange(SKETCH) < lengths[:, None]] = np.frombuffer(b"".join(sketches), np.uint64)
    return rows, lengths


def estimates(a: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_lengths: np.ndarray, x: np.ndarray, y: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """``estimate`` of row ``x[i]`` of the padded sketches ``a`` and row ``y[i]`` of ``b``, for many pairs."""
    out = np.empty(len(x))
    for first in range(0, len(x), at_once):
        i, j = x[first : first + at_once], y[first : first + at_once]
        n, m = a_lengths[i], b_lengths[j]
        both = np.concatenate((a[i], b[j]), axis=1)
        both.sort(axis=1)
        # A value of both sketches comes twice in a row, as no sketch holds one twice; its place among the different ones is its place in the union.
        twice = (both[:, 1:] == both[:, :-1]) & (np.arange(1, 2 * SKETCH) < (n + m)[:, None])
        place = np.arange(1, 2 * SKETCH) + 1 - np.cumsum(twice, axis=1)
        size = np.maximum(np.minimum(n, m), np.minimum(SKETCH, np.maximum(n, m)))
        shared = (twice & (place <= size[:, None])).sum(axis=1)
        out[first : first + at_once] = shared / np.maximum(1, np.minimum(size, n + m - twice.sum(axis=1)))
    return out


def _estimated(batches):
    for batch in batches:
        n, m = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
        batch = batch.filter(pa.array(5 * np.minimum(n, m) >= 4 * np.maximum(n, m)))
        row = np.arange(batch.num_rows)
        keep = estimates(*_padded(batch["sketch_a"].to_pylist()), *_padded(batch["sketch_b"].to_pylist()), row, row) >= ESTIMATE
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _exact(pairs, sets):
    """Verified links of one block of pairs. A pair whose ends are linked already, by other pairs of the block, adds nothing."""
    held = dict(zip(sets["key"].to_pylist(), sets["set"].to_pylist(), strict=True))
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for x, y in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
        if find(x) == find(y):
            continue
        p, q = np.frombuffer(held[x], np.uint64), np.frombuffer(held[y], np.uint64)
        both = len(np.intersect1d(p, q, assume_unique=True))
        if 100 * both >= 80 * (len(p) + len(q) - both):
            root[find(x)] = find(y)
            a.append(x)
            b.append(y)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _across(group):
    """Pairs of one block of a list with another (or itself) that lie in different components and pass the estimate.

    A pair meets in every list that holds both; it is looked at where it meets first in the common order of lists, and nowhere else. A
    list of size band L leaves pairs of two sets of the band below to the list of that band.
    """
    n = group.num_rows
    lid, i, j = (group[c][0].as_py() for c in ("lid", "i", "j"))
    keys, side, size, top = group["key"].to_pylist(), *(np.array(group[c].to_pylist()) for c in ("side", "n", "top"))
    label = np.array(group["label"].to_pylist())
    wanted = (side[:, None] == 0) & (side == 1) | (side[:, None] == 2) & (side == 2) & (np.arange(n)[:, None] < np.arange(n))
    wanted &= (label[:, None] != label) & (top[:, None] | top)
    wanted &= 5 * np.minimum(size[:, None], size) >= 4 * np.maximum(size[:, None], size)
    holders: dict[int, list[int]] = {}
    for x, own in enumerate(group["own"].to_pylist()):
        for v in own[: own.index(lid)]:
            if v >> 32 == lid >> 32:
                holders.setdefault(v, []).append(x)
    for rows in holders.values():
        if len(rows) > 1:
            wanted[np.ix_(rows, rows)] = False
    sketches = [np.frombuffer(x, np.uint64) for x in group["sketch"].to_pylist()]
    lengths = np.array([len(x) for x in sketches])
    if wanted.sum() > 4 * n:
        # Values in common bound the estimate from above; the union sketch decides on what is left.
        held, at = np.unique(np.concatenate(sketches), return_inverse=True)
        often = np.bincount(at, minlength=len(held)) > 1
        place = np.cumsum(often) - 1
        holds = np.zeros((n, int(often.sum())), np.float32)
        row = np.repeat(np.arange(n), lengths)
        holds[row[often[at]], place[at[often[at]]]] = 1
        wanted &= holds @ holds.T >= ESTIMATE * np.maximum(lengths[:, None], lengths)
    x, y = np.nonzero(wanted)
    padded = _padded(group["sketch"].to_pylist())
    wanted[x, y] = estimates(*padded, *padded, x, y) >= ESTIMATE
    # One row for a block, however many of its pairs pass: who has a pair, and a bit for each pair of these.
    some = np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))
    return _blocks([((lid, i, j), [keys[x] for x in some.tolist()], wanted[np.ix_(some, some)])] if len(some) else [])


def _blocks(found) -> pa.Table:
    rows = [(hash(place) & 0x7FFFFFFFFFFFFFFF, keys, np.packbits(pairs).tobytes()) for place, keys, pairs in found]
    return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("near", pa.int64()), ("keys", pa.list_(pa.int64())), ("mask", pa.binary())))})


def _across_lists(batches):
    """``_across`` for lists of one block, which come one after the other: most have two or three members, so many are looked at together."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rows.num_rows:
            # The last list may go on.
            last = int(np.searchsorted(rows["lid"].to_numpy(), rows["lid"][-1].as_py()))
            rest = rows.slice(last)
            yield from _across_whole(rows.slice(0, last)).to_batches()
    if rest is not None:
        yield from _across_whole(rest).to_batches()


def _across_whole(lists: pa.Table) -> pa.Table:
    lid, size, top, label = (lists[c].to_numpy() for c in ("lid", "n", "top", "label"))
    x, y, row = [], [], np.arange(lists.num_rows)
    for step in range(1, lists.num_rows):
        row = row[: np.searchsorted(row, lists.num_rows - step)]
        row = row[lid[row] == lid[row + step]]
        if not len(row):
            break
        with_ = row + step
        wanted = (label[row] != label[with_]) & (top[row] | top[with_])
        wanted &= 5 * np.minimum(size[row], size[with_]) >= 4 * np.maximum(size[row], size[with_])
        x.append(row[wanted])
        y.append(with_[wanted])
    if not x:
        return _blocks([])
    x, y = np.concatenate(x), np.concatenate(y)
    padded = _padded(lists["sketch"].to_pylist())
    near = estimates(*padded, *padded, x, y) >= ESTIMATE
    x, y = x[near], y[near]
    keys, own = lists["key"].to_numpy(), lists["own"]
    earlier: dict[int, set[int]] = {}
    for r in np.unique(np.concatenate((x, y))).tolist():
        held, here = own[r].as_py(), int(lid[r])
        earlier[r] = {v for v in held[: held.index(here)] if v >> 32 == here >> 32}
    of_list: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        if earlier[a].isdisjoint(earlier[b]):
            of_list.setdefault(int(lid[a]), []).append((a, b))
    found = []
    for place, pairs in of_list.items():
        some, at = np.unique(np.array(pairs), return_inverse=True)
        at = at.reshape(-1, 2)
        wanted = np.zeros((len(some), len(some)), bool)
        wanted[at[:, 0], at[:, 1]] = True
        found.append(((place, 0, 0), keys[some].tolist(), wanted))
    return _blocks(found)


def _packed(group):
    """One block of a list as one row; near copies share most of their sketches, so it packs well."""
    row = group.select(["lid", "block", "shared", "others", "own_blocks", "before"]).slice(0, 1)
    return row.append_column("body", pa.array([pack(group.select(list(MEMBER)))], pa.binary()))


def _across_packed(group):
    """``_across`` for two packed blocks, or for one with itself."""
    blocks = [unpack(x) for x in group["body"].to_pylist()]
    members = pa.concat_tables([x.append_column("side", pa.array([s] * x.num_rows, pa.int32())) for x, s in zip(blocks, group["side"].to_pylist(), strict=True)])
    for c in ("lid", "i", "j"):
        members = members.append_column(c, pa.array([group[c][0].as_py()] * members.num_rows, pa.int64()))
    return _across(members)


def _exact_blocks(blocks, sets):
    """Verified links of some blocks: sizes of intersections on the full sets, all pairs of a block at once where many are asked for."""
    held = {k: np.frombuffer(x, np.uint64) for k, x in zip(sets["key"].to_pylist(), sets["set"].to_pylist(), strict=True)}
    links: set[tuple[int, int]] = set()
    for keys, mask in zip(blocks["keys"].to_pylist(), blocks["mask"].to_pylist(), strict=True):
        n = len(keys)
        pairs = np.argwhere(np.unpackbits(np.frombuffer(mask, np.uint8), count=n * n).reshape(n, n))
        own = [held[k] for k in keys]
        size = np.array([len(x) for x in own])
        if len(pairs) > 4 * n:
            values, at = np.unique(np.concatenate(own), return_inverse=True)
            often = np.bincount(at, minlength=len(values)) > 1
            row, both = np.repeat(np.arange(n), size), np.zeros((n, n), np.float32)
            place = np.where(often, np.cumsum(often) - 1, -1)[at]
            order = np.argsort(place, kind="stable")
            row, place = row[order], place[order]
            for first in range(0, int(often.sum()), 4096):
                low, high = np.searchsorted(place, (first, first + 4096))
                part = np.zeros((n, 4096), np.float32)
                part[row[low:high], place[low:high] - first] = 1
                both += part @ part.T
            both = both[pairs[:, 0], pairs[:, 1]].astype(np.int64)
        else:
            both = np.array([len(np.intersect1d(own[x], own[y], assume_unique=True)) for x, y in pairs.tolist()], np.int64)
        good = pairs[100 * both >= 80 * (size[pairs[:, 0]] + size[pairs[:, 1]] - both)]
        # Links within a block that are linked already add nothing.
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in good.tolist():
            if find(x) != find(y):
                root[find(x)] = find(y)
                links.add((min(keys[x], keys[y]), max(keys[x], keys[y])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


class Work(Shelf):
    """The tables of one run."""

    def __init__(self, spark):
        super().__init__(spark, "near-dedup")

    def table(self, rows: DataFrame) -> DataFrame:
        return self.put(rows)

    def release(self, *tables: DataFrame) -> None:
        """Deletes tables that are done with. Spark's cleaner removes the shuffles behind them once the driver has forgotten their plans."""
        self.drop(*tables)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def components(work: Work, links: DataFrame) -> DataFrame:
    """(key, label) for every key in a link (a, b): label is the least key reachable. Each round takes the least label of all neighbours

    and then the label of that label, so the rounds grow with the logarithm of a chain's length; each is written before the next."""
    both = work.table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = work.table(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).withColumnRenamed("a", "key"))
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "key")
        new = labels.join(near, "key").select("key", "label", F.least("label", "near").alias("next"))
        hop = labels.select(F.col("key").alias("next"), F.col("label").alias("hop"))
        new = work.table(new.join(hop, "next").select("key", F.col("label").alias("before"), F.least("next", "hop").alias("label")))
        moved = new.filter("before != label").limit(1).count()
        work.drop(labels)
        labels = new.select("key", "label")
        if not moved:
            work.drop(both)
            return labels


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, row_key: str | None = None) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.8 or more of their sets of ``words``-word shingles.

    Returns per row of ``docs`` the id, ``n_shingles``, ``component_id`` (the smallest id reachable) and ``kept`` (id = component_id).
    Null and empty texts and texts without words have an empty set, are linked with nothing and are kept. Rows without an id are kept
    too, with a null component, and link nothing. Rows with one id and different texts are judged row by row; ``row_key``
    names a binary column that tells them apart and is returned too. Other columns are ignored; an empty table gives no rows.

    A group of exact copies is one class whatever its size; a list of near copies is split into hubs and blocks, not into one task.
    """
    spark = docs.sparkSession
    work = Work(spark)
    own_key = [F.col(row_key).alias("row")] if row_key else []
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("binary").alias("body"), *own_key)

    def sketch(batches):
        for batch in batches:
            for part in _pieces(batch):
                sets = shingle_sets(part["body"].to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [part["doc"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary()), *part.columns[2:]],
                    ["doc", "n", "digest", "sketch", *part.schema.names[2:]],
                )

    sketched = work.table(rows.mapInArrow(sketch, "doc long, n long, digest binary, sketch binary" + (", row binary" if row_key else "")))
    usable = sketched.filter("doc is not null and n > 0")
    of_digest = usable.groupBy("digest").agg(F.min("doc").alias("least"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    # A number, written with its class, names it from here on: digests are as long and as random as what they stand for in the lists.
    classes = work.table(of_digest.withColumn("key", F.monotonically_increasing_id()))
    marks = work.table(sketched.drop("sketch"))
    work.release(sketched)

    # Inverted lists. Values are cut to 32 bits here: a collision only makes a list longer.
    def spread(batches):
        for batch in batches:
            sketches, lengths = _padded(batch["sketch"].to_pylist())
            values = (sketches & np.uint64(0xFFFFFFFF)).astype(np.int64)
            values[np.arange(SKETCH) >= lengths[:, None]] = 1 << 32
            values.sort(axis=1)
            there = values < 1 << 32
            there[:, 1:] &= values[:, 1:] != values[:, :-1]
            at = pa.array(np.nonzero(there)[0])
            yield pa.RecordBatch.from_arrays([batch["key"].take(at), batch["n"].take(at), pa.array(values[there])], ["key", "n", "value"])

    values = classes.select("key", "n", "sketch").mapInArrow(spread, "key long, n long, value long")
    often = values.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1")
    met = values.join(often, "value")
    # Two sets of up to 51 shingles are compared whole and share 4/5 of the larger; larger ones share SHARED of the retained values.
    kept_values = F.least(F.col("n"), F.lit(SKETCH))
    needed = F.when(F.col("n") * 5 <= SKETCH * 4, F.ceil(F.col("n") * 0.8)).otherwise(SHARED)
    by_rarity = Window.partitionBy("key").orderBy("often", "value")
    of_class = Window.partitionBy("key")
    # Values that occur once come first in the order and need no list.
    alone = kept_values - F.count("*").over(of_class)
    listed = met.select("*", F.row_number().over(by_rarity).alias("place"), alone.alias("alone")).filter(F.col("place") + F.col("alone") <= kept_values - needed + 1)
    # A list is cut by size: near-duplicates lie in the same band of sizes (1.25 times each) or in neighbouring ones. A list holds two
    # bands, its own (``top``) and the one below, and looks at pairs with a set of its own band.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("long")
    cut = listed.withColumn("band", band).select("key", "n", "often", "value", F.inline(F.array(F.struct(F.col("band").alias("l"), F.lit(True).alias("top")), F.struct((F.col("band") + 1).alias("l"), F.lit(False).alias("top")))))
    listed = work.table(cut.select((F.shiftleft("l", 32) + F.col("value")).alias("lid"), "key", "n", "often", "top"))
    work.release()
    # Lists with the same members are one list.
    shapes = listed.groupBy("lid").agg(F.count("*").alias("members"), F.max("top").alias("any_top"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("sum"), F.min("key").alias("low"), F.max("key").alias("high"))
    shapes = shapes.filter("members > 1 and any_top").groupBy(F.shiftright("lid", 32).alias("l"), "members", "sum", "low", "high").agg(F.min("lid").alias("lid"))
    lists = work.table(listed.join(shapes.select("lid"), "lid").select("lid", "key", "n", "often", "top"))
    work.release(listed)

    # First links: every member with four hubs of its list - a set can differ from one hub and be near another. The first hub is the member
    # of the most lists: among copies with changes of their own, the one that is nearest to what they were made from.
    sized = F.when(F.col("top"), F.struct("key", "n"))
    central = lists.join(lists.groupBy("key").agg(F.count("*").alias("degree")), "key")
    hubs = central.groupBy("lid").agg(F.array(F.max_by(sized, F.when(F.col("top"), F.struct("degree", "key"))), F.min(sized), F.max(sized), F.min_by(sized, F.when(F.col("top"), F.xxhash64("key")))).alias("hubs"))
    pairs = lists.join(hubs, "lid").select("key", "n", F.explode("hubs").alias("hub"))
    alike = (F.col("key") != F.col("hub.key")) & (5 * F.least("n", "hub.n") >= 4 * F.greatest("n", "hub.n"))
    pairs = pairs.filter(alike).select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()
    sketches = classes.select("key", "n", "sketch")
    first = work.table(_passing(pairs, sketches))
    work.release()
    links = work.table(_verified(first, lambda asked: _sets(work, rows, classes, asked, words)))
    work.release(first)
    labels = components(work, links)

    # The rest: lists that still span several components, block against block; only pairs across components are looked at.
    placed = lists.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    of_label = placed.groupBy("lid", "label").agg(F.count("*").alias("c"))
    spanning = of_label.groupBy("lid").agg(F.count("*").alias("labels")).filter("labels > 1").select("lid")
    of_label = work.table(of_label.join(spanning, "lid"))
    # A large component has blocks of its own, which need not meet each other; the small ones share blocks.
    large = of_label.filter(F.col("c") >= BLOCK).withColumn("own_blocks", F.ceil(F.col("c") / BLOCK).cast("long"))
    large = large.withColumn("before", F.sum("own_blocks").over(Window.partitionBy("lid").orderBy("label")) - F.col("own_blocks"))
    small = of_label.groupBy("lid").agg(
        F.ceil(F.coalesce(F.sum(F.when(F.col("c") < BLOCK, F.col("c"))), F.lit(0)) / BLOCK).cast("long").alias("shared"),
        F.coalesce(F.sum(F.when(F.col("c") >= BLOCK, F.ceil(F.col("c") / BLOCK))), F.lit(0)).cast("long").alias("others"),
    )
    # Each class with its lists in the common order (rarest first).
    own = lists.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "lid"))), lambda v: v["lid"]).alias("own"))
    members = placed.join(small, "lid").join(large.select("lid", "label", "own_blocks", "before"), ["lid", "label"], "left")
    members = members.join(sketches.select("key", "sketch"), "key").join(own, "key")
    begin = F.col("shared") + F.col("before")
    block = F.when(F.col("own_blocks").isNull(), F.pmod(F.xxhash64("label"), F.col("shared"))).otherwise(begin + F.pmod(F.xxhash64("key"), F.col("own_blocks")))
    partners = F.filter(F.sequence(F.lit(0).cast("long"), F.col("shared") + F.col("others") - 1), lambda p: F.col("own_blocks").isNull() | (p < begin) | (p >= begin + F.col("own_blocks")))
    found = "near long, keys array<long>, mask binary"
    # Most lists are one block. Of the others each block is packed, and goes as one row to each block it must meet.
    single = members.filter("shared + others = 1").select("lid", *MEMBER).repartition("lid").sortWithinPartitions("lid")
    packed = members.filter("shared + others > 1").select("lid", block.alias("block"), "shared", "others", "own_blocks", "before", *MEMBER)
    packed = packed.groupBy("lid", "block").applyInArrow(_packed, "lid long, block long, shared long, others long, own_blocks long, before long, body binary")
    sent = packed.select("lid", "block", "body", F.explode(partners).alias("with"))
    side = F.when(F.col("block") == F.col("with"), 2).otherwise((F.col("block") > F.col("with")).cast("int"))
    sent = sent.select("lid", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "body", side.alias("side"))
    # Packed blocks are small and their pairs many: their tasks are not to be put together by size.
    met = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lid", "i", "j").groupBy("lid", "i", "j").applyInArrow(_across_packed, found)
    more = work.table(single.mapInArrow(_across_lists, found).union(met))
    work.release(of_label, lists)
    n_blocks = more.count()
    if n_blocks:
        at = F.pmod("near", F.lit(-(-n_blocks // TOGETHER)))
        asked = more.select(at.alias("at"), F.explode("keys").alias("key")).distinct()
        each = _sets(work, rows, classes, asked, words)
        blocks = more.select(at.alias("place"), "keys", "mask")
        links = links.union(work.table(blocks.groupBy("place").cogroup(each.groupBy("at")).applyInArrow(_exact_blocks, "a long, b long")))
        work.release(more)
        labels = components(work, links)

    # Component of a class, its smallest document, and back to the documents.
    named = classes.select("key", "digest", "least").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(smallest, "label").select("digest", "component_id")
    found = marks.join(by_class, "digest", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc").isNotNull(), F.col("component_id"))).otherwise(F.col("doc"))
    return found.select(F.col("doc").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"), *([F.col("row").alias(row_key)] if row_key else []))


def _passing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    a = sketches.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = sketches.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_estimated, "a long, b long")


def _sets(work: Work, rows: DataFrame, classes: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """Full set of the class of each place and class asked for (``at``, ``key``), from one document of it; no other text is hashed again.

    Up to ``BROADCAST`` ids go to every task, so that texts stay where they are; more are joined by a shuffle.
    """
    wanted = work.table(asked.join(classes.select("key", "digest", F.col("least").alias("doc")), "key"))
    ids = work.table(wanted.select("doc").distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST else ids

    def whole(batches):
        for batch in batches:
            for part in _pieces(batch):
                sets = shingle_sets(part["body"].to_pylist(), words)
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "set"])

    sets = rows.join(few, "doc", "left_semi").select("body").mapInArrow(whole, "digest binary, set binary")
    return wanted.select("at", "key", "digest").join(sets.dropDuplicates(["digest"]), "digest").select("at", "key", "set")


def _spread(pairs: DataFrame) -> DataFrame:
    """Pairs with a place near each other (``near``) where they share their first set; the partners of one set are split into bounded shares."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SETS).alias("shares"))
    return pairs.join(shares, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("shares"))).alias("near"))


def _verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links among pairs whose full sets are similar enough.

    Pairs that are near each other go to one place, some thousands to each, and a set is sent once to every place that has a pair with it.
    """
    n = max(1, -(-pairs.count() // PAIRS))
    asked = _spread(pairs).select(F.pmod("near", F.lit(n)).alias("place"), "a", "b")
    wanted = asked.select(F.col("place").alias("at"), F.col("a").alias("key")).union(asked.select("place", "b")).distinct()
    return asked.groupBy("place").cogroup(sets(wanted).groupBy("at")).applyInArrow(_exact, "a long, b long")


@query("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"), words=2)
