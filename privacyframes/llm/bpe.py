"""Byte-level BPE by prefix dynamic programming: each prefix of a piece keeps the last token of its one valid encoding.

The pieces of some texts are taken in the order of their bytes, so each is an exact append to the prefix it shares with the one before.
"""

from __future__ import annotations

import base64
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from .registry import query, table

#: Bytes of long pieces and of their pairs of tokens a task remembers, each; beyond, it starts to forget (results do not depend on it).
REMEMBERED = 32 << 20
#: Bytes of an entry besides its own: the objects and their place in a table.
ENTRY, PAIR = 200, 110
#: Bytes at its end by which a token is looked for.
ENDING = 3
#: Bytes of the longest piece that is encoded abreast of others, and how many are at once; bytes of the texts whose pieces are taken together.
SHORT, ABREAST, TOGETHER = 64, 1 << 15, 1 << 21
#: Pairs of tokens remembered for short pieces, at 24 to 48 bytes each.
PAIRS = 1 << 18


class Vocabulary:
    """Tokens by rank, and which two tokens can stand side by side in an encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) >= ENDING:
                lengths.setdefault(t[-ENDING:], set(range(1, ENDING))).add(len(t))
        #: Lengths that a token ending in these bytes can have, longest first.
        self.lengths = {end: tuple(sorted(x, reverse=True)) for end, x in lengths.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}

    @classmethod
    def read(cls, lines: list[bytes]) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a token that no merge makes (a single byte, or one never reached)."""
        if token not in self.halves:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def alone(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        return len(self.tokens[token]) == 1 or self.split(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens, going back through the merges that made them, latest first."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            known = self.pairs[pair] = self.settle(left, right)
        return known

    def settle(self, left: int, right: int) -> bool:
        """As ``fits``, worked out anew."""
        tokens, ranks = self.tokens, self.ranks
        # A merge over the border happens only before both tokens beside it are merged on: it must rank lower than ``bound``.
        bound = 1 << 62
        while True:
            merged = ranks.get(tokens[left] + tokens[right])
            if merged is not None and merged < bound:
                return False
            a = self.split(left) if len(tokens[left]) > 1 else None
            b = self.split(right) if len(tokens[right]) > 1 else None
            if a is None and b is None:
                return True
            # Of the two merges the later one is undone; of equal ones, the right one, since merges run from the left.
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]


class Prefixes:
    """The encoding of a growing or edited piece of bytes: ``last[i]`` is the last token of the encoding of its first i bytes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        """Exact: what is known of the shorter prefixes stays."""
        self.text += more
        self._extend(len(self.text))

    def turn(self, text: bytes) -> None:
        """Goes on to another text; what is known of the prefixes both share stays."""
        old, n = self.text, min(len(self.text), len(text))
        same = 0
        while same < n and old[same] == text[same]:
            same += 1
        del self.last[same + 1 :]
        self.text = text
        self._extend(len(text))

    def _extend(self, until: int) -> None:
        v, text = self.vocabulary, self.text
        ranks, last, lengths, pairs, fits, shorter = v.ranks, self.last, v.lengths, v.pairs, v.fits, tuple(range(ENDING - 1, 0, -1))
        for end in range(len(last), until + 1):
            for length in lengths.get(text[end - ENDING : end], shorter) if end >= ENDING else shorter:
                if length > end:
                    continue
                token = ranks.get(text[end - length : end])
                if token is None:
                    continue
                if end == length:
                    good = v.alone(token)
                elif (good := pairs.get(last[end - length] << 32 | token)) is None:
                    good = fits(last[end - length], token)
                if good:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Replaces bytes and returns how many prefixes were computed anew.

        Prefixes before the edit are kept. Behind it the new table is computed until it runs in step with the old one over the length of
        the longest token: a last token depends on no more than that, so all later ones are the old ones.
        """
        old, moved, reach = self.last, len(new) - (end - begin), self.vocabulary.longest
        self.text = self.text[:begin] + new + self.text[end:]
        self.last = old[: begin + 1]
        done = begin
        # In step counts only where both tables see the same bytes, and no token that begins the piece.
        first, equal = max(begin + len(new), moved, 0) + reach + 1, 0
        while done < len(self.text) and equal < reach:
            done += 1
            self._extend(done)
            equal = equal + 1 if done >= first and done - moved > reach and self.last[done] == old[done - moved] else 0
        self.last += old[done - moved + 1 :]
        return done - begin

    def tokens(self) -> list[int]:
        out, at = [], len(self.text)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


class Halves(dict):
    """A table that forgets: when it is full it becomes the older half, and what is asked for again comes back from there. Bounded in bytes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size, self.older = most, 0, {}

    def keep(self, key, value, size: int):
        if self.size + size > self.most // 2:
            self.older, self.size = dict(self), 0
            self.clear()
        self[key] = value
        self.size += size
        return value


class Numbers:
    """Numbers by keys of 63 bits, looked up many at once: open addressing, with twice to four times as many places as keys."""

    def __init__(self):
        self.clear()

    def clear(self, bits: int = 10) -> None:
        self.shift, self.size = np.uint64(64 - bits), 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, -1 for a key that is not there."""
        at = self._places(keys)
        out, held = self.values[at], self.keys[at]
        left = np.flatnonzero(held != keys)
        while len(left):
            taken = held[left] != -1
            out[left] = -1
            left = left[taken]
            at[left] = (at[left] + 1) % len(self.keys)
            out[left], held[left] = self.values[at[left]], self.keys[at[left]]
            left = left[held[left] != keys[left]]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not there yet."""
        size = self.size + len(keys)
        if 2 * size > len(self.keys):
            there = self.keys >= 0
            keys, values = np.append(self.keys[there], keys), np.append(self.values[there], values)
            self.clear((2 * size - 1).bit_length())
        self.size = size
        at = self._places(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) % len(self.keys)


class Endings:
    """The tokens that a growing text ends in, longest first, for many texts at once. Tokens go by their place in the order of ranks."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        starts = np.cumsum(self.size) - self.size
        self.edges = Numbers()
        #: By state (a beginning of tokens): the state of its longest proper ending that is one, and the longest token it ends in.
        self.fallback, self.longest = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        #: By token: the longest shorter token it ends in.
        self.shorter = np.full(len(tokens), -1, np.int64)
        state = np.zeros(len(tokens), np.int64)
        for depth in range(1, int(self.size.max(initial=0)) + 1):
            some = np.flatnonzero(self.size >= depth)
            keys, which = np.unique(state[some] << 8 | data[starts[some] + depth - 1], return_inverse=True)
            first = len(self.longest)
            back = self.step(self.fallback[keys >> 8], keys & 255) if depth > 1 else np.zeros(len(keys), np.int64)
            longest = self.longest[back]
            state[some] = first + which
            done = some[self.size[some] == depth]
            self.shorter[done] = longest[state[done] - first]
            longest[state[done] - first] = done
            self.fallback, self.longest = np.append(self.fallback, back), np.append(self.longest, longest)
            self.edges.add(keys, np.arange(first, first + len(keys), dtype=np.int32))

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """States after one more byte each."""
        states = states.copy()
        out = self.edges.find(states << 8 | bytes_)
        left = np.flatnonzero(out < 0)
        while len(left):
            out[left[states[left] == 0]] = 0
            left = left[states[left] > 0]
            states[left] = self.fallback[states[left]]
            out[left] = self.edges.find(states[left] << 8 | bytes_[left])
            left = left[out[left] < 0]
        return out.astype(np.int64)


class Encoder:
    """Encodes many pieces together, byte by byte in their order: a prefix that neighbours share is computed once, and each is an append to
    the prefix before it. Long pieces are turned into each other one by one."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.table = vocabulary, Prefixes(vocabulary)
        self.ranks = np.array(sorted(vocabulary.tokens), np.int64)
        self.endings = Endings([vocabulary.tokens[r] for r in self.ranks.tolist()])
        self.pairs, self.single = Numbers(), np.full(len(self.ranks), -1, np.int8)
        self.long = Halves(REMEMBERED)

    def encode(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of every piece as little-endian unsigned 32-bit numbers, in the order of the pieces' bytes. A piece that is a token is that token."""
        pieces = sorted(pieces)
        return dict(zip(pieces, self.ids(pa.array(pieces, pa.binary())).to_pylist(), strict=True))

    def ids(self, pieces: pa.Array) -> pa.Array:
        """Ids of every piece (binary or string) in the order of the pieces."""
        if not len(pieces):
            return pa.array([], pa.large_binary())
        order = pc.array_sort_indices(pieces)
        pieces = pieces.take(order)
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.frombuffer(pieces.buffers()[1], "<i4", len(pieces)).astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        short = np.flatnonzero(sizes <= SHORT)
        out, counts, made = [], np.zeros(len(pieces), np.int64), {}
        for i in np.flatnonzero(sizes > SHORT).tolist():
            made[i] = self._long(data[starts[i] : starts[i] + sizes[i]].tobytes())
            counts[i] = len(made[i]) // 4
        if len(self.vocabulary.pairs) * PAIR > REMEMBERED:
            self.vocabulary.pairs.clear()
        for first in range(0, len(short), ABREAST):
            some = short[first : first + ABREAST]
            ids, counts[some] = self._short(data, starts[some], sizes[some])
            out.append(ids)
        ends = np.append(0, np.cumsum(counts))
        ids = np.empty(ends[-1], "<u4")
        ids[np.repeat(sizes <= SHORT, counts)] = np.concatenate([np.empty(0, "<u4"), *out])
        for i, found in made.items():
            ids[ends[i] : ends[i + 1]] = np.frombuffer(found, "<u4")
        sorted_ids = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)])
        back = np.empty(len(pieces), np.int64)
        back[order.to_numpy()] = np.arange(len(pieces))
        return sorted_ids.take(pa.array(back))

    def _long(self, piece: bytes) -> bytes:
        kept = self.long
        found = kept.get(piece) or kept.older.get(piece)
        if found is None:
            whole = self.vocabulary.ranks.get(piece)
            if whole is None:
                self.table.turn(piece)
            found = np.array(self.table.tokens() if whole is None else [whole], "<u4").tobytes()
        size = ENTRY + len(piece) + len(found)
        if piece not in kept and size < kept.most // 64:
            kept.keep(piece, found, size)
        return found

    def _short(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted pieces one after the other, and how many each has."""
        endings = self.endings
        # ``last[e, i]``: last token of the encoding of the first e bytes of piece i. Pieces with one beginning share a node and its state.
        last = np.full((int(sizes.max()) + 1, len(sizes)), -1, np.int32)
        rows, node, state = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), np.zeros(1, np.int64)
        for end in range(1, len(last)):
            more = sizes[rows] >= end
            rows, node = rows[more], node[more]
            byte = data[starts[rows] + end - 1]
            new = np.append(True, (node[1:] != node[:-1]) | (byte[1:] != byte[:-1]))
            heads = np.flatnonzero(new)
            state = endings.step(state[node[heads]], byte[heads])
            node, heads = np.cumsum(new) - 1, rows[heads]
            longest = endings.longest[state]
            token, left = longest.copy(), np.arange(len(heads))
            while len(left):
                right = token[left]
                if (right < 0).any():
                    raise ValueError("a byte is missing from the vocabulary")
                before = last[end - endings.size[right], heads[left]].astype(np.int64)
                left = left[~self._good(before, right)]
                token[left] = endings.shorter[token[left]]
            last[end, rows] = token[node]
            # A piece that is a token is that token.
            over, whole = sizes[rows] == end, longest[node]
            over &= endings.size[whole] == end
            last[end, rows[over]] = whole[over]
        counts, steps = np.zeros(len(sizes), np.int64), []
        rows, end = np.flatnonzero(sizes > 0), sizes[sizes > 0]
        while len(rows):
            token = last[end, rows]
            steps.append((rows, token))
            counts[rows] += 1
            end = end - endings.size[token]
            rows, end = rows[end > 0], end[end > 0]
        ids, ends = np.empty(counts.sum(), "<u4"), np.cumsum(counts)
        for back, (rows, token) in enumerate(steps, 1):
            ids[ends[rows] - back] = self.ranks[token]
        return ids, counts

    def _good(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens can stand side by side; without a left one, whether the right one's bytes encode to it."""
        good, ranks, alone = np.empty(len(right), bool), self.ranks, left < 0
        if alone.any():
            some = right[alone]
            for t in np.unique(some[self.single[some] < 0]).tolist():
                self.single[t] = self.vocabulary.alone(int(ranks[t]))
            good[alone] = self.single[some] > 0
        keys = (left << 32 | right)[~alone]
        known = self.pairs.find(keys)
        if (known < 0).any():
            new, which = np.unique(keys[known < 0], return_inverse=True)
            made = np.array([self.vocabulary.settle(a, b) for a, b in zip(ranks[new >> 32].tolist(), ranks[new & 0xFFFFFFFF].tolist(), strict=True)], np.int32)
            known[known < 0] = made[which]
            if self.pairs.size + len(new) > PAIRS:
                self.pairs.clear()
            self.pairs.add(new[:PAIRS], made[:PAIRS])
        good[~alone] = known > 0
        return good


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    return np.frombuffer(vocabulary.encoder.encode([piece])[piece], "<u4").tolist()


def bound(parts: pa.Array, ends: np.ndarray) -> pa.Array:
    """Joins consecutive values of a large binary array: value i of the result goes from ``ends[i]`` to ``ends[i + 1]``."""
    offsets = np.frombuffer(parts.buffers()[1], "<i8", len(parts) + 1)[ends] if len(parts) else np.zeros(len(ends), "<i8")
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("the ids of texts taken together exceed 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.astype("<i4")), parts.buffers()[2]])


def bpe_encode(docs: DataFrame, lines: list[bytes], pattern: str, id_column: str = "doc_id", text_column: str = "text", extra: list[str] = (), decoded: bool = True) -> DataFrame:
    """Ids of every whole text: the id, ``extra`` columns, ``ids`` (little-endian unsigned 32-bit), with ``decoded`` the bytes they decode to, and ``round_trip``.

    ``lines`` are a vocabulary's lines (base64 of the token, rank), broadcast: about a megabyte. Each match of ``pattern`` is encoded
    separately; special tokens are ordinary text. Null and empty texts have no ids. ``round_trip`` says whether the ids decode to the text.
    One row per row, in any order; nothing is shuffled. Columns named ids, decoded or round_trip cannot be extra ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lines)
    results = ["ids", "decoded", "round_trip"] if decoded else ["ids", "round_trip"]

    def encode(batches):
        import regex

        vocabulary, split = Vocabulary.read(shared.value), regex.compile(pattern)
        encoder = vocabulary.encoder
        tokens = pa.array([vocabulary.tokens[r] for r in encoder.ranks.tolist()], pa.large_binary())
        sparse = len(tokens) and encoder.ranks[-1] >= len(tokens)

        def taken(batch):
            """Rows with some text together, so that the pieces they have in common are encoded once and next to their like."""
            lengths = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            first = 0
            while first < len(lengths):
                last = max(first + 1, int(np.searchsorted(lengths, (lengths[first - 1] if first else 0) + TOGETHER, "right")))
                yield batch.slice(first, last - first)
                first = last

        def worked(part):
            texts, empty = part.column(part.num_columns - 1), pa.array([], pa.string())
            found = [pa.array(split.findall(t), pa.string()) if (t := x.as_py()) else empty for x in texts]
            ends = np.cumsum([0, *map(len, found)])
            # Pieces are numbered: each is encoded once, and the ids of its places are taken by its number.
            numbered = pa.concat_arrays([empty, *found]).dictionary_encode()
            del found
            ids = bound(encoder.ids(numbered.dictionary).take(numbered.indices), ends)
            del numbered
            places = np.frombuffer(ids.buffers()[2] or b"", "<u4")
            if sparse:
                places = np.searchsorted(encoder.ranks, places)
            back = bound(tokens.take(pa.array(places)), np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1) // 4)
            same = pc.equal(back, texts.cast(pa.binary()).fill_null(b""))
            columns = [ids, back, same] if decoded else [ids, same]
            return pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *results])

        for batch in batches:
            for part in taken(batch):
                yield worked(part)

    rows = docs.select(F.col(id_column), *extra, F.col(text_column).alias("__text"))
    kinds = [StructField(c, BooleanType() if c == "round_trip" else BinaryType()) for c in results]
    return rows.mapInArrow(encode, StructType(rows.schema.fields[:-1] + kinds))


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[list[bytes], str]:
    """Lines and pattern of a public tokenizer, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read().splitlines(), public_tokenizers.PATTERN


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    return digest(bpe_encode(table(spark, sf_dir, "documents"), *public_vocabulary()))
