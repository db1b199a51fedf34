"""Detection as one Column: candidates -> validation -> overlap resolution.

The result is ``array<struct<start,end,entity_type,score,value,source>>`` with half-open code point spans.
No shuffle and no Python worker is involved, so it works unchanged in batch and streaming plans.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .recognizers import DEFAULT, FUNCTION_HITS, SCORED, FunctionRecognizer, Probe, Recognizer
from .sqltext import X, bind, empty, fn, let, lit, struct, when
from .text import running, scan
from .validate import valid_finding, valid_value

FINDINGS = "array<struct<start:int,end:int,entity_type:string,score:double,value:string,source:string>>"
EXTERNAL_HITS = "array<struct<start:int,end:int,label:string,score:double>>"
LATE_HITS = "array<struct<start:int,end:int,entity_type:string,value:string>>"

# b0/b1 are UTF-8 byte offsets (constant-time cutting later); rank/ord drive overlap resolution.
_CANDIDATE = (
    "struct<start:int,end:int,ord:int,entity_type:string,score:double,value:string,source:string,"
    "b0:int,b1:int,rank:int>"
)
_CANDIDATES = f"array<{_CANDIDATE}>"
_LATE_ORD = 1 << 30
_PACK = X("4294967296L")
# Letters whose simple case folding is ASCII although they are not (Java and Python regexes agree on them).
_FOLD_FROM, _FOLD_TO = "ſKİı", "skii"


def _lookup(table: dict, key: X, default) -> X:
    return fn.coalesce(fn.try_element_at(fn.map(*chain.from_iterable(table.items())), key), default)


def _probe(text: X) -> X:
    ascii_only = fn.octet_length(text) == fn.length(text)
    odd = [fn.contains(text, c) for c in _FOLD_FROM]
    folded = when(
        ~ascii_only & (odd[0] | odd[1] | odd[2] | odd[3]), fn.lower(fn.translate(text, _FOLD_FROM, _FOLD_TO))
    ).otherwise(fn.lower(text))
    return struct(
        digits=fn.regexp_replace(text, r"\P{Nd}++", " "),
        folded=folded,
        indic=~ascii_only & text.rlike("[ऀ-ॿ઀-૿]"),
    )


def _matches(r: Recognizer, order: int, text: X, probe: Probe, strict: bool) -> X:
    """Values, validity flags and gaps of one pattern; null when nothing valid matched.

    The gaps cost a second pass over the text, so they are only cut when some value passed its check.
    """

    def cut(values: X) -> X:
        def parts(flags: X) -> X:
            zipped = let(
                fn.split(text, r.scan, -1),
                lambda gaps: fn.transform(
                    values,
                    lambda v, i: struct(
                        value=v,
                        ok=fn.get(flags, i),
                        gap_c=fn.length(fn.get(gaps, i)),
                        gap_b=fn.octet_length(fn.get(gaps, i)),
                        len_c=fn.length(v),
                        len_b=fn.octet_length(v),
                    ),
                ),
            )
            hit = struct(
                ord=order,
                entity_type=r.entity,
                score=float(r.score),
                source=r.source,
                rank=fixed.ENTITY_RANK.get(r.entity, fixed.DEFAULT_RANK),
                parts=zipped,
            )
            return when(fn.array_contains(flags, True), hit)

        def valid(v: X) -> X:
            return valid_value(r.entity, v, strict, r.validator)

        if r.skip is None:
            return let(fn.transform(values, valid), parts)
        # Skipped runs have an empty first group; they only take up room between the matches.
        marks = fn.regexp_extract_all(text, r.scan, 1)
        return let(marks, lambda m: let(fn.transform(values, lambda v, i: (fn.get(m, i) != "") & valid(v)), parts))

    found = let(fn.regexp_extract_all(text, r.scan, 0), cut)
    return when(r.guard(probe), found) if r.guard else found


def _place(hit: X) -> X:
    """Turn values and gaps of one pattern into candidates with offsets (running sums).

    Character and byte lengths are summed together, packed into one number (characters in the upper half).
    """
    ends = running(hit.parts, lambda v, p: v + (p.gap_c + p.len_c) * _PACK + (p.gap_b + p.len_b))

    def build(at: X) -> X:
        def candidate(p: X, i: X) -> X:
            c1 = fn.shiftright(fn.get(at, i), 32).cast("int")
            b1 = (fn.get(at, i) % _PACK).cast("int")
            return when(
                p.ok,
                struct(
                    start=c1 - p.len_c,
                    end=c1,
                    ord=hit.ord,
                    entity_type=hit.entity_type,
                    score=hit.score,
                    value=p.value,
                    source=hit.source,
                    b0=b1 - p.len_b,
                    b1=b1,
                    rank=hit.rank,
                ),
            )

        return fn.filter(fn.transform(hit.parts, candidate), lambda c: c.is_set())

    return let(ends, build)


def _from_patterns(text: X, recognizers: Sequence[Recognizer | FunctionRecognizer], strict: bool) -> X:
    patterns = [(i, r) for i, r in enumerate(recognizers) if isinstance(r, Recognizer)]

    def collect(p: X) -> X:
        probe = Probe(text, p.digits, p.folded, p.indic)
        hits = [_matches(r, i, text, probe, strict) for i, r in patterns]
        return fn.flatten(fn.transform(fn.filter(fn.array(*hits), lambda h: h.is_set()), _place))

    return let(_probe(text), collect) if patterns else empty(_CANDIDATES)


def _from_function(text: X, hits: X, order: int, r: FunctionRecognizer, strict: bool) -> X:
    """Hits of a function, as candidates at its place among the recognisers."""
    inside = fn.filter(hits, lambda x: (x.start >= 0) & (x.end > x.start) & (x.end <= fn.length(text)))
    placed = _placed(
        text,
        inside,
        lambda h: lit(order),
        lambda h: fn.coalesce(h.x.entity_type, r.entity),
        lambda h: fn.coalesce(h.x.score, float(r.score)),
        lambda h: h["slice"],
        r.source,
    )
    return fn.filter(placed, lambda c: valid_finding(c.entity_type, c.value, strict)) if r.checked else placed


def _found(text: X, recognizers: Sequence[Recognizer | FunctionRecognizer], strict: bool, functions: Sequence[X]) -> X:
    """Candidates of all recognisers; ``functions`` are the hits of the function recognisers among them, in their order."""
    places = [(i, r) for i, r in enumerate(recognizers) if isinstance(r, FunctionRecognizer)]
    if len(places) != len(functions):
        raise ValueError("function recognizers work on whole texts in a column, not within cells or nested values")
    more = [_from_function(text, hits, i, r, strict) for (i, r), hits in zip(places, functions, strict=True)]
    found = _from_patterns(text, recognizers, strict)
    return fn.concat(found, *more) if more else found


def _placed(text: X, hits: X, order, entity, score, value, source: str) -> X:
    """Candidates from hits with code point bounds; ``order``, ``entity``, ``score`` and ``value`` are functions of the located hit.

    A located hit has ``x`` (the hit), ``i`` (its place in the input), ``b0`` (byte offset), and ``slice`` (its text). Hits are walked in
    the order of their starts, and text is cut at four bytes a character, so the cost is that of the text between them.
    """

    def located(raw: X) -> X:
        n = (fn.octet_length(raw) / 4).cast("int")

        def clamp(v: X) -> X:
            return fn.greatest(0, fn.least(v, n))

        def cut(first: X, end: X) -> X:
            return fn.decode(fn.substring(raw, first * 4 + 1, fn.greatest(0, end - first) * 4), "UTF-32")

        def walk(items: X) -> X:
            gaps = fn.transform(
                items, lambda s, j: fn.octet_length(cut(fn.coalesce(fn.get(items, j - 1)["at"], 0), s["at"])).cast("bigint")
            )
            offsets = running(gaps, lambda v, g: v + g)

            def one(s: X, b0: X) -> X:
                # A negative start counts from nothing: such a hit keeps what the text functions give for it.
                part = when(s.x.start < 0, fn.substring(text, s.x.start + 1, s.x.end - s.x.start)).otherwise(cut(s["at"], clamp(s.x.end)))
                whole = struct(x=s.x, i=s.i, b0=b0.cast("int"), slice=part, reach=fn.octet_length(cut(s["at"], clamp(s.x.end))))
                return let(
                    whole,
                    lambda h: struct(
                        start=h.x.start,
                        end=h.x.end,
                        ord=order(h),
                        entity_type=entity(h),
                        score=score(h),
                        value=value(h),
                        source=source,
                        b0=h.b0,
                        b1=h.b0 + h.reach,
                        rank=_lookup(fixed.ENTITY_RANK, entity(h), fixed.DEFAULT_RANK),
                    ),
                )

            return let(offsets, lambda at: fn.transform(items, lambda s, j: one(s, fn.get(at, j))))

        return let(fn.array_sort(fn.transform(hits, lambda x, i: struct(at=clamp(x.start), i=i, x=x))), walk)

    return let(fn.encode(text, "UTF-32"), located)


def _from_external(text: X, hits: X, strict: bool) -> X:
    """Hits of an outside recogniser: label map, score floor, value cut from the text, validation."""
    placed = _placed(
        text,
        hits,
        lambda h: h.i - _LATE_ORD,
        lambda h: _lookup(fixed.EXTERNAL_LABEL_ENTITY, h.x.label, h.x.label),
        lambda h: h.x.score,
        lambda h: h["slice"],
        "presidio",
    )
    return fn.filter(
        placed, lambda c: (c.score >= fixed.EXTERNAL_MIN_SCORE) & valid_finding(c.entity_type, c.value, strict)
    )


def _from_late(text: X, hits: X, strict: bool) -> X:
    """Hits of a second-stage recogniser: bounds check, fixed score, label used as it is."""
    inside = fn.filter(hits, lambda x: (x.start >= 0) & (x.end > x.start) & (x.end <= fn.length(text)))
    placed = _placed(
        text,
        inside,
        lambda h: h.i + _LATE_ORD,
        lambda h: fn.trim(h.x.entity_type),
        lambda h: lit(fixed.LATE_SCORE),
        lambda h: fn.coalesce(fn.nullif(h.x.value, ""), h["slice"]),
        "llm",
    )
    return fn.filter(placed, lambda c: valid_finding(c.entity_type, c.value, strict))


def _first_of_each(candidates: X) -> X:
    """Keep the first inserted of equal (start, end, entity)."""
    keyed = fn.transform(
        candidates, lambda c: struct(start=c.start, end=c.end, entity_type=c.entity_type, ord=c.ord, c=c)
    )

    def unique(items: X) -> X:
        def is_first(x: X, i: X) -> X:
            return let(
                fn.get(items, i - 1),
                lambda p: (i == 0)
                | (p.start != x.start)
                | (p.end != x.end)
                | (p.entity_type != x.entity_type),
            )

        return fn.transform(fn.filter(items, is_first), lambda x: x.c)

    return let(fn.sort_array(keyed), unique)


def _resolve(candidates: X) -> X:
    """Greedy choice among overlapping candidates, left to right.

    Starts never decrease and kept spans are disjoint, so a candidate can only meet the last kept one.
    """

    def better(a: X, b: X) -> X:
        same_rank = a.rank == b.rank
        longer = (a.end - a.start) > (b.end - b.start)
        return (
            (a.rank < b.rank)
            | (same_rank & (a.score > b.score))
            | (same_rank & (a.score == b.score) & longer)
        )

    def pick(items: X) -> X:
        """Positions of the kept candidates; ``last`` is the one that may still be replaced."""

        def step(s: X, i: X) -> X:
            x, kept = fn.get(items, i), fn.get(items, s.last)
            clear = (s.last < 0) | (x.start >= kept.end)
            return struct(
                last=when(clear | better(x, kept), i).otherwise(s.last),
                out=when(clear & (s.last >= 0), fn.concat(s.out, fn.array(s.last))).otherwise(s.out),
            )

        places = scan(
            fn.transform(items, lambda x, i: i),
            {"last": -1, "out": empty("array<int>")},
            step,
            lambda s: fn.concat(s.out, fn.filter(fn.array(s.last), lambda i: i >= 0)),
        )
        return fn.transform(places, lambda i: fn.get(items, i))

    return let(fn.sort_array(candidates), pick)


def resolved_spans(
    text: X,
    external: X | None = None,
    late: X | None = None,
    recognizers: Sequence[Recognizer | FunctionRecognizer] = DEFAULT,
    strict_aadhaar: bool = False,
    use_scored: bool = False,
    functions: Sequence[X] = (),
    with_candidates: bool = False,
) -> X:
    """Kept spans of one text with their byte offsets; ``external``, ``late`` and ``functions`` are hit arrays.

    ``with_candidates`` gives a struct instead: the first of each of the first stage's hits (``unique``), and what is kept of them.
    """
    scored = SCORED if use_scored else ()
    found = _found(text, (*scored, *recognizers), strict_aadhaar, functions)
    if external is not None:
        found = fn.concat(_from_external(text, external, strict_aadhaar), found)
    if external is not None or late is not None or scored or functions or with_candidates:
        # Pattern hits alone share one score, so there a repeated span can never win and needs no removal.
        found = _first_of_each(found)
    if with_candidates:
        return let(found, lambda unique: struct(unique=unique, kept=_resolve(unique)))
    if late is None:
        return _resolve(found)

    def with_late(seen: X) -> X:
        # A span already proposed in the first pass stays settled, even if it lost there: it comes first among its equals.
        fresh = fn.filter(
            _first_of_each(fn.concat(seen, _from_late(text, late, strict_aadhaar))), lambda c: c.ord >= _LATE_ORD
        )
        return let(
            _resolve(seen),
            lambda first: when(fn.size(fresh) == 0, first).otherwise(_resolve(fn.concat(first, fresh))),
        )

    return let(found, with_late)


def bind_text(body, text, external=None, late=None, recognizers=(), **more) -> Column:
    """Bind text (null read as empty) and optional hit arrays, each evaluated once per row.

    ``body(text, hits, row)`` gets the text, a dict of the given hit arrays, and the bound row. Of ``recognizers`` the functions are
    called here, on the column: their hits are bound like those from outside.
    """
    columns = {"text": F.coalesce(_col(text), F.lit(""))}
    made = [r for r in recognizers if isinstance(r, FunctionRecognizer)]
    for i, r in enumerate(made):
        columns[f"function_{i}"] = F.coalesce(r.find(columns["text"]).cast(FUNCTION_HITS), F.array().cast(FUNCTION_HITS))
    for name, value, ddl in (("external", external, EXTERNAL_HITS), ("late", late, LATE_HITS)):
        if value is not None:
            columns[name] = F.coalesce(_col(value).cast(ddl), F.array().cast(ddl))
    hits = [n for n in ("external", "late") if n in columns]
    columns.update({k: _col(v) for k, v in more.items()})

    def call(r: X) -> X:
        given = {n: r[n] for n in hits}
        return body(r["text"], given | {"functions": [r[f"function_{i}"] for i in range(len(made))]} if made else given, r)

    return bind(call, **columns)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def public(spans: X) -> X:
    """Drop the internal fields."""
    return fn.transform(
        spans,
        lambda c: struct(
            start=c.start, end=c.end, entity_type=c.entity_type, score=c.score, value=c.value, source=c.source
        ),
    )


def findings(text, *, external=None, late=None, **options) -> Column:
    """Personal data found in ``text`` (column or name): disjoint spans in text order.

    ``external`` holds first-stage hits (``EXTERNAL_HITS``), ``late`` second-stage hits (``LATE_HITS``).
    Options: ``recognizers`` (tuple of :class:`Recognizer` and :class:`FunctionRecognizer`), ``strict_aadhaar``, ``use_scored``.
    """
    return bind_text(lambda t, hits, _: public(resolved_spans(t, **hits, **options)), text, external, late, options.get("recognizers", ()))


def candidates(text, recognizers: Sequence[Recognizer | FunctionRecognizer] = DEFAULT, strict_aadhaar: bool = False) -> Column:
    """Every valid hit before overlap resolution, in insertion order."""
    return bind_text(lambda t, hits, _: public(_found(t, recognizers, strict_aadhaar, hits.get("functions", ()))), text, recognizers=recognizers)


def resolution(text, *, external=None, **options) -> Column:
    """``struct<unique, kept>`` of one detection: the hits without repeated ones (the first inserted of equal spans), and what is kept of them."""

    def both(t: X, hits: dict, _) -> X:
        return let(resolved_spans(t, **hits, **options, with_candidates=True), lambda r: struct(unique=public(r.unique), kept=public(r.kept)))

    return bind_text(both, text, external, None, options.get("recognizers", ()))


def counts_of(names: X) -> X:
    return fn.map_from_entries(
        fn.transform(
            fn.array_sort(fn.array_distinct(names)),
            lambda e: struct(e=e, n=fn.size(fn.filter(names, lambda x: x == e)).cast("bigint")),
        )
    )


def entity_counts(found) -> Column:
    """``map<entity, count>`` of a findings array (empty map when nothing was found)."""
    return bind(lambda r: let(fn.transform(r.found, lambda f: f.entity_type), counts_of), found=_col(found))
