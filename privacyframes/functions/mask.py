"""Replacement text: masking, redaction, tokens, and splicing into the original."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .detect import FINDINGS, _col, bind_text, public, resolved_spans
from .sqltext import X, bind, empty, fn, let, lit, struct, when
from .text import WORD, compact_upper, decimal_digits, head, is_digits, running, stars, strip, tail, words

TOKENS = "array<struct<token:string,entity_type:string,original_value:string>>"


def check_mode(mode: str) -> str:
    if mode not in fixed.MODES:
        raise ValueError(f"unknown mode {mode!r}: use one of {', '.join(sorted(fixed.MODES))}")
    return mode


def _after(v: X, mark: str) -> X:
    """Everything behind the first ``mark``."""
    return fn.substring(v, fn.locate(mark, v) + 1, fn.length(v))


def _initial_stars(w: X) -> X:
    return fn.concat(head(w, 1), stars(fn.length(w) - 1))


def mask_default(v: X) -> X:
    n = fn.length(v)
    return when(n <= 2, stars(n)).otherwise(fn.concat(head(v, 1), stars(n - 2), tail(v, 1)))


def mask_email(v: X) -> X:
    first = fn.substring(v, lit(1), fn.least(fn.locate("@", v) - 1, lit(1)))
    return fn.concat(first, lit("***@"), _after(v, "@"))


def mask_phone(v: X) -> X:
    return let(decimal_digits(v), lambda d: fn.concat(stars(fn.length(d) - 2), tail(d, 2)))


def mask_birth_date(v: X) -> X:
    def build(parts: X) -> X:
        last = fn.element_at(parts, -1)
        ok = (fn.size(parts) == 3) & is_digits(last)
        return when(ok, fn.concat(lit("XX/XX/"), tail(last, 4))).otherwise("[MASKED_DOB]")

    return let(fn.split(strip(v), r"[/\-.]", -1), build)


def mask_pan(v: X) -> X:
    return let(
        compact_upper(v),
        lambda c: when(fn.length(c) == 10, fn.concat(head(c, 2), lit("****"), tail(c, 2))).otherwise("[MASKED_PAN]"),
    )


def mask_address(v: X) -> X:
    def one(w: X) -> X:
        return when(is_digits(w) | (fn.length(w) <= 2), w).otherwise(_initial_stars(w))

    return fn.array_join(fn.transform(fn.regexp_extract_all(v, lit(f"[{WORD}]+"), lit(0)), one), " ")


def mask_person(v: X) -> X:
    return fn.array_join(fn.transform(words(v), _initial_stars), " ")


def _middle(v: X, keep_head: int, keep_tail: int, otherwise: str) -> X:
    kept = keep_head + keep_tail
    return let(
        decimal_digits(v),
        lambda d: when(
            fn.length(d) >= kept, fn.concat(head(d, keep_head), stars(fn.length(d) - kept), tail(d, keep_tail))
        ).otherwise(otherwise),
    )


def _trimmed(v: X, length: int, build, otherwise: str) -> X:
    return let(fn.upper(strip(v)), lambda u: when(fn.length(u) == length, build(u)).otherwise(otherwise))


def mask_upi(v: X) -> X:
    user = fn.substring(v, lit(1), fn.locate("@", v) - 1)
    return fn.concat(_initial_stars(user), lit("@"), _after(v, "@"))


def _grouped_digits(v: X, length: int, shown: str) -> X:
    return let(
        decimal_digits(v),
        lambda d: when(fn.length(d) == length, fn.concat(lit(shown), tail(d, 4))).otherwise(mask_default(v)),
    )


def mask_ip(v: X) -> X:
    return let(
        fn.split(v, r"\.", -1),
        lambda p: when(
            fn.size(p) == 4, fn.concat(fn.get(p, lit(0)), lit("."), fn.get(p, lit(1)), lit(".***.***"))
        ).otherwise(mask_default(v)),
    )


def mask_x(entity: X, value: X) -> X:
    """Masked form of one value, by entity."""
    has_at = fn.locate("@", value) > 0
    return (
        when((entity == "EMAIL_ADDRESS") & has_at, mask_email(value))
        .when(entity == "PHONE_NUMBER", mask_phone(value))
        .when(entity == "PERSON_NAME", mask_person(value))
        .when(entity == "IP_ADDRESS", mask_ip(value))
        .when(entity == "IN_ADDRESS", mask_address(value))
        .when(entity == "CREDIT_CARD", _middle(value, 6, 4, "[MASKED_CARD]"))
        .when(entity == "BANK_ACCOUNT", _middle(value, 2, 2, "[MASKED_ACCOUNT]"))
        .when(entity == "IN_AADHAAR", _grouped_digits(value, 12, "XXXX XXXX "))
        .when(entity == "IN_VID", _grouped_digits(value, 16, "XXXX XXXX XXXX "))
        .when(entity == "DATE_OF_BIRTH", mask_birth_date(value))
        .when(entity == "IN_PAN", mask_pan(value))
        .when(
            entity == "IFSC_CODE",
            _trimmed(value, 11, lambda u: fn.concat(head(u, 4), lit("0******")), "[MASKED_IFSC]"),
        )
        .when(
            entity == "PASSPORT_NUMBER",
            _trimmed(value, 8, lambda u: fn.concat(head(u, 1), lit("******"), tail(u, 1)), "[MASKED_PASSPORT]"),
        )
        .when(
            entity.isin("DEVICE_ID", "FINGERPRINT_TEMPLATE", "FACE_TEMPLATE"),
            when(fn.length(value) <= 8, lit("[MASKED_ID]")).otherwise(
                fn.concat(head(value, 4), lit("***"), tail(value, 3))
            ),
        )
        .when(entity == "BANK_NAME", lit("[REDACTED_BANK]"))
        .when((entity == "UPI_ID") & has_at, mask_upi(value))
        .otherwise(mask_default(value))
    )


def redact_x(entity: X) -> X:
    return fn.concat(lit("[REDACTED_"), entity, lit("]"))


def _cut(raw: X, b0: X, b1: X) -> X:
    return fn.substring(raw, b0 + 1, b1 - b0).cast("string")


def token_list(spans: X, raw: X) -> X:
    """Token of every span, in span order.

    Numbers run from the right end of the chunk, one counter for all entities; an equal (entity, value)
    keeps its first number. Work is sorting plus two scans, so long chunks stay near-linear.
    """
    keyed = fn.transform(
        fn.reverse(spans),
        lambda s, i: struct(
            key=fn.concat_ws(":", fn.length(s.entity_type), s.entity_type, _cut(raw, s.b0, s.b1)),
            pos=i,
            entity_type=s.entity_type,
        ),
    )

    def mark(items: X) -> X:
        """Position of the first equal key, for items sorted by (key, pos)."""
        starts = fn.transform(items, lambda x, i: when((i == 0) | (fn.get(items, i - 1).key != x.key), x.pos))
        return let(running(starts, lambda v, x: fn.coalesce(x, v)), lambda lead: by_lead(items, lead))

    def by_lead(items: X, lead: X) -> X:
        pairs = fn.transform(items, lambda x, i: struct(lead=fn.get(lead, i), pos=x.pos, entity_type=x.entity_type))
        return let(fn.sort_array(pairs), number)

    def number(pairs: X) -> X:
        ticks = fn.transform(
            pairs, lambda p, i: when((i == 0) | (fn.get(pairs, i - 1).lead != p.lead), 1).otherwise(0)
        )
        return let(running(ticks, lambda v, x: v + x), lambda n: in_span_order(pairs, n))

    def in_span_order(pairs: X, n: X) -> X:
        return fn.sort_array(
            fn.transform(pairs, lambda p, i: struct(order=-p.pos, entity_type=p.entity_type, n=fn.get(n, i)))
        )

    def name(t: X) -> X:
        digits = t.n.cast("string")
        return fn.concat("TOKEN_", t.entity_type, "_", fn.lpad(digits, fn.greatest(4, fn.length(digits)), "0"))

    return fn.transform(let(fn.sort_array(keyed), mark), name)


def splice(spans: X, raw: X, mode: X | str) -> X:
    """``struct<sanitized, tokens>``: every span replaced; tokens are empty unless tokenizing.

    Gaps are cut from the UTF-8 bytes by offset, so the cost is linear in the text length.
    """
    none = empty("array<string>")
    if isinstance(mode, str):
        tokens = token_list(spans, raw) if mode == "tokenize" else none
    else:
        tokens = when(mode == "tokenize", token_list(spans, raw)).otherwise(none)

    def replacement(s: X, i: X, tok: X) -> X:
        options = {
            "mask": lambda: mask_x(s.entity_type, _cut(raw, s.b0, s.b1)),
            "redact": lambda: redact_x(s.entity_type),
            "tokenize": lambda: fn.get(tok, i),
        }
        if isinstance(mode, str):
            return options[mode]()
        return when(mode == "mask", options["mask"]()).when(mode == "redact", options["redact"]()).otherwise(
            options["tokenize"]()
        )

    def assemble(tok: X) -> X:
        def piece(s: X, i: X) -> X:
            prev = when(i == 0, 0).otherwise(fn.get(spans, i - 1).b1)
            return fn.concat(_cut(raw, prev, s.b0), replacement(s, i, tok))

        end = fn.coalesce(fn.get(spans, fn.size(spans) - 1).b1, 0)
        entries = fn.transform(
            tok,
            lambda t, i: let(
                fn.get(spans, i),
                lambda s: struct(token=t, entity_type=s.entity_type, original_value=_cut(raw, s.b0, s.b1)),
            ),
        )
        return struct(
            sanitized=fn.concat(fn.array_join(fn.transform(spans, piece), ""), _cut(raw, end, fn.octet_length(raw))),
            tokens=entries.cast(TOKENS),
        )

    return let(tokens, assemble)


def _sanitized(text: X, mode: X | str, hits: dict, options: dict) -> X:
    def build(spans: X) -> X:
        return let(
            let(text.cast("binary"), lambda raw: splice(spans, raw, mode)),
            lambda s: struct(sanitized=s.sanitized, findings=public(spans), tokens=s.tokens),
        )

    return let(resolved_spans(text, **hits, **options), build)


def known_mode(mode: Column) -> Column:
    """Whether a requested mode is one of the three; null is none."""
    return F.coalesce(mode.isin(*fixed.MODES), F.lit(False))


def checked_mode(mode: Column) -> Column:
    """The mode column itself; a value outside the three modes stops the query."""
    message = F.concat(F.lit("Invalid mode: "), F.coalesce(mode, F.lit("null")))
    return F.when(known_mode(mode), mode).otherwise(F.raise_error(message))


def sanitize_struct(text, mode="mask", *, external=None, late=None, **options) -> Column:
    """``struct<sanitized, findings, tokens>`` of one text, each part computed once.

    ``mode`` is 'mask', 'redact' or 'tokenize', or a column holding one of them per row. Null text stays null.
    """
    text, functions = _col(text), options.get("recognizers", ())
    if isinstance(mode, str):
        check_mode(mode)
        out = bind_text(lambda t, hits, _: _sanitized(t, mode, hits, options), text, external, late, functions)
    else:
        out = bind_text(
            lambda t, hits, r: _sanitized(t, r["mode"], hits, options), text, external, late, functions, mode=checked_mode(mode)
        )
    return F.when(text.isNotNull(), out)


def sanitize_cells(cells, mode: str = "mask", **options) -> Column:
    """The same for an array of texts, element by element; null cells stay null."""
    check_mode(mode)
    return bind(
        lambda r: fn.transform(r.cells, lambda t: when(t.is_set(), _sanitized(t, mode, {}, options))),
        cells=_col(cells),
    )


def sanitize(text, mode="mask", **options) -> Column:
    """Sanitized text only."""
    return sanitize_struct(text, mode, **options).getField("sanitized")


def mask_value(entity, value) -> Column:
    """Masked form of one value."""
    return bind(lambda r: mask_x(r.entity, r.value), entity=_col(entity), value=_col(value))


def redact_value(entity) -> Column:
    return F.concat(F.lit("[REDACTED_"), _col(entity), F.lit("]"))


_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def sanitize_json(document, mode: str = "mask", **options) -> Column:
    """``struct<sanitized, findings>`` of JSON text of any shape: every string value is its own chunk.

    Keys, numbers and layout stay as they are. Needs no schema, so mixed documents share one column.
    """
    check_mode(mode)

    def body(r: X) -> X:
        def per_literal(literals: X, gaps: X) -> X:
            def one(lit_text: X, i: X) -> X:
                plain = fn.get(fn.from_json(fn.concat("[", lit_text, "]"), "array<string>"), 0)
                clean = let(plain, lambda t: _sanitized(t, mode, {}, options))
                is_key = fn.get(gaps, i + 1).rlike(r"^\s*:")
                return when(is_key, struct(text=lit_text, findings=empty(FINDINGS))).otherwise(
                    let(
                        clean,
                        lambda c: struct(
                            text=when(fn.size(c.findings) == 0, lit_text).otherwise(
                                fn.regexp_replace(fn.to_json(fn.array(c.sanitized)), r"^\[|\]$", "")
                            ),
                            findings=c.findings,
                        ),
                    )
                )

            def join(parts: X) -> X:
                pieces = fn.transform(gaps, lambda g, i: fn.concat(g, fn.coalesce(fn.get(parts, i)["text"], "")))
                return struct(
                    sanitized=fn.array_join(pieces, ""),
                    findings=fn.flatten(fn.transform(parts, lambda p: p.findings)),
                )

            return let(fn.transform(literals, one), join)

        return let(
            fn.regexp_extract_all(r.doc, _JSON_STRING, 0),
            lambda literals: let(fn.split(r.doc, _JSON_STRING, -1), lambda gaps: per_literal(literals, gaps)),
        )

    document = _col(document)
    return F.when(document.isNotNull(), bind(body, doc=document))


_CSV_CELL = (
    r'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+|\z)|[^,"\r\n][^,\r\n]*+)?+(?:,|\r\n|\n|\r|\z)'
)


def _csv_left_open(token: X) -> X:
    """Quoted, but the text ends before the closing quote: everything is content."""
    return token.rlike(r'\A"[^"]*+(?:""[^"]*+)*+\z')


def _csv_end(token: X) -> X:
    """What ends a cell: a comma, a line end, or nothing at the end of the text."""
    return when(_csv_left_open(token), "").otherwise(fn.regexp_extract(token, r"(,|\r\n|\n|\r)\z", 1))


def _csv_quoted(token: X) -> X:
    return fn.startswith(token, '"')


def _csv_value(token: X) -> X:
    """A cell's content. Behind a closing quote further characters may follow; they belong to the cell."""
    raw = fn.left(token, fn.length(token) - fn.length(_csv_end(token)))
    inner = fn.regexp_extract(raw, r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"?+(.*)\z', 1)
    rest = fn.regexp_extract(raw, r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"?+(.*)\z', 2)
    return when(_csv_quoted(token), fn.concat(fn.replace(inner, '""', '"'), rest)).otherwise(raw)


def _csv_tokens(document: X, body) -> X:
    """``body`` of the cells with what ends them. At the end of the text an empty cell is real only behind a comma."""

    def trimmed(tokens: X) -> X:
        n = fn.size(tokens)
        last, second = fn.get(tokens, n - 1), fn.get(tokens, n - 2)
        spare = (last == "") & (second.is_null() | ~fn.endswith(second, ",") | _csv_left_open(second))
        return let(when(spare, fn.slice(tokens, 1, n - 1)).otherwise(tokens), body)

    return let(fn.regexp_extract_all(document, _CSV_CELL, 0), trimmed)


def csv_rows(document) -> Column:
    """``array<array<string>>``: every row of CSV text with all its cells, however many; an empty line is a row without cells."""

    def rows(tokens: X) -> X:
        n = fn.size(tokens)
        places = when(n > 0, fn.sequence(0, n - 1)).otherwise(X("cast(array() as array<int>)"))
        closes = fn.filter(places, lambda i: (i == n - 1) | (_csv_end(fn.get(tokens, i)) != ","))

        def cut(ends: X) -> X:
            def row(end: X, j: X) -> X:
                first = fn.coalesce(fn.get(ends, j - 1) + 1, X("0"))
                cells = fn.transform(fn.slice(tokens, first + 1, end - first + 1), lambda t: _csv_value(t))
                blank = (end == first) & ~_csv_quoted(fn.get(tokens, end)) & (fn.get(cells, 0) == "")
                return when(blank, X("cast(array() as array<string>)")).otherwise(cells)

            return fn.transform(ends, row)

        return let(closes, cut)

    document = _col(document)
    return F.when(document.isNotNull(), bind(lambda r: _csv_tokens(r.doc, rows), doc=document))


def sanitize_csv(document, mode: str = "mask", **options) -> Column:
    """``struct<sanitized, findings>`` of CSV text: every cell, the header included, is its own chunk.

    Written back with minimal quoting and ``\n`` line ends; empty lines stay.
    """
    check_mode(mode)

    def one(token: X, before: X) -> X:
        end = _csv_end(token)
        line_end = when(end == ",", ",").otherwise(lit("\n"))
        starts_row = before.is_null() | ~fn.endswith(before, ",")
        alone = starts_row & (end != ",")

        def write(c: X) -> X:
            needs = c.sanitized.rlike(r'[,"\r\n]') | ((c.sanitized == "") & alone & _csv_quoted(token))
            cell = when(needs, fn.concat('"', fn.replace(c.sanitized, '"', '""'), '"')).otherwise(c.sanitized)
            return struct(text=fn.concat(cell, line_end), findings=c.findings)

        return let(let(_csv_value(token), lambda t: _sanitized(t, mode, {}, options)), write)

    def rows(tokens: X) -> X:
        parts = fn.transform(tokens, lambda t, i: one(t, fn.get(tokens, i - 1)))
        return let(
            parts,
            lambda ps: struct(
                sanitized=fn.array_join(fn.transform(ps, lambda p: p["text"]), ""),
                findings=fn.flatten(fn.transform(ps, lambda p: p.findings)),
            ),
        )

    document = _col(document)
    return F.when(document.isNotNull(), bind(lambda r: _csv_tokens(r.doc, rows), doc=document))


def restore(sanitized, findings, tokens) -> Column:
    """Undo tokenization of one chunk: every token goes back where its finding was, whatever the text around it looks like.

    ``findings`` and ``tokens`` run in parallel, as sanitizing returns them. Pieces are cut at four bytes a character, so the cost is
    linear in the text length.
    """

    def body(r: X) -> X:
        sizes = fn.transform(
            r.tokens,
            lambda t, i: let(
                fn.get(r.findings, i),
                lambda f: struct(gap=(f["start"] - fn.coalesce(fn.get(r.findings, i - 1)["end"], 0)).cast("bigint"), n=fn.length(t.token).cast("bigint")),
            ),
        )

        def build(parts: X, raw: X) -> X:
            def cut(first: X, n: X) -> X:
                return fn.decode(fn.substring(raw, (first * 4 + 1).cast("int"), (n * 4).cast("int")), "UTF-32")

            def pieces(ends: X) -> X:
                def piece(x: X, i: X) -> X:
                    return fn.concat(cut(fn.get(ends, i) - x.n - x.gap, x.gap), fn.get(r.tokens, i).original_value)

                done = fn.coalesce(fn.get(ends, fn.size(ends) - 1), X("0L"))
                rest = cut(done, fn.octet_length(raw) / 4 - done)
                return fn.concat(fn.array_join(fn.transform(parts, piece), ""), rest)

            return let(running(parts, lambda v, x: v + x.gap + x.n), pieces)

        return let(sizes, lambda parts: let(fn.encode(r.sanitized, "UTF-32"), lambda raw: build(parts, raw)))

    sanitized = _col(sanitized)
    return F.when(sanitized.isNotNull(), bind(body, sanitized=sanitized, findings=_col(findings), tokens=_col(tokens)))
