"""Secrets in text, by DataFrame and SQL functions only: three patterns, and character Markov models for keys without a pattern.

Two first-order models over the characters of a token, one of random strings and one of ordinary identifiers, are trained from labelled
samples; a token is a secret where the log-likelihood ratio is high enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import X, bind, fn, let, struct, when
from ..functions.text import running
from .registry import query, table
from .sampling import bounded

# The patterns of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: a run that is too short holds no longer one
HEX = r"[0-9a-f]{24,}"  # the same of [0-9a-f]+
KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6
SPANS = "array<struct<kind:string,start:int,end:int>>"

#: Characters of a token, shortest token looked at, documents whose words are the samples of identifiers at most, random strings made.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SHORTEST, IDENTIFIER_DOCUMENTS, RANDOM_STRINGS = 20, 2_000, 3_000
#: Least log-likelihood ratio of a secret in nats per character step.
LEAST_RATIO = 0.5
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}"


def _placed(text: X, pattern: str, keep=None) -> X:
    """Matches of a pattern with their places in code points; gaps are cut only where something matched."""

    def cut(values: X) -> X:
        def place(gaps: X) -> X:
            parts = fn.transform(values, lambda v, i: struct(v=v, n=fn.length(v).cast("bigint"), gap=fn.length(fn.get(gaps, i)).cast("bigint")))

            def build(p: X) -> X:
                ends = running(p, lambda at, x: at + x.gap + x.n)
                return let(ends, lambda e: fn.transform(p, lambda x, i: struct(value=x.v, start=(fn.get(e, i) - x.n).cast("int"), end=fn.get(e, i).cast("int"))))

            return let(parts, build)

        found = let(fn.split(text, pattern, -1), place)
        return when(fn.size(values) > 0, fn.filter(found, keep) if keep else found).otherwise(X("cast(array() as array<struct<value:string,start:int,end:int>>)"))

    return let(fn.regexp_extract_all(text, pattern, 0), cut)


def _piece(raw: X, first: X, n: X) -> X:
    """Characters of a text encoded in four bytes each: a cut costs its own length, not that of the text before it."""
    return fn.decode(fn.substring(raw, (first * 4 + 1).cast("int"), (n * 4).cast("int")), "UTF-32")


def _named(kind: str, found: X) -> X:
    return fn.transform(found, lambda x: struct(kind=kind, start=x.start, end=x.end))


def _if_any(text: X, needles: list[str], found: X) -> X:
    guard = fn.contains(text, needles[0])
    for n in needles[1:]:
        guard = guard | fn.contains(text, n)
    return when(guard, found).otherwise(X("cast(array() as array<struct<value:string,start:int,end:int>>)"))


def base_spans(text: Column) -> Column:
    """The spans of the three patterns as arrays ``assign``, ``access`` and ``hex``, by place. Null text has none."""

    def build(t: X) -> X:
        long_enough = lambda x: fn.length(fn.regexp_extract(x.value, ASSIGN, 2)) >= LEAST_VALUE
        assign = _if_any(fn.lower(t), ["passw", "secret", "token", "api"], _placed(t, ASSIGN, long_enough))
        return struct(
            assign=_named("assign", assign),
            access=_named("access", _if_any(t, ["AKIA"], _placed(t, ACCESS))),
            hex=_named("hex", _placed(t, HEX)),
        )

    return bind(lambda row: build(row.t), t=F.coalesce(text, F.lit("")))


def _transitions(samples: DataFrame) -> DataFrame:
    """Counts of neighbouring characters per label: one row per label and pair, at most."""
    characters = F.filter(F.transform(F.split("sample", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda i: i >= 0)
    steps = samples.select("label", characters.alias("at")).filter(F.size("at") > 1)
    pair = F.expr(f"transform(sequence(1, size(at) - 1), i -> get(at, i - 1) * {len(ALPHABET)} + get(at, i))")
    return steps.select("label", F.explode(pair).alias("pair")).groupBy("label", "pair").count()


def train(docs: DataFrame, id_column: str, text_column: str) -> list[float]:
    """Log-likelihood ratio of every pair of characters (a table of fixed size, held by the driver).

    Samples labelled random are hex, base64 and base-36 strings made from digests of numbers; samples labelled ordinary are the words of
    at most ``IDENTIFIER_DOCUMENTS`` documents, alone and put together as identifiers usually are.
    """
    spark = docs.sparkSession
    n = spark.range(RANDOM_STRINGS).withColumn("digest", F.sha2(F.col("id").cast("string"), 512))
    bits = F.unhex("digest")
    random = n.select(F.explode(F.array(F.substring("digest", 1, 40), F.base64(bits), F.regexp_replace(F.base64(bits), "[a-z+/=]", ""))).alias("sample"))
    words = bounded(docs.filter(F.col(text_column).isNotNull()).select(id_column, text_column), [id_column, text_column], IDENTIFIER_DOCUMENTS).select(F.regexp_extract_all(text_column, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    ordinary = words.select(F.explode(F.expr("transform(w, (x, i) -> case i % 4 when 0 then x when 1 then concat(lower(x), '_', lower(coalesce(get(w, i + 1), ''))) when 2 then concat(x, initcap(coalesce(get(w, i + 1), ''))) else concat(lower(x), '-', lower(coalesce(get(w, i + 1), '')), '/') end)")).alias("sample"))
    counted = _transitions(random.select(F.lit(1).alias("label"), "sample").unionByName(ordinary.select(F.lit(0).alias("label"), "sample"))).collect()
    size = len(ALPHABET)
    counts = [[0.5] * (size * size) for _ in range(2)]
    for r in counted:
        counts[r["label"]][r["pair"]] += r["count"]
    logs = [[math.log(c / sum(row[i // size * size : i // size * size + size])) for i, c in enumerate(row)] for row in counts]
    return [b - a for a, b in zip(*logs, strict=True)]


def _ratio(token: X, ratios: X) -> X:
    """Mean log-likelihood ratio over the token's steps."""

    def score(at: X) -> X:
        total = fn.aggregate(fn.sequence(1, fn.size(at) - 1), X("0D"), lambda s, i: s + fn.get(ratios, fn.get(at, i - 1) * len(ALPHABET) + fn.get(at, i)))
        return total / (fn.size(at) - 1)

    return let(fn.transform(fn.split(token, ""), lambda c: fn.instr(ALPHABET, c) - 1), lambda at: let(fn.filter(at, lambda i: i >= 0), score))


def markov_spans(text: Column, assigned: Column, ratios: list[float], least: float) -> Column:
    """Tokens outside the base spans that look random. Assigned values are blanked first, with the same length."""
    table = X("array(" + ",".join(f"{x:.5f}D" for x in ratios) + ")")

    def build(t: X, spans: X) -> X:
        def find(rest: X) -> X:
            odd = lambda x: ~x.value.rlike(ACCESS) & ~x.value.rlike(HEX) & x.value.rlike("[0-9]") & x.value.rlike("[A-Za-z]") & (_ratio(x.value, table) >= least)
            return _named("markov", fn.filter(_placed(rest, TOKEN), odd))

        def blanked(raw: X) -> X:
            end = lambda i: fn.coalesce(fn.get(spans, i)["end"], X("0"))
            pieces = fn.transform(spans, lambda s, i: fn.concat(_piece(raw, end(i - 1), s.start - end(i - 1)), fn.repeat(" ", s["end"] - s.start)))
            done = end(fn.size(spans) - 1)
            return fn.concat(fn.array_join(pieces, ""), _piece(raw, done, fn.octet_length(raw) / 4 - done))

        return let(when(fn.size(spans) > 0, let(fn.encode(t, "UTF-32"), blanked)).otherwise(t), find)

    return bind(lambda row: build(row.t, row.spans), t=F.coalesce(text, F.lit("")), spans=assigned)


def secret_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", learn_from: DataFrame | None = None, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with ``secrets``: struct of arrays ``assign``, ``access``, ``hex`` and ``markov`` of (kind, start, end) in code points.

    One narrow stage; the models are trained before, on a bounded sample of ``learn_from`` (``docs`` where not given). Null and empty
    texts have empty arrays; every row comes back, with all its columns (a column named ``secrets`` is replaced). An empty table trains
    on random strings alone and gives no rows.
    """
    ratios = train(docs if learn_from is None else learn_from, id_column, text_column)
    base = docs.withColumn("secrets", base_spans(F.col(text_column)))
    found = markov_spans(F.col(text_column), F.col("secrets.assign"), ratios, least_ratio)
    return base.withColumn("secrets", F.col("secrets").withField("markov", found))


def in_order(*kinds: str, column: str = "secrets") -> Column:
    """Spans of some kinds by start, then by kind as listed, then by end."""
    order = {k: i for i, k in enumerate((*KINDS, "markov"))}

    def keyed(kind):
        return F.transform(F.col(column)[kind], lambda s: F.struct(s["start"].alias("start"), F.lit(order[kind]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.array_sort(F.flatten(F.array(*map(keyed, kinds))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """Text with every run of overlapping spans replaced by one mark. Spans come by start."""

    def build(t: X, s: X) -> X:
        reach = running(s, lambda far, x: fn.greatest(far, x["end"].cast("bigint")))

        def cut(far: X, raw: X) -> X:
            before = lambda i: fn.coalesce(fn.get(far, i - 1), X("0L"))
            pieces = fn.transform(s, lambda x, i: when((x.start >= before(i)), fn.concat(_piece(raw, before(i), x.start - before(i)), mark)).otherwise(""))
            done = fn.get(far, fn.size(far) - 1)
            return fn.concat(fn.array_join(pieces, ""), _piece(raw, done, fn.octet_length(raw) / 4 - done))

        return when(fn.size(s) > 0, let(reach, lambda far: let(fn.encode(t, "UTF-32"), lambda raw: cut(far, raw)))).otherwise(t)

    return bind(lambda row: build(row.t, row.spans), t=text, spans=spans)


@query("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(F.col("secrets")[k]).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(in_order(*KINDS)), 256).alias("base_sha256"),
        joined(in_order(*KINDS, "markov")).alias("spans"),
    )
