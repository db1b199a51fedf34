"""Detection rules once more, as DuckDB SQL. Used only to check the Spark results.

RE2 knows neither look-around nor Unicode word boundaries. Patterns are therefore matched on a shadow of
the text in which every non-ASCII letter or number is an underscore (same length, same word boundaries),
and values are cut from the original by offset.
"""

from __future__ import annotations

from ..functions import fixed

_KEYWORDS = "".join(p for label, p, _ in fixed.PATTERNS)
_INDIC = sorted({c for c in _KEYWORDS if "ऀ" <= c <= "૿" and c.isalpha()})
_LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(_INDIC)]
_TO_LATIN = str.maketrans("".join(_INDIC), _LATIN)

def shadow(text: str) -> str:
    """ASCII word shape of a text."""
    return (
        rf"regexp_replace(regexp_replace({text}, '[^\x00-\x7F\P{{L}}]', '_', 'g'), '[^\x00-\x7F\P{{N}}]', '_', 'g')"
    )


def indic_shadow(text: str) -> str:
    """Letters of the Hindi and Gujarati keywords as distinct Latin letters; ASCII letters as '_'."""
    plain = f"regexp_replace({text}, '[a-zA-Z]', '_', 'g')"
    return shadow(f"translate({plain}, '{''.join(_INDIC)}', '{_LATIN}')")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ORIGINAL = {"EMAIL_ADDRESS", "UPI_ID"}
_INDIC_LABELS = {
    "IN_ADDRESS_INDIC", "PHONE_NUMBER_LABEL_HI_GU", "IN_AADHAAR_LABEL_HI_GU",
    "DATE_OF_BIRTH_LABEL_HI_GU", "IN_ADDRESS_LABEL_HI_GU",
}
# These mix an Indic label with a Latin one or with Latin values, so they get both texts.
_MIXED_LABELS = {"IN_PAN_LABEL_HI_GU", "IN_ADDRESS_PIN_LABEL"}


def _variants(label: str, pattern: str, ignore_case: bool):
    """(text column, RE2 pattern) pairs whose matches together are the matches of one recogniser."""
    ci = "(?i)" if ignore_case else ""
    if label in _INDIC_LABELS:
        return [("indic", pattern.translate(_TO_LATIN))]
    if label == "IN_PAN_LABEL_HI_GU":
        return [
            ("pan_shadow", r"\b(?:<hi>|<gu>)\s*[:\-]?\s*[A-Za-z]{5}[0-9]{4}[A-Za-z]\b"),
            ("shadow", r"(?i)\bPAN\s*[:\-]?\s*[A-Za-z]{5}[0-9]{4}[A-Za-z]\b"),
        ]
    if label == "IN_ADDRESS_PIN_LABEL":
        words = "|".join(w for w in ("पिन", "पिनकोड", "પિન", "પિનકોડ")).translate(_TO_LATIN)
        return [
            ("shadow", r"(?i)\b(?:PIN|Pincode)\s*[:\-]?\s*\d{6}\b"),
            ("indic", rf"\b(?:{words})\s*[:\-]?\s*\d{{6}}\b"),
        ]
    return [("text" if label in _ORIGINAL else "shadow", ci + pattern)]


_MONTH_RE = "(?i)" + fixed.MONTH_DATE


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn(d: str) -> str:
    """Digit string ``d`` passes length, variety and checksum."""
    total = (
        f"list_sum([case when (length({d}) - i) % 2 = 1 then (2 * cast({d}[i] as int)) // 10 + (2 * cast({d}[i] as int)) % 10 "
        f"else cast({d}[i] as int) end for i in range(1, length({d}) + 1)])"
    )
    return (
        f"(length({d}) between 13 and 19 and length(replace({d}, {d}[1], '')) > 0 and ({total}) % 10 = 0)"
    )


def verhoeff(d: str) -> str:
    mul = [x for row in fixed.VERHOEFF_D for x in row]
    perm = [x for row in fixed.VERHOEFF_P for x in row]
    steps = f"[({perm})[((i - 1) % 8) * 10 + cast(reverse({d})[i] as int) + 1] for i in range(1, length({d}) + 1)]"
    return f"(list_reduce(list_concat([0], {steps}), lambda c, p: ({mul})[c * 10 + p + 1]) = 0)"


def strict_aadhaar(d: str) -> str:
    return f"(case when regexp_full_match({d}, '[2-9][0-9]{{11}}') then {verhoeff(d)} else false end)"


def valid(entity: str, v: str, strict: bool = False) -> str:
    """Predicate on a trimmed value."""
    words = f"list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: w != '')"
    stop = "[" + ", ".join(_q(w) for w in dict.fromkeys(fixed.NAME_STOP_WORDS)) + "]"
    never = ", ".join(_q(w) for w in fixed.NEVER_PII)
    d = digits(v)
    rules = {
        "PERSON_NAME": f"not regexp_matches({v}, '[0-9]') and len({words}) between 2 and 4 "
        f"and not list_has_any([lower(w) for w in {words}], {stop})",
        "IN_ADDRESS": f"length({v}) >= 8",
        "IP_ADDRESS": f"len(string_split({v}, '.')) = 4 and list_max([cast(p as int) for p in string_split({v}, '.')]) <= 255",
        "IN_AADHAAR": strict_aadhaar(d) if strict else f"length({d}) = 12",
        "IN_PAN": f"regexp_full_match(upper(regexp_replace({v}, '[^A-Za-z0-9]', '', 'g')), '[A-Z]{{5}}[0-9]{{4}}[A-Z]')",
        "BANK_ACCOUNT": f"length({d}) between 11 and 18 and not {strict_aadhaar(d)} "
        f"and not (length({d}) >= 13 and {luhn(d)})",
        "IFSC_CODE": f"regexp_full_match(upper({v}), '[A-Z]{{4}}0[A-Z0-9]{{6}}')",
        "PASSPORT_NUMBER": f"regexp_full_match(upper({v}), '[A-PR-WY][1-9][0-9]{{6}}')",
        "CREDIT_CARD": luhn(d),
        "DATE_OF_BIRTH": f"(len(regexp_split_to_array({v}, '[/.-]')) = 3 or regexp_matches({v}, '{_MONTH_RE}'))",
    }
    return f"(length({v}) > 0 and lower({v}) not in ({never}) and {rules.get(entity, 'true')})"


def trimmed(v: str) -> str:
    return rf"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def rank_case(entity: str) -> str:
    whens = " ".join(f"when {_q(k)} then {v}" for k, v in fixed.ENTITY_RANK.items())
    return f"(case {entity} {whens} else {fixed.DEFAULT_RANK} end)"


def _pattern_select(order: int, entity: str, column: str, pattern: str, score: float, source: str, strict: bool) -> str:
    if column == "pan_shadow":
        # Indic label in front of a Latin value: mark the label, keep the Latin letters.
        from_hi, from_gu = "पैन", "પાન"
        body = rf"(?:{from_hi}|{from_gu})\s*[:\-]?\s*[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z]\b"
        column, pattern = "text", body
    # Rows without a single Hindi or Gujarati letter cannot match a pattern that needs a keyword in one.
    needs = f" where regexp_matches(text, '[{''.join(_INDIC)}]')" if column == "indic" else ""
    marked = f"regexp_replace({column}, {_q('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'g')"
    return f"""
  select src, doc_id, {order} as ord, {_q(entity)} as entity_type, cast({score} as double) as score, {_q(source)} as source, s as "start", s + n as "end",
         substring(text, s + 1, n) as value
  from (
    select src, doc_id, text,
           cast(coalesce(list_sum([length(replace(q, chr(2), '')) for q in p[1:i]]), 0) as int) as s,
           cast(length(split_part(p[i + 1], chr(2), 1)) as int) as n
    from (select src, doc_id, text, p, unnest(range(1, len(p))) as i
          from (select src, doc_id, text, string_split({marked}, chr(1)) as p from shaped{needs}) where len(p) > 1)
  ) where {valid(entity, trimmed('substring(text, s + 1, n)'), strict)}"""


def candidates_cte(texts: str, names=None, strict: bool = False, scored: bool = False) -> str:
    """CTEs ``shaped`` and ``hits`` over a (src, doc_id, text) select; all valid hits before resolution."""
    selects = []
    if scored:
        for i, (label, pattern, _, score) in enumerate(fixed.SCORED_PATTERNS):
            if score >= fixed.EXTERNAL_MIN_SCORE:
                selects.append(_pattern_select(i - 10, label, "shadow", "(?i)" + pattern, score, "presidio", strict))
    for order, (label, pattern, ci) in enumerate(fixed.PATTERNS):
        if names is not None and label not in names:
            continue
        for column, rx in _variants(label, pattern, ci):
            entity = fixed.LABEL_ENTITY.get(label, label)
            selects.append(_pattern_select(order, entity, column, rx, fixed.PATTERN_SCORE, "regex", strict))
    return (
        f"shaped as materialized (select src, doc_id, text, {shadow('text')} as shadow, {indic_shadow('text')} as indic from ({texts})),\n"
        f"hits as materialized ({' union all '.join(selects)})"
    )


def resolve_cte(source: str = "hits", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}kept``: greedy resolution of ``source`` as a walk over ranked hits."""
    p = prefix
    better = (
        "(n.prio < w.prio or (n.prio = w.prio and n.score > w.score) or (n.prio = w.prio and n.score = w.score "
        "and n.\"end\" - n.\"start\" > w.\"end\" - w.\"start\"))"
    )
    pick = ", ".join(
        f'case when n."start" >= w."end" or {better} then n.{c} else w.{c} end as {c}'
        for c in ('ord', 'entity_type', 'score', 'source', '"start"', '"end"', 'value', 'prio')
    )
    return f"""{p}firsts as (select * from {source} qualify row_number() over (partition by src, doc_id, "start", "end", entity_type order by ord) = 1),
{p}ranked as materialized (select *, {rank_case('entity_type')} as prio,
   row_number() over (partition by src, doc_id order by "start", "end", ord) as rn,
   count(*) over (partition by src, doc_id) as total from {p}firsts),
{p}walk as (
  select src, doc_id, rn, total, ord, entity_type, score, source, "start", "end", value, prio, rn as run from {p}ranked where rn = 1
  union all
  select w.src, w.doc_id, n.rn, n.total, {pick}, case when n."start" >= w."end" then n.rn else w.run end as run
  from {p}walk w join {p}ranked n on n.src = w.src and n.doc_id = w.doc_id and n.rn = w.rn + 1),
{p}kept as (select * from {p}walk qualify row_number() over (partition by src, doc_id, run order by rn desc) = 1)"""


def findings_sql(texts: str, select: str, names=None, strict=False, scored=False, extra: str = "") -> str:
    """Full statement: detection over ``texts``, then ``select`` from ``kept`` (optional extra CTEs)."""
    more = f",\n{extra}" if extra else ""
    return (
        f"with recursive {candidates_cte(texts, names, strict, scored)},\n{resolve_cte()}{more}\n{select}"
    )
