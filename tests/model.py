"""Plain-Python statement of the detection rules, used only to check the Spark expressions."""

import re
import unicodedata

from privacyframes.functions import fixed

COMPILED = [
    (label, fixed.LABEL_ENTITY.get(label, label), re.compile(p, re.I if ci else 0))
    for label, p, ci in fixed.PATTERNS
]


def nums(v):
    return [unicodedata.digit(c) for c in v if c.isdigit()]


def luhn(v):
    d = nums(v)[::-1]
    total = sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and total % 10 == 0


def verhoeff(v):
    c = 0
    for i, x in enumerate(nums(v)[::-1]):
        c = fixed.VERHOEFF_D[c][fixed.VERHOEFF_P[i % 8][x]]
    return c == 0


def strict_aadhaar(v):
    d = nums(v)
    return len(d) == 12 and d[0] >= 2 and verhoeff(v)


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def rule(entity, v, strict=False):
    n = len(nums(v))
    if entity == "PERSON_NAME":
        w = v.split()
        return n == 0 and 2 <= len(w) <= 4 and not {x.lower() for x in w} & set(fixed.NAME_STOP_WORDS)
    if entity == "IN_ADDRESS":
        return len(v) >= 8
    if entity == "IP_ADDRESS":
        p = v.split(".")
        return len(p) == 4 and all(x.isdigit() and int(x) < 256 for x in p)
    if entity == "IN_AADHAAR":
        return strict_aadhaar(v) if strict else n == 12
    if entity == "IN_PAN":
        return bool(re.fullmatch("[A-Z]{5}[0-9]{4}[A-Z]", re.sub("[^A-Za-z0-9]", "", v).upper()))
    if entity == "BANK_ACCOUNT":
        return 11 <= n <= 18 and not strict_aadhaar(v) and not luhn(v)
    if entity == "CREDIT_CARD":
        return luhn(v)
    if entity == "DATE_OF_BIRTH":
        return len(re.split("[/.-]", v)) == 3 or any(m in v.lower() for m in MONTHS)
    return True


def accepted(entity, value, strict=False):
    v = value.strip()
    return bool(v) and v.lower() not in fixed.NEVER_PII and rule(entity, v, strict)


def hits(text, strict=False):
    out = []
    for order, (label, entity, rx) in enumerate(COMPILED):
        for m in rx.finditer(text):
            if accepted(entity, m[0], strict):
                out.append((m.start(), m.end(), order, entity, 0.5, m[0]))
    return out


def resolve(found):
    kept = []
    for h in sorted(found, key=lambda x: x[:3]):
        def strength(x):
            return (fixed.ENTITY_RANK.get(x[3], 10), -x[4], x[0] - x[1])

        if not kept or h[0] >= kept[-1][1]:
            kept.append(h)
        elif strength(h) < strength(kept[-1]):
            kept[-1] = h
    return kept


def spans(text, strict=False):
    return [(s, e, ent, v) for s, e, _, ent, _, v in resolve(hits(text, strict))]


def dec(v):
    return "".join(c for c in v if unicodedata.category(c) == "Nd")


def shown(w):
    return w[:1] + "*" * (len(w) - 1)


def mask(entity, v):
    d = dec(v)
    plain = "*" * len(v) if len(v) < 3 else v[0] + "*" * (len(v) - 2) + v[-1]
    if entity == "EMAIL_ADDRESS" and "@" in v:
        a, b = v.split("@", 1)
        return a[:1] + "***@" + b
    if entity == "PHONE_NUMBER":
        return "*" * max(0, len(d) - 2) + d[-2:]
    if entity == "IN_AADHAAR" and len(d) == 12:
        return "XXXX XXXX " + d[-4:]
    if entity == "IN_VID" and len(d) == 16:
        return "XXXX XXXX XXXX " + d[-4:]
    if entity == "DATE_OF_BIRTH":
        p = re.split("[/.-]", v.strip())
        return "XX/XX/" + p[2][-4:] if len(p) == 3 and p[2].isdigit() else "[MASKED_DOB]"
    if entity == "IN_PAN":
        c = re.sub("[^A-Za-z0-9]", "", v).upper()
        return c[:2] + "****" + c[-2:] if len(c) == 10 else "[MASKED_PAN]"
    if entity == "IP_ADDRESS" and v.count(".") == 3:
        return ".".join(v.split(".")[:2]) + ".***.***"
    if entity == "IN_ADDRESS":
        return " ".join(w if w.isdigit() or len(w) < 3 else shown(w) for w in re.findall(r"\w+", v))
    if entity == "BANK_ACCOUNT":
        return d[:2] + "*" * (len(d) - 4) + d[-2:] if len(d) > 3 else "[MASKED_ACCOUNT]"
    if entity == "CREDIT_CARD":
        return d[:6] + "*" * (len(d) - 10) + d[-4:] if len(d) > 9 else "[MASKED_CARD]"
    if entity == "IFSC_CODE":
        u = v.strip().upper()
        return u[:4] + "0******" if len(u) == 11 else "[MASKED_IFSC]"
    if entity == "PASSPORT_NUMBER":
        u = v.strip().upper()
        return u[0] + "******" + u[-1] if len(u) == 8 else "[MASKED_PASSPORT]"
    if entity in ("DEVICE_ID", "FINGERPRINT_TEMPLATE", "FACE_TEMPLATE"):
        return v[:4] + "***" + v[-3:] if len(v) > 8 else "[MASKED_ID]"
    if entity == "BANK_NAME":
        return "[REDACTED_BANK]"
    if entity == "UPI_ID" and "@" in v:
        a, b = v.split("@", 1)
        return shown(a) + "@" + b
    if entity == "PERSON_NAME":
        return " ".join(shown(w) for w in v.split())
    return plain


def sanitize(text, mode, strict=False):
    out, pos, pieces = [], 0, spans(text, strict)
    numbers = {}
    for s, e, ent, v in reversed(pieces):
        numbers.setdefault((ent, text[s:e]), len(numbers) + 1)
    for s, e, ent, v in pieces:
        new = {
            "mask": lambda: mask(ent, text[s:e]),
            "redact": lambda: f"[REDACTED_{ent}]",
            "tokenize": lambda: f"TOKEN_{ent}_{numbers[ent, text[s:e]]:04d}",
        }[mode]()
        out += [text[pos:s], new]
        pos = e
    return "".join(out) + text[pos:]
