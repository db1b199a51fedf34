"""Masking rules as DuckDB SQL (checks only)."""

from __future__ import annotations


def _stars(w: str) -> str:
    return f"({w}[1] || repeat('*', length({w}) - 1))"


def mask(entity: str, v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    plain = f"(case when length({v}) <= 2 then repeat('*', length({v})) else {v}[1] || repeat('*', length({v}) - 2) || right({v}, 1) end)"
    compact = f"upper(regexp_replace({v}, '[^A-Za-z0-9]', '', 'g'))"
    parts = f"regexp_split_to_array(trim({v}), '[/.-]')"
    at = f"strpos({v}, '@')"
    words = f"regexp_extract_all({v}, '[\\p{{L}}\\p{{N}}_]+')"
    names = f"list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: w != '')"
    up = f"upper(trim({v}))"
    return f"""case
 when {entity} = 'EMAIL_ADDRESS' and {at} > 0 then (case when {at} > 1 then {v}[1] else '' end) || '***@' || substring({v}, {at} + 1)
 when {entity} = 'PHONE_NUMBER' then repeat('*', greatest(length({d}) - 2, 0)) || right({d}, 2)
 when {entity} = 'IN_AADHAAR' and length({d}) = 12 then 'XXXX XXXX ' || right({d}, 4)
 when {entity} = 'IN_VID' and length({d}) = 16 then 'XXXX XXXX XXXX ' || right({d}, 4)
 when {entity} = 'DATE_OF_BIRTH' then case when len({parts}) = 3 and regexp_full_match({parts}[3], '[0-9]+') then 'XX/XX/' || right({parts}[3], 4) else '[MASKED_DOB]' end
 when {entity} = 'IN_PAN' then case when length({compact}) = 10 then left({compact}, 2) || '****' || right({compact}, 2) else '[MASKED_PAN]' end
 when {entity} = 'IP_ADDRESS' and len(string_split({v}, '.')) = 4 then split_part({v}, '.', 1) || '.' || split_part({v}, '.', 2) || '.***.***'
 when {entity} = 'IN_ADDRESS' then coalesce(array_to_string([case when regexp_full_match(w, '[0-9]+') or length(w) <= 2 then w else {_stars('w')} end for w in {words}], ' '), '')
 when {entity} = 'BANK_ACCOUNT' then case when length({d}) >= 4 then left({d}, 2) || repeat('*', length({d}) - 4) || right({d}, 2) else '[MASKED_ACCOUNT]' end
 when {entity} = 'IFSC_CODE' then case when length({up}) = 11 then left({up}, 4) || '0******' else '[MASKED_IFSC]' end
 when {entity} = 'PASSPORT_NUMBER' then case when length({up}) = 8 then {up}[1] || '******' || right({up}, 1) else '[MASKED_PASSPORT]' end
 when {entity} in ('DEVICE_ID', 'FINGERPRINT_TEMPLATE', 'FACE_TEMPLATE') then case when length({v}) <= 8 then '[MASKED_ID]' else left({v}, 4) || '***' || right({v}, 3) end
 when {entity} = 'BANK_NAME' then '[REDACTED_BANK]'
 when {entity} = 'CREDIT_CARD' then case when length({d}) >= 10 then left({d}, 6) || repeat('*', length({d}) - 10) || right({d}, 4) else '[MASKED_CARD]' end
 when {entity} = 'UPI_ID' and {at} > 0 then {v}[1] || repeat('*', {at} - 2) || substring({v}, {at})
 when {entity} = 'PERSON_NAME' then array_to_string([{_stars('w')} for w in {names}], ' ')
 else {plain} end"""
