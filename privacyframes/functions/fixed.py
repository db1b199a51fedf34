"""Labels, weights, word lists and patterns that decide the results.

Patterns are written in Python ``re`` syntax (Unicode mode); ``recognizers.py`` ports them to the
regex dialect the JVM uses.
"""

# --- fixed values: detection patterns, (label, pattern, ignore case), in evaluation order -----------------
PATTERNS = [
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False),
    ("PHONE_NUMBER", r"\b(?:\+91[-\s]?)?[6-9]\d{9}\b", False),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", False),
    ("IN_PAN", r"\b[A-Za-z]{5}[0-9]{4}[A-Za-z]\b", False),
    ("IN_AADHAAR", r"\b[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}\b", False),
    ("IN_VID", r"\bVID\s*[:\-]?\s*[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}\b", True),
    (
        "DATE_OF_BIRTH",
        r"\b(?:DOB|D\.O\.B|Date\s*of\s*Birth)?\s*[:\-]?\s*"
        r"[0-3][0-9][\/\-\.][0-1][0-9][\/\-\.][1-2][0-9]{3}\b",
        True,
    ),
    (
        "DATE_OF_BIRTH_TEXT",
        r"\b(?:DOB|D\.O\.B|Date\s*of\s*Birth)?\s*[:\-]?\s*(?:0?[1-9]|[12][0-9]|3[01])\s+"
        r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
        r"Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+[12][0-9]{3}\b",
        True,
    ),
    ("PERSON_NAME", r"\b[A-Z][a-z]{1,24}(?: [A-Z][a-z]{1,24}){1,2}\b", False),
    (
        "IN_ADDRESS",
        r"\b\d{1,4}\s+[A-Za-z0-9 ,.-]*"
        r"(Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Nagar|Colony|Sector|Block)\b",
        True,
    ),
    (
        "IN_ADDRESS_INDIC",
        r"\b(?:\d{1,4}\s*)?(?:[^\n]{0,60})"
        r"(?:रोड|सड़क|मार्ग|गली|मोहल्ला|नगर|कॉलोनी|सेक्टर|ब्लॉक|"
        r"રોડ|માર્ગ|ગલી|નગર|કોલોની|સેક્ટર|બ્લોક)"
        r"(?:[^\n]{0,60})\b",
        True,
    ),
    ("IN_ADDRESS_LABELLED", r"Address\s*[:\-]?\s*[^\n]{8,}", True),
    ("PIN_CODE", r"\b[0-9]{6}\b", False),
    (
        "UPI_ID",
        r"\b[a-zA-Z0-9._-]{2,}@(upi|okaxis|oksbi|okhdfcbank|okicici|okpnb|paytm|ybl|ibl|axl)\b",
        True,
    ),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){13,19}\b", False),
    ("PASSPORT_NUMBER", r"\b[A-PR-WYa-pr-wy][1-9][0-9]{6}\b", False),
    ("BANK_ACCOUNT", r"\b[0-9]{11,18}\b", False),
    ("IFSC_CODE", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", False),
    ("DEVICE_ID", r"\b(?:android|ios)-[a-zA-Z0-9]{6,}\b", True),
    ("FINGERPRINT_TEMPLATE", r"\bfp_hash_[a-zA-Z0-9]{6,}\b", True),
    ("FACE_TEMPLATE", r"\bface_tmp_[a-zA-Z0-9]{6,}\b", True),
    ("BANK_NAME", r"\b(?:HDFC|ICICI|SBI|AXIS|KOTAK|PNB|BOB|CANARA|IDFC)\s+Bank\b", True),
    (
        "PHONE_NUMBER_LABEL_HI_GU",
        r"\b(?:मोबाइल|फ़ोन|फोन|સંપર્ક|મોબાઇલ|ફોન)\s*[:\-]?\s*(?:\+?91[\s\-]?)?[6-9]\d{9}\b",
        True,
    ),
    ("IN_AADHAAR_LABEL_HI_GU", r"\b(?:आधार|આધાર)\s*[:\-]?\s*\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", True),
    ("IN_PAN_LABEL_HI_GU", r"\b(?:पैन|પાન|PAN)\s*[:\-]?\s*[A-Za-z]{5}[0-9]{4}[A-Za-z]\b", True),
    (
        "DATE_OF_BIRTH_LABEL_HI_GU",
        r"\b(?:जन्म\s*तिथि|જન્મ\s*તારીખ)\s*[:\-]?\s*\d{1,2}[\/\-.]\d{1,2}[\/\-.]\d{4}\b",
        True,
    ),
    ("IN_ADDRESS_LABEL_HI_GU", r"\b(?:पता|સરનામું|સરનામુ)\s*[:\-]?\s*[^\n]{8,}", True),
    ("IN_ADDRESS_PIN_LABEL", r"\b(?:PIN|Pincode|पिन|पिनकोड|પિન|પિનકોડ)\s*[:\-]?\s*\d{6}\b", True),
]

# --- fixed values: scored patterns, (label, pattern, ignore case, score) ----------------------------------
SCORED_PATTERNS = [
    ("IN_PAN", r"\b[A-Za-z]{5}[0-9]{4}[A-Za-z]\b", True, 0.8),
    ("IN_AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b", True, 0.85),
    (
        "IN_ADDRESS",
        r"\b\d{1,4}\s+[A-Za-z0-9\s,.-]*(Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Nagar|Colony|Sector)\b",
        True,
        0.55,
    ),
]

# --- fixed values: label -> entity -------------------------------------------------------------------------
LABEL_ENTITY = {
    "IN_ADDRESS_LABELLED": "IN_ADDRESS",
    "IN_ADDRESS_INDIC": "IN_ADDRESS",
    "PIN_CODE": "IN_ADDRESS",
    "DATE_OF_BIRTH_TEXT": "DATE_OF_BIRTH",
    "PHONE_NUMBER_LABEL_HI_GU": "PHONE_NUMBER",
    "IN_AADHAAR_LABEL_HI_GU": "IN_AADHAAR",
    "IN_PAN_LABEL_HI_GU": "IN_PAN",
    "DATE_OF_BIRTH_LABEL_HI_GU": "DATE_OF_BIRTH",
    "IN_ADDRESS_LABEL_HI_GU": "IN_ADDRESS",
    "IN_ADDRESS_PIN_LABEL": "IN_ADDRESS",
}

# --- fixed values: external recogniser label -> entity -----------------------------------------------------
EXTERNAL_LABEL_ENTITY = {
    "PERSON": "PERSON_NAME",
    "LOCATION": "IN_ADDRESS",
    "EMAIL_ADDRESS": "EMAIL_ADDRESS",
    "PHONE_NUMBER": "PHONE_NUMBER",
    "IP_ADDRESS": "IP_ADDRESS",
    "IN_PAN": "IN_PAN",
    "IN_AADHAAR": "IN_AADHAAR",
    "CREDIT_CARD": "CREDIT_CARD",
    "DATE_TIME": "DATE_OF_BIRTH",
    "IN_ADDRESS": "IN_ADDRESS",
}

# --- fixed values: scores ----------------------------------------------------------------------------------
PATTERN_SCORE = 0.5
EXTERNAL_MIN_SCORE = 0.7
LATE_SCORE = 0.6

# --- fixed values: overlap rank (lower wins) and its default -----------------------------------------------
ENTITY_RANK = {
    "IN_AADHAAR": 1,
    "CREDIT_CARD": 1,
    "BANK_ACCOUNT": 1,
    "IFSC_CODE": 1,
    "IN_PAN": 1,
    "PASSPORT_NUMBER": 1,
    "EMAIL_ADDRESS": 2,
    "PHONE_NUMBER": 2,
    "UPI_ID": 2,
    "IP_ADDRESS": 2,
    "DATE_OF_BIRTH": 2,
    "DEVICE_ID": 2,
    "FINGERPRINT_TEMPLATE": 2,
    "FACE_TEMPLATE": 2,
    "IN_ADDRESS": 3,
    "BANK_NAME": 3,
    "PERSON_NAME": 5,
}
DEFAULT_RANK = 10

# --- fixed values: words -----------------------------------------------------------------------------------
NEVER_PII = [
    "john", "doe", "smith", "apple", "google", "microsoft", "amazon", "facebook",
    "india", "delhi", "mumbai", "ahmedabad", "gujarat", "rajasthan", "maharashtra",
]
NAME_STOP_WORDS = [
    "face", "template", "device", "id", "bank", "account", "passport",
    "aadhaar", "pan", "ifsc", "fingerprint", "mobile", "email", "address", "dob", "ip",
    "मोबाइल", "फोन", "आधार", "पता", "જન્મ", "સરનામું", "મોબાઇલ", "ફોન", "આધાર",
]

# --- fixed values: Verhoeff multiplication and permutation tables ------------------------------------------
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]

# --- fixed values: risk weights, default weight, curve and level floors ------------------------------------
RISK_WEIGHT = {
    "IN_AADHAAR": 10.0,
    "CREDIT_CARD": 10.0,
    "BANK_ACCOUNT": 9.0,
    "PASSPORT_NUMBER": 8.0,
    "IN_PAN": 8.0,
    "FINGERPRINT_TEMPLATE": 8.0,
    "FACE_TEMPLATE": 8.0,
    "IFSC_CODE": 6.0,
    "DATE_OF_BIRTH": 6.0,
    "EMAIL_ADDRESS": 5.0,
    "PHONE_NUMBER": 5.0,
    "IN_ADDRESS": 5.0,
    "UPI_ID": 5.0,
    "DEVICE_ID": 4.0,
    "IP_ADDRESS": 3.0,
    "PERSON_NAME": 2.0,
    "BANK_NAME": 2.0,
}
DEFAULT_WEIGHT = 2.0
RISK_SCALE = 20.0
RISK_LEVELS = [(80, "critical"), (60, "high"), (30, "medium"), (0, "low")]

# --- fixed values: whole-value checks (re syntax) ------------------------------------------------------------
MONTH_DATE = (
    r"(?:0?[1-9]|[12][0-9]|3[01])\s+"
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
    r"Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+[12][0-9]{3}"
)
PAN_VALUE = "^[A-Za-z]{5}[0-9]{4}[A-Za-z]$"
IFSC_VALUE = "^[A-Z]{4}0[A-Z0-9]{6}$"
PASSPORT_VALUE = "^[A-PR-WY][1-9][0-9]{6}$"

# --- fixed values: admission -------------------------------------------------------------------------------
SUPPORTED_EXTENSIONS = [
    ".sql", ".csv", ".json", ".pdf", ".docx", ".txt", ".png", ".jpg", ".jpeg",
    ".xlsx", ".xlsm", ".xltx", ".xltm", ".xls",
]
STRUCTURED_MIME_TYPES = ["application/json", "application/xml", "application/x-yaml", "application/yaml"]
REDACT_ONLY_EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg"]
EXECUTABLE_MAGIC = [b"MZ", b"\x7fELF", b"\xcf\xfa\xed\xfe", b"\xfe\xed\xfa\xcf"]
EICAR_MARKER = r"X5O!P%@AP[4\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*"
MAX_FILE_BYTES = 25 * 1024 * 1024
TEXT_SNIFF_BYTES = 4096
RETENTION_DAYS = 30
CACHE_VERSION = "v2"
ENVELOPE_PREFIX = "ENC2"
ENVELOPE_VERSION = "env_aesgcm_envelope_v1"

# --- fixed values: request limits --------------------------------------------------------------------------
RATE_WINDOW_SECONDS = 60
RATE_MAX_HITS = 120
MAX_LOGIN_ATTEMPTS = 5
LOGIN_LOCK_MINUTES = 15

MODES = ["mask", "redact", "tokenize"]
