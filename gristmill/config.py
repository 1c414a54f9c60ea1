"""Thresholds and word lists. Nothing here computes."""

from __future__ import annotations

# Words that mean "no value", compared after ``normalise_text``.
MISSING_OTHER_LANGUAGES = (
    "unbekannt|keine angabe|k.a.|kein wert|nicht verfugbar|entfallt|onbekend|geen|niet beschikbaar|"
    "inconnu|inconnue|non renseigne|non disponible|non applicable|sans objet|vide|"
    "desconocido|desconocida|sin datos|sin dato|no disponible|no aplica|ninguno|ninguna|"
    "desconhecido|nao informado|sem dados|nao disponivel|nao se aplica|"
    "sconosciuto|non disponibile|non applicabile|nessuno|ukjent|okand|ukendt|tuntematon|"
    "brak|brak danych|nieznany|neznamy|nezname|неизвестно|нет данных|отсутствует|"
    "不明|なし|無し|該当なし|未知|无|没有|미상|없음"
).split("|")
MISSING_WORDS = ["", *"na|n/a|n.a.|null|none|nil|nan|-|--|?|unknown|missing|not available|not applicable".split("|"), *MISSING_OTHER_LANGUAGES]
SENTINEL_WORDS = [
    *"error|err|unknown|n/a|na|n.a.|null|none|nil|nan|missing|not available|not applicable|not recorded|undefined|invalid|tbd|?|-|--".split("|"),
    *"#n/a|#value!|#ref!|#div/0!|#name?|#null!|#num!".split("|"),
    *"prefer not to say|prefer not to answer|no answer|declined|not specified|unspecified|not stated|no response|withheld".split("|"),
    *MISSING_OTHER_LANGUAGES,
]
TOTAL_WORDS = "total|totals|sum|subtotal|grand total|all|overall|sum:".split("|")
LEGAL_FORMS = "inc|incorporated|llc|llp|ltd|limited|plc|corp|corporation|co|company|gmbh|ag|sa|sas|srl|spa|bv|nv|ab|as|oy|pty|pte|kk|kft|sp z oo|doo|the".split("|")
TRUE_WORDS = "true t yes y 1 on".split()
FALSE_WORDS = "false f no n 0 off".split()
BOOLEAN_WORDS = "0 1 true false yes no y n t f".split()

# Limits of the presentation, not of the data.
ROWS_SHOWN = 5_000
PAGE = 50
PREVIEW = 20

# Type inference.
ID_SHARE = 0.95
TEXT_TOKENS = 5
PARSE_SHARE = 0.90
CONTINUOUS_SHARE = 0.05

# Column checks.
MISSING_LOW, MISSING_MEDIUM = 0.05, 0.30
SPARSE_ROW = 0.50
NEAR_CONSTANT = 0.99
MIXED_SHARE = 0.02
RARE = 5
IQR_FENCES = 3.0
ROBUST_Z = 5.0
MAD_TO_SIGMA = 1.4826
MOSTLY_POSITIVE = 0.99
SCALE_BREAK = 10.0
CORRELATED = 0.98
ASSOCIATION_VALUES = 50
SENTINEL_MOST, SENTINEL_LEAST, SENTINEL_AUTO = 0.40, 3, 0.25
CODE_LENGTH, MERGE_RATIO = 4, 0.25
ENTITY_LEAST, ENTITY_MOST = 20, 2_000
MARKUP_SHARE, MARKUP_LEAST = 0.02, 3
FORMAT_LEAST, FORMAT_SHARE, BOOLEAN_SHARE = 8, 0.95, 0.98
CODE_VALUES, CODE_COUNT, CODE_SHARE, CODE_DISTANCE = 30, 5, 0.25, 12.0

# Relations between columns.
RULE_SUPPORT, RULE_KEYS, RULE_KEYS_MOST, RULE_NUMBERS_MOST, RULE_KEY_SUPPORT, RULE_DECISIVE = 20, 2, 200, 30, 5, 0.5
SUM_SUPPORT, SUM_TOLERANCE, SUM_PROVEN, SUM_COLUMNS, SUM_COLUMNS_BLIND, SUM_PROBES = 30, 1e-6, 12, 40, 10, 3
ORDER_SUPPORT, ORDER_SHARE, ORDER_BROKEN, ORDER_OVERLAP, ORDER_SHOWN = 30, 0.98, 0.05, 0.1, 5

# Dataset and label checks.
FOLDS = 5
CLASS_SHARE, CLASS_ROWS, CLASS_MEMBERS = 0.05, 10, 5
NEAR_GAP, NEAR_GROUP, NEAR_TEXT = 0.05, 50, 0.70
DEDUPE_AUTO = 0.10
TOTAL_ROWS, TOTAL_GAP = 5, 0.005
LEAK_ACCURACY, LEAK_LIFT, LABEL_ROWS = 0.95, 0.05, 50
WRONG_GIVEN, WRONG_TOP, WEAK_MODEL, WRONG_HIGH = 0.10, 0.75, 0.60, 0.05

TYPES = ("constant", "id_like", "boolean", "datetime", "numeric", "text", "categorical")
SEVERITIES = ("high", "medium", "low")
