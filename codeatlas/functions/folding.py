"""Case folding: each character to its upper case one, length kept.

Only one-to-one pairs fold, so offsets stay valid, ``_`` sorts after ``Z`` as it does
in upper case, and any engine with ``translate`` gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin, Greek and Cyrillic letters whose upper case is one other letter that folds back.
FOLD_FROM = "".join(c for c in map(chr, range(0x61, 0x530)) if len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c)
FOLD_TO = FOLD_FROM.upper()
_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)


def fold(c: Column | str) -> Column:
    return F.translate(F.col(c) if isinstance(c, str) else c, FOLD_FROM, FOLD_TO)


def fold_text(s: str) -> str:
    return s.translate(_TABLE)


def fold_sql(expression: str) -> str:
    return f"translate({expression}, '{FOLD_FROM}', '{FOLD_TO}')"
