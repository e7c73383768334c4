"""Parsing of raw text cells (I1-I5). Every parser returns NULL on failure
instead of raising, so a bad cell sends its row to quarantine (I6) rather
than failing the job.

Each parser exists as SQL expression text (``*_sql``) and as a Column
(``F.expr`` of that text): a whole sheet is then parsed by one
``selectExpr`` call instead of one driver round trip per expression node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats tried in order (I1). Format inference is not reproducible at
# scale, so the list is a parameter.
DEFAULT_DATE_FORMATS: tuple[str, ...] = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "dd/MM/yyyy",
    "yyyy/MM/dd",
)

# Text accepted as true by the boolean parser (I2), compared
# after lower-casing and without trimming.
TRUE_WORDS: tuple[str, ...] = ("true", "1", "yes", "si", "sí")


def q(name: str) -> str:
    """Quote a column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def lit_sql(text: str) -> str:
    """A SQL string literal (double-quoted, so single quotes need no escape)."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _s(c: str) -> str:
    return f"CAST({q(c)} AS STRING)"


def format_shape(fmt: str) -> str:
    """A regular expression for the text shape of a datetime pattern
    (``dd/MM/yyyy`` -> ``^\\d{1,2}/\\d{1,2}/\\d{4}$``)."""
    import re

    out, i = [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1 : j]))
            i = j + 1
            continue
        j = i
        while j < len(fmt) and fmt[j] == ch:
            j += 1
        run = j - i
        if ch.isalpha():
            out.append(r"\d{4}" if ch in "yu" and run >= 4 else r"\d{1,%d}" % max(run, 2))
        else:
            out.append(re.escape(fmt[i:j]))
        i = j
    return "^" + "".join(out) + "$"


def parse_date_sql(c: str, formats: tuple[str, ...] = DEFAULT_DATE_FORMATS) -> str:
    """First format that parses wins; NULL when none does.

    Each format is tried only when the text has its shape: a failed parse
    costs an exception inside the JVM, a regular-expression test does not."""
    s = f"trim({_s(c)})"
    tries = [
        f"CASE WHEN {s} RLIKE {lit_sql(format_shape(f))} THEN to_date(try_to_timestamp({s}, {lit_sql(f)})) END"
        for f in formats
    ]
    return "coalesce(" + ", ".join(tries) + ")"


# numbers as the text cast accepts them, plus NaN/Infinity spellings
_NUMBER_SHAPE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))[dDfF]?\s*$"


def _try_double(c: str) -> str:
    """``try_cast`` guarded by a shape test (no exception per junk value)."""
    return f"CASE WHEN {_s(c)} RLIKE {lit_sql(_NUMBER_SHAPE)} THEN try_cast({_s(c)} AS DOUBLE) END"


def parse_bool_sql(c: str, numeric: bool = False) -> str:
    """NULL -> false. A text cell is true if it is one of TRUE_WORDS, as it
    stands but for case; a cell of a ``numeric`` column if it is neither 0 nor NaN."""
    if numeric:
        d = f"CAST({q(c)} AS DOUBLE)"
        return f"coalesce(NOT isnan({d}) AND {d} <> 0, false)"
    words = ", ".join(lit_sql(w) for w in TRUE_WORDS)
    return f"coalesce(lower({_s(c)}) IN ({words}), false)"


def parse_double_sql(c: str) -> str:
    """I4: optional double; NaN and junk -> NULL."""
    d = _try_double(c)
    return f"CASE WHEN isnan({d}) THEN CAST(NULL AS DOUBLE) ELSE {d} END"


def parse_int_sql(c: str, type_name: str = "INT") -> str:
    """``int(x)`` truncates a float; junk, NaN or overflow -> NULL."""
    return f"try_cast({parse_double_sql(c)} AS {type_name})"


def optional_text_sql(c: str) -> str:
    """I4: optional text; NULL and the text form of NaN stay NULL."""
    return f"CASE WHEN {_s(c)} IS NULL OR lower({_s(c)}) = 'nan' THEN CAST(NULL AS STRING) ELSE {_s(c)} END"


def required_text_sql(c: str, compat: bool = False) -> str:
    """Required text. NULL stays NULL (the NOT NULL check quarantines the
    row). ``compat=True`` reproduces the reference's ``str(NaN)`` = ``"nan"``."""
    return f"coalesce({_s(c)}, 'nan')" if compat else _s(c)


def _name(c: Column | str) -> str:
    if not isinstance(c, str):
        raise TypeError("parsers take a column name")
    return c


def parse_date(c: str, formats: tuple[str, ...] = DEFAULT_DATE_FORMATS) -> Column:
    return F.expr(parse_date_sql(_name(c), formats))


def parse_bool(c: str, numeric: bool = False) -> Column:
    return F.expr(parse_bool_sql(_name(c), numeric))


def parse_int(c: str) -> Column:
    return F.expr(parse_int_sql(_name(c)))


def parse_double(c: str) -> Column:
    return F.expr(parse_double_sql(_name(c)))


def optional_text(c: str) -> Column:
    return F.expr(optional_text_sql(_name(c)))


def required_text(c: str, compat: bool = False) -> Column:
    return F.expr(required_text_sql(_name(c), compat))
