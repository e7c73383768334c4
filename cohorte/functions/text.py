"""Text expressions (C1, F1, F2, X19). All JVM-side, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex: (?U) makes \s match every Unicode white space, as Python's
# str.strip() does; btrim/trim only remove the ASCII space.
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip_unicode(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, _EDGE_SPACE, "")


def normalise_text(c: Column | str) -> Column:
    """NULL and ``""`` give NULL; otherwise strip white space and put the
    first character in upper case and the rest in lower case.

    A whitespace-only value becomes ``""`` (the emptiness test happens before
    stripping). Accents are kept. This is Python's ``capitalize`` on each
    value, not ``initcap`` (which works per word)."""
    c = F.col(c) if isinstance(c, str) else c
    t = strip_unicode(c)
    capitalised = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))
    return F.when(c.isNull() | (c == F.lit("")), F.lit(None).cast("string")).otherwise(capitalised)


def contains_any(c: Column | str, patterns: tuple[str, ...]) -> Column:
    """``lower(c) LIKE '%p%'`` for any of ``patterns`` (lower case)."""
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(c)
    cond = None
    for p in patterns:
        term = low.contains(p)
        cond = term if cond is None else (cond | term)
    return cond


# Accent folding pairs for harmonisation.
ACCENTED = "áéíóúüñÁÉÍÓÚÜÑ"
UNACCENTED = "aeiouunAEIOUUN"


def fold_accents(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, ACCENTED, UNACCENTED)


def harmonise_key(c: Column | str) -> Column:
    """Key used to match spelling variants: stripped, accent-folded,
    lower case (``Pulmón``/``pulmon``, ``M``/``m``)."""
    return F.lower(fold_accents(strip_unicode(c)))
