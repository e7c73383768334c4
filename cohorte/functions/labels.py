"""Date arithmetic and report labels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report texts of the reference (kept verbatim, Spanish).
MSG_NO_LAB = "Sin datos de laboratorio"
MSG_INCONSISTENT = (
    "DATOS INCONSISTENTES: La fecha de diagnóstico es anterior a la primera prueba de laboratorio"
)
MSG_NO_VISITS = "Sin consultas registradas"
MSG_INACTIVE_FMT = "Inactivo por %d días"


def as_of_lit(as_of: date | str | None) -> Column:
    """the reference date of time-relative queries; ``None`` = today."""
    if as_of is None:
        return F.current_date()
    return F.lit(str(as_of)).cast("date")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """whole days ``later - earlier`` (int, may be negative)."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return F.datediff(later, earlier)


def months_back(as_of: date | str | None, months: int) -> Column:
    """``as_of - interval 'n months'`` with month-end clamping."""
    return F.add_months(as_of_lit(as_of), -months)


def consistency_label(first_lab: Column | str, gap_days: Column | str) -> Column:
    """P4."""
    first_lab = F.col(first_lab) if isinstance(first_lab, str) else first_lab
    gap_days = F.col(gap_days) if isinstance(gap_days, str) else gap_days
    return (
        F.when(first_lab.isNull(), F.lit(MSG_NO_LAB))
        .when(gap_days < 0, F.lit(MSG_INCONSISTENT))
        .otherwise(F.lit(None).cast("string"))
    )


def activity_label(last_visit: Column | str, idle_days: Column | str) -> Column:
    """P5."""
    last_visit = F.col(last_visit) if isinstance(last_visit, str) else last_visit
    idle_days = F.col(idle_days) if isinstance(idle_days, str) else idle_days
    return F.when(last_visit.isNull(), F.lit(MSG_NO_VISITS)).otherwise(
        F.format_string(MSG_INACTIVE_FMT, idle_days)
    )
