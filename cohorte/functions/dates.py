"""The date format of each column of a sheet, inferred from the whole column.

One aggregate counts, per column and candidate format, the cells that the format
reads. Day and month can change places without a cell showing it (``03/04/2020``), so
a cell alone can't decide; the column can, by its cells beyond the 12th.

Per column the verdict is one of

``unico``       one format reads every cell (others don't)
``ambiguo``     day-first and month-first both read every cell; the preferred order is
                taken and the report says so
``varios``      several formats are needed, and no cell can be read in two ways
``mezclado``    day-first and month-first cells stand in one column: cells that can be
                read one way are, the others are not decided but quarantined
``ilegible``    some cells fit no candidate (and go to quarantine); the others are
                read as the rest of the verdict says
``vacio``       no cell
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.functions.parse import _s, format_shape, lit_sql

#: Candidates that read the year first, or a month by name: no other format reads their cells.
PLAIN_FORMATS: tuple[str, ...] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "dd-MMM-yyyy")
#: Pairs that differ in the order of day and month only.
PAIRED_FORMATS: tuple[tuple[str, str], ...] = (
    ("dd/MM/yyyy", "MM/dd/yyyy"),
    ("dd-MM-yyyy", "MM-dd-yyyy"),
    ("dd.MM.yyyy", "MM.dd.yyyy"),
    ("dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss"),
)
REPORT = "campo string, estado string, formatos array<string>, celdas long, legibles long, indecisas long"


@dataclass(frozen=True)
class ColumnFormats:
    """Formats of a column, in the order of trial; ``undecided`` pairs read a cell only if one order does."""

    state: str
    formats: tuple[str, ...]
    undecided: tuple[tuple[str, str], ...] = ()
    cells: int = 0
    readable: int = 0
    open_cells: int = 0


def _shape(fmt: str) -> str:
    shape = format_shape(fmt)
    return shape.replace(r"\d{1,3}", r"\p{L}{3}\.?") if "MMM" in fmt else r"^\d{8}$" if fmt == "yyyyMMdd" else shape


def read_sql(column: str, fmt: str) -> str:
    """The date that ``fmt`` reads in a cell, or null."""
    s = f"trim({_s(column)})"
    return f"CASE WHEN {s} RLIKE {lit_sql(_shape(fmt))} THEN to_date(try_to_timestamp({s}, {lit_sql(fmt)})) END"


def date_sql(column: str, found: ColumnFormats) -> str:
    """I1 with the formats of a column."""
    tries = [read_sql(column, f) for f in found.formats]
    for a, b in found.undecided:
        x, y = read_sql(column, a), read_sql(column, b)
        tries.append(f"CASE WHEN ({x}) IS NULL OR ({y}) IS NULL OR ({x}) = ({y}) THEN coalesce({x}, {y}) END")
    return "coalesce(" + ", ".join(tries) + ")" if tries else "CAST(NULL AS DATE)"


def _present(column: str) -> str:
    s = _s(column)
    return f"({s} IS NOT NULL AND lower(trim({s})) NOT IN ('', 'nan'))"


def infer_formats(raw: DataFrame, columns: list[str], month_first: bool = False) -> dict[str, ColumnFormats]:
    """Formats of ``columns`` from one pass over a sheet (a few numbers per column to the driver).

    ``month_first`` is the order taken where a column shows neither."""
    columns = [c for c in columns if c in raw.columns]
    if not columns:
        return {}
    exprs = []
    for i, c in enumerate(columns):
        exprs.append(f"count_if({_present(c)}) AS n_{i}")
        exprs += [f"count_if({_present(c)} AND ({read_sql(c, f)}) IS NOT NULL) AS p_{i}_{j}" for j, f in enumerate(PLAIN_FORMATS)]
        for j, (a, b) in enumerate(PAIRED_FORMATS):
            x, y = f"({read_sql(c, a)})", f"({read_sql(c, b)})"
            exprs += [
                f"count_if({x} IS NOT NULL AND {y} IS NULL) AS d_{i}_{j}",
                f"count_if({x} IS NULL AND {y} IS NOT NULL) AS m_{i}_{j}",
                f"count_if({x} IS NOT NULL AND {y} IS NOT NULL AND {x} <> {y}) AS u_{i}_{j}",
                f"count_if({x} = {y}) AS e_{i}_{j}",
            ]
    r = raw.selectExpr(*exprs).first()
    return {c: _verdict(r, i, month_first) for i, c in enumerate(columns)}


def _verdict(r, i: int, month_first: bool) -> ColumnFormats:
    n = r[f"n_{i}"]
    if not n:
        return ColumnFormats("vacio", (PLAIN_FORMATS[0],))
    plain = [(f, r[f"p_{i}_{j}"]) for j, f in enumerate(PLAIN_FORMATS) if r[f"p_{i}_{j}"]]
    formats, undecided = [f for f, _ in plain], []
    readable, open_cells, ambiguous = sum(k for _, k in plain), 0, False
    # cells of all pairs tell the order of the column's writer
    day = sum(r[f"d_{i}_{j}"] for j in range(len(PAIRED_FORMATS)))
    month = sum(r[f"m_{i}_{j}"] for j in range(len(PAIRED_FORMATS)))
    for j, (a, b) in enumerate(PAIRED_FORMATS):
        d, m, u, e = (r[f"{k}_{i}_{j}"] for k in "dmue")
        if not d + m + u + e:
            continue
        if day and month:
            undecided.append((a, b))
            readable += d + m + e
            open_cells += u
        else:
            formats.append(b if month or (month_first and not day) else a)
            ambiguous |= u > 0 and not day and not month
            readable += d + m + u + e
    if readable + open_cells < n:
        state = "ilegible"
    elif undecided:
        state = "mezclado"
    elif ambiguous:
        state = "ambiguo"
    else:
        state = "unico" if len(formats) == 1 else "varios"
    return ColumnFormats(state, tuple(formats), tuple(undecided), n, readable, open_cells)


def report(spark, found: dict[str, ColumnFormats]) -> DataFrame:
    """One row per column: verdict, formats (undecided pairs as ``a|b``), cells, cells read, cells left undecided."""
    rows = [(c, f.state, [*f.formats, *("|".join(p) for p in f.undecided)], f.cells, f.readable, f.open_cells) for c, f in sorted(found.items())]
    return spark.createDataFrame(rows, REPORT)


def parsed_dates(raw: DataFrame, found: dict[str, ColumnFormats]) -> DataFrame:
    """``raw`` with the columns of ``found`` as dates."""
    return raw.withColumns({c: F.expr(date_sql(c, f)) for c, f in found.items()})
