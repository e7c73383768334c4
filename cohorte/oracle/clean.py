"""Oracle SQL for the cleaning queries (C1-C13, Q5), written directly in
DuckDB SQL from the rules (not from the Spark code): normalise, null rates,
fill values with data-dependent strategy, quartile bounds, clipping."""

from __future__ import annotations

from cohorte.oracle import SQL, with_fixtures
from cohorte.schemas import TABLES

DEFAULTS = {"zona_residencia": "'Desconocida'", "resultado": "'Sin resultado'", "unidad": "'N/a'", "resultado_numerico": "0.0"}
ORDER = ("paciente", "consulta", "laboratorio")


def norm(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL ELSE upper(substr({t}, 1, 1)) || lower(substr({t}, 2)) END"


def _kinds(table: str):
    spec = TABLES[table]
    keys = {spec.key} | ({spec.parent_key} if spec.parent_key else set())
    text, num, other = [], [], []
    for f in spec.schema.fields:
        tn = f.dataType.typeName()
        if f.name in keys or f.name in spec.date_columns:
            other.append(f.name)
        elif tn == "string":
            text.append(f.name)
        elif tn in ("integer", "long", "double"):
            num.append(f.name)
        else:
            other.append(f.name)
    return spec, keys, text, num, other


def normalised_cte(table: str) -> str:
    spec, keys, text, num, other = _kinds(table)
    cols = [f"{norm(f.name)} AS {f.name}" if f.name in text else f.name for f in spec.schema.fields]
    return f"n_{table} AS (SELECT {', '.join(cols)} FROM {table})"


def fills_cte(table: str) -> str:
    """Fill value and strategy per column with nulls (data-dependent)."""
    spec, keys, text, num, other = _kinds(table)
    parts = []
    src = f"n_{table}"
    for c in text + num:
        stats = f"(SELECT COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*) AS pct FROM {src})"
        if c in DEFAULTS:
            vt = DEFAULTS[c] if c in text else "NULL"
            vn = f"CAST({DEFAULTS[c]} AS DOUBLE)" if c in num else "NULL"
            parts.append(f"SELECT '{table}' AS tabla, '{c}' AS campo, CAST({vt} AS VARCHAR) AS valor_texto, {vn} AS valor_numerico, 'defecto' AS estrategia FROM {stats} s WHERE s.pct > 0")
        elif c in text:
            mode = f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
            parts.append(f"SELECT '{table}' AS tabla, '{c}' AS campo, {mode} AS valor_texto, CAST(NULL AS DOUBLE) AS valor_numerico, 'moda' AS estrategia FROM {stats} s WHERE s.pct > 0 AND s.pct < 20")
        else:
            med = f"(SELECT ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 9) FROM {src})"
            parts.append(
                f"SELECT '{table}' AS tabla, '{c}' AS campo, CAST(NULL AS VARCHAR) AS valor_texto, CASE WHEN s.pct < 20 THEN {med} ELSE 0.0 END AS valor_numerico, "
                f"CASE WHEN s.pct < 20 THEN 'mediana' ELSE 'cero' END AS estrategia FROM {stats} s WHERE s.pct > 0"
            )
    return f"f_{table} AS ({' UNION ALL '.join(parts)})"


def imputed_cte(table: str) -> str:
    spec, keys, text, num, other = _kinds(table)
    cols = []
    for f in spec.schema.fields:
        c = f.name
        sub = lambda v: f"(SELECT {v} FROM f_{table} WHERE campo = '{c}')"
        if c in text:
            cols.append(f"COALESCE({c}, {sub('valor_texto')}) AS {c}")
        elif c in num and f.dataType.typeName() == "double":
            cols.append(f"COALESCE({c}, {sub('valor_numerico')}) AS {c}")
        elif c in num:
            cols.append(f"COALESCE({c}, CAST(round_even({sub('valor_numerico')}, 0) AS INTEGER)) AS {c}")
        else:
            cols.append(c)
    return f"i_{table} AS (SELECT {', '.join(cols)} FROM n_{table})"


def bounds_cte(table: str) -> str:
    spec, keys, text, num, other = _kinds(table)
    parts = []
    for c in num:
        q = (
            f"SELECT ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 9) AS q1, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 9) AS q3 "
            f"FROM i_{table} WHERE {c} IS NOT NULL HAVING COUNT(*) > 0"
        )
        parts.append(
            f"SELECT '{table}' AS tabla, '{c}' AS campo, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS limite_inferior, "
            f"q3 + 1.5 * (q3 - q1) AS limite_superior FROM ({q})"
        )
    if not parts:
        parts.append(f"SELECT '{table}' AS tabla, '' AS campo, 0.0 AS q1, 0.0 AS q3, 0.0 AS iqr, 0.0 AS limite_inferior, 0.0 AS limite_superior WHERE FALSE")
    return f"b_{table} AS ({' UNION ALL '.join(parts)})"


def cleaned_cte(table: str) -> str:
    spec, keys, text, num, other = _kinds(table)
    cols = []
    for f in spec.schema.fields:
        c = f.name
        if c in num:
            lo = f"(SELECT limite_inferior FROM b_{table} WHERE campo = '{c}')"
            hi = f"(SELECT limite_superior FROM b_{table} WHERE campo = '{c}')"
            e = f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE CAST({c} AS DOUBLE) END"
            if f.dataType.typeName() == "integer":
                e = f"CAST(round_even({e}, 0) AS INTEGER)"
            cols.append(f"{e} AS {c}")
        else:
            cols.append(c)
    return f"k_{table} AS (SELECT {', '.join(cols)} FROM i_{table})"


def all_ctes(upto: str = "k") -> str:
    steps = {"n": [normalised_cte], "f": [normalised_cte, fills_cte], "i": [normalised_cte, fills_cte, imputed_cte],
             "b": [normalised_cte, fills_cte, imputed_cte, bounds_cte],
             "k": [normalised_cte, fills_cte, imputed_cte, bounds_cte, cleaned_cte]}[upto]
    return ",\n".join(fn(t) for t in ORDER for fn in steps)


def normalisation_report() -> str:
    parts = []
    for t in ORDER:
        _, _, text, _, _ = _kinds(t)
        for c in text:
            ch = f"{c} IS NOT NULL AND ({norm(c)}) IS DISTINCT FROM {c}"
            parts.append(
                f"SELECT '{t}' AS tabla, '{c}' AS campo, CAST(SUM(CASE WHEN {ch} THEN 1 ELSE 0 END) AS BIGINT) AS registros_modificados, "
                f"COUNT(DISTINCT {c}) AS valores_unicos_antes, COUNT(DISTINCT ({norm(c)})) AS valores_unicos_despues FROM {t}"
            )
    return with_fixtures(f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE registros_modificados > 0")


def normalisation_examples() -> str:
    parts = []
    for t in ORDER:
        _, _, text, _, _ = _kinds(t)
        for c in text:
            parts.append(
                f"SELECT DISTINCT '{t}' AS tabla, '{c}' AS campo, {c} AS valor_original, ({norm(c)}) AS valor_normalizado "
                f"FROM {t} WHERE {c} IS NOT NULL AND ({norm(c)}) IS DISTINCT FROM {c}"
            )
    body = (
        f"SELECT tabla, campo, CAST(orden AS INTEGER) AS orden, valor_original, valor_normalizado FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY tabla, campo ORDER BY valor_original) AS orden FROM ({' UNION ALL '.join(parts)})) WHERE orden <= 5"
    )
    return with_fixtures(body)


def null_rates() -> str:
    parts = []
    for t in ORDER:
        spec = TABLES[t]
        for f in spec.schema.fields:
            miss = f"{f.name} IS NULL" + (f" OR isnan({f.name})" if f.dataType.typeName() == "double" else "")
            parts.append(
                f"SELECT '{t}' AS tabla, '{f.name}' AS campo, COUNT(*) AS total_registros, COUNT(*) FILTER (WHERE {miss}) AS valores_nulos, "
                f"CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE {miss}) AS DOUBLE) * 100.0 / COUNT(*) ELSE 0.0 END AS porcentaje FROM n_{t}"
            )
    return with_fixtures(" UNION ALL ".join(parts), all_ctes("n"))


def imputation_values() -> str:
    return with_fixtures(" UNION ALL ".join(f"SELECT * FROM f_{t}" for t in ORDER), all_ctes("f"))


def missing_report() -> str:
    parts = []
    for t in ORDER:
        _, _, text, num, _ = _kinds(t)
        for c in text + num:
            is_text = c in text
            st = f"(SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulos, COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*) AS pct FROM n_{t})"
            fv = f"(SELECT valor_texto FROM f_{t} WHERE campo = '{c}')"
            fn = f"(SELECT valor_numerico FROM f_{t} WHERE campo = '{c}')"
            fs = f"(SELECT estrategia FROM f_{t} WHERE campo = '{c}')"
            imputed = f"EXISTS (SELECT 1 FROM f_{t} WHERE campo = '{c}')"
            if is_text:
                act_imp = f"'Imputados con ''' || {fv} || ''' (' || CAST(s.nulos AS VARCHAR) || ' registros)'"
            else:
                act_imp = (
                    f"CASE WHEN s.pct >= 20 THEN 'Imputados con 0 (' || CAST(s.nulos AS VARCHAR) || ' registros) - alta tasa de faltantes (' || printf('%.1f', s.pct) || '%)' "
                    f"ELSE 'Imputados con mediana (' || printf('%.2f', {fn}) || ') - ' || CAST(s.nulos AS VARCHAR) || ' registros' END"
                )
            act_not = (
                "CASE WHEN s.pct >= 20 THEN 'No imputado (categórico) - porcentaje alto (' || printf('%.2f', s.pct) || '%). Requiere análisis manual' "
                "ELSE 'No requiere imputación - sin valores faltantes' END"
            )
            left = f"CASE WHEN {imputed} THEN 0 ELSE s.nulos END"
            parts.append(
                f"SELECT '{t}' AS tabla, '{c}' AS campo, s.total AS total_registros, CAST({left} AS BIGINT) AS valores_faltantes, "
                f"ROUND(CAST({left} AS DOUBLE) / s.total * 100, 2) AS porcentaje_faltante, "
                f"CASE WHEN {imputed} THEN {act_imp} ELSE {act_not} END AS recomendacion, "
                f"COALESCE({fs}, 'sin_imputar') AS estrategia FROM {st} s WHERE s.nulos > 0"
            )
    return with_fixtures(" UNION ALL ".join(parts), all_ctes("f"))


def bounds() -> str:
    return with_fixtures(" UNION ALL ".join(f"SELECT * FROM b_{t}" for t in ORDER), all_ctes("b"))


def _outlier_report_parts() -> list[str]:
    parts = []
    for t in ORDER:
        _, _, _, num, _ = _kinds(t)
        for c in num:
            x = f"CAST(i.{c} AS DOUBLE)"
            outside = f"({x} < b.limite_inferior OR {x} > b.limite_superior)"
            parts.append(
                f"SELECT '{t}' AS tabla, '{c}' AS campo, COUNT({x}) AS total_registros, ROUND(ANY_VALUE(b.q1), 2) AS q1, ROUND(ANY_VALUE(b.q3), 2) AS q3, "
                f"ROUND(ANY_VALUE(b.iqr), 2) AS iqr, ROUND(ANY_VALUE(b.limite_inferior), 2) AS limite_inferior, ROUND(ANY_VALUE(b.limite_superior), 2) AS limite_superior, "
                f"COUNT(*) FILTER (WHERE {outside}) AS outliers_detectados, "
                f"ROUND(CASE WHEN COUNT({x}) > 0 THEN COUNT(*) FILTER (WHERE {outside}) * 100.0 / COUNT({x}) ELSE 0.0 END, 2) AS porcentaje_outliers "
                f"FROM i_{t} i JOIN b_{t} b ON b.campo = '{c}'"
            )
    return parts


def outlier_report() -> str:
    return with_fixtures(" UNION ALL ".join(_outlier_report_parts()), all_ctes("b"))


def outlier_values() -> str:
    parts = []
    for t in ORDER:
        _, _, _, num, _ = _kinds(t)
        for c in num:
            x = f"CAST(i.{c} AS DOUBLE)"
            parts.append(
                f"SELECT '{t}' AS tabla, '{c}' AS campo, {x} AS valor FROM i_{t} i JOIN b_{t} b ON b.campo = '{c}' "
                f"WHERE {x} < b.limite_inferior OR {x} > b.limite_superior"
            )
    body = (
        "SELECT tabla, campo, CAST(orden AS INTEGER) AS orden, valor FROM (SELECT *, row_number() OVER (PARTITION BY tabla, campo ORDER BY valor) AS orden "
        f"FROM ({' UNION ALL '.join(parts)})) WHERE orden <= 20"
    )
    return with_fixtures(body, all_ctes("b"))


def combined_report_sql() -> str:
    nparts, mparts, oparts = [], [], _outlier_report_parts()
    for t in ORDER:
        _, _, text, num, _ = _kinds(t)
        for c in text:
            ch = f"{c} IS NOT NULL AND ({norm(c)}) IS DISTINCT FROM {c}"
            nparts.append(f"SELECT 'normalizacion' AS paso, '{t}.{c}' AS campo, CAST(SUM(CASE WHEN {ch} THEN 1 ELSE 0 END) AS BIGINT) AS registros FROM {t}")
        for c in text + num:
            imputed = f"EXISTS (SELECT 1 FROM f_{t} WHERE campo = '{c}')"
            mparts.append(
                f"SELECT 'imputacion' AS paso, '{t}.{c}' AS campo, CAST(COUNT(*) - CASE WHEN {imputed} THEN 0 ELSE COUNT(*) FILTER (WHERE {c} IS NULL) END AS BIGINT) AS registros, "
                f"COUNT(*) FILTER (WHERE {c} IS NULL) AS nulos, CASE WHEN {imputed} THEN COUNT(*) FILTER (WHERE {c} IS NULL) ELSE 0 END AS filled FROM n_{t}"
            )
    norm_u = f"SELECT * FROM ({' UNION ALL '.join(nparts)}) WHERE registros > 0"
    miss_u = f"SELECT paso, campo, registros FROM ({' UNION ALL '.join(mparts)}) WHERE nulos > 0"
    out_u = f"SELECT 'outliers' AS paso, tabla || '.' || campo AS campo, outliers_detectados AS registros FROM ({' UNION ALL '.join(oparts)})"
    filled = f"SELECT CAST(SUM(filled) AS BIGINT) AS n FROM ({' UNION ALL '.join(mparts)})"
    return norm_u, miss_u, out_u, filled


def combined_report() -> str:
    n, m, o, _ = combined_report_sql()
    return with_fixtures(f"{n} UNION ALL {m} UNION ALL {o}", all_ctes("b"))


def summary() -> str:
    n, m, o, filled = combined_report_sql()
    body = f"""
SELECT paso, campos_procesados, registros,
       CASE WHEN paso = 'imputacion' THEN (SELECT n FROM filled) ELSE registros END AS registros_reales
FROM (SELECT paso, COUNT(campo) AS campos_procesados, CAST(SUM(registros) AS BIGINT) AS registros FROM rep GROUP BY paso)
UNION ALL
SELECT 'total', SUM(campos_procesados), CAST(SUM(registros) AS BIGINT), CAST(SUM(registros_reales) AS BIGINT) FROM (
  SELECT paso, COUNT(campo) AS campos_procesados, SUM(registros) AS registros,
         CASE WHEN paso = 'imputacion' THEN (SELECT n FROM filled) ELSE SUM(registros) END AS registros_reales
  FROM rep GROUP BY paso)"""
    extra = all_ctes("b") + f",\nrep AS ({n} UNION ALL {m} UNION ALL {o}),\nfilled AS ({filled})"
    return with_fixtures(body, extra)


def cleaned(table: str) -> str:
    return with_fixtures(f"SELECT * FROM k_{table}", all_ctes("k"))


SQL.update(
    {
        "c1_normalise_paciente": with_fixtures("SELECT * FROM n_paciente", normalised_cte("paciente")),
        "c3_normalisation_report": normalisation_report(),
        "c3_normalisation_examples": normalisation_examples(),
        "c4_null_rates": null_rates(),
        "c5_imputation_values": imputation_values(),
        "c7_missing_report": missing_report(),
        "c8_iqr_bounds": bounds(),
        "c10_outlier_report": outlier_report(),
        "c10_outlier_values": outlier_values(),
        "q5_clean_paciente": cleaned("paciente"),
        "q5_clean_consulta": cleaned("consulta"),
        "q5_clean_laboratorio": cleaned("laboratorio"),
        "c12_combined_report": combined_report(),
        "c13_summary": summary(),
    }
)
