"""Pieces of DuckDB SQL that say what the dictionary of values and the profile are."""

from __future__ import annotations

from gristmill import config

from .dirty import VIEWS


def words(items: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + ")"


def norm(v: str) -> str:
    return f"lower(trim(regexp_replace(replace({v}, '\u00a0', ' '), '\\s+', ' ', 'g')))"


def missing(v: str) -> str:
    return f"({norm(v)} IN {words(config.MISSING_WORDS)})"


def sentinel(v: str) -> str:
    return f"({norm(v)} IN {words(config.SENTINEL_WORDS)})"


def number(v: str) -> str:
    plain = f"CASE WHEN regexp_full_match(trim({v}), '-?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') THEN replace({v}, ',', '') ELSE {v} END"
    return f"(CASE WHEN regexp_full_match({plain}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN CAST(trim({plain}) AS DOUBLE) END)"


def present_number(v: str) -> str:
    return f"(CASE WHEN NOT {missing(v)} THEN {number(v)} END)"


def bare(v: str) -> str:
    """A value without brackets, currency signs and thousands separators."""
    inner = f"CASE WHEN regexp_full_match(trim({v}), '\\(.*\\)') THEN substr(trim({v}), 2, length(trim({v})) - 2) ELSE trim({v}) END"
    plain = f"trim(regexp_replace({inner}, '[$€£¥₹₽¢]', '', 'g'))"
    return f"CASE WHEN regexp_matches({plain}, '^-?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?\\s*') THEN replace({plain}, ',', '') ELSE {plain} END"


DRESS = r"^(-?\d*\.?\d+(?:[eE][-+]?\d+)?)\s*([a-zA-Z°%/²³]{0,4})$"


def literal(v: str) -> str:
    got = f"nullif(regexp_extract({bare(v)}, '{DRESS}', 1), '')"
    return f"(CASE WHEN regexp_full_match(trim({v}), '\\(.*\\)') THEN (CASE WHEN {got} LIKE '-%' THEN substr({got}, 2) ELSE '-' || {got} END) ELSE {got} END)"


def dressed(v: str) -> str:
    return f"(NOT regexp_full_match(trim({v}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') AND {literal(v)} IS NOT NULL)"


MONTH = "((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr({}, 1, 3))) + 2) // 3)"


def style(v: str) -> str:
    return (
        f"(CASE WHEN regexp_matches(trim({v}), '^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') THEN 'iso' WHEN regexp_full_match(trim({v}), '\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{4}}') THEN 'numeric' "
        f"WHEN regexp_full_match(trim({v}), '\\d{{1,2}}[-\\s][A-Za-z]{{3,9}}[-\\s,]+\\d{{4}}') THEN 'day-month-name' WHEN regexp_full_match(trim({v}), '[A-Za-z]{{3,9}}[-\\s]+\\d{{1,2}}[-\\s,]+\\d{{4}}') THEN 'month-name-day' END)"
    )


def iso_date(v: str, dayfirst: str = "false") -> str:
    t = f"trim({v})"
    part = lambda p, k: f"CAST(nullif(regexp_extract({t}, '{p}', {k}), '') AS INT)"
    text = lambda p, k: f"regexp_extract({t}, '{p}', {k})"
    iso, num, dn, nd = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", r"^(\d{1,2})[-\s]([A-Za-z]{3,9})[-\s,]+(\d{4})$", r"^([A-Za-z]{3,9})[-\s]+(\d{1,2})[-\s,]+(\d{4})$"
    made = lambda y, m, d: f"(CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', {y}, {m}, {d}) END)"
    day_leads = f"({part(num, 1)} > 12 OR ({part(num, 2)} <= 12 AND {dayfirst}))"
    return (
        f"(CASE {style(v)} WHEN 'iso' THEN {made(part(iso, 1), part(iso, 2), part(iso, 3))} "
        f"WHEN 'numeric' THEN (CASE WHEN {day_leads} THEN {made(part(num, 3), part(num, 2), part(num, 1))} ELSE {made(part(num, 3), part(num, 1), part(num, 2))} END) "
        f"WHEN 'day-month-name' THEN {made(part(dn, 3), MONTH.format(text(dn, 2)), part(dn, 1))} WHEN 'month-name-day' THEN {made(part(nd, 3), MONTH.format(text(nd, 1)), part(nd, 2))} END)"
    )


def truth(v: str) -> str:
    return f"(CASE WHEN lower(trim({v})) IN {words(config.TRUE_WORDS)} THEN true WHEN lower(trim({v})) IN {words(config.FALSE_WORDS)} THEN false END)"


def dirty(view: str) -> str:
    body = VIEWS[view]
    return f"dirty AS ({body.replace(' AS rid0', ' AS rid') if view == 'lines' else body})"


def cells(columns: list[str]) -> str:
    return "cells AS (" + " UNION ALL ".join(f"SELECT rid, '{c}' AS col, {c} AS raw FROM dirty" for c in columns) + ")"


def values(view: str, columns: list[str]) -> str:
    """WITH dirty, cells, vals (the dictionary) and prof (the profile with its types)."""
    share = config.PARSE_SHARE
    return f"""WITH {dirty(view)}, {cells(columns)},
counted AS (SELECT col, raw, count(*) AS n FROM cells GROUP BY col, raw),
vals AS (SELECT *, {norm('raw')} AS norm, {missing('raw')} AS missing, {sentinel('raw')} AS sentinel, trim(raw) = '' AS blank, {number('raw')} AS num,
  {dressed('raw')} AS dressed, CASE WHEN trim(raw) = '' THEN 0 ELSE len(string_split({norm('raw')}, ' ')) END AS n_words FROM counted),
stats AS (SELECT col, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE missing), 0) AS BIGINT) AS n_missing, CAST(coalesce(sum(n) FILTER (WHERE NOT missing), 0) AS BIGINT) AS n_present,
  count(*) FILTER (WHERE NOT missing) AS n_unique, count(*) AS n_raw,
  coalesce(sum(n * n_words) FILTER (WHERE NOT missing), 0) / greatest(coalesce(sum(n) FILTER (WHERE NOT missing), 0), 1) AS mean_tokens,
  CAST(coalesce(sum(n) FILTER (WHERE NOT missing AND num IS NOT NULL), 0) AS BIGINT) AS n_numeric, coalesce(sum(n) FILTER (WHERE NOT missing AND num % 1 <> 0), 0) AS n_fractional,
  coalesce(sum(n) FILTER (WHERE NOT missing AND NOT sentinel), 0) AS n_readable, coalesce(sum(n) FILTER (WHERE NOT missing AND NOT sentinel AND dressed), 0) AS n_dressed,
  coalesce(sum(n) FILTER (WHERE NOT missing AND {style('raw')} IS NOT NULL), 0) AS n_dates,
  bool_and(missing OR lower(trim(raw)) IN {words(config.BOOLEAN_WORDS)}) AS boolean_words FROM vals GROUP BY col),
prof AS (SELECT *, n_missing / n_rows AS missing_fraction, CASE WHEN n_unique <= 1 THEN 'constant'
  WHEN n_unique / greatest(n_present, 1) > {config.ID_SHARE} AND NOT ((n_numeric / greatest(n_present, 1) > {share} AND n_fractional / greatest(n_numeric, 1) > {config.CONTINUOUS_SHARE}) OR n_dressed / greatest(n_readable, 1) > {share})
    AND NOT n_dates / greatest(n_present, 1) > {share} AND mean_tokens < {config.TEXT_TOKENS} THEN 'id_like'
  WHEN n_unique = 2 AND boolean_words THEN 'boolean' WHEN n_dates / greatest(n_present, 1) > {share} THEN 'datetime'
  WHEN n_numeric / greatest(n_present, 1) > {share} THEN 'numeric' WHEN mean_tokens >= {config.TEXT_TOKENS} THEN 'text' ELSE 'categorical' END AS inferred_type FROM stats)
"""
