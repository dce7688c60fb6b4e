"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

from .url_filters import HOST_RULES, PATTERNS, to_regex
from .warc import BASE32


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _url_filters() -> str:
    """Every rule against every URL, without an index."""
    fits = {f"(host = {_text(r.host)} OR ends_with(host, {_text('.' + r.host)})) AND starts_with(path, {_text(r.path)})": r for r in sorted(HOST_RULES, key=lambda r: -len(r.host + r.path))}
    rule = "CASE " + " ".join(f"WHEN {c} THEN {_text(r.host + r.path)}" for c, r in fits.items()) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN {_text(r.verdict)}" for c, r in fits.items()) + " WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END"
    pattern = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), {_text(to_regex(p))}) THEN {_text(p)}" for p in PATTERNS) + " END"
    return f"""
WITH cut AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         {pattern} AS pattern
  FROM pages)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, pattern FROM cut"""


def _warc() -> str:
    digits = " || ".join(f"substr('{BASE32}', 1 + ((16 * (instr('0123456789abcdef', h[{5 * i // 4 + 1}]) - 1) + instr('0123456789abcdef0', h[{5 * i // 4 + 2}]) - 1) >> {3 - 5 * i % 4}) % 32, 1)" for i in range(32))
    return f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) || '0' AS h FROM pages),
ranked AS (SELECT page_id, p, h, min(page_id) OVER (PARTITION BY h) AS f FROM hashed)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, {digits} AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM ranked"""


ORACLE_SQL: dict[str, str] = {"op9_warc": _warc(), "op10_url_filters": _url_filters()}
