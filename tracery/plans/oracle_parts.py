"""Pieces of SQL that several oracles use."""

PATHS = "paths AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/|[?#].*$', '', 'g') AS path FROM pages)"
