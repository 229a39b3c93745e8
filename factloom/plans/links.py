"""Registered queries: HTTP calls and the endpoints that they reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import routes, stitch
from ..sources import tables as t
from .queries import query

# Calls are the pages' addresses behind a publication, whole, cut or not known by their number; endpoints
# are one for each supplier. The SQL compares every call with every endpoint.
_CALLS = r"""raw AS (SELECT page_id AS id, CASE WHEN starts_with(url, 'https') THEN 'POST' ELSE 'GET' END AS verb, CASE page_id % 5 WHEN 0 THEN '' ELSE lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^:/?#]*)', 1)) END AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS p FROM pages),
calls AS (SELECT id, verb, host, CASE id % 4 WHEN 0 THEN '/erp/hs' || p WHEN 1 THEN '/erp/hs' || left(p, greatest(1, length(p) - 1)) WHEN 2 THEN '' ELSE CASE WHEN id % 8 = 3 THEN p ELSE '/erp/HS' || p || '?x=1' END END AS path, CASE id % 4 WHEN 1 THEN 'prefix' WHEN 2 THEN 'dynamic' ELSE 'static' END AS path_kind, CASE WHEN id % 4 = 1 AND id % 3 = 0 THEN '/x' WHEN id % 4 = 1 AND id % 3 = 1 THEN right(p, 1) ELSE '' END AS suffix, CASE WHEN id % 12 = 2 THEN 'request-from-parameter' ELSE '' END AS reason FROM raw),
endpoints AS (SELECT 'e' || s_suppkey AS endpoint, 'p' || s_suppkey % 2 AS project, list_value('/en', '/fr', 'de', '/es/')[s_suppkey % 4 + 1] AS root, CASE s_suppkey % 5 WHEN 0 THEN '/{id}' WHEN 1 THEN '/' || s_suppkey * 3 WHEN 2 THEN '/*' WHEN 3 THEN '/{id}/x' ELSE '/' END AS template, list_value('GET', 'POST', 'any')[s_suppkey % 3 + 1] AS verb FROM supplier),
projects AS (SELECT DISTINCT host, CASE WHEN ends_with(host, '.example.com') THEN 'p0' WHEN ends_with(host, '.example.org') THEN 'p1' WHEN ends_with(host, 'a.example.net') THEN 'p9' END AS project FROM calls WHERE host <> '')"""


def _calls(s, d):
    pages = t.table(s, d, "pages")
    k, p = F.col("page_id"), F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    path = F.when(k % 4 == 0, F.concat(F.lit("/erp/hs"), p)).when(k % 4 == 1, F.concat(F.lit("/erp/hs"), F.left(p, F.greatest(F.lit(1), F.length(p) - 1)))).when(k % 4 == 2, "").when(k % 8 == 3, p).otherwise(F.concat(F.lit("/erp/HS"), p, F.lit("?x=1")))
    kind = F.when(k % 4 == 1, "prefix").when(k % 4 == 2, "dynamic").otherwise("static")
    suffix = F.when((k % 4 == 1) & (k % 3 == 0), "/x").when((k % 4 == 1) & (k % 3 == 1), F.right(p, F.lit(1))).otherwise("")
    return pages.select(k.alias("id"), F.when(F.col("url").startswith("https"), "POST").otherwise("GET").alias("verb"), F.when(k % 5 == 0, "").otherwise(text.host(F.col("url"))).alias("host"), path.alias("path"), kind.alias("path_kind"), suffix.alias("suffix"), F.when(k % 12 == 2, "request-from-parameter").otherwise("").alias("reason"))


def _endpoints(s, d):
    k = F.col("s_suppkey")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    template = F.when(k % 5 == 0, "/{id}").when(k % 5 == 1, F.concat(F.lit("/"), (k * 3).cast("string"))).when(k % 5 == 2, "/*").when(k % 5 == 3, "/{id}/x").otherwise("/")
    return t.table(s, d, "supplier").select(F.concat(F.lit("e"), k).alias("endpoint"), F.concat(F.lit("p"), k % 2).alias("project"), pick(4, "/en", "/fr", "de", "/es/").alias("root"), template.alias("template"), pick(3, "GET", "POST", "any").alias("verb"))


def _stitched(s, d):
    calls = _calls(s, d)
    rules = s.createDataFrame([("*.example.com", "p0"), ("*.example.org", "p1"), ("*a.example.net", "p9")], "rule string, project string")
    projects = routes.mapped_hosts(calls.where("host <> ''"), rules).where("project IS NOT NULL")
    return stitch.stitched(calls, _endpoints(s, d), projects)


_STITCHED = _CALLS + r""", parts AS (SELECT c.*, pr.project AS wanted, EXISTS (SELECT 1 FROM endpoints e WHERE e.project = pr.project) AS loaded, list_transform(list_filter(string_split(regexp_replace(path, '[?#].*$', ''), '/'), lambda x: x <> ''), lambda x: lower(x)) AS s, path_kind = 'prefix' AND NOT regexp_matches(path, '[?#]') AND NOT ends_with(path, '/') AS partial FROM calls c LEFT JOIN projects pr ON pr.host = c.host AND pr.project IS NOT NULL),
placed AS (SELECT *, coalesce(list_position(s[:len(s) - CAST(partial AS INTEGER)], 'hs'), 0) AS hs FROM parts), ready AS (SELECT *, s[hs + 1:] AS rest, len(s) - hs - CAST(partial AS INTEGER) AS known FROM placed),
tpl AS (SELECT *, list_filter(string_split(lower(root), '/'), lambda x: x <> '') AS r, list_filter(string_split(lower(template), '/'), lambda x: x <> '') AS t FROM endpoints),
pairs AS (SELECT c.id, e.endpoint, c.verb AS asked, e.verb, path_kind, suffix, partial, known, rest, r, t, len(r) AS nr, rest[len(r) + 1:] AS tail FROM ready c JOIN tpl e ON (c.host = '' OR e.project = c.wanted) WHERE hs > 0 AND path_kind <> 'dynamic'),
cmp AS (SELECT *, known >= nr AND rest[:nr] = r AS rooted, path_kind = 'prefix' AND known < nr AND len(list_filter(range(1, len(rest) + 1), lambda i: CASE WHEN i = len(rest) AND partial THEN NOT starts_with(r[i], rest[i]) ELSE r[i] <> rest[i] END)) = 0 AS before,
  coalesce(list_position(t, '*'), 0) AS star, len(t) AS nt, len(tail) AS n FROM pairs),
seg AS (SELECT *, len(list_filter(range(1, least(n, CASE WHEN star > 0 THEN star - 1 ELSE nt END) + 1), lambda i: NOT (starts_with(t[i], '{') OR t[i] = tail[i] OR (partial AND i = n AND starts_with(t[i], tail[i]))))) = 0 AS agree FROM cmp),
fit AS (SELECT *, rooted AND agree AND CASE WHEN star > 0 AND n >= star - 1 THEN true WHEN path_kind = 'prefix' THEN n <= nt ELSE n = nt END AS found FROM seg),
ended AS (SELECT *, list_filter(string_split(suffix, '/'), lambda x: x <> '') AS z, NOT starts_with(suffix, '/') AS inside FROM fit),
ok AS (SELECT *, found AND (path_kind = 'static' OR suffix = '' OR star > 0 OR (nt - len(z) >= n + CASE WHEN NOT partial AND NOT inside THEN 1 WHEN partial AND inside THEN -1 ELSE 0 END AND len(list_filter(range(1, len(z) + 1), lambda i: NOT (starts_with(t[nt - len(z) + i], '{') OR CASE WHEN inside AND i = 1 THEN ends_with(t[nt - len(z) + i], z[i]) ELSE t[nt - len(z) + i] = z[i] END))) = 0)) AS ok, upper(verb) IN ('ANY', asked) AS allowed FROM ended),
hits AS (SELECT id, string_agg(CASE WHEN ok AND allowed THEN endpoint END, ',' ORDER BY endpoint) AS good, string_agg(CASE WHEN ok THEN endpoint END, ',' ORDER BY endpoint) AS every, bool_or(before) AS before FROM ok GROUP BY id),
stitched AS (SELECT c.id, CASE WHEN host <> '' AND wanted IS NULL THEN 'external' WHEN path_kind = 'dynamic' THEN 'dynamic' WHEN host <> '' AND NOT loaded THEN 'unknown' WHEN every IS NOT NULL THEN 'stitched' WHEN path_kind = 'prefix' THEN 'unknown' ELSE 'external' END AS kind,
  CASE WHEN host <> '' AND wanted IS NULL THEN 'host-unmapped' WHEN path_kind = 'dynamic' THEN CASE WHEN reason <> '' THEN reason ELSE 'dynamic-path' END WHEN host <> '' AND NOT loaded THEN 'project-not-loaded' WHEN every IS NOT NULL AND good IS NULL THEN 'verb-not-allowed' WHEN every IS NOT NULL THEN CASE WHEN host <> '' THEN 'host-mapped' ELSE 'path-only' END WHEN hs = 0 THEN CASE path_kind WHEN 'prefix' THEN 'prefix-without-hs' ELSE 'no-endpoint' END WHEN before THEN 'prefix-before-root' ELSE 'no-endpoint' END AS reason, coalesce(good, every) AS endpoints, host, path_kind FROM ready c LEFT JOIN hits h ON h.id = c.id)"""


@query(f"WITH {_STITCHED} SELECT id, kind, reason, CASE kind WHEN 'stitched' THEN endpoints ELSE '' END AS endpoints, CASE WHEN kind <> 'stitched' THEN 0.0 WHEN host <> '' THEN CASE path_kind WHEN 'static' THEN 0.9 ELSE 0.7 END WHEN path_kind = 'static' THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM stitched")
def stitched_calls(s, d):
    """The endpoints that each call reaches, or why none can be told."""
    return _stitched(s, d)


@query(f"WITH {_STITCHED} SELECT coalesce(d.source, '') AS owner, count(*) FILTER (kind = 'stitched') AS stitched, count(*) FILTER (kind = 'external') AS external, count(*) FILTER (kind = 'dynamic') AS dynamic, count(*) FILTER (kind = 'unknown') AS unknown FROM stitched x JOIN documents d ON d.doc_id = x.id GROUP BY 1")
def object_links(s, d):
    """How the calls of each owner end."""
    owners = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("owner"))
    return stitch.link_counts(_stitched(s, d), owners)
