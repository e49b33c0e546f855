"""DuckDB twins of the registered queries that SQL can express.

The others are checked in ``tests/llm`` against brute force, a library or a round trip: quantile
sketches, mixture weights, merges, region scans and archives have no SQL form.
"""

from billwright.llm import secret_scan
from billwright.llm.url_filter import (
    CAPITALS,
    LEAST_SPREAD,
    MOST_SPREAD,
    TWO_LABEL_SUFFIXES,
)

ORACLE: dict[str, str] = {}

_LOWER = f"'{CAPITALS}', '{CAPITALS.lower()}'"
_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)


def _level(name: str, keys: str, source: str, prior: str) -> str:
    """CTEs of one level: its groups, its prior strength and its posterior."""
    return f"""
{name}_groups AS (SELECT g.*, {prior}),
{name}_strength AS (
  SELECT 1 / least(greatest(coalesce((sum(n * pow(k / n - prior, 2)) - sum(prior * (1 - prior)))
    / nullif(sum(prior * (1 - prior) * (n - 1)), 0), {LEAST_SPREAD}), {LEAST_SPREAD}), {MOST_SPREAD}) - 1 AS s
  FROM {name}_groups WHERE n > 0),
{name}_posterior AS (SELECT {keys}, (prior * s + k) / (n + s) AS mean, n + s AS weight FROM {name}_groups, {name}_strength)"""


ORACLE["op1_url_filter"] = rf"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
outcomes AS (SELECT page_id, host, (quality = 0 OR toxic = 1) AS bad FROM parsed
  JOIN labels ON labels.doc_id = try_cast(regexp_extract(path, '/(\d+)[^/]*/?$', 1) AS BIGINT)),
counted AS (SELECT host, count(o.bad) AS n, count(CASE WHEN o.bad THEN 1 END) AS k
  FROM (SELECT DISTINCT host FROM parsed) h LEFT JOIN outcomes o USING (host) GROUP BY host),
labelled AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), '(:\d*|\.+)$', ''), '.') AS parts FROM counted),
hosts AS (SELECT host, n, k, array_to_string(parts[-(CASE WHEN two THEN 3 ELSE 2 END):], '.') AS domain,
    CASE WHEN two THEN last_two ELSE parts[-1] END AS suffix
  FROM (SELECT *, array_to_string(parts[-2:], '.') AS last_two, len(parts) > 1 AND array_to_string(parts[-2:], '.') IN ({_TWO}) AS two FROM labelled)),
root AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS mean FROM hosts),
{_level("suffix", "suffix", "", "root.mean AS prior FROM (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix) g, root")},
{_level("domain", "domain, suffix", "", "p.mean AS prior FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix) g JOIN suffix_posterior p USING (suffix)")},
{_level("host", "host", "", "p.mean AS prior FROM hosts g JOIN domain_posterior p ON g.domain = p.domain AND g.suffix = p.suffix")},
fits AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL OR mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.25 THEN 'block' ELSE 'allow' END AS verdict
FROM fits JOIN host_posterior USING (host)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op2_decontaminate"] = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, pos, pos + 9), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS (SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos
        FROM docs, (SELECT DISTINCT size FROM phrases) WHERE len(w) >= size)),
found AS (SELECT DISTINCT r.doc_id, r.pos, r.size, p.item_id FROM runs r JOIN phrases p ON r.size = p.size AND r.phrase = p.phrase),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM
  (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
  (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

ORACLE["op5_jaccard_join"] = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 2), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS pos FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.u = d.doc_id"""

ORACLE["op7_chat_format"] = """
WITH turns AS (SELECT conv_id, turn, role, text, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(role || chr(1) || text || chr(2), '') OVER w AS prefix
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
wholes AS (SELECT prefix, min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_copies FROM turns WHERE place = n GROUP BY prefix),
kept AS (SELECT * FROM wholes WHERE prefix NOT IN (SELECT prefix FROM turns WHERE place < n))
SELECT conv_id, cast(n_turns AS int) AS n_turns, n_copies,
  string_agg('<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM kept JOIN conversations USING (conv_id) GROUP BY conv_id, n_turns, n_copies"""


_ANY_CASE = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
             for word in ("password", "passwd", "secret", "token", "api_?key")]
_ASSIGN = rf"""(?:{"|".join(_ANY_CASE)})["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)"""
_STRING = secret_scan.IN_STRING


def _cut(name: str, source: str, keys: str, pattern: str, group: int = 0) -> str:
    """CTE of the pieces between a pattern's matches: place, piece, hit, value, end of the hit."""
    return rf"""
{name} AS (SELECT *, cast(sum(length(piece) + coalesce(length(hit), 0)) OVER (PARTITION BY {keys} ORDER BY place) AS BIGINT) AS stop
  FROM (SELECT {keys}, base_at, unnest(range(1, len(pieces) + 1)) AS place, unnest(pieces) AS piece, unnest(hits) AS hit, unnest(vals) AS val
    FROM (SELECT {keys}, base_at, regexp_split_to_array(body, '{pattern}') AS pieces, regexp_extract_all(body, '{pattern}', 0) AS hits,
      regexp_extract_all(body, '{pattern}', {group}) AS vals FROM {source})))"""


def _model(name: str, kind: str, uniform: float) -> str:
    size, weight = len(secret_scan.ALPHABET), secret_scan.SMOOTHING
    return f"""
{name}_n AS (SELECT pair, count(*) AS n FROM pairs WHERE random = {kind} GROUP BY pair),
{name}_one AS (SELECT c, (coalesce(n, 0) + 1.0) / ((SELECT coalesce(sum(n), 0) FROM {name}_n) + {size}) AS single
  FROM letters LEFT JOIN (SELECT substr(pair, 2, 1) AS c, sum(n) AS n FROM {name}_n GROUP BY 1) USING (c)),
{name} AS (SELECT a.c || b.c AS pair, {1 - uniform} * ((coalesce(p.n, 0) + {weight} * b.single)
    / (coalesce(f.n, 0) + {weight})) + {uniform / size} AS p
  FROM letters a CROSS JOIN {name}_one b LEFT JOIN {name}_n p ON p.pair = a.c || b.c
  LEFT JOIN (SELECT substr(pair, 1, 1) AS c, sum(n) AS n FROM {name}_n GROUP BY 1) f ON f.c = a.c)"""


def _simple_spans(name: str, kind: int) -> str:
    return f"SELECT doc_id, {kind} AS kind, stop - length(hit) AS start, stop, hit AS val FROM {name} WHERE hit IS NOT NULL"


def _listed(spans: str) -> str:
    names = "['" + "', '".join(secret_scan.KINDS) + "'][kind]"
    return f"""SELECT doc_id, string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS listed,
    count(CASE WHEN kind = 1 THEN 1 END) AS n_assign, count(CASE WHEN kind = 2 THEN 1 END) AS n_access,
    count(CASE WHEN kind = 3 THEN 1 END) AS n_hex FROM {spans} GROUP BY doc_id"""


ORACLE["op12_secret_scan"] = rf"""
WITH texts AS (SELECT doc_id, 0 AS base_at, coalesce(text, '') AS body FROM documents),
{_cut("assigned", "texts", "doc_id", _ASSIGN, 1)},
{_cut("accessed", "texts", "doc_id", "AKIA[A-Z0-9]{%d,}" % (secret_scan.LEAST_ACCESS - 4))},
{_cut("hexed", "texts", "doc_id", "[0-9a-f]{%d,}" % secret_scan.LEAST_HEX)},
base AS ({_simple_spans("assigned", 1).replace("hit AS val", "val")} AND length(val) >= {secret_scan.LEAST_ASSIGNED}
  UNION ALL {_simple_spans("accessed", 2)} UNION ALL {_simple_spans("hexed", 3)}),
pieces AS (SELECT doc_id, place AS outer_place, stop - coalesce(length(hit), 0) - length(piece) AS base_at, piece AS body FROM assigned),
{_cut("strings", "pieces", "doc_id, outer_place", "%s{%d,}" % (_STRING, secret_scan.LEAST_CANDIDATE))},
candidates AS (SELECT doc_id, 4 AS kind, base_at + stop - length(hit) AS start, base_at + stop AS stop, hit AS val FROM strings
  WHERE hit IS NOT NULL AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
    AND NOT regexp_matches(hit, 'AKIA[A-Z0-9]{{{secret_scan.LEAST_ACCESS - 4},}}') AND NOT regexp_matches(hit, '[0-9a-f]{{{secret_scan.LEAST_HEX},}}')),
secret_docs AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM base) ORDER BY md5(cast(doc_id AS VARCHAR)), doc_id LIMIT {secret_scan.SAMPLE_TEXTS}),
plain_docs AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM base))
  ORDER BY md5(cast(doc_id AS VARCHAR)), doc_id LIMIT {secret_scan.SAMPLE_TEXTS}),
samples AS (SELECT val, true AS random FROM base WHERE doc_id IN (SELECT doc_id FROM secret_docs)
  UNION ALL SELECT val, false AS random FROM (SELECT unnest(regexp_extract_all(body, '{_STRING}{{{secret_scan.LEAST_ORDINARY},}}')) AS val
    FROM texts WHERE doc_id IN (SELECT doc_id FROM plain_docs))
  WHERE length(val) < {secret_scan.LEAST_CANDIDATE} OR NOT regexp_matches(val, '[0-9]') OR NOT regexp_matches(val, '[A-Za-z]')),
pairs AS (SELECT random, pair FROM (SELECT random, substr(val, unnest(range(1, length(val))), 2) AS pair FROM samples)
  WHERE regexp_full_match(pair, '{_STRING}{{2}}')),
letters AS (SELECT unnest(string_split('{secret_scan.ALPHABET}', '')) AS c),
{_model("random_p", "true", secret_scan.UNIFORM[True])},
{_model("ordinary_p", "false", secret_scan.UNIFORM[False])},
scores AS (SELECT doc_id, kind, start, stop, val, sum(ln(r.p) - ln(o.p)) AS ratio
  FROM (SELECT *, substr(val, unnest(range(1, length(val))), 2) AS pair FROM candidates)
  JOIN random_p r USING (pair) JOIN ordinary_p o USING (pair) GROUP BY ALL),
spans AS (SELECT doc_id, kind, start, stop FROM base UNION ALL
  SELECT doc_id, kind, start, stop FROM scores WHERE ratio > {secret_scan.LEAST_RATIO}),
base_listed AS ({_listed("base")}), all_listed AS ({_listed("spans")})
SELECT d.doc_id, coalesce(b.n_assign, 0) AS n_assign, coalesce(b.n_access, 0) AS n_access, coalesce(b.n_hex, 0) AS n_hex,
  sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(a.listed, '') AS spans
FROM documents d LEFT JOIN base_listed b ON b.doc_id = d.doc_id LEFT JOIN all_listed a ON a.doc_id = d.doc_id"""
