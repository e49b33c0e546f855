"""The registered queries as DuckDB SQL, written in set form.

Extraction is restated with unnested lines, window functions and grouping, apart from
the Spark expressions. Only the writing of the input texts shares its CASE arms with
:mod:`billwright.plans.corpus`, so that both sides read the same texts.
"""

from __future__ import annotations

from billwright.plans import corpus as src

ORACLE: dict[str, str] = {}


def _dialect(sql: str) -> str:
    return sql.replace(" as string)", " as varchar)").replace(" div ", " // ")


_ITEM_CENTS = src._ITEM_CENTS

# ---- Common table expressions ------------------------------------------------------
# The regular expressions, key words, message texts and limits in the SQL below
# define the results and are those of functions/fields.py and functions/quality.py.
CTES: dict[str, str] = {}

CTES["inv0"] = f"""
SELECT o_orderkey AS k, o_custkey, o_orderdate, o_orderpriority, {_dialect(src._CENTS)} AS c
FROM orders"""

CTES["inv1"] = f"""
SELECT *, concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0')) AS name,
  CASE WHEN k % 7 > 1 THEN concat('INV-', lpad(cast(k as varchar), 9, '0')) END AS truth_number,
  CASE WHEN k % 11 = 0 THEN NULL
       WHEN k % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d')
       WHEN k % 4 = 2 THEN strftime(o_orderdate, '%d-%m-%y')
       ELSE strftime(o_orderdate, '%d/%m/%Y') END AS truth_date,
  (SELECT string_agg({_dialect(src._ITEM_LINE)}, chr(10) ORDER BY i)
   FROM range(0, k % 6 + 1) AS r(i)) AS items,
  (SELECT cast(sum({_ITEM_CENTS}) as bigint) FROM range(0, k % 6 + 1) AS r(i)) AS total_cents
FROM inv0"""

CTES["inv2"] = f"""
SELECT *,
  CASE WHEN k % 7 = 1 THEN concat('Invoice No: ', lpad(cast(k as varchar), 9, '0'))
       WHEN k % 7 = 2 THEN concat('receipt ', lower(truth_number))
       WHEN truth_number IS NOT NULL THEN concat('Invoice No: ', truth_number) END AS truth_number_line,
  CASE WHEN truth_date IS NULL THEN NULL
       WHEN k % 4 = 3 THEN concat('Date: ', truth_date, ' 09:41:27 PM Due: ', strftime(o_orderdate, '%Y/%m/%d'))
       ELSE concat('Date: ', truth_date) END AS truth_date_line,
  {_dialect(src._money('total_cents'))} AS total_text,
  {_dialect(src._grouped_money('total_cents'))} AS total_grouped
FROM inv1"""

CTES["invoices"] = f"""
SELECT k AS doc_id, 'invoices' AS corpus, 'en' AS lang, o_orderpriority AS source,
  CASE WHEN k % 37 = 3 THEN NULL WHEN k % 13 = 5 THEN replace(body, chr(10), chr(13) || chr(10))
       ELSE body END AS text,
  truth_number, truth_date,
  CASE WHEN k % 8 <> 4 THEN cast(total_cents as double) / 100 END AS truth_total,
  CASE WHEN k % 5 IN (1, 2, 4) THEN name END AS truth_name
FROM (SELECT *, concat_ws(chr(10), {_dialect(', '.join(src._INVOICE_LINES))}) AS body FROM inv2)"""

CTES["corpus_text"] = """
SELECT doc_id, corpus, lang, source, text FROM invoices
UNION ALL SELECT doc_id, 'documents', lang, source, text FROM documents"""

CTES["lines"] = """
SELECT corpus, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
FROM (SELECT corpus, doc_id, string_split(text, chr(10)) AS parts FROM corpus_text WHERE text IS NOT NULL)"""

CTES["date_hits"] = r"""
SELECT corpus, doc_id, 1 AS pat, unnest(m) AS d, unnest(range(len(m))) AS ord
FROM (SELECT corpus, doc_id, regexp_extract_all(text, '\d{2}[/-]\d{2}[/-]\d{4}') AS m FROM corpus_text)
UNION ALL
SELECT corpus, doc_id, 2, unnest(m), unnest(range(len(m)))
FROM (SELECT corpus, doc_id, regexp_extract_all(text, '(\d{2}[/-]\d{2}[/-]\d{2})(?:\D|$)', 1) AS m FROM corpus_text)
UNION ALL
SELECT corpus, doc_id, 3, unnest(m), unnest(range(len(m)))
FROM (SELECT corpus, doc_id, regexp_extract_all(text, '\d{4}[/-]\d{2}[/-]\d{2}') AS m FROM corpus_text)"""

CTES["date_rows"] = """
SELECT corpus, doc_id, d, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY first_at) - 1 AS pos
FROM (SELECT corpus, doc_id, d, min(pat * 1000000 + ord) AS first_at FROM date_hits GROUP BY ALL)"""

CTES["amount_rows"] = r"""
SELECT corpus, doc_id, amount, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY ord) - 1 AS pos
FROM (
  SELECT corpus, doc_id, ord,
    try_cast(replace(regexp_replace(raw, '[^\d.,]', '', 'g'), ',', '.') AS double) AS amount
  FROM (SELECT corpus, doc_id, unnest(m) AS raw, unnest(range(len(m))) AS ord
        FROM (SELECT corpus, doc_id,
                regexp_extract_all(text, '(?:RM|Rs\.?|\$|€)?\s*\d{1,3}(?:,\d{3})*[.,]\d{2}') AS m
              FROM corpus_text)))
WHERE amount IS NOT NULL"""

CTES["totals"] = r"""
SELECT corpus, doc_id, try_cast(replace(regexp_extract(text,
  '(?i)(?:TOTAL|GRAND\s*TOTAL|AMOUNT\s*DUE|BALANCE)\s*:?\s*(\d+[.,]\d{2})', 1), ',', '.') AS double) AS total_amount
FROM corpus_text"""

CTES["vendors"] = r"""
SELECT t.corpus, t.doc_id, coalesce(s.line, f.line) AS vendor_rules
FROM corpus_text t
LEFT JOIN (
  SELECT corpus, doc_id, arg_min(regexp_replace(line, '^\s+|\s+$', '', 'g'), pos) AS line FROM lines
  WHERE regexp_matches(upper(line), 'SDN BHD|INC|LTD|LLC|PLC|CORP|PTY|PVT') GROUP BY ALL) s
  USING (corpus, doc_id)
LEFT JOIN (
  SELECT corpus, doc_id, arg_min(line, pos) AS line
  FROM (SELECT corpus, doc_id, regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g') AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT corpus, doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS parts
              FROM corpus_text WHERE text IS NOT NULL))
  WHERE pos < 10 AND length(line) >= 3 AND NOT regexp_full_match(replace(line, ' ', ''), '[*\-=_#]*')
  GROUP BY ALL) f USING (corpus, doc_id)"""

CTES["number_rows"] = r"""
SELECT t.corpus, t.doc_id, n.receipt_number FROM corpus_text t
LEFT JOIN (
  SELECT corpus, doc_id, upper(arg_min(code, pos * 1000000 + ord)) AS receipt_number
  FROM (SELECT corpus, doc_id, pos, unnest(m) AS code, unnest(range(len(m))) AS ord
        FROM (SELECT corpus, doc_id, pos, regexp_extract_all(line, '(?i)[A-Z]{2,}[A-Z0-9\-]{3,}') AS m
              FROM lines
              WHERE pos < 15 AND (contains(lower(line), 'nvoice') OR contains(lower(line), 'receipt')
                OR contains(lower(line), 'bill') OR contains(lower(line), 'no'))))
  WHERE regexp_matches(code, '\d') GROUP BY ALL) n USING (corpus, doc_id)"""

CTES["bill_lines"] = r"""
SELECT corpus, doc_id, line, pos,
  lead(line) OVER (PARTITION BY corpus, doc_id ORDER BY pos) AS next_line
FROM (SELECT corpus, doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM lines)
WHERE line <> ''"""

CTES["bill_tos"] = r"""
SELECT t.corpus, t.doc_id, CASE WHEN length(b.name) > 2 THEN b.name END AS bill_to_name,
  CASE WHEN length(b.name) > 2 THEN b.email END AS bill_to_email
FROM corpus_text t
LEFT JOIN (
  SELECT corpus, doc_id, email,
    CASE WHEN email IS NULL THEN payload
         ELSE regexp_replace(replace(payload, email, ''), '^\s+|\s+$', '', 'g') END AS name
  FROM (
    SELECT corpus, doc_id, payload,
      nullif(regexp_extract(payload, '[\pL\pN_.\-]+@[\pL\pN_.\-]+\.[\pL\pN_]+'), '') AS email
    FROM (
      SELECT corpus, doc_id,
        CASE WHEN regexp_matches(line, '[:\-]')
             THEN regexp_replace(regexp_replace(line, '^[^:\-]*[:\-]', ''), '^\s+|\s+$', '', 'g')
             ELSE next_line END AS payload
      FROM bill_lines
      WHERE regexp_matches(lower(line), 'bill to|billed to|billing name|customer')
      QUALIFY row_number() OVER (PARTITION BY corpus, doc_id ORDER BY pos) = 1)
    WHERE payload <> '')) b USING (corpus, doc_id)"""

CTES["bounds"] = """
SELECT s.corpus, s.doc_id, s.start_pos, min(l.pos) AS end_pos
FROM (SELECT corpus, doc_id, min(pos) AS start_pos FROM lines
      WHERE regexp_matches(lower(line), 'description|item|qty|price|amount') GROUP BY ALL) s
LEFT JOIN lines l ON l.corpus = s.corpus AND l.doc_id = s.doc_id AND l.pos >= s.start_pos
  AND regexp_matches(lower(l.line), 'total|subtotal|tax|gst')
GROUP BY ALL"""

CTES["section"] = r"""
SELECT l.corpus, l.doc_id, l.pos - b.start_pos - 1 AS line_no, l.line,
  regexp_extract_all(regexp_replace(l.line, '[^\d.\s]', '', 'g'), '\d+(?:\.\d+)?') AS numbers,
  coalesce(cast(nullif(regexp_extract(l.line, '^\s*(\d+)', 1), '') AS bigint), 1) AS quantity,
  regexp_replace(l.line, '[\d.\s]+', '', 'g') AS piece
FROM lines l JOIN bounds b ON l.corpus = b.corpus AND l.doc_id = b.doc_id
WHERE l.pos > b.start_pos AND (b.end_pos IS NULL OR l.pos < b.end_pos)"""

CTES["item_rows"] = """
SELECT corpus, doc_id, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY grp) - 1 AS pos,
  description, quantity, unit_price, total
FROM (
  SELECT corpus, doc_id, grp,
    string_agg(piece, ' ' ORDER BY line_no) FILTER (WHERE piece <> '') AS description,
    max(quantity) FILTER (WHERE len(numbers) > 0) AS quantity,
    max(cast(numbers[-1] AS double)) FILTER (WHERE len(numbers) > 0) AS total,
    max(cast(coalesce(numbers[-2], numbers[-1]) AS double)) FILTER (WHERE len(numbers) > 0) AS unit_price
  FROM (SELECT *, coalesce(sum(cast(len(numbers) > 0 AS int)) OVER (PARTITION BY corpus, doc_id ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM section)
  GROUP BY ALL)
WHERE total IS NOT NULL AND description IS NOT NULL"""

CTES["item_sums"] = """
SELECT t.corpus, t.doc_id, coalesce(n, 0) AS n_items, coalesce(s, 0.0) AS items_total
FROM corpus_text t LEFT JOIN (
  SELECT corpus, doc_id, count(*) AS n,
    list_reduce(list_prepend(0.0::double, list(total ORDER BY pos)), lambda a, x: a + x) AS s
  FROM item_rows GROUP BY ALL) USING (corpus, doc_id)"""

CTES["records"] = """
SELECT *, (cast(receipt_number IS NOT NULL AS int) + cast(date IS NOT NULL AS int)
    + cast(bill_to_name IS NOT NULL AS int) + cast(total_amount IS NOT NULL AS int)
    + cast(n_items > 0 AS int)) * 20 AS extraction_confidence,
  coalesce(abs(total_amount - items_total) < 0.01, false) AS validation_passed
FROM (
  SELECT t.corpus, t.doc_id, t.lang, t.source, t.text AS raw_text, 'rules' AS method, receipt_number,
    d.d AS date, bill_to_name, bill_to_email, n_items, items_total, total_amount, vendor_rules
  FROM corpus_text t
  JOIN number_rows USING (corpus, doc_id) JOIN bill_tos USING (corpus, doc_id)
  JOIN item_sums USING (corpus, doc_id) JOIN totals USING (corpus, doc_id)
  JOIN vendors USING (corpus, doc_id)
  LEFT JOIN (SELECT corpus, doc_id, d FROM date_rows WHERE pos = 0) d USING (corpus, doc_id)
  WHERE t.text IS NOT NULL)"""

CTES["rated"] = """
SELECT *, CASE WHEN extraction_confidence >= 80 THEN 'High' WHEN extraction_confidence >= 50 THEN 'Medium'
    ELSE 'Low' END AS confidence_tier,
  CASE WHEN contains(raw_text, 'SDN BHD') THEN 'Template A (Retail)' ELSE 'Unknown Format' END AS format_name
FROM records"""

CTES["ocr"] = """
SELECT doc_id, row_no, text, cast((doc_id * 7 + row_no * 13) % 101 AS double) AS conf,
  (row_no % 10) * 40 AS "left", (row_no // 10) * 20 AS top, 8 * length(text) AS width, 16 AS height
FROM (SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts))) AS row_no
      FROM (SELECT doc_id, string_split(text, ' ') AS parts FROM documents))"""

CTES["kept"] = r"""
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) - 1 AS word_idx,
  "left" AS x0, top AS y0, "left" + width AS x1, top + height AS y1
FROM ocr WHERE trunc(conf) > 60 AND NOT regexp_full_match(text, '\s*')"""

CTES["tokens"] = """
SELECT doc_id, 2 * word_idx + 1 + sub AS token_idx, word_idx,
  CASE WHEN sub = 1 THEN (label + 1) % 9 WHEN word_idx % 41 = 40 THEN -100 ELSE label END AS label_id
FROM (SELECT doc_id, word_idx, CASE WHEN t = 0 THEN 0
          WHEN word_idx % 3 = 0 AND word_idx % 7 <> 0 THEN 2 * t - 1 ELSE 2 * t END AS label
      FROM (SELECT doc_id, word_idx, (doc_id + word_idx // 3) % 5 AS t FROM kept)),
  (VALUES (0), (1)) AS s(sub)
WHERE sub = 0 OR word_idx % 2 = 0
UNION ALL SELECT DISTINCT doc_id, 0, NULL, 0 FROM kept"""

CTES["labels_of_words"] = f"""
SELECT doc_id, word_idx, label_id, label
FROM (SELECT doc_id, word_idx, arg_min(label_id, token_idx) AS label_id FROM tokens
      WHERE token_idx < 512 AND word_idx IS NOT NULL AND label_id <> -100 GROUP BY ALL)
JOIN (VALUES {', '.join(f"({i}, '{n}')" for i, n in src.LABELS.items())}) AS d(label_id, label) USING (label_id)"""

CTES["segments"] = """
SELECT *, sum(starts) OVER (PARTITION BY doc_id, kind ORDER BY word_idx) AS seg
FROM (
  SELECT *, CASE WHEN label[1] = 'B' OR prev_idx IS DISTINCT FROM word_idx - 1
      OR prev_label[3:] IS DISTINCT FROM kind THEN 1 ELSE 0 END AS starts
  FROM (
    SELECT *, label[3:] AS kind, lag(word_idx) OVER w AS prev_idx, lag(label) OVER w AS prev_label
    FROM labels_of_words WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx))
  WHERE label <> 'O')
JOIN (SELECT doc_id, label[3:] AS kind, min(word_idx) AS first_b FROM labels_of_words
      WHERE label[1] = 'B' GROUP BY ALL) USING (doc_id, kind)
WHERE word_idx >= first_b"""

CTES["entities"] = r"""
SELECT doc_id, kind AS entity_type, regexp_replace(string_agg(text, ' ' ORDER BY word_idx), '^\s+|\s+$', '', 'g') AS text,
  count(*) AS n_words, min(x0) AS min_x0, min(y0) AS min_y0, max(x1) AS max_x1, max(y1) AS max_y1
FROM (SELECT * FROM segments
      QUALIFY seg = max(seg) OVER (PARTITION BY doc_id, kind))
JOIN (SELECT doc_id, word_idx, text, x0, y0, x1, y1 FROM kept) USING (doc_id, word_idx)
GROUP BY ALL"""

CTES["pages_text"] = """
SELECT doc_id, string_agg(text, ' ' ORDER BY word_idx) AS raw_text, count(*) AS n_words FROM kept GROUP BY ALL"""

CTES["model_records"] = r"""
SELECT doc_id, method, error_class, CASE WHEN error_class IS NULL THEN vendor END AS vendor,
  CASE WHEN error_class IS NULL THEN address END AS address, CASE WHEN error_class IS NULL THEN date END AS date,
  CASE WHEN error_class IS NULL THEN total_amount END AS total_amount,
  CASE WHEN error_class IS NULL THEN n_entities ELSE 0 END AS n_entities FROM (
SELECT d.doc_id, 'ml' AS method,
  max(e.text) FILTER (WHERE entity_type = 'COMPANY') AS vendor,
  max(e.text) FILTER (WHERE entity_type = 'ADDRESS') AS address,
  max(e.text) FILTER (WHERE entity_type = 'DATE') AS date,
  try_cast(regexp_replace(max(e.text) FILTER (WHERE entity_type = 'TOTAL'), '[^\d.]', '', 'g') AS double) AS total_amount,
  count(e.entity_type) AS n_entities,
  CASE WHEN d.doc_id % 50 = 7 AND d.doc_id IN (SELECT doc_id FROM kept) THEN 'zero_page_size' END AS error_class
FROM documents d LEFT JOIN entities e ON d.doc_id = e.doc_id GROUP BY d.doc_id)"""

CTES["variants"] = """
SELECT doc_id, 0 AS config_rank, '' AS config, text FROM documents
UNION ALL SELECT doc_id, 1, '--psm 3', replace(text, ',', '') FROM documents
UNION ALL SELECT doc_id, 2, '--psm 4', CASE WHEN doc_id % 3 = 0 THEN text || ' ~' ELSE text END FROM documents
UNION ALL SELECT doc_id, 3, '--psm 6', CASE WHEN doc_id % 4 = 1 THEN text || ' .' ELSE replace(text, 'e', 'E') END FROM documents
UNION ALL SELECT doc_id, 4, '--psm 11', CASE WHEN doc_id % 5 = 2 THEN text || '---' ELSE text END FROM documents
UNION ALL SELECT doc_id, 5, '--psm 12', replace(text, ' ', '') FROM documents"""

CTES["manifest"] = r"""
SELECT path, regexp_extract(name, '^(.*)\.[^.]*$', 1) AS stem, ext,
  CASE ext WHEN 'jpg' THEN 1 WHEN 'png' THEN 2 ELSE 3 END AS ext_rank, length, sha256
FROM (
  SELECT '/landing/' || name AS path, name, ext, strlen(text) AS length, sha256(text) AS sha256
  FROM (SELECT text, 'receipt' || cast((doc_id // 10) * 2 + doc_id % 2 AS varchar) || '.' || ext AS name, ext
        FROM (SELECT doc_id, text, ['jpg', 'png', 'jpeg', 'PNG', 'txt'][doc_id % 5 + 1] AS ext
              FROM documents WHERE doc_id % 9 <> 4)))
WHERE ext IN ('jpg', 'png', 'jpeg')"""


CTES["mixed_text"] = rf"""
SELECT corpus, doc_id, source, CASE WHEN {src.MONTH_FIRST_ROWS}
  THEN regexp_replace(text, '{src.SWAP[0]}', '{src.SWAP[1].replace("$", chr(92))}', 'g') ELSE text END AS text FROM invoices
UNION ALL SELECT 'documents', doc_id, source, text FROM documents"""

CTES["mixed_dates"] = r"""
SELECT corpus, doc_id, source, d, min(pat * 1000000 + ord) AS first_at FROM (
  SELECT corpus, doc_id, source, 1 AS pat, unnest(m) AS d, unnest(range(len(m))) AS ord
  FROM (SELECT corpus, doc_id, source, regexp_extract_all(text, '\d{2}[/-]\d{2}[/-]\d{4}') AS m FROM mixed_text)
  UNION ALL SELECT corpus, doc_id, source, 2, unnest(m), unnest(range(len(m)))
  FROM (SELECT corpus, doc_id, source, regexp_extract_all(text, '(\d{2}[/-]\d{2}[/-]\d{2})(?:\D|$)', 1) AS m FROM mixed_text)
  UNION ALL SELECT corpus, doc_id, source, 3, unnest(m), unnest(range(len(m)))
  FROM (SELECT corpus, doc_id, source, regexp_extract_all(text, '\d{4}[/-]\d{2}[/-]\d{2}') AS m FROM mixed_text))
GROUP BY ALL"""

CTES["order_votes"] = r"""
SELECT corpus, source, count(*) FILTER (WHERE a BETWEEN 13 AND 31 AND b BETWEEN 1 AND 12) AS day_votes,
  count(*) FILTER (WHERE b BETWEEN 13 AND 31 AND a BETWEEN 1 AND 12) AS month_votes
FROM (SELECT corpus, source, cast(d[1:2] AS int) AS a, cast(d[4:5] AS int) AS b FROM mixed_dates m
      WHERE NOT regexp_matches(d, '^\d{4}') AND NOT EXISTS (SELECT 1 FROM mixed_dates w
        WHERE w.corpus = m.corpus AND w.doc_id = m.doc_id AND regexp_matches(w.d, '^\d{4}') AND w.d[3:] = m.d))
GROUP BY ALL"""

CTES["corpus_votes"] = """
SELECT corpus, sum(day_votes) AS day_votes, sum(month_votes) AS month_votes FROM order_votes GROUP BY corpus"""

CTES["parsed_dates"] = r"""
SELECT corpus, doc_id, source, date, date_order,
  CASE date_order WHEN 'year_first' THEN try_cast(replace(whole, '/', '-') AS date)
    WHEN 'day_first' THEN try_cast(printf('%04d-%02d-%02d', y, b, a) AS date)
    WHEN 'month_first' THEN try_cast(printf('%04d-%02d-%02d', y, a, b) AS date) END AS date_parsed,
  CASE WHEN own IS NOT NULL THEN 'date' WHEN by_source IS NOT NULL THEN 'source' WHEN by_corpus IS NOT NULL THEN 'corpus' END AS decided_by
FROM (
  SELECT *, coalesce(own, by_source, by_corpus) AS date_order FROM (
    SELECT t.corpus, t.doc_id, t.source, f.d AS date, whole, a, b, y,
      CASE WHEN whole IS NOT NULL THEN 'year_first' WHEN a > 12 AND b BETWEEN 1 AND 12 THEN 'day_first'
        WHEN b > 12 AND a BETWEEN 1 AND 12 THEN 'month_first' WHEN a = b AND a BETWEEN 1 AND 12 THEN 'day_first' END AS own,
      CASE WHEN a BETWEEN 1 AND 12 AND b BETWEEN 1 AND 12 THEN CASE WHEN s.day_votes > s.month_votes THEN 'day_first'
        WHEN s.month_votes > s.day_votes THEN 'month_first' END END AS by_source,
      CASE WHEN a BETWEEN 1 AND 12 AND b BETWEEN 1 AND 12 THEN CASE WHEN c.day_votes > c.month_votes THEN 'day_first'
        WHEN c.month_votes > c.day_votes THEN 'month_first' END END AS by_corpus
    FROM mixed_text t LEFT JOIN (
      SELECT *, try_cast(d[1:2] AS int) AS a, try_cast(d[4:5] AS int) AS b,
        CASE WHEN length(d) = 8 AND cast(d[7:8] AS int) < 70 THEN 2000 + cast(d[7:8] AS int)
          WHEN length(d) = 8 THEN 1900 + cast(d[7:8] AS int) ELSE try_cast(d[7:10] AS int) END AS y
      FROM (SELECT m.corpus, m.doc_id, arg_min(m.d, m.first_at) AS d FROM mixed_dates m GROUP BY ALL) h
      LEFT JOIN (SELECT corpus, doc_id, d AS whole, d[3:] AS tail FROM mixed_dates WHERE regexp_matches(d, '^\d{4}')) w
        ON w.corpus = h.corpus AND w.doc_id = h.doc_id AND (w.tail = h.d OR w.whole = h.d)) f
      ON f.corpus = t.corpus AND f.doc_id = t.doc_id
    LEFT JOIN order_votes s ON s.corpus = t.corpus AND s.source = t.source
    LEFT JOIN corpus_votes c ON c.corpus = t.corpus))"""


CTES["image_headers"] = f"""
SELECT '/scans/' || doc_id || '.' || named AS path,
  CASE WHEN problem IN ('not_an_image', 'no_content') THEN 'none' ELSE named END AS kind,
  CASE WHEN problem IS NULL THEN {src.IMAGE_WIDTH} END AS width, CASE WHEN problem IS NULL THEN {src.IMAGE_HEIGHT} END AS height,
  CASE WHEN problem IS NULL THEN CASE named WHEN 'png' THEN CASE {src.IMAGE_COLOUR} WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 4 END
    ELSE {src.IMAGE_COMPONENTS} END END AS channels, problem, CASE WHEN problem IS NOT NULL THEN 'bad_image' END AS error_class
FROM (SELECT doc_id, named, CASE WHEN fault = 'not_an_image' AND coalesce(text, '') = '' THEN 'no_content'
    WHEN fault = 'bad_header' AND named = 'png' THEN 'bad_checksum'
    ELSE fault END AS problem
  FROM (SELECT *, {src.IMAGE_KIND} AS named, {src.IMAGE_FAULT} AS fault FROM documents))"""


def _needs(sql: str, seen: list[str]) -> list[str]:
    words = set("".join(ch if ch.isalnum() or ch == "_" else " " for ch in sql).split())
    for name in CTES:
        if name in words and name not in seen and CTES[name] is not sql:
            _needs(CTES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def oracle(name: str, sql: str) -> None:
    """Register a query; the CTEs it names are put in front of it."""
    used = [n for n in CTES if n in _needs(sql, [])]
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in used)
    ORACLE[name] = f"WITH {head}\n{sql}" if used else sql


# ---- Scans and sinks ---------------------------------------------------------------
oracle("scan_text", "SELECT doc_id, length(text) AS n_chars, md5(text) AS md5 FROM documents")
oracle("scan_image_manifest", "SELECT * FROM manifest")
oracle("first_sample", "SELECT * FROM manifest ORDER BY path LIMIT 1")
oracle("scan_image_checked", "SELECT * FROM image_headers")
oracle(
    "image_faults",
    """
SELECT kind, problem, count(*) AS files, sum(cast(width AS bigint) * height * channels) AS samples
FROM image_headers GROUP BY ALL""",
)
oracle("scan_ocr_words", "SELECT * FROM ocr")
oracle(
    "sink_json",
    """
SELECT corpus, doc_id, output_name, count(*) OVER (PARTITION BY output_name) > 1 AS duplicate_name, method,
  receipt_number, date, bill_to_name, n_items, total_amount, extraction_confidence, validation_passed,
  bill_to_name IS NULL AS null_kept
FROM (SELECT *, cast(doc_id % 20000 AS varchar) || '_rules.json' AS output_name FROM records)""",
)
oracle(
    "sink_json_files",
    """
SELECT doc_id, cast(doc_id // 3 AS varchar) || '_rules.json' AS output_name, receipt_number, date, bill_to_name,
  n_items, total_amount, extraction_confidence, true AS indented, bill_to_name IS NULL AS null_kept
FROM records WHERE corpus = 'documents'""",
)
oracle(
    "sink_export_named",
    """
SELECT corpus, doc_id, output_name, count(*) OVER (PARTITION BY output_name) > 1 AS duplicate_name, method,
  receipt_number, date, bill_to_name, n_items, total_amount, extraction_confidence, validation_passed,
  bill_to_name IS NULL AS null_kept, 'invoice_data_20240203_040506.json' AS export_name
FROM (SELECT *, cast(doc_id % 20000 AS varchar) || '_rules.json' AS output_name FROM records)""",
)
oracle(
    "word_quarantine",
    """
SELECT doc_id, row_no, CASE WHEN row_no % 97 <> 8 THEN text END AS text,
  CASE row_no % 97 WHEN 5 THEN 'no_confidence' WHEN 6 THEN 'bad_confidence' ELSE 'no_text' END AS error_class
FROM ocr WHERE row_no % 97 IN (5, 6, 8)""",
)
oracle(
    "confident_spoiled_words",
    """
SELECT doc_id, count(*) AS n_words FROM ocr
WHERE row_no % 97 NOT IN (5, 6, 8) AND (conf >= 61 OR row_no % 97 = 7) AND trim(text) <> ''
GROUP BY doc_id""",
)

# ---- OCR words -----------------------------------------------------------------------
oracle("filter_confident_words", "SELECT doc_id, row_no, word_idx, text, conf FROM kept")
oracle("word_boxes", "SELECT doc_id, word_idx, x0, y0, x1, y1 FROM kept")
oracle(
    "normalize_boxes",
    """
SELECT doc_id, word_idx,
  CASE WHEN w > 0 THEN cast(trunc(1000 * (x0 / w)) AS int) END AS x0,
  CASE WHEN w > 0 THEN cast(trunc(1000 * (y0 / h)) AS int) END AS y0,
  CASE WHEN w > 0 THEN cast(trunc(1000 * (x1 / w)) AS int) END AS x1,
  CASE WHEN w > 0 THEN cast(trunc(1000 * (y1 / h)) AS int) END AS y1,
  CASE WHEN w = 0 THEN 'zero_page_size' END AS error_class
FROM kept JOIN (
  SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 0.0::double ELSE 480.0::double END AS w,
    cast((len(string_split(text, ' ')) // 10 + 1) * 20 AS double) AS h FROM documents) USING (doc_id)""",
)
oracle("page_text", "SELECT doc_id, raw_text, n_words FROM pages_text")
oracle(
    "best_ocr_variant",
    """
SELECT doc_id, config_rank, config, length(text) AS n_chars, md5(text) AS md5 FROM variants
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, config_rank) = 1""",
)
oracle(
    "best_of_two_variants",
    """
SELECT doc_id, CASE WHEN length(b.text) > length(a.text) THEN b.config ELSE a.config END AS config,
  greatest(length(a.text), length(b.text)) AS n_chars
FROM (SELECT * FROM variants WHERE config_rank = 3) a
JOIN (SELECT * FROM variants WHERE config_rank = 4) b USING (doc_id)""",
)
oracle(
    "ocr_variant_lengths",
    """
SELECT config_rank, config, count(*) AS pages, round(avg(length(text)), 4) AS avg_chars,
  max(length(text)) AS max_chars FROM variants GROUP BY ALL""",
)

# ---- Text fields -----------------------------------------------------------------------
oracle(
    "extract_dates",
    """
SELECT t.corpus, t.doc_id, coalesce(string_agg(d, '|' ORDER BY pos), '') AS dates, count(d) AS n
FROM corpus_text t LEFT JOIN date_rows USING (corpus, doc_id) GROUP BY ALL""",
)
oracle("dedupe_stable", "SELECT corpus, doc_id, pos, d AS date_text FROM date_rows")
oracle(
    "first_date",
    """
SELECT t.corpus, t.doc_id, d AS date FROM corpus_text t
LEFT JOIN (SELECT * FROM date_rows WHERE pos = 0) USING (corpus, doc_id)""",
)
oracle(
    "extract_amounts",
    """
SELECT t.corpus, t.doc_id, count(amount) AS n, round(coalesce(sum(amount), 0), 2) AS sum_amounts, max(amount) AS max_amount
FROM corpus_text t LEFT JOIN amount_rows USING (corpus, doc_id) GROUP BY ALL""",
)
oracle(
    "explode_amounts",
    """
SELECT t.corpus, t.doc_id, pos, amount FROM corpus_text t LEFT JOIN amount_rows USING (corpus, doc_id)""",
)
oracle("extract_total", "SELECT * FROM totals")
oracle("extract_vendor", "SELECT * FROM vendors")
oracle("extract_receipt_number", "SELECT * FROM number_rows")
oracle(
    "extract_bill_to",
    "SELECT corpus, doc_id, bill_to_name AS name, bill_to_name IS NULL AS missing FROM bill_tos",
)
oracle(
    "email_in_bill_to",
    "SELECT corpus, doc_id, bill_to_email AS email FROM bill_tos",
)
oracle("item_section", "SELECT corpus, doc_id, line_no, line FROM section")
oracle(
    "item_line_numbers",
    "SELECT corpus, doc_id, line_no, array_to_string(numbers, '|') AS numbers FROM section",
)
oracle("item_quantity", "SELECT corpus, doc_id, line_no, quantity FROM section")
oracle("item_description", "SELECT corpus, doc_id, line_no, piece AS description FROM section")
oracle("extract_line_items", "SELECT * FROM item_rows")
oracle(
    "explode_line_items",
    """
SELECT corpus, doc_id, pos, description AS show_description, cast(quantity AS varchar) AS show_qty,
  printf('$%.2f', unit_price) AS show_unit_price, printf('$%.2f', total) AS show_total FROM item_rows""",
)
oracle(
    "structure_records",
    """
SELECT corpus, doc_id, method, receipt_number, date, bill_to_name, bill_to_email, n_items,
  round(items_total, 2) AS items_total, total_amount, md5(raw_text) AS raw_text_md5,
  extraction_confidence, validation_passed, vendor_rules FROM records""",
)
oracle(
    "quarantine",
    "SELECT corpus, doc_id, 'null_text' AS error_class FROM corpus_text WHERE text IS NULL",
)

# ---- Quality and display ------------------------------------------------------------------
oracle("extraction_confidence", "SELECT corpus, doc_id, extraction_confidence FROM records")
oracle("validate_total", "SELECT corpus, doc_id, validation_passed FROM records")
oracle("item_total_sum", "SELECT corpus, doc_id, round(items_total, 2) AS items_total FROM records")
oracle(
    "detect_format",
    """
SELECT corpus, doc_id, CASE WHEN retail THEN 'Template A (Retail)' ELSE 'Unknown Format' END AS name,
  CASE WHEN retail THEN 95.0::double ELSE 20.0::double END AS confidence, retail AS supported,
  CASE WHEN retail THEN 'Found ''SDN BHD'' suffix|Date format DD/MM/YYYY detected'
       ELSE 'No known company suffixes found' END AS indicators
FROM (SELECT *, coalesce(contains(text, 'SDN BHD'), false) AS retail FROM corpus_text)""",
)
oracle(
    "detect_format_templates",
    f"""
, numbers AS (SELECT unnest(range(97)) AS n), templates AS ({_dialect(src.TEMPLATES).replace("0D", "0")}),
found AS (SELECT t.corpus, t.doc_id, f.* FROM corpus_text t JOIN templates f ON contains(t.text, f.mark)
  QUALIFY row_number() OVER (PARTITION BY t.corpus, t.doc_id ORDER BY priority DESC, length(mark) DESC, mark) = 1)
SELECT t.corpus, t.doc_id, coalesce(f.name, 'Unknown Format') AS name, coalesce(f.confidence, 20.0) AS confidence,
  coalesce(f.supported, false) AS supported, f.mark, coalesce('Found ' || f.mark, 'No known company suffixes found') AS indicators
FROM corpus_text t LEFT JOIN found f ON f.corpus = t.corpus AND f.doc_id = t.doc_id""",
)
oracle(
    "format_recommendations",
    """
SELECT corpus, doc_id, CASE WHEN contains(text, 'SDN BHD') THEN '• Extraction should be highly accurate.'
  ELSE '• Results may be incomplete.|• Consider adding patterns for this format.' END AS recommendations
FROM corpus_text""",
)
CTES["shown"] = """
SELECT corpus, doc_id, method, coalesce(nullif(vendor, ''), 'N/A') AS show_vendor, coalesce(nullif(address, ''), 'N/A') AS show_address,
  coalesce(nullif(receipt_number, ''), 'N/A') AS show_receipt_number, coalesce(nullif(date, ''), 'N/A') AS show_date,
  coalesce(printf('$%.2f', total_amount), 'N/A') AS show_total, coalesce(bill_to_name, 'N/A') AS show_bill_to,
  CASE WHEN confidence >= 80 THEN 'High' WHEN confidence >= 50 THEN 'Medium' ELSE 'Low' END AS confidence_tier, passed AS validation_status
FROM (
  SELECT 'documents' AS corpus, doc_id, 'ml' AS method, vendor, address, NULL AS receipt_number, date, total_amount,
    NULL AS bill_to_name, 0 AS confidence, false AS passed
  FROM model_records WHERE doc_id % 101 <> 100 AND error_class IS NULL
  UNION ALL
  SELECT corpus, doc_id, 'rules', NULL, NULL, receipt_number, date, total_amount, bill_to_name, extraction_confidence, validation_passed
  FROM records WHERE corpus = 'invoices' AND doc_id % 101 <> 100)"""
oracle("display_both_methods", "SELECT * FROM shown")
oracle(
    "quality_of_both_methods",
    "SELECT method, confidence_tier, validation_status, count(*) AS documents FROM shown GROUP BY ALL",
)
oracle("confidence_tier", "SELECT corpus, doc_id, confidence_tier FROM rated")
oracle(
    "validation_status",
    "SELECT corpus, doc_id, validation_passed AS validation_status FROM records",
)
oracle(
    "display_defaults",
    """
SELECT corpus, doc_id, coalesce(vendor_rules, 'N/A') AS show_vendor, coalesce(receipt_number, 'N/A') AS show_receipt_number,
  coalesce(date, 'N/A') AS show_date, coalesce(printf('$%.2f', total_amount), 'N/A') AS show_total,
  coalesce(bill_to_name, 'N/A') AS show_bill_to FROM records""",
)

# ---- Token predictions and entities ----------------------------------------------------------
oracle("truncate_tokens", "SELECT * FROM tokens WHERE token_idx < 512")
oracle(
    "words_lost",
    """
SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE 2 * word_idx + 1 >= 512) AS words_lost
FROM kept GROUP BY ALL""",
)
oracle("word_labels", "SELECT doc_id, word_idx, label_id, label FROM labels_of_words")
oracle(
    "logits_to_label",
    "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS label_id FROM embeddings",
)
oracle("merge_entities", "SELECT * FROM entities")
oracle(
    "parse_entity_total",
    r"""
SELECT doc_id, entity_type, try_cast(regexp_replace(text, '[^\d.]', '', 'g') AS double) AS amount FROM entities""",
)
oracle(
    "entities_to_record",
    """
SELECT m.doc_id, method, vendor, address, date, total_amount, md5(coalesce(raw_text, '')) AS raw_text_md5,
  coalesce(n_words, 0) AS n_words, n_entities, cast(NULL AS int) AS extraction_confidence, error_class
FROM model_records m LEFT JOIN pages_text p USING (doc_id)""",
)
oracle(
    "dispatch_method",
    """
SELECT corpus, doc_id, 'auto' AS method, NULL AS date, NULL AS total_amount, NULL AS vendor,
  NULL AS receipt_number, 'unknown_method' AS error_class FROM corpus_text WHERE doc_id % 101 = 100
UNION ALL
SELECT 'documents', doc_id, 'ml', date, total_amount, vendor, NULL, error_class FROM model_records WHERE doc_id % 101 <> 100
UNION ALL
SELECT t.corpus, t.doc_id, 'rules', date, total_amount, NULL, receipt_number,
  CASE WHEN t.text IS NULL THEN 'null_text' END
FROM corpus_text t LEFT JOIN records USING (corpus, doc_id)
WHERE t.corpus = 'invoices' AND t.doc_id % 101 <> 100""",
)
oracle(
    "complete_from_rules",
    """
SELECT m.doc_id, r.receipt_number, coalesce(m.date, r.date) AS date,
  coalesce(m.total_amount, r.total_amount) AS total_amount, coalesce(m.vendor, r.vendor_rules) AS vendor, r.n_items
FROM model_records m JOIN records r ON r.corpus = 'documents' AND r.doc_id = m.doc_id""",
)

# ---- Reports -----------------------------------------------------------------------------------
oracle(
    "batch_summary",
    """
SELECT method, CASE WHEN error_class IS NULL THEN 'ok' ELSE 'failed' END AS status, error_class, count(*) AS documents
FROM (
  SELECT CASE WHEN doc_id % 101 = 100 THEN 'auto' WHEN corpus = 'documents' THEN 'ml' ELSE 'rules' END AS method,
    CASE WHEN doc_id % 101 = 100 THEN 'unknown_method' WHEN corpus = 'invoices' AND text IS NULL THEN 'null_text'
         ELSE m.error_class END AS error_class
  FROM corpus_text t LEFT JOIN (SELECT 'documents' AS corpus, doc_id, error_class FROM model_records) m
    USING (corpus, doc_id))
GROUP BY ALL""",
)
oracle(
    "unprocessed_docs",
    "SELECT corpus, doc_id FROM corpus_text EXCEPT SELECT corpus, doc_id FROM records",
)
oracle(
    "quality_report",
    """
SELECT confidence_tier, validation_passed AS validation_status, format_name, count(*) AS documents,
  round(avg(extraction_confidence), 4) AS avg_confidence FROM rated GROUP BY ALL""",
)
oracle(
    "date_parsed",
    """
SELECT *, CASE WHEN date IS NOT NULL AND date_parsed IS NULL THEN CASE WHEN date_order IS NULL AND
    cast(date[1:2] AS int) BETWEEN 1 AND 12 AND cast(date[4:5] AS int) BETWEEN 1 AND 12 THEN 'undecided_order'
  ELSE 'impossible_date' END END AS date_problem FROM parsed_dates""",
)
oracle(
    "date_votes",
    """
SELECT corpus, source, count(*) FILTER (WHERE decided_by = 'date') AS by_date,
  count(*) FILTER (WHERE decided_by = 'source') AS by_source, count(*) FILTER (WHERE date_parsed IS NULL) AS unread,
  min(date_parsed) AS first_day, max(date_parsed) AS last_day
FROM parsed_dates WHERE date IS NOT NULL GROUP BY ALL""",
)
oracle(
    "amount_statistics",
    """
, grouped AS MATERIALIZED (
  SELECT a.corpus, t.source, a.amount FROM amount_rows a JOIN corpus_text t USING (corpus, doc_id)
  UNION ALL SELECT corpus, '(all)', amount FROM amount_rows),
counted AS (SELECT corpus, source, amount, count(*) AS c FROM grouped GROUP BY ALL),
ranked AS (SELECT corpus, source, amount, row_number() OVER (PARTITION BY corpus, source ORDER BY amount) AS r,
  count(*) OVER (PARTITION BY corpus, source) AS n FROM grouped),
sizes AS (SELECT corpus, source, count(*) AS n, count(DISTINCT amount) AS n_distinct, min(amount) AS least,
  max(amount) AS most, round(cast(sum(cast(amount AS decimal(18, 6))) AS double), 2) AS total FROM grouped GROUP BY ALL),
tops AS (SELECT corpus, source, string_agg(printf('%.2f x %d', amount, c), ', ' ORDER BY c DESC, amount) AS common
  FROM (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY corpus, source ORDER BY c DESC, amount) <= 3) GROUP BY ALL),
quantiles AS (SELECT corpus, source, max(amount) FILTER (WHERE r = (n * 500 + 999) // 1000) AS p500,
  max(amount) FILTER (WHERE r = (n * 950 + 999) // 1000) AS p950 FROM ranked GROUP BY ALL)
SELECT * FROM sizes JOIN quantiles USING (corpus, source) JOIN tops USING (corpus, source)""",
)
oracle(
    "amount_heavy_hitters",
    """
SELECT corpus, place, amount AS value, n FROM (
  SELECT corpus, amount, count(*) AS n, row_number() OVER (PARTITION BY corpus ORDER BY count(*) DESC, amount) AS place
  FROM amount_rows GROUP BY corpus, amount) WHERE place <= 20""",
)
oracle(
    "quality_rollup",
    """
SELECT confidence_tier, validation_passed AS validation_status, format_name,
  grouping_id(confidence_tier, validation_passed, format_name) AS level, count(*) AS documents,
  round(avg(extraction_confidence), 4) AS avg_confidence, count(*) FILTER (WHERE total_amount IS NULL) AS without_total
FROM rated GROUP BY ROLLUP (confidence_tier, validation_passed, format_name)""",
)
oracle(
    "field_fill_rate",
    """
SELECT corpus, lang, source, count(*) AS documents,
  round(avg(cast(receipt_number IS NOT NULL AS int)), 6) AS receipt_number_rate,
  round(avg(cast(date IS NOT NULL AS int)), 6) AS date_rate,
  round(avg(cast(bill_to_name IS NOT NULL AS int)), 6) AS bill_to_rate,
  round(avg(cast(total_amount IS NOT NULL AS int)), 6) AS total_amount_rate,
  round(avg(cast(n_items > 0 AS int)), 6) AS items_rate
FROM records GROUP BY ALL""",
)
oracle(
    "field_accuracy",
    """
SELECT field, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1
FROM (
  SELECT field, count(*) FILTER (WHERE e = a) AS tp,
    count(*) FILTER (WHERE a IS NOT NULL AND e IS DISTINCT FROM a) AS fp,
    count(*) FILTER (WHERE e IS NOT NULL AND e IS DISTINCT FROM a) AS fn
  FROM (
    SELECT unnest(['receipt_number', 'date', 'total_amount', 'bill_to']) AS field,
      unnest([truth_number, truth_date, cast(truth_total AS varchar), truth_name]) AS e,
      unnest([receipt_number, date, cast(total_amount AS varchar), bill_to_name]) AS a
    FROM invoices i LEFT JOIN (SELECT * EXCLUDE (lang, source) FROM records) r USING (corpus, doc_id))
  GROUP BY field)""",
)

oracle(
    "expected_accuracy",
    """
SELECT field, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, records, missing_records, unexpected_records
FROM (
  SELECT field, count(*) FILTER (WHERE e = a) AS tp,
    count(*) FILTER (WHERE a IS NOT NULL AND e IS DISTINCT FROM a) AS fp,
    count(*) FILTER (WHERE e IS NOT NULL AND e IS DISTINCT FROM a) AS fn,
    count(*) FILTER (WHERE ek IS NOT NULL AND ak IS NOT NULL) AS records,
    count(*) FILTER (WHERE ak IS NULL) AS missing_records, count(*) FILTER (WHERE ek IS NULL) AS unexpected_records
  FROM (
    SELECT i.doc_id AS ek, r.doc_id AS ak,
      unnest(['receipt_number', 'date', 'total_amount', 'bill_to_name']) AS field,
      unnest([truth_number, truth_date, cast(truth_total AS varchar), truth_name]) AS e,
      unnest([receipt_number, date, cast(total_amount AS varchar), bill_to_name]) AS a
    FROM (SELECT * FROM invoices WHERE doc_id % 41 <> 0) i
    FULL JOIN (SELECT * EXCLUDE (lang, source) FROM records WHERE corpus = 'invoices') r ON r.doc_id = i.doc_id)
  GROUP BY field)""",
)

# ---- Streams -------------------------------------------------------------------------------------
oracle(
    "ingest_without_repeats",
    """
SELECT d.doc_id, 1 AS records, r.date FROM documents d
LEFT JOIN (SELECT * FROM records WHERE corpus = 'documents') r ON r.doc_id = d.doc_id""",
)
oracle(
    "incremental_ingest",
    """
SELECT t.doc_id, receipt_number, date, total_amount, n_items, extraction_confidence,
  coalesce(validation_passed, false) AS validation_passed, CASE WHEN t.text IS NULL THEN 'null_text' END AS error_class
FROM (SELECT * FROM corpus_text WHERE corpus = 'invoices') t LEFT JOIN records r USING (corpus, doc_id)""",
)
for _name in ("processed_per_day", "processed_per_day_stream"):
    oracle(_name, "SELECT date_trunc('day', ts) AS day, count(*) AS documents FROM events GROUP BY ALL")
for _name in ("processed_per_session", "processed_per_session_stream"):
    oracle(
        _name,
        """
SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 8 HOUR AS until, count(*) AS documents
FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 8 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events))
GROUP BY user_id, island""",
    )
oracle(
    "unprocessed_docs_stream",
    """
SELECT doc_id, epoch_ms((doc_id + 1704067200) * 1000) AS uploaded
FROM documents WHERE doc_id % 7 = 0 OR doc_id * 37 % 80 > 60""",
)
# Documents without a third version keep their second one, which is their first line.
_cut = "CASE WHEN doc_id % 5 = 0 THEN string_split(text, chr(10))[1] ELSE text END"
oracle(
    "corrected_uploads",
    """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 3 END AS version, receipt_number, date, total_amount, n_items
FROM records WHERE corpus = 'documents'""",
)
_whole = "UNION ALL SELECT doc_id, 'documents', lang, source, text FROM documents"
if _whole not in ORACLE["corrected_uploads"]:
    raise ValueError("the corpus is written in another way")
ORACLE["corrected_uploads"] = ORACLE["corrected_uploads"].replace(_whole, _whole.replace("source, text", f"source, {_cut}"))
