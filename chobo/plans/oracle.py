"""DuckDB forms of the audit domain: the same questions asked of flat tables, for comparison with the operators."""

from __future__ import annotations

from chobo.plans import adapter as A


def digit_of(number: str) -> str:
    """Check digit of T and 13 digits, from its last twelve."""
    return "9 - ((" + " + ".join(f"CAST(substr({number}, {14 - i}, 1) AS INT) * {1 + i % 2}" for i in range(12)) + ") % 9)"


def valid(number: str) -> str:
    return f"CAST(substr({number}, 2, 1) AS INT) = {digit_of(number)}"


def status(day: str) -> str:
    return f"CASE WHEN r.reg_no IS NULL THEN 'not_found' WHEN r.registered <> '' AND {day} < r.registered THEN 'not_yet_registered' WHEN r.revoked <> '' AND {day} >= r.revoked THEN 'revoked' WHEN r.expired <> '' AND {day} >= r.expired THEN 'expired' ELSE 'valid' END"


def core(name: str) -> str:
    return f"replace(replace(replace({name}, '株式会社', ''), '有限会社', ''), '合同会社', '')"


def match(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 'exact' WHEN {core(a)} = {core(b)} THEN 'same_core' ELSE 'different' END"


CTES = A.duck(f"""company AS ({A.COMPANY}), registry AS ({A.REGISTRY}), item AS ({A.ITEM}), head AS ({A.NUMBERED_HEAD}), total AS ({A.TOTAL}),
n AS (SELECT h.id, count(i.id) AS n_items FROM head h LEFT JOIN item i ON h.id = i.id GROUP BY h.id),
grand AS (SELECT h.id, CAST(coalesce(sum(t.subtotal), 0) + CASE WHEN h.included THEN 0 ELSE coalesce(sum(t.tax), 0) END AS BIGINT) AS grand_total FROM head h LEFT JOIN total t ON h.id = t.id GROUP BY h.id, h.included),
stated AS (SELECT t.*, h.included, t.subtotal * t.rate AS num, CASE WHEN h.included THEN 100 + t.rate ELSE 100 END AS den FROM total t JOIN head h ON t.id = h.id),
explained AS (SELECT id, bool_and(tax = num // den) AS floor, bool_and(tax = (2 * num + den) // (2 * den)) AS half_up, bool_and(tax = (num + den - 1) // den) AS ceil,
  bool_or(tax NOT IN (num // den, (2 * num + den) // (2 * den), (num + den - 1) // den)) AS mismatch FROM stated GROUP BY id)""")


def verdicts(fault: str) -> str:
    """id, f, first_level, reasons of documents as read; ``fault`` is the number of what is wrong with the reading, in SQL."""
    digit = "CASE WHEN substr(h.reg_no, 14, 1) = '9' THEN '5' ELSE CAST(CAST(substr(h.reg_no, 14, 1) AS INT) + 1 AS VARCHAR) END"
    return f"""read AS (SELECT h.*, n.n_items, {fault} AS f FROM head h JOIN n ON h.id = n.id),
doc AS (SELECT h.*, CASE WHEN f = 6 THEN substr(h.reg_no, 1, 13) || {digit} ELSE h.reg_no END AS number, CASE WHEN f = 2 THEN CAST(CAST(CAST(issue_date AS DATE) + 1 AS DATE) AS VARCHAR) ELSE issue_date END AS day FROM read h),
looked AS (SELECT d.*, {status('d.day')} AS registry_status, CASE WHEN r.reg_no IS NULL THEN 'no_record' ELSE {match('d.issuer_name', 'r.name')} END AS name_match FROM doc d LEFT JOIN registry r ON d.number = r.reg_no),
parts AS (SELECT l.id, l.f, l.issue, l.template, registry_status, name_match,
  CASE WHEN f IN (0, 5) THEN 'schema:not_an_object' ELSE concat_ws('|', CASE WHEN f = 10 THEN 'schema:tax_included_missing' END, CASE WHEN f = 7 THEN 'schema:grand_total_missing' END, CASE WHEN n_items = 0 THEN 'schema:items_missing|schema:totals_missing' END) END AS s,
  CASE WHEN NOT ({valid('number')}) THEN 'check_digit:invalid' END AS c, CASE WHEN registry_status <> 'valid' THEN 'registry:' || registry_status END AS r,
  CASE WHEN name_match NOT IN ('exact', 'same_core') THEN 'name:' || name_match END AS m,
  nullif(concat_ws('|', CASE WHEN f = 4 THEN 'tax:line_amount_mismatch' END, CASE WHEN f = 4 THEN 'tax:subtotal_mismatch' END, CASE WHEN e.mismatch THEN 'tax:tax_mismatch' END, CASE WHEN f = 1 THEN 'tax:total_mismatch' END), '') AS t
  FROM looked l LEFT JOIN explained e ON l.id = e.id),
verdict AS (SELECT id, f, issue, template, CASE WHEN s <> '' THEN s ELSE concat_ws('|', c, r, m, t) END AS reasons,
  CASE WHEN s <> '' THEN 1 WHEN c IS NOT NULL THEN 2 WHEN r IS NOT NULL THEN 3 WHEN m IS NOT NULL THEN 4 WHEN t IS NOT NULL THEN 5 ELSE 6 END AS first_level,
  CASE WHEN s = '' THEN registry_status END AS registry_status, CASE WHEN s = '' THEN name_match END AS name_match FROM parts)"""


#: id and what of the prediction is right, from what is known to be wrong with it.
SCORE = """score AS (SELECT h.id, h.issue, h.template, h.layout, h.seal_overlap, h.id % 17 AS f, n_items,
  h.id % 17 NOT IN (0, 5) AS read_at_all, h.id % 17 NOT IN (0, 5) AS issuer_name, h.id % 17 NOT IN (0, 5, 6) AS registration_number, h.id % 17 NOT IN (0, 5, 2) AS issue_date,
  h.id % 17 NOT IN (0, 5, 3) AS recipient_name, h.id % 17 NOT IN (0, 5) AS invoice_number, h.id % 17 NOT IN (0, 5) AS tax_included, h.id % 17 NOT IN (0, 5, 1) AS grand_total,
  n_items = 0 OR h.id % 17 NOT IN (0, 5, 4) AS items, n_items = 0 OR h.id % 17 NOT IN (0, 5) AS totals,
  CASE WHEN h.id % 17 IN (0, 5) THEN 0 WHEN h.id % 17 = 4 AND n_items > 0 THEN n_items - 1 ELSE n_items END AS items_correct
  FROM head h JOIN n ON h.id = n.id),
scored AS (SELECT *, issuer_name AND registration_number AND issue_date AND recipient_name AND invoice_number AND tax_included AND grand_total AND items AND totals AS exact,
  issuer_name AND registration_number AND tax_included AND grand_total AND totals AND (items OR f NOT IN (0, 5, 4)) AS covered_exact,
  recipient_name AND invoice_number AND issue_date AND (n_items = 0 OR f NOT IN (0, 5)) AS uncovered_exact FROM score)"""
