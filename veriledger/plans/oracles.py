"""DuckDB SQL with the rows of the queries, written on its own from the operators' definitions."""

from __future__ import annotations

from veriledger.functions.text import CURRENCIES
from veriledger.operators.decision import FIELD_KINDS, PRICED_RULES, RULE_KINDS, UNVERIFIABLE
from veriledger.operators.reporting import AMOUNT_KINDS, ANOMALIES, BLIND, BLIND_NOTE, FIELD_ANOMALY, FOUND, HOLD_SUBTITLES, ICONS, KINDS, LONE, LONGEST, MATCH_VERDICTS, OVERCHARGED, SHORTENED, SIGNS, SUBTITLES, TITLES, TO_DO
from veriledger.operators.rules import MESSAGES
from veriledger.plans.queries import EXTRA_ORD, FIELD_ORD, HEAD_ORD, MISSING_ORD, MOST_ITEMS, RATES, RULES
from veriledger.plans.views import with_views

ORACLES: dict[str, str] = {}


def put(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views) if views else sql.strip()


def case(column: str, names: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ---- scalar functions

NAMES = """names AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN
  ['Ttnet A.Ş.', 'TTNET ANONIM ŞIRKETI', 'Sarıtekeli Market', 'Öz Ltd. Şti.', 'Gübre San. Tic.'][(s_suppkey // 2) % 5 + 1] ELSE s_name END AS name FROM supplier)"""
LEGAL = "(a\\.?ş\\.?|ltd\\.?|şt[iı]\\.?|san\\.?|t[iı]c\\.?|ve|a\\.?s\\.?|anon[iı]m|l[iı]m[iı]ted|ş[iı]rket[iı]|s[iı]rket[iı])"
FOLD = "lower(translate({0}, 'İIŞĞÜÖÇ', 'iışğüöç'))"


def name_key(c: str) -> str:
    return f"trim(regexp_replace(array_to_string(list_filter(string_split({FOLD.format(c)}, ' '), lambda x: NOT regexp_full_match(x, '{LEGAL}')), ' '), '[^0-9a-zçğıöşü]+', ' ', 'g'))"


def number_key(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^0-9a-zçğıöşü]+', '', 'g')"


def number_core(c: str) -> str:
    return f"ltrim(regexp_replace({c}, '[^0-9]', '', 'g'), '0')"


def vkn(x: str) -> str:
    moved = [f"((substr({x}, {i + 1}, 1)::INT + {9 - i}) % 10)" for i in range(9)]
    part = [f"(CASE WHEN {m} = 0 THEN 0 WHEN ({m} * {2 ** (9 - i)}) % 9 = 0 THEN 9 ELSE ({m} * {2 ** (9 - i)}) % 9 END)" for i, m in enumerate(moved)]
    return f"(substr({x}, 10, 1)::INT = (10 - ({' + '.join(part)}) % 10) % 10)"


def tckn(x: str) -> str:
    digit = lambda i: f"substr({x}, {i + 1}, 1)::INT"
    odd, even = "(" + " + ".join(map(digit, range(0, 9, 2))) + ")", "(" + " + ".join(map(digit, range(1, 9, 2))) + ")"
    return f"(substr({x}, 1, 1) <> '0' AND {digit(9)} = (({odd} * 7 - {even}) % 10 + 10) % 10 AND {digit(10)} = ({odd} + {even} + {digit(9)}) % 10)"


TAX = f"""bare AS (SELECT suppkey, name, tax_id, regexp_replace(tax_id, '[ ./_-]', '', 'g') AS b, regexp_extract(tax_id, '(^|[^0-9])([0-9]{{10,11}})([^0-9]|$)', 2) AS inside FROM tax_ids),
judged AS (SELECT suppkey, name, tax_id, CASE WHEN regexp_full_match(b, '[0-9]+') THEN b END AS norm, inside,
  NOT regexp_full_match(b, '[0-9]+') AND inside <> '' AND contains(trim(tax_id), ' ') AS labelled FROM bare),
tax AS (SELECT suppkey, name, tax_id, CASE WHEN labelled THEN 'label_captured' WHEN norm IS NULL THEN 'not_numeric' WHEN length(norm) = 10 THEN 'vkn' WHEN length(norm) = 11 THEN 'tckn' ELSE 'unknown_length' END AS kind,
  CASE WHEN labelled THEN inside ELSE norm END AS normalized, CASE WHEN length(norm) = 10 THEN {vkn("norm")} WHEN length(norm) = 11 THEN {tckn("norm")} END AS valid FROM judged)"""

put("FN-01_name", f"WITH {NAMES} SELECT id, {name_key('name')} AS name_key FROM names")
_NUMBERS = "(SELECT row_id AS id, doc_number, supplier FROM ledger UNION ALL SELECT doc_id, doc_number, supplier FROM incoming)"
put("FN-02_doc_number", f"SELECT id, {number_key('doc_number')} AS number_key FROM {_NUMBERS}", "incoming")
put("FN-03_number_core", f"SELECT id, {number_core('doc_number')} AS number_core FROM {_NUMBERS}", "incoming")
put("FN-04_supplier_key", f"SELECT suppkey, CASE WHEN suppkey % 3 <> 0 AND regexp_replace(tax_id, '[^0-9]', '', 'g') <> '' THEN regexp_replace(tax_id, '[^0-9]', '', 'g') ELSE {name_key('name')} END AS supplier_key FROM tax_ids", "tax_ids")
put("FN-05_identity_key", f"SELECT id, supplier || '|' || {number_key('doc_number')} AS identity_key FROM {_NUMBERS}", "incoming")
put("FN-06_amount_key", "SELECT o_orderkey, CAST(sign(o_totalprice) * floor(abs(o_totalprice) * 100 + 0.5) AS BIGINT) AS amount_key FROM orders")
put("FN-07_as_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS issue_date FROM orders")
put("FN-08_to_number", """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE CAST(((CASE WHEN event_id % 3 = 0 THEN '1' ELSE '' END || CAST(event_id % 1000 AS VARCHAR) || '.5')::DOUBLE * 10) AS BIGINT) END AS tenths,
  NOT (event_id % 7 = 0 OR event_id % 11 = 0) AS is_numeric FROM events""")
put("FN-09_normalize_tax_id", "SELECT suppkey, CASE WHEN regexp_full_match(regexp_replace(tax_id, '[ ./_-]', '', 'g'), '[0-9]+') THEN regexp_replace(tax_id, '[ ./_-]', '', 'g') END AS normalized FROM tax_ids", "tax_ids")
put("FN-10_vkn", f"SELECT o_orderkey, {vkn('x')} AS valid FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS x FROM orders)")
put("FN-11_tckn", f"SELECT o_orderkey, {tckn('x')} AS valid FROM (SELECT o_orderkey, CAST(o_orderkey * 7919 % 90000000000 + 10000000000 AS VARCHAR) AS x FROM orders)")
put("FN-12_classify_tax_id", f"WITH {TAX} SELECT suppkey, kind, normalized, valid FROM tax", "tax_ids")
put("FN-13_currency", f"SELECT doc_id, {case('c', CURRENCIES, 'c')} AS currency FROM (SELECT doc_id, trim(upper(coalesce(currency, 'euro'))) AS c FROM inv_docs)", "inv_docs")
put("FN-14_vendor", f"WITH {NAMES} SELECT id, translate(trim(lower(name)), 'ğĞşŞıİöÖüÜçÇ', 'gGsSiIoOuUcC') AS vendor FROM names")
put("FN-15_text", "SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS normal FROM documents")
put("FN-17_numeric_close", "SELECT i.doc_id, i.pos, abs(p.price_k - i.price_k) / greatest(abs(p.price_k), abs(i.price_k), 1e-9) <= 0.02 AS close FROM po_items p JOIN inv_items i ON p.doc_id = i.doc_id AND p.pos = i.pos", "po_items")
put("FN-18_money", "SELECT l_orderkey, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS money FROM lineitem GROUP BY l_orderkey")
put("FN-19_turkish_money", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || translate(format('{:,}', k // 100), ',', '.') || ',' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || ' TL' AS money
  FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS k FROM orders)""")
put("FN-20_stray_escapes", "SELECT event_id, props AS text FROM events")
put("FN-21_parse_response", "SELECT event_id AS doc_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
FLAT = """flat AS (SELECT doc_id, unnest(['number', 'date', 'party', 'tax_id', 'currency', 'subtotal', 'tax_amount', 'total_amount']) AS path,
  unnest([number, date_text, party, tax_id, currency, CAST(sub_k AS VARCHAR), CAST(tax_k AS VARCHAR), CAST(amount_k AS VARCHAR)]) AS value FROM inv_docs
  UNION ALL SELECT doc_id, 'items[' || CAST(pos AS VARCHAR) || '].' || f, v FROM (SELECT doc_id, pos, unnest(['sku', 'quantity', 'unit_price', 'discount', 'total']) AS f,
    unnest([sku, CAST(qty AS VARCHAR), CAST(price_k AS VARCHAR), CAST(disc_k AS VARCHAR), CAST(total_k AS VARCHAR)]) AS v FROM inv_items))"""
put("FN-22_flatten", f"WITH {FLAT} SELECT doc_id, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM flat WHERE value IS NOT NULL GROUP BY doc_id", "inv_docs")
put("FN-23_markdown", r"SELECT p_partkey, regexp_replace(p_brand || '_*[' || p_type || '`', '([_*`\[])', '\\\1', 'g') AS text FROM part")
put("FN-24_days_between", "SELECT o_orderkey, CAST(sum(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey")
put("FN-25_round2", "SELECT p_partkey, CAST(floor(p_retailprice * 0.18::DOUBLE * 100 + 0.5) AS BIGINT) AS tax_k FROM part")

# ---- rules

TYPE = lambda i, p, r: f"CASE doc_type WHEN 'po' THEN '{p}' WHEN 'receipt' THEN '{r}' ELSE '{i}' END"
ISSUES = f"""{TAX}, sums AS (SELECT doc_id, CAST(sum(total_k) AS BIGINT) AS s FROM inv_items GROUP BY doc_id),
dd AS (SELECT d.*, coalesce(s, 0) AS lines_k, t.kind, t.normalized, t.valid FROM inv_docs d LEFT JOIN sums USING (doc_id) LEFT JOIN (SELECT DISTINCT tax_id, kind, normalized, valid FROM tax) t ON t.tax_id = d.tax_id),
il AS (SELECT i.*, d.doc_type, qty * price_k - CASE WHEN d.doc_type = 'invoice' THEN disc_k ELSE 0 END AS want FROM inv_items i JOIN inv_docs d USING (doc_id)),
issues AS (
  SELECT doc_id, doc_type, 'required_field_missing' AS rule, {TYPE("invoice_number", "po_number", "receipt_number")} AS field, 'critical' AS severity, NULL::BIGINT AS expected_k, NULL::BIGINT AS actual_k, NULL::VARCHAR AS detail FROM dd WHERE coalesce(number, '') = ''
  UNION ALL SELECT doc_id, doc_type, 'required_field_missing', 'date', 'critical', NULL, NULL, NULL FROM dd WHERE coalesce(date_text, '') = ''
  UNION ALL SELECT doc_id, doc_type, 'required_field_missing', {TYPE("vendor_name", "supplier_name", "store_name")}, 'critical', NULL, NULL, NULL FROM dd WHERE coalesce(party, '') = ''
  UNION ALL SELECT doc_id, doc_type, 'required_field_missing', 'items', 'critical', NULL, NULL, NULL FROM dd WHERE n_items = 0
  UNION ALL SELECT doc_id, doc_type, 'required_field_missing', 'total_amount', 'critical', NULL, NULL, NULL FROM dd WHERE amount_k IS NULL AND amount_text IS NULL
  UNION ALL SELECT doc_id, doc_type, r, f, 'warning', NULL, NULL, date_text FROM (SELECT doc_id, doc_type, f, date_text, CASE WHEN NOT regexp_full_match(date_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date_format_invalid'
    WHEN try_strptime(date_text, '%Y-%m-%d') IS NULL THEN 'date_invalid' WHEN year(try_strptime(date_text, '%Y-%m-%d')) NOT BETWEEN 2000 AND 2030 THEN 'date_implausible' END AS r FROM (SELECT doc_id, doc_type, unnest(['date', 'due_date', 'delivery_date']) AS f, unnest([date_text, due_text, delivery_text]) AS date_text FROM dd) WHERE date_text IS NOT NULL) WHERE r IS NOT NULL
  UNION ALL SELECT doc_id, doc_type, 'numeric_invalid', f, 'warning', NULL, NULL, trim(v) FROM (SELECT doc_id, doc_type, unnest(['tax_amount', 'total_amount', 'change_amount']) AS f, unnest([tax_text, amount_text, change_text]) AS v FROM dd) WHERE v IS NOT NULL
  UNION ALL SELECT doc_id, doc_type, 'negative_amount', f, 'warning', NULL, v, NULL FROM (SELECT doc_id, doc_type, unnest(['subtotal', 'tax_amount', 'total_amount', 'change_amount']) AS f, unnest([sub_k, tax_k, amount_k, change_k]) AS v FROM dd) WHERE v < 0
  UNION ALL SELECT doc_id, doc_type, 'item_total_mismatch', 'items[' || CAST(pos AS VARCHAR) || '].total', 'critical', want, total_k, NULL FROM il WHERE abs(want - total_k) > 2
  UNION ALL SELECT doc_id, doc_type, 'negative_discount', 'items[' || CAST(pos AS VARCHAR) || '].discount', 'warning', NULL, disc_k, NULL FROM il WHERE doc_type = 'invoice' AND disc_k < 0
  UNION ALL SELECT doc_id, doc_type, 'subtotal_mismatch', 'subtotal', 'critical', lines_k, sub_k, NULL FROM dd WHERE doc_type <> 'po' AND n_items > 0 AND abs(lines_k - sub_k) > 2
  UNION ALL SELECT doc_id, doc_type, 'total_mismatch', 'total_amount', 'critical', sub_k + tax_k, amount_k, NULL FROM dd WHERE doc_type <> 'po' AND abs(sub_k + tax_k - amount_k) > 2
  UNION ALL SELECT doc_id, doc_type, 'total_mismatch', 'total_amount', 'critical', lines_k, amount_k, NULL FROM dd WHERE doc_type = 'po' AND n_items > 0 AND abs(lines_k - amount_k) > 2
  UNION ALL SELECT doc_id, doc_type, 'tax_rate_implausible', 'tax_amount', 'warning', NULL, NULL, NULL FROM dd WHERE sub_k > 0 AND tax_k <> 0 AND tax_k * 2 > sub_k
  UNION ALL SELECT doc_id, doc_type, 'too_many_items', 'items', 'info', NULL, n_items, NULL FROM dd WHERE n_items > {MOST_ITEMS}
  UNION ALL SELECT doc_id, doc_type, 'total_implausible', 'total_amount', 'warning', NULL, amount_k, NULL FROM dd WHERE amount_k > 1000000000
  UNION ALL SELECT doc_id, doc_type, 'seller_tax_id_missing', 'vendor_tax_id', 'warning', NULL, NULL, NULL FROM dd WHERE doc_type = 'invoice' AND currency = 'TRY' AND coalesce(trim(tax_id), '') = ''
  UNION ALL SELECT doc_id, doc_type, CASE WHEN kind = 'label_captured' THEN 'tax_id_label_captured' WHEN valid IS NULL THEN 'tax_id_unverifiable' ELSE 'tax_id_checksum_invalid' END, {TYPE("vendor_tax_id", "supplier_tax_id", "store_tax_id")},
    CASE WHEN kind = 'label_captured' THEN 'warning' WHEN valid IS NULL THEN 'info' ELSE 'critical' END, NULL, NULL, CASE WHEN kind = 'label_captured' THEN normalized ELSE tax_id END FROM dd WHERE coalesce(trim(tax_id), '') <> '' AND valid IS DISTINCT FROM TRUE
  UNION ALL SELECT d.doc_id, d.doc_type, CASE WHEN t.kind = 'label_captured' THEN 'tax_id_label_captured' WHEN t.valid IS NULL THEN 'tax_id_unverifiable' ELSE 'tax_id_checksum_invalid' END, 'buyer_tax_id',
    CASE WHEN t.kind = 'label_captured' THEN 'warning' WHEN t.valid IS NULL THEN 'info' ELSE 'critical' END, NULL, NULL, CASE WHEN t.kind = 'label_captured' THEN t.normalized ELSE d.buyer_tax_id END FROM inv_docs d JOIN (SELECT DISTINCT tax_id, kind, normalized, valid FROM tax) t ON t.tax_id = d.buyer_tax_id WHERE trim(d.buyer_tax_id) <> '' AND t.valid IS DISTINCT FROM TRUE)"""


def put_issues(name: str, sql: str) -> None:
    put(name, f"WITH {ISSUES} " + sql, "inv_docs")


for _name, _rules in RULES.items():
    _kinds = [r for r in _rules if r in ("invoice", "po", "receipt")]
    _only = f" AND doc_type IN {listed(_kinds)}" if _kinds else ""
    put_issues(_name, f"SELECT doc_id, rule, field, severity, expected_k, actual_k FROM issues WHERE rule IN {listed(_rules)}{_only}")
put("RL-03_numeric", f"WITH {ISSUES} SELECT i.doc_id, rule, field, CASE WHEN rule = 'numeric_invalid' THEN CASE field WHEN 'tax_amount' THEN tax_text WHEN 'total_amount' THEN amount_text ELSE change_text END END AS detail, actual_k FROM issues i JOIN inv_docs d ON i.doc_id = d.doc_id WHERE rule IN ('numeric_invalid', 'negative_amount')", "inv_docs")
SEV = """rep AS (SELECT d.doc_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM inv_docs d LEFT JOIN issues i ON d.doc_id = i.doc_id GROUP BY d.doc_id),
report AS (SELECT *, critical = 0 AS valid, greatest(100 - 20 * critical - 5 * warning - info, 0)::DOUBLE / 100.0::DOUBLE AS score FROM rep)"""
put("RL-15_report", f"WITH {ISSUES}, {SEV} SELECT doc_id, critical, warning, info, valid, score FROM report", "inv_docs")
put_issues("RL-16_correctable", "SELECT rule, count(*) AS n, rule <> 'tax_id_checksum_invalid' AS correctable FROM issues GROUP BY rule")
put("RL-22_rules_only", f"WITH {ISSUES}, {SEV} SELECT doc_id, CASE WHEN NOT valid THEN 'REJECT' WHEN warning > 0 THEN 'CAUTION' ELSE 'ACCEPT' END AS decision, score FROM report", "inv_docs")
GROUND = f"""g AS (SELECT d.*, coalesce(s, 0) AS lines_k, CASE WHEN d.doc_id % 31 = 0 THEN 'de' WHEN d.doc_id % 3 = 0 THEN 'tr' WHEN d.doc_id % 3 = 1 THEN 'en' ELSE 'mixed' END AS language
  FROM inv_docs d LEFT JOIN (SELECT doc_id, CAST(sum(total_k) AS BIGINT) AS s FROM inv_items GROUP BY doc_id) USING (doc_id)),
missing AS (SELECT doc_id, 'missing:' || {TYPE("invoice_number", "po_number", "receipt_number")} AS error FROM g WHERE coalesce(number, '') = '' UNION ALL SELECT doc_id, 'missing:date' FROM g WHERE coalesce(date_text, '') = ''
  UNION ALL SELECT doc_id, 'missing:party' FROM g WHERE coalesce(party, '') = '' UNION ALL SELECT doc_id, 'missing:currency' FROM g WHERE coalesce(currency, '') = '' UNION ALL SELECT doc_id, 'missing:total_amount' FROM g WHERE amount_k IS NULL),
w AS (SELECT * FROM g WHERE doc_id NOT IN (SELECT doc_id FROM missing)), wi AS (SELECT * FROM inv_items WHERE doc_id IN (SELECT doc_id FROM w)),
errors AS (SELECT * FROM missing
  UNION ALL SELECT doc_id, 'date:format' FROM w WHERE NOT regexp_full_match(date_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
  UNION ALL SELECT doc_id, 'date:value' FROM w WHERE regexp_full_match(date_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(date_text, '%Y-%m-%d') IS NULL
  UNION ALL SELECT doc_id, 'tax_id:format' FROM w WHERE doc_type = 'invoice' AND tax_id <> '' AND NOT regexp_full_match(tax_id, '[0-9]{{10}}')
  UNION ALL SELECT doc_id, 'currency:unknown' FROM w WHERE currency NOT IN ('TRY', 'USD', 'EUR') UNION ALL SELECT doc_id, 'language:unknown' FROM w WHERE language = 'de'
  UNION ALL SELECT doc_id, 'total_amount:positive' FROM w WHERE amount_k <= 0 UNION ALL SELECT doc_id, 'items:empty' FROM w WHERE n_items = 0
  UNION ALL SELECT doc_id, 'item ' || CAST(pos AS VARCHAR) || ':quantity' FROM wi WHERE qty <= 0 UNION ALL SELECT doc_id, 'item ' || CAST(pos AS VARCHAR) || ':unit_price' FROM wi WHERE price_k <= 0
  UNION ALL SELECT doc_id, 'item ' || CAST(pos AS VARCHAR) || ':total' FROM wi WHERE abs(qty * price_k - total_k) > 2
  UNION ALL SELECT doc_id, 'math:total' FROM w WHERE doc_type <> 'po' AND abs(sub_k + tax_k - amount_k) > 2 UNION ALL SELECT doc_id, 'math:subtotal' FROM w WHERE doc_type <> 'po' AND n_items > 0 AND abs(lines_k - sub_k) > 2
  UNION ALL SELECT doc_id, 'math:po_total' FROM w WHERE doc_type = 'po' AND n_items > 0 AND abs(lines_k - amount_k) > 2),
ok AS (SELECT g.*, doc_id NOT IN (SELECT doc_id FROM errors) AS ok FROM g)"""
for _name, _pattern in (("RL-17_gt_fields", "^(missing|date|tax_id|currency|language|total_amount)"), ("RL-18_gt_items", "^item"), ("RL-19_gt_math", "^math")):
    put(_name, f"WITH {GROUND} SELECT doc_id, error FROM errors WHERE regexp_matches(error, '{_pattern}')", "inv_docs")
put("RL-20_batch_validate", f"WITH {GROUND} SELECT doc_type, count(*) AS total_docs, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM ok GROUP BY doc_type", "inv_docs")
put("RL-21_quality_report", f"WITH {GROUND} SELECT language, count(*) AS n, CAST((count(*) * 2000 + (SELECT count(*) FROM ok)) // (2 * (SELECT count(*) FROM ok)) AS BIGINT) AS per_mille, CASE WHEN (SELECT bool_and(ok) FROM ok) THEN 'READY FOR TRAINING' ELSE 'NEEDS REVIEW' END AS status FROM ok GROUP BY language", "inv_docs")
LLM = """st AS (SELECT doc_id, k, CASE WHEN doc_id % (k * 2) = 0 THEN 'hallucination' WHEN doc_id % (k * 3) = 0 THEN 'error' ELSE 'missing' END AS status FROM inv_docs, (SELECT unnest([4, 9]) AS k) WHERE doc_id % k = 0 AND doc_id % 10 <> 7),
llm AS (SELECT d.doc_id, (d.doc_id % 5)::DOUBLE / 4.0::DOUBLE AS confidence, count(*) FILTER (status = 'hallucination') AS h, count(*) FILTER (status = 'error') AS e, count(status) AS a FROM inv_docs d LEFT JOIN st USING (doc_id) WHERE d.doc_id % 10 <> 7 GROUP BY d.doc_id),
ens AS (SELECT r.doc_id, r.*, coalesce(confidence, 0.0) AS conf, coalesce(h, 0) AS h, coalesce(e, 0) AS e, coalesce(a, 0) AS a, critical + warning + info AS n FROM report r LEFT JOIN llm ON r.doc_id = llm.doc_id),
ens2 AS (SELECT *, CASE WHEN critical > 0 THEN 'REJECT' WHEN h > 0 THEN 'REVIEW' WHEN warning > 0 OR e > 0 THEN 'CAUTION' ELSE 'ACCEPT' END AS decision FROM ens)"""
put("RL-23_combine", f"WITH {ISSUES}, {SEV}, {LLM} SELECT doc_id, decision, floor((0.4::DOUBLE * score + 0.6::DOUBLE * conf) * 10000 + 0.5) / 10000.0::DOUBLE AS combined_score, n + a AS n_issues, h > 0 AS hallucination_detected FROM ens2", "inv_docs")
put("RL-24_llm_counts", f"WITH {ISSUES}, {SEV}, {LLM} SELECT doc_id, h AS hallucinations, e AS errors FROM llm", "inv_docs")
put("RL-25_summary", f"""WITH {ISSUES}, {SEV}, {LLM} SELECT doc_id, concat_ws(' ', 'Decision: ' || decision || '.', CASE WHEN critical > 0 THEN critical || ' critical rule violations.' END, CASE WHEN warning > 0 THEN warning || ' warnings.' END,
  CASE WHEN h > 0 THEN h || ' hallucinations detected by LLM.' END, CASE WHEN e > 0 THEN e || ' extraction errors detected by LLM.' END, 'LLM confidence: ' || CAST(floor(conf * 100 + 0.5) AS BIGINT) || '%.') AS summary FROM ens2""", "inv_docs")

# ---- repair and correction

put("TR-01_repair", """WITH holes AS (SELECT d.doc_id, doc_type, CASE WHEN d.doc_id % 3 <> 0 THEN sub_k END AS sub_k, CASE WHEN d.doc_id % 4 <> 0 THEN tax_k END AS tax_k, amount_k, amount_text, n_items FROM inv_docs d),
  it AS (SELECT doc_id, CAST(sum(CASE WHEN pos % 3 <> 1 THEN total_k ELSE qty * price_k - disc_k END) AS BIGINT) AS items_k FROM inv_items GROUP BY doc_id),
  a AS (SELECT doc_id, doc_type, tax_k, amount_k, amount_text, coalesce(items_k, 0) AS items_k, CASE WHEN doc_type <> 'po' AND n_items > 0 THEN coalesce(sub_k, items_k) ELSE sub_k END AS sub_k FROM holes LEFT JOIN it USING (doc_id)),
  b AS (SELECT *, coalesce(sub_k + tax_k, sub_k, items_k) AS want FROM a) SELECT doc_id, items_k, sub_k, coalesce(amount_k, CASE WHEN want > 0 AND amount_text IS NULL THEN want END) AS amount_k FROM b""", "inv_docs")
put("TR-02_apply_corrections", """SELECT doc_id, path, CASE WHEN bool_or(fixed) THEN max(value) FILTER (fixed) ELSE max(value) FILTER (NOT fixed) END AS value
  FROM (SELECT doc_id, path, predicted AS value, false AS fixed FROM fields UNION ALL SELECT doc_id, path, truth, true FROM fields WHERE path IN ('vendor_name', 'tax_rate')
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'items[99].total' ELSE 'extra' END, '1', true FROM orders WHERE o_orderkey % 9 = 0)
  GROUP BY doc_id, path HAVING bool_or(NOT fixed AND value IS NOT NULL) OR path NOT LIKE 'items[%'""", "fields")
put("TR-03_changed_fields", "SELECT doc_id, path FROM fields WHERE truth IS DISTINCT FROM predicted", "fields")
put("TR-04_merge", "SELECT doc_id, path, CASE WHEN (doc_id + length(path)) % 3 = 0 AND predicted IS NOT NULL THEN predicted ELSE truth END AS value FROM fields", "fields")
put("SE-04_refused", "SELECT doc_id, path FROM fields WHERE (doc_id + length(path)) % 3 <> 0", "fields")
put("TR-05_gate", f"""WITH {ISSUES}, sent AS (SELECT doc_id, count(*) AS n_sent FROM issues WHERE severity = 'critical' AND rule <> 'tax_id_checksum_invalid' GROUP BY doc_id),
  ch AS (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 'total_amount' ELSE 'notes' END AS path FROM inv_docs WHERE doc_id % 6 = 0),
  bad AS (SELECT doc_id, 'unrequested_correction: ' || path AS reason FROM ch WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.doc_id = ch.doc_id AND i.field = ch.path)) SELECT sent.doc_id, n_sent, reason FROM sent LEFT JOIN bad ON sent.doc_id = bad.doc_id""", "inv_docs")
put("TR-06_verdict", f"WITH {ISSUES} SELECT d.doc_id, CASE WHEN count(i.doc_id) > 0 THEN 'REVIEW' ELSE 'OK' END AS verdict, count(i.doc_id) AS n_reasons FROM inv_docs d LEFT JOIN (SELECT doc_id FROM issues WHERE severity = 'critical') i ON d.doc_id = i.doc_id GROUP BY d.doc_id", "inv_docs")
_FIG = lambda c: f"printf('%.2f', {c} / 100.0)"
_SAID = {k: v.replace("'", "''") for k, v in MESSAGES.items()}
put_issues("TR-07_issue_text", f"SELECT doc_id, '- [' || upper(severity) || '] Field ''' || field || ''': ' || {case('rule', _SAID, 'rule')} || coalesce(': ' || coalesce(detail, 'expected ' || {_FIG('expected_k')} || ', found ' || {_FIG('actual_k')}), '') AS text FROM issues")
_DAY = "CASE WHEN regexp_full_match(date_text, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN CAST(CAST(try_strptime(date_text, '%Y-%m-%d') AS DATE) AS VARCHAR) ELSE CAST(CAST(try_strptime(date_text, '%d.%m.%Y') AS DATE) AS VARCHAR) END"
CANON = f"""canon AS (SELECT doc_id, nullif(number, '') AS doc_number, nullif(party, '') AS supplier_name, nullif(tax_id, '') AS supplier_tax_id, {_DAY} AS issue_date, coalesce(nullif(currency, ''), 'TRY') AS currency, 'email_pdf' AS channel FROM inv_docs),
efat AS (SELECT doc_id, coalesce(nullif(number, ''), 'alt') AS doc_number, party AS supplier_name, tax_id AS supplier_tax_id, {_DAY} AS issue_date, coalesce(nullif(currency, ''), 'TRY') AS currency, 'efatura' AS channel, 'ettn-' || doc_id AS source_ref FROM inv_docs)"""
put("TR-08_canonical", f"WITH {CANON} SELECT * FROM canon", "inv_docs")
put("TR-09_efatura", f"WITH {CANON} SELECT * FROM efat", "inv_docs")
put("SE-05_channels", f"WITH {CANON} SELECT channel, currency, count(*) AS n FROM (SELECT channel, currency FROM canon UNION ALL SELECT channel, currency FROM efat) GROUP BY ALL", "inv_docs")

# ---- duplicates

DUP = f"""d AS (SELECT *, {number_key("doc_number")} AS nk, {number_core("doc_number")} AS nc FROM incoming), l AS (SELECT *, {number_key("doc_number")} AS nk, {number_core("doc_number")} AS nc FROM ledger),
t1 AS (SELECT d.doc_id, l.row_id, 1 AS tier FROM d JOIN l ON d.supplier = l.supplier AND d.nk = l.nk WHERE d.nk <> ''),
t2 AS (SELECT d.doc_id, l.row_id, 2 AS tier FROM d JOIN l ON d.supplier = l.supplier AND d.amount_key = l.amount_key WHERE length(d.nc) >= 4 AND length(l.nc) >= 4 AND (ends_with(d.nc, l.nc) OR ends_with(l.nc, d.nc))),
t3 AS (SELECT d.doc_id, l.row_id, 3 AS tier FROM d JOIN l ON d.supplier = l.supplier AND d.amount_key = l.amount_key WHERE d.issue_date IS NULL OR l.issue_date BETWEEN d.issue_date - 10 AND d.issue_date + 10),
best AS (SELECT doc_id, row_id, min(tier) AS tier FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3) GROUP BY ALL),
m AS (SELECT b.doc_id, b.row_id, b.tier, CASE WHEN tier = 3 THEN 'MEDIUM' ELSE 'HIGH' END AS risk, abs(date_diff('day', l.issue_date, d.issue_date)) AS days_apart, d.channel = l.channel AS same_channel, d.doc_number AS actual, l.doc_number AS expected, l.issue_date AS earlier
  FROM best b JOIN d USING (doc_id) JOIN l ON l.row_id = b.row_id),
f AS (SELECT doc_id, 'POSSIBLE_DUPLICATE' AS kind, CASE risk WHEN 'HIGH' THEN 'critical' ELSE 'warning' END AS severity, expected, actual,
  CASE tier WHEN 1 THEN 'same supplier, same number' WHEN 2 THEN 'same supplier and amount, numbers share digits' ELSE 'same supplier and amount, close in time' END || '; earlier document: ' || expected || ' (' || CAST(earlier AS VARCHAR) || ')' || CASE WHEN same_channel THEN '' ELSE '; also received by another channel' END AS message, risk = 'HIGH' AS blocks_payment FROM m)"""


def put_dup(name: str, sql: str) -> None:
    put(name, f"WITH {DUP} " + sql, "incoming")


put_dup("JN-01_identity", "SELECT doc_id, row_id FROM t1")
put_dup("JN-02_number_core", "SELECT doc_id, row_id FROM t2")
put_dup("JN-03_amount_window", "SELECT doc_id, row_id FROM t3")
put_dup("JN-04_strongest", "SELECT doc_id, row_id, tier, risk, days_apart FROM m")
_HIST = "SELECT supplier, row_id, row_number() OVER (PARTITION BY supplier ORDER BY issue_date DESC NULLS LAST, row_id DESC) AS rank FROM ledger WHERE supplier IN (SELECT supplier FROM incoming)"
put("JN-05_history", f"SELECT * FROM ({_HIST}) WHERE rank <= 20", "incoming")
put("SO-03_newest", f"SELECT supplier, row_id FROM ({_HIST}) WHERE rank <= 3", "incoming")
put("WN-04_history_rank", f"SELECT supplier, count(*) AS n, max(rank) AS last_rank FROM ({_HIST}) WHERE rank <= 200 GROUP BY supplier", "incoming")
put_dup("AG-03_risk", "SELECT d.doc_id, CASE coalesce(min(CASE risk WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 END), 2) WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id")
put_dup("SO-01_order", "SELECT doc_id, row_id, row_number() OVER (PARTITION BY doc_id ORDER BY risk <> 'HIGH', coalesce(nullif(days_apart, 0), 9999), tier, row_id) AS place FROM m")
put_dup("FD-11_duplicate_findings", "SELECT * FROM f")
put_dup("PIPE-01_duplicate_decision", "SELECT d.doc_id, CASE WHEN bool_or(risk = 'HIGH') THEN 'HOLD' ELSE 'PAY' END AS verdict, count(m.doc_id) AS n_findings FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id")
put("WN-01_recurring", """SELECT supplier, amount_key FROM (SELECT supplier, amount_key, issue_date - lag(issue_date) OVER (PARTITION BY supplier, amount_key ORDER BY issue_date) AS gap FROM recurring)
  GROUP BY ALL HAVING count(*) >= 3 AND bool_and(coalesce(gap BETWEEN 25 AND 35, true))""", "recurring")
put("WN-02_damper", """WITH last AS (SELECT supplier, max(issue_date) AS d FROM recurring GROUP BY supplier),
  steady AS (SELECT supplier FROM (SELECT supplier, amount_key, issue_date - lag(issue_date) OVER (PARTITION BY supplier, amount_key ORDER BY issue_date) AS gap FROM recurring) GROUP BY ALL HAVING count(*) >= 3 AND bool_and(coalesce(gap BETWEEN 25 AND 35, true)))
  SELECT CAST(r.supplier AS BIGINT) AS doc_id, r.row_id, CASE WHEN s.supplier IS NULL THEN 'MEDIUM' ELSE 'LOW' END AS risk, s.supplier IS NOT NULL AS recurring FROM recurring r JOIN last l ON r.supplier = l.supplier LEFT JOIN steady s ON r.supplier = s.supplier WHERE r.issue_date >= l.d - 5""", "recurring")
put("AG-19_ledger_count", "SELECT count(*) AS n FROM lineitem")
put("SRC-10_ledger_scan", "SELECT row_id, doc_number, amount_key FROM ledger WHERE supplier = '7'", "ledger")
put("SNK-01_record", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) + (SELECT max(row_id) FROM ledger) AS row_id, supplier FROM incoming", "incoming")

# ---- orders against invoices

#: Lines of one key - SKU, or description where there is no SKU - pair in order; other descriptions have nothing in common.
MATCH = f"""pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS k FROM (SELECT *, coalesce('s ' || lower(sku), 'd ' || description) AS key FROM po_lines)),
ik AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS k FROM (SELECT *, coalesce('s ' || lower(sku), 'd ' || description) AS key FROM inv_lines)),
pair AS (SELECT p.doc_id, p.pos AS po_pos, i.pos AS inv_pos, p.qty AS pq, p.price_k AS pp, p.total_k AS pt, i.qty AS iq, i.price_k AS ip, i.total_k AS it, CASE WHEN p.description IS NOT DISTINCT FROM i.description THEN 1.0 ELSE 0.0 END::DOUBLE AS sim, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos) - 1 AS line
  FROM pk p JOIN ik i ON p.doc_id = i.doc_id AND p.key = i.key AND p.k = i.k),
lone AS (SELECT doc_id, pos, 'po' AS side, sku, NULL::BIGINT AS total_k, description FROM po_lines WHERE doc_id * 100000 + pos NOT IN (SELECT doc_id * 100000 + po_pos FROM pair)
  UNION ALL SELECT doc_id, pos, 'inv', sku, total_k, description FROM inv_lines WHERE doc_id * 100000 + pos NOT IN (SELECT doc_id * 100000 + inv_pos FROM pair)),
three AS (SELECT *, unnest(['quantity', 'unit_price', 'total']) AS field, unnest([pq, pp, pt]) AS a, unnest([iq, ip, it]) AS b, unnest([0.001, 0.02, 0.02]) AS tol FROM pair),
disc AS (SELECT doc_id, line, field, a AS po_value, b AS inv_value, CASE WHEN a IS NULL OR b IS NULL OR field = 'total' THEN 'warning' ELSE 'critical' END AS severity,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (abs(a - b) * 20000 + greatest(abs(a), 1)) // (2 * greatest(abs(a), 1)) END AS diff_bp, pq, pp, iq, ip
  FROM three WHERE (a IS NULL) <> (b IS NULL) OR NOT ((a = 0 AND b = 0) OR abs(a - b)::DOUBLE / greatest(abs(a), abs(b), 1e-9)::DOUBLE <= tol::DOUBLE)
  UNION ALL SELECT doc_id, line, 'description', NULL, NULL, 'warning', NULL, pq, pp, iq, ip FROM pair WHERE sim < 0.8),
hd AS (SELECT doc_id, sub_k + CASE WHEN doc_id % 23 = 0 THEN CAST(floor(sub_k / 10) AS BIGINT) ELSE 0 END AS a_t, amount_k AS bt, sub_k AS bs, CASE WHEN doc_id % 8 = 1 THEN 'TRY' ELSE currency END AS ac, currency AS bc, party FROM inv_docs),
near AS (SELECT *, (a_t = 0 AND bt = 0) OR abs(a_t - bt)::DOUBLE / greatest(abs(a_t), abs(bt), 1e-9)::DOUBLE <= 0.02 AS n1, (a_t = 0 AND bs = 0) OR abs(a_t - bs)::DOUBLE / greatest(abs(a_t), abs(bs), 1e-9)::DOUBLE <= 0.02 AS n2, {case("ac", CURRENCIES, "ac")} = {case("bc", CURRENCIES, "bc")} AS cc FROM hd),
scal AS (SELECT doc_id, 'total_amount' AS field, n1 OR n2 AS matched, CASE WHEN n1 OR n2 THEN 'ok' ELSE 'warning' END AS severity, bt - a_t AS gap FROM near WHERE a_t IS NOT NULL AND bt IS NOT NULL
  UNION ALL SELECT doc_id, 'currency', cc, CASE WHEN cc THEN 'ok' ELSE 'critical' END, NULL FROM near WHERE ac <> '' AND bc <> ''
  UNION ALL SELECT doc_id, 'supplier_vendor', doc_id % 29 <> 0, CASE WHEN doc_id % 29 <> 0 THEN 'ok' ELSE 'warning' END, NULL FROM hd WHERE party <> ''),
pf AS (SELECT doc_id, {case("field", FIELD_KINDS, "'OTHER'")} AS kind, severity, field, 'po_match' AS source, 'cross_source' AS basis, CAST(po_value AS VARCHAR) AS expected, CAST(inv_value AS VARCHAR) AS actual,
    CASE field WHEN 'unit_price' THEN (inv_value - po_value) * coalesce(nullif(iq, 0), pq) WHEN 'quantity' THEN (inv_value - po_value) * coalesce(nullif(pp, 0), ip) ELSE inv_value - po_value END AS amount_k, line FROM disc
  UNION ALL SELECT doc_id, {case("field", FIELD_KINDS, "'OTHER'")}, severity, field, 'po_match', 'cross_source', NULL, NULL, gap, NULL FROM scal WHERE severity <> 'ok'
  UNION ALL SELECT doc_id, CASE side WHEN 'inv' THEN 'NOT_IN_PO' ELSE 'MISSING_ITEM' END, CASE side WHEN 'inv' THEN 'critical' ELSE 'warning' END, 'items', 'po_match', 'cross_source', CASE side WHEN 'po' THEN sku END, CASE side WHEN 'inv' THEN sku END, total_k, NULL FROM lone)"""


def put_match(name: str, sql: str) -> None:
    put(name, f"WITH {MATCH} " + sql, "inv_docs", "po_lines", "inv_lines")


SKU = """pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(sku) ORDER BY pos) AS k FROM po_items), ik AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(sku) ORDER BY pos) AS k FROM inv_items),
pair AS (SELECT p.doc_id, p.pos AS po_pos, i.pos AS inv_pos, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos) - 1 AS line FROM pk p JOIN ik i ON p.doc_id = i.doc_id AND lower(p.sku) = lower(i.sku) AND p.k = i.k)"""
put("JN-06_sku_pairs", f"WITH {SKU} SELECT doc_id, po_pos, inv_pos FROM pair", "po_items")
put("WN-03_occurrence", f"WITH {SKU} SELECT doc_id, count(*) AS n, max(inv_pos) AS last FROM pair GROUP BY doc_id", "po_items")
put_match("JN-08_match_lines", "SELECT doc_id, line, po_pos, inv_pos, sim FROM pair")
put_match("JN-09_unmatched", "SELECT doc_id, pos, side FROM lone")
put_match("FD-01_discrepancies", "SELECT doc_id, line, field, po_value, inv_value, severity, diff_bp FROM disc")
put_match("FD-03_match_score", "SELECT doc_id, line, round((sim + CASE WHEN abs(pq - iq)::DOUBLE / greatest(pq, iq, 1e-9)::DOUBLE <= 0.001 THEN 1.0 ELSE 0.5 END::DOUBLE) / 2, 4) AS match_score FROM pair")
put_match("JN-10_scalars", "SELECT doc_id, field, matched, severity FROM scal")
put_match("FD-04_total_check", "SELECT doc_id, matched, severity FROM scal WHERE field = 'total_amount'")
put_match("FD-05_currency_check", "SELECT doc_id, matched, severity FROM scal WHERE field = 'currency'")
put("GR-01_goods_receipts", """WITH li AS (SELECT l_orderkey AS doc_id, 'SKU-' || l_partkey AS sku, CAST(sum(l_quantity) AS BIGINT) AS qty, min(l_partkey) AS partkey FROM lineitem GROUP BY ALL),
  x AS (SELECT *, CASE WHEN partkey % 9 <> 0 THEN qty - CASE WHEN partkey % 4 = 0 THEN 1 ELSE 0 END ELSE 0 END AS got FROM li)
  SELECT doc_id, sku, 'invoiced_over_received' AS rule, 'critical' AS severity FROM x WHERE qty > got UNION ALL SELECT doc_id, sku, 'received_under_ordered', 'warning' FROM x WHERE got < qty UNION ALL SELECT doc_id, sku, 'received_after_invoice', 'warning' FROM x WHERE partkey % 9 <> 0 AND partkey % 6 = 0""")
STATUS = """, sv AS (SELECT doc_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings FROM (SELECT doc_id, severity FROM disc UNION ALL SELECT doc_id, severity FROM scal) GROUP BY doc_id),
  s AS (SELECT d.doc_id, coalesce(a.n, 0) AS matched, coalesce(p.n, 0) AS unmatched_po, coalesce(i.n, 0) AS unmatched_inv, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings FROM inv_docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM pair GROUP BY 1) a ON a.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM lone WHERE side = 'po' GROUP BY 1) p ON p.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM lone WHERE side = 'inv' GROUP BY 1) i ON i.doc_id = d.doc_id LEFT JOIN sv ON sv.doc_id = d.doc_id),
  sm AS (SELECT *, (matched * 20000 + greatest(matched + unmatched_po, 1)) // (2 * greatest(matched + unmatched_po, 1)) AS match_rate_bp, CASE WHEN critical > 0 THEN 'REJECT' WHEN warnings + unmatched_po + unmatched_inv > 0 THEN 'REVIEW' ELSE 'APPROVE' END AS overall_status FROM s)"""
put_match("AG-02_match_summary", STATUS + " SELECT * FROM sm")

# ---- findings and decisions

RF = f"rf AS (SELECT doc_id, {case('rule', RULE_KINDS, 'upper(rule)')} AS kind, severity, field, 'document' AS source, 'single_document' AS basis, CASE WHEN rule IN {listed(PRICED_RULES)} THEN actual_k - expected_k END AS amount_k FROM issues)"
ALL = f"""{ISSUES}, {RF}, {MATCH}, {DUP.replace(" f AS (", " df AS (")}, af AS (SELECT doc_id, kind, severity, field, source, basis, amount_k, NULL::BIGINT AS line, false AS blocks FROM rf
  UNION ALL SELECT doc_id, kind, severity, field, source, basis, amount_k, line, false FROM pf UNION ALL SELECT doc_id, kind, severity, '_document', 'ledger', 'cross_source', NULL, NULL, blocks_payment FROM df),
fl AS (SELECT *, coalesce(abs(amount_k) >= 1, false) AS is_priced, basis = 'cross_source' AS is_financial, severity = 'critical' AND basis = 'cross_source' AND (blocks OR coalesce(abs(amount_k) >= 1, false)) AS holds_payment FROM af)"""
ALL = ALL.replace("\nf AS (SELECT doc_id, 'POSSIBLE", "\ndf AS (SELECT doc_id, 'POSSIBLE")


def impact(source: str, basis: str) -> str:
    return f"""(SELECT doc_id, CAST(coalesce(sum(CASE WHEN line IS NOT NULL THEN v END), max(CASE WHEN line IS NULL THEN v END)) AS BIGINT) AS impact_k FROM (SELECT doc_id, line, arg_max(amount_k, abs(amount_k)::HUGEINT * 2 + (amount_k > 0)::INT) AS v
    FROM {source} WHERE basis = '{basis}' AND abs(amount_k) >= 1 GROUP BY doc_id, line) GROUP BY doc_id)"""


def put_all(name: str, sql: str) -> None:
    put(name, f"WITH {ALL} " + sql, "inv_docs", "po_lines", "inv_lines", "incoming")


put("FD-07_rule_findings", f"WITH {ISSUES}, {RF} SELECT doc_id, kind, severity, field, amount_k FROM rf", "inv_docs")
put_match("FD-08_po_findings", "SELECT doc_id, kind, severity, field, amount_k, line FROM pf WHERE line IS NOT NULL")
put_match("FD-09_scalar_findings", "SELECT doc_id, kind, severity, field, amount_k FROM pf WHERE line IS NULL AND field <> 'items'")
put_match("FD-10_unmatched_findings", "SELECT doc_id, kind, severity, expected, actual, amount_k FROM pf WHERE field = 'items'")
put("FD-12_failed", "SELECT doc_id, 'EXTRACTION_FAILED' AS kind, 'critical' AS severity FROM inv_docs WHERE n_items = 0", "inv_docs")
put_all("FD-13_flags", "SELECT kind, is_priced, is_financial, holds_payment, count(*) AS n FROM fl GROUP BY ALL")
put_all("FD-14_priced", "SELECT doc_id, count(*) AS n_priced FROM fl WHERE is_priced GROUP BY doc_id")
put_match("AG-04_net_impact", f"SELECT * FROM {impact('pf', 'cross_source')}")
DECIDED = f""", ag AS (SELECT doc_id, bool_or(holds_payment) AS hold, bool_or(severity = 'critical') AS crit, count(*) AS n FROM fl GROUP BY doc_id),
  dec AS (SELECT d.doc_id, CASE WHEN hold THEN 'HOLD' WHEN crit THEN 'REVIEW' ELSE 'PAY' END AS verdict, coalesce(x.impact_k, 0) AS financial_k, coalesce(y.impact_k, 0) AS internal_k, coalesce(n, 0) AS n_findings
  FROM inv_docs d LEFT JOIN ag ON ag.doc_id = d.doc_id LEFT JOIN {impact("fl", "cross_source")} x ON x.doc_id = d.doc_id LEFT JOIN {impact("fl", "single_document")} y ON y.doc_id = d.doc_id)"""
put_all("AG-05_decide", DECIDED + " SELECT * FROM dec")
put_all("AG-17_portfolio", DECIDED + " SELECT verdict, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, CAST(sum(financial_k) AS BIGINT) AS financial_k, CAST(sum(internal_k) AS BIGINT) AS internal_k FROM dec GROUP BY verdict")
put_all("AG-17_members", DECIDED + " SELECT verdict, doc_id FROM dec")
put(
    "AG-05_coverage",
    f"""WITH {ALL}{DECIDED}, cv AS (SELECT doc_id, count(*) FILTER (path NOT IN {listed(UNVERIFIABLE)}) AS c, count(*) FILTER (path IN {listed(UNVERIFIABLE)}) AS u, string_agg(path, ',' ORDER BY path) FILTER (path IN {listed(UNVERIFIABLE)}) AS b FROM fields WHERE predicted <> '' GROUP BY doc_id)
  SELECT dec.doc_id, verdict, coalesce(c, 0) AS checked, coalesce((c * 2000 + c + u) // (2 * (c + u)), 0) AS coverage_pm, coalesce(b, '') AS blind FROM dec LEFT JOIN cv ON cv.doc_id = dec.doc_id""",
    "inv_docs", "po_lines", "inv_lines", "incoming", "fields",
)
put_all("SE-01_findings", "SELECT source, severity, count(*) AS n FROM fl GROUP BY ALL")
put_issues("AG-01_severities", "SELECT doc_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM issues GROUP BY doc_id")
put("AG-06_coverage", f"""SELECT doc_id, c AS checked, u AS unverifiable, (c * 2000 + c + u) // (2 * (c + u)) AS coverage_pm FROM (SELECT doc_id, count(*) FILTER (path NOT IN {listed(UNVERIFIABLE)}) AS c, count(*) FILTER (path IN {listed(UNVERIFIABLE)}) AS u
  FROM fields WHERE predicted <> '' GROUP BY doc_id)""", "fields")
put_match("JN-14_optional_po", f""", h AS (SELECT * FROM pf WHERE doc_id % 2 = 0), ag AS (SELECT doc_id, bool_or(severity = 'critical' AND abs(amount_k) >= 1) AS hold, bool_or(severity = 'critical') AS crit FROM h GROUP BY doc_id)
  SELECT d.doc_id, CASE WHEN hold THEN 'HOLD' WHEN crit THEN 'REVIEW' ELSE 'PAY' END AS verdict, coalesce(impact_k, 0) AS financial_k FROM inv_docs d LEFT JOIN ag ON ag.doc_id = d.doc_id LEFT JOIN {impact("h", "cross_source")} x ON x.doc_id = d.doc_id""")
put_match("RP-04_json", f""", ag AS (SELECT doc_id, bool_or(severity = 'critical' AND abs(amount_k) >= 1) AS hold, bool_or(severity = 'critical') AS crit FROM pf GROUP BY doc_id)
  SELECT d.doc_id, '{{"verdict":"' || CASE WHEN hold THEN 'HOLD' WHEN crit THEN 'REVIEW' ELSE 'PAY' END || '","financial_k":' || coalesce(impact_k, 0) || '}}' AS json FROM inv_docs d LEFT JOIN ag ON ag.doc_id = d.doc_id LEFT JOIN {impact("pf", "cross_source")} x ON x.doc_id = d.doc_id""")


def money(k: str) -> str:
    return f"CASE WHEN {k} < 0 THEN '-' ELSE '' END || translate(format('{{:,}}', abs({k}) // 100), ',', '.') || ',' || lpad(CAST(abs({k}) % 100 AS VARCHAR), 2, '0') || ' TL'"


PLACED = """, pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY amount_k IS NULL, -abs(coalesce(amount_k, 0)), CASE severity WHEN 'critical' THEN 0 ELSE 1 END, coalesce(line, 1000000000), kind, field, coalesce(expected, ''), coalesce(actual, '')) AS place FROM pf)"""
put_match("SO-02_problem_order", PLACED + " SELECT doc_id, place, kind, field, severity, amount_k, line FROM pl")
_SHOWN = lambda c: f"CASE WHEN kind IN {listed(AMOUNT_KINDS)} THEN {money(f'TRY_CAST({c} AS BIGINT)')} ELSE {c} END"
put(
    "RP-02_decision_text",
    f"""WITH {MATCH}{PLACED}, ag AS (SELECT doc_id, bool_or(severity = 'critical' AND abs(amount_k) >= 1) AS hold, bool_or(severity = 'critical') AS crit,
    first(kind ORDER BY coalesce(line, 1000000000), kind, field, coalesce(expected, ''), coalesce(actual, '')) FILTER (severity = 'critical' AND kind IN {listed(HOLD_SUBTITLES)}) AS cause,
    string_agg('• ' || {case("kind", {k: v[0] for k, v in KINDS.items()}, "kind")} || CASE WHEN amount_k <> 0 THEN '  (' || {money("amount_k")} || ')' ELSE '' END || CASE WHEN expected IS NOT NULL AND actual IS NOT NULL THEN chr(10) || '    Beklenen: ' || {_SHOWN("expected")} || '    Faturada: ' || {_SHOWN("actual")} ELSE '' END
      || coalesce(chr(10) || '    → ' || {case("kind", {k: v[1] for k, v in KINDS.items()}, "NULL")}, ''), chr(10) || chr(10) ORDER BY place) AS said FROM pl GROUP BY doc_id),
  bl AS (SELECT doc_id, count(*) AS n, string_agg(path, ', ' ORDER BY path) AS blind FROM fields WHERE predicted <> '' AND path IN {listed(UNVERIFIABLE)} GROUP BY doc_id),
  dc AS (SELECT d.doc_id, CASE WHEN hold THEN 'HOLD' WHEN crit THEN 'REVIEW' ELSE 'PAY' END AS verdict, cause, said, n, blind, CASE WHEN impact_k <> 0 THEN {money("impact_k")} END AS impact FROM inv_docs d LEFT JOIN ag ON ag.doc_id = d.doc_id LEFT JOIN {impact("pf", "cross_source")} x ON x.doc_id = d.doc_id LEFT JOIN bl ON bl.doc_id = d.doc_id),
  hl AS (SELECT *, {case("verdict", TITLES, "''")} AS title, CASE WHEN verdict = 'HOLD' THEN {case("cause", HOLD_SUBTITLES, f"'{SUBTITLES['HOLD']}'")} ELSE {case("verdict", SUBTITLES, "''")} END AS subtitle FROM dc)
  SELECT doc_id, title, subtitle, impact, NULL::VARCHAR AS internal, concat_ws(chr(10) || chr(10), {case("verdict", SIGNS, "''")} || ' ' || title || chr(10) || subtitle, '{OVERCHARGED}' || impact, said, '{BLIND}(' || n || '): ' || blind || chr(10) || '{BLIND_NOTE}') AS text FROM hl""",
    "inv_docs", "po_lines", "inv_lines", "fields",
)
_ORD = "line * 10 + list_position([" + ", ".join(f"'{f}'" for f in FIELD_ORD) + "], field) - 1"
PROB = f""", p0 AS (SELECT doc_id, {_ORD} AS ord, field, severity, '' AS raw_desc FROM disc UNION ALL SELECT doc_id, {HEAD_ORD} + length(field), field, severity, '' FROM scal WHERE severity <> 'ok'
    UNION ALL SELECT doc_id, CASE side WHEN 'inv' THEN {EXTRA_ORD} ELSE {MISSING_ORD} END + pos, CASE side WHEN 'inv' THEN '_extra_invoice_line' ELSE '_missing_po_line' END, CASE side WHEN 'inv' THEN 'critical' ELSE 'warning' END,
    CASE side WHEN 'inv' THEN '{LONE["_extra_invoice_line"]}' ELSE '{LONE["_missing_po_line"]}' END || coalesce(': ' || description, '') FROM lone),
  pr AS (SELECT doc_id, ord, {case("field", FIELD_ANOMALY, "'OTHER'")} AS code, CASE severity WHEN 'critical' THEN 'HIGH' ELSE 'MEDIUM' END AS level, raw_desc FROM p0),
  lb AS (SELECT *, {case("level", ICONS, "''")} AS icon, {case("code", {k: v[0] for k, v in ANOMALIES.items()}, "''")} AS label, {case("code", {k: v[1] for k, v in ANOMALIES.items()}, "''")} AS detail, {case("code", {k: v[2] for k, v in ANOMALIES.items()}, "''")} AS action FROM pr),
  tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE level WHEN 'HIGH' THEN 0 ELSE 1 END, ord) AS n FROM lb) WHERE n <= 6)"""
VERDICT = ", vd AS (SELECT doc_id, " + ", ".join(f"{case('overall_status', {k: v[i] for k, v in MATCH_VERDICTS.items()}, chr(39) * 2)} AS {c}" for i, c in enumerate(("icon", "title", "subtitle", "color", "action"))) + " FROM sm)"
put_match("RP-01_match_problems", PROB + " SELECT doc_id, ord, code, level, icon, label, detail, raw_desc, action FROM lb")
put_match("RP-01_match_verdict", STATUS + VERDICT + " SELECT * FROM vd")
put_match("SO-04_top_problems", PROB + " SELECT doc_id, n, code, level, ord FROM tp")
_LINES = "icon || ' *' || label || '*' || CASE WHEN raw_desc <> '' THEN chr(10) || '   _' || substr(raw_desc, 1, 100) || '_' ELSE '' END || chr(10) || '   → ' || action"
put_match("RP-03_chat", STATUS + VERDICT + PROB + f""", ls AS (SELECT doc_id, string_agg({_LINES}, chr(10) || chr(10) ORDER BY n) AS listed FROM tp GROUP BY doc_id),
  ms AS (SELECT vd.doc_id, concat_ws(chr(10) || chr(10), icon || ' *' || title || '*' || chr(10) || '_' || subtitle || '_', '{FOUND}' || chr(10) || listed, '{TO_DO}' || chr(10) || action) || chr(10) AS t FROM vd LEFT JOIN ls ON ls.doc_id = vd.doc_id)
  SELECT doc_id, CASE WHEN length(t) > {LONGEST} THEN substr(t, 1, {LONGEST - 50}) || '{SHORTENED}' ELSE t END AS message FROM ms""")

# ---- scoring

NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"
NUM = "TRY_CAST(replace({0}, ',', '') AS DOUBLE)"


def accuracy(field: str) -> str:
    p, g = NUM.format("predicted"), NUM.format("truth")
    rel = f"CASE WHEN {g} = 0 THEN {p} = 0 ELSE abs({p} - {g}) / abs({g}) <= 0.01 END"
    return f"CASE WHEN coalesce(CASE {field} WHEN 'total_amount' THEN abs({p} - {g}) <= 1e-9 WHEN 'tax_rate' THEN abs({p} - {g}) <= 0.001 + 1e-9 ELSE {rel} END, false) THEN 1.0 ELSE 0.0 END::DOUBLE"


_W = lambda c: f"list_filter(list_distinct(string_split({NORM.format(c)}, ' ')), lambda x: x <> '')"
TOKENS = f"""tok AS (SELECT *, len({_W("predicted")}) AS n, len({_W("truth")}) AS m, len(list_intersect({_W("predicted")}, {_W("truth")})) AS b FROM src),
prf AS (SELECT *, round(CASE WHEN m = 0 THEN (n = 0)::INT::DOUBLE WHEN n = 0 THEN 0.0 ELSE b::DOUBLE / n END, 4) AS p, round(CASE WHEN m = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE b::DOUBLE / m END, 4) AS r,
  round(CASE WHEN m = 0 THEN (n = 0)::INT::DOUBLE WHEN b = 0 THEN 0.0 ELSE (2 * b)::DOUBLE / (n + m) END, 4) AS f1 FROM tok)"""
SCORED = f"""src AS (SELECT doc_id, path, coalesce(truth, '') AS truth, coalesce(predicted, '') AS predicted FROM fields WHERE path <> 'receipt_number'), {TOKENS},
sc AS (SELECT doc_id, path, f1, CASE WHEN {NORM.format("predicted")} = {NORM.format("truth")} THEN 1.0 WHEN path IN ('total_amount', 'tax_rate') THEN {accuracy("path")} ELSE 0.0 END::DOUBLE AS em FROM prf),
ds AS (SELECT doc_id, count(*) AS n_fields, round(avg(em), 4) AS em, round(avg(f1), 4) AS f1 FROM sc GROUP BY doc_id), dx AS (SELECT doc_id, round(avg(em), 4) AS em FROM sc WHERE path <> 'tax_rate' GROUP BY doc_id)"""


def put_scored(name: str, sql: str, *more: str) -> None:
    put(name, f"WITH {SCORED} " + sql, "fields", *more)


put("JN-12_fields", "SELECT doc_id, path, coalesce(truth, '') AS truth, coalesce(predicted, '') AS predicted FROM fields WHERE path <> 'receipt_number'", "fields")
put("SC-01_exact", f"SELECT doc_id, path, CASE WHEN {NORM.format('predicted')} = {NORM.format('truth')} THEN 1.0 ELSE 0.0 END::DOUBLE AS em FROM fields WHERE path <> 'receipt_number'", "fields")
put("SC-02_relative", f"SELECT doc_id, path, {accuracy(chr(39) + chr(39))} AS score FROM fields WHERE path IN ('total_amount', 'tax_rate')", "fields")
put("SC-03_absolute", f"SELECT doc_id, path, {accuracy(chr(39) + 'tax_rate' + chr(39))} AS score FROM fields WHERE path IN ('total_amount', 'tax_rate')", "fields")
put("SC-04_dispatch", f"SELECT doc_id, path, {accuracy('path')} AS score FROM fields", "fields")
put_scored("SC-05_override", "SELECT doc_id, path, em FROM sc")
put("SC-06_available", "SELECT doc_id, path FROM fields WHERE path <> 'receipt_number' AND (doc_id + length(path)) % 2 = 0", "fields")
put("SC-08_reindex", f"""WITH {SKU}, o AS (SELECT doc_id, inv_pos AS j, line AS ord FROM pair) SELECT i.doc_id, i.pos AS j, row_number() OVER (PARTITION BY i.doc_id ORDER BY o.ord ASC NULLS LAST, i.pos) - 1 AS new_pos FROM inv_items i LEFT JOIN o ON o.doc_id = i.doc_id AND o.j = i.pos""", "po_items")
put("WN-06_alignment_rank", "SELECT pos AS new_pos, count(*) AS n FROM inv_items GROUP BY pos", "inv_items")
put("SE-02_key_union", """SELECT path, count(*) AS n FROM (SELECT coalesce(a.path, b.path) AS path, truth, predicted FROM (SELECT doc_id, path, truth FROM fields WHERE doc_id % 2 = 0) a FULL JOIN (SELECT doc_id, path, predicted FROM fields WHERE doc_id % 3 = 0) b
  ON a.doc_id = b.doc_id AND a.path = b.path) WHERE truth IS DISTINCT FROM predicted GROUP BY path""", "fields")
DOCTOK = "src AS (SELECT doc_id, t AS truth, CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(t, 1, CAST(floor(length(t) * 3 / 4) AS INT)) END AS predicted FROM (SELECT doc_id, text AS t FROM documents))"
put("AG-07_token_f1", f"WITH {DOCTOK}, {TOKENS} SELECT doc_id, p AS precision, r AS recall, f1 FROM prf")
put("SE-03_common_words", f"WITH {DOCTOK}, {TOKENS} SELECT doc_id, b AS common FROM tok")
put_scored("AG-08_document_scores", "SELECT * FROM ds")
put_scored("AG-09_batch_scores", "SELECT count(*) AS total_documents, round(avg(em), 4) AS em, round(avg(f1), 4) AS f1 FROM ds")
put_scored("AG-10_run", """, rows AS (SELECT d.doc_id, doc_type, CASE WHEN d.doc_id % 4 = 0 THEN 'REVIEW' ELSE 'OK' END AS verdict, CASE WHEN d.doc_id % 13 <> 0 THEN em END AS em, CASE WHEN d.doc_id % 13 <> 0 THEN f1 END AS f1 FROM inv_docs d LEFT JOIN ds ON d.doc_id = ds.doc_id),
  bl AS (SELECT *, 'overall' AS block FROM rows UNION ALL SELECT *, 'ok_only' FROM rows WHERE verdict = 'OK' UNION ALL SELECT *, 'type:' || doc_type FROM rows)
  SELECT block, count(*) AS documents, round(avg(coalesce(em, 0)), 4) AS em, round(avg(coalesce(f1, 0)), 4) AS f1 FROM bl GROUP BY block""", "inv_docs")
put_scored("AG-11_raw_delta", "SELECT round(avg(ds.em), 4) AS em, round(avg(dx.em), 4) AS raw_em FROM ds JOIN dx ON ds.doc_id = dx.doc_id")
put_scored("AG-16_pilot", "SELECT round(avg(em), 4) AS em, count(*) AS fields_scored, count(*) FILTER (em = 0) AS misses FROM sc")
put_scored("AG-20_misses", "SELECT doc_id, count(*) AS n_misses, string_agg(path, ',' ORDER BY path) AS paths FROM sc WHERE em = 0 GROUP BY doc_id")
put_scored("AG-21_moved", "SELECT ds.doc_id, dx.em AS old, ds.em AS new FROM ds JOIN dx ON ds.doc_id = dx.doc_id WHERE ds.em <> dx.em")
put_scored("AG-22_score_or_zero", "SELECT d.doc_id, CASE WHEN d.doc_id % 13 <> 0 THEN coalesce(em, 0.0) ELSE 0.0 END::DOUBLE AS em FROM inv_docs d LEFT JOIN ds ON d.doc_id = ds.doc_id", "inv_docs")
put_scored("JN-13_rescore", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN em ELSE -1.0 END::DOUBLE AS em FROM ds WHERE doc_id % 3 <> 0")

# ---- voting, calls, splits

NORMAL = NORM.format("description")


def voted(form: str) -> str:
    return f"""(SELECT doc_id, pos, arg_min(spelled, -n * 10 + first) AS description FROM (SELECT doc_id, pos, {form} AS form, count(*) AS n, min(pass) AS first, arg_min(description, pass) AS spelled FROM passes GROUP BY ALL) GROUP BY doc_id, pos)"""


def median(c: str) -> str:
    return f"list_sort(list({c}))[len(list({c})) // 2 + 1]"


put("AG-14_vote", f"SELECT v.doc_id, v.pos, v.description, m.qty FROM {voted(NORMAL)} v JOIN (SELECT doc_id, pos, {median('qty')} AS qty FROM passes GROUP BY ALL) m ON v.doc_id = m.doc_id AND v.pos = m.pos", "passes")
put("AG-15_vote_items", f"SELECT v.doc_id, v.pos, m.qty, m.price_k, v.description FROM {voted('description')} v JOIN (SELECT doc_id, pos, {median('qty')} AS qty, {median('price_k')} AS price_k FROM passes GROUP BY ALL) m ON v.doc_id = m.doc_id AND v.pos = m.pos", "passes")
COST = "costed AS (SELECT *, tokens_in * CASE model " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in RATES.items()) + " ELSE 500 END + tokens_out * CASE model " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in RATES.items()) + " ELSE 4000 END AS cost FROM calls)"
put("AG-13_cost", f"WITH {COST} SELECT event_id, cost FROM costed", "calls")
put("AG-12_calls", f"WITH {COST} SELECT model, count(*) AS calls, count(*) FILTER (success) AS successes, CAST(floor(sum(elapsed_c) FILTER (success) / greatest(count(*) FILTER (success), 1)) AS BIGINT) AS avg_elapsed_c, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost FROM costed GROUP BY model", "calls")
put("AG-23_usage", f"WITH {COST} SELECT count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(cost) AS BIGINT) AS cost FROM costed", "calls")
_PART = lambda p: f"greatest(1, (n * {p} + 50) // 100 - CASE WHEN n * {p} % 100 = 50 AND (n * {p} // 100) % 2 = 0 THEN 1 ELSE 0 END)"
SPLIT = f"""sp AS (SELECT doc_id, lang, CASE WHEN r <= {_PART(60)} THEN 'train' WHEN r <= {_PART(60)} + {_PART(20)} THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY source, lang) AS n,
  row_number() OVER (PARTITION BY source, lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents))"""
put("WN-05_split", f"WITH {SPLIT} SELECT doc_id, split FROM sp")
put("AG-18_split_counts", f"WITH {SPLIT} SELECT split, lang, count(*) AS n FROM sp GROUP BY ALL")
put("SRC-04_manifest", "SELECT doc_type, count(*) AS n, min(doc_id) AS first_id FROM inv_docs GROUP BY doc_type", "inv_docs")
put("SRC-05_missing_truth", "SELECT d.doc_id, l.doc_id IS NOT NULL AS scored FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
put("SNK-03_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 = 1)")
put("SO-05_limit", "SELECT doc_id, doc_type FROM inv_docs ORDER BY doc_id LIMIT 25", "inv_docs")
