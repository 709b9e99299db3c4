"""Documents, orders and ledgers derived from the driver's tables.

Each view is one SELECT that Spark SQL and DuckDB read alike. Money is in kuruş (suffix _k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

VIEWS = {
    "inv_items": """
      SELECT l_orderkey AS doc_id,
        cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS bigint) AS pos,
        l_partkey AS partkey, l_suppkey AS suppkey, concat('SKU-', cast(l_partkey AS varchar(20))) AS sku,
        cast(l_quantity AS bigint) AS qty,
        cast(floor(l_extendedprice / l_quantity * 100 + 0.5) AS bigint) AS price_k,
        cast(floor(l_extendedprice * l_discount * 100 + 0.5) AS bigint) * CASE WHEN l_partkey % 71 = 0 THEN -1 ELSE 1 END AS disc_k,
        cast(l_quantity AS bigint) * cast(floor(l_extendedprice / l_quantity * 100 + 0.5) AS bigint)
          - cast(floor(l_extendedprice * l_discount * 100 + 0.5) AS bigint) * CASE WHEN l_partkey % 71 = 0 THEN -1 ELSE 1 END
          + CASE WHEN l_partkey % 50 = 0 THEN 100 ELSE 0 END AS total_k
      FROM lineitem""",
    "tax_ids": """
      SELECT suppkey, name, CASE WHEN suppkey % 5 = 1 THEN concat('TR TIN ', id) WHEN suppkey % 5 = 2 THEN concat(substr(id, 1, 3), '.', substr(id, 4, 20))
        WHEN suppkey % 5 = 3 AND suppkey % 2 = 0 THEN substr(id, 1, 9) WHEN suppkey % 11 = 0 THEN 'DE123456789' WHEN suppkey % 13 = 0 THEN '12345678950'
        ELSE id END AS tax_id, id AS plain
      FROM (SELECT s_suppkey AS suppkey, s_name AS name,
          lpad(cast(s_suppkey * 7919 % 1000000000 AS varchar(20)), 9, '0') || CASE WHEN s_suppkey % 7 = 0 THEN '0' ELSE cast(s_suppkey % 10 AS varchar(20)) END AS id
        FROM supplier) s""",
    "inv_docs": """
      SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'po' WHEN 1 THEN 'receipt' ELSE 'invoice' END AS doc_type,
        CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE concat('GIB2026', lpad(cast(o_orderkey AS varchar(20)), 9, '0')) END AS number,
        CASE o_orderkey % 7 WHEN 0 THEN '15.08.2026' WHEN 1 THEN '2026-02-30' WHEN 2 THEN '1999-12-31' WHEN 3 THEN NULL WHEN 4 THEN '2026-08-15'
          ELSE substr(cast(cast(o_orderdate AS date) AS varchar(20)), 1, 10) END AS date_text,
        CASE o_orderkey % 4 WHEN 0 THEN 'TRY' WHEN 1 THEN 'TL' WHEN 2 THEN 'USD' ELSE NULL END AS currency,
        CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE t.name END AS party, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE t.tax_id END AS tax_id,
        coalesce(i.sum_k, 0) + CASE WHEN o_orderkey % 41 = 0 THEN 500 ELSE 0 END AS sub_k,
        CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN -1 ELSE 1 END * CASE WHEN o_orderkey % 61 = 0 THEN coalesce(i.sum_k, 0)
          ELSE cast(floor((coalesce(i.sum_k, 0) * 18 + 50) / 100) AS bigint) END AS tax_k,
        CASE WHEN o_orderkey % 47 = 0 OR o_orderkey % 67 = 0 THEN NULL ELSE coalesce(i.sum_k, 0) + cast(floor((coalesce(i.sum_k, 0) * 18 + 50) / 100) AS bigint)
          + CASE WHEN o_orderkey % 37 = 0 THEN 7 ELSE 0 END + CASE WHEN o_orderkey % 997 = 0 THEN 2000000000 ELSE 0 END END AS amount_k,
        coalesce(i.n, 0) AS n_items, CASE o_orderkey % 9 WHEN 0 THEN '31/12/2026' WHEN 1 THEN '2026-13-01' WHEN 2 THEN '2031-01-05' WHEN 3 THEN '2026-09-30' ELSE NULL END AS due_text,
        CASE WHEN o_orderkey % 16 = 5 THEN '01.02.2026' WHEN o_orderkey % 16 = 6 THEN '2026-02-01' ELSE NULL END AS delivery_text,
        CASE WHEN o_orderkey % 67 = 0 THEN 'oops' ELSE NULL END AS amount_text, CASE WHEN o_orderkey % 71 = 0 THEN 'n/a' ELSE NULL END AS tax_text,
        CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 73 = 0 THEN '-' ELSE NULL END AS change_text,
        CASE WHEN o_orderkey % 5 <> 1 OR o_orderkey % 73 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN -250 ELSE 500 END AS change_k,
        CASE WHEN o_orderkey % 4 = 2 THEN b.tax_id ELSE NULL END AS buyer_tax_id
      FROM orders o LEFT JOIN (SELECT doc_id, cast(sum(total_k) AS bigint) AS sum_k, count(*) AS n FROM inv_items GROUP BY doc_id) i ON o.o_orderkey = i.doc_id
        LEFT JOIN tax_ids t ON t.suppkey = o.o_custkey % 97 + 1
        LEFT JOIN tax_ids b ON b.suppkey = o.o_custkey % 89 + 1""",
    "ledger": """
      SELECT cast((l_orderkey * 8 + l_linenumber) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS bigint) AS row_id, l_orderkey AS orderkey, l_linenumber AS line,
        cast(l_suppkey AS varchar(20)) AS supplier, concat('GIB2026', lpad(cast(l_orderkey * 8 + l_linenumber AS varchar(20)), 9, '0')) AS doc_number,
        cast(l_shipdate AS date) AS issue_date, cast(floor(l_extendedprice * 100 + 0.5) AS bigint) AS amount_key,
        CASE l_linenumber % 3 WHEN 0 THEN 'efatura' WHEN 1 THEN 'email_pdf' ELSE 'photo' END AS channel
      FROM lineitem""",
    "incoming": """
      SELECT row_id AS doc_id, supplier, amount_key, 'email_pdf' AS channel,
        CASE (orderkey + line) % 3 WHEN 0 THEN concat(' gib-2026/', lpad(cast(orderkey * 8 + line AS varchar(20)), 9, '0')) WHEN 1 THEN concat('GIB-', cast(orderkey * 8 + line AS varchar(20)))
          ELSE concat('X', cast(row_id AS varchar(20)), '7') END AS doc_number,
        CASE WHEN orderkey % 11 = 0 THEN NULL ELSE date_add(issue_date, cast(orderkey % 20 AS int)) END AS issue_date
      FROM ledger WHERE orderkey % 10 = 0""",
    "recurring": """
      SELECT s_suppkey * 10 + k AS row_id, cast(s_suppkey AS varchar(20)) AS supplier, 2400 AS amount_key,
        date_add(DATE '2026-01-13', cast(k * (25 + s_suppkey % 13) AS int)) AS issue_date
      FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks
      WHERE k < 2 + s_suppkey % 4""",
    "po_items": """
      SELECT doc_id, pos, sku, partkey, qty + CASE WHEN partkey % 13 = 0 THEN 1 ELSE 0 END AS qty,
        CASE WHEN partkey % 11 = 0 THEN cast(floor(price_k * 1.05 + 0.5) AS bigint) ELSE price_k END AS price_k,
        CASE WHEN partkey % 29 = 0 THEN NULL ELSE total_k END AS total_k
      FROM inv_items WHERE partkey % 17 <> 0
      UNION ALL
      SELECT doc_id, pos + 1000 AS pos, concat('PO-', sku) AS sku, partkey, qty, price_k, total_k FROM inv_items WHERE partkey % 19 = 0""",
    "fields": """
      SELECT o_orderkey AS doc_id, o_orderkey % 3 AS kind, path,
        CASE path WHEN 'vendor_name' THEN concat('  Vendor ', cast(o_custkey AS varchar(20)), ' Ltd') WHEN 'currency' THEN o_orderstatus WHEN 'receipt_number' THEN 'r'
          WHEN 'total_amount' THEN cast(cast(floor(o_totalprice * 100 + 0.5) AS bigint) AS varchar(20)) WHEN 'tax_rate' THEN '0.18' ELSE o_orderpriority END AS truth,
        CASE WHEN o_orderkey % 17 = 0 AND path <> 'vendor_name' THEN NULL WHEN path = 'vendor_name' THEN concat('vendor  ', cast(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS varchar(20)), ' LTD ')
          WHEN path = 'currency' THEN CASE WHEN o_orderkey % 6 = 0 THEN 'Z' ELSE o_orderstatus END WHEN path = 'receipt_number' THEN 'q'
          WHEN path = 'total_amount' THEN cast(cast(floor(o_totalprice * 100 + 0.5) AS bigint) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS varchar(20))
          WHEN path = 'tax_rate' THEN CASE o_orderkey % 4 WHEN 0 THEN '0.1805' WHEN 1 THEN '0.2' ELSE '0.18' END
          ELSE CASE WHEN o_orderkey % 8 = 0 THEN substr(o_orderpriority, 1, 3) ELSE o_orderpriority END END AS predicted
      FROM orders CROSS JOIN (SELECT 'vendor_name' AS path UNION ALL SELECT 'currency' UNION ALL SELECT 'total_amount' UNION ALL SELECT 'tax_rate'
        UNION ALL SELECT 'receipt_number' UNION ALL SELECT 'notes') p""",
    "passes": """
      SELECT doc_id, pos, pass, CASE WHEN partkey % 3 = pass THEN qty + 1 ELSE qty END AS qty, CASE WHEN partkey % 5 = pass THEN price_k + 10 ELSE price_k END AS price_k,
        CASE WHEN partkey % 4 = pass THEN concat(sku, ' ') WHEN partkey % 4 = 3 THEN lower(sku) ELSE sku END AS description
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM inv_items) i CROSS JOIN (SELECT 0 AS pass UNION ALL SELECT 1 UNION ALL SELECT 2) ps WHERE pos < greatest(n, 8) - pass""",
    "inv_lines": """
      SELECT doc_id, pos, CASE WHEN partkey % 23 = 0 THEN NULL ELSE sku END AS sku, partkey, qty, price_k, total_k,
        CASE WHEN partkey % 23 = 0 THEN repeat(chr(cast(97 + partkey % 26 AS int)), 12) WHEN partkey % 31 = 0 THEN '111111111111' ELSE NULL END AS description FROM inv_items""",
    "po_lines": """
      SELECT doc_id, pos, CASE WHEN partkey % 23 = 0 AND pos < 1000 THEN NULL ELSE sku END AS sku, partkey, qty, price_k, total_k,
        CASE WHEN pos >= 1000 THEN NULL WHEN partkey % 23 = 0 THEN repeat(chr(cast(97 + partkey % 26 AS int)), 12) WHEN partkey % 31 = 0 THEN '000000000000' ELSE NULL END AS description FROM po_items""",
    "calls": """
      SELECT event_id, user_id, CASE user_id % 5 WHEN 0 THEN 'gpt-5-nano' WHEN 1 THEN 'gpt-5-mini' WHEN 2 THEN 'gpt-4.1-nano' WHEN 3 THEN 'gpt-4o-mini' ELSE 'other' END AS model,
        event_type <> 'error' AND event_id % 9 <> 0 AS success, cast(floor(value * 100 + 0.5) AS bigint) AS elapsed_c, event_id * 37 % 5000 AS tokens_in, event_id * 11 % 900 AS tokens_out
      FROM events""",
}
#: The views that each view reads, itself last.
NEEDS = {"inv_docs": ("inv_items", "tax_ids"), "incoming": ("ledger",), "po_items": ("inv_items",), "passes": ("inv_items",), "inv_lines": ("inv_items",), "po_lines": ("inv_items", "po_items")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = [t for t in (*VIEWS, *TABLES) if t != name and _reads(text, t)]
    for t in used:
        text = _replaced(text, t)
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in used})


def _pattern(t: str):
    import re

    return re.compile(rf"\b(FROM|JOIN)(\s+){t}\b")


def _reads(text: str, t: str) -> bool:
    return bool(_pattern(t).search(text))


def _replaced(text: str, t: str) -> str:
    return _pattern(t).sub(rf"\1\2{{{t}}}", text)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it reads as common table expressions."""
    order = list(dict.fromkeys(v for n in names for v in (*NEEDS.get(n, ()), n)))
    ctes = [f"{n} AS ({_duck(VIEWS[n])})" for n in order]
    body = sql.strip()
    joiner = ", " + body[5:] if body[:5].upper() == "WITH " else " " + body
    return "WITH " + ", ".join(ctes) + joiner


def _duck(text: str) -> str:
    import re

    return re.sub(r"date_add\(([^,()]+(?:'[^']*')?), cast\(([^)]*(?:\([^)]*\))?[^)]*) AS int\)\)", r"(\1 + cast(\2 AS int))", text)
