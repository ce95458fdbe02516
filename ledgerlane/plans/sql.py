"""The derived tables in plain SQL, written apart from the Spark code."""

AS_OF = "TIMESTAMP '1999-01-01 00:00:00'"
TODAY = "DATE '1999-01-01'"

USERS = """
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         c_custkey % 2 = 0 AS email_reminders,
         CASE n_regionkey WHEN 0 THEN 'Asia/Kolkata' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Europe/Paris'
              WHEN 3 THEN 'Europe/London' WHEN 4 THEN 'Asia/Jakarta' END AS timezone,
         c_custkey % 18 + 6 AS reminder_hour,
         CASE c_custkey % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'pending' END AS welcome_status,
         c_custkey % 7 AS welcome_attempts,
         CASE c_custkey % 3 WHEN 0 THEN TIMESTAMP '1999-01-01 00:01:00' WHEN 1 THEN TIMESTAMP '1998-12-31 23:59:00' END AS welcome_lease_until,
         CAST(DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at,
         n_regionkey AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""

BILLS = USERS + """,
lines AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice,
             l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1
),
bills0 AS (
  SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
         l_orderkey || '-' || l_linenumber AS id,
         CAST(o_custkey AS VARCHAR) AS user_id,
         p_name AS name, p_brand AS brand, s_name AS retailer,
         'INV-' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS invoice_number,
         'MD-' || l_partkey AS model_number,
         lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS barcode,
         CASE WHEN l_suppkey % 5 <> 0 THEN 'SN' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || l_linenumber END AS serial_number,
         CASE l_partkey % 6 WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Appliances' WHEN 2 THEN 'Furniture'
              WHEN 3 THEN 'Clothing' WHEN 4 THEN 'Other' END AS category,
         CAST(o_orderdate AS DATE) AS purchase_date,
         CASE WHEN p_size % 7 <> 0 THEN p_size END AS warranty_months,
         CASE l_returnflag WHEN 'R' THEN 30 WHEN 'A' THEN 7 END AS return_window_days,
         CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS purchase_price,
         CASE u.region WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' WHEN 4 THEN 'IDR' END AS currency,
         CAST(o_orderdate AS TIMESTAMP) AS created_at
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN users u ON CAST(o_custkey AS VARCHAR) = u.id
),
bills AS (
  SELECT *, CAST(purchase_date + to_months(warranty_months) AS DATE) AS warranty_expires_at,
         purchase_date + return_window_days AS return_expires_at FROM bills0
)"""

STATE = BILLS + """,
state AS (
  SELECT *, date_diff('day', DATE '1999-01-01', warranty_expires_at) AS days_left,
         CASE WHEN warranty_expires_at IS NULL THEN 'unknown'
              WHEN warranty_expires_at < DATE '1999-01-01' THEN 'expired'
              WHEN warranty_expires_at <= DATE '1999-01-31' THEN 'ending' ELSE 'active' END AS status FROM bills
)"""

PLANNED = BILLS + """,
deadlines AS (
  SELECT user_id, id AS item_id, 'warranty' AS deadline_type, warranty_expires_at AS expires FROM bills WHERE warranty_expires_at IS NOT NULL
  UNION ALL
  SELECT user_id, id, 'return', return_expires_at FROM bills WHERE return_expires_at IS NOT NULL
),
notices AS (
  SELECT d.*, u.email_reminders,
         timezone('UTC', timezone(u.timezone, CAST(expires - n AS TIMESTAMP) + to_hours(CAST(u.reminder_hour AS BIGINT)))) AS remind_at
  FROM deadlines d CROSS JOIN (VALUES (30), (7), (1)) t(n) JOIN users u ON u.id = d.user_id
),
channels AS (
  SELECT user_id, item_id, deadline_type, expires, remind_at, 'in_app' AS channel FROM notices
  UNION ALL
  SELECT user_id, item_id, deadline_type, expires, remind_at, 'email' FROM notices WHERE email_reminders
)"""

REMINDERS = PLANNED + """,
reminders AS (
  SELECT *, CASE WHEN channel = 'email' AND o % 13 = 0 THEN 'sent' WHEN o % 17 = 0 THEN 'cancelled' ELSE 'scheduled' END AS status,
         CASE WHEN channel = 'email' AND o % 13 = 0 THEN remind_at END AS sent_at,
         CASE WHEN o % 7 = 0 THEN remind_at + INTERVAL 72 HOUR END AS snoozed_until,
         CASE WHEN channel = 'email' AND (o % 13 = 0 OR o % 5 = 0) THEN remind_at END AS delivery_started_at,
         CASE WHEN channel = 'email' AND o % 10 = 0 THEN TIMESTAMP '1999-01-01 00:01:00'
              WHEN channel = 'email' AND o % 5 = 0 THEN TIMESTAMP '1998-12-31 23:59:00' END AS delivery_lease_until,
         item_id || '/' || deadline_type || '/' || CAST(epoch(remind_at) AS BIGINT) || '/' || channel AS id
  FROM (SELECT *, CAST(split_part(item_id, '-', 1) AS BIGINT) AS o FROM channels) WHERE remind_at > TIMESTAMP '1996-01-01 00:00:00'
)"""

DOCUMENTS = BILLS + """,
documents_d AS (
  SELECT id, user_id, CASE WHEN o % 3 <> 0 THEN id END AS item_id,
         invoice_number || CASE WHEN o % 2 = 0 THEN '.pdf' ELSE '.jpg' END AS original_filename,
         CASE WHEN o % 2 = 0 THEN 'application/pdf' ELSE 'image/jpeg' END AS content_type,
         o * 37 + 1000 AS byte_size, o,
         CASE WHEN o % 3 <> 0 THEN 'complete' WHEN o % 4 = 0 THEN 'pending' WHEN o % 4 = 1 THEN 'processing'
              WHEN o % 4 = 2 THEN 'review' ELSE 'failed' END AS ocr_status,
         o % 4 + 1 AS page_count,
         'users/' || user_id || '/documents/' || id AS storage_key, created_at FROM bills
)"""

PAGES = DOCUMENTS + """,
pages_d AS (
  SELECT user_id, id AS document_id, o, page_count, page_index,
         CASE WHEN o % 4 = 3 AND page_index = page_count - 1 THEN 'processing' ELSE 'complete' END AS status
  FROM (SELECT *, unnest(range(0, page_count)) AS page_index FROM documents_d)
)"""

JOBS = BILLS + """,
jobs AS (
  SELECT id AS document_id, user_id, o % 4 + 1 AS generation,
         CASE o % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'reading' WHEN 2 THEN 'extracting' WHEN 3 THEN 'complete' ELSE 'failed' END AS status,
         o % 3 AS completed_pages,
         CASE WHEN o % 3 <> 0 THEN TIMESTAMP '1999-01-01' - to_minutes(o % 23) END AS dispatched_at,
         TIMESTAMP '1999-01-01' - to_seconds(o % 2000) AS updated_at FROM bills
)"""


def with_(tables: str, select: str) -> str:
    select = select.strip()
    return f"WITH {tables}{select}" if select.startswith(",") else f"WITH {tables}\n{select}"
