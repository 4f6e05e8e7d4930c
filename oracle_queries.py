"""The same results as ``queries()`` in plain SQL over the driver's views, for the correctness gate."""

from __future__ import annotations

BINDING = """
a_customers AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_custkey % 17 = 3 THEN NULL ELSE c_name END AS name,
         CASE WHEN c_custkey % 29 = 5 THEN NULL
              ELSE 'user' || CAST(CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 9 ELSE c_custkey END AS VARCHAR)
                   || '@example.com' END AS email,
         created_at
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) f
    ON o_custkey = c_custkey),
a_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
         CASE WHEN p_partkey % 40 = 7 THEN NULL ELSE p_size <= 45 END AS active
  FROM part),
a_orders AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_orderkey % 61 = 7 THEN NULL WHEN o_orderkey % 37 = 0 THEN o_custkey + 1000000000
              ELSE o_custkey END AS customer_id,
         product_id, CASE WHEN o_orderkey % 79 <> 6 THEN o_orderdate END AS order_date,
         CASE WHEN o_orderkey % 59 = 4 THEN 'Shipped' WHEN o_orderkey % 43 = 11 THEN 'Cancelled' WHEN o_orderstatus = 'F' THEN 'Completed'
              WHEN o_orderstatus = 'O' THEN 'Pending' ELSE 'Processing' END AS status,
         CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS total_amount
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS product_id FROM lineitem GROUP BY l_orderkey) l
    ON l_orderkey = o_orderkey),
a_payments AS (
  SELECT o_orderkey * 2 AS payment_id,
         CASE WHEN o_orderkey % 97 = 13 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS order_id,
         o_orderdate AS payment_date,
         CAST(CASE WHEN o_orderkey % 83 = 2 THEN NULL
              WHEN o_orderkey % 19 = 4 THEN CAST(o_totalprice AS DECIMAL(12,2)) - 100.25
              WHEN o_orderkey % 31 = 8 THEN CAST(o_totalprice AS DECIMAL(12,2)) + 50.50
              ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS payment_amount,
         CASE WHEN o_orderkey % 67 = 9 THEN 'Refunded' WHEN o_orderkey % 13 = 6 THEN 'Failed' WHEN o_orderkey % 13 = 9 THEN 'Pending' ELSE 'Paid' END
           AS payment_status
  FROM orders WHERE o_orderkey % 23 <> 1
  UNION ALL
  SELECT o_orderkey * 2 + 1, o_orderkey, o_orderdate, CAST(10.00 AS DECIMAL(12,2)), 'Paid'
  FROM orders WHERE o_orderkey % 71 = 5)
"""

# Shared steps: reference tests written as NOT EXISTS / IN, as the audit states them.
SHARED = """
dup_emails AS (SELECT email FROM a_customers WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1),
no_customer AS (SELECT * FROM a_orders o
  WHERE NOT EXISTS (SELECT 1 FROM a_customers c WHERE c.customer_id = o.customer_id)),
unpaid AS (SELECT * FROM a_orders o WHERE status = 'Completed'
  AND NOT EXISTS (SELECT 1 FROM a_payments p WHERE p.order_id = o.order_id)),
lost AS (SELECT * FROM a_payments p WHERE NOT EXISTS (SELECT 1 FROM a_orders o WHERE o.order_id = p.order_id)),
mismatch AS (
  SELECT o.order_id, o.customer_id, o.order_date, o.total_amount, p.payment_amount,
         p.payment_amount - o.total_amount AS diff
  FROM a_orders o JOIN a_payments p ON p.order_id = o.order_id
  WHERE p.payment_status = 'Paid' AND o.total_amount IS NOT NULL
    AND abs(p.payment_amount - o.total_amount) > 0),
inactive AS (SELECT o.*, pr.product_name, pr.price, pr.active
  FROM a_orders o JOIN a_products pr ON pr.product_id = o.product_id WHERE pr.active = FALSE),
bad_customers AS (SELECT customer_id FROM a_customers WHERE name IS NULL
  UNION SELECT customer_id FROM a_customers SEMI JOIN dup_emails USING (email)),
bad_orders AS (SELECT order_id FROM no_customer UNION SELECT order_id FROM unpaid
  UNION SELECT order_id FROM a_orders WHERE total_amount IS NULL),
counts AS (
  SELECT 'customers' AS table_name, (SELECT count(*) FROM a_customers) AS total,
         (SELECT count(*) FROM bad_customers) AS bad
  UNION ALL SELECT 'orders', (SELECT count(*) FROM a_orders), (SELECT count(*) FROM bad_orders)
  UNION ALL SELECT 'payments', (SELECT count(*) FROM a_payments), (SELECT count(*) FROM lost)),
risk AS (
  SELECT 'Completed orders without payment' AS category, count(*) AS n, coalesce(sum(total_amount), 0) AS amount
  FROM unpaid
  UNION ALL SELECT 'Underpaid orders', count(*), sum(-diff) FROM mismatch WHERE diff < 0
  UNION ALL SELECT 'Overpaid orders', count(*), sum(diff) FROM mismatch WHERE diff > 0
  UNION ALL SELECT 'Orphan payments', count(*), sum(payment_amount) FROM lost),
wide AS (
  SELECT o.order_id, o.customer_id, c.name AS customer_name, o.order_date, o.status, o.total_amount,
         CAST(coalesce(p.payment_amount, 0) AS DECIMAL(12,2)) AS paid_amount, pr.product_name,
         pr.active AS product_active,
         CASE WHEN o.order_id IN (SELECT order_id FROM no_customer) THEN 1 ELSE 0 END AS no_customer,
         CASE WHEN o.order_id IN (SELECT order_id FROM unpaid) THEN 1 ELSE 0 END AS no_payment,
         CASE WHEN p.payment_id IS NOT NULL AND o.total_amount IS NOT NULL
               AND abs(p.payment_amount - o.total_amount) > 0 THEN 1 ELSE 0 END AS amount_mismatch,
         CASE WHEN o.total_amount IS NULL THEN 1 ELSE 0 END AS null_total,
         CASE WHEN pr.active = FALSE THEN 1 ELSE 0 END AS inactive_product,
         CAST(CASE WHEN p.payment_id IS NOT NULL AND o.total_amount IS NOT NULL
              THEN p.payment_amount - o.total_amount END AS DECIMAL(13,2)) AS diff
  FROM a_orders o
  LEFT JOIN a_customers c ON c.customer_id = o.customer_id
  LEFT JOIN a_payments p ON p.order_id = o.order_id AND p.payment_status = 'Paid'
  LEFT JOIN a_products pr ON pr.product_id = o.product_id)
"""


def audit(select: str, *steps: str) -> str:
    """A statement over the bound ledger and the shared steps."""
    return "WITH " + ",\n".join([BINDING.strip(), SHARED.strip(), *[s.strip() for s in steps]]) + "\n" + select.strip()


def pct(bad: str, total: str) -> str:
    """round(100 * bad / total, 2), half up, in whole-number arithmetic; NULL when total is 0."""
    return f"CASE WHEN {total} > 0 THEN CAST((20000 * ({bad}) + {total}) // (2 * {total}) AS DOUBLE) / 100 END"


def score(bad: str, total: str) -> str:
    return pct(f"{total} - ({bad})", total)


def n(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def money(expression: str) -> str:
    return f"CAST({expression} AS DECIMAL(24,2))"


SCORES = f"""scores AS (SELECT table_name, {n('total')} AS total, {n('bad')} AS bad,
  {pct('bad', 'total')} AS pct, {score('bad', 'total')} AS score FROM counts)"""
MEAN = "CAST((2 * sum(CAST(round(score * 100) AS BIGINT)) + 3) // 6 AS DOUBLE) / 100"
TOTAL_RISK = "total_risk AS (SELECT sum(n) AS n, sum(amount) AS amount FROM risk)"


def _groups(columns: str) -> str:
    return audit(f"""SELECT {columns} FROM a_customers WHERE email IS NOT NULL
        GROUP BY email HAVING count(*) > 1""")


IDS = "string_agg(CAST(customer_id AS VARCHAR), ', ' ORDER BY customer_id) AS ids"
SEEN = "min(created_at) AS first_seen, max(created_at) AS last_seen"
GROUP_N = f"email, {n('count(*)')} AS n, {n('count(*) - 1')} AS n_extra"
DIFF_PCT = """CAST(CASE WHEN total_amount <> 0 THEN
    CAST((20000 * CAST(abs(diff) * 100 AS BIGINT) + CAST(total_amount * 100 AS BIGINT))
    // (2 * CAST(total_amount * 100 AS BIGINT)) AS DOUBLE) / 100 END AS DOUBLE)"""


def _census(checks: list[str]) -> str:
    parts = [f"SELECT '{c}' AS check_name, {n('count(*)')} AS n FROM a_{c.split('.')[0]} "
             f"WHERE {c.split('.')[1]} IS NULL" for c in checks]
    return audit("\nUNION ALL ".join(parts))


REPORT_LINES = [
    (1, "Ledger", "customers", "count", "SELECT count(*) FROM a_customers"),
    (1, "Ledger", "products", "count", "SELECT count(*) FROM a_products"),
    (1, "Ledger", "orders", "count", "SELECT count(*) FROM a_orders"),
    (1, "Ledger", "payments", "count", "SELECT count(*) FROM a_payments"),
    (1, "Ledger", "gross revenue", "money",
     "SELECT coalesce(sum(total_amount), 0) FROM a_orders WHERE status = 'Completed'"),
    (2, "Duplicate emails", "customers", "count", "SELECT count(*) FROM a_customers"),
    (2, "Duplicate emails", "affected", "count",
     "SELECT count(*) FROM a_customers WHERE email IN (SELECT email FROM dup_emails)"),
    (2, "Duplicate emails", "affected pct", "percent",
     f"SELECT {pct('count(*) FILTER (WHERE email IN (SELECT email FROM dup_emails))', 'count(*)')} "
     "FROM a_customers"),
    (3, "Referential integrity", "orders", "count", "SELECT count(*) FROM a_orders"),
    (3, "Referential integrity", "without customer", "count", "SELECT count(*) FROM no_customer"),
    (3, "Referential integrity", "without customer pct", "percent",
     f"SELECT {pct('(SELECT count(*) FROM no_customer)', 'count(*)')} FROM a_orders"),
    (4, "Completed without payment", "orders", "count", "SELECT count(*) FROM unpaid"),
    (4, "Completed without payment", "revenue at risk", "money",
     "SELECT coalesce(sum(total_amount), 0) FROM unpaid"),
    (5, "Orphan payments", "payments", "count", "SELECT count(*) FROM lost"),
    (5, "Orphan payments", "unreconciled", "money", "SELECT coalesce(sum(payment_amount), 0) FROM lost"),
    (6, "Amount mismatch", "payments", "count", "SELECT count(*) FROM mismatch"),
    (6, "Amount mismatch", "total difference", "money", "SELECT sum(abs(diff)) FROM mismatch"),
    (6, "Amount mismatch", "overpaid", "money",
     "SELECT sum(CASE WHEN diff > 0 THEN diff ELSE 0 END) FROM mismatch"),
    (6, "Amount mismatch", "underpaid", "money",
     "SELECT sum(CASE WHEN diff < 0 THEN -diff ELSE 0 END) FROM mismatch"),
    (7, "Missing critical fields", "customers.name", "count",
     "SELECT count(*) FROM a_customers WHERE name IS NULL"),
    (7, "Missing critical fields", "customers.email", "count",
     "SELECT count(*) FROM a_customers WHERE email IS NULL"),
    (7, "Missing critical fields", "orders.total_amount", "count",
     "SELECT count(*) FROM a_orders WHERE total_amount IS NULL"),
    (8, "Discontinued products", "orders", "count", "SELECT count(*) FROM inactive"),
    (8, "Discontinued products", "amount", "money", "SELECT coalesce(sum(total_amount), 0) FROM inactive"),
    (9, "Quality score", "customers", "percent", "SELECT score FROM scores WHERE table_name = 'customers'"),
    (9, "Quality score", "orders", "percent", "SELECT score FROM scores WHERE table_name = 'orders'"),
    (9, "Quality score", "payments", "percent", "SELECT score FROM scores WHERE table_name = 'payments'"),
    (9, "Quality score", "global", "percent", f"SELECT {MEAN} FROM scores"),
    *[(9, "Quality score", f"{t} {metric}", kind, f"SELECT {value} FROM scores WHERE table_name = '{t}'")
      for t in ("customers", "orders", "payments")
      for metric, kind, value in (("records", "count", "total"), ("with problems", "count", "bad"),
                                  ("with problems pct", "percent", "pct"))],
    *[(10, "Revenue at risk", f"{c}{more}", kind, f"SELECT {value} FROM risk WHERE category = '{c}'")
      for c in ("Completed orders without payment", "Underpaid orders", "Overpaid orders", "Orphan payments")
      for more, kind, value in (("", "money", "coalesce(amount, 0)"), (": records", "count", "n"))],
    (10, "Revenue at risk", "total", "money", "SELECT sum(amount) FROM risk"),
]


def _report(more: str = "") -> str:
    parts = [f"SELECT CAST({s} AS INTEGER) AS section, '{title}' AS title, '{metric}' AS metric, "
             f"'{kind}' AS kind, {money(f'({value})')} AS value_num" for s, title, metric, kind, value in REPORT_LINES]
    lines = "lines AS (" + "\nUNION ALL ".join(parts) + ")"
    return audit("""SELECT *, CASE WHEN value_num IS NULL THEN 'N/A'
        WHEN kind = 'count' THEN CAST(CAST(value_num AS BIGINT) AS VARCHAR)
        WHEN kind = 'percent' THEN CAST(value_num AS VARCHAR) || '%'
        ELSE '$ ' || format('{:,}', CAST(round(value_num) AS BIGINT)) || ' COP' END AS value_text FROM lines""" + more,
                 SCORES, lines)


# The head and the list of shared emails around the figures.
REPORT_REST = f"""
    UNION ALL SELECT 0, 'Audit report', metric, 'text', NULL, value FROM (VALUES
      ('generated', '2024-01-15 06:30:00'), ('scope', 'Customers, Products, Orders, Payments'),
      ('period from', (SELECT strftime(min(order_date), '%Y-%m-%d') FROM a_orders)),
      ('period to', (SELECT strftime(max(order_date), '%Y-%m-%d') FROM a_orders))) v(metric, value)
    UNION ALL SELECT 2, 'Duplicate emails', email, 'detail', {money('count(*)')},
      string_agg(name, ' | ' ORDER BY customer_id)
      FROM a_customers WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1"""


EXPORT_SOURCES = {
    "01_emails_duplicados": "dup_emails", "02_ordenes_sin_cliente": "no_customer",
    "03_completadas_sin_pago": "unpaid", "04_pagos_huerfanos": "lost", "05_diferencia_monetaria": "mismatch",
    "06_revenue_at_risk": "risk", "07_data_quality_score": "counts",
    "08_campos_nulos_criticos": "(VALUES (1), (2), (3)) v(i)",
    "09_ordenes_producto_inactivo": "inactive", "10_auditoria_consolidada": "wide"}

# Headers and wording of the ten published files, each with the columns its rows are read from.
EXPORT_FILES = {
    "01_emails_duplicados": ("email,total_ocurrencias,duplicados_extra,customer_ids,primer_registro,ultimo_duplicado",
        """SELECT email, count(*), count(*) - 1, string_agg(CAST(customer_id AS VARCHAR), ', ' ORDER BY customer_id),
           min(created_at), max(created_at) FROM a_customers WHERE email IS NOT NULL GROUP BY email
           HAVING count(*) > 1"""),
    "02_ordenes_sin_cliente": (
        "order_id,customer_id_referenciado,order_date,status,total_amount,descripcion_problema",
        "SELECT order_id, customer_id, order_date, status, total_amount, 'Cliente no existe' FROM no_customer"),
    "03_completadas_sin_pago": ("order_id,customer_id,nombre_cliente,order_date,total_amount,descripcion_problema",
        """SELECT u.order_id, u.customer_id, c.name, u.order_date, u.total_amount, 'Completada sin pago'
           FROM unpaid u LEFT JOIN a_customers c ON c.customer_id = u.customer_id"""),
    "04_pagos_huerfanos": (
        "payment_id,order_id_referenciado,payment_date,payment_amount,payment_status,descripcion_problema",
        "SELECT payment_id, order_id, payment_date, payment_amount, payment_status, 'Orden no existe' FROM lost"),
    "05_diferencia_monetaria": ("order_id,customer_id,nombre_cliente,order_date,monto_orden,monto_pagado,"
        "discrepancia_cop,tipo_discrepancia,discrepancia_pct",
        """SELECT m.order_id, m.customer_id, c.name, m.order_date, total_amount, payment_amount,
           CAST(diff AS DECIMAL(13,2)), CASE WHEN diff > 0 THEN 'Overpaid' ELSE 'Underpaid' END, {pct}
           FROM mismatch m LEFT JOIN a_customers c ON c.customer_id = m.customer_id"""),
    "06_revenue_at_risk": ("categoria_riesgo,registros_afectados,monto_riesgo_cop",
        """SELECT CASE category WHEN 'Completed orders without payment' THEN 'Completadas sin pago'
             WHEN 'Underpaid orders' THEN 'Underpaid (deficit cobro)'
             WHEN 'Overpaid orders' THEN 'Overpaid (pasivo devolucion)' ELSE 'Pagos huerfanos no conciliados' END,
           CAST(n AS BIGINT), CAST(amount AS DECIMAL(24,2)) FROM risk"""),
    "07_data_quality_score": ("nombre_tabla,total_registros,registros_con_problemas,pct_con_problemas,quality_score",
        "SELECT table_name, total, bad, pct, score FROM scores"),
    "08_campos_nulos_criticos": ("verificacion,registros_afectados",
        """SELECT 'customers.name nulo', count(*) FROM a_customers WHERE name IS NULL
           UNION ALL SELECT 'customers.email nulo', count(*) FROM a_customers WHERE email IS NULL
           UNION ALL SELECT 'orders.total_amount nulo', count(*) FROM a_orders WHERE total_amount IS NULL"""),
    "09_ordenes_producto_inactivo": ("order_id,customer_id,nombre_cliente,order_date,status,total_amount,product_id,"
        "product_name,precio_producto,descripcion_problema",
        """SELECT i.order_id, i.customer_id, c.name, i.order_date, i.status, i.total_amount, i.product_id,
           i.product_name, i.price, 'Producto descontinuado'
           FROM inactive i LEFT JOIN a_customers c ON c.customer_id = i.customer_id"""),
    "10_auditoria_consolidada": ("order_id,customer_id,nombre_cliente,order_date,status,total_amount,monto_pagado,"
        "product_name,producto_activo,flag_cliente_inexistente,flag_sin_pago,flag_monto_desajustado,flag_total_nulo,"
        "flag_producto_inactivo,discrepancia_cop", "SELECT * FROM wide"),
}


def _export_gate() -> str:
    """Header, rows and digest of each file: the sum of 48 bits of each row's MD5."""
    parts = []
    for name, (header, select) in EXPORT_FILES.items():
        columns = [f"c{k}" for k in range(header.count(",") + 1)]
        text = "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in columns) + ")"
        parts.append(f"""SELECT '{name}' AS name, '{header}' AS header, {n('count(*)')} AS rows,
            CAST(coalesce(sum(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)), 0) AS VARCHAR) AS digest,
            'OK' AS status FROM ({select.replace('{pct}', DIFF_PCT)}) f({', '.join(columns)})""")
    return audit("\nUNION ALL ".join(parts), SCORES)


RULES = """tagged AS (SELECT order_id, customer_id, status, total_amount,
    concat_ws(', ',
      CASE WHEN order_id IN (SELECT order_id FROM unpaid) THEN 'completed_without_payment' END,
      CASE WHEN order_id IN (SELECT order_id FROM inactive) THEN 'inactive_product' END,
      CASE WHEN order_id IN (SELECT order_id FROM no_customer) THEN 'unknown_customer' END,
      CASE WHEN total_amount IS NULL THEN 'null_total' END) AS broken
    FROM a_orders)"""

# The rule table's rules: (rule, table, kind, condition under which a row breaks it).
RULE_FAULTS = [
    ("customer has a name", "a_customers", "not_null", "name IS NULL"),
    ("email is unique", "a_customers", "unique", "email IN (SELECT email FROM dup_emails)"),
    ("price is positive", "a_products", "condition", "NOT price > 0"),
    ("product state is known", "a_products", "not_null", "active IS NULL"),
    ("product was sold", "a_products", "has_child",
     "NOT EXISTS (SELECT 1 FROM a_orders x WHERE x.product_id = t.product_id)"),
    ("order has a total", "a_orders", "not_null", "total_amount IS NULL"),
    ("order has a customer", "a_orders", "references", "order_id IN (SELECT order_id FROM no_customer)"),
    ("order status is known", "a_orders", "domain", "status NOT IN ('Pending', 'Processing', 'Completed', 'Cancelled')"),
    ("completed order has a payment", "a_orders", "has_child", "order_id IN (SELECT order_id FROM unpaid)"),
    ("order in progress has a payment", "a_orders", "has_child",
     "status = 'Processing' AND NOT EXISTS (SELECT 1 FROM a_payments x WHERE x.order_id = t.order_id)"),
    ("ordered product exists", "a_orders", "foreign_key", "product_id IS NOT NULL AND "
     "NOT EXISTS (SELECT 1 FROM a_products x WHERE x.product_id = t.product_id)"),
    ("payment has an order", "a_payments", "references",
     "NOT EXISTS (SELECT 1 FROM a_orders x WHERE x.order_id = t.order_id)"),
    ("payment status is known", "a_payments", "domain", "payment_status NOT IN ('Paid', 'Failed', 'Pending')"),
    ("confirmed payment is of 1000 at least", "a_payments", "condition",
     "payment_status = 'Paid' AND NOT payment_amount >= 1000"),
    ("line has a supplier", "lineitem", "references", "l_suppkey IS NULL OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier)"),
    ("line's product was ordered", "lineitem", "has_child",
     "l_quantity > 10 AND NOT EXISTS (SELECT 1 FROM a_orders x WHERE x.product_id = t.l_partkey)"),
    ("line is unique", "lineitem", "unique", "l_discount > 0.08 AND l_orderkey IN "
     "(SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)"),
]


def _rule_tables() -> dict[str, list[tuple[str, str, str]]]:
    by: dict[str, list] = {}
    for rule, table, kind, fault in RULE_FAULTS:
        by.setdefault(table, []).append((rule, kind, fault))
    return by


def _rule_scores() -> str:
    parts = []
    for table, own in _rule_tables().items():
        any_fault = " OR ".join(f"coalesce({fault}, false)" for *_, fault in own)
        parts.append(f"SELECT '{table.removeprefix('a_')}' AS table_name, count(*) AS total, "
                     f"count(*) FILTER ({any_fault}) AS bad FROM {table} t")
    ruled = "ruled AS (" + "\nUNION ALL ".join(parts) + ")"
    return audit(f"""SELECT table_name, {n('total')} AS total, {n('bad')} AS bad, {pct('bad', 'total')} AS pct,
        {score('bad', 'total')} AS score FROM ruled""", ruled)


def _rule_counts() -> str:
    parts = [f"SELECT '{table.removeprefix('a_')}' AS table_name, '{rule.replace(chr(39), chr(39) * 2)}' AS rule, "
             f"'{kind}' AS kind, count(*) FILTER ({fault}) AS n, count(*) AS total FROM {table} t"
             for rule, table, kind, fault in RULE_FAULTS]
    return audit(f"SELECT table_name, rule, kind, {n('n')} AS n, {pct('n', 'total')} AS pct FROM ("
                 + "\nUNION ALL ".join(parts) + ")")


def _rule_violations() -> str:
    names = ", ".join(f"CASE WHEN {fault} THEN '{rule}' END" for rule, _, fault in _rule_tables()["a_orders"])
    return audit(f"SELECT * FROM (SELECT order_id, status, concat_ws(', ', {names}) AS broken FROM a_orders t) "
                 "WHERE broken <> ''")


CUT = "TIMESTAMP '1998-07-01 00:00:00'"


def _as_of(alias: str, cut: str | None) -> str:
    """Scorecard counts of the ledger before a moment, as steps named with a prefix."""
    def before(table: str, column: str) -> str:
        where = f" WHERE {column} < {cut} OR {column} IS NULL" if cut else ""
        return f"{alias}_{table} AS (SELECT * FROM a_{table}{where})"
    return f"""
{before('customers', 'created_at')}, {before('orders', 'order_date')}, {before('payments', 'payment_date')},
{alias}_scores AS (
  SELECT table_name, bad, {score('bad', 'total')} AS score FROM (
  SELECT 'customers' AS table_name, (SELECT count(*) FROM {alias}_customers) AS total,
    (SELECT count(*) FROM {alias}_customers WHERE name IS NULL OR email IN (SELECT email FROM {alias}_customers
       WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1)) AS bad
  UNION ALL SELECT 'orders', (SELECT count(*) FROM {alias}_orders), (SELECT count(*) FROM {alias}_orders o
    WHERE total_amount IS NULL
      OR NOT EXISTS (SELECT 1 FROM {alias}_customers c WHERE c.customer_id = o.customer_id)
      OR (status = 'Completed' AND NOT EXISTS (SELECT 1 FROM {alias}_payments p WHERE p.order_id = o.order_id)))
  UNION ALL SELECT 'payments', (SELECT count(*) FROM {alias}_payments), (SELECT count(*) FROM {alias}_payments p
    WHERE NOT EXISTS (SELECT 1 FROM {alias}_orders o WHERE o.order_id = p.order_id))))"""


def _defects(alias: str, cut: str | None) -> str:
    """Every defect of the ledger before a moment, with the text of the row that has it."""
    def before(table: str, column: str) -> str:
        where = f" WHERE {column} < {cut} OR {column} IS NULL" if cut else ""
        return f"{alias}_{table} AS (SELECT * FROM a_{table}{where})"

    def found(rule: str, table: str, key: str, fault: str) -> str:
        return f"SELECT '{rule}' AS rule, {key} AS key, CAST(t AS VARCHAR) AS row FROM {alias}_{table} t WHERE {fault}"

    c, o, p = f"{alias}_customers", f"{alias}_orders", f"{alias}_payments"
    parts = [
        found("email shared", "customers", "customer_id", f"email IN (SELECT email FROM {c} WHERE email IS NOT NULL "
              "GROUP BY email HAVING count(*) > 1)"),
        found("name missing", "customers", "customer_id", "name IS NULL"),
        found("email missing", "customers", "customer_id", "email IS NULL"),
        found("customer unknown", "orders", "order_id",
              f"NOT EXISTS (SELECT 1 FROM {c} x WHERE x.customer_id = t.customer_id)"),
        found("completed without payment", "orders", "order_id",
              f"status = 'Completed' AND NOT EXISTS (SELECT 1 FROM {p} x WHERE x.order_id = t.order_id)"),
        found("total missing", "orders", "order_id", "total_amount IS NULL"),
        found("product inactive", "orders", "order_id",
              "product_id IN (SELECT product_id FROM a_products WHERE active = FALSE)"),
        found("order unknown", "payments", "payment_id",
              f"NOT EXISTS (SELECT 1 FROM {o} x WHERE x.order_id = t.order_id)"),
        found("amount differs", "payments", "payment_id", "payment_status = 'Paid' AND "
              f"EXISTS (SELECT 1 FROM {o} x WHERE x.order_id = t.order_id AND x.total_amount <> t.payment_amount)")]
    return f"""
{before('customers', 'created_at')}, {before('orders', 'order_date')}, {before('payments', 'payment_date')},
{alias}_defects AS ({' UNION ALL '.join(parts)})"""


def _compared() -> tuple[str, ...]:
    return (_defects("was", CUT), _defects("now", None), """compared AS (
  SELECT coalesce(b.rule, a.rule) AS rule, coalesce(b.key, a.key) AS key,
         CASE WHEN b.rule IS NULL THEN 'new' WHEN a.rule IS NULL THEN 'solved'
              WHEN b.row = a.row THEN 'open' ELSE 'changed' END AS state
  FROM was_defects b FULL JOIN now_defects a ON a.rule = b.rule AND a.key = b.key)""")


ORDER_FLAGS = """per_order AS (
  SELECT order_id, any_value(order_date) AS order_date, max(no_customer) AS no_customer,
         max(no_payment) AS no_payment, max(amount_mismatch) AS amount_mismatch, max(null_total) AS null_total,
         max(inactive_product) AS inactive_product
  FROM wide GROUP BY order_id)"""
FLAG_NAMES = ("no_customer", "no_payment", "amount_mismatch", "null_total", "inactive_product")


def _streams(confirmed: str) -> str:
    """Orders and payments by day, and the watermark at which both streams end."""
    return f"""
days AS (SELECT order_id, CAST(date_trunc('day', payment_date) AS TIMESTAMP) AS d, count(*) AS n,
    sum(payment_amount) AS paid, max(payment_date) AS latest FROM a_payments
  WHERE order_id IS NOT NULL AND payment_date IS NOT NULL {confirmed} GROUP BY 1, 2),
placed AS (SELECT *, CAST(date_trunc('day', order_date) AS TIMESTAMP) AS d FROM a_orders
  WHERE order_id IS NOT NULL AND order_date IS NOT NULL),
clock AS (SELECT least((SELECT max(d) FROM placed), (SELECT max(latest) FROM days)) - INTERVAL 1 DAY AS mark)"""


DUE_DAYS = "p.d >= o.d AND p.d <= o.d + INTERVAL 30 DAY"


#: The same results from tables laid out for their joins, or kept by day.
LAID_OUT = {"a05_laid_out": "a05_completed_without_payment", "a07_laid_out": "a07_orphan_payments",
            "a09_laid_out": "a09_amount_mismatch", "a18_laid_out": "a18_consolidated_view", "b09_trend_by_day": "b09_error_trend"}


def oracles() -> dict[str, str]:
    by_name = _oracles()
    return by_name | {name: by_name[same] for name, same in LAID_OUT.items()}


def _oracles() -> dict[str, str]:
    return {
        "a01_duplicate_groups": _groups(f"{GROUP_N}, {SEEN}"),
        "a01_duplicate_members": audit("""SELECT email, customer_id, name FROM a_customers
            WHERE email IN (SELECT email FROM dup_emails)"""),
        "a01_duplicate_blocks": _groups(f"""{GROUP_N}, {n('0')} AS block, min(customer_id) AS first_id,
            max(customer_id) AS last_id, {IDS}, string_agg(name, ', ' ORDER BY customer_id) AS names"""),
        "a01_duplicate_groups_export": _groups(f"{GROUP_N}, {IDS}, {SEEN}"),
        "a01_duplicate_names_report": _groups(
            f"email, {n('count(*)')} AS n, string_agg(name, ' | ' ORDER BY customer_id) AS names"),
        "a02_duplicate_rate": audit(f"""SELECT {n('count(*)')} AS total, {n('sum(d)')} AS affected,
            {pct('sum(d)', 'count(*)')} AS pct
            FROM (SELECT CASE WHEN email IN (SELECT email FROM dup_emails) THEN 1 ELSE 0 END AS d
                  FROM a_customers)"""),
        "a03_orders_without_customer": audit("""SELECT order_id, customer_id AS referenced_customer_id, order_date,
            status, total_amount, 'Customer not found in customers' AS problem FROM no_customer"""),
        "a04_orders_without_customer_rate": audit(f"""SELECT {n('t')} AS total, {n('b')} AS orphans,
            {pct('b', 't')} AS pct
            FROM (SELECT (SELECT count(*) FROM a_orders) AS t, (SELECT count(*) FROM no_customer) AS b)"""),
        "a05_completed_without_payment": audit("""SELECT u.order_id, u.customer_id, c.name AS customer_name,
            u.order_date, u.total_amount, 'Completed without a registered payment' AS problem
            FROM unpaid u LEFT JOIN a_customers c ON c.customer_id = u.customer_id"""),
        "a06_completed_without_payment_risk": audit(f"""SELECT {n('count(*)')} AS n,
            {money('coalesce(sum(total_amount), 0)')} AS amount,
            CAST(CASE WHEN count(total_amount) = 0 THEN 0 ELSE
              CAST((2 * CAST(sum(total_amount) * 100 AS HUGEINT) + count(total_amount))
              // (2 * count(total_amount)) AS DECIMAL(30,0)) * 0.01 END AS DECIMAL(24,2)) AS avg_amount
            FROM unpaid"""),
        "a07_orphan_payments": audit("""SELECT payment_id, order_id AS referenced_order_id, payment_date,
            payment_amount, payment_status, 'Order not found in orders' AS problem FROM lost"""),
        "a08_orphan_payment_amount": audit(
            f"SELECT {n('count(*)')} AS n, {money('sum(payment_amount)')} AS amount FROM lost"),
        "a09_amount_mismatch": audit(f"""SELECT m.order_id, m.customer_id, c.name AS customer_name, m.order_date,
            total_amount AS order_amount, payment_amount AS paid_amount, CAST(diff AS DECIMAL(13,2)) AS diff,
            CASE WHEN diff > 0 THEN 'Overpaid' ELSE 'Underpaid' END AS diff_type, {DIFF_PCT} AS diff_pct
            FROM mismatch m LEFT JOIN a_customers c ON c.customer_id = m.customer_id"""),
        "a10_amount_mismatch_summary": audit(f"""SELECT {n('count(*)')} AS n, {money('sum(abs(diff))')} AS total_diff,
            {money('sum(CASE WHEN diff > 0 THEN diff ELSE 0 END)')} AS overpaid,
            {money('sum(CASE WHEN diff < 0 THEN -diff ELSE 0 END)')} AS underpaid FROM mismatch"""),
        "a11_revenue_at_risk": audit(f"SELECT category, {n('n')} AS n, {money('amount')} AS amount FROM risk"),
        "a12_quality_score": audit("SELECT * FROM scores", SCORES),
        "a12_quality_score_rules": _rule_scores(),
        "a12_rule_counts": _rule_counts(),
        "a12_rule_violations": _rule_violations(),
        "a13_customers_with_nulls": audit("""SELECT customer_id, name, email, created_at,
            CASE WHEN name IS NULL AND email IS NULL THEN 'Name and email missing'
                 WHEN name IS NULL THEN 'Name missing' ELSE 'Email missing' END AS null_fields
            FROM a_customers WHERE name IS NULL OR email IS NULL"""),
        "a14_orders_with_null_total": audit("""SELECT order_id, customer_id, order_date, status,
            'total_amount is NULL' AS problem FROM a_orders WHERE total_amount IS NULL"""),
        "a15_null_census": _census(["customers.name", "customers.email", "orders.total_amount",
                                    "orders.order_date", "payments.payment_amount"]),
        "a15_null_census_export": _census(["customers.name", "customers.email", "orders.total_amount"]),
        "a16_inactive_product_orders": audit("""SELECT i.order_id, i.customer_id, c.name AS customer_name,
            i.order_date, i.status, i.total_amount, i.product_id, i.product_name, i.price AS product_price, i.active,
            'Order for a discontinued product' AS problem
            FROM inactive i LEFT JOIN a_customers c ON c.customer_id = i.customer_id"""),
        "a17_inactive_product_summary": audit(f"""SELECT {n('count(*)')} AS n,
            {money('coalesce(sum(total_amount), 0)')} AS amount FROM inactive"""),
        "a18_consolidated_view": audit("SELECT * FROM wide"),
        "a19_ledger_kpis": audit(f"""SELECT (SELECT count(*) FROM a_customers) AS customers,
            (SELECT count(*) FROM a_products) AS products, (SELECT count(*) FROM a_orders) AS orders,
            (SELECT count(*) FROM a_payments) AS payments,
            {money("(SELECT coalesce(sum(total_amount), 0) FROM a_orders WHERE status = 'Completed')")}
              AS gross_revenue"""),
        "a20_global_score": audit(f"""SELECT {MEAN} AS mean_score,
            {score('sum(bad)', 'sum(total)')} AS weighted_score FROM scores""", SCORES),
        "a21_reconciliation": audit("""SELECT o.order_id, o.customer_id, o.order_date, o.total_amount,
            coalesce(s.n, 0) AS n_payments,
            CAST(CASE WHEN s.n IS NULL THEN 0 ELSE s.paid END AS DECIMAL(24,2)) AS paid_total,
            CAST(CASE WHEN s.n IS NULL THEN 0 ELSE s.paid END - o.total_amount AS DECIMAL(24,2)) AS diff
            FROM a_orders o LEFT JOIN (SELECT order_id, count(*) AS n, sum(payment_amount) AS paid FROM a_payments
              WHERE payment_status = 'Paid' GROUP BY order_id) s ON s.order_id = o.order_id
            WHERE (s.n IS NOT NULL OR o.status = 'Completed')
              AND CASE WHEN s.n IS NULL THEN 0 ELSE s.paid END <> o.total_amount"""),
        "b01_revenue_at_risk_total": audit(f"SELECT {n('n')} AS n, {money('amount')} AS amount FROM total_risk",
                                           TOTAL_RISK),
        "b02_quality_score_global": audit(f"SELECT {MEAN} AS mean_score FROM scores", SCORES),
        "b03_percent_with_problems": audit(f"SELECT {pct('sum(bad)', 'sum(total)')} AS pct FROM counts"),
        "b04_kpi_cards": audit(f"""SELECT {MEAN} AS mean_score,
            {money('(SELECT amount FROM total_risk)')} AS risk_amount, {n('sum(bad)')} AS bad_rows,
            {pct('sum(bad)', 'sum(total)')} AS pct_bad FROM scores""", SCORES, TOTAL_RISK),
        "b05_risk_by_category": audit(f"SELECT category, {money('amount')} AS amount FROM risk"),
        "b06_problem_rows": audit("\nUNION ALL ".join(
            f"SELECT order_id, '{f}' AS problem FROM wide WHERE {f} = 1" for f in FLAG_NAMES)),
        "b07_error_distribution": audit(f"""SELECT table_name, {n('bad')} AS bad,
            {pct('bad', '(SELECT sum(bad) FROM counts)')} AS share FROM counts"""),
        "b08_over_under_by_order": audit(f"""SELECT order_id,
            {money('sum(CASE WHEN diff > 0 THEN diff ELSE 0 END)')} AS overpaid,
            {money('sum(CASE WHEN diff < 0 THEN -diff ELSE 0 END)')} AS underpaid
            FROM mismatch GROUP BY order_id"""),
        "b09_error_trend": audit("SELECT CAST(date_trunc('day', order_date) AS TIMESTAMP) AS period, "
                                 + ", ".join(f"{n(f'sum({f})')} AS {f}" for f in FLAG_NAMES)
                                 + f", {n(f'sum(greatest({', '.join(FLAG_NAMES)}))')} AS any_problem"
                                 + " FROM per_order GROUP BY 1", ORDER_FLAGS),
        "b10_order_vs_paid": audit("SELECT order_id, total_amount, paid_amount, diff FROM wide"),
        "b11_score_vs_target": audit(f"""SELECT table_name, score, CAST(98 AS DOUBLE) AS target,
            CAST(CAST(score AS DECIMAL(10,2)) - 98.00 AS DOUBLE) AS gap, score >= 98 AS met
            FROM (SELECT table_name, score FROM scores UNION ALL SELECT 'global', {MEAN} FROM scores)""", SCORES),
        "b12_score_alerts": audit("""SELECT table_name, score, CAST(95 AS DOUBLE) AS threshold
            FROM (SELECT table_name, score FROM scores UNION ALL SELECT 'global', mean_score FROM overall)
            WHERE score < 95""", SCORES, f"overall AS (SELECT {MEAN} AS mean_score FROM scores)"),
        "c01_risk_shares": audit(f"""SELECT category, {n('n')} AS n, {money('amount')} AS amount,
            CAST((2000 * CAST(amount * 100 AS HUGEINT) + (SELECT CAST(amount * 100 AS HUGEINT) FROM total_risk))
              // (2 * (SELECT CAST(amount * 100 AS HUGEINT) FROM total_risk)) AS DOUBLE) / 10 AS share_pct
            FROM risk""", TOTAL_RISK),
        "c02_annual_projection": audit(f"""SELECT 'optimistic' AS scenario, CAST(6 AS DOUBLE) AS factor,
            {money('amount * 6')} AS amount FROM total_risk
            UNION ALL SELECT 'conservative', CAST(12 AS DOUBLE), {money('amount * 12')} FROM total_risk""",
                                       TOTAL_RISK),
        "c03_growth_projection": audit(f"""SELECT 'growth' AS scenario, CAST(8.052 AS DOUBLE) AS factor,
            {money('CAST(amount AS DECIMAL(24,2)) * 8.052')} AS amount FROM total_risk""", TOTAL_RISK),
        "c04_fix_roi": audit(f"""SELECT {money('amount * 6')} AS annual_loss, {money('4000000')} AS fix_cost,
            CAST((200 * CAST(amount * 600 AS HUGEINT) + 400000000) // 800000000 AS DOUBLE) / 100 AS roi
            FROM total_risk""", TOTAL_RISK),
        "c05_orphan_payments_by_status": audit(f"""SELECT payment_status, {n('count(*)')} AS n,
            {money('sum(payment_amount)')} AS amount FROM lost GROUP BY payment_status"""),
        "d04_export_gate": _export_gate(),
        "d04_export_run": audit("\nUNION ALL ".join(
            f"SELECT '{name}' AS name, {n('count(*)')} AS rows, 'OK' AS status FROM {source}"
            for name, source in EXPORT_SOURCES.items())),
        "d06_full_report": _report(REPORT_REST),
        "d06_sectioned_report": _report(),
        "f01_unique_email": _groups(GROUP_N),
        "f01_unique_line_key": f"""SELECT l_orderkey, l_linenumber, {n('count(*)')} AS n,
            {n('count(*) - 1')} AS n_extra FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
        "f02_fk_orders_customers": audit("""SELECT order_id, customer_id, 'customer_id has no parent' AS problem
            FROM no_customer WHERE customer_id IS NOT NULL"""),
        "f02_fk_payments_orders": audit("""SELECT payment_id, order_id, 'order_id has no parent' AS problem
            FROM lost WHERE order_id IS NOT NULL"""),
        "f03_not_null_customers": audit("""SELECT customer_id, 'name' AS violations
            FROM a_customers WHERE name IS NULL"""),
        "f03_not_null_orders": audit("""SELECT order_id, 'total_amount' AS violations
            FROM a_orders WHERE total_amount IS NULL"""),
        "f04_status_domain": audit("""SELECT order_id, status,
            'status not in (Pending, Processing, Completed, Cancelled)' AS problem
            FROM a_orders WHERE status NOT IN ('Pending', 'Processing', 'Completed', 'Cancelled')"""),
        "f04_payment_status_domain": audit("""SELECT payment_id, payment_status,
            'payment_status not in (Paid, Failed, Pending)' AS problem
            FROM a_payments WHERE payment_status NOT IN ('Paid', 'Failed', 'Pending')"""),
        "f05_quarantine": audit("SELECT * FROM tagged WHERE broken <> ''", RULES),
        "f06_clean": audit("SELECT order_id, customer_id, status, total_amount FROM tagged WHERE broken = ''", RULES),
        "f07_stream_reconciliation": audit(f"""SELECT order_id, customer_id, day, total_amount, {n('n')} AS n_payments,
            {money('paid')} AS paid_total, {money('paid - total_amount')} AS diff,
            CASE WHEN paid > total_amount THEN 'Overpaid' ELSE 'Underpaid' END AS diff_type FROM (
              SELECT o.order_id, o.customer_id, o.d AS day, o.total_amount, o.status, coalesce(sum(p.n), 0) AS n,
                CASE WHEN sum(p.n) IS NULL THEN 0 ELSE sum(p.paid) END AS paid
              FROM placed o LEFT JOIN days p ON p.order_id = o.order_id AND {DUE_DAYS}
              WHERE o.d + INTERVAL 31 DAY < (SELECT mark FROM clock) GROUP BY ALL)
            WHERE (n > 0 OR status = 'Completed') AND paid <> total_amount""",
                                           _streams("AND payment_status = 'Paid'")),
        "f08_daily_scorecard": audit("SELECT *, DATE '2024-01-15' AS run_date FROM scores", SCORES),
        "f08_incremental_scorecard": audit("SELECT * FROM scores", SCORES),
        "f09_follow_up": audit("SELECT * FROM compared", *_compared()),
        "f09_follow_up_summary": audit("SELECT rule, " + ", ".join(
            f"{n(f"count(*) FILTER (state = '{s}')")} AS {s}" for s in ("new", "solved", "open", "changed"))
            + " FROM compared GROUP BY rule", *_compared()),
        "f09_score_change": audit("""SELECT b.table_name, b.score AS score_before, a.score AS score_after,
            CAST(CAST(a.score AS DECIMAL(10,2)) - CAST(b.score AS DECIMAL(10,2)) AS DOUBLE) AS score_delta,
            b.bad AS bad_before, a.bad AS bad_after
            FROM old_scores b FULL JOIN now_scores a ON a.table_name = b.table_name""",
                                  _as_of("old", CUT), _as_of("now", None)),
        "f10_stream_absences": audit(f"""
            SELECT 'no payment in time' AS problem, order_id, d AS day, {n('0')} AS n_payments,
              {money('total_amount')} AS amount FROM placed o WHERE status = 'Completed'
              AND d + INTERVAL 31 DAY < (SELECT mark FROM clock)
              AND NOT EXISTS (SELECT 1 FROM days p WHERE p.order_id = o.order_id AND {DUE_DAYS})
            UNION ALL SELECT 'no order in time', order_id, d, {n('n')}, {money('paid')} FROM days p
            WHERE d + INTERVAL 1 DAY < (SELECT mark FROM clock)
              AND NOT EXISTS (SELECT 1 FROM placed o WHERE o.order_id = p.order_id AND {DUE_DAYS})
            UNION ALL SELECT 'no payment in time', order_id, CAST(date_trunc('day', order_date) AS TIMESTAMP), 0,
              {money('total_amount')} FROM a_orders
            WHERE status = 'Completed' AND (order_id IS NULL OR order_date IS NULL)
            UNION ALL SELECT 'no order in time', order_id, CAST(date_trunc('day', payment_date) AS TIMESTAMP), 1,
              {money('payment_amount')} FROM a_payments WHERE order_id IS NULL OR payment_date IS NULL""",
                                     _streams("")),
        "f10_stream_unpaid": audit("""SELECT order_id, customer_id, order_date, total_amount,
              'undated' AS reason FROM a_orders WHERE status = 'Completed' AND order_date IS NULL
            UNION ALL SELECT order_id, customer_id, order_date, total_amount, 'no payment in time' FROM a_orders o
            WHERE status = 'Completed'
              AND order_date + INTERVAL 30 DAY < (SELECT least(
                (SELECT max(order_date) FROM a_orders WHERE status = 'Completed'),
                (SELECT max(payment_date) FROM a_payments WHERE order_id IS NOT NULL)) - INTERVAL 1 DAY)
              AND NOT EXISTS (SELECT 1 FROM a_payments p WHERE p.order_id = o.order_id
                AND p.payment_date >= o.order_date AND p.payment_date <= o.order_date + INTERVAL 30 DAY)"""),
        "n01_document_duplicates": f"""SELECT sha256(text) AS text_key, {n('count(*)')} AS n,
            {n('count(*) - 1')} AS n_extra FROM documents WHERE text IS NOT NULL
            GROUP BY text HAVING count(*) > 1""",
        "n01_document_duplicate_members": """SELECT sha256(text) AS text_key, doc_id FROM documents
            WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""",
        "n03_documents_without_labels": """SELECT doc_id, lang, source, n_chars, 'no label' AS problem
            FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
        "n05_orders_without_lines": f"""SELECT o_orderstatus, {n('count(*)')} AS n FROM orders o
            WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) GROUP BY o_orderstatus""",
        "n21_order_line_reconciliation": """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS order_total,
            s.n AS n_lines, s.total AS lines_total,
            CAST(s.total - CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(24,2)) AS diff
            FROM orders JOIN (SELECT l_orderkey, count(*) AS n,
                CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                  AS DECIMAL(18,2))) AS DECIMAL(24,2)) AS total
              FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey
            WHERE s.total <> CAST(o_totalprice AS DECIMAL(18,2))""",
    }
