"""Queries of purchases, products and the stock ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import description_key
from ..operators import inventory, queues
from ..sources.views import Tables
from .registry import query

SIGNED = "CASE WHEN kind = 'SALIDA' THEN -quantity ELSE quantity END"
ITEMS = "CASE k % 5 WHEN 0 THEN '[{\"description\": \" Cafe \", \"quantity\": \"1,250.50\", \"unit_price\": \"2.00\", \"total\": \"' || cast(total_amount AS string) || '\"}, {\"description\": \"\", \"quantity\": 1}]' WHEN 1 THEN '[{\"description\": \"Pan\", \"quantity\": 0}, 7, {\"description\": \"Sal\", \"quantity\": \"x\"}]' WHEN 2 THEN '{\"description\": \"no list\"}' WHEN 3 THEN NULL ELSE '[]' END"


def _with_items(t: Tables):
    return t.receipt.withColumn("items", F.expr(ITEMS))


@query("A32_stock", f"SELECT product_id, cast(sum({SIGNED}) AS decimal(24,3)) AS stock FROM ledger GROUP BY 1")
def a32(t: Tables):
    return inventory.stock(t.ledger)


@query("J06_products_with_stock", f"SELECT p.id, p.name, cast(coalesce(s.stock, 0) AS decimal(24,3)) AS stock FROM product AS p LEFT JOIN (SELECT product_id, sum({SIGNED}) AS stock FROM ledger WHERE quantity < 20 GROUP BY 1) AS s ON s.product_id = p.id WHERE p.active")
def j06(t: Tables):
    return inventory.products_with_stock(t.product, t.ledger.where("quantity < 20"), only_active=True).select("id", "name", "stock")


@query("I07_negative_stock", f"SELECT id, stock_after FROM (SELECT id, cast(sum({SIGNED}) OVER (PARTITION BY product_id ORDER BY moved_on, id ROWS UNBOUNDED PRECEDING) AS decimal(24,3)) AS stock_after FROM ledger) AS x WHERE stock_after < 0")
def i07(t: Tables):
    return inventory.negative_stock(t.ledger).select("id", "stock_after")


@query("J05_T06_open_lines", "SELECT l.id, p.company_id FROM purchase_line AS l JOIN purchase AS p ON p.id = l.purchase_id WHERE l.product_id IS NULL AND p.state IN ('PROCESAR', 'EN_REVISION')")
def j05(t: Tables):
    return inventory.open_lines(t.purchase_line, t.purchase).select("id", "company_id")


@query("J15_purchases_with_lines", "SELECT p.id, count(l.id) AS n, coalesce(string_agg(cast(l.line_order AS varchar), ',' ORDER BY l.line_order), '') AS positions FROM purchase AS p LEFT JOIN purchase_line AS l ON l.purchase_id = p.id GROUP BY 1")
def j15(t: Tables):
    rows = queues.purchases_with_lines(t.purchase, t.purchase_line)
    return rows.select("id", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: x["line_order"].cast("string")), ",").alias("positions"))


@query("T05_newest_movements", "SELECT id FROM ledger ORDER BY moved_on DESC, id LIMIT 1000")
def t05(t: Tables):
    return queues.page(t.ledger, [F.desc("moved_on"), F.col("id")], 1000).select("id")


KEY = "trim(regexp_replace(lower(strip_accents(trim({}))), '\\s+', ' ', 'g'), ' .,:;-*#')"


@query("I01_description_key", f"SELECT id, {KEY.format('name')} AS key FROM product")
def i01(t: Tables):
    return t.product.select("id", description_key(F.col("name")).alias("key"))


LINES = "(SELECT id, cast(cast(split_part(purchase_id, '-', 1) AS bigint) % 5 AS varchar) AS company_id, purchase_id, line_order, description || CASE WHEN line_order = 7 THEN ' nuevo' ELSE '' END AS description, CASE WHEN line_order = 2 THEN 'C' || cast(cast(purchase_id AS bigint) % 200 AS varchar) END AS code FROM purchase_line)"


def _lines(t: Tables):
    return t.purchase_line.select("id", (F.col("purchase_id").cast("long") % 5).cast("string").alias("company_id"), "purchase_id", "line_order", F.concat("description", F.when(F.col("line_order") == 7, " nuevo").otherwise("")).alias("description"), F.when(F.col("line_order") == 2, F.concat(F.lit("C"), (F.col("purchase_id").cast("long") % 200).cast("string"))).alias("code"))


RESOLVED = f"""(SELECT l.*, coalesce(c.id, n.id) AS product_id FROM (SELECT *, {KEY.format('description')} AS key FROM {LINES} AS q) AS l
  LEFT JOIN (SELECT company_id, code, arg_min(id, (created_on, id)) AS id FROM product WHERE code IS NOT NULL GROUP BY 1, 2) AS c ON c.company_id = l.company_id AND c.code = l.code
  LEFT JOIN (SELECT company_id, {KEY.format('name')} AS key, arg_min(id, (created_on, id)) AS id FROM product GROUP BY 1, 2) AS n ON n.company_id = l.company_id AND n.key = l.key)"""


@query("J12_I02_resolved_lines", f"SELECT id, product_id FROM {RESOLVED} AS r")
def j12(t: Tables):
    return inventory.resolved_lines(_lines(t), t.product).select("id", "product_id")


@query("I02_new_products", f"SELECT company_id, key, arg_min(description, (purchase_id, line_order)) AS name FROM {RESOLVED} AS r WHERE product_id IS NULL AND key <> '' GROUP BY 1, 2")
def i02(t: Tables):
    return inventory.new_products(inventory.resolved_lines(_lines(t), t.product)).select("company_id", "key", "name")


@query("V16_parsed_items", "SELECT id, 0 AS line_order, 'Cafe' AS description, cast(1250.5 AS decimal(14,3)) AS quantity, total_amount AS total FROM receipt WHERE k % 5 = 0")
def v16(t: Tables):
    return inventory.parsed_items(_with_items(t))[0].select("id", "line_order", "description", "quantity", "total")


@query("V16_rejected_items", "SELECT id, 1 AS line_order, 'sin descripcion' AS reason FROM receipt WHERE k % 5 = 0 UNION ALL SELECT id, unnest([0, 1, 2]), unnest(['cantidad no positiva', 'no es un objeto', 'cantidad ilegible']) FROM receipt WHERE k % 5 = 1")
def v16_rejected(t: Tables):
    return inventory.parsed_items(_with_items(t))[1]


@query("A40_verified_items", "SELECT p.id, cast(n AS int) AS lines, cast(s AS decimal(18,2)) AS line_sum, cast(s - p.total AS decimal(18,2)) AS gap, abs(s - p.total) <= 0.01 AS adds_up, CASE WHEN n = 0 THEN 'NADA' WHEN abs(s - p.total) <= 0.01 THEN 'CONCILIA' ELSE 'PARCIAL' END AS verdict FROM purchase AS p LEFT JOIN (SELECT purchase_id, count(*) AS n, sum(total) AS s FROM purchase_line GROUP BY 1) AS l ON l.purchase_id = p.id WHERE n > 0")
def a40(t: Tables):
    item = F.struct("description", F.col("quantity").cast("string").alias("quantity"), F.lit(None).cast("string").alias("unit_price"), F.col("total").cast("string").alias("total"))
    items = t.purchase_line.groupBy(F.col("purchase_id").alias("id")).agg(F.collect_list(item).alias("items"))
    rows = t.purchase.join(items, "id").select("id", "items", F.lit(None).cast("decimal(12,2)").alias("subtotal"), F.col("total").alias("total_amount"))
    return inventory.verified_items(rows)


@query("A41_discarded_lines", "SELECT id, CASE k % 5 WHEN 0 THEN 1 ELSE 3 END AS discarded FROM receipt WHERE k % 5 < 2")
def a41(t: Tables):
    return inventory.parsed_items(_with_items(t))[1].groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("discarded"))


@query("I03_new_purchases", "SELECT id AS receipt_id, 'EN_REVISION' AS state, total_amount AS total FROM receipt WHERE k % 5 = 0 AND k % 3 <> 0")
def i03(t: Tables):
    return inventory.new_purchases(_with_items(t), t.purchase.where("cast(id as bigint) % 3 = 0")).select("receipt_id", "state", "total")


def _actions(t: Tables):
    return t.purchase.where("cast(id as bigint) % 2 = 0 or cast(id as bigint) % 7 = 1").select(F.col("id").alias("purchase_id"), F.lit("user9").alias("actor"))


COMPLETE = "(SELECT p.*, s.complete FROM purchase AS p LEFT JOIN (SELECT purchase_id, bool_and(product_id IS NOT NULL) AS complete FROM purchase_line GROUP BY 1) AS s ON s.purchase_id = p.id WHERE cast(p.id AS bigint) % 2 = 0 OR cast(p.id AS bigint) % 7 = 1)"


@query("I04_entries", f"SELECT l.id, l.product_id, 'ENTRADA' AS kind, l.quantity FROM purchase_line AS l JOIN {COMPLETE} AS p ON p.id = l.purchase_id WHERE p.complete AND p.state IN ('PROCESAR', 'EN_REVISION')")
def i04(t: Tables):
    return inventory.confirmed_purchases(_actions(t), t.purchase, t.purchase_line)[1].select("id", "product_id", "kind", "quantity")


@query("I04_K04_refusals", f"SELECT id AS purchase_id, CASE WHEN state = 'PROCESADO' THEN 'already confirmed' WHEN state = 'RECHAZADO' THEN 'rejected' WHEN complete IS NULL THEN 'no lines' ELSE 'line without product' END AS reason FROM {COMPLETE} AS p WHERE NOT (coalesce(complete, false) AND state IN ('PROCESAR', 'EN_REVISION'))")
def i04_refused(t: Tables):
    return inventory.confirmed_purchases(_actions(t), t.purchase, t.purchase_line)[2]


@query("I05_rejected_purchases", "SELECT id, CASE WHEN cast(id AS bigint) % 3 = 0 AND state IN ('PROCESAR', 'EN_REVISION') THEN 'RECHAZADO' WHEN cast(id AS bigint) % 3 = 1 AND state = 'RECHAZADO' THEN 'EN_REVISION' ELSE state END AS state FROM purchase")
def i05(t: Tables):
    k = F.col("id").cast("long") % 3
    actions = t.purchase.where(k < 2).select(F.col("id").alias("purchase_id"), F.when(k == 0, "reject").otherwise("reopen").alias("action"))
    return inventory.moved_purchases(actions, t.purchase)[0].select("id", "state")


@query("I06_checked_movements", f"""SELECT id, accepted FROM (WITH RECURSIVE m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY moved_on, id) AS k FROM ledger WHERE moved_on >= date '1996-01-01'),
    s AS (SELECT product_id, sum({SIGNED}) AS stock FROM ledger WHERE moved_on < date '1996-01-01' GROUP BY 1),
    turn AS (SELECT p.product_id, cast(0 AS bigint) AS k, cast(coalesce(stock, 0) AS decimal(24,3)) AS have, cast(NULL AS varchar) AS id, false AS accepted FROM (SELECT DISTINCT product_id FROM m) AS p LEFT JOIN s ON s.product_id = p.product_id
      UNION ALL SELECT product_id, k, cast(CASE WHEN NOT ok THEN have WHEN kind = 'AJUSTE' THEN have + quantity ELSE have - quantity END AS decimal(24,3)), id, ok
      FROM (SELECT m.product_id, m.k, t.have, m.id, m.kind, m.quantity, coalesce(m.quantity > 0 AND (m.kind = 'AJUSTE' OR (m.kind = 'SALIDA' AND m.quantity <= t.have)), false) AS ok FROM turn AS t JOIN m ON m.product_id = t.product_id AND m.k = t.k + 1) AS n)
  SELECT id, accepted FROM turn WHERE k > 0) AS r""")
def i06(t: Tables):
    return inventory.checked_movements(t.ledger.where("moved_on >= date '1996-01-01'"), t.ledger.where("moved_on < date '1996-01-01'")).select("id", "accepted")


@query("I09_assigned_lines", "SELECT l.id, CASE WHEN l.product_id IS NULL AND p.company_id = d.company_id AND p.state IN ('PROCESAR', 'EN_REVISION') THEN d.id ELSE l.product_id END AS product_id FROM purchase_line AS l LEFT JOIN purchase AS p ON p.id = l.purchase_id LEFT JOIN product AS d ON d.id = cast(1 + cast(l.purchase_id AS bigint) % 150 AS varchar)")
def i09(t: Tables):
    actions = t.purchase_line.where("product_id is null").select(F.col("id").alias("line_id"), (1 + F.col("purchase_id").cast("long") % 150).cast("string").alias("product_id"))
    return inventory.assigned_lines(actions, t.purchase_line, t.purchase, t.product)[0].select("id", "product_id")
