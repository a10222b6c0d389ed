"""Purchases, products and the stock ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import description_key
from .segments import moved_entries, replayed

ITEM = "array<struct<description:string,quantity:string,unit_price:string,total:string>>"
QUANTITY, MONEY, STOCK = "decimal(14,3)", "decimal(12,2)", "decimal(24,3)"
LONGEST = 300
#: Movements of one product that are replayed in one go.
PART = 50_000


def signed() -> Column:
    """What a ledger row adds to the stock: issues take away, adjustments always add."""
    return F.when(F.col("kind") == "SALIDA", -F.col("quantity")).otherwise(F.col("quantity"))


def stock(ledger: DataFrame) -> DataFrame:
    """Stock of each product that has movements."""
    return ledger.groupBy("product_id").agg(F.sum(signed()).cast(STOCK).alias("stock"))


def products_with_stock(products: DataFrame, ledger: DataFrame, only_active: bool = False) -> DataFrame:
    """Products with their stock, 0 without movements."""
    rows = products.where("active") if only_active else products
    return rows.join(stock(ledger).withColumnRenamed("product_id", "id"), "id", "left").withColumn("stock", F.coalesce("stock", F.lit(0)).cast(STOCK))


def running_stock(ledger: DataFrame) -> DataFrame:
    """Each movement with the stock after it, by date and id."""
    w = Window.partitionBy("product_id").orderBy("moved_on", "id").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("stock_after", F.sum(signed()).over(w).cast(STOCK))


def negative_stock(ledger: DataFrame) -> DataFrame:
    """Movements after which the stock is below 0."""
    return running_stock(ledger).where("stock_after < 0")


def open_lines(lines: DataFrame, purchases: DataFrame) -> DataFrame:
    """Lines without a product of purchases that are still open, newest purchase first."""
    p = purchases.where("state in ('PROCESAR', 'EN_REVISION')").select(F.col("id").alias("purchase_id"), "company_id", "purchased_on")
    return lines.where("product_id is null").join(p, "purchase_id").orderBy(F.desc("purchased_on"), "purchase_id", "line_order")


def _number(c: Column, kind: str) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast(kind)


def parsed_items(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of `items` (JSON text or an array of structs): (good lines, rejected ones with their reason).

    A list that is no list gives neither. Lines keep their position as line_order.
    """
    kind = dict(receipts.dtypes)["items"]
    if kind == "string":
        raw = F.from_json("items", "array<string>")
        rows = receipts.select("id", F.posexplode(raw).alias("line_order", "raw"))
        rows = rows.withColumn("item", F.when(F.trim("raw").startswith("{"), F.from_json("raw", "struct<description:string,quantity:string,unit_price:string,total:string>")))
    else:
        rows = receipts.select("id", F.posexplode("items").alias("line_order", "item"))
    text = F.trim(F.coalesce("item.description", F.lit("")))
    quantity = _number(F.col("item.quantity"), QUANTITY)
    reason = F.when(F.col("item").isNull(), "no es un objeto").when(text == "", "sin descripcion").when(quantity.isNull(), "cantidad ilegible").when(quantity <= 0, "cantidad no positiva")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select("id", "line_order", F.substring(text, 1, LONGEST).alias("description"), quantity.alias("quantity"), _number(F.col("item.unit_price"), MONEY).alias("unit_price"), _number(F.col("item.total"), MONEY).alias("total"))
    return good, rows.where("reason is not null").select("id", "line_order", "reason")


def verified_items(receipts: DataFrame) -> DataFrame:
    """Whether the lines' totals add up to the subtotal, else to the total: CONCILIA, PARCIAL or NADA."""
    number = lambda c, kind: F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast(kind)
    usable = lambda x: (F.trim(F.coalesce(x["description"], F.lit(""))) != "") & (number(x["quantity"], QUANTITY) > 0) & (number(x["total"], MONEY) > 0) & F.coalesce(number(x["unit_price"], MONEY) > 0, F.lit(True))
    items = F.filter(F.coalesce("items", F.array().cast(ITEM)), usable)
    rows = receipts.withColumn("__items", items).withColumn("line_sum", F.when(F.size("__items") > 0, F.aggregate("__items", F.lit(0).cast("decimal(18,2)"), lambda s, x: (s + number(x["total"], MONEY)).cast("decimal(18,2)"))))
    told = F.coalesce("subtotal", "total_amount")
    gap = F.col("line_sum") - told
    fits = F.abs(gap) <= F.lit("0.01").cast(MONEY)
    verdict = F.when(gap.isNull(), F.when(F.size("__items") > 0, "PARCIAL").otherwise("NADA")).when(fits, "CONCILIA").otherwise("PARCIAL")
    return rows.select("id", F.size("__items").alias("lines"), "line_sum", gap.cast("decimal(18,2)").alias("gap"), fits.alias("adds_up"), verdict.alias("verdict"))


def resolved_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Each line's product: by code within its company, else by normalised name, of several the oldest (ties by id)."""
    oldest = F.min_by("id", F.struct("created_on", "id"))
    by_code = products.where("code is not null").groupBy("company_id", "code").agg(oldest.alias("by_code"))
    by_name = products.groupBy("company_id", description_key(F.col("name")).alias("key")).agg(oldest.alias("by_name"))
    rows = lines.withColumn("key", description_key(F.col("description")))
    if "code" not in rows.columns:
        rows = rows.withColumn("code", F.lit(None).cast("string"))
    return rows.join(by_code, ["company_id", "code"], "left").join(by_name, ["company_id", "key"], "left").withColumn("product_id", F.coalesce("by_code", "by_name")).drop("by_code", "by_name")


def new_products(resolved: DataFrame) -> DataFrame:
    """A product for each name that no line resolved, described as its first line; unverified unless it has a code."""
    rows = resolved.where("product_id is null and key <> ''")
    first = F.min_by(F.struct("description", "code"), F.struct("purchase_id", "line_order")).alias("__f")
    return rows.groupBy("company_id", "key").agg(first).select("company_id", "key", F.col("__f.description").alias("name"), F.col("__f.code").alias("code"), F.col("__f.code").isNotNull().alias("verified"), F.lit("OCR").alias("origin"))


def new_purchases(receipts: DataFrame, purchases: DataFrame) -> DataFrame:
    """A purchase for each receipt that has good lines and none yet."""
    good, _ = parsed_items(receipts)
    counted = good.groupBy("id").agg(F.count(F.lit(1)).alias("lines"))
    rows = receipts.join(counted, "id").join(purchases.select(F.col("receipt_id").alias("id")), "id", "left_anti")
    return rows.select(F.col("id").alias("receipt_id"), "company_id", F.lit("EN_REVISION").alias("state"), F.col("expense_date").alias("purchased_on"), "provider_name", F.col("total_amount").alias("total"), "lines")


def confirmed_purchases(actions: DataFrame, purchases: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confirm purchases named by actions (purchase_id, actor): (purchases, new ledger rows, refusals).

    Refused are purchases that are unknown, already confirmed, rejected, empty, or have a line without a product.
    """
    ready = lines.groupBy("purchase_id").agg(F.bool_and(F.col("product_id").isNotNull()).alias("complete"))
    asked = actions.groupBy("purchase_id").agg(F.min("actor").alias("actor"))
    p = purchases.select(F.col("id").alias("purchase_id"), "state", "company_id", "purchased_on")
    rows = asked.join(p, "purchase_id", "left").join(ready, "purchase_id", "left")
    s = F.col("state")
    rows = rows.withColumn("reason", F.when(s.isNull(), "unknown").when(s == "PROCESADO", "already confirmed").when(s == "RECHAZADO", "rejected").when(F.col("complete").isNull(), "no lines").when(~F.col("complete"), "line without product"))
    good = rows.where("reason is null")
    entries = lines.join(good.select("purchase_id", "company_id", "actor", "purchased_on"), "purchase_id").select("id", "company_id", "product_id", F.lit("ENTRADA").alias("kind"), "quantity", F.col("purchased_on").alias("moved_on"), "actor")
    done = good.select(F.col("purchase_id").alias("id"), F.col("actor").alias("__by"))
    after = purchases.join(done, "id", "left").withColumns({"state": F.when(F.col("__by").isNotNull(), "PROCESADO").otherwise(s), "confirmed_by": F.coalesce("__by", "confirmed_by")}).drop("__by")
    return after, entries, rows.where("reason is not null").select("purchase_id", "reason")


def moved_purchases(actions: DataFrame, purchases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reject or reopen purchases: actions (purchase_id, action). Confirmed ones can't be rejected, only rejected ones reopen."""
    s, a = F.col("state"), F.col("action")
    rows = actions.join(purchases.select(F.col("id").alias("purchase_id"), "state"), "purchase_id", "left")
    allowed = ((a == "reject") & s.isin("PROCESAR", "EN_REVISION")) | ((a == "reopen") & (s == "RECHAZADO"))
    rows = rows.withColumn("ok", F.coalesce(allowed, F.lit(False)))
    new = rows.where("ok").groupBy(F.col("purchase_id").alias("id")).agg(F.min(F.when(a == "reject", "RECHAZADO").otherwise("EN_REVISION")).alias("__s"))
    after = purchases.join(new, "id", "left").withColumn("state", F.coalesce("__s", "state")).drop("__s")
    return after, rows.where("not ok").select("purchase_id", "action", "state")


def checked_movements(movements: DataFrame, ledger: DataFrame, part: int = PART) -> DataFrame:
    """Manual movements with `accepted`: receipts only as adjustments, and issues only as far as stock reaches.

    Movements of one product are replayed by date and id from its stock in the ledger; only accepted ones change
    it, a refused one writes nothing. A task holds at most `part` movements; parts of a product are replayed at once,
    from the stock that there is if nothing before them is refused. The lowest stock above an issue, and the least that a
    refused one lacks, say for which other stocks at its beginning a part's answers are the same.
    """

    def run(rows: dict[str, list], state: list):
        have, accepted, lower, higher = state[0], [], None, None
        for kind, quantity in zip(rows["kind"], rows["quantity"], strict=True):
            ok = quantity is not None and quantity > 0 and kind in ("AJUSTE", "SALIDA")
            if ok and kind == "SALIDA":
                spare = have - quantity
                ok = spare >= 0
                if ok:
                    lower = spare if lower is None else min(lower, spare)
                else:
                    higher = -spare if higher is None else min(higher, -spare)
            if ok:
                have += quantity if kind == "AJUSTE" else -quantity
            accepted.append(bool(ok))
        return {"accepted": accepted}, [have], [lower, higher]

    def unrefused(cut: DataFrame) -> DataFrame:
        change = F.when(F.col("quantity") > 0, F.when(F.col("kind") == "AJUSTE", F.col("quantity")).when(F.col("kind") == "SALIDA", -F.col("quantity")))
        sums = cut.groupBy("product_id", "__part").agg(F.sum(change).alias("change"), F.first("__start").alias("start"))
        before = F.sum("change").over(Window.partitionBy("product_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        later = sums.withColumn("before", before).withColumn("n", F.row_number().over(Window.partitionBy("product_id").orderBy("__part"))).where("n > 1")
        stock_then = F.greatest(F.col("start")[0] + F.coalesce("before", F.lit(0)), F.lit(0)).cast(STOCK)
        return later.select("__part", F.array(stock_then).alias("__entry"))

    opening = stock(ledger).select("product_id", F.col("stock").alias("__stock"))
    rows = movements.join(opening, "product_id", "left").withColumn("__start", F.array(F.coalesce("__stock", F.lit(0)).cast(STOCK)))
    rows = rows.select(*movements.columns, "__start")
    return replayed(rows, "product_id", ["moved_on", "id"], run, "accepted boolean", f"array<{STOCK}>", part, moved_entries, unrefused)


def assigned_lines(actions: DataFrame, lines: DataFrame, purchases: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assign products to lines: actions (line_id, product_id); both must belong to one company, and the purchase must be open."""
    l = lines.select(F.col("id").alias("line_id"), "purchase_id").join(purchases.select(F.col("id").alias("purchase_id"), "company_id", "state"), "purchase_id")
    p = products.select(F.col("id").alias("product_id"), F.col("company_id").alias("owner"))
    rows = actions.join(l, "line_id", "left").join(p, "product_id", "left")
    ok = F.coalesce((F.col("company_id") == F.col("owner")) & F.col("state").isin("PROCESAR", "EN_REVISION"), F.lit(False))
    rows = rows.withColumn("ok", ok)
    new = rows.where("ok").groupBy(F.col("line_id").alias("id")).agg(F.min("product_id").alias("__p"))
    return lines.join(new, "id", "left").withColumn("product_id", F.coalesce("__p", "product_id")).drop("__p"), rows.where("not ok").select("line_id", "product_id")
