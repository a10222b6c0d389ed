"""Fields of receipt texts (V07, V07a-V07e, V12, V13, V14, V24).

A text is cut into tokens once: words, figures (digits with the marks that join them) and single marks, written with a blank
around each. What kind of figure a token is follows from its joining marks: none or points and commas make an amount, two
slashes or dashes a date, colons a time. Labels look at their neighbours in a line of tokens by patterns, one evaluation for a line
and rule (functions on arrays of tokens are interpreted token by token), and put forward candidates; each field is picked among
the candidates of all lines, so that the reasons of a reading (V24) are the same rows that made it. Only the merging of recognised
boxes into lines is sequential; it runs on one page at a time.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import MONEY, marked_number, receipt_number
from ..functions.text import UNKNOWN_PROVIDER, strip_accents, text_quality

# Words of receipts, lower case and without accents.
TOTAL, SUB, SUBTOTAL, DUE, DATE = "total", "sub", "subtotal", "importe", "fecha"
TAXES = ("iva", "tax", "impuesto")
TAX_ID_LABELS = ("rfc", "nit", "tax id")
DATE_KINDS = ("expedicion", "emision")
FIELD_LABELS = (
    "rfc", "nit", "tax id", "fecha", "hora", "folio", "serie", "no", "factura", "subtotal", "total", "iva", "impuesto", "importe", "monto", "articulo", "articulos", "concepto", "cantidad",
    "descripcion", "telefono", "tel", "direccion", "domicilio", "referencia", "metodo de pago",
)
ISSUER_LABELS = ("emisor", "proveedor", "razon social", "nombre", "nombre comercial")
SAVINGS = ("ahorroste", "ahorraste", "ahorro", "ahorra", "ahorcen", "ahorren", "descuento", "rebaja", "precio final", "ya descontado")
EXPIRY_STEMS = ("vence", "vencimiento", "expira", "caduca", "caducidad", "validez", "vigencia", "limite")
RECEIPT_WORDS = ("folio", "nota", "ticket", "comprobante", "caja", "operacion", "transaccion", "corte")
HEADINGS = ("factura electronica", "cfdi", "comprobante", "recibo")
HEAD_LINES = 15
GOOD_SCORE = 70

#: Blanks within a line, and marks that may stand between a label and its amount.
BLANK, LIGHT = r" \t\x0B\f\r", ":$€"
TOKEN = rf"\p{{L}}+|[.,]?\d+(?:[.,:/-]+\d+)*|[^\s{LIGHT}]"
#: A line's end with the blanks around it; blanks are tried from their first one only.
LINE_END = rf"(?<![{BLANK}])[{BLANK}]*+\n\s*+"
#: Pieces of tokens: the amount that a figure begins with, a whole day of three parts, a whole amount with marks.
AMOUNT, DAY, MARKED = r"([.,]?\d+(?:[.,]+\d+)*)", r"(\d+[/-]\d+[/-]\d+)(?= )", r" (\d+(?:[.,]+\d+)+) "
#: Rules of dates.
YEAR_FIRST, LABELLED, ISO, BESIDE = "labelled, year first", "labelled", "iso", "beside a time or mark"
LINES = "array<struct<s string, low string, tokens string, words string>>"
CANDIDATE = "array<struct<field string, rule string, line int, raw string>>"


def _trimmed(text: Column) -> Column:
    """The lines with something in them, without the blanks around them, each but the last with a line break."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s++", ""), LINE_END, "\n"), r"(?<!\s)\s++\z", "")


def _spaced(low: Column) -> Column:
    """Lines as their tokens, without the light marks, a blank before each and behind the last."""
    return F.regexp_replace(low, rf"[{BLANK}{LIGHT}]*+(?:({TOKEN})|(?=\n|\z))", " $1")


def _lines(trimmed: Column, low: Column, spaced: Column) -> Column:
    """Each line as s, low (in lower case and without accents), tokens (as _spaced writes them) and words (those of the tokens that are words)."""
    words = F.regexp_replace(spaced, r" [^\p{L}\s]\S*", "")
    cut = F.arrays_zip(*(F.split(x, "\n").alias(n) for x, n in ((trimmed, "s"), (low, "low"), (spaced, "tokens"), (words, "words"))))
    return F.when(trimmed != "", cut).otherwise(F.array().cast(LINES))


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _found(tokens: Column, pattern: str) -> Column:
    """The first group of each match."""
    return F.regexp_extract_all(tokens, F.lit(pattern), F.lit(1))


def _one(tokens: Column, pattern: str) -> Column:
    """The first match's first group; empty without one."""
    return F.regexp_extract(tokens, pattern, 1)


def _has_mark(raw: Column) -> Column:
    return raw.contains(".") | raw.contains(",")


def _is_amount(raw: Column) -> Column:
    """Whether a figure can be read as an amount; few digits with one mark at most within them always can."""
    return raw.rlike(r"^[.,]?\d{1,8}(?:[.,]\d{1,2})?\z") | marked_number(raw).isNotNull()


def _date(year: Column, month: Column, day: Column) -> Column:
    fits = (F.length(month) <= 2) & (F.length(day) <= 2)
    return F.when(fits, F.try_to_date(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def _parts(token: Column) -> tuple[Column, Column, Column]:
    return tuple(F.get(F.split(token, "[/-]"), F.lit(i)) for i in range(3))


def _year_first(token: Column) -> Column:
    """A date whose first part is a year of four digits."""
    year, month, day = _parts(token)
    return F.when(F.length(year) == 4, _date(year, month, day))


def _day_first(token: Column) -> Column:
    """Day, month, year; years of two digits up to 68 are in this century."""
    day, month, year = _parts(token)
    century = F.when(F.length(year) == 4, "").when(F.length(year) == 2, F.when(year <= "68", "20").otherwise("19"))
    return _date(F.concat(century, year), month, day)


def _says(words: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (words.contains(f" {p} ") for p in phrases))


def _tax_id(low: Column) -> Column:
    """An id of three or four letters, six digits and three more signs behind its label, in up to three pieces."""
    pieces = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}&]+"), F.lit(0))

    def behind(piece: Column, i: Column) -> Column:
        start = F.when(piece.isin("rfc", "nit"), i + 2).when((piece == "tax") & (F.get(pieces, i + 1) == "id"), i + 3)
        tries = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.array_join(F.slice(pieces, start, n), ""))
        return F.when(start.isNotNull(), _first(F.filter(tries, lambda x: x.rlike(r"^[\p{L}&]{3,4}\d{6}[\p{L}\d]{3}$"))))

    return F.upper(_first(F.array_compact(F.transform(pieces, behind))))


def _is_provider(s: Column, low: Column) -> Column:
    """Neither a field, a heading nor an amount, and capitalised: three capitals in a row, or two words that begin with one."""
    other = r"[^\p{L}\p{N}_]"
    field = low.rlike(rf"^(?:{'|'.join(w.replace(' ', other + '+') for w in FIELD_LABELS)})(?:{other}|\z)")
    heading = low.rlike("|".join(HEADINGS))
    money = F.translate(F.substring_index(s, " ", -1), "$€0123456789.,", "") == ""
    names = F.filter(F.regexp_extract_all(s, F.lit(r"[\p{L}'-]+"), F.lit(0)), lambda w: (F.length(w) > 2) & (F.lower(w.substr(1, 1)) != w.substr(1, 1)))
    return (F.length(s) >= 4) & ~s.contains(":") & ~money & (s.rlike("[A-Z]{3}") | (F.size(names) >= 2)) & ~heading & ~field


def _candidate(field: str, rule: str, line: Column, raw: Column) -> Column:
    """What a line puts forward for a field; raw is null or empty where that is nothing."""
    return F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), line.alias("line"), raw.alias("raw"))


def _amounts_of(lines: Column, x: Column, i: Column) -> Column:
    """What a line puts forward for subtotal, tax, total and amount due. A rate in brackets may stand between a tax and its amount."""
    tokens, words = x["tokens"], x["words"]
    beside = lambda labels, between="": _first(F.filter(_found(tokens, f"(?<= (?:{labels}) ){between}{AMOUNT}"), _is_amount))
    rest = F.substr(tokens, F.instr(tokens, f" {TOTAL} ") + len(TOTAL) + 1)
    below = F.when(~rest.rlike(r"\d"), _one(F.try_element_at(lines, i + 2)["tokens"], r"^ (\d[\d.,]*) +\z"))
    options = [_candidate("total", rule, i, raw) for rule, raw in (("beside", beside(TOTAL)), ("later", _one(rest, MARKED)), ("below", below))]
    total = F.slice(F.filter(F.array(*options), lambda o: o["raw"] != ""), 1, 1)
    sub, tax, due = beside(f"{SUBTOTAL}|{SUB} {TOTAL}|{SUB} - {TOTAL}"), beside("|".join(TAXES), r"(?:\( \S+ % \) )?"), beside(f"{TOTAL}|{DUE}", f"(?<! - (?:{TOTAL}|{DUE}) )")
    some = lambda present, made: F.when(present, made).otherwise(_nothing())
    saving, labelled = _says(words, SAVINGS), _says(words, (TOTAL, DUE))
    whole = tokens.contains(f" {TOTAL} ") & ~F.replace(words, F.lit(" "), F.lit("")).contains(SUBTOTAL)
    return F.concat(
        some(words.contains(f" {SUB}"), F.array(_candidate("subtotal", "beside", i, sub))),
        some(~saving, F.concat(
            some(_says(words, TAXES), F.array(_candidate("tax", "beside", i, tax))), some(whole, total), some(labelled, F.array(_candidate("due", "beside", i, due))),
        )),
    )


def _dates_of(x: Column, i: Column) -> Column:
    """V07e: what a line puts forward as the date. The kind of a date may stand between its label and the date."""
    tokens, words = x["tokens"], x["words"]
    first = lambda found, read: _first(F.filter(found, lambda k: read(k).isNotNull()))
    labelled = _found(tokens, f"(?<= {DATE} )(?:(?:{'|'.join(DATE_KINDS)}) )?{DAY}")
    marked = _says(words, RECEIPT_WORDS) | tokens.rlike(r" [0-2]\d:[0-5]\d(?::\d+)? | (?:#|no|no \.) \d")
    expires = reduce(lambda a, b: a | b, (words.contains(f" {w}") for w in EXPIRY_STEMS))
    return F.concat(
        F.when(words.contains(f" {DATE} "), F.array(_candidate("date", YEAR_FIRST, i, first(labelled, _year_first)), _candidate("date", LABELLED, i, first(labelled, _day_first)))).otherwise(_nothing()),
        F.array(
            _candidate("date", ISO, i, first(_found(tokens, r"(?<= )(\d{4}-\d\d-\d\d)(?= )"), _year_first)),
            _candidate("date", BESIDE, i, F.when(marked & ~expires, first(_found(tokens, f"(?<= ){DAY}"), _day_first))),
        ),
    )


def _nothing() -> Column:
    return F.array().cast(CANDIDATE)


def candidates(lines: Column) -> Column:
    """All that the lines put forward, in their order (field, rule, line, raw); a line without labels, dates or a name adds nothing."""

    def named(x: Column, i: Column) -> Column:
        label = F.trim(F.regexp_replace(F.substring_index(x["low"], ":", 1), r"\s+", " "))
        name = F.trim(F.regexp_replace(x["s"], "^[^:]*:", ""))
        told = F.when(label.isin(*ISSUER_LABELS) & _is_provider(name, strip_accents(F.lower(name))), name)
        # a name by its look has no colon
        return F.array(F.when(x["s"].contains(":"), _candidate("provider", "issuer", i, told)).otherwise(_candidate("provider", "look", i, F.when(_is_provider(x["s"], x["low"]), x["s"]))))

    def one(x: Column, i: Column) -> Column:
        number = x["low"].rlike(r"\d")
        return F.concat(
            F.when(i < HEAD_LINES, named(x, i)).otherwise(_nothing()),
            F.when(_says(x["words"], TAX_ID_LABELS) & number, F.array(_candidate("tax_id", "labelled", i, _tax_id(x["low"])))).otherwise(_nothing()),
            F.when(_says(x["words"], (TOTAL, SUBTOTAL, DUE, *TAXES)) & (number | x["words"].contains(TOTAL)), _amounts_of(lines, x, i)).otherwise(_nothing()),
            F.when(x["low"].rlike(r"\d[/-]\d"), _dates_of(x, i)).otherwise(_nothing()),
        )

    return F.filter(F.flatten(F.transform(lines, one)), lambda c: c["raw"] != "")


def _valued(found: Column) -> Column:
    """The candidates with what their texts are read as: amounts, or days; those that can't be read are left out."""
    amount = lambda c: F.when(c["field"].isin("subtotal", "tax", "total", "due"), marked_number(c["raw"]))
    day = lambda c: F.when(c["field"] == "date", F.when(c["rule"].isin(YEAR_FIRST, ISO), _year_first(c["raw"])).otherwise(_day_first(c["raw"])))
    rows = F.transform(found, lambda c: F.struct(c["field"], c["rule"], c["line"], c["raw"], amount(c).alias("amount"), day(c).alias("day")))
    return F.filter(rows, lambda c: c["field"].isin("provider", "tax_id") | c["amount"].isNotNull() | c["day"].isNotNull())


def _of(found: Column, field: str, *rules: str) -> Column:
    return F.filter(found, lambda c: (c["field"] == field) & (c["rule"].isin(*rules) if rules else F.lit(True)))


def _strongest(found: Column, last: bool) -> Column:
    """Amounts with a point or comma go before bare digits; of equal ones the last line's or the first one's."""
    ranked = F.transform(found, lambda c: F.struct(_has_mark(c["raw"]).alias("marked"), (c["line"] if last else -c["line"]).alias("at"), c.alias("c")))
    return F.array_max(ranked)["c"]


def _times(lines: Column, value: Column, with_savings: bool) -> Column:
    """How often an amount is printed."""
    printed = lines if with_savings else F.filter(lines, lambda x: ~_says(x["words"], SAVINGS))
    figures = lambda x: F.filter(F.split(x["tokens"], "[ /:-]+"), lambda k: k.rlike(r"^[.,]?\d"))
    return F.size(F.filter(F.flatten(F.transform(printed, figures)), lambda n: F.coalesce(marked_number(F.ltrim(n, F.lit(".,"))) == value, F.lit(False))))


def corroborated(lines: Column, amount: Column, subtotal: Column, tax_seen: Column) -> Column:
    """Without a tax line the subtotal replaces a total printed once where the subtotal is printed twice and their difference never."""
    doubt = ~tax_seen & (amount > 0) & (subtotal > 0) & (amount != subtotal)
    return F.when(doubt & (_times(lines, F.abs(amount - subtotal), True) == 0) & (_times(lines, subtotal, False) >= 2) & (_times(lines, amount, False) == 1), subtotal).otherwise(amount).cast(MONEY)


def parsed_receipts(texts: DataFrame, text: str = "text", trace: str | None = None) -> DataFrame:
    """Texts with provider_name, provider_tax_id, subtotal, tax_amount, total_amount and expense_date.

    V07b: of lines labelled total (no subtotals, no savings) the strongest amount, of equal ones the last; the amount may stand
    later in the line or alone on the next one. Without any, of lines labelled total or importe the strongest, first one.
    V07e: the last labelled date with the year first, else the first labelled or ISO date, else a day beside a time or a
    receipt's mark; expiry lines don't count there. V07d: the tax becomes 0 where total and subtotal are equal.
    Null texts have an unknown provider and a total of 0.
    V24: with `trace`, a column of that name tells where each field is from: array of field, line, rule, raw and chosen, first the
    candidates in the order of the lines, then (line null) rules that set a field afterwards. Unfold it with posexplode_outer, or from a stored table.
    """
    # each step is a column of its own that the next ones name more than once, so that no line is cut twice
    rows = texts.withColumn("__bare", _trimmed(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("__low", F.lower("__bare"))
    rows = rows.withColumn("__low", F.when(F.octet_length("__low") > F.length("__low"), strip_accents(F.col("__low"))).otherwise(F.col("__low")))
    rows = rows.withColumn("__tokens", _spaced(F.col("__low")))
    rows = rows.withColumn("__lines", _lines(F.col("__bare"), F.col("__low"), F.col("__tokens")))
    rows = rows.withColumn("__raw", candidates(F.col("__lines")))
    rows = rows.withColumn("__found", _valued(F.col("__raw")))
    found = F.col("__found")
    dated = lambda *rules: _of(found, "date", *rules)
    rows = rows.withColumns({
        "__subtotal": F.try_element_at(_of(found, "subtotal"), F.lit(-1)), "__tax": F.try_element_at(_of(found, "tax"), F.lit(-1)),
        "__total": _strongest(_of(found, "total"), last=True), "__due": _strongest(_of(found, "due"), last=False),
        "__provider": _first(_of(found, "provider")), "__tax_id": _first(_of(found, "tax_id")),
        "__date": F.coalesce(F.try_element_at(dated(YEAR_FIRST), F.lit(-1)), _first(dated(LABELLED, ISO)), _first(dated(BESIDE))),
    })
    rows = rows.withColumn("__whole", F.coalesce(F.when(F.col("__total")["amount"] != 0, F.col("__total")), F.col("__due")))
    printed, subtotal, seen = F.coalesce(F.col("__whole")["amount"], F.lit(0)).cast(MONEY), F.col("__subtotal")["amount"], F.col("__tax").isNotNull()
    rows = rows.withColumns({
        "provider_name": F.coalesce(F.col("__provider")["raw"], F.lit(UNKNOWN_PROVIDER)), "provider_tax_id": F.col("__tax_id")["raw"], "subtotal": subtotal,
        "total_amount": corroborated(F.col("__lines"), printed, F.coalesce(subtotal, F.lit(0)), seen), "expense_date": F.col("__date")["day"],
    })
    untaxed = F.coalesce((F.col("subtotal") > 0) & (F.col("total_amount") == F.col("subtotal")), F.lit(False))
    rows = rows.withColumn("tax_amount", F.when(untaxed, F.lit(0)).otherwise(F.coalesce(F.col("__tax")["amount"], F.lit(0))).cast(MONEY))
    picks = ("__provider", "__tax_id", "__subtotal", "__tax", "__whole", "__date")
    if trace is not None:
        # the picks are an element of an array, so that they aren't made anew for each candidate
        told = lambda p: F.transform(found, lambda c: F.struct(c["field"], c["line"], c["rule"], c["raw"], F.coalesce(F.array_contains(p, c), F.lit(False)).alias("chosen")))
        reasons = F.flatten(F.transform(F.array(F.array_compact(F.array(*[F.col(p) for p in picks]))), told))
        step = lambda field, rule, when: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(None).cast("int").alias("line"), F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("raw"), F.lit(True).alias("chosen")))
        later = F.array_compact(F.array(step("total", "subtotal printed oftener", F.col("total_amount") != printed), step("tax", "total is the subtotal", untaxed & seen & (F.col("__tax")["amount"] != 0))))
        rows = rows.withColumn(trace, F.concat(reasons, later))
    return rows.drop("__bare", "__low", "__tokens", "__lines", "__raw", "__found", "__total", "__due", *picks)


def reading_scores(texts: DataFrame, text: str = "text") -> DataFrame:
    """parsed_receipts with score (20 for a total, 10 for a tax id, 40 where subtotal and tax make the total, and the text's
    points) and good: from GOOD_SCORE on no other reading can be better."""
    rows = parsed_receipts(texts, text)
    whole = F.col("total_amount")
    agrees = F.coalesce((whole > 0) & (F.col("subtotal") + F.col("tax_amount") == whole), F.lit(False))
    score = F.when(whole > 0, 20).otherwise(0) + F.when(F.col("provider_tax_id").isNotNull(), 10).otherwise(0) + F.when(agrees, 40).otherwise(0) + text_quality(F.col(text))
    return rows.withColumn("score", score.cast("int")).withColumn("good", F.col("score") >= GOOD_SCORE)


#: Pieces of JSON: closed strings, marks, bare words and numbers, and a string that never closes.
JSON_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]+|".*'
#: Fields of an answer, each with the names that it may have there.
ANSWER_TEXTS = {"provider_name": (), "provider_tax_id": (), "invoice_number": (), "currency": (), "raw_text": ()}
ANSWER_AMOUNTS = {"total_amount": ("total",), "tax_amount": (), "subtotal": (), "excise_amount": ("ieps_amount",)}
ANSWER_DATES = {"expense_date": ("invoice_date",)}
NULL_WORDS = ("null", "none", "n/a", "", "desconocido")
LEVEL = "struct<depth int, key string, ready boolean, value string, pairs array<struct<key string, value string>>>"


def json_pairs(answer: Column) -> Column:
    """The names and values (both as JSON writes them) of the first object in a text, whole or cut, in order.

    Strings are read with their escapes, so that marks inside them don't count; what is nested is left out with its names. A number
    or word that nothing follows may have been cut itself and is left out; text before and after the object is ignored.
    """
    cut = F.regexp_extract_all(F.substring(answer, F.instr(answer, "{"), F.length(answer)), F.lit(JSON_TOKEN), F.lit(0))
    sort = lambda t: F.when(t.startswith('"'), F.when((F.length(t) > 1) & t.endswith('"'), "string").otherwise("open string")).when(t.isin("{", "["), "{").when(t.isin("}", "]"), "}").when(t.isin(",", ":"), t).otherwise("bare")
    tokens = F.transform(cut, lambda t: F.struct(t.alias("t"), sort(t).alias("sort")))
    start = F.expr("struct(0 AS depth, cast(null AS string) AS key, false AS ready, cast(null AS string) AS value, array() AS pairs)").cast(LEVEL)

    def state(at: Column, depth=None, key=None, ready=None, value=None, pairs=None) -> Column:
        new = {"depth": depth, "key": key, "ready": ready, "value": value, "pairs": pairs}
        return F.struct(*[(at[n] if v is None else v).alias(n) for n, v in new.items()])

    def step(at: Column, token: Column) -> Column:
        t, sort, none, no, one = token["t"], token["sort"], F.lit(None).cast("string"), F.lit(False), F.lit(1)
        with_pair = lambda value: F.concat(at["pairs"], F.array(F.struct(at["key"].alias("key"), value.alias("value"))))
        kept = F.when(at["value"].isNotNull(), with_pair(at["value"])).otherwise(at["pairs"])
        # once the object has been closed, its depth is -1 and nothing counts any more
        return (
            F.when(at["depth"] < 0, at)
            .when(at["depth"] != 1, F.when(sort == "{", state(at, depth=at["depth"] + one)).when(sort == "}", state(at, depth=at["depth"] - one)).otherwise(at))
            .when(sort == "string", F.when(~at["ready"], state(at, key=t)).when(at["value"].isNull(), state(at, key=none, ready=no, pairs=with_pair(t))).otherwise(at))
            .when(sort == ":", F.when(at["key"].isNotNull(), state(at, ready=F.lit(True))).otherwise(at))
            .when(sort == "bare", F.when(at["ready"] & at["value"].isNull(), state(at, value=t)).otherwise(at))
            .when(sort == ",", state(at, key=none, ready=no, value=none, pairs=kept))
            .when(sort == "{", state(at, depth=F.lit(2), key=none, ready=no, value=none))
            .when(sort == "}", state(at, depth=F.lit(-1), key=none, ready=no, value=none, pairs=kept))
            .otherwise(at)
        )

    return F.when(F.coalesce(F.instr(answer, "{") > 0, F.lit(False)), F.aggregate(tokens, start, step, lambda at: at["pairs"])).otherwise(F.array().cast("array<struct<key string, value string>>"))


def _plain_json(value: Column) -> Column:
    """A string of JSON without its quotes and escapes; other values as they are."""
    lenient = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.when(value.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string", lenient)["v"]).otherwise(value)


def _iso(raw: Column) -> Column:
    return F.when(raw != "", _date(*_parts(raw)))


def repaired_json(answer: Column) -> Column:
    """A model's answer as a struct of ANSWER_TEXTS, ANSWER_AMOUNTS and ANSWER_DATES; null words are nulls, of a repeated name the last counts.

    Fences, text around the object and a cut end don't matter (see json_pairs); only names of the object itself count.
    """

    def made(pairs: Column) -> Column:
        def field(name: str, others: tuple[str, ...]) -> Column:
            own = F.filter(pairs, lambda p: p["key"].isin(f'"{name}"', *(f'"{o}"' for o in others)))
            plain = F.transform(F.slice(own, F.greatest(F.size(own), F.lit(1)), 1), lambda p: F.trim(_plain_json(p["value"])))
            return F.try_element_at(F.filter(plain, lambda v: ~F.lower(v).isin(*NULL_WORDS)), F.lit(1))

        texts = [field(n, o).alias(n) for n, o in ANSWER_TEXTS.items()]
        amounts = [receipt_number(field(n, o)).alias(n) for n, o in ANSWER_AMOUNTS.items()]
        return F.struct(*texts, *amounts, *[_iso(field(n, o)).alias(n) for n, o in ANSWER_DATES.items()])

    return F.get(F.transform(F.array(json_pairs(answer)), made), F.lit(0))


#: Lines that are handed on in one go.
PAGE_PART = 5_000


def lines_from_boxes(boxes: DataFrame, part: int = PAGE_PART) -> DataFrame:
    """Boxes (page_id, x0, x1, y0, y1, text) as lines (page_id, line, text): by top and left edge, a box joins the
    first line that it overlaps by more than half of the lower height; a line's boxes are read by their left edges.

    Where no box above reaches below a box's top, no line goes across: a page is cut there into islands. A task reads its pages
    as one stream of boxes and holds an island's lines and about `part` finished ones. Boxes without text or place have no line.
    """
    w = Window.partitionBy("page_id").orderBy("y0", "x0", "y1", "x1", "text")
    seen = boxes.where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]") & ~F.isnull(F.col("x0") + F.col("x1") + F.col("y0") + F.col("y1")))
    lowest = F.max(F.greatest("y0", "y1")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = seen.select("page_id", F.row_number().over(w).alias("n"), F.coalesce(F.least("y0", "y1") >= lowest, F.lit(True)).alias("fresh"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "y1")), "text")
    schema = T.StructType([boxes.schema["page_id"], T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())])

    def merged(batches):
        island: list[list] = []  # top, bottom, boxes of each line
        out: list[tuple] = []
        page, number = None, 0

        def close() -> None:
            out.extend((page, number + i, " ".join(text for _, text in sorted(line[2], key=lambda b: b[0]))) for i, line in enumerate(island))

        def handed_on(kind: pa.DataType) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (kind, pa.int32(), pa.string()), strict=True)], names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("page_id").type
            for at, n, fresh, x0, y0, y1, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fresh or n == 1:
                    close()
                    page, number, island = at, 0 if n == 1 else number + len(island), []
                for line in island:
                    overlap = min(line[1], y1) - max(line[0], y0)
                    if overlap > 0.5 * min(line[1] - line[0], y1 - y0):
                        line[0], line[1] = min(line[0], y0), max(line[1], y1)
                        line[2].append((x0, text))
                        break
                else:
                    island.append([y0, y1, [(x0, text)]])
                if len(out) >= part:
                    yield handed_on(kind)
                    out.clear()
        if kind is not None:
            close()
            yield handed_on(kind)

    # a page's boxes are in one task since they were numbered
    return rows.sortWithinPartitions("page_id", "n").mapInArrow(merged, schema)
