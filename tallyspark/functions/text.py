"""Scalar text functions, all in built-in expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their base letters, from their canonical decompositions.
_PAIRS = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
_PAIRS = [(c, d[0]) for c, d in _PAIRS if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
_ACCENTED, _BASE = "".join(c for c, _ in _PAIRS), "".join(b for _, b in _PAIRS)

UNCLASSIFIED = "SIN_CLASIFICAR"
UNKNOWN_PROVIDER = "Unknown Provider"

# Categories in their canonical order: key, label, whether they vary with activity.
CATEGORIES = (
    ("RENTA", "Renta", False), ("SERVICIOS_PROFESIONALES", "Servicios profesionales", False), ("SERVICIOS", "Servicios (internet, luz, tel)", False),
    ("SOFTWARE", "Software y suscripciones", False), ("IMPUESTOS", "Impuestos y retenciones", False), ("SUELDOS", "Sueldos y prestaciones", False),
    ("EQUIPO", "Equipo de computo", False), ("ALIMENTACION", "Alimentacion", True), ("BEBIDAS", "Bebidas y despensa", True), ("COMBUSTIBLE", "Combustible", True),
    ("TRANSPORTE", "Transporte y casetas", True), ("VIATICOS", "Viaticos", True), ("MATERIALES", "Materiales de construccion", True),
    ("HERRAMIENTAS", "Herramientas", True), ("MANTENIMIENTO", "Mantenimiento", True), ("PAPELERIA", "Papeleria", True), ("OTROS", "Otros", True),
    (UNCLASSIFIED, "Sin clasificar", True),
)

TAX_ID = r"[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}"
PERIOD = r"^\d{4}-(0[1-9]|1[0-2])\z"
SHA256 = r"^[0-9a-f]{64}\z"


def strip_accents(s: Column) -> Column:
    """Accented Latin letters without their accents, combining marks removed."""
    return F.regexp_replace(F.translate(s, _ACCENTED, _BASE), r"\p{Mn}", "")


# Hangul syllables stand in the order of their leading consonants, vowels and final consonants (none first).
_SYLLABLES, _LAST_SYLLABLE = 0xAC00, 0xD7A3
_LEADS, _VOWELS, _FINALS = ([chr(first + i) for i in range(n)] for first, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28)))
_FINALS[0] = ""


@functools.cache
def _decompositions() -> tuple[str, str, str, str]:
    """All characters with a compatibility decomposition, marks left out: those of one character or none, and the characters
    of the former in the same order; those of several, and these texts, each after a separator."""
    single, base, none, several, texts = [], [], [], [], []
    for code in (*range(0x80, 0xAC00), *range(0xE000, 0x110000)):
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) > 1:
            several.append(c)
            texts.append(d)
        elif d != c:
            (single if d else none).append(c)
            base.append(d)
    return "".join(single + none), "".join(base), "".join(several), "\x1f".join(texts)


def folded(s: Column) -> Column:
    """Compatibility decomposition without marks: ﬁ as fi, full width as plain letters, ½ as 1⁄2, Hangul as its letters. Plain ASCII is passed through."""
    single, base, several, texts = _decompositions()

    def spelt(c: Column) -> Column:
        k = F.ascii(c) - _SYLLABLES
        letter = lambda letters, at: F.get(F.split(F.lit("\x1f".join(letters)), "\x1f"), at.cast("int"))
        syllable = F.concat(letter(_LEADS, F.floor(k / 588)), letter(_VOWELS, F.floor(k % 588 / 28)), letter(_FINALS, k % 28))
        return F.when(k.between(0, _LAST_SYLLABLE - _SYLLABLES), syllable).otherwise(F.coalesce(F.get(F.split(F.lit(texts), "\x1f"), F.position(c, F.lit(several)) - 1), c))

    some = (F.length(F.translate(s, several, "")) < F.length(s)) | s.rlike(f"[{chr(_SYLLABLES)}-{chr(_LAST_SYLLABLE)}]")
    spelt_out = F.when(some, F.array_join(F.transform(F.split(s, ""), spelt), "")).otherwise(s)
    return F.when(F.octet_length(s) > F.length(s), F.translate(spelt_out, single, base)).otherwise(s)


def comparable(s: Column) -> Column:
    """upper case, decomposed without accents, each run of other than A-Z 0-9 one space."""
    return F.trim(F.regexp_replace(F.upper(folded(F.coalesce(s, F.lit("")))), "[^A-Z0-9]+", " "))


def long_words(provider: Column) -> Column:
    """The provider's words of three letters or more, in comparable form."""
    return F.filter(F.split(comparable(provider), " "), lambda w: F.length(w) >= 3)


def mentions_words(words: Column, text: Column) -> Column:
    """All words (of long_words) occur in the comparable text; false without words."""
    # the last word, often a number, turns most texts away at once
    return (F.size(words) > 0) & text.contains(F.try_element_at(words, F.lit(-1))) & F.forall(words, lambda w: text.contains(w))


def first_and_last_words(words: Column) -> tuple[Column, Column]:
    """Of long_words: all but the last, joined by spaces, as first, and the last (empty without words)."""
    first = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return first.alias("first"), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("last")


def mentions_joined(first: Column, last: Column, text: Column) -> Column:
    """mentions_words by first_and_last_words, without a function over elements, which Spark interprets: for very many pairs."""
    others = F.concat(F.lit("^(?=.*"), F.replace(first, F.lit(" "), F.lit(")(?=.*")), F.lit(")"))
    return (last != "") & text.contains(last) & F.rlike(text, others)


def mentions(provider: Column, description: Column) -> Column:
    """All words of three letters or more of the provider occur in the description; false without such words."""
    return mentions_words(long_words(provider), comparable(description))


def category_key(s: Column) -> Column:
    """the key that categories are grouped by; null and blank are unclassified."""
    bare = F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", UNCLASSIFIED).otherwise(folded(F.upper(bare)))


def no_category(s: Column) -> Column:
    """Null or only spaces."""
    return s.isNull() | (F.trim(s) == "")


def capitalised(key: Column) -> Column:
    """First letter upper, the rest lower, underscores as spaces."""
    return F.replace(F.concat(F.upper(F.substring(key, 1, 1)), F.lower(F.substring(key, F.lit(2), F.length(key)))), F.lit("_"), F.lit(" "))


def category_label(key: Column) -> Column:
    """the label of a key; unknown keys are shown capitalised."""
    out = F.lit(None).cast("string")
    for name, label, _ in CATEGORIES:
        out = F.when(key == name, label).otherwise(out)
    return F.coalesce(out, capitalised(key))


def category_varies(key: Column) -> Column:
    """whether a category varies with activity; unknown keys do."""
    return ~key.isin(*[name for name, _, varies in CATEGORIES if not varies])


def category_order(key: Column) -> Column:
    """Position in the canonical order; unknown keys after all others."""
    out = F.lit(10000)
    for i, (name, _, _) in enumerate(CATEGORIES):
        out = F.when(key == name, i).otherwise(out)
    return out


def description_key(s: Column) -> Column:
    """Trimmed, lower case, no accents, single spaces, no marks at the ends."""
    blank = r"[\s\x1c-\x1f]+"
    bare = folded(F.lower(F.regexp_replace(s, rf"(?U)^{blank}|{blank}$", "")))
    return F.btrim(F.regexp_replace(bare, f"(?U){blank}", " "), F.lit(" .,:;-*#"))


def formula_guard(s: Column) -> Column:
    """a leading quote before what a spreadsheet would run as a formula."""
    return F.when(s.rlike(r"^\s*[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def latin1(s: Column) -> Column:
    """dashes, quotes and dots that Latin-1 lacks as plain ones; all else beyond it as ?."""
    plain = F.translate(s, "–—‘’“”• ", "--''\"\"* ")
    return F.regexp_replace(F.replace(F.replace(plain, F.lit("…"), F.lit("...")), F.lit("€"), F.lit("EUR")), r"[^\x00-\xFF]", "?")


def tax_id(s: Column) -> Column:
    """the first tax id of a text, in canonical form (upper case, no blanks or dashes inside); null without one."""
    found = F.regexp_extract(F.upper(s), r"(?<![A-Z0-9Ñ&])([A-ZÑ&]{3,4})[ -]?(\d{6})[ -]?([A-Z0-9]{3})(?![A-Z0-9])", 0)
    return F.when(found != "", F.regexp_replace(found, "[ -]", ""))


def valid_tax_id(s: Column) -> Column:
    return F.upper(F.trim(s)).rlike(rf"^{TAX_ID}\z")


def without_legal_suffix(s: Column) -> Column:
    """without a company's legal form at the end (S.A. de C.V., S. de R.L., S.C. and the like)."""
    form = r"(?i)[\s,]+(?:S\.?\s*A\.?(?:\s*P\.?\s*I\.?)?|S\.?\s*de\s*R\.?\s*L\.?|S\.?\s*C\.?|A\.?\s*C\.?)(?:\s*de\s*C\.?\s*V\.?)?[\s.]*$"
    return F.trim(F.regexp_replace(s, form, ""))


def capped_text(s: Column, limit: int = 20_000, head: int = 12_000, tail: int = 8_000, marker: str = "\n[...]\n") -> Column:
    """A text beyond the limit as its head, a marker and its tail."""
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, head), F.lit(marker), F.substring(s, F.length(s) - tail + 1, F.lit(tail)))).otherwise(s)


def file_name(*parts: Column, extension: str) -> Column:
    """a safe file name: words of letters and digits joined by underscores, lower case."""
    joined = F.lower(folded(F.concat_ws("_", *parts)))
    return F.concat(F.btrim(F.regexp_replace(joined, r"[^a-z0-9._-]+", "_"), F.lit("_")), F.lit(f".{extension}"))


def list_items(s: Column) -> Column:
    """A comma-separated list: trimmed items, empty ones dropped."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def text_quality(s: Column) -> Column:
    """0 to 5 points for how much a text looks like a receipt's."""
    n = F.length(s)
    share = F.regexp_count(s, F.lit(r"[\p{L}\p{N} .,;:-]")) / F.greatest(n, F.lit(1))
    words = ("total", "subtotal", "iva", "importe", "rfc", "fecha", "caja", "cajero")
    hits = sum((F.lower(s).contains(w).cast("int") for w in words), F.lit(0))
    points = F.when(share > 0.75, 2).when(share > 0.6, 1).otherwise(0) + (n > 200).cast("int") + (n > 600).cast("int") + F.least(hits, F.lit(2))
    return F.when(F.coalesce(s, F.lit("")) == "", 0).otherwise(F.least(points, F.lit(5)))


# Answers that name nobody, words of headings and of addresses, articles that may open a name, words of one letter, legal forms with points.
NOBODY = ("UNKNOWN", "ERROR_PARSING", "AI_DISABLED")
HEADER_WORDS = (
    "TOTAL", "TOTALES", "SUBTOTAL", "BASE", "IVA", "IEPS", "ISR", "IMPUESTO", "IMPUESTOS", "IMPORTE", "MONTO", "CANTIDAD", "CANT", "ARTICULO", "ARTICULOS", "DESCRIPCION", "PRODUCTO", "PRODUCTOS", "FECHA", "HORA", "FOLIO",
    "FACTURA", "COMPROBANTE", "RECIBO", "RFC", "CURP", "CAMBIO", "EFECTIVO", "TARJETA", "DEBITO", "CREDITO", "TRANSFERENCIA", "CUENTA", "VENDEDOR", "CAJERO", "CAJERA", "TICKET", "VENTA", "CONSUMIDOR",
)
ADDRESS_WORDS = ("CALLE", "AVENIDA", "AVE", "NTE", "COLONIA", "CP", "TEL", "TELEFONO", "DIRECCION", "DOMICILIO")
ARTICLES = ("LA", "EL", "LOS", "LAS", "DE", "DEL", "UN", "UNA")
ONE_LETTER_WORDS = ("Y", "O", "E", "U")
POINTED_FORMS = ("S.A. DE C.V.", "S.A.B. DE C.V.", "S. DE R.L.", "S.R.L.", "S. EN C.", "S.C.", "A.C.")


def _pointed_form() -> str:
    """A pattern of the legal forms, with blanks wherever there is a point."""
    spelt = (r"\s*".join(r"\." if c == "." else r"\s+" if c == " " else c for c in form.removesuffix(".")) for form in POINTED_FORMS)
    return rf"(?i)\b(?:{'|'.join(spelt)})\.?"


def implausible_name(s: Column) -> Column:
    """A provider's name that looks like an address, a heading or scanning noise."""
    told = F.trim(F.coalesce(s, F.lit("")))
    words = F.filter(F.split(comparable(F.regexp_replace(told, _pointed_form(), " ")), " "), lambda w: w != "")
    first, rest = F.try_element_at(words, F.lit(1)), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    solid = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*ARTICLES))
    return (
        (F.size(words) == 0) | (told == UNKNOWN_PROVIDER) | F.upper(told).isin(*NOBODY) | (F.length(F.array_join(words, "")) < 4)
        | F.exists(words, lambda w: w.isin(*ADDRESS_WORDS)) | F.exists(rest, lambda w: w.rlike(r"^\d+$"))
        | ((F.length(first) <= 2) & ~first.isin(*ARTICLES) & ~first.rlike(r"^\d+$")) | F.exists(rest, lambda w: (F.length(w) == 1) & ~w.isin(*ONE_LETTER_WORDS))
        | F.forall(words, lambda w: F.length(w) <= 3) | ((F.size(solid) > 0) & F.forall(solid, lambda w: w.isin(*HEADER_WORDS)))
    )


def magic_type(content: Column) -> Column:
    """Pdf, xml, image or unknown by a file's first bytes."""
    starts = lambda hexed: F.substring(F.hex(F.substring(content, 1, 16)), 1, len(hexed)) == hexed
    riff_webp = starts("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    head = F.lower(F.decode(F.substring(content, 1, 16), "ISO-8859-1"))
    return (
        F.when(starts("25504446"), "pdf").when(starts("FFD8FF") | starts("89504E470D0A1A0A") | starts("47494638") | starts("424D") | starts("49492A00") | starts("4D4D002A") | riff_webp, "image")
        .when(head.rlike(r"^(\xEF\xBB\xBF)?\s*<(\?xml|cfdi)"), "xml").otherwise("unknown")
    )


def is_plain_text(content: Column) -> Column:
    """Valid UTF-8 without NUL bytes whose first 2048 characters hold under 5 % of control characters."""
    head = F.substring(F.make_valid_utf8(content.cast("string")), 1, 2048)
    controls = F.regexp_count(head, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    return F.coalesce(F.is_valid_utf8(content.cast("string")) & ~F.hex(F.substring(content, 1, 2048)).rlike("^(..)*00") & (F.length(head) > 0) & (controls < 0.05 * F.length(head)), F.lit(False))
