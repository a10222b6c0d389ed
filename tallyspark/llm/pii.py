"""Surrogates for personal data, in DataFrame functions only.

Found are e-mail addresses, IPv4 and IPv6 addresses, telephone numbers, payment cards (Luhn), bank accounts (IBAN,
mod 97), US social security numbers, and names: after a form of address, a common given name, or words that introduce
a person. A name that a text gives once is found again wherever the text repeats it, whole or in part. Each
distinct entity gets a surrogate drawn from a keyed SHA-512 of its kind, canonical form and attempt:
same kind, same format (separators, lengths, check digits, upper case), for names the same gender and
script. Spellings of one entity share the canonical form and so the surrogate, in all documents; parts
of names are entities of their own, so "Mrs Smith" agrees with "Anna Smith". A surrogate that another
entity won, of whatever kind, or that is itself an entity of the corpus, is drawn again with the next attempt.
Whoever has the key can rebuild the mapping, so it is an argument without a default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, stored

MARK, ESCAPE = "﷐", "﷑"  # noncharacters: cut marks, and the escape for texts that hold them
MOST_ATTEMPTS = 40

# Forms of address by gender, and given names by gender.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "госпожа", "г-жа", "Κυρία")
NEUTRAL_TITLES = ("Dr", "Doctor", "Doktor", "Prof", "Professor", "Professeur", "Profesor", "Rev", "Mx", "Доктор", "Профессор")
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "господин", "г-н", "Κύριος")
FEMALE_NAMES = ("Anna", "Maria", "Mary", "Emma", "Olivia", "Sophia", "Sophie", "Elizabeth", "Jennifer", "Linda", "Patricia", "Susan", "Sarah", "Karen", "Nancy", "Laura", "Julia", "Katharina", "Claudia", "Sabine", "Petra", "Monika", "Camille", "Isabelle", "Nathalie", "Céline", "Carmen", "Lucía", "Isabel", "Ana", "Анна", "Мария", "Елена", "Ольга", "Ελένη", "Μαρία", "Emily", "Grace", "Hannah", "Ingrid", "Greta", "Chloé", "Giulia", "Francesca", "Fatima", "Aisha", "Leila", "Priya", "Yuki", "Mei", "Amina", "Zainab")
MALE_NAMES = ("John", "James", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Peter", "Paul", "Hans", "Klaus", "Jürgen", "Stefan", "Wolfgang", "Pierre", "Jean", "Michel", "Philippe", "François", "Carlos", "José", "Juan", "Javier", "Miguel", "Antonio", "Иван", "Сергей", "Дмитрий", "Николай", "Γιώργος", "Νίκος", "Mark", "George", "Henry", "Lukas", "Matthias", "Giovanni", "Marco", "Luca", "Mohammed", "Muhammad", "Ahmed", "Omar", "Hassan", "Ibrahim", "Raj", "Hiroshi", "Kenji", "Wei")

# Words between given name and surname that are no names, and words that introduce a person.
PARTICLES = ("de", "la", "las", "los", "del", "di", "da", "dos", "du", "le", "van", "von", "der", "den", "ten", "ter", "zu", "zur", "al", "el", "bin", "ibn")
INTRODUCTIONS = ("My name is", "His name is", "Her name is", "Dear", "Sincerely,", "Best regards,", "Signed by", "Attn:", "Name:", "Full name:", "Contact:", "Mein Name ist", "Kontakt:", "Liebe", "Lieber", "Mit freundlichen Grüßen,", "Je m'appelle", "Nom:", "Me llamo", "Nombre:", "Меня зовут")

_LETTER, _BEFORE, _AFTER = r"\p{L}\p{N}", r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: A name's word may have inner capitals (McDonald), an apostrophe before one (O'Brien), or be all capitals.
_WORD, _INITIALS = r"\p{Lu}(?:['’](?=\p{Lu}\p{L})|\p{L})+", r"(?:\p{Lu}\.(?: |(?=\p{Lu})))"


def _any(words: tuple[str, ...]) -> str:
    """A pattern of the words, in which words with the same first letters share them: a place of the text is given up at its first letter that fits none."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[:1], []).append(w[1:])
    ends = tails.pop("", None) is not None
    found = "|".join(c + (_any(tuple(rest)) if any(rest) else "") for c, rest in tails.items())
    return f"(?:{found})" + ("?" if ends else "") if found else ""


def _either_case(words: tuple[str, ...]) -> str:
    return _any(tuple(dict.fromkeys((*words, *map(str.upper, words)))))


_TITLES, _NAMES = _either_case((*FEMALE_TITLES, *MALE_TITLES, *NEUTRAL_TITLES)), _either_case((*FEMALE_NAMES, *MALE_NAMES))
#: Lengths of accounts by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(length: int, countries: str) -> str:
    groups, left = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{left}}}" if left else "")


EMAIL = rf"(?<![{_LETTER}_%+-])[{_LETTER}_%+-]{{1,128}}+(?:\.[{_LETTER}_%+-]{{1,128}}+){{0,20}}@(?:[{_LETTER}](?:[{_LETTER}-]{{0,62}}[{_LETTER}])?\.){{1,8}}\p{{L}}{{2,24}}"
IP = rf"{_BEFORE}(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}{_AFTER}(?!\.\d)"
PHONE = rf"(?:(?<![{_LETTER}+])\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}|(?<![{_LETTER}+])\+[2-9]\d{{0,2}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|{_BEFORE}\(\d{{3}}\) ?\d{{3}}-\d{{4}}|{_BEFORE}(?<!\d )[2-9]\d{{2}} [2-9]\d{{2}} \d{{4}}(?! \d)|{_BEFORE}(?<!\d[ .-])0[1-9]\d{{1,3}}[ /-]\d{{5,8}}(?![ /]\d)|{_BEFORE}(?<!\d[-.])\d{{3}}([-.])\d{{3}}\1\d{{4}}){_AFTER}(?![-.]\d)"
SSN = rf"{_BEFORE}(?<!\d-)(?!000|666|9)\d{{3}}-(?!00)\d{{2}}-(?!0000)\d{{4}}{_AFTER}(?!-\d)"
CARD = rf"{_BEFORE}(?:\d{{13,19}}|\d{{4}}([ -])\d{{4}}\2\d{{4}}\2\d{{4}}|\d{{4}}([ -])\d{{6}}\3\d{{5}}){_AFTER}"
# a country's own length goes first, so a word behind the account stays outside; any other length as before
IBAN = rf"{_BEFORE}(?:{'|'.join(_account(n, c) for n, c in _IBAN_LENGTHS.items())}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?){_AFTER}"
_PARTICLE = rf"(?:{_any(PARTICLES)} ){{0,3}}+"
_INTRO = rf"{_any(INTRODUCTIONS)}[ \n]"
_PART = rf"{_INITIALS}{{0,3}}{_PARTICLE}{_WORD}(?:-{_WORD})?"
NAME = rf"{_BEFORE}(?:(?:(?:{_TITLES})\.? )+{_PART}(?: {_PART}){{0,2}}|(?:{_NAMES}) {_PART}(?: {_WORD})?|{_INTRO}(?!(?:{_TITLES})\b){_WORD}(?: {_PART}){{1,2}}){_AFTER}"
IPV6 = rf"(?<![{_LETTER}:])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,5}})?::(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,5}})?)(?![{_LETTER}:])"
# All but e-mail addresses begin with one of these; a look at one character passes over nearly every place of a text.
_HEAD = r"(?=[0-9+(A-ZÀ-ÞА-ЯΑ-Ωг])"
_NUMBERS = f"(?=[0-9+(])(?:{'|'.join((IP, PHONE, SSN, CARD))})"
_OTHERS = f"{_HEAD}(?:{_NUMBERS}|(?=[^0-9+(])(?:{IBAN}|{NAME}))"


def _by_marks(text: Column, build) -> Column:
    """build(pattern) with e-mail addresses only for texts that hold an @, and IPv6 addresses only for those with enough colons."""
    six = text.contains("::") | text.rlike("(?::[0-9A-Fa-f]{1,4}){7}")
    plain = F.when(text.contains("@"), build(f"{_OTHERS}|{EMAIL}")).otherwise(build(_OTHERS))
    return F.when(six, build(f"{IPV6}|{_OTHERS}|{EMAIL}")).otherwise(plain)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a text of digits modulo 10."""

    def add(total: Column, i: Column) -> Column:
        d = _at(digits, F.length(digits) + 1 - i).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.when(digits == "", None).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10)


def mod97(text: Column) -> Column:
    """A text of digits and A-Z (10..35) as a number modulo 97."""

    def add(total: Column, i: Column) -> Column:
        c = _at(text, i)
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), total * 10 + F.ascii(c) - 48).otherwise(total * 100 + letter) % 97

    return F.when(text == "", None).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add))


def _iban_sum(bare: Column) -> Column:
    return mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)))


def kind_of(s: Column) -> Column:
    """The kind of a candidate; null for numbers that fail their check."""
    bare = F.regexp_replace(s, " ", "")
    return (
        F.when(s.contains("@"), "email")
        .when(s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(s.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:"), F.when(s.rlike("[0-9A-Fa-f]"), "ip6"))
        .when(s.rlike(r"^\+|^\(|^\d{3}([-. ])\d{3}\1\d{4}$|^0[1-9]\d{1,3}[ /-]\d{5,8}$"), "phone")
        .when(s.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(s.rlike(r"^[A-Z]{2}\d{2}"), F.when(F.length(bare).between(15, 34) & (_iban_sum(bare) == 1), "iban"))
        .when(s.rlike(r"^\d"), F.when(luhn_sum(_digits(s)) == 0, "card"))
        .otherwise("name")
    )


def _script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


#: What stands before a name and stays; behind an introduction at least two words are a name, so that "Dear Sir" stays.
_TITLE_HEAD = rf"^(?:(?:(?:{_TITLES})\.? )+|{_INTRO})"
_NAME_PART = rf"(?<![\p{{L}}'’])(?!(?:{'|'.join(PARTICLES)})(?![\p{{L}}'’]))\p{{L}}+(?:['’]\p{{L}}+)*"


def _name_parts(s: Column) -> Column:
    """The words of a name, without its form of address, in order."""
    return F.regexp_extract_all(F.regexp_replace(s, _TITLE_HEAD, ""), F.lit(f"({_NAME_PART})"))


def _name_units(s: Column) -> Column:
    words = _name_parts(s)
    bare = F.regexp_replace(s, _TITLE_HEAD, "")
    told = lambda titles, names: s.rlike(rf"^(?:\S+ )?(?:{_either_case(titles)})\b") | bare.rlike(rf"^(?:{_either_case(names)}) ")
    gender = F.when(told(FEMALE_TITLES, FEMALE_NAMES), "f").when(told(MALE_TITLES, MALE_NAMES), "m").otherwise("n")
    # one word after a form of address is a surname; of more, the first is a given name
    first_given = (F.size(words) > 1) | ~s.rlike(_TITLE_HEAD)
    return F.transform(words, lambda w, i: F.struct(F.concat(F.when(first_given & (i == 0), F.concat(F.lit("given-"), gender)).otherwise("surname"), F.lit("-"), _script(w)).alias("kind"), F.lower(F.translate(w, "’", "'")).alias("canon")))


def units_of(s: Column, kind: Column) -> Column:
    """The entities (kind, canon) of a candidate: one, or for a name one for each word."""
    digits = _digits(s)
    canon = (
        F.when(kind == "phone", F.when(~s.startswith("+") & (F.length(digits) == 10) & ~digits.startswith("0"), F.concat(F.lit("1"), digits)).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(s, " ", ""))
        .otherwise(F.lower(s))
    )
    return F.when(kind == "name", _name_units(s)).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def segments(texts: DataFrame) -> DataFrame:
    """k and the text t cut into parts, structs (s, kind, units); kind and units are null for plain stretches."""
    # a column for each step, as each is named several times by the next
    rows = texts.select("k", found_segments(F.col("t")).alias("parts")).withColumn("names", _named(F.col("parts")))
    rows = rows.withColumn("again", repeated_names(F.col("names")))
    again = F.flatten(F.transform("parts", lambda x: F.when(x["kind"].isNull(), repeated_in(x["s"], F.col("again"), F.col("names"))).otherwise(F.array(x))))
    return rows.select("k", F.when(F.col("again").isNull(), F.col("parts")).otherwise(again).alias("parts"))


def _named(parts: Column) -> Column:
    return F.flatten(F.transform(F.filter(parts, lambda x: x["kind"] == "name"), lambda x: x["units"]))


def repeated_names(names: Column) -> Column:
    """A pattern of the names that a text gives, as it may repeat them: two in a row in any case, one with a capital; null without names."""
    words = F.array_sort(F.filter(F.array_distinct(F.transform(names, lambda u: u["canon"])), lambda w: F.length(w) > 1), lambda a, b: F.length(b) - F.length(a))
    one = F.replace(F.array_join(words, "|"), F.lit("'"), F.lit("['’]"))
    pattern = F.regexp_replace(F.lit(rf"{_BEFORE}(?:(?iu:#)(?:[ -](?iu:#))+|(?=\p{{Lu}})(?iu:#)){_AFTER}"), F.lit("#"), one)
    return F.when(one != "", pattern)


def repeated_in(s: Column, pattern: Column, names: Column) -> Column:
    """A plain stretch as segments, with the names that the text gives as entities like there."""
    cut = F.split(F.regexp_replace(s, pattern, F.lit(f"{MARK}$0{MARK}")), MARK)

    def segment(x: Column, i: Column) -> Column:
        units = F.transform(_name_parts(x), lambda w: F.get(F.filter(names, lambda u: u["canon"] == F.lower(F.translate(w, "’", "'"))), F.lit(0)))
        return F.struct(x.alias("s"), F.when(i % 2 == 1, "name").alias("kind"), F.when(i % 2 == 1, units).alias("units"))

    return F.transform(cut, segment)


def found_segments(text: Column) -> Column:
    """The segments by the patterns alone."""
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "m"))
    parts = F.split(_by_marks(safe, lambda p: F.regexp_replace(safe, f"(?:{p})", f"{MARK}$0{MARK}")), MARK)
    kinds = F.transform(parts, lambda s, i: F.struct(s.alias("s"), F.when(i % 2 == 1, kind_of(s)).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), F.when(x["kind"].isNotNull(), units_of(x["s"], x["kind"])).alias("units")))


def has_entities(text: Column) -> Column:
    safe = F.replace(text, F.lit(MARK), F.lit(ESCAPE))
    found = _by_marks(text, lambda p: F.regexp_extract_all(safe, F.lit(f"(?:{p})"), F.lit(0)))
    return F.coalesce(F.exists(found, lambda s: kind_of(s).isNotNull()), F.lit(False))


# --- surrogates ---------------------------------------------------------------------------------------

# Consonants, vowels, and the last letters of female, male and other given names.
_ALPHABETS = {"cyrillic": ("бвгдклмнпрстз", "аеиоу", "а", "н", "и"), "greek": ("βγδκλμνπρσ", "αειου", "α", "ς", "ι"), "latin": ("bdfgklmnprstvz", "aeiou", "a", "n", "i")}


def _draw(key: str, *parts: Column) -> Column:
    """128 hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 512)


def _number(draw: Column, i: Column | int, below: int) -> Column:
    """The i-th small number drawn, 0 .. below - 1."""
    at = (F.lit(i) if isinstance(i, int) else i) % 30 * 4 + 1
    return (F.conv(F.substring(draw, at, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _letter(draw: Column, i: Column, letters: str) -> Column:
    return _at(F.lit(letters), _number(draw, i, len(letters)) + 1)


def _reshaped(s: Column, draw: Column) -> Column:
    """s with each letter and digit drawn anew, in its script; marks stay."""

    def one(i: Column) -> Column:
        c = _at(s, i)
        cyrillic = F.when(c.rlike(r"\p{IsCyrillic}"), _letter(draw, i, "абвгдежзиклмнопрстуф"))
        greek = cyrillic.when(c.rlike(r"\p{IsGreek}"), _letter(draw, i, "αβγδεζηθικλμνοπρστυφ"))
        return greek.when(c.rlike(r"\d"), _letter(draw, i, "0123456789")).when(c.rlike(r"\p{L}"), _letter(draw, i, "abcdefghijklmnopqrstuvwxyz")).otherwise(c)

    return F.when(s == "", "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), ""))


def _drawn_digits(draw: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _letter(draw, i, "0123456789")), "")


def _syllables(draw: Column, n: Column, script: str) -> Column:
    consonants, vowels, *_ = _ALPHABETS[script]
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(_letter(draw, i * 2, consonants), _letter(draw, i * 2 + 1, vowels))), "")


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate's canonical form. Later attempts lengthen what has no fixed length."""
    draw = _draw(key, kind, canon, attempt.cast("string"))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), attempt * 2), lambda i: _letter(draw, i + 7, "abcdefghijklmnopqrstuvwxyz")), "")).otherwise("")
    labels, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.substring_index(domain, ".", -1)
    email = F.concat(_reshaped(local, draw), more, F.lit("@"), _reshaped(labels, _draw(key, F.lit("domain"), domain)), F.lit("."), top)
    ip = F.concat_ws(".", _number(draw, 0, 89) + 11, *[_number(draw, i, 256) for i in (1, 2, 3)])
    ip6 = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), _letter(draw, i + 1, "123456789abcdef")).otherwise(c)), "")
    nanp = canon.rlike("^1[0-9]{10}$")
    rest = _drawn_digits(draw, F.length(canon) - 2)
    ten = _drawn_digits(draw, F.lit(10))
    two_on = lambda s: F.translate(s, "01", "67")  # noqa: E731  area codes and exchanges begin with 2 to 9
    phone = F.when(nanp, F.concat(F.lit("1"), two_on(F.substring(ten, 1, 1)), F.substring(ten, 2, 2), two_on(F.substring(ten, 4, 1)), F.substring(ten, 5, 6))).otherwise(F.concat(F.substring(canon, 1, 2), rest))
    body = F.concat(F.substring(canon, 1, 1), _drawn_digits(draw, F.length(canon) - 2))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0")))) % 10).cast("string"))
    ssn = F.concat((_number(draw, 0, 500) + 100).cast("string"), F.lpad((_number(draw, 1, 99) + 1).cast("string"), 2, "0"), F.lpad((_number(draw, 2, 9999) + 1).cast("string"), 4, "0"))
    country, account = F.substring(canon, 1, 2), F.upper(_reshaped(F.lower(F.substring(canon, F.lit(5), F.length(canon))), draw))
    check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "iban", F.concat(country, check, account))
    for script, (_, _, female, male, other) in _ALPHABETS.items():
        n = F.lit(2) + (attempt / 2).cast("int")
        out = out.when(kind == f"given-f-{script}", F.concat(_syllables(draw, n, script), _letter(draw, F.lit(29), _ALPHABETS[script][0]), F.lit(female)))
        out = out.when(kind == f"given-m-{script}", F.concat(_syllables(draw, n, script), F.lit(male)))
        out = out.when(kind == f"given-n-{script}", F.concat(_syllables(draw, n, script), _letter(draw, F.lit(27), _ALPHABETS[script][0]), F.lit(other)))
        out = out.when(kind == f"surname-{script}", F.concat(_syllables(draw, n + 1, script), _letter(draw, F.lit(28), _ALPHABETS[script][0])))
    return out


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon and body of distinct entities (kind, canon): no body is given twice, to whatever kind, none is an entity.

    The first attempt settles nearly all; each further round only redraws what collided.
    """
    real = stored(entities.select("kind", "canon").distinct(), "entities")
    pending, settled = real.withColumn("attempt", F.lit(0)), None
    for _ in range(MOST_ATTEMPTS):
        # a small file is read by one task: dealt out again, drawing takes as many as there are
        dealt = pending.repartition("kind", "canon")
        drawn = stored(dealt.withColumn("body", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))), "drawn")
        # for each body: an entity of that name (0) or an earlier winner (1) goes before the candidates (2)
        claim = lambda role: F.struct(F.lit(role).alias("role"), "kind", "canon").alias("claim")
        claims = [real.select(F.col("canon").alias("body"), claim(0)), drawn.select("body", claim(2))]
        if settled is not None:
            claims.append(settled.select("body", claim(1)))
        won = reduce(DataFrame.unionByName, claims).groupBy("body").agg(F.min("claim").alias("claim")).where("claim.role = 2")
        new = won.select("claim.kind", "claim.canon", "body")
        settled = stored(new if settled is None else settled.unionByName(new), "settled")
        pending = stored(drawn.join(settled, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "pending")
        drop_stored(drawn)
        if pending.isEmpty():
            return settled
    raise RuntimeError("the surrogates of some kind are used up")


def _filled(s: Column, body: Column) -> Column:
    """s with its letters and digits taken from the end of body, in order; marks stay."""
    n = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))

    def one(i: Column) -> Column:
        c = _at(s, i)
        index = F.length(F.regexp_replace(F.substring(s, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), _at(body, F.length(body) - n + index)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")


def _cased(s: Column, body: Column) -> Column:
    upper = (s == F.upper(s)) & (s != F.lower(s)) & (F.length(s) > 1)
    titled = F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body)))
    initial = F.upper(F.substring(body, 1, 1))
    return F.when((F.length(s) == 1) & (s == F.upper(s)), initial).when(upper, F.upper(body)).when(F.substring(s, 1, 1) == F.lower(F.substring(s, 1, 1)), body).otherwise(titled)


def _unit_key(u: Column) -> Column:
    return F.concat(u["kind"], F.lit("|"), u["canon"])


def _rendered(x: Column, bodies: Column) -> Column:
    """A segment's new text; bodies: unit key -> surrogate."""
    body = bodies[_unit_key(F.element_at(x["units"], 1))]
    title = F.regexp_extract(x["s"], _TITLE_HEAD, 0)
    words, gaps = _name_parts(x["s"]), F.split(F.regexp_replace(x["s"], _TITLE_HEAD, ""), _NAME_PART)
    named = F.array_join(F.transform(words, lambda w, i: F.concat(_cased(w, bodies[_unit_key(x["units"][i])]), gaps[i + 1])), "")
    whole = F.when(x["kind"].isin("phone", "card", "ssn", "iban"), _filled(x["s"], body)).when(x["kind"] == "name", F.concat(title, gaps[0], named))
    upper = (x["s"] == F.upper(x["s"])) & (x["s"] != F.lower(x["s"]))
    return F.when(x["kind"].isNull(), x["s"]).otherwise(whole.otherwise(F.when(upper, F.upper(body)).otherwise(body)))


def with_surrogates(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with its columns, the text's entities replaced, and if wanted a column of how many were.

    key: a secret. Texts without entities, null and empty texts stay as they are. Repeated rows are treated alike; rows
    with null in any other column too. Inner columns take names that docs doesn't have; a column of the count's name is
    replaced. Only the documents that hold entities are shuffled; the others are passed on from the scan.
    """
    names = [c for c in docs.columns if c != count]
    docs = docs.select(*[docs[f"`{c}`"] for c in names])
    has, k, new_text, n = (fresh(docs, c) for c in ("has", "k", "new", "n"))
    body = F.col(f"`{text}`").cast("string")
    marked = docs.withColumn(has, has_entities(body))
    holding = marked.where(F.col(has))
    digest = F.sha2(body.cast("binary"), 256)
    found = stored(segments(holding.select(digest.alias("k"), body.alias("t")).groupBy("k").agg(F.first("t").alias("t"))), "segments")
    units = found.select("k", F.explode("parts").alias("x")).where("x.kind is not null").select("k", F.explode("x.units").alias("u")).select("k", "u.kind", "u.canon")
    settled = resolve(units, key)
    bodies = units.distinct().join(settled, ["kind", "canon"]).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(_unit_key(F.struct("kind", "canon")).alias("u"), "body"))).alias("bodies"))
    joined = F.array_join(F.transform("parts", lambda x: _rendered(x, F.col("bodies"))), "")
    unescaped = F.replace(F.replace(joined, F.lit(ESCAPE + "m"), F.lit(MARK)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))
    new = stored(found.join(bodies, "k").select(F.col("k").alias(k), unescaped.alias(new_text), F.size(F.filter("parts", lambda x: x["kind"].isNotNull())).cast("long").alias(n)), "replaced")
    drop_stored(found)
    drop_stored(settled)
    out = [F.col(new_text).alias(c) if c == text else F.col(f"`{c}`") for c in names]
    changed = holding.withColumn(k, digest).join(new, k).select(*out, *([F.col(n).alias(count)] if count else []))
    plain = marked.where(~F.col(has)).select(*[F.col(f"`{c}`") for c in names], *([F.lit(0).cast("long").alias(count)] if count else []))
    return plain.unionByName(changed)
