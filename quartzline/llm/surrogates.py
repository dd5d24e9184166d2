"""Personal data: keyed, type-consistent surrogates for detected entities, in DataFrame functions only."""

from __future__ import annotations

from itertools import count as attempts

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.llm.common import materialize

OPEN, CLOSE = "\ue000", "\ue001"
# What these marks, and the escape itself, are written as where a text has them.
_ESCAPE = "\ue002"
_ESCAPED = {_ESCAPE: _ESCAPE + "\ue003", OPEN: _ESCAPE + "\ue004", CLOSE: _ESCAPE + "\ue005"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Titles that tell a gender, and others; fixed values.
_FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Mademoiselle|Señora|Señorita|Sra|Doña|Госпожа|Κυρία"
_MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин|Κύριος"
_EITHER = "Dr|Prof|Professor"
# Small words within names; fixed values.
_PARTICLES = "de|la|las|los|del|della|di|da|do|dos|du|des|le|von|vom|van|der|den|zu|zum|zur|ter|ten|bin|ibn|al|el|y|af|av"
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+"
_NAME = rf"(?:(?:{_PARTICLES}) ){{0,3}}+(?:\p{{Lu}}\.(?= ?\p{{Lu}})|{_WORD})"
#: Patterns by kind, in the order in which they are tried at a place; fixed values. No loop over a
#: group can give back what it took, and none can start anew within what another start has read, so
#: that long texts of one word take neither stack nor time out of proportion.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])(?=[._%+-]*+[\p{L}\p{N}])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}-]++\.[\p{N}.-]*+\p{L})[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z]{4})?(?: ?\d{4}){3,6}(?: ?\d{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])\d{4}(?:[ -]?\d{4}){3}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_FEMALE}|{_MALE}|{_EITHER})\.? {_NAME}(?: ?{_NAME}){{0,3}}+(?![\p{{L}}\p{{N}}])",
}
# What the patterns begin with, looked for first, as most places of a text have none of it.
_BEGIN = {"ip": r"\d", "iban": r"[A-Z]{2}\d", "card": r"\d{4}", "ssn": r"\d{3}-", "phone": r"[+(]?\d", "name": "[" + "".join(sorted({t[0] for t in f"{_FEMALE}|{_MALE}|{_EITHER}".split("|")})) + "]"}
PATTERN = "|".join((f"(?={_BEGIN[k]})" if k in _BEGIN else "") + f"(?:{p})" for k, p in PATTERNS.items())

# Lengths of account numbers by country, as registered; fixed values.
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(_IBAN_COUNTRIES.values()).replace(" ", "|")
_IBAN_FORMS = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?:[ \u00a0-]?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_COUNTRIES.items())
#: Wider patterns, whose matches count only if their check digits are right; tried before the others.
CONFIRMED = {
    "iban": rf"(?=[A-Z]{{2}}\d{{2}})(?<![\p{{L}}\p{{N}}])(?:{_IBAN_FORMS}|(?!{_KNOWN})[A-Z]{{2}}\d{{2}}(?:[ \u00a0-]?[A-Z0-9]{{4}}){{3,7}}(?:[ \u00a0-]?[A-Z0-9]{{1,3}})?)(?![\p{{L}}\p{{N}}])",
    "card": r"(?=\d{4})(?<![\p{L}\p{N}.+])(?:\d{13,19}|\d{6}[ -]\d{7,13}|\d{4}(?<sep>[ -])(?:\d{6}\k<sep>\d{4,5}|\d{3}\k<sep>\d{3}\k<sep>\d{3}|\d{4}\k<sep>\d{4}\k<sep>(?:\d{4}\k<sep>)?\d{1,3}))(?![\p{L}\p{N}])",
}
CANDIDATE = "|".join(f"(?:{p})" for p in CONFIRMED.values())

# Codes of countries in phone numbers; fixed values.
_COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

# Syllables and endings of invented names by script; fixed values.
_SYLLABLES = {
    "latin": ["Bal", "Cor", "Dan", "Fer", "Gil", "Har", "Jor", "Kel", "Lam", "Mar", "Nor", "Per", "Ros", "Sal", "Tor", "Ver"],
    "cyrillic": ["Бал", "Вер", "Гор", "Дан", "Жел", "Зор", "Кар", "Лад", "Мир", "Нев", "Пол", "Род", "Сав", "Тар", "Фед", "Яр"],
    "greek": ["Βασ", "Γαλ", "Δαμ", "Ερμ", "Ζην", "Θαλ", "Καλ", "Λεμ", "Μαρ", "Νικ", "Παρ", "Ροδ", "Σοφ", "Ταλ", "Φιλ", "Χαρ"],
}
_ENDINGS = {
    "latin": (["ina", "ela", "ia", "ana"], ["io", "us", "en", "or"], ["is", "an", "el", "in"]),
    "cyrillic": (["ина", "ова", "ия", "ана"], ["ов", "ин", "ий", "ан"], ["ко", "ых", "их", "ло"]),
    "greek": (["ία", "ίνα", "ούλα", "άνα"], ["ίος", "άκης", "ίδης", "άνος"], ["ου", "ών", "ή", "ύ"]),
}


def kind_of(entity: Column) -> Column:
    """The first kind of which a pattern matches the whole entity."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in PATTERNS.items():
        for p in (pattern, CONFIRMED[kind]) if kind in CONFIRMED else (pattern,):
            out = out.when(entity.rlike(f"^(?:{p})$"), F.lit(kind))
    return out


def _mod97(value: Column) -> Column:
    """The remainder by 97 of a string of digits and letters, where A to Z are 10 to 35."""
    code = lambda c: F.ascii(c) - F.when(c.rlike("^[0-9]$"), 48).otherwise(55)
    step = lambda rest, c: ((rest * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + code(c)) % 97).cast("int")
    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.lit(0), step)


def _iban_right(value: Column) -> Column:
    """Whether an account number's check digits are right."""
    plain = F.regexp_replace(value, "[^A-Z0-9]", "")
    return _mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1


def _confirmed(candidate: Column) -> Column:
    """Whether a match of CANDIDATE or an address is an entity."""
    luhn = F.call_function("luhn_check", F.regexp_replace(candidate, r"\D", ""))
    return F.when(candidate.contains("@"), True).when(candidate.rlike("^[A-Z]"), _iban_right(candidate)).otherwise(luhn)


def _digest(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _pick(digest: Column, place: Column, n: int) -> Column:
    """A number below n from four digits of a digest, which is used around its end."""
    at = (place * 4) % 60 + 1
    return (F.conv(F.substr(digest, at, F.lit(4)), 16, 10).cast("int") + (place / 15).cast("int") * 7919) % n


def _shaped(value: Column, digest: Column) -> Column:
    """Another string of the same form: digits for digits, letters for letters of the same case."""

    def other(c: Column, i: Column) -> Column:
        letter = lambda letters: F.substr(F.lit(letters), _pick(digest, i, len(letters)) + 1, F.lit(1))
        return (
            F.when(c.rlike(r"^\d$"), _pick(digest, i, 10).cast("string"))
            .when(c.rlike("^[a-z]$"), letter("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("^[A-Z]$"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"^[а-я]$"), letter("абвгдежзийклмнопрстуфхцчшщэюя"))
            .when(c.rlike(r"^[α-ω]$"), letter("αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"^\p{Lu}$"), letter("ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"))
            .when(c.rlike(r"^\p{L}$"), letter("àáâäçèéêëìíîïñòóôöùúûü"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), other), "")


def _name(value: Column, digest: Column, attempt: Column) -> Column:
    """The same title and number of words; invented names of the title's gender and the name's script.

    A word has three syllables and an ending, and one more syllable for each attempt, up to 14. Parts
    joined by a hyphen or an apostrophe are words of their own; initials, capitals, and particles
    (lower case), which stay, keep the form.
    """
    script = F.when(value.rlike(r"\p{IsCyrillic}"), 1).when(value.rlike(r"\p{IsGreek}"), 2).otherwise(0)
    gender = F.when(value.rlike(f"^(?:{_FEMALE})"), 0).when(value.rlike(f"^(?:{_MALE})"), 1).otherwise(2)
    titles = rf"(?:{_FEMALE}|{_MALE}|{_EITHER})\.?"
    title = F.regexp_extract(value, f"^({titles})", 1)
    words = F.split(F.trim(F.regexp_replace(value, f"^{titles}", "")), "(?<=[ '’.-])(?=.)|(?=[ '’.-])")

    def word(_: Column, i: Column) -> Column:
        own = F.sha2(F.concat_ws("\x1f", digest, i.cast("string")), 256)
        out = F.lit("")
        for s, name in enumerate(_SYLLABLES):
            pick = lambda table, at: F.element_at(F.array(*map(F.lit, table)), _pick(own, at, len(table)) + 1)
            syllables = F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(11)) + 2), lambda at: pick(_SYLLABLES[name], at))  # noqa: B023
            last = F.lit(14)
            ending = F.when(gender == 0, pick(_ENDINGS[name][0], last)).when(gender == 1, pick(_ENDINGS[name][1], last)).otherwise(pick(_ENDINGS[name][2], last))
            out = F.when(script == s, F.concat(F.initcap(F.array_join(syllables, "")), ending)).otherwise(out)
        return out

    def part(w: Column, i: Column) -> Column:
        after, before = F.get(words, i + 1), F.when(i > 0, F.get(words, i - 1)).otherwise(F.lit(" "))
        initial = (F.length(w) == 1) & F.coalesce(after.isin(".", "'", "’"), F.lit(False))
        return (
            F.when(~w.rlike(r"\p{Lu}"), w)
            .when(initial, F.substr(word(w, i), F.lit(1), F.lit(1)))
            .when((F.length(w) > 1) & (F.upper(w) == w), F.upper(word(w, i)))
            .when(before.isin("-", "'", "’"), F.initcap(word(w, i)))
            .otherwise(word(w, i))
        )

    return F.concat(title, F.lit(" "), F.array_join(F.transform(words, part), ""))


def canonical(kind: Column, value: Column) -> Column:
    """What all mentions of one entity have in common.

    Addresses in lower case and without marks before them, titles without a dot, numbers without separators (phone numbers keep a
    plus sign). IPs and all else stay.
    """
    number = F.regexp_replace(value, "[^A-Z0-9+]", "")
    return F.when(kind == "email", F.regexp_replace(F.lower(value), "^[._%+-]+", "")).when(kind.isin("iban", "card", "ssn", "phone"), number).when(kind == "name", F.regexp_replace(value, r"^(\p{L}+)\. ", "$1 ")).otherwise(value)


def laid_out(kind: Column, value: Column, drawn: Column) -> Column:
    """The surrogate of a canonical value in the form of a mention: its case, separators or dot.

    What the surrogate has more than the mention goes to the end, in addresses of the local part.
    """
    chars = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    cased = lambda like, text: F.array_join(F.transform(chars(text), lambda c, i: F.when(F.substr(like, i + 1, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    front = F.regexp_extract(value, "^[._%+-]*", 0)
    own = F.substr(value, F.length(front) + 1, F.length(value))
    side = lambda at: cased(F.substring_index(own, "@", at), F.substring_index(drawn, "@", at))
    email = F.concat(front, side(1), F.lit("@"), side(-1))
    plain = F.regexp_replace(drawn, "[^A-Z0-9]", "")
    before = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^A-Z0-9]", ""))
    places = F.transform(chars(value), lambda c, i: F.when(c.rlike("^[A-Z0-9]$"), F.substr(plain, before(i) + 1, F.lit(1))).otherwise(c))
    number = F.concat(F.array_join(places, ""), F.substr(plain, before(F.length(value)) + 1, F.length(plain)))
    name = F.when(value.rlike(r"^\p{L}+\. "), F.regexp_replace(drawn, "^([^ ]+) ", "$1. ")).otherwise(drawn)
    return F.when(kind == "email", email).when(kind.isin("iban", "card", "ssn", "phone"), number).when(kind == "name", name).otherwise(drawn)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The keyed surrogate of an entity's canonical value, of its kind and form; another one for each attempt.

    Forms that few strings have grow with the attempts, so that there are always enough: names by a
    syllable each attempt, the local parts of addresses by a letter from attempt 4 on, phone and
    other numbers by a digit from attempt 10 on. Octets lose their number of digits at attempt 4.

    Addresses of one mail domain get one domain, whose last label stays. Octets stay in range and
    keep their number of digits before that. A country code stays. Card numbers that pass the Luhn test get
    numbers that pass it, account numbers with right check digits get right ones.
    """
    digest = _digest(key, kind, value, attempt.cast("string"))
    domain = F.substring_index(value, "@", -1)
    label = F.substring_index(domain, ".", -1)
    inner = F.substr(domain, F.lit(1), F.length(domain) - F.length(label) - 1)
    more = lambda c, first: _shaped(F.repeat(F.lit(c), F.greatest(attempt - first + 1, F.lit(0))), _digest(key, F.lit("more"), digest))
    email = F.concat(_shaped(F.substring_index(value, "@", 1), digest), more("a", 4), F.lit("@"), _shaped(inner, _digest(key, F.lit("domain"), F.lower(domain))), F.lit("."), label)
    octet = lambda o, i: (
        F.when(attempt >= 4, _pick(digest, i, 255) + 1).when(F.length(o) == 3, _pick(digest, i, 156) + 100).when(F.length(o) == 2, _pick(digest, i, 90) + 10).otherwise(_pick(digest, i, 9) + 1).cast("string")
    )
    ip = F.array_join(F.transform(F.split(value, r"\."), octet), ".")
    code = F.regexp_extract(value, _COUNTRY_CODE, 0)
    phone = F.concat(code, _shaped(F.substr(value, F.length(code) + 1, F.length(value)), digest), more("0", 10))
    front = _shaped(F.substr(value, F.lit(1), F.length(value) - 1), digest)
    last = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(F.regexp_replace(front, r"\D", ""), d.cast("string"))))
    card = F.when(F.call_function("luhn_check", F.regexp_replace(value, r"\D", "")), F.concat(front, F.element_at(last, 1).cast("string"))).otherwise(_shaped(value, digest))
    country, body = F.substr(value, F.lit(1), F.lit(2)), _shaped(F.substr(value, F.lit(5), F.length(value)), digest)
    checks = F.lpad((98 - _mod97(F.concat(F.regexp_replace(body, "[^A-Z0-9]", ""), country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_iban_right(value), checks).otherwise(_shaped(F.substr(value, F.lit(3), F.lit(2)), _digest(key, F.lit("checks"), digest))), body)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "name", _name(value, digest, attempt)).otherwise(F.concat(_shaped(value, digest), more("0", 10)))
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for each distinct mention (kind, value).

    Mentions with one canonical value have one surrogate, each in its own form. Within a kind no
    two canonical values share a surrogate, and no surrogate is a value that occurs. Each
    attempt draws for all values without one; of those that draw the same, the smallest wins,
    unless the draw is taken or occurs. The losers draw again. Hashes of the values decide, so runs
    with one key agree on all but such losers. Forms grow with the attempts (`surrogate`), so every
    value gets one in the end.
    """
    mentions = materialize(entities.select("kind", "value").distinct().withColumn("entity", canonical(F.col("kind"), F.col("value"))))
    real = materialize(mentions.select("kind", "entity").distinct())
    pending, settled = real, None
    for attempt in attempts():
        drawn = pending.withColumn("drawn", surrogate(F.col("kind"), F.col("entity"), F.lit(attempt), key))
        won = drawn.groupBy("kind", "drawn").agg(F.min("entity").alias("entity"))
        won = won.join(real.select("kind", F.col("entity").alias("drawn")), ["kind", "drawn"], "left_anti")
        if settled is not None:
            won = won.join(settled.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        won = materialize(won.select("kind", "entity", "drawn"))
        settled = won if settled is None else settled.union(won)
        pending = materialize(pending.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti"))
        if pending.isEmpty():
            return mentions.join(settled, ["kind", "entity"]).select("kind", "value", laid_out(F.col("kind"), F.col("value"), F.col("drawn")).alias("surrogate"))


def _marked(text: Column) -> Column:
    """A text with marks around its entities; marks of our own in the text itself are escaped.

    Candidates that their check digits do not confirm are searched for entities like other text.
    """
    mark = f"{OPEN}$0{CLOSE}"
    clean = text
    for c, code in _ESCAPED.items():
        clean = F.replace(clean, F.lit(c), F.lit(code))
    clean = F.when(text.rlike(f"[{''.join(_ESCAPED)}]"), clean).otherwise(text)
    tried = F.split(F.regexp_replace(clean, f"(?:{PATTERNS['email']})|{CANDIDATE}", mark), OPEN)
    checked = F.transform(tried, lambda p, i: F.when((i > 0) & _confirmed(F.substring_index(p, CLOSE, 1)), F.concat(F.lit(OPEN), p)).otherwise(F.translate(p, CLOSE, "")))
    twice = F.regexp_replace(F.array_join(checked, ""), f"{OPEN}[^{CLOSE}]*+{CLOSE}|{PATTERN}", mark)
    once = F.regexp_replace(F.regexp_replace(twice, OPEN * 2, OPEN), CLOSE * 2, CLOSE)
    return F.when(clean.rlike(CANDIDATE), once).otherwise(F.regexp_replace(clean, PATTERN, mark))


def _plain(text: Column) -> Column:
    """A text with the escapes of `_marked` undone."""
    out = text
    for c, code in reversed(_ESCAPED.items()):
        out = F.replace(out, F.lit(code), F.lit(c))
    return F.when(F.instr(text, _ESCAPE) > 0, out).otherwise(text)


def replace_entities(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with every detected entity in `text` replaced by its surrogate; other columns stay.

    The same entity has the same surrogate everywhere, in the form of each mention; different ones
    have different surrogates. Mentions are of one entity if `canonical` makes them equal: case of
    addresses, separators of numbers and the dot of a title do not count. A phone number with its
    country code and one without are two, as are full and last names. Who has `key` can draw the same
    surrogates, so it is to be kept as a secret.
    With `count`, a column of that name tells how many were replaced (one that docs has by that
    name gives way). Null and empty texts stay as they are. Rows are kept one for one, repeated
    ones too. All other characters stay.

    Each text is searched once; all rows are written to the shared folder, those with entities cut
    into pieces. The entities are joined with the table of surrogates, whose hot values Spark's skew
    handling splits, and the pieces are put together again by row. All other rows pass without a shuffle.
    """
    if count:
        docs = docs.drop(count)
    columns = docs.columns
    others = [F.col(f"`{c}`") for c in columns if c != "text"]
    marked = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("rest"), F.col("text").alias("text"), F.split(_marked(F.col("text").cast("string")), OPEN).alias("split"))
    # arrays of one piece have no entity: the text itself stands for them
    cut = F.when(F.size("split") > 1, F.col("split"))
    staged = materialize(marked.select("rest", F.when(cut.isNull(), F.col("text")).alias("text"), cut.alias("split")).withColumn("row", F.monotonically_increasing_id()))
    row = staged.where("split IS NOT NULL").select("row", "rest", F.posexplode("split").alias("i", "piece"))
    entity = F.when(F.col("i") > 0, F.substring_index("piece", CLOSE, 1))
    plain = _plain(F.when(F.col("i") > 0, F.substr("piece", F.length(entity) + 2, F.length("piece"))).otherwise(F.col("piece")))
    pieces = row.select("row", "i", F.when(F.col("i") == 0, F.col("rest")).alias("rest"), kind_of(entity).alias("kind"), entity.alias("value"), plain.alias("plain"))
    pieces = materialize(pieces)
    found = pieces.where("value IS NOT NULL")
    table = surrogate_table(found.select(F.coalesce("kind", F.lit("other")).alias("kind"), "value"), key)
    joined = pieces.withColumn("kind", F.when(F.col("value").isNotNull(), F.coalesce("kind", F.lit("other")))).join(table, ["kind", "value"], "left")
    whole = joined.groupBy("row").agg(
        F.first("rest", ignorenulls=True).alias("rest"),
        F.sort_array(F.collect_list(F.struct("i", F.concat(F.coalesce("surrogate", F.lit("")), "plain").alias("s")))).alias("parts"),
    )
    n = (F.size("parts") - 1).cast("bigint")
    done = whole.select("rest", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("text"), n.alias("n"))
    same = staged.where("split IS NULL").select("rest", "text", F.lit(0).cast("bigint").alias("n"))
    out = [(F.col("text") if c == "text" else F.col(f"rest.`{c}`")).alias(c) for c in columns]
    return same.union(done).select(*out, *([F.col("n").alias(count)] if count else []))
