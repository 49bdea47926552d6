r"""Personal data: detection and keyed surrogates. DataFrame functions only.

Every detected value is replaced by one of its own kind: an address by an address, a card number by one
that keeps its issuer digit, separators and check digit, an IBAN by one of its country with right check
digits, a phone number by one of its country code, a name by a name of the same script and gender. A surrogate is a
function of the key, the kind and the normalised value, so a value has the same surrogate wherever it
occurs, in any spelling, in any document and any run with that key. Values are then checked against each
other: if two of them would share a surrogate, or a surrogate is a real value of the corpus, all but one
take their next candidate, and candidates grow longer, so that there is room for all of them in the end.

A part of a name that stands alone in a document that has the whole name ("Keller", "KELLER") takes the
part of that name's surrogate. Only values that moved are joined back; texts without entities never
leave their task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise

#: Titles by the gender they tell, and phrases that a name follows.
TITLES = {"m": ("Mr", "Herr", "Monsieur"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame"), "x": ("Dr", "Prof")}
PHRASES = ("My name is", "my name is", "Name:", "name:")
_title = "|".join(t for ts in TITLES.values() for t in ts)
PREFIX = rf"(?<![\p{{L}}\p{{M}}])(?:(?:{_title})\.?|{'|'.join(PHRASES)}) "
#: Patterns of the kinds, in order of precedence.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}|[0-9a-f]{32,64}|[0-9A-F]{32,64})\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{8,14}(?![0-9])",
    "titled": PREFIX + r"\p{Lu}[\p{L}\p{M}'’-]*\p{L}(?: \p{Lu}[\p{L}\p{M}'’-]*\p{L})?",
}
#: Country codes of one and of two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Given names by script and gender; a name is one of them followed by a capitalised surname of the script.
NAMES = {
    "latin_f": ("Aisha", "Alice", "Amina", "Ana", "Anna", "Carmen", "Charlotte", "Clara", "Elena", "Emily", "Emma", "Fatima", "Hannah", "Ingrid", "Isabel", "Julia", "Katharina", "Laura", "Linda", "Lucia", "Margaret", "Maria", "Mary", "Mei", "Olivia", "Patricia", "Priya", "Sarah", "Sofia", "Sophie", "Yuki"),
    "latin_m": ("Ahmed", "Andrew", "Antonio", "Carlos", "Charles", "Daniel", "David", "François", "Hans", "Heinrich", "Hiroshi", "Ivan", "James", "John", "José", "Jürgen", "Kenji", "Luca", "Michael", "Mohammed", "Muhammad", "Omar", "Pablo", "Peter", "Pierre", "Rahul", "Robert", "Thomas", "Wei", "William"),
    "cyrillic_f": ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"),
    "cyrillic_m": ("Александр", "Алексей", "Борис", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"),
    "devanagari_f": ("अनीता", "कविता", "गीता", "प्रिया", "मीना", "राधा", "सीता", "सुनीता"),
    "devanagari_m": ("अजय", "अमित", "मोहन", "राजेश", "राम", "रमेश", "विजय", "सुरेश"),
}
SYLLABLES = {
    "latin": ("ba", "ber", "cal", "dan", "del", "el", "fen", "gar", "hal", "jor", "kel", "lan", "mar", "nor", "or", "per", "quin", "ros", "san", "tel", "ul", "ver", "win", "yar"),
    "cyrillic": ("ба", "вер", "гор", "дан", "ел", "жар", "зан", "кол", "лан", "мор", "нов", "пер", "рос", "сан", "тол", "ян"),
    "devanagari": ("का", "गा", "जा", "ता", "दा", "ना", "पा", "बा", "मा", "रा", "ला", "वा", "शा", "सा", "हा", "या"),
}
SURNAME = {"latin": r"\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)*", "cyrillic": r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)*", "devanagari": r"[\p{IsDevanagari}]+"}
for _kind, _names in NAMES.items():
    _both = dict.fromkeys(x for n in _names for x in (n, n.upper()))
    _first = "".join(sorted({x[0] for x in _both}))  # a class of first letters turns most places down at once
    PATTERNS[f"name_{_kind}"] = rf"(?=[{_first}])(?<![\p{{L}}\p{{M}}])(?:{'|'.join(_both)}) {SURNAME[_kind.split('_')[0]]}"
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every pattern demands one of these, so a text without any holds no entity; it spares most texts the longer pattern.
_latin = [x for k in ("latin_f", "latin_m") for n in NAMES[k] for x in (n, n.upper())]
HINT = (
    r"@|[0-9]{3}|[0-9]\.[0-9]|[0-9](?:[ -]?[0-9]){12}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|AKIA|gh[pousr]_|[0-9A-Fa-f]{32}|sk-|[Ѐ-ӿ]{2}|[ऀ-ॿ]{2}|"
    + rf"(?=[{''.join(sorted({n[0] for n in _latin}))}])(?<![\p{{L}}\p{{M}}])(?:{'|'.join(_latin)}) \p{{Lu}}|(?=[{''.join(sorted({t[0] for t in [*_title.split('|'), *PHRASES]}))}]){PREFIX}\p{{Lu}}"
)
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
NUMBERS = ("ssn", "card", "phone", "iban")
GROWS_FROM = 8  # tries within the shape of a number or secret before its surrogates grow
TRIES = 200


def bare(value: Column) -> Column:
    """A name without the title or phrase before it."""
    return F.regexp_replace(value, rf"^(?:{PREFIX})", "")


def kind_of(value: Column) -> Column:
    """The kind of a detected value; a titled name is of its given name's kind, else of its title's gender."""
    of = {k: F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items() if k != "titled"}
    listed = F.coalesce(*[F.when(bare(value).rlike(f"^(?:{PATTERNS[f'name_{k}']})$"), F.lit(f"name_{k}")) for k in NAMES])
    by_title = F.when(~F.contains(bare(value), F.lit(" ")), F.lit("surname"))
    for gender in ("m", "f"):
        by_title = by_title.when(value.rlike(rf"^(?:{'|'.join(TITLES[gender])})\b"), F.lit(f"name_latin_{gender}"))
    titled = F.when(value.rlike(f"^(?:{PATTERNS['titled']})$"), F.coalesce(listed, by_title.otherwise(F.lit("name_latin_x"))))
    return F.coalesce(*[of[k] for k in of if not k.startswith("name_")], titled, *[of[k] for k in of if k.startswith("name_")], F.lit("secret"))


def normal(kind: Column, value: Column) -> Column:
    """What makes spellings the same entity: case of addresses and names, separators of numbers, the North American country code."""
    plain = F.regexp_replace(value, r"[^0-9A-Za-z+]", "")
    phone = F.regexp_replace(plain, r"^\+1(?=[0-9]{10}$)", "")
    name = kind.startswith("name_") | (kind == "surname")
    return F.when(kind == "email", F.lower(value)).when(kind == "phone", phone).when(kind.isin("ssn", "card", "iban"), plain).when(name, F.lower(bare(value))).otherwise(value)


def stream(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """256 keyed hexadecimal digits."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(i)), kind, entity, attempt.cast("string")), 256) for i in range(4)])


def number(h: Column, at: Column | int, below: Column | int) -> Column:
    """A number under below from four digits of the stream, from place at * 4 on (around its end)."""
    at = F.lit(at) if isinstance(at, int) else at
    return (F.conv(F.substr(h, F.pmod(at * 4, F.lit(252)) + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def shaped(value: Column, h: Column, hexadecimal: bool = False, keep: Column | int = 0) -> Column:
    """value with letters and digits replaced by others of their class and case; the first keep characters stay."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda s: F.substr(F.lit(s), number(h, i, len(s)) + 1, F.lit(1))
        low = pick(HEX[10:]) if hexadecimal else pick(LOWER)
        return F.when(i < keep, c).when(c.rlike("[0-9]"), pick(DIGITS)).when(c.rlike("[a-z]"), low).when(c.rlike("[A-Z]"), F.upper(low) if hexadecimal else pick(UPPER)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def spread(like: Column, chars: Column) -> Column:
    """The letters and digits of chars in the places that like has for them, other characters as in like; what is left over comes last."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(acc["s"], F.when(own, F.substr(chars, acc["at"], F.lit(1))).otherwise(c)).alias("s"), (acc["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.split(like, ""), start, put, lambda acc: F.concat(acc["s"], F.substr(chars, acc["at"], F.lit(100))))


def check_digit(number_but_last: Column) -> Column:
    """The Luhn digit of a run of digits."""
    places = F.reverse(F.split(number_but_last, ""))
    total = F.aggregate(
        F.transform(places, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int")), F.lit(0), lambda s, x: s + x
    )
    return ((10 - total % 10) % 10).cast("string")


def iban_check(country: Column, body: Column) -> Column:
    """The two check digits that make an IBAN's remainder by 97 one."""
    chars = F.split(F.concat(body, country, F.lit("00")), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(chars, F.lit(0), lambda r, c: ((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def with_surrogate(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """entities (kind, entity) with s, the attempt-th surrogate of the normalised value, normalised itself."""
    domain = F.substring_index("entity", "@", -1)
    keyed = entities.select("kind", "entity", stream(key, F.col("kind"), F.col("entity"), F.lit(attempt)).alias("h"), stream(key, F.lit("domain"), domain, F.lit(0)).alias("hd"))
    return keyed.select("kind", "entity", surrogate(F.col("kind"), F.col("entity"), F.col("h"), F.col("hd"), attempt).alias("s"))


def surrogate(kind: Column, entity: Column, h: Column, h_domain: Column, attempt: int = 0) -> Column:
    more = max(0, attempt - GROWS_FROM)
    own = F.concat(entity, F.lit("0" * more))  # the shape to fill: longer where tries within it failed
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    local = shaped(F.concat(local, F.lit("a" * attempt)), h)
    email = F.concat(local, F.lit("@"), shaped(F.substring_index(domain, ".", 1), h_domain), F.lit(".example."), F.substring_index(domain, ".", -1))
    # Ten times 254^3 addresses of version 4 are more than any table is likely to hold; should they run out, a longer form follows.
    ip = F.concat_ws(".", *[(number(h, i, 254) + 1).cast("string") for i in range(4 + more)])
    digits = shaped(own, h, keep=1)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    card = F.concat(body, check_digit(body))
    hexadecimal = entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    secret = F.when(hexadecimal, shaped(own, h, hexadecimal=True)).when(entity.startswith("AKIA"), shaped(own, h, keep=4)).when(entity.startswith("gh"), shaped(own, h, keep=4)).otherwise(shaped(own, h, keep=3))
    abroad = 1 + F.length(F.regexp_extract(F.substr(entity, F.lit(2)), COUNTRY, 0))
    phone = F.when(entity.startswith("+"), shaped(own, h, keep=abroad)).otherwise(shaped(own, h))
    account = shaped(F.substr(own, F.lit(5)), h)
    iban = F.concat(F.substr(entity, F.lit(1), F.lit(2)), iban_check(F.substr(entity, F.lit(1), F.lit(2)), account), account)
    kinds = {"email": email, "ip": ip, "card": card, "secret": secret, "phone": phone, "iban": iban, "ssn": shaped(own, h)}
    return F.coalesce(*[F.when(kind == k, s) for k, s in kinds.items()], full_name(kind, h, attempt))


def full_name(kind: Column, h: Column, attempt: int = 0) -> Column:
    """A given name of the kind's script and gender and a surname of four syllables or more; for a surname that alone."""
    names = {f"name_{k}": v for k, v in NAMES.items()} | {"name_latin_x": NAMES["latin_f"] + NAMES["latin_m"], "surname": ("",)}
    lists = lambda of: F.create_map(*[x for k in names for x in (F.lit(k), F.array(*map(F.lit, of(k))))])
    given, part = F.element_at(lists(names.get), kind), F.element_at(lists(lambda k: SYLLABLES[k.split("_")[1] if k != "surname" else "latin"]), kind)
    pick = lambda values, at: F.element_at(values, number(h, at, F.size(values)) + 1)
    return F.ltrim(F.concat(pick(given, 0), F.lit(" "), F.initcap(F.concat(*[pick(part, i) for i in range(1, 5 + attempt)]))))


def detected(text: Column, hint: bool = True) -> Column:
    """All values in a text, in order; with hint most texts are told by a short pattern to hold none."""
    every = F.regexp_extract_all(text, F.lit(EVERY), F.lit(0))
    return F.when(text.rlike(HINT), every).otherwise(F.array().cast("array<string>")) if hint else every


def settle(first: DataFrame, key: str) -> DataFrame:
    """first (kind, entity, s), distinct entities with their first surrogates -> those that must not take their first surrogate: kind, entity, s.

    In each round every surrogate that several values want goes to the one of smallest hash, and none
    that is itself a value goes to any; the others try again, in the end with longer surrogates. Values that are settled stay so.
    """
    owner = F.min(F.struct(F.xxhash64("entity"), "entity")).alias("o")
    best = first.groupBy("kind", "s").agg(owner, F.count(F.lit(1)).alias("c"))
    # A surrogate must differ from real values of any spelling, so from what a lower-cased name or address is compared by.
    real = first.select("kind", F.col("entity").alias("r"))
    seen = F.when(F.col("kind").startswith("name_") | F.col("kind").isin("surname", "email"), F.lower("s")).otherwise(F.col("s"))
    is_real = best.select("kind", "s", seen.alias("r")).join(real, ["kind", "r"], "left_semi").select("kind", "s")
    taken = materialise(is_real.union(best.filter("c > 1").select("kind", "s")).distinct(), "taken")
    if not taken.limit(1).count():
        return first.sparkSession.createDataFrame([], "kind string, entity string, s string")
    hit = first.join(taken, ["kind", "s"])
    held = hit.join(best.withColumnRenamed("o", "own"), ["kind", "s"]).join(is_real.withColumn("is_real", F.lit(True)), ["kind", "s"], "left")
    moving = materialise(held.filter("is_real OR own.entity <> entity").select("kind", "entity"), "moving")
    settled = None
    for attempt in range(1, TRIES + 1):
        new = with_surrogate(moving, key, attempt)
        rank = F.row_number().over(Window.partitionBy("kind", "s").orderBy(F.xxhash64("entity"), "entity"))
        used = first.select("kind", "s") if settled is None else first.select("kind", "s").union(settled.select("kind", "s"))
        free = new.withColumn("r", seen).join(real, ["kind", "r"], "left_anti").join(used, ["kind", "s"], "left_anti").withColumn("rank", rank).filter("rank = 1").select("kind", "entity", "s")
        free = materialise(free, "free")
        left = materialise(moving.join(free, ["kind", "entity"], "left_anti"), "moving")
        forget(moving)
        moving, settled = left, free if settled is None else settled.union(free)
        if not moving.limit(1).count():
            return settled
    raise RuntimeError("surrogates did not become distinct")


def cased(value: Column, s: Column) -> Column:
    """s in capitals where value is."""
    return F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(s)).otherwise(s)


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text with surrogates, n_entities, kinds (distinct, sorted), entities (kind, surrogate).

    Null text counts as empty; a null or repeated id is no matter, each row is rewritten by itself.
    Spellings of one entity (case of an address or name, separators of a number) get the surrogate in their own
    spelling. Values that overlap go to the leftmost, then to the kind named first in PATTERNS. Parts of a
    name that stand alone count as entities of kind "part". Without a key this raises ValueError.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("t")).withColumn("found", detected(F.col("t")))
    some = rows.filter("size(found) > 0").withColumn("every", pattern_of(F.col("found")))
    some = some.withColumn("found", F.when(F.col("every") == EVERY, F.col("found")).otherwise(F.expr("regexp_extract_all(t, every, 0)")))
    some = materialise(some, "found")
    values = some.select(F.explode("found").alias("value")).distinct()
    whole = F.col("value").rlike(EVERY) & (F.regexp_extract("value", EVERY, 0) == F.col("value"))  # others are parts of names
    values = values.filter(whole).withColumn("kind", kind_of(F.col("value")))
    values = materialise(values.withColumn("entity", normal(F.col("kind"), F.col("value"))), "values")
    # A name with a title here and without one there is one entity.
    gender = values.filter(F.col("kind").startswith("name_")).groupBy("entity").agg(F.min("kind").alias("k"), F.max("kind").alias("other")).filter("k <> other").select("entity", "k")
    mend = F.when(F.col("kind").startswith("name_"), F.coalesce("k", "kind")).otherwise(F.col("kind"))
    values = materialise(values.join(gender, "entity", "left").select("value", "entity", mend.alias("kind")), "values")
    first = materialise(with_surrogate(values.select("kind", "entity").distinct(), key, 0), "first")
    moved = settle(first, key).withColumnRenamed("s", "later")
    table = values.join(first, ["kind", "entity"]).join(moved, ["kind", "entity"], "left").withColumn("s", F.coalesce("later", "s"))
    value, s, kind = F.col("value"), F.col("s"), F.col("kind")
    chars = F.when((kind == "phone") & value.startswith("+") & ~F.col("entity").startswith("+"), F.concat(F.lit("1"), s)).otherwise(F.regexp_replace(s, r"^\+", ""))
    named = F.concat(F.regexp_extract(value, rf"^(?:{PREFIX})", 0), cased(bare(value), s))
    written = F.when(kind.isin(*NUMBERS), spread(value, chars)).when(kind.startswith("name_") | (kind == "surname"), named).otherwise(s)
    table = materialise(table.select("value", "kind", written.alias("s")), "surrogates")
    # Rows with entities only: a row's values meet their surrogates, then its text is put together again.
    some = some.withColumn("row", F.struct("doc_id", F.xxhash64("t").alias("h"), F.sha2("t", 256).alias("h2")))
    one = some.select("row", F.posexplode("found").alias("at", "value")).distinct()
    told = one.join(table, "value", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "value", "kind", "s"))).alias("e"))
    told = told.withColumn("e", with_parts(F.col("e")))
    told = told.select(F.col("row.doc_id").alias("i"), F.col("row.h").alias("h"), F.col("row.h2").alias("h2"), "e")
    full = some.join(told, (F.col("doc_id").eqNullSafe(F.col("i"))) & (F.col("row.h") == F.col("h")) & (F.col("row.h2") == F.col("h2")))
    between = F.expr("split(t, every, -1)")
    text = F.array_join(F.flatten(F.zip_with(between, F.col("e.s"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    done = full.select("doc_id", text.alias("text"), F.size("e").cast("long").alias("n_entities"), F.array_sort(F.array_distinct("e.kind")).alias("kinds"), F.transform("e", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("surrogate"))).alias("entities"))
    empty = F.array().cast("array<struct<kind:string,surrogate:string>>")
    rest = rows.filter("size(found) = 0").select("doc_id", F.col("t").alias("text"), F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"), empty.alias("entities"))
    return done.union(rest)


def words(name: Column) -> Column:
    return F.split(bare(name), " ")


IS_NAME = "|".join(f"(?:{PATTERNS[k]})" for k in PATTERNS if k.startswith("name_") or k == "titled")


def pattern_of(found: Column) -> Column:
    """EVERY, and for texts with names also the words of these, as they are and in capitals, standing alone."""
    names = F.filter(found, lambda v: v.rlike(f"^(?:{IS_NAME})$"))
    parts = F.filter(F.flatten(F.transform(names, words)), lambda w: F.length(w) > 2)
    parts = F.array_sort(F.array_distinct(F.concat(parts, F.transform(parts, F.upper))))
    alone = F.concat(F.lit(EVERY + r"|(?<![\p{L}\p{M}])(?:"), F.array_join(parts, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    return F.when(F.size(parts) > 0, alone).otherwise(F.lit(EVERY))


def with_parts(e: Column) -> Column:
    """e (at, value, kind, s) with the surrogates of parts of names, taken from the first name that has the part."""
    names = F.filter(e, lambda x: x["kind"].startswith("name_") | (x["kind"] == "surname"))

    def part(x: Column) -> Column:
        own = F.lower(x["value"])
        last = lambda n: F.lower(F.element_at(words(n["value"]), -1)) == own
        first = lambda n: (F.size(words(n["value"])) > 1) & (F.lower(F.element_at(words(n["value"]), 1)) == own)
        by_last, by_first = F.try_element_at(F.filter(names, last), F.lit(1)), F.try_element_at(F.filter(names, first), F.lit(1))
        s = F.coalesce(F.element_at(words(by_last["s"]), -1), F.element_at(words(by_first["s"]), 1), F.lit(""))
        s = cased(x["value"], F.when(F.upper(s) == s, F.initcap(F.lower(s))).otherwise(s))
        return F.struct(x["at"].alias("at"), x["value"].alias("value"), F.lit("part").alias("kind"), s.alias("s"))

    # "Mr. Keller" beside "Anna Keller": the surname is that of the whole name.
    full = F.filter(names, lambda n: n["kind"] != "surname")

    def titled(x: Column) -> Column:
        same = F.try_element_at(F.filter(full, lambda n: F.lower(F.element_at(words(n["value"]), -1)) == F.lower(bare(x["value"]))), F.lit(1))
        s = F.concat(F.regexp_extract(x["value"], rf"^(?:{PREFIX})", 0), cased(bare(x["value"]), F.element_at(words(same["s"]), -1)))
        return F.struct(x["at"].alias("at"), x["value"].alias("value"), x["kind"].alias("kind"), F.coalesce(s, x["s"]).alias("s"))

    return F.transform(e, lambda x: F.when(x["kind"].isNull(), part(x)).when(x["kind"] == "surname", titled(x)).otherwise(x))
