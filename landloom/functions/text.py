"""Text column functions: keys, header roles, transliteration, phonetic codes, name and identifier scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from landloom.functions.num import rnd

#: Latin spelling of Devanagari code points; other marks are dropped.
LATIN = {
    "क": "K", "ख": "KH", "ग": "G", "घ": "GH", "ङ": "NG", "च": "CH", "छ": "CHH", "ज": "J", "झ": "JH", "ञ": "NY",
    "ट": "T", "ठ": "TH", "ड": "D", "ढ": "DH", "ण": "N", "त": "T", "थ": "TH", "द": "D", "ध": "DH", "न": "N",
    "प": "P", "फ": "PH", "ब": "B", "भ": "BH", "म": "M", "य": "Y", "र": "R", "ल": "L", "व": "V", "श": "SH", "ष": "SH", "स": "S", "ह": "H", "ळ": "L",
    "ा": "A", "ि": "I", "ी": "I", "ु": "U", "ू": "U", "े": "E", "ै": "AI", "ो": "O", "ौ": "AU", "ं": "N",
    "अ": "A", "आ": "A", "इ": "I", "ई": "I", "उ": "U", "ऊ": "U", "ए": "E", "ऐ": "AI", "ओ": "O", "औ": "AU", "्": "",
}
#: Digit of a letter in the phonetic code.
DIGIT = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key(c: Column) -> Column:
    """Lower case, trimmed, every run of other than a-z0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", " "))


def column_key(name: str) -> str:
    """A header in snake case."""
    out = "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in name.strip().lower())
    return "_".join(x for x in out.split("_") if x)


def header_key(c: Column) -> Column:
    """column_key as a column function."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def transliterate(c: Column) -> Column:
    """Devanagari to upper-case Latin, code point by code point; other letters, digits and blanks stay, the rest goes."""
    table = F.create_map(*[F.lit(x) for pair in LATIN.items() for x in pair])

    def one(ch: Column) -> Column:
        return F.coalesce(F.element_at(table, ch), F.when(ch.rlike(r"^[\p{L}\p{N}\s]$"), ch), F.lit(""))

    return F.upper(F.array_join(F.transform(F.split(c, ""), one), ""))


def phonetic_code(c: Column) -> Column:
    """First letter and three digits; a digit is left out when it repeats the last one written, and nothing resets that."""

    def code(t: Column) -> Column:
        digits = F.translate(F.upper(F.substr(t, F.lit(2))), "".join(DIGIT.values()), "".join(d * len(x) for d, x in DIGIT.items()))
        only = F.regexp_replace(digits, "[^1-6]", "")
        return F.when(F.length(t) > 0, F.rpad(F.concat(F.substr(t, F.lit(1), F.lit(1)), F.regexp_replace(only, r"([1-6])\1+", "$1")), 4, "0")).otherwise("Z000")

    return let(F.regexp_replace(transliterate(c), r"\s", ""), code)


def _alike(t: Column, b: Column) -> tuple[Column, Column]:
    distance = F.levenshtein(F.lower(F.trim(t)), F.lower(F.trim(b)))
    return distance, F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.greatest(F.length(t), F.length(b), F.lit(1)))


def _codes_alike(x: Column, y: Column) -> Column:
    return F.when(x == y, 1.0).when(F.substr(x, F.lit(1), F.lit(1)) == F.substr(y, F.lit(1), F.lit(1)), 0.8).otherwise(0.2)


def name_parts(a: Column, b: Column) -> dict[str, Column]:
    """Distance, similarity and codes of two names, the first in either script."""
    t = transliterate(a)
    distance, similarity = _alike(t, b)
    x, y = phonetic_code(a), phonetic_code(b)
    return {"transliterated": t, "distance": distance, "similarity": rnd(similarity, 4), "code_a": x, "code_b": y, "code_score": _codes_alike(x, y), "score": name_score(a, b)}


def name_score(a: Column, b: Column) -> Column:
    """Half the likeness of spellings, half that of the codes; 4 places."""
    spelled = let(transliterate(a), lambda t: _alike(t, b)[1])
    codes = let(F.struct(phonetic_code(a).alias("x"), phonetic_code(b).alias("y")), lambda p: _codes_alike(p["x"], p["y"]))
    return let(spelled * 0.5 + codes * 0.5, lambda s: rnd(s, 4))


def bare_identifier(c: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))
    return F.coalesce(F.array_max(places), F.lit(0))


def roles_by_token(headers: Sequence[str], aliases: dict[str, Sequence[str]]) -> dict[str, str]:
    """Raw header -> canonical field: an alias equals the header's words, else begins or ends them; aliases in table order."""
    spaced = lambda s: " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in s.lower()).split())
    table = [(alias.lower(), field) for field, own in aliases.items() for alias in own]
    out = {}
    for raw in headers:
        k = spaced(raw)
        exact = next((f for a, f in table if a == k), None)
        part = next((f for a, f in table if k.startswith(a + " ") or k.endswith(" " + a)), None)
        if exact or part:
            out[raw] = exact or part
    return out


def match_header(raw: str, aliases: dict[str, Sequence[str]]) -> str | None:
    """The field of one header: alias equal in snake case, then to the raw words, then an alias of over three letters within it."""
    snake, words = column_key(raw), " ".join(raw.lower().split())
    table = [(a, f) for f, own in aliases.items() for a in own]
    for test in (lambda a: column_key(a) == snake, lambda a: a == words, lambda a: len(a) > 3 and column_key(a) in snake):
        hit = next((f for a, f in table if test(a)), None)
        if hit:
            return hit
    return None


def first_headers(headers: Sequence[str], aliases: dict[str, Sequence[str]]) -> dict[str, str]:
    """Canonical field -> the first header that maps to it."""
    out: dict[str, str] = {}
    for raw in headers:
        field = match_header(raw, aliases)
        if field:
            out.setdefault(field, raw)
    return out


def land_number(state: Column, district: Column, ward: Column, sequence: Column) -> Column:
    """A parcel number of fixed width; the sequence keeps its last two digits, so it repeats beyond 99 in a ward."""
    return F.concat(F.lpad(state.cast("string"), 2, "0"), F.lpad(district.cast("string"), 3, "0"), F.lpad(ward.cast("string"), 3, "0"), F.right(F.lpad(sequence.cast("string"), 2, "0"), F.lit(2)))


def tamper_code(*cols: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over the fields joined by bars."""
    return F.upper(F.substr(F.sha2(F.concat_ws("|", *cols), 256), F.lit(1), F.lit(16)))


def notice_number(identifier: Column) -> Column:
    """The last three digits of an identifier, padded with zeros."""
    return F.lpad(F.right(F.regexp_replace(identifier, "[^0-9]", ""), F.lit(3)), 3, "0")
