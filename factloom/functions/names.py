"""Names of entities and people as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import bind, column

# The transliteration of one-word terms.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h",
    "ц": "c", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Degrees and titles that are not surnames, and marks of organisations that are not people.
DEGREES = ("к.т.н.", "д.т.н.", "к.х.н.", "д.х.н.", "проф.", "проф", "доц.", "чл.-корр.")
ORGANISATIONS = r"(?iu)(gmbh|ltd|limited|llc|inc\b|group|team|analyst|institute|university|центр|институт|компания|сплав|завод|ооо|пао|ао\b)"
NO_AUTHOR, NO_YEAR = "Без автора", "б.г."


def nfc(text: Column | str) -> Column:
    """Unicode's composed form, in Arrow batches; texts of ASCII pass unchanged."""

    @F.pandas_udf("string")
    def composed(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))

    t = column(text)
    return F.when(t.rlike(r"[^\x00-\x7F]"), composed(t)).otherwise(t)


def normalize_name(name: Column | str) -> Column:
    """The key of a name: lower case, ё as е, single spaces. Composes nothing: use nfc first where forms are mixed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(column(name), F.lit(""))), "ё", "е"), r"[\s\x{85}\p{Z}]+", " "))


def to_latin(text: Column) -> Column:
    single = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) <= 1}
    longer = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) > 1}
    kept = {k: v for k, v in single.items() if v}
    out = F.translate(text, "".join(kept) + "".join(k for k in single if k not in kept), "".join(kept.values()))
    for k, v in longer.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def to_cyrillic(text: Column) -> Column:
    """The reverse by single letters; of letters with the same Latin one the last in the table counts."""
    back = {v: k for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}
    return F.translate(text, "".join(back), "".join(back.values()))


def slug(name: Column | str) -> Column:
    """An id of Latin letters and digits with hyphens between them; for a name without any, x- and a digest."""
    norm = normalize_name(name)
    made = F.regexp_replace(F.regexp_replace(to_latin(norm), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made != "", made).otherwise(F.concat(F.lit("x-"), F.substring(F.sha1(norm), 1, 8)))


def surname(authors: Column | str) -> Column:
    """The surname of the first author: the first part that is neither initials nor a degree."""
    first = F.try_element_at(F.filter(F.transform(column(authors), lambda a: F.trim(a)), lambda a: a != ""), F.lit(1))
    parts = F.split(first, r"\s+")
    letters = lambda p: F.length(F.regexp_replace(p, r"[^\p{L}]", ""))
    likely = F.filter(parts, lambda p: ~F.trim(F.translate(F.lower(p), ",", "")).isin(*DEGREES) & ~(p.contains(".") & (letters(p) <= 3)) & (letters(p) >= 2))
    found = F.try_element_at(likely, F.lit(1))
    shown = F.when((found == F.upper(found)) & (found != F.lower(found)), F.concat(F.upper(F.substring(found, 1, 1)), F.lower(F.substr(found, F.lit(2))))).otherwise(found)
    return F.coalesce(F.translate(F.coalesce(shown, F.try_element_at(parts, F.lit(1))), ",", ""), F.lit(NO_AUTHOR))


def cite_key(authors: Column | str, year: Column | str) -> Column:
    return F.concat(surname(authors), F.lit(" "), F.coalesce(F.when(column(year) != 0, column(year).cast("string")), F.lit(NO_YEAR)))


# Latin letters and the Cyrillic ones that look like them.
LOOKALIKES = {"A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т", "X": "Х", "a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у"}


def fold_lookalikes(name: Column) -> Column:
    """A name of more Cyrillic than Latin letters, with Latin ones of a Cyrillic letter's shape as that letter; any other as it is. Lone initials are folded with the rest."""
    more = F.regexp_count(name, F.lit("[А-ЯЁа-яё]")) > F.regexp_count(name, F.lit("[A-Za-z]"))
    return F.when(more, F.translate(name, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))).otherwise(name)


def person_key(name: Column | str) -> Column:
    """(alphabet, surname, initials) of a person's name, NULL for organisations and what is no name.

    Two to four tokens, each a word (W) or an initial (I). The surname is the only word, else the first token, which then
    must be a word; the initials are those of all other tokens.
    """
    folded = fold_lookalikes(F.translate(column(name), ",\u00a0", "  "))
    tokens = F.filter(F.split(F.regexp_replace(folded, r"(\p{L})\.(?=\p{L})", "$1. "), r"\s+"), lambda t: t != "")
    letters = r"[A-Za-zА-ЯЁа-яё]"
    kinds = F.transform(tokens, lambda t: F.when(t.rlike(rf"\A{letters}\.?\z"), "I").when(t.rlike(rf"\A{letters}[A-Za-zА-ЯЁа-яё'-]+\z"), "W").otherwise("x"))

    def decide(read: Column) -> Column:
        shape = F.array_join(read["kinds"], "")
        at = F.when(shape.rlike(r"\AI*WI*\z"), F.array_position(read["kinds"], "W")).when(shape.rlike(r"\AW"), 1)
        family = F.element_at(read["tokens"], at.cast("int"))
        short = F.lower(F.array_join(F.transform(F.filter(read["tokens"], lambda t, i: i + 1 != at), lambda t: F.substring(t, 1, 1)), ""))
        alphabet = F.when(family.rlike("[А-ЯЁа-яё]"), "cyr").otherwise("lat")
        return F.when(shape.rlike(r"\A[WI]{2,4}\z") & at.isNotNull(), F.struct(alphabet.alias("alphabet"), F.translate(F.lower(family), "ё", "е").alias("surname"), short.alias("initials")))

    found = bind(F.struct(tokens.alias("tokens"), kinds.alias("kinds")), decide)
    return F.when(~column(name).rlike(r"\d") & ~column(name).rlike(ORGANISATIONS), found)
