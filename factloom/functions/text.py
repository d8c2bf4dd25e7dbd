"""Text as column expressions: normalising, tokens, windows, quotes, front matter and file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of letters, digits and underscores of any script. Java's \w knows ASCII only.
WORD = r"[\p{L}\p{N}_]+"
#: Characters per token in the estimate of a text's tokens.
CHARS_PER_TOKEN = 3

# Words that carry no content for query tokens and for content tokens.
QUERY_STOP_WORDS = (
    "какие", "какой", "каковы", "для", "при", "или", "методы", "способы", "решения", "описаны", "применялись",
    "считается", "подходят", "если", "воды", "and", "the", "for", "with", "what", "which", "methods",
)
CONTENT_STOP_WORDS = (
    "и", "в", "во", "на", "по", "за", "из", "для", "при", "что", "как", "это", "режим", "источник", "следовательно",
    "способно", "обеспечить", "применение", "the", "a", "of", "in", "to", "and", "for", "is", "as", "by", "with",
)
# What a file name's parts may say about a document.
DOC_TYPES = ("article", "patent", "report", "protocol", "reference")

_TRAILING = r"[\t\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+(\n|\z)"


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it stands in the result."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalize_text(text: Column | str) -> Column:
    """No-break spaces become spaces, line ends \\n; trailing white space goes; at most one blank line stays between others."""
    t = F.regexp_replace(column(text), "[  ]", " ")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, _TRAILING, "$1")
    t = F.regexp_replace(t, r"\n[ \t]*\n[ \t]*(?:\n[ \t]*)+", "\n\n")
    return F.regexp_replace(t, r"\A[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z", "")


def normalize_spaces(text: Column | str) -> Column:
    """White space of any kind becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(column(text), F.lit("")), r"[\s\x{85}\p{Z}]+", " "))


def estimate_tokens(text: Column | str) -> Column:
    return F.floor(F.length(column(text)) / CHARS_PER_TOKEN).cast("long")


def content_hash(text: Column | str) -> Column:
    return F.sha2(normalize_text(text), 256)


def count_matches(text: Column | str, pattern: str) -> Column:
    """How many characters of text are in the class `pattern`."""
    return F.length(F.regexp_replace(column(text), f"[^{pattern}]+", "")).cast("long")


def detect_lang(text: Column | str) -> Column:
    """ru where Cyrillic letters are at least as many as Latin ones, else en. They are counted only in a text that has both."""
    cyrillic, latin = column(text).rlike("[Ѐ-ӿ]"), column(text).rlike("[A-Za-z]")
    more = count_matches(text, "Ѐ-ӿ") >= count_matches(text, "A-Za-z")
    return F.when(~latin, "ru").when(~cyrillic, "en").when(more, "ru").otherwise("en")


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(column(text)), F.lit(WORD), F.lit(0))


def prefix_tokens(text: Column | str, least: int = 4, prefix: int = 5) -> Column:
    """The distinct prefixes of tokens with content: a light stem that ignores endings."""
    kept = F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~t.isin(*CONTENT_STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda t: F.substring(t, 1, prefix)))


def query_tokens(*texts: Column | str, most: int = 16) -> Column:
    """The first distinct tokens of four letters or digits and more, of all texts in order, without stop words."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(column(t), F.lit("")), F.lit("[0-9A-Za-zА-Яа-яЁё]{4,}"), F.lit(0)), F.lower) for t in texts]
    return F.slice(F.array_distinct(F.filter(F.flatten(F.array(*found)), lambda t: ~t.isin(*QUERY_STOP_WORDS))), 1, most)


def lucene_query(*texts: Column | str) -> Column:
    """Query tokens as alternatives in Lucene's syntax."""
    return F.array_join(query_tokens(*texts), " OR ")


def containment(statement: Column | str, text: Column | str) -> Column:
    """The share of a statement's prefix tokens that the text has too; 0 for a statement without any."""
    own = prefix_tokens(statement)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, prefix_tokens(text))) / F.size(own)).otherwise(F.lit(0.0))


def truncate(text: Column | str, limit: int) -> Column:
    """Cut to limit characters, at the last space if that stands beyond 60 % of them, with an ellipsis."""
    t = F.trim(column(text))
    head = F.substring(t, 1, limit)
    at = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    cut = F.when((F.locate(" ", head) > 0) & (at - 1 > 0.6 * limit), F.substring(head, F.lit(1), at - 1)).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def quote(text: Column | str, limit: int = 280) -> Column:
    """The first characters, cut at the last space, with an ellipsis if anything was cut."""
    t = F.trim(column(text))
    head = F.substring(t, 1, limit)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*\z", ""), F.lit("…")))


def word_windows(text: Column | str, size: int = 180, overlap: int = 40, least_chars: int = 80) -> Column:
    """Windows of words that overlap, as an array of (idx, first_word, words). Short windows are skipped and not numbered.

    A window is as long as its words with single spaces between them.
    """
    step = max(1, size - overlap)

    def cut(words: Column) -> Column:
        n = F.size(words)
        # The last window is the first one that reaches the end.
        last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int") * step)
        windows = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda a: F.struct(a.alias("first_word"), F.slice(words, a + 1, F.lit(size)).alias("words")))
        kept = F.filter(windows, lambda w: F.aggregate(w["words"], F.lit(-1), lambda n, x: n + F.length(x) + 1) >= least_chars)
        return F.when(n > 0, F.transform(kept, lambda w, i: F.struct(i.alias("idx"), w["first_word"].alias("first_word"), w["words"].alias("words"))))

    # Once per text: what a lambda names is computed anew for each element.
    return bind(F.regexp_extract_all(column(text), F.lit(r"[^\s]+"), F.lit(0)), cut)


def front_matter(raw: Column | str) -> Column:
    """The `key: value` lines of a leading block between --- lines, as a map. Values lose surrounding quotes."""
    block = F.regexp_extract(column(raw), r"\A---[ \t]*\n([\s\S]*?)\n---", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x.contains(":") & ~x.startswith(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.translate(F.trim(F.substr(x, F.locate(":", x) + 1)), "\"'", ""))))

    def last_of_each(found: Column) -> Column:
        # Of keys that come twice the last one counts.
        return F.map_from_entries(F.filter(found["pairs"], lambda p, i: ~F.array_contains(F.slice(found["keys"], i + 2, F.greatest(F.size(found["keys"]), F.lit(1))), p["col1"])))

    return bind(pairs, lambda ps: bind(F.struct(ps.alias("pairs"), F.transform(ps, lambda p: p["col1"]).alias("keys")), last_of_each))


def body_after_front_matter(raw: Column | str) -> Column:
    return F.regexp_replace(column(raw), r"\A---[ \t]*\n[\s\S]*?\n---[ \t]*\n?", "")


def file_name_facts(stem: Column | str) -> Column:
    """doc_type, lang and year that the parts of a file name between underscores give; of several the last."""
    parts = F.split(column(stem), "_")
    low = F.transform(parts, F.lower)
    return F.struct(
        F.try_element_at(F.filter(low, lambda p: p.isin(*DOC_TYPES)), F.lit(-1)).alias("doc_type"),
        F.try_element_at(F.filter(low, lambda p: p.isin("ru", "en")), F.lit(-1)).alias("lang"),
        F.try_element_at(F.filter(parts, lambda p: p.rlike(r"\A(19|20)\d{2}\z")), F.lit(-1)).cast("int").alias("year"),
    )


def tags(raw: Column | str) -> Column:
    """The tags of a front matter's `tags:` line, in brackets or not, without #, lower-cased, distinct."""
    given = F.element_at(front_matter(raw), "tags")
    parts = F.split(F.regexp_replace(F.coalesce(given, F.lit("")), r"[\[\]\"']", ""), ",")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(F.regexp_replace(F.trim(x), "^#+", ""))), lambda x: x != ""))


def table_is_data(rows: Column | str) -> Column:
    """Whether an array of rows of cells is a table of data: three rows, two columns, filled, short cells, many with digits."""
    r = column(rows)
    cells = F.transform(F.flatten(r), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    filled = F.filter(cells, lambda c: c != "")
    n = F.size(filled)
    chars = F.aggregate(filled, F.lit(0), lambda a, c: a + F.length(c))
    digits = F.size(F.filter(filled, lambda c: c.rlike(r"\d")))
    enough = (F.size(r) >= 3) & (F.size(F.element_at(r, 1)) >= 2) & (n > 0)
    return F.coalesce(enough & (n / F.size(cells) >= 0.6) & (chars / n <= 40) & (digits / n >= 0.3), F.lit(False))


def highlighted(text: Column | str, statement: Column | str) -> Column:
    """The words of text whose prefix the statement has."""
    stems = prefix_tokens(statement)
    return F.filter(F.regexp_extract_all(column(text), F.lit(WORD), F.lit(0)), lambda w: F.array_contains(stems, F.substring(F.lower(w), 1, 5)))


def corpus_path(path: Column | str) -> Column:
    """What stands after the last `/corpus/` of a path; the path itself without one."""
    return F.regexp_replace(column(path), r"\A.*/corpus/", "")
