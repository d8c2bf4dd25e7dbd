"""YAML files as tables: every scalar of a file is a row with the path of keys and places that leads to it.

Read are block mappings and sequences, flow mappings and lists over several
lines, quoted and plain scalars, literal and folded blocks, and comments. Tags,
anchors, aliases and several documents in one file are refused: such a file
gives one row with its error. Files are read by Spark, from any store it can
read, a file in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.shipping import ship

#: Rows that a task hands over at once.
ROWS_AT_ONCE = 10_000
LEAVES = "ord long, path array<string>, value string, is_text boolean, error string"

_SPECIAL = re.compile(r"""["'#\[\]{}]""")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{}#&*!|>%@`,-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/"}
_REFUSED = re.compile(r"[&*!%@`]|---|\.\.\.")
# Plain scalars that mean nothing is there.
_NOTHING = ("", "~", "null", "Null", "NULL")

Leaf = tuple[list[str], str | None, bool]


def _logical_lines(text: str) -> list[tuple[int, str]]:
    """Indent and content of each line without comments; a flow that goes on is one line, a block scalar is a quoted one."""
    out: list[tuple[int, str]] = []
    raw = text.lstrip("\ufeff").split("\n")
    k = 0
    while k < len(raw):
        line, depth = _bare(raw[k], 0)
        indent = len(raw[k]) - len(raw[k].lstrip(" "))
        k += 1
        while depth and k < len(raw):
            more, depth = _bare(raw[k], depth)
            line += " " + more.strip()
            k += 1
        if depth:
            raise ValueError("a bracket is not closed")
        content = line.strip()
        block = re.search(r"(?:^|[:\-] +)([|>])([+-]?)$", content)
        if block:
            held = []
            while k < len(raw) and (not raw[k].strip() or len(raw[k]) - len(raw[k].lstrip(" ")) > indent):
                held.append(raw[k])
                k += 1
            while held and not held[-1].strip():
                held.pop()
            cut = min((len(x) - len(x.lstrip(" ")) for x in held if x.strip()), default=0)
            body = [x[cut:].rstrip("\r") for x in held]
            joined = "\n".join(body) if block[1] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(body))
            value = joined + ("" if block[2] == "-" or not held else "\n")
            content = content[: block.start(1)] + '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        if content:
            out.append((indent, content))
    return out


def _bare(line: str, depth: int) -> tuple[str, int]:
    """A line without its comment, and how many brackets are open behind it."""
    at = 0
    while m := _SPECIAL.search(line, at):
        c, at = m[0], m.end()
        if c == "#":
            if m.start() == 0 or line[m.start() - 1].isspace():
                return line[: m.start()], depth
        elif c in "\"'":
            # A quote opens a scalar only where one may begin.
            if re.search(r"(?:^\s*|[:\-,\[{]\s*)$", line[: m.start()]):
                end = re.compile(r'(?:[^"\\]|\\.)*"' if c == '"' else r"(?:[^']|'')*'").match(line, at)
                if not end:
                    raise ValueError("a quote is not closed")
                at = end.end()
        elif depth or re.search(r"(?:^\s*|[:\-]\s+)$", line[: m.start()]):
            depth += 1 if c in "[{" else -1
    return line, max(depth, 0)


def _scalar(text: str) -> tuple[str | None, bool]:
    text = text.strip()
    if text[:1] == '"':
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" else _ESCAPES.get(m[1], m[1]), text[1:-1]), True
    if text[:1] == "'":
        return text[1:-1].replace("''", "'"), True
    if _REFUSED.match(text):
        raise ValueError(f"not read: {text[:40]}")
    return (None if text in _NOTHING else text), False


def _flow(text: str, path: list[str]) -> Iterator[Leaf]:
    """A value on one line."""
    text = text.strip()
    if text[:1] not in ("[", "{"):
        yield path, *_scalar(text)
        return
    parts, depth, begin, at = [], 0, 1, 1
    while at < len(text):
        m = re.compile(r"""["'\[\]{},]""").search(text, at)
        if not m:
            raise ValueError("a bracket is not closed")
        c, at = m[0], m.end()
        if c in "\"'" and re.search(r"[:,\[{]\s*$", text[: m.start()]):
            end = re.compile(r'(?:[^"\\]|\\.)*"' if c == '"' else r"(?:[^']|'')*'").match(text, at)
            if not end:
                raise ValueError("a quote is not closed")
            at = end.end()
        elif c in "[{":
            depth += 1
        elif c in "]}" and depth:
            depth -= 1
        elif c in ",]}" and not depth:
            parts.append(text[begin : m.start()])
            begin = at
            if c != ",":
                break
    items = [p for k, p in enumerate(parts) if p.strip() or k < len(parts) - 1]
    for k, part in enumerate(items):
        if text[0] == "[":
            yield from _flow(part, [*path, str(k)])
        else:
            key = _KEY.match(part.strip())
            name = _scalar(key[1])[0] if key else _scalar(part)[0]
            yield from _flow(part.strip()[key.end() :] if key else "", [*path, name or ""])


def leaves(text: str) -> list[Leaf]:
    """Path, value and whether it was quoted, of each scalar of a file in its order."""
    lines = _logical_lines(text)
    out: list[Leaf] = []

    def block(k: int, indent: int, path: list[str]) -> int:
        """Reads what stands at indent from line k on; returns the line after it."""
        n = 0
        dashed = lambda x: x == "-" or x.startswith("- ")
        sequence = dashed(lines[k][1])
        # A sequence may stand no deeper than its key: the next key ends it.
        while k < len(lines) and lines[k][0] == indent and dashed(lines[k][1]) == sequence:
            content = lines[k][1]
            if sequence:
                rest = content[1:].strip()
                inner = indent + len(content) - len(content[1:].lstrip()) if rest else indent
                if rest and (_KEY.match(rest) or rest.startswith("- ")) and rest[0] not in "[{":
                    # What follows the dash begins a block of its own.
                    lines[k] = (inner, rest)
                    k = block(k, inner, [*path, str(n)])
                else:
                    k = value(k, rest, indent, [*path, str(n)])
                n += 1
                continue
            key = _KEY.match(content)
            if not key:
                if n == 0 and not path and len(lines) == 1:
                    out.extend(_flow(content, path))
                    return k + 1
                raise ValueError(f"no key: {content[:40]}")
            k = value(k, content[key.end() :].strip(), indent, [*path, _scalar(key[1])[0] or ""])
            n += 1
        return k

    def value(k: int, rest: str, indent: int, path: list[str]) -> int:
        if rest:
            out.extend(_flow(rest, path))
            return k + 1
        deeper = k + 1 < len(lines) and (lines[k + 1][0] > indent or (lines[k + 1][0] == indent and lines[k + 1][1].startswith("- ") and not lines[k][1].startswith("-")))
        if deeper:
            return block(k + 1, lines[k + 1][0], path)
        out.append((path, None, False))
        return k + 1

    end = block(0, lines[0][0], []) if lines else 0
    if end < len(lines):
        raise ValueError(f"indented unlike what stands before: {lines[end][1][:40]}")
    return out


def _leaves_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """source_path and LEAVES of files (source_path, value): the rows of one file are held at a time, and handed over by ROWS_AT_ONCE."""
    for pdf in batches:
        for name, text in zip(pdf["source_path"], pdf["value"], strict=True):
            try:
                rows = [(name, k, p, v, q, None) for k, (p, v, q) in enumerate(leaves(text))]
            except ValueError as e:
                rows = [(name, None, None, None, None, str(e))]
            for at in range(0, len(rows), ROWS_AT_ONCE):
                yield pd.DataFrame(rows[at : at + ROWS_AT_ONCE], columns=["source_path", *(x.split()[0] for x in LEAVES.split(", "))])


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """source_path, ord, path, value (NULL where nothing is there), is_text (it was quoted) and error of all files at path."""
    ship(spark)
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")

    return found.mapInPandas(_leaves_of, f"source_path string, {LEAVES}")


def _fields(rows: DataFrame, keys: list[Column], **fields: str) -> DataFrame:
    """One row for each of keys (paths' parts), with the value under each field's name."""
    return rows.groupBy("source_path", *keys).agg(*[F.max(F.when(F.element_at("path", -1) == name, F.col("value"))).alias(c) for c, name in fields.items()])


def units_of(yaml: DataFrame) -> DataFrame:
    """A table of units (units.SCHEMA) of files with `categories` (canonical_unit, abs_delta) and `units` (category, multiplier, offset by spelling)."""
    key = F.col("path")[1]
    known = _fields(yaml.where("path[0] = 'categories' AND size(path) = 3"), [key.alias("category")], canonical_unit="canonical_unit", zero_delta="abs_delta")
    spelled = _fields(yaml.where("path[0] = 'units' AND size(path) = 3"), [key.alias("unit")], category="category", multiplier="multiplier", offset="offset")
    joined = spelled.join(known, ["source_path", "category"], "left")
    number = lambda c, otherwise: F.coalesce(F.col(c).try_cast("double"), F.lit(otherwise)).alias(c)
    return joined.select("unit", "category", number("multiplier", 1.0), number("offset", 0.0), "canonical_unit", F.col("zero_delta").try_cast("double").alias("zero_delta"))


def glossary_of(yaml: DataFrame) -> DataFrame:
    """term_id, label, name and aliases of files that give terms with `label` and lists or single words `ru` and `en`; the first ru, else en, is the name."""
    terms = yaml.where("error IS NULL AND size(path) >= 2")
    named = F.sort_array(F.collect_list(F.when(F.col("path")[1].isin("ru", "en") & F.col("value").isNotNull(), F.struct((F.col("path")[1] == "en").alias("later"), "ord", "value"))))
    found = terms.groupBy(F.col("path")[0].alias("term_id")).agg(F.max(F.when(F.col("path")[1] == "label", F.col("value"))).alias("label"), F.transform(named, lambda x: x["value"]).alias("names"))
    return found.select("term_id", "label", F.try_element_at("names", F.lit(1)).alias("name"), F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0))).alias("aliases"))


def ontology_of(yaml: DataFrame) -> DataFrame:
    """entity_id, type, name of files with a list `entities` (entity_id, type, synonyms): a row for each synonym, as a dictionary of names in texts."""
    items = yaml.where("path[0] = 'entities' AND size(path) >= 3").withColumn("item", F.col("path")[1])
    ids = _fields(items.where("size(path) = 3"), [F.col("item")], entity_id="entity_id", type="type")
    synonyms = items.where("path[2] = 'synonyms' AND value IS NOT NULL").select("source_path", "item", F.col("value").alias("name"))
    return ids.join(synonyms, ["source_path", "item"]).select("entity_id", "type", "name").distinct()
