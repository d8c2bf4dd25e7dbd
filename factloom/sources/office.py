"""DOCX and PPTX files as blocks of text and tables in their order, and as documents with their tables in words."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.chunking import linear_tables
from factloom.shipping import ship

BLOCKS = "source_path string, ord long, text string, cells array<array<string>>, error string"

# The name spaces of the two formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
#: Bytes of one part of a file, unpacked, beyond which it is refused: a small file may unpack to anything.
MOST_BYTES = 200_000_000

Block = tuple[str | None, list[list[str]] | None]


def _part(held: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if held.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is too large")
    data = held.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError(f"{name} defines entities")
    return ElementTree.fromstring(data)


def _said(element: ElementTree.Element, space: str) -> str:
    """The runs of text below an element; tabs and breaks as such, paragraphs as lines."""
    out = []
    for x in element.iter():
        if x.tag == f"{space}t":
            out.append(x.text or "")
        elif x.tag == f"{space}tab":
            out.append("\t")
        elif x.tag in (f"{space}br", f"{space}cr") or (x.tag == f"{space}p" and x is not element and out):
            out.append("\n")
    return "".join(out).strip()


def _walk(element: ElementTree.Element, space: str) -> Iterator[Block]:
    """Paragraphs and whole tables in order, however deep they stand; what a table holds is in it alone."""
    for x in element:
        if x.tag == f"{space}tbl":
            yield None, [[_said(cell, space) for cell in row if cell.tag == f"{space}tc"] for row in x if row.tag == f"{space}tr"]
        elif x.tag == f"{space}p":
            if text := _said(x, space):
                yield text, None
        else:
            yield from _walk(x, space)


def blocks(data: bytes) -> list[Block]:
    """The texts and tables of a file; slides in the order of their numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as held:
        names = held.namelist()
        if "word/document.xml" in names:
            return [*_walk(_part(held, "word/document.xml"), _W)]
        slides = sorted((int(m[1]), m[0]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        if not slides:
            raise ValueError("neither a document nor slides")
        return [b for _, name in slides for b in _walk(_part(held, name), _A)]


def read_office(spark: SparkSession, root: str) -> DataFrame:
    """BLOCKS of all .docx and .pptx files below root, temporary ones (~$) left out; a file that can't be read is one row with its error."""
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pptx}").load(root)
    named = found.where(~F.substring_index("path", "/", -1).startswith("~$")).select(F.col("path").alias("source_path"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["source_path"], pdf["content"], strict=True):
                try:
                    rows = [(path, k, text, cells, None) for k, (text, cells) in enumerate(blocks(content))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, RuntimeError) as e:
                    rows = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCKS.split(", ")])

    return named.mapInPandas(run, BLOCKS)


def office_corpus(read: DataFrame) -> DataFrame:
    """source_path, raw of read files, as read_corpus gives text files: blocks apart by empty lines, tables as linear_tables puts them."""
    good = read.where("error IS NULL")
    key = F.struct("source_path", "ord").alias("id")
    tables = linear_tables(good.where("cells IS NOT NULL").select(key, F.col("cells").alias("rows"))).select("id.source_path", "id.ord", "text")
    every = good.where("text IS NOT NULL").select("source_path", "ord", "text").unionByName(tables).where("text != ''")
    held = every.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return held.select("source_path", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("raw"))
