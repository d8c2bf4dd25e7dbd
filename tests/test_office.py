import zipfile

from factloom.sources import files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
BODY = "Nickel matte is leached in sulphuric acid at 80 degrees for two hours under oxygen, and most copper stays behind."


def write(path, **parts):
    with zipfile.ZipFile(path, "w") as out:
        for name, text in parts.items():
            out.writestr(name.replace("__", "/") + ".xml", text)


def cell(text, space="w"):
    run = f"<{space}:r><{space}:t>{text}</{space}:t></{space}:r>"
    return f"<{space}:tc><{space}:p>{run}</{space}:p></{space}:tc>"


def table(rows, space="w"):
    return f"<{space}:tbl>" + "".join(f"<{space}:tr>" + "".join(cell(c, space) for c in r) + f"</{space}:tr>" for r in rows) + f"</{space}:tbl>"


def test_blocks_of_documents_and_slides(spark, tmp_path):
    (tmp_path / "below").mkdir()
    paragraph = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{x}</w:t></w:r>" if x != "\t" else "<w:r><w:tab/></w:r>" for x in runs) + "</w:p>"
    inner = paragraph("Before ", "it") + table([["", "Cu", "Ni"], ["Slag", "1", "2"]]) + f"<w:sdt><w:sdtContent>{paragraph('a', chr(9), 'b')}</w:sdtContent></w:sdt>" + "<w:p/>" + paragraph(BODY)
    write(tmp_path / "a.docx", word__document=f"<w:document {W}><w:body>{inner}</w:body></w:document>")
    slide = lambda text, more="": f"<p:sld {A}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>{more}</p:spTree></p:cSld></p:sld>"
    write(tmp_path / "below" / "b.pptx", ppt__slides__slide10=slide("last"), ppt__slides__slide2=slide("first", f"<p:graphicFrame>{table([['x', 'y'], ['1', '2']], 'a')}</p:graphicFrame>"))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    write(tmp_path / "other.docx", something="<x/>")
    write(tmp_path / "entities.docx", word__document=f'<!DOCTYPE x [<!ENTITY e "e">]><w:document {W}><w:body/></w:document>')
    write(tmp_path / "~$a.docx", word__document=f"<w:document {W}><w:body/></w:document>")
    read = office.read_office(spark, str(tmp_path))
    got = {}
    for r in read.orderBy("source_path", "ord").collect():
        got.setdefault(r.source_path.rpartition("/")[2], []).append(r.error or r.text or r.cells)
    assert got["a.docx"] == ["Before it", [["", "Cu", "Ni"], ["Slag", "1", "2"]], "a\tb", BODY]
    assert got["b.pptx"] == ["first", [["x", "y"], ["1", "2"]], "last"]
    assert {k: v[0].split(":")[0] for k, v in got.items() if k not in ("a.docx", "b.pptx")} == {"broken.docx": "BadZipFile", "other.docx": "ValueError", "entities.docx": "ValueError"}
    raw = {r.source_path.rpartition("/")[2]: r.raw for r in office.office_corpus(read).collect()}
    assert raw == {"a.docx": f"Before it\n\nSlag: Cu = 1; Ni = 2.\n\na\tb\n\n{BODY}", "b.pptx": "first\n\nx = 1; y = 2.\n\nlast"}
    parsed = files.parse_documents(office.office_corpus(read)).collect()
    assert [(r.title, r.lang) for r in parsed] == [("a", "en")]
