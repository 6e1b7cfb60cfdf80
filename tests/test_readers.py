import zipfile

import pytest

from leafwright.sources.readers import csv_blocks, decode, markdown_blocks, read_blocks, text_blocks


def test_decode_falls_back():
    assert decode("é".encode()) == "é"
    assert decode("中文".encode("gb18030")) == "中文"


def test_paragraphs_have_their_lines():
    got = list(text_blocks(b"a\nb\n\n\nc\n"))
    assert [(g[2], g[3], g[6]) for g in got] == [(1, 2, "a\nb"), (5, 5, "c")]


def test_markdown_ignores_fences_and_reads_both_heading_forms():
    got = list(markdown_blocks(b"# A\nx\n```\n# no\n```\n\nB\n---\ny\n## C\n"))
    assert [(g[2], g[3], g[4], g[5]) for g in got] == [(1, 5, 1, "A"), (7, 9, 2, "B"), (10, 10, 2, "C")]


def test_csv_keeps_physical_rows():
    got = list(csv_blocks(b"boat;crew;port\n;;\nGull; 4 ;Brest\n\nTern;2\n", ";"))
    assert [(g[1], g[2], g[3], g[6]) for g in got] == [("header", 1, 1, "boat\tcrew\tport"), ("rows", 3, 5, "Gull\t4\tBrest\nTern\t2\t")]
    long = "x" * 200_000
    assert long in list(csv_blocks(f"a,b\n1,{long}\n".encode()))[1][6]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.csv").write_text("mast,sail\nmain,9\n")
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c t="s"><v>0</v></c></row><row r="3"><c><v>7</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:d>')
    with zipfile.ZipFile(tmp_path / "e.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<s xmlns:a="u"><a:p><a:t>First</a:t></a:p></s>')
        z.writestr("ppt/notesSlides/notesSlide1.xml", '<s xmlns:a="u"><a:p><a:t>note</a:t></a:p></s>')
    return tmp_path


def test_all_formats(spark, folder):
    got = {(r.path.rpartition("/")[2], r.kind, r.start, r.level): r.text for r in read_blocks(spark, str(folder)).collect()}
    assert got[("a.txt", "paragraph", 3, 0)] == "two"
    assert got[("b.csv", "rows", 2, 0)] == "main\t9"
    assert got[("c.xlsx", "rows", 3, 0)] == "7"
    assert got[("d.docx", "heading", 1, 2)] == "Title"
    assert got[("e.pptx", "slide", 1, 1)] == "First\nnote"
    assert ("broken.xlsx", "error", 0, 0) in got
