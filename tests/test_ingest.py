"""Folder ingest (R01-R03) on a generated corpus (FIXTURES.md section 6)."""

import os
import zipfile
import io

from docket.sources.docx import W, docx_bytes, quarantine, read_docx_folder, readable


def _raw_docx(body_xml: str) -> bytes:
    base = docx_bytes("x")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(base)) as zin, zipfile.ZipFile(out, "w") as zout:
        for item in zin.namelist():
            data = zin.read(item)
            if item == "word/document.xml":
                data = (f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body_xml}</w:body></w:document>').encode()
            zout.writestr(item, data)
    return out.getvalue()


def test_corpus(spark, tmp_dir):
    d = tmp_dir
    files = {
        "plain.docx": docx_bytes("first line\nsecond line"),
        "blank.docx": docx_bytes("a\n\nend"),
        "tabbreak.docx": _raw_docx(
            "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>end</w:t></w:r></w:p>"
        ),
        "table.docx": docx_bytes("before", table_cell="cell text"),
        "bad.docx": b"this is not a zip archive",
        "B.DOCX": docx_bytes("upper"),
        "_x.docx": docx_bytes("underscore"),
        ".x.docx": docx_bytes("hidden"),
        "~$x.docx": docx_bytes("lock"),
        "x.txt": b"text",
    }
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    open(os.path.join(d, "zero.docx"), "wb").close()
    os.makedirs(os.path.join(d, "nested"))
    with open(os.path.join(d, "nested", "n.docx"), "wb") as fh:
        fh.write(docx_bytes("nested"))
    os.makedirs(os.path.join(d, "dir.docx"))

    ex = read_docx_folder(spark, d)
    got = {r["filename"]: r for r in ex.collect()}
    ok = {r["filename"]: r["text"] for r in readable(ex).collect()}
    assert ok["plain.docx"] == "first line\nsecond line"
    assert ok["blank.docx"] == "a\n\nend"
    assert ok["tabbreak.docx"] == "a\tb\nc\n\nend"
    assert ok["table.docx"] == "before"  # table cells are not body paragraphs
    assert ok["~$x.docx"] == "lock"  # lock files are listed, as by a plain listing
    bad = {r["filename"] for r in quarantine(ex).collect()}
    assert "bad.docx" in bad and got["bad.docx"]["text"] is None
    # case-sensitive suffix, no recursion, other suffixes ignored
    for absent in ("B.DOCX", "n.docx", "x.txt"):
        assert absent not in got
    # documented difference: the binary-file listing skips hidden and '_' names,
    # zero-byte files and directories
    for skipped in ("_x.docx", ".x.docx", "dir.docx"):
        assert skipped not in got
    assert "zero.docx" not in got or "zero.docx" in bad


def test_only_the_paragraphs_own_runs_count():
    from docket.sources.docx import docx_text

    body = (
        '<w:p><w:pPr><w:tabs><w:tab w:val="left" w:pos="720"/><w:tab w:val="left" w:pos="1440"/></w:tabs></w:pPr>'
        '<w:r><w:t>Caption</w:t></w:r><w:ins><w:r><w:t>inserted</w:t></w:r></w:ins>'
        '<w:r><w:pict><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p>'
    )
    assert docx_text(_raw_docx(body)) == "Caption"


def test_main_part_by_relationship():
    from docket.sources.docx import docx_text

    body = f'<w:document xmlns:w="{W[1:-1]}"><w:body><w:p><w:r><w:t>moved</w:t></w:r></w:p></w:body></w:document>'
    rels = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1"'
            ' Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"'
            ' Target="/story/main.xml"/></Relationships>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", rels)
        z.writestr("story/main.xml", body)
    assert docx_text(out.getvalue()) == "moved"


def test_break_kinds():
    from docket.sources.docx import docx_text

    body = (
        '<w:p><w:r><w:t>a</w:t><w:br w:type="page"/><w:t>b</w:t><w:br/><w:t>c</w:t>'
        '<w:noBreakHyphen/><w:t>d</w:t><w:cr/><w:delText>gone</w:delText></w:r>'
        '<w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink></w:p>'
    )
    assert docx_text(_raw_docx(body)) == "ab\nc-d\n link"
