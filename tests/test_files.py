from __future__ import annotations

import io
import os
import subprocess
import sys
import zipfile

from pyspark import cloudpickle
from pyspark.sql import functions as F

from winnow.catalog.files_fixture import make_docx
from winnow.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(*runs: str) -> str:
    return "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"


def t(text: str) -> str:
    return f'<w:t xml:space="preserve">{text}</w:t>'


def cell(text: str, props: str = "") -> str:
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t(text))}</w:tc>"


def test_docx_text():
    body = (p(t("Jane "), t("Doe")) + p(t("   ")) + p(t("a"), "<w:tab/>", t("b"), "<w:br/>", t("c"))
            + "<w:tbl><w:tr>" + cell("One", '<w:gridSpan w:val="2"/>') + cell(" ") + cell(" Two ") + "</w:tr>"
            + "<w:tr>" + cell("") + cell("") + "</w:tr></w:tbl>" + p(t("after")))
    assert files.docx_text(docx(body)) == "Jane Doe\na\tb\nc\nafter\nOne | One | Two"


def test_merged_cells_repeat():
    body = ("<w:tbl><w:tr>" + cell("Top", '<w:vMerge w:val="restart"/>') + cell("x") + "</w:tr><w:tr>"
            + cell("", "<w:vMerge/>") + cell("y") + "</w:tr></w:tbl>")
    assert files.docx_text(docx(body)) == "Top | x\nTop | y"


def test_scan_parse_and_bundle(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "one.DOCX").write_bytes(make_docx("hello\n\nworld", ["k", "v"]))
    (tmp_path / "deep" / "er" / "broken.docx").write_bytes(b"nothing")
    (tmp_path / "deep" / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "deep" / "notes.txt").write_bytes(b"no")
    (tmp_path / "deep" / ".hidden.docx").write_bytes(b"no")
    found = files.scan_folder(spark, str(tmp_path))
    names = {r["filename"] for r in files.supported_files(found).collect()}
    assert names == {"one.DOCX", "broken.docx", "scan.pdf"}
    parsed = {r["filename"]: r for r in files.parse_files(found).collect()}
    assert parsed["one.DOCX"]["raw_text"] == "hello\nworld\nk | v" and parsed["one.DOCX"]["error"] is None
    assert parsed["broken.docx"]["raw_text"] == "" and parsed["broken.docx"]["error"]
    assert parsed["scan.pdf"]["error"] == "NoExtractor"
    texts = found.select("path", F.lit("scanned").alias("raw_text"))
    again = {r["filename"]: r["raw_text"] for r in files.parse_files(found, texts).collect()}
    assert again["scan.pdf"] == "scanned" and again["broken.docx"] == ""

    folder = {r["filename"]: (r["raw_text"], r["error"]) for r in files.parse_folder(spark, str(tmp_path), texts).collect()}
    assert folder["one.DOCX"] == ("hello\nworld\nk | v", None) and folder["scan.pdf"] == ("scanned", None)
    resumes = files.as_resumes(files.parse_folder(spark, str(tmp_path)), F.lit("upload"))
    numbered = [r["filename"] for r in resumes.orderBy("ordinal").collect()]
    assert numbered == ["broken.docx", "scan.pdf", "one.DOCX"] and resumes.columns == [
        "batch_id", "resume_id", "ordinal", "filename", "raw_text"]

    bundle = io.BytesIO()
    with zipfile.ZipFile(bundle, "w") as z:
        z.writestr("a/cv.docx", make_docx("from zip", ["c"]))
        z.writestr("__MACOSX/._cv.docx", b"")
        z.writestr("a/readme.txt", b"")
    (tmp_path / "set.ZIP").write_bytes(bundle.getvalue())
    zips = files.scan_folder(spark, str(tmp_path), [".zip"])
    members = files.expand_zips(zips).filter("error is null")
    assert {r["path"] for r in members.collect()} == {"a/cv.docx", "__MACOSX/._cv.docx", "a/readme.txt"}
    assert [r["raw_text"] for r in files.parse_files(members).collect()] == ["from zip\nc"]


def test_names_that_spark_passes_over(spark, tmp_path):
    (tmp_path / "_deep" / ".er").mkdir(parents=True)
    for name in ("_jane.docx", "_a=b.docx", "plain.docx", "_deep/in.docx", "_deep/.er/_two.DOCX", "__skip.docx", ".skip.docx"):
        (tmp_path / name).write_bytes(make_docx(name, []))
    for name in ("_scan.pdf", "_metadata.pdf", "_deep/__skip.pdf", "_notes.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    rows = files.parse_folder(spark, str(tmp_path)).collect()
    assert sorted((r["filename"], r["raw_text"], r["error"]) for r in rows) == sorted(
        [(n.rsplit("/", 1)[-1], n, None) for n in ("_jane.docx", "_a=b.docx", "plain.docx", "_deep/in.docx", "_deep/.er/_two.DOCX")]
        + [(n, "", "NoExtractor") for n in ("_scan.pdf", "_metadata.pdf")])
    assert {r["path"] for r in rows} == {f"file:{tmp_path / n}" for n in (
        "_jane.docx", "_a=b.docx", "plain.docx", "_deep/in.docx", "_deep/.er/_two.DOCX", "_scan.pdf", "_metadata.pdf")}


def test_folder_listing(spark, tmp_path):
    for name in ("a/x.pdf", "a/b/y.docx", "_c/.d/z.doc", "c[1]/w.pdf", "e/empty/none.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "link").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "linked.pdf").symlink_to(tmp_path / "a" / "x.pdf")

    def names(folder):
        return sorted(r["path"].removeprefix(f"file:{tmp_path}/") for r in files.list_folder(spark, folder).collect())

    everything = ["_c/.d/z.doc", "a/b/y.docx", "a/x.pdf", "c[1]/w.pdf", "e/empty/none.txt", "linked.pdf"]
    assert names(str(tmp_path)) == names(f"file://{tmp_path}/") == everything
    assert names(f"{tmp_path}/a") == ["a/b/y.docx", "a/x.pdf"]
    assert names(f"{tmp_path}/*/b") == ["a/b/y.docx"] and names(f"{tmp_path}/[ae]/*.pdf") == ["a/x.pdf"]
    assert {r["path"]: r["length"] for r in files.list_folder(spark, f"{tmp_path}/a").collect()}[f"file:{tmp_path}/a/x.pdf"] == 7
    read = files.read_files(files.list_folder(spark, f"{tmp_path}/a")).collect()
    assert sorted(bytes(r["content"]).decode() for r in read) == ["a/b/y.docx", "a/x.pdf"]


def test_an_empty_folder_has_no_files(spark, tmp_path):
    assert files.scan_folder(spark, str(tmp_path)).collect() == []
    assert files.parse_folder(spark, str(tmp_path)).collect() == []


def test_bundles_with_equal_member_paths_keep_their_texts(spark, tmp_path):
    for name in ("one.zip", "two.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("cv/1.pdf", b"")
    members = files.expand_zips(files.scan_folder(spark, str(tmp_path), [".zip"]))
    texts = members.select("bundle", "path", files.base_name(F.col("bundle")).alias("raw_text"))
    rows = files.parse_files(members, texts).collect()
    assert sorted((r["bundle"].rsplit("/", 1)[-1], r["raw_text"]) for r in rows) == [
        ("one.zip", "one.zip"), ("two.zip", "two.zip")]


def test_a_damaged_bundle_is_an_error_row(spark, tmp_path):
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("cv.txt", b"some text " * 500)
    data = bytearray(whole.getvalue())
    data[40:60] = b"\xff" * 20
    (tmp_path / "bad.zip").write_bytes(bytes(data))
    rows = files.expand_zips(files.scan_folder(spark, str(tmp_path), [".zip"])).collect()
    assert [(r["path"], r["error"] is not None) for r in rows] == [(None, True)]


def test_extensions(spark):
    names = ["a.DOCX", "a.tar.gz", ".bashrc", "..x", "a.", "noext", "x.jpeg"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(files.extension(F.col("n"))).collect()] == [
        ".docx", ".gz", "", "", ".", "", ".jpeg"]


def test_codecs_load_where_the_package_is_missing(tmp_path):
    code = ("import pickle, sys; from pyspark import cloudpickle; codec = pickle.load(sys.stdin.buffer); "
            "assert 'winnow' not in sys.modules; print(codec.__name__)")
    for codec in (files._docx_texts, files._members):
        done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(codec), cwd=tmp_path,
                              capture_output=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert done.stdout.decode().strip() == codec.__name__, done.stderr.decode()


def test_few_file_contents_reach_python_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, expected in (("10000", str(files.BATCH_FILES)), ("0", str(files.BATCH_FILES)), ("64", "64")):
            spark.conf.set(name, given)
            files.small_batches(spark.range(1))
            assert spark.conf.get(name) == expected
    finally:
        spark.conf.set(name, before)
