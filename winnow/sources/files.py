"""Resume files: folder scan, ZIP bundles, DOCX text, dispatch by type.

Listing and reading folders and the two codecs (ZIP, DOCX) run in Python on executors, one file at a time.
"""

from __future__ import annotations

import fnmatch
import io
import os
import re
import sys
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import fixed
from winnow.operators.slices import materialize

SUPPORTED = [ext for group in fixed.FILE_TYPES.values() for ext in group]
# Executors need not have this package: its codecs travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
# Files whose contents travel to a codec at once.
BATCH_FILES = 256
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def small_batches(files: DataFrame) -> DataFrame:
    """``files``, of whose contents at most ``BATCH_FILES`` reach Python at once: by default it would be 10,000, in each
    worker several times over. A smaller number set by the session stays."""
    conf = files.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_FILES:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_FILES))
    return files


# --- names and types ---------------------------------------------------------------------------------------------

def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; leading dots do not start one."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def file_type(name: Column) -> Column:
    """Type group of a file name, null if unsupported."""
    choice = F.lit(None).cast("string")
    for group, extensions in fixed.FILE_TYPES.items():
        choice = F.when(extension(name).isin(extensions), F.lit(group)).otherwise(choice)
    return choice


def supported_files(files: DataFrame) -> DataFrame:
    """Rows whose ``path`` names a supported, not hidden file; adds ``filename``, ``file_type`` and, where
    there is none, a null ``bundle``."""
    named = files.withColumn("filename", base_name(F.col("path")))
    hidden = F.lit(False)
    for prefix in fixed.HIDDEN_PREFIXES:
        hidden = hidden | F.col("filename").startswith(prefix)
    if "bundle" not in named.columns:
        named = named.withColumn("bundle", F.lit(None).cast("string"))
    typed = named.filter(~hidden).withColumn("file_type", file_type(F.col("filename")))
    return typed.filter(F.col("file_type").isNotNull())


# Directory entries, and bytes of files or of members of archives, that a task sends on together.
LISTED_ROWS, FLUSH_BYTES = 10_000, 16_000_000
_ENTRY = "path string, length bigint, is_folder boolean, wanted string"


def _file_system(uri: str):
    """The file system of ``uri`` (None: this machine's) and the path within it."""
    from pyarrow import fs

    local = re.sub(r"^file:/*", "/", uri)
    if "://" not in local:
        return None, local
    store, path = re.fullmatch(r"(\w[\w+.-]*://[^/]*)(.*)", uri, re.DOTALL).groups()
    system, root = fs.FileSystem.from_uri(store + "/")  # names may hold what a URI may not
    return system, root.rstrip("/") + path


def _entries(folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder and the sizes of files (None: a folder). Links to folders are passed over, so none is walked
    twice."""
    from pyarrow import fs

    system, inner = _file_system(folder)
    if system is None:
        with os.scandir(inner) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, None
                elif entry.is_file():
                    yield entry.name, entry.stat().st_size
        return
    for info in system.get_file_info(fs.FileSelector(inner, recursive=False)):
        if info.type is not fs.FileType.NotFound:
            yield info.base_name, None if info.type is fs.FileType.Directory else info.size


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the folders that come in. ``wanted`` holds the rest of a pattern that names must still match."""
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          ["path", "length", "is_folder", "wanted"])

    rows = []
    for batch in batches:
        for folder, wanted in zip(*(batch.column(n).to_pylist() for n in ("path", "wanted"))):
            here, _, rest = wanted.partition("/")
            for name, length in _entries(folder):
                if (here and not fnmatch.fnmatchcase(name, here)) or (rest and length is not None):
                    continue
                rows.append((f"{folder.rstrip('/')}/{name}", length, length is None, rest))
                if len(rows) >= LISTED_ROWS:
                    yield batch_of(rows)
                    rows = []
    if rows:
        yield batch_of(rows)


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of all files below ``folder``, whose last parts may be patterns (``*``, ``?``, ``[...]``).

    Folders are listed on executors, one level of the tree after the other, whatever their names begin with. The driver
    sees how many folders a level has and no path.
    """
    parts = re.sub(r"^file:/*", "/", folder.rstrip("/")).split("/")
    plain = next((i for i, part in enumerate(parts) if re.search(r"[*?\[]", part)), len(parts))
    root = "/".join(parts[:plain]) or "/"
    level = spark.createDataFrame([(root if "://" in root else f"file:{root}", "/".join(parts[plain:]))],
                                  "path string, wanted string")
    most, folders, found = int(spark.conf.get("spark.sql.shuffle.partitions")), 1, []
    while folders:
        below = materialize(level.repartition(min(folders, most)).mapInArrow(_list, _ENTRY))
        found.append(below.filter("not is_folder").select("path", "length"))
        level = below.filter("is_folder").select("path", "wanted")
        folders = level.count()
    return reduce(DataFrame.unionByName, found)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))],
                                          ["path", "content"])

    rows, held = [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, inner = _file_system(path)
            with open(inner, "rb") if system is None else system.open_input_stream(inner) as file:
                rows.append((path, file.read()))
            held += len(rows[-1][1])
            if held > FLUSH_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
    if rows:
        yield batch_of(rows)


def read_files(files: DataFrame) -> DataFrame:
    """``path, content`` of listed files, dealt over tasks by path, so that a full folder is no single task's work."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(tasks, "path").mapInArrow(_read, "path string, content binary")


def scan_folder(spark: SparkSession, folder: str, extensions=None, content: bool = True) -> DataFrame:
    """``path, content`` (or ``path``) of the files below ``folder`` with the given extensions in any letter case
    (default: all supported). Other files are never opened, names that begin with ``.`` or ``__`` not either; a folder
    may have any name."""
    named = list_folder(spark, folder).withColumn("_name", base_name(F.col("path")))
    kept = F.lower(F.col("_name")).rlike("(?:" + "|".join(re.escape(e) for e in extensions or SUPPORTED) + r")\z")
    for prefix in fixed.HIDDEN_PREFIXES:
        kept = kept & ~F.col("_name").startswith(prefix)
    files = named.filter(kept).select("path")
    return read_files(files) if content else files


# --- ZIP bundles ---------------------------------------------------------------------------------------------------


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["bundle", "path", "content", "error"]
    rows, held = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                    for item in bundle.infolist():
                        if item.is_dir():
                            continue
                        rows.append((path, item.filename, bundle.read(item), None))
                        held += item.file_size
                        if held > FLUSH_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
            except Exception as failure:  # a damaged bundle costs no other; members read before it are kept
                rows.append((path, None, None, type(failure).__name__))
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def expand_zips(bundles: DataFrame) -> DataFrame:
    """One row per archive member: ``bundle, path, content, error``. A broken archive yields one error row."""
    return small_batches(bundles).select("path", "content").mapInPandas(
        _members, "bundle string, path string, content binary, error string")


# --- DOCX text -------------------------------------------------------------------------------------------------------

def _run_text(node) -> str:
    out = []
    for part in node.iter():
        if part.tag == _WORD + "t":
            out.append(part.text or "")
        elif part.tag == _WORD + "tab" and part.attrib == {}:
            out.append("\t")
        elif part.tag in (_WORD + "br", _WORD + "cr"):
            out.append("\n")
    return "".join(out)


def _row_texts(row, above: list[str]) -> list[str]:
    """Cell texts of a table row by grid column: a spanning cell repeats, a vertically merged one copies ``above``."""
    texts: list[str] = []
    for cell in row.findall(_WORD + "tc"):
        props = cell.find(_WORD + "tcPr")
        span, merged = 1, False
        if props is not None:
            grid, vertical = props.find(_WORD + "gridSpan"), props.find(_WORD + "vMerge")
            span = int(grid.get(_WORD + "val", "1")) if grid is not None else 1
            merged = vertical is not None and vertical.get(_WORD + "val", "continue") == "continue"
        text = "\n".join(_run_text(p) for p in cell.findall(_WORD + "p"))
        for _ in range(span):
            texts.append(above[len(texts)] if merged and len(texts) < len(above) else text)
    return texts


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs, then per table row the non-blank cells joined by ``" | "``."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(_WORD + "body")
    parts = [text for text in (_run_text(p) for p in body.findall(_WORD + "p")) if text.strip()]
    for table in body.findall(_WORD + "tbl"):
        above: list[str] = []
        for row in table.findall(_WORD + "tr"):
            above = _row_texts(row, above)
            cells = [text.strip() for text in above if text.strip()]
            if cells:
                parts.append(" | ".join(cells))
    return "\n".join(parts)


def _docx_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, errors = [], []
        for content in batch.pop("content"):
            try:
                texts.append(docx_text(content))
                errors.append(None)
            except Exception as failure:  # any unreadable file becomes an empty text, its row is kept
                texts.append("")
                errors.append(type(failure).__name__)
        yield batch.assign(raw_text=texts, error=errors)


def read_docx(files: DataFrame) -> DataFrame:
    """``bundle, path, filename, raw_text, error`` of DOCX files given as ``bundle, path, filename, content``."""
    return small_batches(files).select("bundle", "path", "filename", "content").mapInPandas(
        _docx_texts, "bundle string, path string, filename string, raw_text string, error string")


# --- dispatch --------------------------------------------------------------------------------------------------------

def parse_files(files: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """Resume texts ``bundle, path, filename, raw_text, error`` of ``path, content`` rows, which may have a ``bundle``.

    Unsupported files are dropped. DOCX is read here; PDF, DOC and image texts come from ``extracted``
    (``path, raw_text`` and, for members of bundles, ``bundle``), where an extractor has put them. A file without text is kept with an empty one.
    """
    typed = supported_files(files)
    documents = read_docx(typed.filter(F.col("file_type") == "docx"))
    return documents.unionByName(_attach_texts(typed.filter(F.col("file_type") != "docx"), extracted))


def parse_folder(spark: SparkSession, folder: str, extracted: DataFrame | None = None) -> DataFrame:
    """``parse_files`` of a folder. Only DOCX content is read; of other files the path is enough."""
    documents = supported_files(scan_folder(spark, folder, fixed.FILE_TYPES["docx"]))
    rest = [ext for ext in SUPPORTED if ext not in fixed.FILE_TYPES["docx"]]
    others = supported_files(scan_folder(spark, folder, rest, content=False))
    return read_docx(documents).unionByName(_attach_texts(others, extracted))


def _attach_texts(typed: DataFrame, extracted: DataFrame | None) -> DataFrame:
    others = typed.select("bundle", "path", "filename")
    if extracted is not None:
        if "bundle" not in extracted.columns:
            extracted = extracted.withColumn("bundle", F.lit(None).cast("string"))
        # bundles may have members of the same path; of several texts for one file the last in order counts
        texts = extracted.groupBy(F.col("bundle").alias("_bundle"), F.col("path").alias("_path")).agg(
            F.max("raw_text").alias("raw_text"))
        same = F.col("bundle").eqNullSafe(F.col("_bundle")) & (F.col("path") == F.col("_path"))
        others = others.join(texts, same, "left")
    else:
        others = others.withColumn("raw_text", F.lit(None).cast("string"))
    return others.select(
        "bundle", "path", "filename", F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.when(F.col("raw_text").isNull(), F.lit("NoExtractor")).alias("error"))


def as_resumes(parsed: DataFrame, batch_id: Column) -> DataFrame:
    """Parsed files as resumes: numbered in path order and written once, so that numbers stay what they are.

    Numbers grow along the sorted partitions without any task seeing all rows; ``batch_id`` is a column of
    ``parsed``, for example the file's folder.
    """
    ordered = parsed.orderBy("path").select(
        batch_id.alias("batch_id"), F.monotonically_increasing_id().alias("resume_id"), "filename", "raw_text")
    return materialize(ordered.select(
        "batch_id", "resume_id", F.col("resume_id").alias("ordinal"), "filename", "raw_text"))
