"""Token counts of flat token files by a separator scan.

A flat file is nothing but token ids, two bytes each (four where the vocabulary needs them); every document ends with
the end-of-document id. There is no index, so the ends are searched: each block of a file is read by itself and
compared with the id in one vector operation. A document may begin many blocks before the one that holds its end;
what crosses blocks is the last end seen and the number of ends so far, which a prefix scan over the blocks carries on
in two levels, so a file that is a third of all data is not one task.

Files without tokens give no rows. Ids after the last end form an unterminated document. Empty documents (two ends in
a row) have no tokens and are counted.

Null and empty texts are documents without tokens; null and repeated ids and repeated rows are documents of their own.
A text of any length is one document, whose blocks are scanned apart. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm.common import file_system, publish, shared_folder, text_bytes, written
from winnow.llm.tokens import word_ids

BLOCK_TOKENS = 1 << 21
GROUP_BLOCKS = 1 << 10
FILE_DOCS = 200_000  # documents of a file, whose ids are one row


def token_width(largest_id: int) -> int:
    return 2 if largest_id < 1 << 16 else 4


def largest_id(tokenizer: str, end_id: int) -> int:
    """The largest id that a vocabulary file or the end can give."""
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, width: int, folder: str,
               file_tokens: int = 1 << 27, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write ``docs`` as flat token files into ``folder``. One row per file: ``path, doc_ids`` in file order.

    A file belongs to one task, has a name of its own and appears whole, so a task that runs again leaves at worst a
    file that no row names. Special tokens in texts are ordinary text: they cannot pass for an end.
    """
    if end_id >> 8 * width:
        raise ValueError(f"token id {end_id} does not fit {width} bytes")
    kind, end = f"<u{width}", np.array([end_id], f"<u{width}").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer, True)
        rest = iter(_documents(batches))
        doc = next(rest, None)
        while doc is not None:
            path, ids = f"{folder}/{uuid.uuid4().hex}.bin", []

            def fill(stream):
                nonlocal doc
                size = 0
                while doc is not None and size < file_tokens and len(ids) < file_docs:
                    tokens = np.frombuffer(words.of(doc[1]), "<u4")
                    if len(tokens) and int(tokens.max()) >> 8 * width:
                        raise ValueError(f"token id {tokens.max()} does not fit {width} bytes")
                    tokens = tokens.astype(kind)
                    stream.write(tokens.tobytes() + end)
                    size += len(tokens) + 1
                    ids.append(doc[0])
                    doc = next(rest, None)

            publish(path, fill)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([ids], pa.list_(pa.int64()))], ["path", "doc_ids"])
        words.clear()

    return docs.select("doc_id", text_bytes(F.col("text")).alias("text")).mapInArrow(
        write, "path string, doc_ids array<bigint>")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield doc_id, text.as_py()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the flat files in a folder; their content is not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
            .select("path", "length"))


def scan_blocks(files: DataFrame, end_id: int, width: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block: ``path, block, ends`` (positions in the file), ``stop`` (tokens up to the block's end)."""
    blocks = files.select("path", F.floor(F.col("length") / width).alias("tokens")).filter("tokens > 0").select(
        "path", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism,
                int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, tokens, block in zip(*(c.to_pylist() for c in batch.columns)):
                first = block * block_tokens
                count = min(block_tokens, tokens - first)
                system, inner = file_system(path)
                with system.open_input_file(inner) as file:
                    ids = np.frombuffer(file.read_at(count * width, first * width), f"<u{width}")
                ends = (first + np.flatnonzero(ids == end_id)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()),
                     pa.array([ends], pa.list_(pa.int64())), pa.array([first + count], pa.int64())],
                    ["path", "block", "ends", "stop"])

    return blocks.repartition(tasks, "path", "block").mapInArrow(
        scan, "path string, block bigint, ends array<bigint>, stop bigint")


def count_tokens(files: DataFrame, end_id: int, width: int, block_tokens: int = BLOCK_TOKENS,
                 group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """One row per document of the files: ``path, doc_no`` (from 0 in its file), ``start, n_tokens`` without the end,
    ``ended``."""
    blocks = written(scan_blocks(files, end_id, width, block_tokens))
    sums = blocks.select("path", "block", F.floor(F.col("block") / group_blocks).alias("grp"),
                         F.size("ends").cast("bigint").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    earlier = Window.partitionBy("path").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("path", "grp").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select(
        "path", "grp", F.sum("n").over(earlier).alias("n0"), F.max("last").over(earlier).alias("last0"))
    inside = Window.partitionBy("path", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sums.withColumn("n1", F.sum("n").over(inside)).withColumn("last1", F.max("last").over(inside))
        .join(groups, ["path", "grp"])
        .select("path", "block", (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("ends_before"),
                F.coalesce("last1", "last0", F.lit(-1)).alias("end_before")))
    stitched = blocks.join(before, ["path", "block"])
    bounds = F.concat(F.array("end_before"), "ends")
    ended = stitched.select("path", "ends_before", F.posexplode(F.arrays_zip(
        F.slice(bounds, F.lit(1), F.size("ends")).alias("a"), F.col("ends").alias("b"))).alias("k", "doc")).select(
        "path", (F.col("ends_before") + F.col("k")).alias("doc_no"), (F.col("doc.a") + 1).alias("start"),
        (F.col("doc.b") - F.col("doc.a") - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    last = stitched.groupBy("path").agg(
        F.max_by(F.struct((F.col("ends_before") + F.size("ends")).alias("doc_no"),
                          (F.coalesce(F.when(F.size("ends") > 0, F.element_at("ends", -1)), "end_before") + 1).alias("start"),
                          "stop"), "block").alias("z"))
    open_end = last.select("path", "z.doc_no", "z.start", (F.col("z.stop") - F.col("z.start")).alias("n_tokens"),
                           F.lit(False).alias("ended")).filter("n_tokens > 0")
    return ended.unionByName(open_end)


def count_documents(docs: DataFrame, tokenizer: str, end_id: int, width: int | None = None) -> DataFrame:
    """Write ``docs`` as flat files and count each document's tokens by the scan: ``doc_id, n_tokens`` and its place.
    Ids have as many bytes as the vocabulary's largest needs, unless ``width`` says otherwise.

    The order in which ids were written names the documents; the counts come from the files alone.
    """
    width = width or token_width(largest_id(tokenizer, end_id))
    folder = shared_folder(docs.sparkSession, "flat")
    order = written(write_flat(docs, tokenizer, end_id, width, folder))
    names = order.select("path", F.posexplode("doc_ids").alias("doc_no", "doc_id"))
    path = F.element_at(F.split("path", "/"), -1)
    # the reader may spell the folder differently from the writer
    counts = count_tokens(order.select("path", F.lit(None).cast("bigint").alias("length")).drop("length").join(
        list_files(docs.sparkSession, folder).select(path.alias("file"), "length"), path == F.col("file")).select(
        "path", "length"), end_id, width) if not order.isEmpty() else None
    if counts is None:
        return names.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"), path.alias("file"),
                            F.col("doc_no").cast("bigint"), F.lit(0).cast("bigint").alias("start"))
    return counts.join(names.withColumn("doc_no", F.col("doc_no").cast("bigint")), ["path", "doc_no"]).select(
        "doc_id", "n_tokens", path.alias("file"), "doc_no", "start")
