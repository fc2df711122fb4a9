"""Token counts of flat token files: vectorised separator scan, boundaries stitched by a prefix scan.

A token file is nothing but ids, one after another, each document ended by one separator id; there is
no index.  The scan cuts every file into blocks of ``BLOCK_TOKENS`` whatever the documents do, finds the
separators of each block with one vectorised comparison, and a prefix scan over one row per block
(separators so far, place of the last one) tells each block which document it starts in and where that
began.  A document that spans many blocks is the difference of two of these places.

``write_tokens`` makes such files from texts.  A task holds one block, or one batch of texts; a huge file
or document is spread over many tasks.  Written files count only if the written list names them.

Defined cases: null or empty text is a document of 0 tokens; ids behind the last separator are a last,
unterminated document; an empty file has no documents; strings of special tokens in a text are ordinary
text, so a text cannot forge a separator; repeated rows are documents of their own; an empty table has no documents;
other columns, whatever their names, are not read.  Words are cached by 124-bit hashes under random keys of the worker.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haze.llm._bytes import row_blocks
from haze.llm._tokens import BLOCK as TOKEN_BLOCK
from haze.llm._tokens import encoder
from haze.llm.archives import _file_system
from haze.session import ship_package, written

BLOCK_TOKENS = 4 << 20
ROLL_TOKENS = 256 << 20
KINDS = {2: "<u2", 4: "<u4"}


def write_tokens(docs: DataFrame, root: str, tokenizer: str, separator: int, text: str = "text",
                 doc_id: str = "doc_id", width: int = 2) -> DataFrame:
    """Flat files of ``width``-byte ids under ``root``: path, ordinal and doc_id of every document."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.asarray([separator], KINDS[width]).tobytes()

    def land(batches: Iterator[pa.RecordBatch]):
        out = path = None
        size = ordinal = 0
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in row_blocks([len(t) for t in texts], TOKEN_BLOCK):
                if out is None:
                    path, size, ordinal = f"{root}/{uuid.uuid4().hex}.tokens", 0, 0
                    system, where = _file_system(path)
                    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(where, compression=None)
                for ids in encoder(tokenizer, False).encode(texts[a:b]):
                    raw = np.frombuffer(ids, "<u4").astype(KINDS[width]).tobytes() + end
                    out.write(raw)
                    size += len(raw) // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * (b - a)), pa.array(np.arange(ordinal, ordinal + b - a)), batch.column("doc_id")[a:b]],
                    ["path", "ordinal", "doc_id"])
                ordinal += b - a
                if size >= ROLL_TOKENS:
                    out.close()
                    out = None
        if out is not None:
            out.close()

    return written(rows.mapInArrow(land, f"path string, ordinal long, doc_id {kind}"), "token-docs")


def _sized(files: DataFrame, width: int) -> DataFrame:
    def look(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            sizes = []
            for path in paths:
                system, where = _file_system(path)
                sizes.append(system.get_file_info(where).size // width)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "tokens"])

    return files.select("path").distinct().mapInArrow(look, "path string, tokens long")


def count_tokens(files: DataFrame, separator: int, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """path, ordinal, start, n_tokens and terminated of every document in the ``files`` (path)."""
    spark = files.sparkSession
    ship_package(spark)
    sized = written(_sized(files, width), "token-sizes")
    blocks = written(sized.where(F.col("tokens") > 0).select("path", "tokens", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block).cast("long"))).alias("at")), "token-blocks")

    def scan(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("path", "tokens", "at")]
            for path, tokens, at in zip(*cols):
                system, where = _file_system(path)
                with system.open_input_file(where) as f:
                    raw = f.read_at(min(block, tokens - at) * width, at * width)
                ends = np.flatnonzero(np.frombuffer(raw, KINDS[width]) == separator) + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([tokens]), pa.array([at]), pa.array([ends], pa.list_(pa.int64()))],
                    ["path", "tokens", "at", "ends"])

    n = blocks.count()
    parts = min(n, max(3 * spark.sparkContext.defaultParallelism, n // 16)) or 1
    found = written(blocks.repartitionByRange(parts, "path", "at").mapInArrow(
        scan, "path string, tokens long, at long, ends array<bigint>"), "token-ends")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("path", "tokens", "at", F.size("ends").cast("long").alias("n"),
                           F.try_element_at("ends", F.lit(-1)).alias("last"))
    stitched = summary.select("path", "tokens", "at", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                              F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open"), "last")
    carry = stitched.select(F.col("path").alias("p"), F.col("at").alias("a"), "first", "open")
    ended = found.join(carry, (F.col("path") == F.col("p")) & (F.col("at") == F.col("a"))).select(
        "path", "first", "open", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.coalesce(F.get("ends", F.col("i") - 1), F.col("open")) + 1
    done = ended.select("path", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"),
                        (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = stitched.groupBy("path").agg(F.max("tokens").alias("tokens"), F.sum("n").alias("ordinal"),
                                        (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    rest = tail.where(F.col("start") < F.col("tokens")).select(
        "path", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return done.unionByName(rest)


def counts_through_files(docs: DataFrame, root: str, tokenizer: str, separator: int, text: str = "text",
                         doc_id: str = "doc_id", width: int = 2) -> DataFrame:
    """doc_id and n_tokens of every document, counted from flat files and nothing else."""
    order = write_tokens(docs, root, tokenizer, separator, text, doc_id, width)
    found = count_tokens(order.select("path").distinct(), separator, width).select(
        F.col("path").alias("p"), F.col("ordinal").alias("o"), "n_tokens")
    return order.join(found, (F.col("path") == F.col("p")) & (F.col("ordinal") == F.col("o"))).select("doc_id", "n_tokens")
