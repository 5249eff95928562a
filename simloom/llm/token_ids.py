"""Token ids in files: frequency-ranked, byte-aligned, with separate control bytes.

Texts are encoded once; the ids are counted over the whole corpus and replaced
by their rank, so that frequent ids take one byte. Files hold blocks: a document
directory, control bytes (two bits an id: its length less one) and data bytes.
A reader finds all ids of a block with numpy: a table gives the lengths that
each control byte stands for, their running sum the places of the data bytes.

Documents lie in ascending order of id over all files (null ids first), each
file holding one range. Files are written under fresh names and named by a
manifest, so a repeated attempt leaves no trace.

Results for odd input: a null text is empty and has the end id only; rows with
the same id follow each other, ordered by what they hold; an empty table gives
no files and no rows. Extra columns are left alone.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.ragged import ENCODE_BYTES, UnitTable
from simloom.llm.shared import binary_column, fresh_path, open_fs, slices, text_buffer

END_ID = 2
MAGIC = b"SLTOKID1"
BLOCK_IDS = 1 << 18

#: Bytes that the remembered units of a worker may take.
TABLE_BYTES = 200 << 20

#: For files that lower-case and drop white space, whatever its kind; others are not folded.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 13]] = 32

_encoders: dict[str, TextEncoder] = {}


class TextEncoder:
    """Encodes texts with a word-end BPE file of the tokenizers library.

    No token crosses white space, so each distinct unit between white space goes
    through the library once and texts are joined from the results.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = self.library.get_added_tokens_decoder()
        self.mark = next(((i, t.content) for i, t in special.items() if t.special and not t.normalized), None)
        self.specials = [t.content for t in special.values()]
        self.units = UnitTable(self._encode_units, FOLD if self._folds() else None, TABLE_BYTES)

    def _folds(self) -> bool:
        """Whether this file gives bytes that ``FOLD`` makes one the same ids."""
        letters = [chr(c) for c in range(65, 91)]
        probes = [*letters, "".join(letters), *(f"a{b}b" for b in "\t\n\r"), "a \t\r\nB"]
        return self._apart(probes) == self._apart([bytes(FOLD[list(p.encode())]).decode() for p in probes])

    def _apart(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> list[list[int]]:
        """Many units in one call, with a special token between them.

        Units that hold a special token themselves are encoded one by one.
        """
        if self.mark is None:
            return self._apart(units)
        odd = [i for i, u in enumerate(units) if any(s in u for s in self.specials)]
        plain = units
        if odd:
            skip = set(odd)
            plain = [u for i, u in enumerate(units) if i not in skip]
        out: list[list[int]] = []
        for at in range(0, len(plain), 1024):
            some = plain[at : at + 1024]
            ids = np.array(self._apart([self.mark[1].join(some)])[0], np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0]).tolist()
            ids = ids.tolist()
            out += [ids[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(ids)])]
        for i, x in zip(odd, self._apart([units[i] for i in odd])):  # in rising order, so places agree
            out.insert(i, x)
        return out

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column; null is empty."""
        return self.units.encode_texts(column)


def encoder(path: str) -> TextEncoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


# --- the coding -----------------------------------------------------------------

#: Lengths that a control byte stands for, lowest two bits first.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    sizes = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = sizes - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- files ------------------------------------------------------------------------


class FileWriter:
    """Blocks one after another, then a JSON footer, its length and the magic."""

    def __init__(self, stream):
        self.stream, self.blocks, self.at = stream, [], 0
        self.docs: list[int | None] = []
        self.values: list[np.ndarray] = []
        self.held = self.total_docs = self.total_ids = 0

    def add(self, doc_id: int | None, ranks: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.values.append(ranks)
        self.held += len(ranks)
        if self.held >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        counts = np.array([len(v) for v in self.values], "<u4")
        valid = np.array([d is not None for d in self.docs], np.uint8)
        keys = np.array([d or 0 for d in self.docs], "<i8")
        control, data = encode_values(np.concatenate(self.values))
        parts = [valid.tobytes(), keys.tobytes(), counts.tobytes(), control, data]
        self.blocks.append([self.at, len(self.docs), self.held, *map(len, parts)])
        for p in parts:
            self.stream.write(p)
            self.at += len(p)
        self.total_docs += len(self.docs)
        self.total_ids += self.held
        self.docs, self.values, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        footer = json.dumps(self.blocks).encode()
        self.stream.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.stream.close()


def read_file(system, path: str, ids_by_rank: np.ndarray) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Block by block: document ids and their token ids."""
    with system.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 16)
        tail = f.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token id file")
        length = int.from_bytes(tail[:8], "little")
        f.seek(size - 16 - length)
        for at, n_docs, n_ids, *sizes in json.loads(f.read(length)):
            f.seek(at)
            valid, keys, counts, control, data = (f.read(s) for s in sizes)
            ids = ids_by_rank[decode_values(control, data, n_ids)]
            ends = np.cumsum(np.frombuffer(counts, "<u4"), dtype=np.int64)
            docs = [int(k) if v else None for k, v in zip(np.frombuffer(keys, "<i8"), np.frombuffer(valid, np.uint8))]
            yield docs, np.split(ids, ends[:-1])


# --- the operator -------------------------------------------------------------------


def id_type(size: int) -> str:
    """The narrowest type for ids of a vocabulary of this size."""
    return "<u2" if size <= 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u4") -> DataFrame:
    """A row per document: id and its token ids as little-endian integers."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        for part in slices(batches, 1, ENCODE_BYTES):
            rows = [np.concatenate([x, end]).astype(dtype).tobytes() for x in enc.encode(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), binary_column(rows)], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def vocabulary_size(tokenizer: str) -> int:
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1


def frequency_ranks(encoded: DataFrame, dtype: str) -> np.ndarray:
    """Token ids by falling count over all documents; at most one for each id."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, 1, 8 << 20):
            more = np.bincount(text_buffer(batch.column(1))[0].view(dtype))
            if len(more) > len(total):
                more[: len(total)] += total
                total = more
            else:
                total[: len(more)] += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = encoded.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, **options) -> list[dict]:
    """Writes the corpus and returns the manifest: a row per file, in order.

    The encoded corpus is kept as a table between counting and writing.
    """
    spark = docs.sparkSession
    table = fresh_path(spark, "token-ids")
    dtype = id_type(max(vocabulary_size(tokenizer), options.get("end_id", END_ID) + 1))
    encode_documents(docs, tokenizer, dtype=dtype, **options).write.option("compression", "zstd").parquet(table)
    encoded = spark.read.schema("doc_id long, ids binary").parquet(table)
    ids_by_rank = frequency_ranks(encoded, dtype)
    system, root = open_fs(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/ids-by-rank.bin") as f:
        f.write(ids_by_rank.astype("<u4").tobytes())
    size = int(ids_by_rank.max()) + 1 if len(ids_by_rank) else 1
    rank_of = np.zeros(size, np.uint32)
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)  # one entry for each id of the vocabulary at most

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, f"part-{uuid.uuid4().hex}.tok"
        fs_, top = open_fs(folder)
        for part in slices(batches, 1):
            for key, x in zip(part.column(0).to_pylist(), part.column(1)):
                if out is None:
                    out = FileWriter(fs_.open_output_stream(f"{top}/{name}", buffer_size=1 << 20))
                out.add(key, ranks.value[np.frombuffer(x.as_buffer(), dtype)])
        if out is not None:
            out.close()
            row = [[TaskContext.get().partitionId()], [name], [out.total_docs], [out.total_ids]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1]), *(pa.array(c, pa.int64()) for c in row[2:])], names=["part", "name", "docs", "ids"])

    sorted_rows = (
        encoded.withColumn("tie", F.xxhash64("ids"))
        .repartitionByRange(F.asc_nulls_first("doc_id"), "tie")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
        .select("doc_id", "ids")
    )
    files = sorted_rows.mapInArrow(write, "part long, name string, docs long, ids long").collect()  # a row per file
    manifest, start = [], 0
    for f in sorted(files):
        manifest.append(f.asDict() | {"start": start})
        start += f.ids
    with system.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


READ_SCHEMA = "doc_id long, start long, ids binary"


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a written corpus: id, place of the first token, ids."""
    system, root = open_fs(folder)
    with system.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    if not manifest:
        return spark.createDataFrame([], READ_SCHEMA)
    files = spark.sparkContext.broadcast([(m["name"], m["start"]) for m in manifest])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs_, top = open_fs(folder)
        with fs_.open_input_stream(f"{top}/ids-by-rank.bin") as f:
            ids_by_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, start = files.value[k]
                for docs, ids in read_file(fs_, f"{top}/{name}", ids_by_rank):
                    sizes = np.array([len(x) for x in ids], np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    rows = [x.astype("<u4").tobytes() for x in ids]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), binary_column(rows)], names=["doc_id", "start", "ids"])

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(read, READ_SCHEMA)


def token_report(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the corpus to the shared folder, reads it back and describes each document."""
    folder = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer, **options)
    return read_token_files(docs.sparkSession, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
