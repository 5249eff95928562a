"""Media columns, token id files and BPE: exact round trips and the library itself."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from simloom.llm import bpe, media, token_ids
from simloom.llm.shared import BATCH_BYTES, fresh_path, map_arrow, open_fs

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = [
    (5, "Hello, WORLD!  It's 12:30\n\tend "),
    (1, None),
    (2, ""),
    (3, "naïve Straße 中文 🙂 é   x"),
    (None, "<|endoftext|>a <|startoftext|>"),
    (4, "word " * 5000),
    (5, "Hello, WORLD!  It's 12:30\n\tend "),
    (-7, "trailing   "),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in media.media_round_trip(frame(spark, TEXTS)).collect()}
    assert len(rows) == len({d for d, _ in TEXTS})
    for d, t in TEXTS:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert (r.media_bytes, r.media_sha256) == (len(m := media.encode_png(raw)), hashlib.sha256(m).hexdigest())
        size = len(payload) // 64
        sums = [sum(payload[i * size : (i + 1) * size]) for i in range(64)]
        bits = "".join(str(int(64 * s > sum(payload))) for s in sums)
        assert r.feature == f"{len(payload) // 192}:{sum(payload) * 1000 // len(payload)}:{int(bits, 2):016x}"
    assert media.media_round_trip(frame(spark, [])).count() == 0


def test_media_writes_add_up(spark):
    path = fresh_path(spark, "media")
    ids = lambda: sorted(r.doc_id for r in media.read_media(spark, path).collect())
    part = lambda *rows: spark.createDataFrame([(i, f"text {i}") for i in rows], "doc_id long, text string")
    media.write_media(part(1, 2), path)
    media.write_media(part(3), path)
    assert ids() == [1, 2, 3]
    media.write_media(part(4), path, mode="overwrite")
    assert ids() == [4]
    with pytest.raises(FileNotFoundError):
        media.ArchiveReader({"path": fresh_path(spark, "none")}).partitions()


def test_media_ranges_and_retries(spark, monkeypatch):
    path = fresh_path(spark, "media")
    docs = spark.createDataFrame([(i, "text %d " % i * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    media.write_media(docs, path, archive_bytes="4000")
    reader = media.ArchiveReader({"path": path, "range_bytes": "1500", "wait_s": "0"})
    parts = reader.partitions()
    assert len({p.name for p in parts}) > 1 and len(parts) > len({p.name for p in parts})
    read = lambda r: sorted(k for p in parts for b in r.read(p) for k in b.column(0).to_pylist())
    assert read(reader) == list(range(40))
    failures = {}
    real = media.zlib.crc32

    class Flaky:
        def __getattr__(self, name):
            return getattr(zlib, name)

        def crc32(self, data, *a):
            failures[data] = failures.get(data, 0) + 1
            return real(data, *a) + (failures[data] == 1)

    monkeypatch.setattr(media, "zlib", Flaky())
    assert read(reader) == list(range(40))
    monkeypatch.undo()
    system, root = open_fs(path)
    name = f"{root}/{parts[0].name}"
    with system.open_input_stream(name) as f:
        raw = bytearray(f.read())
    member = media.archive_members(system, name)[0]
    raw[member.header_offset + 60] ^= 1
    with system.open_output_stream(name) as f:
        f.write(bytes(raw))
    with pytest.raises(OSError):
        read(media.ArchiveReader({"path": path, "range_bytes": "1500", "wait_s": "0", "retries": "1"}))
    kept = media.ArchiveReader({"path": path, "range_bytes": "1500", "wait_s": "0", "retries": "1", "on_error": "keep"})
    errors = [e for p in parts for b in kept.read(p) for e in b.column(2).to_pylist() if e]
    assert len(errors) == 1 and len(read(kept)) == 40


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=500))
def test_png(data):
    samples, n = media.decode_png(media.encode_png(data))
    assert n == len(data) and samples.tobytes()[:n] == data and len(samples) % 192 == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_coding(values):
    v = np.array(values, np.uint32)
    assert token_ids.decode_values(*token_ids.encode_values(v), len(v)).tolist() == values


def test_token_files(spark):
    found = sorted(token_ids.token_report(frame(spark, TEXTS), WORD).collect(), key=lambda r: r.start)
    t = library(WORD)
    start = 0
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in found] == [d for d, _ in order]
    for r, (_, text) in zip(found, order):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_ids.token_report(frame(spark, []), WORD).count() == 0


def test_bpe(spark):
    t = library(BYTE)
    found = {r.doc_id: r for r in bpe.bpe_report(frame(spark, TEXTS), BYTE).collect()}
    for d, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert (found[d].n_tokens, found[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert found[d].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.bpe_report(frame(spark, []), BYTE).count() == 0


ODD = st.text(st.sampled_from("abcXYZ019 \n\t'!.,|<>_é́ſıŉİ中  \u0085​\x0b\x0c\x00") | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=8))
def test_encoders_agree_with_the_library(texts):
    column = pa.array(texts, pa.string())
    for path, mine in ((BYTE, bpe.codec(BYTE).encode), (WORD, token_ids.encoder(WORD).encode)):
        theirs = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in mine(column)] == theirs


def test_trie_against_merges():
    v = bpe.codec(BYTE).v
    words = sorted({w.encode() for w in "thanking thanked thanks theatre thé ' 123 unthankfulness aaaaaaa  \n\n".split(" ")} - {b""})
    assert bpe.TrieEncoder(v).encode_sorted(words) == [v.merge(w) for w in words]


def test_batches_are_bound_by_bytes(spark):
    """The bound holds where the session names none, and a session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    texts = spark.range(0, 9000, 1, 1).selectExpr("id", "repeat('x', 2000) AS text")
    try:
        spark.conf.unset(key)
        found = map_arrow(texts, sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in found) == 9000
        assert max(r["bytes"] for r in found) < BATCH_BYTES + 10_000
        spark.conf.set(key, "1m")
        found = map_arrow(texts, sizes, "rows long, bytes long").collect()
        assert max(r["bytes"] for r in found) < (1 << 20) + 10_000
        assert map_arrow(texts.limit(0), sizes, "rows long, bytes long").count() == 0
    finally:
        spark.conf.unset(key)
        if own is not None:
            spark.conf.set(key, own)
