"""BPE encoding and decoding by prefix-sharing trie traversal.

Texts are cut into units at white space and those into words; the new distinct
words of a batch form a trie, held as their sorted list: walking
it in order is a depth-first traversal, and a word starts from the states of the
prefix that it shares with the word before. The state of a prefix is the last
token of its encoding. A longer prefix ends in a token t if t is a suffix of it
and t may follow the last token of what is left; exactly one t does. So the
encoding of each shared prefix is found once, and a word's tokens are read off
backwards from its states.

That two tokens may follow each other means that the merges, run on their joined
bytes, give back those two. Answers and units are remembered within a bound and
forgotten at the end of a task; only the vocabulary stays with a worker.

Encoding and decoding run in one Arrow stage: ids go to the decoder as arrays.

Results for odd input: a null text is empty and has no ids; a null id comes back
null; equal texts get equal ids; an empty table gives no rows. Extra columns are
left alone, whatever their names. A very long text is encoded whole, as a slice of
its own. Special tokens in a text become their ids, as in the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.ragged import UnitTable, take
from simloom.llm.shared import binary_column, map_arrow, release_memory, slices

#: Pairs of tokens whose compatibility a task remembers, about 100 bytes each.
PAIR_LIMIT = 200_000
#: Bytes of text that are encoded at once.
SLICE = 2 << 20

#: Letters whose class every Unicode version agrees on.
LETTERS = "A-Za-zÀ-ÖØ-öø-ƺƼ-ƿ"
#: Texts with other characters are split by the library.
UNUSUAL = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}]")
PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from U+0100 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens as bytes, merges by rank, special tokens, from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.id_of = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        everything = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.size = max(everything) + 1
        #: Two ids as one number, to rank and merged id as one number.
        self.merges: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b = to_bytes(left), to_bytes(right)
            self.merges[self.id_of[a] * self.size + self.id_of[b]] = rank * self.size + self.id_of[a + b]
        self.bytes_of = [everything.get(i, b"") for i in range(self.size)]
        self.longest = max(map(len, self.id_of))
        self.byte_ids = [self.id_of.get(bytes([b])) for b in range(256)]

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a piece by its definition: always the first merge of least rank."""
        merges, size = self.merges, self.size
        none = size * (len(merges) + 1)
        ids = [self.byte_ids[b] for b in data]
        best = [merges.get(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while best:
            least = min(best)
            if least == none:
                break
            i = best.index(least)
            ids[i : i + 2] = [least % size]
            del best[i]
            if i:
                best[i - 1] = merges.get(ids[i - 1] * size + ids[i], none)
            if i < len(best):
                best[i] = merges.get(ids[i] * size + ids[i + 1], none)
        return ids


class TrieEncoder:
    """Encodes sets of distinct words over a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def _follows(self, last: int, token: int) -> bool:
        key = last * self.v.size + token
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIR_LIMIT:
                self.pairs.clear()
            ok = self.pairs[key] = self.v.merge(self.v.bytes_of[last] + self.v.bytes_of[token]) == [last, token]
        return ok

    def _stands(self, token: int) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.v.merge(self.v.bytes_of[token]) == [token]
        return ok

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of the words, which must be sorted.

        ``states[i]`` is the last token of the encoding of the first i bytes.
        """
        token_of, pair_known, size, longest = self.v.id_of.get, self.pairs.get, self.v.size, self.v.longest
        bytes_of = self.v.bytes_of
        out: list[list[int]] = []
        states: list[int] = [-1]
        before = b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(end - longest if end > longest else 0, end):
                    token = token_of(word[begin:end])
                    if token is None:
                        continue
                    if begin:
                        fits = pair_known(states[begin] * size + token)
                        if fits is None:
                            fits = self._follows(states[begin], token)
                    else:
                        fits = self._stands(token)
                    if fits:
                        states.append(token)
                        break
                else:
                    raise ValueError(f"no encoding of {word[:end]!r}")
            ids, end = [], len(word)
            while end:
                token = states[end]
                ids.append(token)
                end -= len(bytes_of[token])
            out.append(ids[::-1])
            before = word
        return out


class Codec:
    """Encodes and decodes whole texts; one per worker and file."""

    def __init__(self, path: str):
        self.path = path
        self.v = Vocabulary(path)
        self.trie = TrieEncoder(self.v)
        self.units = UnitTable(self._encode_units)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) or r"(?!)")
        sizes = np.array([len(b) for b in self.v.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.v.bytes_of), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self._library = None

    def _pieces(self, text: str) -> list[str]:
        """The words of a unit without special tokens."""
        if not UNUSUAL.search(text):
            return PIECE.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _encode_units(self, units: list[str]) -> list[list[int]]:
        split: list[list[str | int]] = []
        for unit in units:
            parts: list[str | int] = []
            at = 0
            if self.v.special:
                for m in self.specials.finditer(unit):
                    parts += [*self._pieces(unit[at : m.start()]), self.v.special[m[0]]]
                    at = m.end()
            split.append(parts + self._pieces(unit[at:]) if at < len(unit) else parts)
        raw = {w: w.encode() for parts in split for w in parts if isinstance(w, str)}
        words = sorted(raw, key=raw.__getitem__)
        ids = dict(zip(words, self.trie.encode_sorted([raw[w] for w in words])))
        return [[t for w in parts for t in ((w,) if isinstance(w, int) else ids[w])] for parts in split]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column; null is empty."""
        return self.units.encode_texts(column)

    def forget(self) -> None:
        """Drops what was remembered of the texts seen."""
        self.units.clear()
        self.trie.pairs.clear()
        release_memory()

    def decode(self, ids: np.ndarray) -> str:
        """Ids outside the vocabulary stand for nothing."""
        known = ids[ids < self.v.size].astype(np.int64)
        return take(self.flat, self.offsets, known).tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """A row per document: id and token ids as little-endian 32-bit integers.

    With ``decoded`` also the text that the decoder gives back for these ids.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        try:
            for part in slices(batches, 1, SLICE):
                ids = c.encode(part.column(1))
                columns = [part.column(0), binary_column([x.astype("<u4").tobytes() for x in ids])]
                if decoded:
                    columns.append(pa.array(map(c.decode, ids), pa.string(), size=len(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
        finally:
            c.forget()

    return map_arrow(_columns(docs, id_col, text_col), encode, "doc_id long, ids binary" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text beside the ids."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for part in slices(batches, 1):
            texts = [c.decode(np.frombuffer(x.as_buffer() or b"", "<u4")) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), decode, "doc_id long, ids binary, decoded string")


def bpe_report(docs: DataFrame, tokenizer: str, **columns: str) -> DataFrame:
    """Digests of ids and decoded text per document."""
    both = encode_documents(docs, tokenizer, decoded=True, **columns)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
