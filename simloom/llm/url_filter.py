"""URL filters: host and path rules plus glob rules in one bit-parallel automaton.

Every rule becomes a glob over the canonical URL ``.host`` + ``path``. The globs
are packed one after another into 64-bit words, one bit for each literal
character, and a batch of URLs is run through a Shift-And automaton in step:
one numpy pass for each character position moves the states of all rules of all
URLs at once.

Results for odd input: a null URL or one without ``://`` has an empty host and
path, fits no rule and gets the default verdict; repeated rows are judged
alike; empty tables give no rows. Columns of the input other than the id and
the URL are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import map_arrow

#: (verdict, rule); a rule is ``host/path``.
CONTRACT_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Globs for URLs that no rule fits: one hit blocks. ``*`` is any run of characters.
DEFAULT_GLOBS = ("*spam*", "*casino*", "*/ads/*", "*.xxx/*")

URL_SLICE = 4096


@dataclass(frozen=True)
class Automaton:
    """Shift-And masks of ``n`` globs over bytes, in ``words`` 64-bit words."""

    masks: np.ndarray  # (256, words): bits whose literal is this byte
    first: np.ndarray  # (words,): first literal of each glob that must begin at the start
    inject: np.ndarray  # (words,): first literal of each glob that begins with a star
    hold: np.ndarray  # (words,): bits that a following star keeps alive
    hold_host: np.ndarray  # (words,): same, but a ``/`` ends it
    inject_host: np.ndarray  # (words,): injected until the first ``/``
    accept_any: np.ndarray  # (n, 2): word and bit of last literal, glob ends with a star
    open_end: np.ndarray  # (n,): bool

    @property
    def words(self) -> int:
        return len(self.first)


def compile_globs(globs: Sequence[str]) -> Automaton:
    """Packs globs into masks.

    ``*`` is any run of bytes, ``\\x00`` any run without ``/`` (hosts only).
    Each glob needs at least one literal; runs of stars collapse.
    """
    pieces: list[tuple[list[int], list[str], str]] = []
    for g in globs:
        literals: list[int] = []
        after: list[str] = []
        lead = ""
        for b in g.encode():
            ch = {0x2A: "*", 0: "h"}.get(b, "")
            if not ch:
                literals.append(b)
                after.append("")
            elif literals:
                after[-1] = "*" if "*" in (ch, after[-1]) else ch
            else:
                lead = "*" if "*" in (ch, lead) else ch
        if not literals:
            raise ValueError(f"a glob needs a literal character: {g!r}")
        pieces.append((literals, after, lead))
    total = sum(len(p[0]) for p in pieces)
    words = (total + 63) // 64 or 1
    zero = lambda: np.zeros(words, np.uint64)
    masks = np.zeros((256, words), np.uint64)
    first, inject, hold, hold_host, inject_host = zero(), zero(), zero(), zero(), zero()
    accept = np.zeros((len(pieces), 2), np.int64)
    open_end = np.zeros(len(pieces), bool)
    at = 0
    for k, (literals, after, lead) in enumerate(pieces):
        for i, b in enumerate(literals):
            w, bit = divmod(at, 64)
            one = np.uint64(1 << bit)
            masks[b, w] |= one
            if i == 0:
                {"": first, "*": inject, "h": inject_host}[lead][w] |= one
            if after[i] == "*":
                hold[w] |= one
            elif after[i] == "h":
                hold_host[w] |= one
            at += 1
        accept[k] = divmod(at - 1, 64)
        open_end[k] = after[-1] == "*"
    return Automaton(masks, first, inject, hold, hold_host, inject_host, accept, open_end)


def run_automaton(a: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which globs fit which strings: a (strings, globs) array of bool."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    longest_first = np.argsort(-lengths, kind="stable")
    start, lengths = offsets[:-1][longest_first], lengths[longest_first]
    # A literal's bit must not flow on into the next glob's first literal.
    starts = a.first | a.inject | a.inject_host
    state = np.zeros((n, a.words), np.uint64)
    in_host = np.ones(n, bool)
    one, top = np.uint64(1), np.uint64(63)
    for i in range(int(lengths[0]) if n else 0):
        live = int(np.searchsorted(-lengths, -i, side="left"))  # strings longer than i
        s = state[:live]
        ch = data[start[:live] + i]
        moved = s << one
        if a.words > 1:
            moved[:, 1:] |= s[:, :-1] >> top
        moved &= ~starts
        moved |= a.inject
        if i == 0:
            moved |= a.first
        host = in_host[:live] & (ch != 0x2F)
        moved |= np.where(in_host[:live, None], a.inject_host, np.uint64(0))
        s_new = moved & a.masks[ch]
        s_new |= s & a.hold
        s_new |= np.where(host[:, None], s & a.hold_host, np.uint64(0))
        in_host[:live] = host
        # A held bit stands for "its literal was seen and the star goes on".
        state[:live] = s_new
    out = np.zeros((n, len(a.open_end)), bool)
    for k, (w, bit) in enumerate(a.accept_any):
        out[:, k] = (state[:, w] >> np.uint64(bit)) & one
    back = np.empty_like(out)
    back[longest_first] = out
    return back


def rule_glob(rule: str) -> str:
    """A rule fits its host and all subdomains where the path starts with its path."""
    host, slash, path = rule.partition("/")
    return f"\x00.{host}{slash}{path}*"


def host_column(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = CONTRACT_RULES,
    default_globs: Sequence[str] = DEFAULT_GLOBS,
) -> DataFrame:
    """One row per page: id, host, path, rule (or null), verdict.

    Of the rules that fit, the longest wins; of equally long ones, ``block``.
    Where none fits, the verdict is ``block`` if a default glob fits and
    ``allow`` otherwise. No shuffle: every URL is judged where it is read.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    plain = [("." if g[0] not in "*." else "") + g for g in default_globs]
    automaton = compile_globs([rule_glob(r) for _, r in ranked] + plain)
    url = F.col(url_col)
    parts = pages.select(
        F.col(id_col).alias("page_id"), host_column(url).alias("host"), path_column(url).alias("path")
    )
    id_type = parts.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        names = np.array([r for _, r in ranked] + [None], object)
        verdicts = np.array([v for v, _ in ranked] + [None], object)
        for batch in batches:
            for at in range(0, batch.num_rows, URL_SLICE):
                part = batch.slice(at, URL_SLICE)
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                strings = [f".{h or ''}{p or ''}".encode() if h or p else b"" for h, p in zip(hosts, paths)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
                fits = run_automaton(automaton, np.frombuffer(b"".join(strings), np.uint8), offsets)
                ruled = fits[:, : len(ranked)]
                which = np.where(ruled.any(1), ruled.argmax(1), len(ranked)) if ranked else np.zeros(len(fits), int)
                blocked = fits[:, len(ranked) :].any(1)
                verdict = [v or ("block" if b else "allow") for v, b in zip(verdicts[which], blocked)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(names[which], pa.string()), pa.array(verdict, pa.string())],
                    names=["page_id", "host", "path", "rule", "verdict"],
                )

    return map_arrow(parts, judge, f"page_id {id_type}, host string, path string, rule string, verdict string")
