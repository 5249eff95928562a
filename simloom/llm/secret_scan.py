"""Secret scans: regex rules over a trigram inverted index.

Native: DataFrame functions only. Each rule's regex gives a Boolean query over
trigrams that any match must hold. The trigrams that the queries ask for are
indexed: one posting (trigram, row) for each row that has it, in a table whose
files are sorted by trigram; a frequent trigram is spread over many of them by
row. The queries intersect and unite postings, and only rows that come through
are verified with the regex itself. A rule without mandatory trigrams scans
every row.

Texts stay where they are read but for those of rows that may have come through:
a set of row hash slots, of bounded size, parts them from the rest beforehand.

Trigrams are taken from the lower-cased text, which can only add candidates.

Results for odd input: a null text is empty; rows with a null id are scanned
like others; equal rows get equal results; spans that start at the same place
are ordered by kind; a very long text is scanned whole, in time linear in its
length and nearly so in its matches; empty tables give no rows. Extra columns,
whatever their names, are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.line_dedup import ROW, column, row_key
from simloom.llm.shared import dropped, fresh_path, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its ``group`` has ``min_chars`` at least.

    ``verify`` is a pattern with the same counting matches and fewer failing ones.
    """

    kind: str
    pattern: str
    group: int
    min_chars: int
    verify: str | None = None


#: Kinds in the order that breaks ties between spans; the first three are the base.
RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20, r"(AKIA[A-Z0-9]{16,})"),
    Rule("hex", r"([0-9a-f]+)", 1, 24, r"([0-9a-f]{24,})"),
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
    Rule("slack", r"(xox[baprs]-[A-Za-z0-9-]+)", 1, 15),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+)", 1, 30),
    Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 27),
)
BASE_KINDS = ("assign", "access", "hex")

# --- Boolean trigram queries --------------------------------------------------

#: A query is True (all rows), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple

#: Sets of exact strings beyond this size are given up for their trigrams.
EXACT_LIMIT = 16


def trigram_query(pattern: str) -> Query:
    """What every match of the pattern must hold, over lower-cased text."""
    exact, query = _info(_parser.parse(pattern))
    return _simple(("and", (query, _of_strings(exact))))


def _of_strings(strings: frozenset[str] | None) -> Query:
    if strings is None or any(len(s) < 3 for s in strings):
        return True
    return ("or", tuple(("and", tuple(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def _simple(q: Query) -> Query:
    if not isinstance(q, tuple):
        return q
    kind, parts = q
    flat: list[Query] = []
    for p in map(_simple, parts):
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    if kind == "or":
        if any(p is True for p in flat):
            return True
    else:
        flat = [p for p in flat if p is not True]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _info(parsed) -> tuple[frozenset[str] | None, Query]:
    """The exact strings a pattern can match (None: not a small set) and a further query."""
    run, query, whole = frozenset([""]), True, True
    for op, arg in parsed:
        exact, more = _one(op, arg)
        query = ("and", (query, more))
        joined = None if exact is None else frozenset(a + b for a in run for b in exact)
        if joined is not None and len(joined) <= EXACT_LIMIT:
            run = joined
            continue
        # The run of exact strings ends here; what it held stays mandatory.
        query, whole = ("and", (query, _of_strings(run))), False
        run = exact or frozenset([""])
    return (run, query) if whole else (None, ("and", (query, _of_strings(run))))


def _one(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), True
    if op is sre.IN:
        chars: set[str] = set()
        for o, a in arg:
            if o is sre.LITERAL:
                chars.add(chr(a).lower())
            elif o is sre.RANGE and a[1] - a[0] < EXACT_LIMIT:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None, True
        return (frozenset(chars), True) if len(chars) <= EXACT_LIMIT else (None, True)
    if op is sre.SUBPATTERN:
        return _info(arg[3])
    if op is sre.BRANCH:
        parts = [_info(p) for p in arg[1]]
        exacts = [e for e, _ in parts]
        if all(e is not None for e in exacts) and len(union := frozenset().union(*exacts)) <= EXACT_LIMIT:
            return union, ("or", tuple(q for _, q in parts))
        return None, ("or", tuple(("and", (q, _of_strings(e))) for e, q in parts))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, sub = arg
        e, q = _info(sub)
        if (low, high) == (0, 1) and e is not None:
            return e | {""}, True
        if low == 0:
            return None, True
        return None, ("and", (q, _of_strings(e)))
    return None, True


def trigrams_of(q: Query) -> list[str]:
    if isinstance(q, tuple):
        return sorted({t for p in q[1] for t in trigrams_of(p)})
    return [] if isinstance(q, bool) else [q]


def matches_query(q: Query, has) -> Column:
    """The query as a condition; ``has`` gives a trigram's column."""
    if isinstance(q, bool):
        return F.lit(q)
    if isinstance(q, str):
        return has(q)
    parts = [matches_query(p, has) for p in q[1]]
    return reduce((lambda a, b: a & b) if q[0] == "and" else (lambda a, b: a | b), parts)


# --- index, search, verification ---------------------------------------------

#: Row slots that part possible candidates from the rest: at most so many numbers are broadcast.
SLOTS = 1 << 18
#: Matches of one text whose places are summed in one run.
RUN = 128
SPANS = "array<struct<start:int,ord:int,end:int>>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).alias("doc_id"), text.alias("text"), *row_key(column(id_col), text))
    return rows.withColumn("slot", F.pmod("t1", F.lit(SLOTS)).cast("int"))


def build_index(docs: DataFrame, trigrams: list[str], path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, row) of these trigrams over whole texts, as a table at ``path``."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col).withColumn("low", F.lower("text"))
    # A null stands for "no posting"; array_compact drops it before rows are made.
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    postings = rows.select(F.explode(held).alias("trigram"), *ROW, "slot")
    postings.repartition("trigram", F.pmod(F.xxhash64("doc", "t1"), F.lit(1024))).sortWithinPartitions("trigram", "doc").write.parquet(path)
    return spark.read.schema(postings.schema).parquet(path)


def search_index(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows that come through any query: row, slot and one flag ``c_<kind>`` per rule."""
    queries = [(r, q) for r in rules if (q := trigram_query(r.pattern)) is not True]
    needed = sorted({t for _, q in queries for t in trigrams_of(q)})
    bit = {t: i for i, t in enumerate(needed)}
    number = F.element_at(F.create_map(*(F.lit(x) for pair in bit.items() for x in pair)), F.col("trigram"))
    none = F.lit(0).cast("long")
    words = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, bit % 64)")).otherwise(none)).alias(f"w{w}") for w in range(-(-len(needed) // 64))]
    rows = index.where(F.col("trigram").isin(needed)).withColumn("bit", number).groupBy(*ROW, "slot").agg(*words)
    has = lambda t: F.getbit(F.col(f"w{bit[t] // 64}"), F.lit(bit[t] % 64)) == 1
    flags = [matches_query(q, has).alias(f"c_{r.kind}") for r, q in queries]
    return rows.select(*ROW, "slot", *flags).where(" OR ".join(f"c_{r.kind}" for r, _ in queries))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end): code points, leftmost non-overlapping matches.

    The text is split at the matches; the lengths of the pieces and of the
    matches add up to the places. They are summed in runs, and the runs after.
    """
    pattern = rule.verify or rule.pattern
    size = lambda s: F.char_length(s)
    between = F.transform(F.split(text, pattern, -1), size)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), size)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), size)
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("between"), whole.alias("whole"), counted.alias("counted"))
    none = F.array().cast(SPANS)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), F.lit(order).alias("ord"), b.cast("int").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["between"]
        end = begin + x["whole"]
        out = F.when(x["counted"] >= rule.min_chars, F.concat(acc["out"], F.array(span(begin, end)))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def run(first: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.slice(zipped, first, F.lit(RUN)), start, step)

    runs = F.transform(F.sequence(F.lit(1), F.size(whole), F.lit(RUN)), run)

    def join(acc: Column, r: Column) -> Column:
        moved = F.transform(r["out"], lambda s: span(s["start"] + acc["at"], s["end"] + acc["at"]))
        out = F.when(F.size(moved) > 0, F.concat(acc["out"], F.array(moved))).otherwise(acc["out"])
        return F.struct((acc["at"] + r["at"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.when(text.rlike(pattern), F.flatten(F.aggregate(runs, start, join)["out"])).otherwise(none)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per document with ``spans``: array of (kind, start, end), in order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    needed = sorted({t for q in queries.values() for t in trigrams_of(q)})
    keyed = _keyed(docs, id_col, text_col)
    none = F.array().cast(SPANS)
    kinds = F.array(*(F.lit(r.kind) for r in rules))

    def verified(rows: DataFrame, flagged: bool) -> DataFrame:
        found = []
        for i, r in enumerate(rules):
            if queries[r.kind] is True:
                found.append(rule_spans(F.col("text"), r, i))
            elif flagged:
                found.append(F.when(F.col(f"c_{r.kind}"), rule_spans(F.col("text"), r, i)).otherwise(none))
        named = lambda s: F.struct(F.element_at(kinds, s["ord"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        return rows.select("doc_id", F.transform(F.array_sort(F.concat(none, *found)), named).alias("spans"))

    if not needed:
        return verified(keyed, False)
    path = fresh_path(docs.sparkSession, "trigrams")
    through = written(search_index(build_index(docs, needed, path, id_col, text_col), rules), "secret-candidates")
    dropped(docs.sparkSession, path)
    slots = F.broadcast(through.select("slot").distinct())  # at most SLOTS numbers
    rest = verified(keyed.join(slots, "slot", "left_anti"), False)
    some = keyed.join(slots, "slot", "left_semi").join(through.drop("slot"), ROW, "left")
    return rest.unionByName(verified(some, True))


def secret_report(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, all spans as text."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan_secrets(docs, **columns).select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans")
    )
