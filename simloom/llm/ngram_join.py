"""N-gram Jaccard join: candidates by prefixes under several global orders.

A text's set is its distinct 5-word shingles. For a similarity of t, two sets
that link must share a token among the first n - ceil(t n) + 1 of each, under
any order of all tokens. Three orders are used; all put shingles of crowded
sketch slots last and differ in a hash. A pair must pass under each of them, and
must share as many prefix tokens as the overlap needs; what passes the
intersected filters is verified on the whole sets. The result is exact.

The steps, none of which emits all pairs of a group or gathers it in a task:

1. Each document gives a class number of its set (equal sets are one class from
   here on) and counts for the sketch, both over the whole corpus.
2. Prefix tokens go to buckets of bounded size as packed arrays; copies within a
   batch send one. A bucket pairs the members of short lists. Long lists come
   out as rows; crowded tokens go there straight away, in a pass of their own.
3. Members of long lists are linked to two leaders each, of those whose prefixes
   lie most in long lists, if they meet them under every order; verified and
   merged, for a few rounds.
4. Then only pairs across components are left. Their long lists are filtered by a
   prefix once more: two sets that share no short list under an order must share
   as many long ones as the overlap needs, so with lists ordered by length each
   looks into its first c - need + 1 of c lists, where need depends on the size
   of the partner. A set that lies in fewer lists looks into none.
5. Pairs of both kinds that pass under every order are verified, and components
   of all links taken.

Results for odd input: a null or empty text, or one without words, has no
shingles, is linked with nothing and is its own component; rows with a null id
take part and can be linked, but a component's id is the least id that is not
null; repeated rows come back each; a very long text is one set, hashed in steps;
pairs exactly at the threshold link; an empty table gives no rows. Extra columns,
whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.components import components
from simloom.llm.line_dedup import column
from simloom.llm.shared import binary_column, bit_field, dropped, field_bits, in_field, map_arrow, release_memory, slices, text_buffer, written
from simloom.llm.words import NOT_BLANK, hashed_words, mix, row_grams

SHINGLE = 5
#: Similarity in percent from which two sets link.
PERCENT = 80
ORDERS = 3
#: Slots of the sketch of shingle counts; its size bounds what the driver holds.
SKETCH_BITS = 17
#: Members up to which a list is paired within its bucket.
SHORT_LIST = 32
BUCKET_POSTINGS = 500_000
LEADER_ROUNDS = 2
#: Size classes in an octave by which long lists are parted.
BANDS = 24
#: Pairs that a bucket makes in one numpy step.
PAIR_STEP = 250_000
#: Bytes of text that one step cuts into shingles.
SLICE = 1 << 20
#: Marks a set two of whose tokens agree in all that a bucket keeps of them.
TWINS = 1 << 31

_U = np.uint64
_SALTS = [_U(0x8CB92BA72F3D8DD7), _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xC13FA9A902A6328F)]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = hashed_words(*text_buffer(column), NOT_BLANK)
    for h in row_grams(words, first, SHINGLE):
        yield np.unique(h)


def class_number(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def least_overlap(a, b):
    """Shingles that two sets of these sizes must share to link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def least_shared(a, b):
    """Prefix tokens that must be shared: the rest of one set cannot make up for less."""
    rest = np.maximum(-(-PERCENT * a // 100), -(-PERCENT * b // 100)) - 1
    return np.maximum(1, least_overlap(a, b) - rest)


def slot_of(h: np.ndarray, size: int) -> np.ndarray:
    """The sketch slot of each shingle; ``size`` is a power of two."""
    return (mix(h ^ _SALTS[3]) >> _U(65 - size.bit_length())).astype(np.int64)


# --- 1: classes and sketch --------------------------------------------------------


SURVEY = "doc_id long, cls long, n long, slot long, count long"


def _survey(size: int):
    """Batches of (id, text) to a row per document, and one per sketch slot and task."""

    def survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        names = [c.split()[0] for c in SURVEY.split(", ")]
        for part in slices(batches, 1, SLICE):
            sets = list(shingle_sets(part.column(1)))
            counts += np.bincount(slot_of(np.concatenate([np.zeros(0, np.uint64), *sets]), size), minlength=size)
            cls = pa.array([class_number(s) if len(s) else None for s in sets], pa.int64())
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), cls, pa.array(list(map(len, sets)), pa.int64()), none, none], names=names)
        slots = np.flatnonzero(counts)
        none = pa.nulls(len(slots), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(slots), pa.array(counts[slots])], names=names)
        release_memory()

    return survey


def crowding(sketch: DataFrame, size: int) -> np.ndarray:
    """A level per slot: 0 for usual ones, more the further its count lies above the mean."""
    total = sketch.agg(F.sum("count")).first()[0] or 0
    mean = total / size
    usual = int(mean + 6 * mean**0.5 + 32)
    crowded = sketch.groupBy("slot").agg(F.sum("count").alias("count")).where(F.col("count") > usual).collect()
    levels = np.zeros(size, np.uint8)
    for r in crowded:
        levels[r.slot] = min(63, max(1, int(r["count"] - usual).bit_length()))
    return levels


# --- 2: prefixes, buckets, lists ----------------------------------------------------


def order_key(h: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """Sorts shingles by crowding and then by the order's own hash."""
    return (level.astype(np.uint64) << _U(58)) | (mix(h ^ _SALTS[order]) >> _U(6))


def _prefix_tokens(part: pa.RecordBatch, levels: np.ndarray, crowded: bool):
    """Classes and sizes of the sets in a slice (each once), and per order the tokens
    of their prefixes, crowded or not, with the place of their set."""
    tokens: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
    cls, sizes, seen = [], [], set()
    for s in shingle_sets(part.column(1)):
        if not len(s):
            continue
        c = class_number(s)
        if c in seen:
            continue
        seen.add(c)
        level, p = levels[slot_of(s, len(levels))], prefix_size(len(s))
        if crowded and not level.any():
            continue
        cls.append(c)
        sizes.append(len(s))
        for k in range(ORDERS):
            key = order_key(s, level, k)
            first = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
            tokens[k].append(s[first[(level[first] > 0) == crowded]])
    none = [np.zeros(0, np.uint64)]
    found = [(mix(np.concatenate(none + t)), np.repeat(np.arange(len(t)), [len(x) for x in t])) for t in tokens]
    return np.array(cls, np.int64), np.array(sizes, np.uint32), found


def _prefixes(levels: np.ndarray, buckets: int):
    """Batches of (id, text) to packed postings: one row per slice, order and bucket."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            cls, sizes, found = _prefix_tokens(part, levels, False)
            rows: list[tuple] = []
            for k, (token, doc) in enumerate(found):
                bucket = ((token >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                at = np.argsort(bucket, kind="stable")
                borders = np.flatnonzero(np.diff(bucket[at], prepend=-1))
                for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(at)]):
                    run = at[a:b]
                    docs, index = np.unique(doc[run], return_inverse=True)
                    short = token[run].astype(np.uint32)
                    own = np.sort((index.astype(np.uint64) << _U(32)) | short)
                    marked = sizes[docs]
                    marked[(own[1:][own[1:] == own[:-1]] >> _U(32)).astype(np.int64)] |= np.uint32(TWINS)
                    index = index.astype(np.uint32 if len(docs) > 65535 else np.uint16)
                    rows.append((int(bucket[run[0]]) * ORDERS + k, short.tobytes(), index.tobytes(), cls[docs].tobytes(), marked.tobytes()))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *map(binary_column, c[1:])], names=["bucket", "tokens", "index", "cls", "sizes"])

    return pack


def _crowded_rows(levels: np.ndarray):
    """Batches of (id, text) to a row per crowded prefix token, in a pass of its own.

    They are never paired in a bucket.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            cls, sizes, found = _prefix_tokens(part, levels, True)
            for k, (token, doc) in enumerate(found):
                if len(token):
                    yield _listed(1, k, token.view(np.int64), cls[doc], sizes[doc])

    return rows


PACKED = "bucket long, tokens binary, index binary, cls binary, sizes binary"
#: kind 0: a pair (a, b) and its shared tokens; kind 1: a list's token and a member (a) with its size (b).
LISTED = "kind int, ord int, a long, b long, n long"


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cls = np.frombuffer(row["cls"], np.int64)
    index = np.frombuffer(row["index"], np.uint16 if len(cls) <= 65535 else np.uint32)
    token = np.frombuffer(row["tokens"], np.uint32).astype(np.uint64)
    return token, cls[index], np.frombuffer(row["sizes"], np.uint32)[index].astype(np.int64)


def _listed(kind: int, order: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    fixed = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, order, np.int32))]
    return pa.RecordBatch.from_arrays([*fixed, *(pa.array(c.astype(np.int64)) for c in columns)], names=["kind", "ord", "a", "b", "n"])


def _matcher(short_list: int):
    """A function of one bucket: pairs of lists up to ``short_list``, rows of longer ones."""

    def match(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        order, number = bucket % ORDERS, bucket // ORDERS
        parts = [_unpack(row) for row in table.to_pylist()]
        token, cls, size = (np.concatenate(x) for x in zip(*parts))
        at = np.lexsort((cls, token))
        token, cls, size = token[at], cls[at], size[at]
        new = np.ones(len(token), bool)  # copies in other batches sent the same
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, size = token[new], cls[new], size[new]
        start = np.flatnonzero(np.diff(token, prepend=token[0] + _U(1)))
        length = np.diff(start, append=len(token))
        out: list[pa.RecordBatch] = []
        names, member = np.unique(cls, return_inverse=True)
        twins = np.zeros(len(names), bool)
        twins[member] = size >= TWINS
        size &= TWINS - 1
        codes: list[np.ndarray] = []  # a pair as one number: first member times members plus second
        held = 0

        def flush() -> None:
            nonlocal codes, held
            if codes:
                both, count = np.unique(np.concatenate(codes), return_counts=True)
                x, y = both // len(names), both % len(names)
                count += np.where(twins[x] & twins[y], TWINS, 0)  # shared tokens may have counted as one: let pass
                out.append(_listed(0, order, names[x], names[y], count))
            codes, held = [], 0

        for m in range(2, short_list + 1):
            lists = start[length == m]
            if not len(lists):
                continue
            x, y = np.triu_indices(m, 1)
            step = max(1, PAIR_STEP // len(x))
            for k in range(0, len(lists), step):
                i = (lists[k : k + step, None] + x).ravel()
                j = (lists[k : k + step, None] + y).ravel()
                ok = 100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j])
                codes.append(member[i[ok]] * len(names) + member[j[ok]])  # a list is sorted by class, so first < second
                held += int(ok.sum())
                if held > 8 * PAIR_STEP:
                    flush()
        flush()
        long = np.repeat(length > short_list, length)
        if long.any():
            named = (token[long] | (_U(number + 1) << _U(32))).view(np.int64)
            out.append(_listed(1, order, named, cls[long], size[long]))
        release_memory()
        return pa.Table.from_batches(out or [_listed(0, 0, *[np.zeros(0, np.int64)] * 3)])

    return match


# --- verification ---------------------------------------------------------------------


def _id_slot(bits: int, ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(1 << bits))


def id_field(ids: DataFrame) -> np.ndarray | None:
    """A bit field of the ``doc_id`` that are not null; None for too many of them."""
    bits = field_bits(ids.count())
    return None if bits is None else bit_field(ids.where("doc_id IS NOT NULL").select(_id_slot(bits, F.col("doc_id"))), bits)


def _maybe_in(spark, field: np.ndarray, ids: Column) -> Column:
    """Whether an id may be one of the field's; never false for one that is."""
    shared = spark.sparkContext.broadcast(field)

    @F.arrow_udf("boolean")
    def held(slot: pa.Array) -> pa.Array:
        return pa.array(in_field(shared.value, slot.to_numpy()))

    return held(_id_slot((8 * len(field)).bit_length() - 1, ids))


def _sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, shingles) of the classes that ``members`` (cls, doc_id) names.

    A bit field made from their ids spares most other documents the work; it may
    let some through, never keep one out. Too many ids for it are joined.
    """
    field = id_field(members)
    if field is not None:
        bits = (8 * len(field)).bit_length() - 1
        held = docs.select("text", F.when(F.col("doc_id").isNotNull(), _id_slot(bits, F.col("doc_id"))).alias("slot"))
        field = docs.sparkSession.sparkContext.broadcast(field)
    else:
        named = docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
        held = docs.where("doc_id IS NULL").unionByName(named).select("text", F.lit(None).cast("long").alias("slot"))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(1).fill_null(-1).to_numpy()
            wanted = slot < 0
            if field is not None:
                wanted |= in_field(field.value, np.maximum(slot, 0))
            for part in slices([batch.filter(pa.array(wanted))], 0, SLICE):
                found = {class_number(x): x.tobytes() for x in shingle_sets(part.column(0)) if len(x)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), binary_column(list(found.values()))], names=["cls", "shingles"])
        release_memory()

    # A class's row may come from any of its documents; one is enough.
    found = map_arrow(held, sets, "cls long, shingles binary")
    return found.join(members.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= PERCENT * (len(both) - shared)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["u", "v"])
    release_memory()


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, as a written table of edges (u, v)."""
    pairs = written(pairs.select("a", "b").distinct(), "candidates")
    nodes = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    sets = written(_sets_of(docs, firsts.join(nodes, "cls", "left_semi")), "sets")
    one = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y")
    links = written(map_arrow(both, _verify, "u long, v long"), "links")
    dropped(docs.sparkSession, pairs, sets)
    return links


# --- 3 and 4: long lists ---------------------------------------------------------------------

#: Bounds of the sizes that may link, and what prefixes must share, as SQL over two sizes.
_FITS = f"100 * least({{a}}, {{b}}) >= {PERCENT} * greatest({{a}}, {{b}})"
_NEED = f"greatest(1, -floor(-{PERCENT} * ({{a}} + {{b}}) / {100 + PERCENT}) + floor(-{PERCENT} * greatest({{a}}, {{b}}) / 100) + 1)"


def ranked_lists(lists: DataFrame) -> DataFrame:
    """``lists`` (ord, token, cls, size) of two members or more, with each list's rank among
    its member's lists (shortest first) and their number."""
    length = lists.groupBy("ord", "token").agg(F.count(F.lit(1)).alias("len")).where("len > 1")
    own = Window.partitionBy("ord", "cls")
    ranked = lists.join(length, ["ord", "token"]).withColumn("rank", F.row_number().over(own.orderBy("len", "token")))
    return ranked.withColumn("lists", F.count(F.lit(1)).over(own)).drop("len")


def _with_roots(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("root", F.col("cls"))
    return lists.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def leader_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """For each member of another component than a list's leaders, its commonest leaders, if it
    meets them under every order.

    A list has two leaders: the member whose prefix lies most in long lists, as one with
    few tokens of its own does, and one by chance of those not far behind it.
    """
    prefix = F.col("size") + F.floor(-PERCENT * F.col("size") / 100) + 1
    share = F.col("lists") / prefix
    by = {"best": -share, "some": -F.ceil(4 * share)}
    rank = lambda own, seed: F.min(F.struct(own.alias("own"), F.xxhash64("root", F.lit(seed)).alias("h"), "cls", "root", "size"))
    lead = lists.groupBy("ord", "token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), *(rank(own, turn).alias(name) for name, own in by.items()))
    led = lead.where("r0 <> r1").select("ord", "token", F.explode(F.array(*by)).alias("lead"))
    near = lists.join(led, ["ord", "token"]).where("root <> lead.root").where(_FITS.format(a="size", b="lead.size"))
    met = near.groupBy("cls", F.col("lead.cls").alias("leader"), "ord").agg(F.count(F.lit(1)).alias("n"))
    counted = met.groupBy("cls", "leader").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("orders")).where(F.col("orders") == ORDERS)
    first = F.max_by("leader", F.struct("n", "leader"))
    least = F.max_by("leader", F.struct(F.xxhash64("leader", F.lit(turn)), "leader"))
    best = counted.groupBy("cls").agg(F.array_distinct(F.array(first, least)).alias("leaders")).select("cls", F.explode("leaders").alias("leader"))
    return best.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))


def cross_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of different components that pass the prefix filter over long lists, a row per list.

    Each has a member outside the list's largest component, so a list of one
    component costs nothing, whatever its size. That member meets only the size
    classes for which its rank allows a partner.
    """
    sized = lists.groupBy("ord", "token", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sized.groupBy("ord", "token").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    live = lists.join(largest, ["ord", "token"]).withColumn("band", F.expr(f"cast(floor({BANDS} * log2(size)) as int)"))
    few = live.where("root <> top").selectExpr("ord", "token", "cls as x", "root as rx", "size as nx", "lists - rank + 1 as kx")
    # The ends of a size class bound what a partner in it must share; 1 less for rounding.
    least, most = f"greatest(ceil({PERCENT} * nx / 100), floor(power(2, band / {BANDS})))", f"least(floor(100 * nx / {PERCENT}), ceil(power(2, (band + 1) / {BANDS})))"
    reach = F.expr(f"sequence(cast(floor({BANDS} * log2({PERCENT} * nx / 100)) as int), cast(floor({BANDS} * log2(100 * nx / {PERCENT})) as int))")
    few = few.withColumn("band", F.explode(reach)).where(f"least({_NEED.format(a='nx', b=least)}, {_NEED.format(a='nx', b=most)}) - 1 <= kx")
    need = _NEED.format(a="nx", b="size")
    return few.join(live, ["ord", "token", "band"]).where(
        f"rx <> root AND (root = top OR x < cls) AND {_FITS.format(a='nx', b='size')} AND kx >= {need} AND lists - rank + 1 >= {need}"
    ).select(F.lit(0).alias("kind"), "ord", F.least("x", "cls").alias("a"), F.greatest("x", "cls").alias("b"), F.lit(0).cast("long").alias("n"))


# --- the operator ------------------------------------------------------------------------------


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_list: int = SHORT_LIST, sketch_bits: int = SKETCH_BITS, bucket_postings: int = BUCKET_POSTINGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, cls, n), links between classes (u, v), roots (node, root)."""
    spark, texts = docs.sparkSession, _texts(docs, id_col, text_col)
    slots = 1 << sketch_bits
    survey = written(map_arrow(texts, _survey(slots), SURVEY), "survey")
    members = survey.where("n IS NOT NULL").select("doc_id", "cls", "n")
    firsts = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    sketch = survey.where("slot IS NOT NULL").select("slot", "count")
    levels = crowding(sketch, slots)
    shingles = sketch.agg(F.sum("count")).first()[0] or 0
    buckets = max(1, shingles * (100 - PERCENT) // 100 // bucket_postings + 1)
    matched = map_arrow(texts, _prefixes(levels, buckets), PACKED).groupBy("bucket").applyInArrow(_matcher(short_list), LISTED)
    if levels.any():
        matched = matched.unionByName(map_arrow(texts, _crowded_rows(levels), LISTED))
    listed = written(matched, "lists")
    lists = listed.where("kind = 1").select("ord", F.col("a").alias("token"), F.col("b").alias("cls"), F.col("n").alias("size")).distinct()
    ranked = written(ranked_lists(lists), "long-lists")
    links: DataFrame | None = None
    roots: DataFrame | None = None
    if not ranked.isEmpty():
        for turn in range(LEADER_ROUNDS):
            more = verified(leader_pairs(_with_roots(ranked, roots), turn), texts, firsts)
            if more.isEmpty():
                break
            links = more if links is None else links.unionByName(more)
            roots = components(links)
    pairs = listed.where("kind = 0").unionByName(cross_pairs(_with_roots(ranked, roots)))
    orders = range(ORDERS)
    by_order = [f(F.when(F.col("ord") == k, F.col("n"))).alias(f"{c}{k}") for c, f in (("s", F.sum), ("met", F.count)) for k in orders]
    shared = pairs.groupBy("a", "b").agg(*by_order).where(" AND ".join(f"met{k} > 0" for k in orders))
    # What two sets share are short lists, counted above, and at most as many long ones as each lies in.
    long = [F.max(F.when(F.col("ord") == k, F.col("lists"))).alias(f"l{k}") for k in orders]
    size = firsts.select("cls", "n").join(ranked.groupBy("cls").agg(*long), "cls", "left").na.fill(0, [f"l{k}" for k in orders])
    for side in ("a", "b"):
        shared = shared.join(size.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}{side}") for c in size.columns[1:])), side)
    need = _NEED.format(a="na", b="nb")
    shared = shared.where(" AND ".join(f"s{k} + least(l{k}a, l{k}b) >= {need}" for k in orders))
    if roots is not None:
        for side in ("a", "b"):
            shared = shared.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
        shared = shared.where("coalesce(ra, a) <> coalesce(rb, b)")
    last = verified(shared, texts, firsts)
    dropped(spark, listed, ranked)
    links = last if links is None else links.unionByName(last)
    return members, links, components(links)


def join_report(docs: DataFrame, **options) -> DataFrame:
    """A row per document: size of its set and the least id of its component."""
    members, _, roots = similar_classes(docs, **options)
    rooted = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that bear the least id of their component, as they were.

    Rows without an id stay. Only rows whose id hits a bit field of the ids to be
    dropped are shuffled; the others cannot be among them.
    """
    report = written(join_report(docs, id_col=id_col, text_col=text_col), "components").where("doc_id IS NOT NULL")
    kept = report.where("doc_id = component_id").select("doc_id")
    gone = written(report.where("doc_id <> component_id").select("doc_id").join(kept, "doc_id", "left_anti").distinct(), "gone")
    key, name = column(id_col).cast("long"), f"gone_{uuid.uuid4().hex}"
    field = id_field(gone)
    without = lambda df: df.join(gone.withColumnRenamed("doc_id", name), key == F.col(name), "left_anti")
    if field is None:
        return without(docs)
    maybe = _maybe_in(docs.sparkSession, field, key)
    return docs.where(~maybe).unionByName(without(docs.where(maybe)))
