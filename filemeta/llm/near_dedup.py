"""Near duplicates: MinHash with banding, signature verification, full-set confirmation and connected components.

1. Each text becomes its set of hashed word shingles (64 bits). Texts with equal sets form a class, and only a
   class's first row, by id and a hash of the text, goes on, so copies cost one row. A class is known by a hash of its set.
2. HASHES universal hash minima are cut in bands of as many rows as keep the chance to miss a pair at the threshold
   under MISS. Classes that share a band's key are candidates.
3. Rounds of stars: in each bucket that still holds several components, members are paired with one pivot, at most
   one new pair for each class and round; a pair is checked by signature, then confirmed on the full sets; links join components.
   A hot bucket of near copies falls into one component this way without its pairs being made.
4. What stays unresolved is compared whole, in blocks of BLOCK members of a bucket against another: first by
   signature alone, in numpy, which leaves the members that have a likely partner in another component; only these
   get their full sets, and are compared on them; a pair of blocks gives only the links that join components.

Every pair that shares a band is thus either linked by a path of confirmed links or compared; none is capped away.

Defined results: a null or empty text, or one without words, has no shingles (0) and is linked with nothing; one
with fewer words than a shingle has the whole sequence as its one shingle; rows with the same id and text are one
document, kept or not together; rows that share an id but differ in text are documents of their own; a null doc_id counts as the smallest id and is returned as null; an empty table gives an empty table; only the id and
text columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

HASHES, MISS = 180, 1e-6
#: Standard errors of the signature's estimate that a pair may lie under the threshold.
ERRORS = 5
ROUNDS = 3
#: Members of a hot bucket that are compared with as many others in one task.
BLOCK = 1000
NULL_ID = -(1 << 63)
#: Bytes of text whose words are hashed together.
TEXT_BLOCK = 8 << 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def band_rows(percent: int) -> int:
    """Rows of a band: the most with which a pair at the threshold is missed with a chance of at most MISS."""
    t = percent / 100
    return max([r for r in range(1, 21) if (1 - t**r) ** (HASHES // r) <= MISS], default=1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C[0]
    x = (x ^ (x >> np.uint64(29))) * _C[1]
    return x ^ (x >> np.uint64(32))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Distinct hashed shingles of each text, ascending. Words are runs of bytes other than blank and \\x09-\\x0D; A-Z
    count as a-z. Distinct words of a block of texts are hashed once, shingles are mixed for all texts together."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BLOCK, side="right")) - at)
        yield from _shingle_block(column.slice(at, n), size)
        at += n


def _shingle_block(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    bounds = np.asarray(lists.offsets, np.int64)
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(there)])[bounds]
    known = words.filter(pa.array(there)).dictionary_encode()
    distinct = known.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    h = hashed[known.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64)
    whole = _rolled(h, size)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= size:
            yield np.unique(whole[lo : hi - size + 1])
        else:
            yield _rolled(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words."""
    n = max(0, len(h) - size + 1)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mix(total * _C[2] + h[k : k + n])
    return total


def shingles(text: str | None, size: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), size))


_RNG = np.random.default_rng(20240601)
_A = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES minima of universal hashes of a non-empty set."""
    x = (found >> np.uint64(32)).astype(np.uint32)[None, :]
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 512):
        np.minimum(low, (_A * x[:, at : at + 512] + _B).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of each row of signatures."""
    n = low.shape[1] // rows
    part = low[:, : n * rows].reshape(len(low), n, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64) + np.uint64(1), (len(low), n))
    for k in range(rows):
        key = _mix(key * _C[2] + part[:, :, k])
    return key.view(np.int64)


def least_equal(percent: int) -> int:
    """Equal bytes of two signatures from which a pair is confirmed on full sets."""
    t = percent / 100
    return int((t - ERRORS * (t * (1 - t) / HASHES) ** 0.5) * HASHES)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    same = np.intersect1d(a, b, assume_unique=True).size
    return 100 * same >= percent * (small + large - same)


def sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, set_key, sig (a byte of each minimum) and bands of each text; nulls where the set is
    empty."""
    rows = band_rows(percent)
    schema = "doc_id long, mark long, n_shingles long, set_key binary, sig binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n, keys, lows = [], [], []
                for found in shingle_sets(b.column("text"), size):
                    n.append(len(found))
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    if len(found):
                        lows.append(signature(found))
                low = np.stack(lows) if lows else np.zeros((0, HASHES), np.uint32)
                short = (low & np.uint32(255)).astype(np.uint8)
                place = np.cumsum([k is not None for k in keys]) - 1
                mine = pa.array([None if k is None else int(i) for k, i in zip(keys, place)], pa.int32())
                every = band_keys(low, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * every.shape[1]), pa.array(every.reshape(-1)))
                sigs = pa.array([x.tobytes() for x in short], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), sigs.take(mine), lists.take(mine)], names=["doc_id", "mark", "n_shingles", "set_key", "sig", "bands"])

    return docs.mapInArrow(run, schema)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """rep and set of texts, as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.tobytes() for x in shingle_sets(b.column("text"), size)]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(found, pa.binary())], names=["rep", "items"])

    return docs.mapInArrow(run, "rep long, items binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Which of pairs(a, b) are links: by signature, then on full sets. Both joins can split a hot id."""
    least = least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[np.frombuffer(v.as_buffer(), t) for v in b.column(c)] for c, t in (("sig_a", np.uint8), ("sig_b", np.uint8), ("items_a", np.uint64), ("items_b", np.uint64))]
            ok = [int((sa == sb).sum()) >= least and linked(x, y, percent) for sa, sb, x, y in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("items").alias(f"items_{side}")), side)
    return pairs.mapInArrow(run, "a long, b long, ok boolean")


def _merged(spark, comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps(rep, comp) after links(u, v) between components."""
    cc = connected_components(spark, links).select(F.col("node").alias("comp"), "component")
    return common.stored(spark, comps.join(cc, "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp")), "comps")


def _likely(rep: np.ndarray, comp: np.ndarray, block: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of the members of one pair of blocks, each of the lower block with those of the other, each pair once, that are
    of another component and by size and signature may be linked with it."""
    low, high = int(block.min()), int(block.max())
    others = np.flatnonzero(block == high)
    for x in np.flatnonzero(block == low).tolist():
        some = others[rep[others] > rep[x]] if low == high else others
        some = some[(100 * np.minimum(n[x], n[some]) >= percent * np.maximum(n[x], n[some])) & (comp[some] != comp[x])]
        if len(some):
            yield x, some[np.count_nonzero(sig[some] == sig[x], axis=1) >= least]


def _members(rows: list[tuple]) -> list[np.ndarray]:
    """Of rows (rep, comp, block, n, sig, ...): rep, comp, block, n, signatures."""
    sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
    return [*(np.array([r[k] for r in rows], np.int64) for k in range(4)), sig]


def _survivors(rows: list[tuple], percent: int, least: int) -> list[tuple[int, int, int]]:
    """(rep, comp, block) of the members that have a likely partner."""
    seen = np.zeros(len(rows), bool)
    for x, some in _likely(*_members(rows), percent, least):
        seen[some] = True
        seen[x] |= len(some) > 0
    return [rows[k][:3] for k in np.flatnonzero(seen).tolist()]


def _compare(rows: list[tuple], percent: int, least: int) -> list[tuple[int, int]]:
    """Links (comp, comp) that join components, of rows (rep, comp, block, n, sig, items)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, some in _likely(*_members(rows), percent, least):
        for y in some.tolist():
            u, v = find(rows[x][1]), find(rows[y][1])
            if u != v and linked(np.frombuffer(rows[x][5], np.uint64), np.frombuffer(rows[y][5], np.uint64), percent):
                root[max(u, v)] = min(u, v)
                out.append((rows[x][1], rows[y][1]))
    return out


def _by_block_pair(rest: DataFrame, parts: int, columns: list[str], schema: str, work) -> DataFrame:
    """Rows of rest are dealt and sorted by (key, i, j), a pair of blocks, and stream by; work gets a list of the columns'
    rows of each pair, which are unique by rep, and gives rows of long columns, behind (key, i, j) if the schema has them."""
    names = [x.split()[0] for x in schema.split(", ")]
    keyed = names[0] == "key"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, {}, []

        def shut() -> None:
            if len(rows) > 1:
                out.extend((*now, *x) if keyed else x for x in work(list(rows.values())))

        for b in batches:
            for at in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", *columns))):
                if at[:3] != now:
                    shut()
                    now, rows = at[:3], {}
                rows[at[3]] = at[3:]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(names))], names=names)
            out.clear()
        shut()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(names))], names=names)

    return rest.select("key", "i", "j", *columns).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def compare_blocks(rest: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (u, v) between components, of rest(key, i, j, rep, comp, block); sets has rep, sig, items and n_shingles.
    Full sets go only to members that a signature leaves."""
    spark, least = rest.sparkSession, least_equal(percent)
    known = ["rep", "comp", "block", "n_shingles", "sig"]
    near = _by_block_pair(rest.join(sets.drop("items"), "rep"), parts, known, "key long, i long, j long, rep long, comp long, block long", lambda rows: _survivors(rows, percent, least))
    near = common.stored(spark, near, "likely")
    return _by_block_pair(near.join(sets, "rep"), parts, [*known, "items"], "u long, v long", lambda rows: _compare(rows, percent, least))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; of a component, the rows of one id and text are kept."""
    return near_groups(docs, size, percent, doc_id, text).drop("mark")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """near_duplicates() with mark, the text's xxhash64: doc_id and mark are a row's key."""
    spark = docs.sparkSession
    common.ship(spark)
    with common.noted() as written:
        known, classes, comps = _components(docs, size, percent, doc_id, text)
    common.drop(spark, *set(written) - {t.stored_at for t in (known, classes, comps)})

    # A component's first row, by id and text; a class or row of no component is its own.
    first = comps.join(classes.select("rep", "low"), "rep").groupBy("comp").agg(F.min("low").alias("first"))
    heads = classes.select("set_key", "rep", "low").join(comps.join(first, "comp").select("rep", "first"), "rep", "left").select("set_key", F.coalesce("first", "low").alias("head"))
    own = F.struct("doc_id", "mark")
    found = known.select("doc_id", "mark", "n_shingles", "set_key").join(heads, "set_key", "left").select("doc_id", "mark", "n_shingles", own.alias("own"), F.coalesce("head", own).alias("head"))
    null = F.lit(None).cast("long")
    return found.select(
        F.when(F.col("doc_id") == NULL_ID, null).otherwise(F.col("doc_id")).alias("doc_id"), "mark", "n_shingles",
        F.when(F.col("head.doc_id") == NULL_ID, null).otherwise(F.col("head.doc_id")).alias("component_id"),
        (F.col("own") == F.col("head")).alias("kept"),
    )


def _components(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: the sketches of all rows, the classes, and the component of each class that shares a bucket."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    known = common.stored(spark, sketch(docs, size, percent), "sketch")
    classes = known.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "mark")).alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).withColumn("rep", F.xxhash64("set_key"))
    classes = common.stored(spark, classes, "classes")

    buckets = classes.select("rep", F.explode("bands").alias("key"))
    shared = common.stored(spark, buckets.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key"), "keys")
    multi = common.stored(spark, buckets.join(shared, "key").select("key", "rep"), "buckets")
    members = common.stored(spark, multi.select("rep").distinct(), "members")
    rows = classes.join(members, "rep", "left_semi").select("rep", "low.doc_id", "low.mark")
    items = full_sets(docs.join(rows, ["doc_id", "mark"]).select("rep", "text"), size)
    sets = common.stored(spark, items.join(classes.select("rep", "sig"), "rep"), "sets")

    comps, tested = common.stored(spark, members.select("rep", F.col("rep").alias("comp")), "comps"), None
    for turn in range(ROUNDS):
        at = multi.join(comps, "rep")
        order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
        pivot = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(order.alias("o"), "rep", "comp")).alias("p")).where("low < high")
        pivot = common.stored(spark, pivot.select("key", F.col("p.rep").alias("b"), F.col("p.comp").alias("pc")), "pivots")
        if pivot.isEmpty():
            break
        pairs = at.join(pivot, "key").where("comp <> pc").select(F.col("rep").alias("a"), "b")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = common.stored(spark, pairs.groupBy("a").agg(F.min("b").alias("b")), "pairs")
        done = common.stored(spark, confirm(pairs, sets, percent), "tested")
        both = done.select("a", "b").unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tested = both if tested is None else tested.unionByName(both)
        good = done.where("ok")
        if good.isEmpty():
            continue
        if turn:
            good = good.join(comps.select(F.col("rep").alias("a"), F.col("comp").alias("u")), "a").join(comps.select(F.col("rep").alias("b"), F.col("comp").alias("v")), "b")
        else:
            good = good.select(F.col("a").alias("u"), F.col("b").alias("v"))
        comps = _merged(spark, comps, good.select("u", "v"))

    at = multi.join(comps, "rep")
    open_keys = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high")
    open_keys = common.stored(spark, open_keys.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    if not open_keys.isEmpty():
        rest = at.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        # A bucket of one block is compared with itself; of more, each block with each.
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = rest.select("key", "rep", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        sized = sets.withColumn("n_shingles", F.expr("length(items) div 8"))
        links = common.stored(spark, compare_blocks(rest, sized, percent, common.parts(spark)), "links")
        if not links.isEmpty():
            comps = _merged(spark, comps, links)
    return known, classes, comps


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=3, percent=85)
