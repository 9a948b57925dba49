"""Near-duplicate texts by the Jaccard similarity of their sets of words or of word shingles: exact links, classes, exemplars.

Equal sets are one class before anything is compared. The sets are ordered by length and packed into blocks, and every two
blocks whose lengths allow a link meet in one task. There a set finds its partners in the cheaper of two ways, neither of
which loses a link: by the rarest of its words, of which two sets over the threshold share one (of the longer set all that
a partner could miss, of the shorter one fewer still), or, where these are too frequent, by bitmaps of all sets of fitting
length. What is left passes a bound on larger bitmaps and is then counted exactly.

Pairs come out between class representatives only, with the membership beside them. For classes, where only the numbers of
links and what hangs together matter, a task gives the links of a spanning forest and counts the others.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.session import scratch, settle

#: Longs of a bitmap: those with a bit for one item, of which the first are looked at alone at first, and those that the other items share.
FIRST, OWN, SHARED = 4, 12, 4
#: Items of a block at most; sets of a block at least, where there are under six blocks; sets whose links are put out at once.
ITEMS, LEAST, GROUP = 1 << 23, 2_048, 1_000


def words(text: Column) -> Column:
    """Distinct hashes of the runs of three or more letters a to z of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})")), lambda w: F.xxhash64(w)))


def hashed_words(text: Column) -> Column:
    """Hashes of the runs of letters and digits of a text in lower case, in their order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)")), lambda w: F.xxhash64(w))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct hashes of runs of n words in lower case; a shorter text is one run, a text without words has none."""
    found = hashed_words(text)

    def runs(w: Column) -> Column:  # w is bound once; in the expression itself it would be extracted anew for each run
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) > 0, F.array_distinct(each))

    return F.element_at(F.transform(F.array(found), runs), 1)


def _hashed(rows: DataFrame, key: str, items: Column) -> DataFrame:
    """(key, _s, _n, _h) of every row, written so that items are found once: the set in order, its size, 128 bits of a hash."""
    path = scratch(rows.sparkSession, "sets")
    found = rows.select(F.col(key), F.sort_array(items).alias("_s")).select(key, F.element_at(F.transform(F.array("_s"), lambda s: F.struct(s.alias("_s"), F.greatest(F.size(s), F.lit(0)).alias("_n"), F.struct(F.xxhash64(s), F.xxhash64(F.lit(1), s)).alias("_h"))), 1).alias("_r"))
    found.select(key, "_r.*").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def classes(rows: DataFrame, key: str, items: Column) -> tuple[DataFrame, DataFrame]:
    """Membership (key, rep) of every row with items, and one row (rep, set) for each different set."""
    return _classes(_hashed(rows, key, items), key)


def _classes(hashed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    some = hashed.where("_n > 0")
    reps = settle(some.groupBy("_h", "_n").agg(F.min(key).alias("rep"), F.first("_s").alias("set")))
    return some.select(key, "_h", "_n").join(reps.select("_h", "_n", "rep"), ["_h", "_n"]).select(key, "rep"), reps.select("rep", "set")


def _least(x, t: int, over: int, strict: bool):
    """The least integer of at least (more than) t * x / over."""
    return t * x // over + 1 if strict else -(-t * x // over)


def _packed(reps: DataFrame) -> DataFrame:
    """(no, least, most, reps, data): the sets in blocks by length; least and most are the lengths of a block."""
    kind = reps.schema["rep"].dataType.simpleString()
    n, items = reps.agg(F.count("*"), F.coalesce(F.sum(F.size("set")), F.lit(0))).first()
    blocks = max(1, min(6, -(-n // LEAST)), -(-items // ITEMS))
    ordered = reps.select(F.size("set").alias("n"), "rep", "set").repartitionByRange(blocks, "n", "rep").sortWithinPartitions("n", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, sizes, sets = [], [], []
        for batch in batches:
            names.append(batch.column("rep"))
            sizes.append(batch.column("n").to_numpy())
            sets.append(batch.column("set").flatten().to_numpy())
        if sum(map(len, sizes)):
            size = np.concatenate(sizes)
            known, own = np.unique(np.concatenate(sets), return_inverse=True)
            data = zlib.compress(pickle.dumps((size, known, own.astype(np.uint16 if len(known) < 1 << 16 else np.uint32))), 1)
            every = pa.chunked_array(names).combine_chunks()
            row = [[TaskContext.get().partitionId()], [int(size[0])], [int(size[-1])], pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int32()) for x in row], names=["no", "least", "most", "reps", "data"])

    return settle(ordered.mapInArrow(run, f"no int, least int, most int, reps array<{kind}>, data binary"))


def _met(reps: DataFrame, threshold: Fraction, strict: bool, told, schema: str) -> DataFrame:
    """What told(reps of both blocks, whether they are the same one, links) yields for every two blocks that may have links."""
    t, u = threshold.numerator, threshold.denominator
    packed = _packed(reps)
    blocks = packed.select("no", "least", "most").collect()  # a row for each block
    pairs = [(a.no, b.no) for a in blocks for b in blocks if a.no <= b.no and a.most >= _least(b.least, t, u, strict)]
    if not pairs:
        return reps.sparkSession.createDataFrame([], schema)
    asked = reps.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "_p int, a int, b int")
    left, right = (packed.select(F.col("no").alias(c), F.col("reps").alias(f"{c}_reps"), F.col("data").alias(f"{c}_data")) for c in "ab")
    both = asked.join(left, "a").join(right, "b").repartitionByRange(len(pairs), "_p").select("a", "b", "a_reps", "b_reps", "a_data", "b_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("a")[i].as_py() == batch.column("b")[i].as_py()
                x, y = (pickle.loads(zlib.decompress(batch.column(c)[i].as_py())) for c in ("a_data", "b_data"))
                yield from told(batch.column("a_reps")[i].values, batch.column("b_reps")[i].values, same, _found(x, y, same, t, u, strict))

    return both.mapInArrow(run, schema)


def _found(left: tuple, right: tuple, same: bool, t: int, u: int, strict: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number in right, numbers in left, items shared, items of both) of each set of right, none shorter, that has links.

    In one block the numbers in left are the lower ones.
    """
    (n_a, known_a, a), (n_b, known_b, b) = left, right
    known = np.union1d(known_a, known_b)
    a, b = np.searchsorted(known, known_a)[a], np.searchsorted(known, known_b)[b]
    df = np.bincount(a, minlength=len(known)) + (0 if same else np.bincount(b, minlength=len(known)))
    sets = len(n_a) + (0 if same else len(n_b))
    bit = 64 * OWN + np.arange(len(known)) % (64 * SHARED)
    best = np.argsort(-np.minimum(df, sets - df), kind="stable")[: 64 * OWN]  # what half of the sets have tells most
    bit[best] = np.arange(len(best))
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(known))

    def prepared(n: np.ndarray, items: np.ndarray):
        owner = np.repeat(np.arange(len(n)), n)
        at, bits = bit[items], np.zeros(len(n) * (OWN + SHARED), np.uint64)
        np.bitwise_xor.at(bits, owner * (OWN + SHARED) + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        rest = at >= 64 * OWN
        ordered = np.sort(owner * len(known) + rank[items]) - owner * len(known)  # ranks of each set, rare ones first
        place = np.arange(len(items)) - np.repeat(np.cumsum(n) - n, n)
        rest_n = np.bincount(owner[rest], minlength=len(n))
        return owner, bits.reshape(len(n), -1), ordered, place, items[rest], rest_n, np.cumsum(rest_n) - rest_n

    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    owner_a, bits_a, ordered_a, place_a, rest_a, rest_n_a, rest_at_a = one = prepared(n_a, a)
    owner_b, bits_b, ordered_b, place_b, rest_b, rest_n_b, rest_at_b = one if same else prepared(n_b, b)
    need = _least(np.arange(int(n_a[-1]) + int(n_b[-1]) + 1), t, t + u, strict)
    index = place_a < (n_a - _least(2 * n_a, t, t + u, strict) + 1)[owner_a]
    posted = owner_a[index][np.argsort(ordered_a[index], kind="stable")]
    length = np.bincount(ordered_a[index], minlength=len(known))
    post_at = np.cumsum(length) - length
    probe = (place_b < (n_b - _least(n_b, t, u, strict) + 1)[owner_b]) & (length[ordered_b] > 0)
    asked, asked_n = ordered_b[probe], np.bincount(owner_b[probe], minlength=len(n_b))
    asked_at, cost = np.cumsum(asked_n) - asked_n, np.bincount(owner_b[probe], length[asked], len(n_b))
    lows = np.searchsorted(n_a, _least(n_b, t, u, strict))
    own_bits = [np.ascontiguousarray(bits_a[:, k]) for k in range(OWN)]
    marked, size, allowed, few = np.zeros(len(known), bool), -1, None, None
    for j, (n, low) in enumerate(zip(n_b.tolist(), lows.tolist())):
        high = j if same else len(n_a)
        if low >= high:
            continue
        if 4 * cost[j] < high - low:
            if not asked_n[j]:
                continue
            at = np.unique(np.concatenate([posted[post_at[w] : post_at[w] + length[w]] for w in asked[asked_at[j] : asked_at[j] + asked_n[j]]]))
            at = at[(at >= low) & (at < high)]
        else:
            if n != size:  # the items in one set only that a link may have
                size, allowed = n, (n_a + n - 2 * need[n_a + n]).astype(np.int32)
                few = np.clip(allowed, 0, 255).astype(np.uint8)
            apart = np.bitwise_count(own_bits[0][low:high] ^ bits_b[j, 0])
            for k in range(1, FIRST):
                apart += np.bitwise_count(own_bits[k][low:high] ^ bits_b[j, k])
            at = np.flatnonzero(apart <= few[low:high])
            apart, at = apart[at].astype(np.int32), at + low
            for k in range(FIRST, OWN):  # the others of those that are left, which are fewer each time
                apart += np.bitwise_count(own_bits[k][at] ^ bits_b[j, k])
                if (k - FIRST) % FIRST == FIRST - 1 or k == OWN - 1:
                    near = apart <= allowed[at]
                    at, apart = at[near], apart[near]
        if not len(at):
            continue
        apart = np.bitwise_count(bits_a[at] ^ bits_b[j])
        own, both = np.add.reduce(apart[:, :OWN], axis=1, dtype=np.int64), n_a[at] + n
        likely = both - own - np.add.reduce(apart[:, OWN:], axis=1, dtype=np.int64) >= 2 * need[both]
        at, own, both = at[likely], own[likely], both[likely]
        shared = (both - rest_n_a[at] - rest_n_b[j] - own) // 2  # of items with a bit of their own, exactly
        if rest_n_b[j] and (lengths := rest_n_a[at]).any():
            mine = rest_b[rest_at_b[j] : rest_at_b[j] + rest_n_b[j]]
            marked[mine] = True
            ends = np.cumsum(lengths)
            of = rest_a[np.repeat(rest_at_a[at] - ends + lengths, lengths) + np.arange(ends[-1])]
            shared = shared + np.bincount(np.repeat(np.arange(len(at)), lengths), marked[of], len(at)).astype(np.int64)
            marked[mine] = False
        sure = shared >= need[both]
        if sure.any():
            yield j, at[sure], shared[sure], both[sure]


def links(reps: DataFrame, threshold: Fraction, strict: bool = False) -> DataFrame:
    """(a, b, similarity) of representatives a < b with similarity of at least the threshold (more, if strict), each pair once."""
    names = ["a", "b", "similarity"]

    def told(a: pa.Array, b: pa.Array, same: bool, found: Iterator) -> Iterator[pa.RecordBatch]:
        held: list = []

        def batch() -> pa.RecordBatch:
            x, y = a.take(pa.array(np.concatenate([at for _, at, *_ in held]))), b.take(pa.array(np.repeat([j for j, *_ in held], [len(at) for _, at, *_ in held])))
            shared, both = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            less = pc.less(x, y)
            return pa.RecordBatch.from_arrays([pc.if_else(less, x, y), pc.if_else(less, y, x), pa.array(shared / (both - shared))], names=names)

        for hit in found:
            held.append(hit)
            if len(held) >= GROUP:
                yield batch()
                held.clear()
        if held:
            yield batch()

    kind = reps.schema["rep"].dataType.simpleString()
    return _met(reps, threshold, strict, told, f"a {kind}, b {kind}, similarity double")


def forest(reps: DataFrame, threshold: Fraction, strict: bool = False) -> DataFrame:
    """(a, b, links): pairs that connect what all links do, without a number; and with b null parts of each set's number of links.

    The pairs of a task are stars: each set with one of those that its links reach there.
    """

    def told(a: pa.Array, b: pa.Array, same: bool, found: Iterator) -> Iterator[pa.RecordBatch]:
        every = a if same else pa.concat_arrays([a, b])
        before = 0 if same else len(a)
        parent, degree = np.arange(len(every)), np.zeros(len(every), np.int64)
        for j, at, *_ in found:
            nodes = np.concatenate([[before + j], at])
            degree[at] += 1
            degree[before + j] += len(at)
            roots = parent[nodes]
            while (up := parent[roots]).tobytes() != roots.tobytes():
                roots = up
            parent[nodes] = roots
            parent[np.unique(roots)] = roots[0]
        if (has := np.flatnonzero(degree)).size:
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            below = np.flatnonzero(parent != np.arange(len(every)))
            x, y = every.take(pa.array(parent[below])), every.take(pa.array(below))
            names = ["a", "b", "links"]
            yield pa.RecordBatch.from_arrays([x, y, pa.nulls(len(x), pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([every.take(pa.array(has)), pa.nulls(len(has), every.type), pa.array(degree[has])], names=names)

    kind = reps.schema["rep"].dataType.simpleString()
    return _met(reps, threshold, strict, told, f"a {kind}, b {kind}, links bigint")


def components(nodes: DataFrame, edges: DataFrame, node: str = "rep") -> DataFrame:
    """(node, class): the least node of each connected component, by repeated minimum of neighbours with pointer jumping.

    It goes on until nothing moves. Labels are written and read again: a checkpoint keeps the size that was estimated for its
    plan, a product over all joins before it, a number whose digits triple with each round until the driver has no room.
    """
    spark = nodes.sparkSession
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = settle(nodes.select(F.col(node).alias("_n"), F.col(node).alias("_c")))
    while True:
        near = both.join(label, both.b == label["_n"]).groupBy("a").agg(F.min("_c").alias("_m"))
        step = label.join(near, label["_n"] == near.a, "left").select("_n", F.least("_c", F.coalesce("_m", "_c")).alias("_c"), F.col("_c").alias("_old"))
        jump = step.select(F.col("_n").alias("_j"), F.col("_c").alias("_jc"))
        path = scratch(spark, "labels")
        step.join(jump, F.col("_c") == F.col("_j"), "left").select("_n", F.least("_c", F.coalesce("_jc", "_c")).alias("_c"), "_old").write.parquet(path)
        new = spark.read.parquet(path)
        label = new.select("_n", "_c")
        if not new.where("_c <> _old").limit(1).count():
            return label.select(F.col("_n").alias(node), F.col("_c").alias("class"))


def near_duplicates(rows: DataFrame, key: str, items: Column, threshold: Fraction, strict: bool = False, without: bool = False) -> DataFrame:
    """(key, class, links): every row with items, its class and the number of links of its representative.

    With `without` rows that have no items (their text null, or without a word) come out too, each as a class of its own
    without links. Runs jobs: sets, the forest of links and each round of the classes are settled.
    """
    hashed = _hashed(rows, key, items)
    member, reps = _classes(hashed, key)
    found = settle(forest(reps, threshold, strict))
    return linked(member, hashed.where("_n = 0") if without else None, found, key)


def linked(member: DataFrame, none: DataFrame | None, found: DataFrame, key: str) -> DataFrame:
    """(key, class, links) of the members, by what forest found, and of the rows that have no items, if given."""
    degree = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(degree.select("rep"), found.where("links is null").select("a", "b")).join(degree, "rep")
    out = member.join(joined, "rep", "left").select(key, F.coalesce("class", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    if none is None:
        return out
    return out.unionByName(none.select(key, F.col(key).alias("class"), F.lit(0).cast("bigint").alias("links")))


def exemplars(member: DataFrame, rows: DataFrame, key: str, depth: Column, length: Column) -> DataFrame:
    """(class, exemplar, members): of each class the deepest row, of equals the longest, then the first; null is least."""
    ranked = rows.select(key, F.struct(F.coalesce(depth.cast("bigint"), F.lit(-1).cast("bigint")).alias("d"), F.coalesce(length.cast("bigint"), F.lit(-1).cast("bigint")).alias("l"), (-F.col(key)).alias("k")).alias("_r"))
    return member.join(ranked, key).groupBy("class").agg(F.max_by(key, "_r").alias("exemplar"), F.count("*").alias("members"))


def first_seen(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of rows with the same key the first by order."""
    from tunemill.operators.corpus import latest

    return latest(rows, [key], order)
