"""N-gram Jaccard similarity join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct n-word shingles (A-Z lower-cased; a shorter
text is one shingle; a text without words has none and links with nothing). Two sets
link if 100 * |intersection| >= 100 * threshold * |union|.

1. Equal sets are one class (64-bit digest of the sorted set), represented by its smallest doc_id;
   only classes are compared.
2. All sets share one order of shingles: hashes first, the ``HEAVY`` most frequent shingles last, by
   rising frequency. (Any order gives the same links; the table only has to be the
   same for all, so its fixed size is no cap.) Linked sets of size n share at least one of
   their first n - ceil(t n) + 1 shingles, and l of them if both prefixes are l - 1 longer.
3. Each document chooses its l: the prefix grows by one while that lowers the estimated candidate
   cost, the number of documents expected to share l of its prefix shingles.
4. Shingles in the prefixes of two or more classes are buckets. Buckets of more than ``FEW`` classes lose the
   classes that no other of the bucket fits in size and in the histogram of hashes, and are parted into groups of those that
   fit: of classes that share common shingles by chance none is left, however large such buckets grow with the corpus. In buckets of up to ``SMALL``
   classes all pairs are formed, and pairs that share as many prefix shingles as the smaller l of the two
   and fit in size and in the histogram of their hashes are verified on the whole sets. Larger buckets (groups of near copies,
   very common lines) are dealt into blocks of about ``SIDE`` classes; a task takes two blocks, counts all
   intersections by one matrix product and emits only the links that join what it has
   not joined yet, never all pairs. Near copies share dozens of large buckets: buckets that have members in common
   become one, unless that would send more sets to the tasks than the buckets one by one.
5. Links are contracted to components by alternating large-star and small-star steps.

Defined cases: null, empty and blank texts have an empty set and are components of their own;
rows of one doc_id are one node; rows with null doc_id link with nothing and have a null
component; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, freed, materialize, small_batches
from tessera.llm.wordhash import run_hashes, word_hashes, words

HEAVY = 1 << 19
#: Shingles counted together before the frequent ones are reported, and the least count reported.
COUNTED, REPORT = 1 << 22, 3
MOST_MATCHES = 4
SMALL, SIDE = 32, 512
#: Buckets of more than ``FEW`` classes and up to ``HELD`` (some 100 bytes each in a task) are sifted; a larger one keeps all its classes.
FEW, HELD = 8, 1 << 14
#: Ids (8 bytes each) that are broadcast to pick the texts to verify; more of them are joined by a shuffle.
BROADCAST_IDS = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64)."""
    raw = (text or "").encode().translate(_LOWER)
    starts, ends = words(raw)
    h = word_hashes(raw, starts, ends)
    if not len(h):
        return h
    return np.unique(run_hashes(h, min(n, len(h))))


def digest(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def spread(hashes: np.ndarray) -> np.ndarray:
    """How many hashes begin with each value of the first 6 bits.

    The differences of two such histograms add up to no more than the sets' symmetric difference.
    """
    return np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=64).astype(np.int32)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: (doc_id, size, key, parts) of a document, and (token, count) of a shingle frequent in one block of documents."""
    small_batches(docs.sparkSession)

    def report(blocks: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(blocks), return_counts=True)
        often = counts >= REPORT
        return batch([], [], _signed(tokens[often]), counts[often])

    def batch(ids, sets, tokens, counts) -> pa.RecordBatch:
        a, b = len(ids), len(tokens)
        nulls = lambda k: [None] * k
        cols = [[*ids, *nulls(b)], [*map(len, sets), *nulls(b)], [*map(digest, sets), *nulls(b)], [*nulls(a), *tokens], [*nulls(a), *counts]]
        parts = pa.array([*map(spread, sets), *nulls(b)], pa.list_(pa.int32()))
        return pa.record_batch([*[pa.array(c, pa.int64()) for c in cols], parts], names=["doc_id", "size", "key", "token", "count", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for b in batches:
            sets = [shingles(t.as_py(), n) for t in b.column(1)]
            yield batch(b.column(0).to_pylist(), sets, [], [])
            held += sets
            total += sum(map(len, sets))
            if total >= COUNTED:
                yield report(held)
                held, total = [], 0
        if held:
            yield report(held)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(freed(run), "doc_id bigint, size bigint, key bigint, token bigint, count bigint, parts array<int>")


def prefix_length(size: int, percent: int) -> int:
    """Shingles of which two linked sets must share one."""
    return size - -(-percent * size // 100) + 1


def choose(costs: np.ndarray, base: int, most: int) -> int:
    """The number of matches l (from 1) with the least estimated cost.

    costs: estimated documents of each shingle in order; a prefix of base + l - 1 shingles has
    their sum as memberships, of which the l-th part at most can be documents met l times.
    """
    sums = np.cumsum(costs[: base + most - 1])
    best, least = 1, float(sums[base - 1])
    for matches in range(2, most + 1):
        if base + matches - 1 > len(sums):
            break
        cost = float(sums[base + matches - 2]) / matches
        if cost < least:
            best, least = matches, cost
    return best


def prefixes(docs: DataFrame, n: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, key, size, matches): the prefix of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value  # sorted by token
        done: set[int] = set()  # equal sets in one task give their prefix once
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for t in b.column(0):
                s = shingles(t.as_py(), n)
                if not len(s) or (key := digest(s)) in done:
                    continue
                done.add(key)
                base = prefix_length(len(s), percent)
                cost = np.ones(len(s))
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    cost = np.where(tokens[at] == s, counts[at], 0) + 1.0
                order = np.lexsort((s, cost))[: base + MOST_MATCHES - 1]
                matches = choose(cost[order], base, MOST_MATCHES)
                prefix = s[order[: base + matches - 1]]
                k = len(prefix)
                for col, x in zip(out, (_signed(prefix), np.full(k, key), np.full(k, len(s)), np.full(k, matches)), strict=True):
                    col.append(x)
            cols = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out]
            yield pa.record_batch(cols, names=["token", "key", "size", "matches"])

    return docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(freed(run), "token bigint, key bigint, size bigint, matches bigint")


def _buckets(prefix_rows: DataFrame) -> DataFrame:
    """Prefix rows, each once, whose token has two keys or more.

    Rows come sorted by token and key, so a row only has to be compared with its neighbours: a
    bucket of any size streams through.
    """
    names = ["token", "key", "size", "matches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, False  # the last row, and whether the row before it had its token
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if last is not None:
                rows = np.hstack([last, rows])
            rows = rows[:, np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))]
            same = rows[0, 1:] == rows[0, :-1]
            before = np.append(met if last is not None else False, same)
            out = rows[:, :-1][:, before[:-1] | same]
            last, met = rows[:, -1:], bool(before[-1])
            yield pa.record_batch([pa.array(r, pa.int64()) for r in out], names=names)
        if met:
            yield pa.record_batch([pa.array(r, pa.int64()) for r in last], names=names)

    width = int(prefix_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prefix_rows.repartition(width, "token").sortWithinPartitions("token", "key").mapInArrow(freed(run), "token bigint, key bigint, size bigint, matches bigint")


def fitting(sizes: np.ndarray, parts: np.ndarray, percent: int, step: int = 256) -> np.ndarray:
    """A number for each set, the same for two that may be linked by size and histogram, directly or over others. Sets are sorted by size.

    Blocks of sets that have one number already are not compared: near copies come to that at once.
    """
    n = len(sizes)
    group = np.arange(n)
    ends = np.searchsorted(percent * sizes, 100 * sizes, side="right")
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        for at in range(lo, int(ends[hi - 1]), step):
            upto = min(at + step, n)
            if (group[lo:hi] == group[lo]).all() and (group[at:upto] == group[lo]).all():
                continue
            apart = np.abs(parts[lo:hi, None, :] - parts[None, at:upto, :]).sum(axis=2, dtype=np.int64)
            a, b = sizes[lo:hi, None], sizes[None, at:upto]
            x, y = np.nonzero((apart * (100 + percent) <= (a + b) * (100 - percent)) & (100 * a >= percent * b) & (100 * b >= percent * a))
            while (differ := group[lo + x] != group[at + y]).any():
                x, y = x[differ], y[differ]
                ends_of = np.stack([group[lo + x], group[at + y]])
                least = np.arange(n)
                np.minimum.at(least, ends_of.max(axis=0), ends_of.min(axis=0))
                group = least[group]
    return group


def _sifted(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """members (token, key, rep, size, matches, n) that another one of their token fits, with a token for each group of those that fit; n counts the group.

    Counts above 255 are taken as 255, which brings histograms no further apart.
    """
    byte = F.array_join(F.transform("parts", lambda x: F.lpad(F.hex(F.least(x, F.lit(255))), 2, "0")), "")
    names = ["token", "key", "rep", "size", "matches"]

    def sift(rows: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(rows[0])) + 1
        left, counts, groups = [], [], []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.shape[1]], strict=True):
            group = fitting(rows[3, lo:hi], parts[lo:hi], percent)
            count = np.bincount(group)[group]
            keep = np.flatnonzero(count > 1)
            left.append(lo + keep)
            counts.append(count[keep])
            groups.append(group[keep])
        out = rows[:, np.concatenate(left)]
        token = (out[0].view(np.uint64) ^ np.concatenate(groups).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)  # two with one token would be compared, no more
        return pa.record_batch([pa.array(x, pa.int64()) for x in (_signed(token), *out[1:], np.concatenate(counts))], names=[*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last token, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            parts = np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=np.uint8).reshape(-1, 64).astype(np.int16)
            at = int(np.searchsorted(rows[0], rows[0, -1]))
            if at or (held and held[0][0][0, 0] != rows[0, 0]):
                whole = [*held, (rows[:, :at], parts[:at])]
                held = []
                yield sift(np.hstack([w[0] for w in whole]), np.vstack([w[1] for w in whole]))
            held.append((rows[:, at:], parts[at:]))
        if held:
            yield sift(np.hstack([w[0] for w in held]), np.vstack([w[1] for w in held]))

    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.join(classes.select("key", F.unhex(byte).alias("parts")), "key").select(*names, "parts")
    kinds = ", ".join(f"{c} bigint" for c in [*names, "n"])
    return rows.repartition(width, "token").sortWithinPartitions("token", "size", "key").mapInArrow(freed(run), kinds)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, set array<bigint>) of the wanted (rep, key)."""
    reps = materialize(wanted.select("rep").distinct(), "jaccard-reps")
    if reps.count() <= BROADCAST_IDS:
        reps = F.broadcast(reps)
    few = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(reps, "rep", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), n) for t in b.column(0)]
            yield pa.record_batch([pa.array([digest(s) for s in sets], pa.int64()), pa.array([_signed(s) for s in sets], pa.list_(pa.int64()))], names=["key", "set"])

    found = few.mapInArrow(freed(run), "key bigint, set array<bigint>").join(wanted.select("key"), "key", "left_semi")
    return found.groupBy("key").agg(F.any_value("set").alias("set"))


def links_in_block(ids: list[int], sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between (or, with one side, among) sets that make a spanning forest of their links."""
    vocabulary, where = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(where, minlength=len(vocabulary)) > 1
    renumber = np.cumsum(shared) - 1
    use = shared[where]
    rows, cols = rows[use], renumber[where[use]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(shared.sum()), 4096):  # a slice of the vocabulary at a time
        pick = (cols >= at) & (cols < at + 4096)
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[rows[pick], cols[pick] - at] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    side = np.array(sides)
    near = np.triu(100 * common >= percent * union, 1)
    if len(set(sides)) > 1:
        near &= side[:, None] != side[None, :]
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[a] = b
            out.append((ids[i], ids[j]))
    return out


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links of blocks: rows (task, side, rep, set), sorted by task within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        current = None

        def flush() -> list[tuple[int, int]]:
            out = links_in_block([h[1] for h in held], [h[2] for h in held], [h[0] for h in held], percent) if len(held) > 1 else []
            held.clear()
            return out

        for b in batches:
            out = []
            for task, side, rep, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if task != current:
                    out += flush()
                    current = task
                held.append((side, rep, s.values.to_numpy()))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = flush()
        yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(freed(run), "a bigint, b bigint")


def _merged(large: DataFrame) -> DataFrame:
    """(token, rep, key, blocks, block) of large buckets: those connected by common members as one bucket with each member once, if that sends fewer sets to tasks.

    large: token, rep, key, n (the bucket's members). A bucket sends each member once for each of its blocks.
    """
    blocks = lambda n: F.ceil(n / SIDE).cast("int")
    least = large.groupBy("token").agg(F.min("key").alias("first"))
    stars = large.join(least, "token").select("token", "rep", "key", "first", "n")
    groups = components(stars.select(F.col("key").alias("a"), F.col("first").alias("b")))
    member = materialize(stars.join(groups, stars["key"] == groups["node"], "left").select("token", "rep", "key", "n", F.coalesce("root", "key").alias("grp")), "jaccard-groups")
    each = member.select("grp", "rep", "key").distinct()
    apart = member.groupBy("grp").agg(F.sum(blocks(F.col("n"))).alias("apart"))
    sizes = each.groupBy("grp").agg(F.count("*").alias("n")).join(apart, "grp").select("grp", "n", (F.col("n") * blocks(F.col("n")) <= F.col("apart")).alias("together"))
    one = each.join(sizes.where("together").drop("together"), "grp").select(F.xxhash64(F.lit("group"), "grp").alias("token"), "rep", "key", "n")
    rest = member.join(sizes.where("not together").select("grp"), "grp", "left_semi").select("token", "rep", "key", "n")
    dealt = one.unionByName(rest).withColumn("blocks", blocks(F.col("n")))
    return dealt.select("token", "rep", "key", "blocks", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"))


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b) links between representatives, enough to connect whatever is linked. classes: key, size, rep."""
    found = materialize(_buckets(prefixes(docs, n, percent, heavy)), "jaccard-buckets")
    members = materialize(found.join(classes.select("key", "rep"), "key"), "jaccard-members")
    discard(found)
    counted = materialize(members.join(members.groupBy("token").agg(F.count("*").alias("n")), "token"), "jaccard-counted")
    discard(members)
    many = F.col("n").between(FEW + 1, HELD)
    sized = counted.where(~many).unionByName(_sifted(counted.where(many), classes, percent))
    sized = materialize(sized, "jaccard-sized")
    discard(counted)

    small = sized.where(F.col("n") <= SMALL)
    a, b = (small.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "rep", "size", "matches")]) for x in "ab")
    fits = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    pairs = (
        a.join(b, "token").where((F.col("key_a") < F.col("key_b")) & fits)
        .groupBy("key_a", "key_b", "rep_a", "rep_b", "size_a", "size_b")
        .agg(F.count("*").alias("met"), F.max(F.least("matches_a", "matches_b")).alias("needed"))
        .where(F.col("met") >= F.col("needed"))
    )
    # linked sets differ in at most (a + b) (1 - t) / (1 + t) shingles, so their histograms do, too
    apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    side = lambda x: classes.select(F.col("key").alias(f"key_{x}"), F.col("parts").alias(f"parts_{x}"))
    pairs = (
        pairs.join(side("a"), "key_a").join(side("b"), "key_b")
        .where(apart * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)).drop("parts_a", "parts_b")
    )
    pairs = materialize(pairs, "jaccard-pairs")
    shared = materialize(sized.where(F.col("n") > SMALL).select("token", "rep", "key", "n"), "jaccard-large")
    discard(sized)
    large = materialize(_merged(shared), "jaccard-dealt")
    discard(shared)
    wanted = (
        pairs.select(F.col("rep_a").alias("rep"), F.col("key_a").alias("key"))
        .unionByName(pairs.select(F.col("rep_b").alias("rep"), F.col("key_b").alias("key")))
        .unionByName(large.select("rep", "key")).distinct()
    )
    wanted = materialize(wanted, "jaccard-wanted")
    sets = materialize(_sets(docs, wanted, n), "jaccard-sets")
    discard(wanted)

    common = F.size(F.array_intersect("set_a", "set_b"))
    verified = (
        pairs.join(sets.select(F.col("key").alias("key_a"), F.col("set").alias("set_a")), "key_a")
        .join(sets.select(F.col("key").alias("key_b"), F.col("set").alias("set_b")), "key_b")
        .where(100 * common >= percent * (F.col("size_a") + F.col("size_b") - common))
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    )
    # a member goes to the tasks of its block with every block of its bucket
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = (
        large.withColumn("other", other)
        .select(F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("task"), F.col("block").alias("side"), "rep", "key")
    )
    blocks = tasks.join(sets, "key").select("task", "side", "rep", "set")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = materialize(verified.unionAll(_block_links(blocks.repartition(width, "task").sortWithinPartitions("task"), percent)), "jaccard-links")
    discard(pairs, large, sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge but the smallest ones themselves."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        old = e
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        e = materialize(e.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        discard(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    table = materialize(sketches(docs, n), "jaccard-sketches")
    rows = table.where("key is not null").select("doc_id", "size", "key", "parts")
    top = table.where("token is not null").groupBy("token").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "token").limit(HEAVY).toArrow()  # 16 bytes a row
    tokens, counts = (top.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(tokens.view(np.uint64))
    heavy = (tokens.view(np.uint64)[order], counts[order].astype(np.float64))
    classes = rows.where("size > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size"), F.any_value("parts").alias("parts")).where("rep is not null")
    classes = materialize(classes, "jaccard-classes")
    found = links(docs, classes, n, percent, heavy)
    # rows of one id with several texts are one node, too
    same = rows.where("size > 0 and doc_id is not null").join(classes.select("key", "rep"), "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    roots = components(found.unionAll(same))
    discard(found, classes)
    return (
        rows.join(roots, rows["doc_id"] == roots["node"], "left")
        .select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
