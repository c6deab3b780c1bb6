"""Near-duplicate detection with SetSketch registers, banding, a joint likelihood test and exact verification.

A document's set are its distinct shingles of five words. Register j of its sketch is a truncated, exponentially spaced
minimum: with x_j the least of the set's exponential hashes of rate ``RATE``, K_j = floor(1 - log_b x_j), held within
0..q+1. Sketches merge by maxima, and equal registers grow likelier with similarity.

1. Equal sets are one class (by a 128-bit digest), so that copies cost nothing further.
2. Each class puts its registers, ``ROWS`` at a time, into buckets. A pair of similarity 0.75 misses all ``BANDS`` of
   them with probability below 1e-5, a likelier pair more rarely.
3. Hub rounds: every class is tried with one hub, the most crowded class of its buckets. After verified links have been
   joined to components, buckets that lie within one component are done; the rest goes into the next round.
4. What is left after the rounds is compared pair by pair within buckets, between blocks of at most ``BLOCK`` classes and
   inside tasks: pairs of different components that the likelihood test does not rule out are verified on the spot, and
   only links that join two components are given out.

The likelihood test maximises the joint likelihood of the similarity given how many registers are greater, less and equal
and the known set sizes; it rules a pair out if 0.75 is ``RULED_OUT`` worse in log-likelihood than the best lower value.
Every link is confirmed on full sets: 100 * intersection >= 75 * union.

Defined results: A-Z are lower-cased, words are split at ASCII white space; with fewer than five words the whole sequence
is the one shingle; a null or wordless text has an empty set, is linked with nothing and kept; rows that repeat a doc_id
are one document, whose links are those of any of its texts; texts of any length are compared whole; there are no ties,
since the smallest doc_id names a component; an empty table gives an empty result; other columns are ignored; a null
doc_id comes before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt, discard, hot_join, modest_batches, small_batches, stash

WORDS = 5
BANDS, ROWS = 45, 5
BASE, RATE, TOP = 1.001, 20.0, 65_535
RULED_OUT = 12.5
BLOCK = 256
HUB_ROUNDS = 2
#: Ids up to this number are sent to every task (8 MB); more are met by a join.
MAX_SENT_IDS = 1_000_000
_NULL_ID = -(2**63)
_M = BANDS * ROWS
_ODD = np.random.default_rng(2024).integers(0, 1 << 32, size=(2, _M), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    mixed = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        mixed = mixed * _STEP + h[i : len(h) - k + 1 + i]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (unsigned 16-bit) of shingle hashes."""
    low = np.full(_M, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for at in range(0, len(h), 512):
        np.minimum(low, ((h[at : at + 512] ^ _ODD[0]) * _ODD[1]).min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def buckets(registers: np.ndarray) -> list[int]:
    data = registers.astype("<u2").tobytes()
    step = 2 * ROWS
    return [int(np.uint64(xxhash.xxh3_64_intdigest(data[i * step : (i + 1) * step], seed=i + 1)).astype(np.int64)) for i in range(BANDS)]


def not_ruled_out(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float = 0.75) -> np.ndarray:
    """Which pairs the joint likelihood leaves at ``similarity`` or more, given counts of registers and set sizes."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.concatenate([np.linspace(0, similarity, 61), [similarity]])[None, :]

    def share(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    p, q = share(u - v * grid), share(v - u * grid)
    equal = _M - greater - less
    value = greater[:, None] * np.log(p) + less[:, None] * np.log(q) + equal[:, None] * np.log(np.maximum(1 - p - q, 1e-12))
    fits = np.minimum(n_a, n_b) * 100 >= 75 * np.maximum(n_a, n_b)
    return fits & (value[:, :-1].max(axis=1) - value[:, -1] <= RULED_OUT)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted distinct hashes."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _sketched(docs: DataFrame) -> DataFrame:
    """id, n, key (digest of the set, null if empty) and registers of docs' rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, keys, registers = [], [], []
            for text in batch.column(1):
                s = shingle_hashes(text.as_py())
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())], names=["id", "n", "key", "registers"])

    return docs.mapInArrow(run, "id long, n long, key binary, registers binary")


def _bucketed(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [buckets(np.frombuffer(r, "<u2")) for r in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(found, np.int64).ravel(), pa.int64())], names=["id", "bucket"])

    return classes.select("id", "registers").mapInArrow(run, "id long, bucket long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the likelihood test of their sketches leaves."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, _M) for i in (3, 5))
                keep = not_ruled_out((a > b).sum(axis=1), (a < b).sum(axis=1), batch.column(2).to_numpy(), batch.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    # a hub is the b of many pairs
    pairs = stash(pairs, "hub-pairs")
    joined = hot_join(pairs.join(side("a"), "a"), side("b"), "b", "a", like=pairs).select("a", "b", "n_a", "r_a", "n_b", "r_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; docs has id and text. A hub's text goes once to each place of its
    pairs, ahead of the other sides' texts."""
    pairs = stash(pairs, "likely-pairs")
    docs = _held_ids(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, hubs = None, []
        for batch in small_batches(batches):
            found = []
            for a, b, at, text in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3)):
                if (b, at) != place:
                    place, hubs = (b, at), []
                own = shingle_hashes(text.as_py())
                if a is None:
                    hubs.append(own)
                elif any(similar(own, h) for h in hubs):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    placed = dealt(pairs, "b", "a")
    texts = lambda x: docs.select(F.col("id").alias(x), "text")
    hubs = placed.select("b", "_place").distinct().join(texts("b"), "b").select(F.lit(None).cast("long").alias("a"), "b", "_place", "text")
    rows = placed.join(texts("a"), "a").select("a", "b", "_place", "text").unionByName(hubs)
    rows = rows.repartition("b", "_place").sortWithinPartitions("b", "_place", F.col("a").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long").distinct()


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges (a, b), distinct and with a > b, and whether each a has one edge and is no b: all are stars
    around their smallest id then."""
    up, down = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ids = up.unionByName(down).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, most = ids.agg(F.sum("up"), F.max(F.col("up") + F.col("down"))).first()
    return n or 0, (most or 0) <= 1


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """id and root, the smallest id reachable, of all ids in edges (a, b); alternating large and small stars."""
    edges = stash(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not (found := _stars(edges))[1]:
        # large star: each node's larger neighbours are tied to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = hot_join(both.filter("b > a"), least, "a", "b", n=found[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(large.filter("a != b").distinct(), label)
        discard(edges)
        # small star: each node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stash(small.filter("a != b").distinct(), label)
        discard(large)
    ends = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    roots = stash(edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(ends), "roots")
    discard(edges)
    return roots


def _open_buckets(members: DataFrame) -> DataFrame:
    """The rows (bucket, id, root) of buckets that hold more than one component, with the bucket's count."""
    mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held")).filter("low != high").select("bucket", "held")
    return members.join(mixed, "bucket")


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """One pair (a, b) for each class a of rows (bucket, id, root, held): b is the most crowded class of a's buckets."""
    crowd = rows.groupBy("id").agg(F.sum("held").alias("crowd"))
    rows = rows.join(crowd, "id")
    hubs = rows.groupBy("bucket").agg(F.max(F.struct("crowd", (-F.col("id")).alias("minus"), "root")).alias("hub"))
    tried = rows.join(hubs, "bucket").filter(F.col("hub.root") != F.col("root"))
    return tried.groupBy(F.col("id").alias("a")).agg(F.max("hub").alias("hub")).select("a", (-F.col("hub.minus")).alias("b"))


def _held_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without rows that ids do not name, where the ids are few enough to be sent to every task; else docs."""
    ids = stash(ids.select("id").distinct(), "wanted-ids")
    return docs.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= MAX_SENT_IDS else docs


def _dealt_blocks(rows: DataFrame) -> DataFrame:
    """Rows (bucket, id, root) of open buckets in groups (bucket, kind, low, high) of at most two blocks.

    A bucket's most common component is its major one. Pairs within it need no look, so that major blocks meet minor
    blocks (kind 0: low is the major's, high the minor's) and minor blocks each other (kind 1)."""
    counts = rows.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    modes = counts.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("held"))
    modes = modes.select("bucket", F.col("m.root").alias("mode"), F.ceil(F.col("m.c") / BLOCK).cast("int").alias("majors"), F.ceil((F.col("held") - F.col("m.c")) / BLOCK).cast("int").alias("minors"))
    rows = rows.select("bucket", "id", "root").join(modes, "bucket").withColumn("major", F.col("root") == F.col("mode"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    group = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.cast("int").alias("low"), high.cast("int").alias("high"))
    own = F.col("own")
    to_minors = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda j: group(0, own, j))
    to_majors = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda i: group(0, i, own))
    among = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda j: group(1, F.least(own, j), F.greatest(own, j)))
    rows = rows.withColumn("g", F.explode(F.when(F.col("major"), to_minors).otherwise(F.concat(to_majors, among))))
    return rows.select("bucket", "g.*", "major", "own", "id", "root")


def _link_group(group: list[tuple]) -> list[tuple[int, int]]:
    """Confirmed links of a group's rows (bucket, kind, low, high, major, own, id, root, n, registers, text) that join
    different components. A pair is looked at only in the first bucket that it shares, likelier pairs first, and not at
    all once its components are joined."""
    bucket, kind, low, high = group[0][:4]
    registers = np.frombuffer(b"".join(r[9] for r in group), "<u2").reshape(-1, _M)
    bands = registers.reshape(-1, BANDS, ROWS)
    sizes = np.array([r[8] for r in group])
    joined: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}

    def root(i: int) -> int:
        x = group[i][7]
        while x in joined:
            x = joined[x]
        return x

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_hashes(group[i][10])
        return sets[i]

    left = [i for i, r in enumerate(group) if (not r[4] if kind == 0 else r[5] == low)]
    right = np.array([i for i, r in enumerate(group) if (r[4] if kind == 0 else r[5] == high)], np.int64)
    links = []
    for i in left:
        others = right[right > i] if kind == 1 and low == high else right
        if not len(others):
            continue
        a, b = registers[i], registers[others]
        ok = not_ruled_out((a > b).sum(axis=1), (a < b).sum(axis=1), np.full(len(others), sizes[i]), sizes[others])
        others = others[ok]
        if not len(others):
            continue
        first = (bands[i] == bands[others]).all(axis=2).argmax(axis=1)
        others = others[np.array(buckets(a))[first] == bucket]
        for j in others[np.argsort(-(a == registers[others]).sum(axis=1), kind="stable")]:
            if root(i) != root(j) and similar(full(i), full(j)):
                links.append((group[i][6], group[j][6]))
                joined[max(root(i), root(j))] = min(root(i), root(j))
    return links


def _block_links(rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between components that still share a bucket."""
    rows = stash(_dealt_blocks(rows), "blocks")
    texts = _held_ids(docs, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def found(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in small_batches(batches, 256):
            links = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and row[:4] != group[0][:4]:
                    links += _link_group(group)
                    group = []
                group.append(row)
            yield found(links)
        if group:
            yield found(_link_group(group))

    keys = ["bucket", "kind", "low", "high"]
    whole = rows.join(classes.select("id", "n", "registers"), "id").join(texts, "id")
    whole = whole.select(*keys, "major", "own", "id", "root", "n", "registers", "text")
    return whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    rows = members.select("bucket", "id")
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest linked doc_id) and kept."""
    with modest_batches(docs.sparkSession):
        return _near_duplicates(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text")), hub_rounds)


def _near_duplicates(docs: DataFrame, hub_rounds: int) -> DataFrame:
    # all that goes to Python is written before this returns
    rows = stash(_sketched(docs), "sketches")
    # a class is named by its smallest id
    full = rows.filter("key IS NOT NULL")
    first = full.groupBy("key").agg(F.min(F.struct("id", "n", "registers")).alias("c"))
    classes = stash(first.select("key", "c.*"), "classes")
    named = classes.select("key", F.col("id").alias("rep"))
    classes = classes.drop("key")
    members = stash(_open_buckets(_rooted(_bucketed(classes), None)), "members")
    roots = None
    for turn in range(hub_rounds + 1):
        # each round keeps only rows of buckets that still hold different components
        rest = members if roots is None else stash(_open_buckets(_rooted(members, roots)), "members")
        if rest.isEmpty():
            break
        found = _verified(_likely(_hub_pairs(rest), classes), docs) if turn < hub_rounds else _block_links(rest, classes, docs)
        found = stash(found, "links")
        members = rest
        if not found.isEmpty():
            # earlier links count by the stars that they gave
            known = found if roots is None else found.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
            roots = components(known)
    # classes of rows that repeat an id with another text are tied by their common name
    placed = hot_join(full.select("id", "n", "key"), named, "key", "id").select("id", "n", "rep")
    placed = stash(placed.unionByName(rows.filter("key IS NULL").select("id", "n", F.col("id").alias("rep"))), "placed")
    if roots is not None:
        placed = hot_join(placed, roots.withColumnRenamed("id", "rep"), "rep", "id", "left").select("id", "n", F.coalesce("root", "rep").alias("root"))
    else:
        placed = placed.withColumnRenamed("rep", "root")
    same = F.col("id") == F.col("root")
    return placed.select(F.nullif("id", F.lit(_NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("root", F.lit(_NULL_ID)).alias("component_id"), same.alias("kept"))
