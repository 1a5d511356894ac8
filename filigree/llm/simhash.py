"""Near duplicates by SimHash, found with BK-trees.

Fingerprints that differ in ``radius`` bits or fewer agree on at least one of ``radius + 1`` blocks of
bits (pigeonhole). Distinct fingerprints are dealt into shards by block and value, and each shard is a
BK-tree: children hang on their integer Hamming distance to the parent, and a search follows the edges
within ``radius`` of its own distance only. Whole shards go to the task that builds their tree, as a
broadcast would grow with the data. A shard over ``most`` fingerprints is dealt again by blocks of the bits
that its members do not share yet; after some levels so few bits are free that a shard is small by
itself, so no shard is ever cut or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import materialise, remove, rows_of, through, utf8
from filigree.operators.components import components

SEED = 42
BITS = 64


def simhash_bytes(text: bytes, shingle: int, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and white space of ASCII, alone
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([hashed(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - shingle + 1
        h = np.fromiter((hashed(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # bits of bounded pieces
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a long; texts without words, and null ones, have 0."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fp = np.array([simhash_bytes(b.as_py(), shingle, seed) for b in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return through(d, "doc_id long, fp long", run)


def tree_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (positions) of distinct ``values`` (uint64) within ``radius`` bits, by a BK-tree.

    A node is the first of its values; the others hang on their distance to it. The values search their own tree
    together: at a node, all that have come so far are compared with it, and each edge is followed by those
    whose distance is within ``radius`` of the edge's.
    """
    found_a, found_b = [], []
    stack = [(np.arange(len(values)), np.arange(len(values)))]
    while stack:
        members, seekers = stack.pop()
        node, rest = members[0], members[1:]
        far = np.bitwise_count(values[seekers] ^ values[node]).astype(np.int64)
        near = seekers[(far <= radius) & (seekers > node)]
        found_a.append(np.full(len(near), node))
        found_b.append(near)
        # Whoever comes later in the tree's order is found by it; a value need not look among those before it.
        seekers, far = seekers[seekers > node], far[seekers > node]
        if not len(rest) or not len(seekers):
            continue
        edge = np.bitwise_count(values[rest] ^ values[node])
        for e in np.unique(edge):
            below = np.abs(far - int(e)) <= radius
            if below.any():
                stack.append((rest[edge == e], seekers[below]))
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position reachable from each of ``n`` positions."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(again := new[new], new):
            new = again
        if np.array_equal(new, root):
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _blocks(free: int, parts: int) -> list[list[int]]:
    """The bits of a mask in ``parts`` runs of nearly equal length."""
    bits = [i for i in range(BITS) if free >> i & 1]
    return [bits[len(bits) * k // parts : len(bits) * (k + 1) // parts] for k in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def shards(distinct: DataFrame, radius: int, most: int) -> Iterator[DataFrame]:
    """``mask, key, fp``: shards of two members or more, at most ``most`` each or of so few free bits that no more exist.

    Each pair within ``radius`` bits is together in one shard at least: of the blocks that a shard is dealt into, the
    pair agrees on one.
    """
    level = {0: distinct.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("key"), "fp")}
    small = max(1, most.bit_length() - 1)
    while level:
        deeper = {}
        for shared, rows in level.items():
            free = ((1 << BITS) - 1) & ~shared
            masks = [shared | sum(1 << i for i in block) for block in _blocks(free, radius + 1)]
            key = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            dealt = rows.select("fp", F.explode(F.array(*[key(m) for m in masks])).alias("s")).select("s.mask", "s.key", "fp")
            dealt = dealt.distinct() if shared else dealt
            counts = dealt.groupBy(F.col("mask").alias("c_mask"), F.col("key").alias("c_key")).agg(F.count("*").alias("members"))
            counts = materialise(counts.filter("members > 1"), "simhash-shards")
            sized = dealt.join(counts, (F.col("mask") == F.col("c_mask")) & (F.col("key") == F.col("c_key"))).drop("c_mask", "c_key")
            done = [m for m in masks if BITS - m.bit_count() <= small]
            is_done = F.col("members") <= most
            if done:
                is_done |= F.col("mask").isin(*[_signed(m) for m in done])
            yield sized.filter(is_done).drop("members")
            big = {r["c_mask"] for r in counts.filter(F.col("members") > most).select("c_mask").distinct().collect()}  # masks: radius + 1 at most
            for m in masks:
                if _signed(m) in big and m not in done:
                    deeper[m] = sized.filter((F.col("mask") == F.lit(_signed(m))) & ~is_done).select("mask", "key", "fp")
        level = deeper


def links(distinct: DataFrame, radius: int = 3, most: int = 8192) -> DataFrame:
    """``a, b``: links that join all ``fp`` of ``distinct`` which chains of steps of ``radius`` bits or fewer join.

    Within a shard the links found are given as a forest (each fingerprint and the first one it is joined with), so a
    dense group gives as many links as it has members and not their square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def solve() -> pa.RecordBatch:
            values = np.concatenate(held)
            root = forest(len(values), *tree_links(values, radius))
            hung = root != np.arange(len(values))
            signed = values.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[hung]), pa.array(signed[root[hung]])], names=["a", "b"])

        for batch in batches:
            mask, key = (np.asarray(batch.column(i)) for i in (0, 1))
            fp = np.asarray(batch.column(2)).view(np.uint64)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mask)], strict=True):
                if s == e:
                    continue
                now = (int(mask[s]), int(key[s]))
                if shard != now and held:
                    yield solve()
                    held = []
                shard = now
                held.append(fp[s:e])
        if held:
            yield solve()

    out = None
    for part in shards(distinct, radius, most):
        near = through(part.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp"), "a long, b long", run)
        out = near if out is None else out.union(near)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, most: int = 8192) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id among all documents that links reach, itself included.

    One row for each row of ``docs``; rows with null ids take part and get the component's smallest id, null if it has none.
    Equal fingerprints are one node, so copies cost nothing; the join back to documents is one that Spark can split.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = materialise(nodes, "simhash-nodes")
    found = materialise(components(links(nodes.select("fp"), radius, most), "simhash-links"), "simhash-roots")
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("n_fp"), "component_id")
    return fps.join(named, F.col("fp") == F.col("n_fp")).select("doc_id", "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near copies by their similarity, for wider radii than blocks of bits can prove.

WORDS64 = 4
#: Texts of so many shingles or fewer are also compared by the shingles themselves (`short_links`).
SHORT = 20
#: Odd multipliers that make independent hashes of one. Fixed values.
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """Distinct hashes (uint64) of the shingles of a text; of all words if they are fewer; none without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n))


def wide_simhash(hashes: np.ndarray) -> bytes:
    """256 bits of a set of hashes, each the majority of a mixed bit."""
    if not len(hashes):
        return bytes(8 * WORDS64)
    ones = np.zeros(BITS * WORDS64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14), None] * np.array(MIXERS, np.uint64)
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        ones += np.unpackbits(part.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id, node, fp, size, short``: a hash of the whole text, its 256 bits, the number of its shingles, and their hashes if they are few."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), node_of(text_col).alias("node"), utf8(text_col).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            hashes = [shingle_hashes(b.as_py(), shingle) for b in batch.column(2)]
            fp, size = [wide_simhash(h) for h in hashes], [len(h) for h in hashes]
            short = [h.view(np.int64) if 0 < len(h) <= SHORT else None for h in hashes]
            made = [pa.array(fp, pa.binary()), pa.array(size, pa.int32()), pa.array(short, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "node", "fp", "size", "short"])

    return through(d, "doc_id long, node long, fp binary, size int, short array<long>", run)


def node_of(text_col: str) -> Column:
    """The same for equal texts; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _orders(turns: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.permutation(BITS * WORDS64) for _ in range(turns)]


def _shard_values(fp: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The values of 16 bits at a time, in the given order, of fingerprints (rows of bytes)."""
    bits = np.unpackbits(fp, axis=1)[:, order]
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u2").astype(np.int32)


def _dealt(nodes: DataFrame, turns: int, seed: int) -> DataFrame:
    """``shard`` and the columns of ``nodes`` (``fp`` is the second), one row for each shard of a node: the values of 16 bits at a time, of all 256 in ``turns`` random orders."""
    orders, names = _orders(turns, seed), nodes.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 2048):
            fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 8 * WORDS64)
            for t, order in enumerate(orders):
                value = _shard_values(fp, order)
                shard = (value + ((t * value.shape[1] + np.arange(value.shape[1], dtype=np.int32)) << 16)).ravel()
                rows = pa.array(np.repeat(np.arange(len(fp)), value.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *[c.take(rows) for c in batch.columns]], names=["shard", *names])

    return through(nodes, ", ".join(["shard int", *[f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields]]), deal)


def nearest_links(nodes: DataFrame, radius: int, turns: int, most: int = 4096, seed: int = 11) -> DataFrame:
    """``a, b``: each node and the nearest to it within ``radius`` of 256 bits, of the stretch of every shard that it is in.

    These links join dense groups cheaply, so that `crossing_links`, which leaves out no pair, need not look inside
    them. Shards are dealt by ranges of shard and fingerprint, so that a very frequent one is spread over tasks, and
    searched in stretches of ``most`` fingerprints.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WORDS64)))
                size += batch.num_rows
            if size >= 1 << 15:
                shard, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                # The last shard goes on in the next batch, unless it fills this one.
                cut = int(np.searchsorted(shard, shard[-1])) or len(shard)
                yield _nearest(shard[:cut], node[:cut], fp[:cut], radius, most)
                held, size = [(shard[cut:], node[cut:], fp[cut:])], len(shard) - cut
        if size:
            yield _nearest(*(np.concatenate(x) for x in zip(*held, strict=True)), radius, most)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(nodes.select("node", "fp"), turns, seed)
    near = through(dealt.repartitionByRange(n, "shard", "fp").sortWithinPartitions("shard", "fp"), "a long, b long", search)
    return near.distinct()


def _nearest(shard: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int, most: int) -> pa.RecordBatch:
    """Links of sorted rows: small shards are compared directly, row against row; a larger one is a BK-tree."""
    n = len(shard)
    best = np.full(n, radius + 1)
    other = np.full(n, -1)
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    sizes = np.diff(np.append(cuts, n))
    length = np.repeat(sizes, sizes)

    def offer(i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        for x, y in ((i, j), (j, i)):
            order = np.lexsort((far, x))
            x, y, d = x[order], y[order], far[order]
            first = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
            x, y, d = x[first], y[first], d[first]
            nearer = d < best[x]
            best[x[nearer]], other[x[nearer]] = d[nearer], y[nearer]

    small = 24
    for step in range(1, small):
        i = np.flatnonzero((shard[step:] == shard[:-step]) & (length[: n - step] <= small)) if step < n else np.zeros(0, int)
        if not len(i):
            break
        far = np.bitwise_count(fp[i] ^ fp[i + step]).sum(1, dtype=np.int64)
        ok = far <= radius
        offer(i[ok], i[ok] + step, far[ok])
    for at, size in zip(cuts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        for start in range(at, at + size, most):
            part = slice(start, min(start + most, at + size))
            i, j, far = wide_tree_links(fp[part], radius)
            offer(i + start, j + start, far)
    got = np.flatnonzero(other >= 0)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[got], node[other[got]])), pa.array(np.minimum(node[got], node[other[got]]))], names=["a", "b"])


def wide_tree_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value the pair with its nearest earlier and later tree mates within ``radius``, by a BK-tree."""
    n = len(fp)
    best, other = np.full(n, radius + 1), np.full(n, -1)
    stack = [(np.arange(n), np.arange(n))]
    while stack:
        members, seekers = stack.pop()
        node, rest = members[0], members[1:]
        seekers = seekers[seekers > node]
        far = np.bitwise_count(fp[seekers] ^ fp[node]).sum(1, dtype=np.int64)
        near = far < best[seekers]
        best[seekers[near]], other[seekers[near]] = far[near], node
        if len(far) and far.min() < best[node]:
            best[node], other[node] = far.min(), seekers[far.argmin()]
        if not len(rest) or not len(seekers):
            continue
        edge = np.bitwise_count(fp[rest] ^ fp[node]).sum(1, dtype=np.int64)
        for e in np.unique(edge):
            below = np.abs(far - e) <= radius
            if below.any():
                stack.append((rest[edge == e], seekers[below]))
    got = np.flatnonzero(other >= 0)
    return got, other[got], best[got]


def cells(dealt: DataFrame, most: int) -> DataFrame:
    """``dealt`` with the cell ``i, j`` of each row and its block ``own``: a shard over ``most`` rows is dealt into blocks by hash, and each pair of blocks is a cell.

    So any two rows of a shard meet in a cell, and a cell has about ``2 * most`` rows. A row of a hot shard goes to as many cells as the
    shard has blocks. Hot shards of a single group have no pairs to find and go.
    """
    hot = dealt.groupBy(F.col("shard").alias("c_shard")).agg(F.count("*").alias("members"), (F.min("group") < F.max("group")).alias("mixed"))
    hot = materialise(hot.filter(F.col("members") > most), "simhash-hot")
    blocks = F.coalesce(F.ceil(F.col("members") / most), F.lit(1))
    rows = dealt.join(hot, F.col("shard") == F.col("c_shard"), "left").filter(F.coalesce("mixed", F.lit(True)))
    rows = rows.select(*dealt.columns, blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit("cell"), "node"), blocks).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return rows.select(*dealt.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def crossing_links(nodes: DataFrame, radius: int, turns: int, similarity: float, most: int = 4096, seed: int = 11) -> DataFrame:
    """``a, b``: all pairs of nodes of different groups that are within ``radius`` bits and share a shard, each pair once.

    ``nodes``: ``node, fp, size, group``. Left out are pairs of one group, which are joined already, and those whose sizes
    alone exclude the similarity. Every other pair of a shard is compared: shards over ``most`` nodes block against block (`cells`).
    """
    orders = _orders(turns, seed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, full = 0, 1 << 15
        for batch in batches:
            if batch.num_rows:
                fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WORDS64)
                held.append((*(np.asarray(batch.column(i)) for i in (0, 1)), fp, *(np.asarray(batch.column(i)) for i in range(3, batch.num_columns))))
                size += batch.num_rows
            if size >= full:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                # The last cell goes on in the next batch; one that fills all is held until its end.
                cut = int(np.flatnonzero(_starts_of(rows))[-1])
                if cut:
                    yield from _crossing([x[:cut] for x in rows], radius, similarity, orders)
                held, size = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
                full = max(1 << 15, 2 * size)
        if size:
            yield from _crossing([np.concatenate(x) for x in zip(*held, strict=True)], radius, similarity, orders)

    dealt = cells(_dealt(nodes.select("node", "fp", "size", "group"), turns, seed), most)
    return through(dealt.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "group"), "a long, b long", search)


def _starts_of(rows: list[np.ndarray]) -> np.ndarray:
    """Where the cell differs from the row before."""
    differ = [rows[k][1:] != rows[k][:-1] for k in (0, 5, 6)]
    return np.concatenate([[True], np.logical_or.reduce(differ)])


def _crossing(rows: list[np.ndarray], radius: int, similarity: float, orders: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The pairs of whole cells, sorted by cell and group."""
    shard, node, fp, size, group, low, high, own = rows
    n = len(shard)
    starts = _starts_of(rows)
    cell, cuts = np.cumsum(starts), np.flatnonzero(starts)
    sizes = np.diff(np.append(cuts, n))
    length = np.repeat(sizes, sizes)

    def near(i: np.ndarray, j: np.ndarray, values: np.ndarray | None = None, base: int = 0) -> Iterator[pa.RecordBatch]:
        """Those of the pairs that are links and don't share an earlier shard; ``values``: the shards of the rows from ``base`` on, if they are known."""
        ok = (group[i] != group[j]) & ((own[i] != own[j]) | (low[i] == high[i])) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= radius
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 1 << 13):
            x, y = i[at : at + (1 << 13)], j[at : at + (1 << 13)]
            if values is None:
                differ = np.ascontiguousarray(fp[x] ^ fp[y]).view(np.uint8)
                equal = np.concatenate([_shard_values(differ, o) == 0 for o in orders], axis=1)
            else:
                equal = values[x - base] == values[y - base]
            first = equal.argmax(1) == shard[x] >> 16
            x, y = node[x[first]], node[y[first]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    small = 24
    for step in range(1, min(small, n)):
        i = np.flatnonzero((cell[step:] == cell[:-step]) & (length[: n - step] <= small))
        if not len(i):
            break
        yield from near(i, i + step)
    for at, count in zip(cuts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        # Rows of one group are neighbours: what a row is compared with begins where its group ends.
        end = np.searchsorted(group[at : at + count], group[at : at + count], "right") + at
        bits = np.ascontiguousarray(fp[at : at + count]).view(np.uint8)
        values = np.concatenate([_shard_values(bits, o).astype(np.uint16) for o in orders], axis=1)
        for i in range(at, at + count):
            if end[i - at] < at + count:
                j = np.arange(end[i - at], at + count)
                j = j[np.bitwise_count(fp[j] ^ fp[i]).sum(1, dtype=np.int64) <= radius]
                if len(j):
                    yield from near(np.full(len(j), i), j, values, at)


def short_links(nodes: DataFrame, similarity: float, most: int = 1024) -> DataFrame:
    """``a, b``: all pairs of nodes of different groups whose ``short`` sets have the similarity; a pair can come more than once.

    ``nodes``: ``node, group, short``. Few shingles make few different bits, so a fingerprint says little about such texts.
    Two sets of that similarity share one of the rarest ``n - ceil(similarity * n) + 1`` shingles of each, so those are
    the shards, and every pair in a shard is compared: shards over ``most`` nodes block against block (`cells`).
    """
    sets = nodes.filter(F.col("short").isNotNull()).select("node", "group", "short")
    places = materialise(sets.select("node", F.explode("short").alias("h")), "simhash-short")
    # Written, so that both sides of the join are plain tables, which Spark can split at a frequent shingle.
    often = places.groupBy(F.col("h").alias("o_h")).agg(F.count("*").alias("often")).filter(F.col("often") > 1)
    often = materialise(often, "simhash-often")
    ranked = places.join(often.hint("merge"), F.col("h") == F.col("o_h"), "left").groupBy(F.col("node").alias("r_node"))
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "h"))).alias("rare"))
    n = F.size("rare")
    first = F.slice("rare", F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int"))
    ranked = ranked.select("r_node", F.explode(F.filter(first, lambda x: x["often"] > 1)).alias("x"))
    dealt = materialise(sets.join(ranked, F.col("node") == F.col("r_node")).select(F.col("x.h").alias("shard"), "node", "group", "short"), "simhash-rare")
    remove(places, often)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, full = 0, 1 << 15
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= full:
                rows = pa.concat_batches(held)
                cut = int(_short_cuts(rows)[-1])  # the last cell goes on in the next batch
                if cut:
                    yield from _short_pairs(rows.slice(0, cut), similarity)
                held, size = [rows.slice(cut)], rows.num_rows - cut
                full = max(1 << 15, 2 * size)
        if size:
            yield from _short_pairs(pa.concat_batches(held), similarity)

    rows = cells(dealt, most).select("shard", "i", "j", "own", "node", "group", "short")
    return through(rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "group"), "a long, b long", search)


def _short_cuts(rows: pa.RecordBatch) -> np.ndarray:
    """Where cells begin."""
    keys = [np.asarray(rows.column(k)) for k in range(3)]
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def _short_pairs(rows: pa.RecordBatch, similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs of whole cells, sorted by cell and group."""
    low, high, own, node, group = (np.asarray(rows.column(k)) for k in range(1, 6))
    size = np.asarray(rows.column(6).value_lengths()).astype(np.int64)
    words, at = np.unique(np.asarray(rows.column(6).flatten()), return_inverse=True)
    ends, has = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(words), bool)
    cuts = _short_cuts(rows)
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), rows.num_rows], strict=True):
        if group[s] == group[e - 1]:
            continue
        for i in range(s, e - 1):
            mine = at[ends[i] : ends[i + 1]]
            has[mine] = True
            both = np.add.reduceat(has[at[ends[i + 1] : ends[e]]], ends[i + 1 : e] - ends[i + 1], dtype=np.int64)
            has[mine] = False
            j = slice(i + 1, e)
            ok = (both >= similarity * (size[i] + size[j] - both)) & (group[j] != group[i]) & ((own[j] != own[i]) | (low[i] == high[i]))
            if ok.any():
                other = node[j][ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(other, node[i])), pa.array(np.minimum(other, node[i]))], names=["a", "b"])


def verified(links: DataFrame, texts: DataFrame, shingle: int, similarity: float, block_bytes: int = 8 << 20) -> DataFrame:
    """The links between texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    ``texts``: ``node, b``, one row a node that has links. Nodes are dealt into blocks by hash, and a link goes to the cell of
    its two blocks. A set goes once to each cell that has links of it, so a node of many links costs at most
    one copy a block. Blocks have sets of about ``block_bytes``, so a cell is bounded whatever the length of texts. Sets
    are of 64-bit hashes of the shingles of whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sets = [shingle_hashes(b.as_py(), shingle).astype("<u8").tobytes() for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's sets come before its links."""
        cell, sets, ids, has = None, {}, {}, np.zeros(0, bool)
        for batch in rows_of(batches, 1 << 16):
            p, q, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            held = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            turn = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (held[1:] != held[:-1])]))
            for s, e in zip(turn.tolist(), [*turn[1:].tolist(), len(p)], strict=True):
                if (p[s], q[s]) != cell:
                    cell, sets, ids = (p[s], q[s]), {}, {}
                if held[s]:
                    sets |= {k: np.frombuffer(v.as_py(), "<u8") for k, v in zip(a[s:e].tolist(), batch.column(2)[s:e], strict=True)}
                    continue
                if not ids:  # shingles of the cell numbered from 0
                    words, at = np.unique(np.concatenate([*sets.values()]), return_inverse=True)
                    ends = np.cumsum([len(v) for v in sets.values()])
                    ids, has = dict(zip(sets, np.split(at, ends[:-1]), strict=True)), np.zeros(len(words), bool)
                x, y = a[s:e], b[s:e]
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                ok = np.zeros(len(x), bool)
                for h, t in zip(heads.tolist(), [*heads[1:].tolist(), len(x)], strict=True):
                    own = ids[x[h]]
                    has[own] = True
                    for k in range(h, t, 1024):
                        other = [ids[v] for v in y[k : min(k + 1024, t)].tolist()]
                        sizes = np.array([len(o) for o in other])
                        sums = np.concatenate([[0], np.cumsum(has[np.concatenate(other)])])
                        ends = np.cumsum(sizes)
                        both = sums[ends] - sums[ends - sizes]
                        ok[k : k + len(other)] = both >= similarity * (len(own) + sizes - both)
                    has[own] = False
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], names=["a", "b"])

    # Repeated rows of a text give the same set.
    sets = through(texts, "node long, set binary", run).groupBy("node").agg(F.first("set").alias("set"))
    sets = materialise(sets, "simhash-sets")
    size = sets.agg(F.sum(F.octet_length("set"))).head()[0] or 0
    blocks = F.lit(max(8, size // block_bytes))
    block = lambda c: F.pmod(F.xxhash64(F.lit("block"), F.col(c)), blocks)
    cells = links.select(block("a").alias("p"), block("b").alias("q"), F.lit(None).cast("binary").alias("set"), "a", "b")
    need = cells.select("p", "q", F.col("a").alias("e")).union(cells.select("p", "q", F.col("b").alias("e"))).distinct()
    sent = need.join(sets, F.col("e") == F.col("node")).select("p", "q", "set", F.col("e").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = sent.union(cells).repartition("p", "q").sortWithinPartitions("p", "q", F.col("set").isNull())
    return through(rows, "a long, b long", compare)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 58, turns: int = 5) -> DataFrame:
    """``node, group, first``: groups of texts that chains of near copies join, and the group's smallest document id.

    One row for each different text (`node_of`). Near copies: a Jaccard similarity of ``similarity`` or more between
    the sets of shingles of lower-cased words. Candidates are found by 256-bit SimHash fingerprints, and every one is
    verified on whole texts: first the nearest in each shard (`nearest_links`), and then all pairs within ``radius`` in a
    shard that are not in one group by then (`crossing_links`). Texts of up to 20 shingles are compared exactly beside
    that, by shared rare shingles (`short_links`). ``radius`` lies three deviations over what
    the similarity makes expect, and ``turns`` of 16 shards each let 997 of 1000 pairs at exactly 0.8 meet, and
    more above it. All texts without words are one group. Null ids take part; ``first`` is null
    where a group has no other.
    """
    base = materialise(wide_fingerprints(docs, id_col, text_col, shingle), "simhash-wide")
    nodes = materialise(base.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first"), F.min("size").alias("size"), F.min("short").alias("short")), "simhash-nodes")

    def check(links: DataFrame) -> DataFrame:
        ends = links.select(F.col("a").alias("e")).union(links.select(F.col("b").alias("e"))).distinct()
        one = nodes.join(ends, F.col("node") == F.col("e"), "left_semi").select(F.col("node").alias("o_node"), "first")
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), node_of(text_col).alias("node"), utf8(text_col).alias("b"))
        texts = texts.join(one, (F.col("node") == F.col("o_node")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "b")
        return materialise(verified(links, texts, shingle, similarity), "simhash-verified")

    def grouped(sure: DataFrame) -> DataFrame:
        linked = components(sure, "simhash-similar").withColumnRenamed("node", "l_node")
        return nodes.join(linked, F.col("node") == F.col("l_node"), "left").withColumn("group", F.coalesce("root", "node"))

    near = materialise(nearest_links(nodes.select("node", "fp"), radius, turns), "simhash-near")
    sure = check(near)
    by_near = materialise(grouped(sure).select("node", "fp", "size", "short", "group"), "simhash-by-near")
    few = materialise(short_links(by_near, similarity), "simhash-few")
    rest = materialise(crossing_links(by_near.drop("short"), radius, turns, similarity), "simhash-crossing")
    more = check(rest)
    found = materialise(grouped(sure.union(more).union(few)).select("node", "first", "group"), "simhash-groups")
    remove(base, nodes, near, sure, by_near, few, rest, more)
    least = found.groupBy(F.col("group").alias("g")).agg(F.min("first").alias("least"))
    return found.join(least, F.col("group") == F.col("g")).select("node", "group", F.col("least").alias("first"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of `similar_groups` one stays, that with the smallest id.

    Of rows that share it, one of the text with the smallest hash stays. Columns are those of ``docs``, whatever their names.
    """
    groups = similar_groups(docs, id_col, text_col, **options)
    base = docs.select(F.col(id_col).cast("long").alias("i"), node_of(text_col).alias("n")).distinct()
    kept = base.join(groups, F.col("n") == F.col("node")).groupBy("group")
    kept = kept.agg(F.min(F.struct(F.col("i").isNull().alias("none"), F.col("i"), F.col("n"))).alias("k")).select(F.col("k.i").alias("k_i"), F.col("k.n").alias("k_n"))
    kept = materialise(kept, "simhash-kept")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), node_of(text_col).alias("n"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(kept, (F.col("n") == F.col("k_n")) & F.col("i").eqNullSafe(F.col("k_i")), "left_semi")
    return rows.dropDuplicates(["n", "i"]).select("row.*")
