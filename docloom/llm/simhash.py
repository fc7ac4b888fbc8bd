"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: 256 bits, each the sign of a sum over a text's distinct pairs of neighbouring words; a sum of 0 takes the
bit of the pair with the smallest hash, so that ties fall to either side and near copies break them alike. Texts with equal
fingerprints are one node from then on. Candidates: two nodes are compared if they share a key; keys are minima of
hashes over the text's word 5-grams (one each) and 3-grams (two each). Rows sorted by key are packed 64 to a lane
group whose fingerprints are stored as 256 vertical bit planes, one word a plane. A query's differences to the 64 lanes
are added plane by plane in carry-save counters, also vertical, for many (query, lane group) blocks at once; a block
is abandoned as soon as all its lanes exceed the radius. Of pairs within the radius, those beyond SURE bits are verified
by the Jaccard similarity of their distinct word pairs, which must be at least SIMILARITY. What is left is joined to groups
(connected components), of which the smallest id stays.

Key runs longer than TILE_ROWS are split into tiles that are compared pair by pair, so that none is bounded or dropped.
Candidate search is approximate (recall is tested against all pairs); distances and similarities are exact.

Defined cases: null, empty and white-space texts have no fingerprint and are never near copies; repeated rows count as one
node and one of them stays; other columns are ignored here and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import (
    INF,
    K1,
    U64,
    arrow_map,
    cut,
    fixed_binary,
    join_checked,
    keep_one,
    mix,
    reduce_rows,
    room,
    row_of,
    shingles,
    size_of,
    slices,
    text_of,
    word_hashes,
    word_spans,
)

BITS = 256
#: Two texts are near copies if their distinct word pairs have at least this Jaccard similarity.
SIMILARITY = 0.6
#: Pairs that differ in more of the 256 bits aren't looked at; of 0.6 it is 59 bits on average, and at most 72 in 97 of 100 pairs.
RADIUS = 72
#: Pairs that differ in no more bits need no verification: of 0.6 that is 4 standard deviations off.
SURE = 32
#: Keys from 5-grams, of one minimum each, and from 3-grams, of two each.
LONG_KEYS, SHORT_KEYS = 8, 6
TILE_ROWS = 8192
#: Blocks that are compared at a time.
BLOCKS = 1 << 14

_SEEDS = mix(np.arange(1, 64, dtype=np.uint64) * K1)
#: For each byte its 8 bits as 16-bit lanes of two words.
_SPREAD = np.zeros((256, 2), np.uint64)
for _i in range(8):
    _SPREAD[:, _i // 4] |= ((np.arange(256, dtype=np.uint64) >> U64(_i)) & U64(1)) << U64(16 * (_i % 4))


def fingerprints(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 32) bytes: the signs of the sums over each row's hashes, repeated ones included as often as they are given."""
    n = np.diff(first)
    least = reduce_rows(np.minimum, grams, first, U64(0))
    out = np.zeros((len(n), BITS // 8), np.uint8)
    # 16-bit lanes overflow beyond 65535 hashes: longer rows are summed in parts.
    parts = np.unique(np.concatenate([first, np.arange(0, first[-1], 32768)]))
    owner = np.searchsorted(first, parts[:-1], "right") - 1
    for w in range(BITS // 64):
        h = mix(grams ^ _SEEDS[w])
        tie = mix(least ^ _SEEDS[w])
        for b in range(8):
            byte = ((h >> U64(8 * b)) & U64(255)).astype(np.intp)
            for half in range(2):
                sums = np.add.reduceat(_SPREAD[:, half][byte], parts[:-1]) if len(byte) else np.zeros(0, np.uint64)
                for lane in range(4):
                    count = np.bincount(owner, weights=((sums >> U64(16 * lane)) & U64(0xFFFF)).astype(np.float64), minlength=len(n))
                    own = (tie >> U64(8 * b + 4 * half + lane)) & U64(1)
                    out[:, 8 * w + b] |= (2 * count + own > n).astype(np.uint8) << np.uint8(4 * half + lane)
    return out


def _distinct(grams: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, and each row's first."""
    order = np.lexsort((grams, row))
    g, r = grams[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return g[new], np.searchsorted(r[new], np.arange(rows + 1))


def _grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's word k-grams, or the one shorter gram that a shorter row is; and each row's first."""
    left, row = room(first), row_of(first)
    ok = left >= k
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    g, r = shingles(words, k)[ok], row[ok]
    if len(short):
        whole = np.array([mix(words[first[i] : first[i + 1]] + np.arange(n[i], dtype=np.uint64) * K1).sum(dtype=np.uint64) for i in short], np.uint64)
        g, r = np.concatenate([g, whole]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    return g, np.searchsorted(r, np.arange(len(n) + 1))


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: whether it has words, its fingerprint, its keys."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    rows = len(offsets) - 1
    pairs, pf = _grams(words, first, 2)
    prints = fingerprints(*_distinct(pairs, row_of(pf), rows))
    keys = np.empty((rows, LONG_KEYS + SHORT_KEYS), np.uint64)
    g, f = _grams(words, first, 5)
    for j in range(LONG_KEYS):
        keys[:, j] = reduce_rows(np.minimum, mix(g ^ _SEEDS[8 + j]), f, INF) + U64(j)
    g, f = _grams(words, first, 3)
    for j in range(SHORT_KEYS):
        a = reduce_rows(np.minimum, mix(g ^ _SEEDS[20 + 2 * j]), f, INF)
        b = reduce_rows(np.minimum, mix(g ^ _SEEDS[21 + 2 * j]), f, INF)
        keys[:, LONG_KEYS + j] = mix(a * K1 + b + U64(j))
    return np.diff(first) > 0, prints, keys


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_of(batch.column("_t"))
        for a, b in slices(offsets):
            has, prints, keys = signatures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = np.flatnonzero(has)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys[at].ravel().view(np.int64)))
            take = pa.array(at + a)
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(take), batch.column("_k").take(take), fixed_binary(prints[at]), lists], ["_id", "_k", "_print", "_keys"])


def planes(prints: np.ndarray) -> np.ndarray:
    """Vertical storage: (lane groups of 64 rows, 256) words; bit r of word p of a group is bit p of its row r."""
    n = -(-len(prints) // 64) * 64
    bits = np.zeros((n, BITS), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints, axis=1, bitorder="little")
    packed = np.packbits(bits.reshape(-1, 64, BITS), axis=1, bitorder="little")  # (groups, 8, 256)
    return np.ascontiguousarray(packed.transpose(0, 2, 1)).view("<u8")[:, :, 0]


def _exceed(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose vertical counter is greater than radius."""
    more, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            more = more | (equal & counters[i])
            equal = equal & ~counters[i]
    return more


def within(vertical: np.ndarray, bits: np.ndarray, query: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Of each block (query row, lane group): the lanes within the radius. bits: (256, rows) of 0 or 1 as all-zero or all-one words."""
    out = np.zeros(len(query), np.uint64)
    live = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(BITS.bit_length())]
    for start in range(0, BITS, 32):
        q, g = query[live], group[live]
        carried: list[list[np.ndarray]] = [[] for _ in range(len(counters) + 1)]
        for p in range(start, start + 32):
            carried[0].append(vertical[p][g] ^ bits[p][q])
            level = 0
            while len(carried[level]) == 2:  # a full adder: two words of this weight and the counter's give one, and a carry
                x, y = carried[level]
                c = counters[level]
                u = x ^ y
                carry = (x & y) | (u & c)
                counters[level] = u ^ c
                carried[level] = []
                level += 1
                if level >= len(counters):
                    break
                carried[level].append(carry)
        for level in range(len(counters)):  # what is left over: half adders
            for x in carried[level]:
                for i in range(level, len(counters)):
                    carry = counters[i] & x
                    counters[i] = counters[i] ^ x
                    x = carry
        over = _exceed(counters, radius)
        keep = over != INF
        if not keep.all():
            live, over = live[keep], over[keep]
            counters = [c[keep] for c in counters]
        if not len(live):
            return out
    out[live] = ~over
    return out


def close_pairs(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), i < j, lo[i] <= j < hi[i], whose fingerprints differ in at most ``radius`` bits."""
    vertical = np.ascontiguousarray(planes(prints).T)
    bits = np.ascontiguousarray(np.unpackbits(prints, axis=1, bitorder="little").T).astype(np.uint64)
    bits = np.where(bits > 0, INF, U64(0))
    rows = np.arange(len(prints))
    lo = np.maximum(lo, rows + 1)
    a, b = lo // 64, np.maximum(-(-hi // 64), lo // 64)
    count = np.where(hi > lo, b - a, 0)
    total = np.cumsum(count)
    found_i, found_j = [], []
    for start in range(0, int(total[-1]) if len(total) else 0, BLOCKS):
        job = np.arange(start, min(start + BLOCKS, int(total[-1])))
        q = np.searchsorted(total, job, "right")
        g = a[q] + job - (total[q] - count[q])
        lanes = within(vertical, bits, q, g, radius)
        hit = np.flatnonzero(lanes)
        if len(hit):
            on = np.unpackbits(lanes[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(on)
            i, j = q[hit[r]], g[hit[r]] * 64 + lane
            ok = (j >= lo[i]) & (j < hi[i])
            found_i.append(i[ok])
            found_j.append(j[ok])
    z = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (z, z)


def spanning(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same components, each to its smallest member."""
    nodes, inv = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = inv[: len(i)], inv[len(i) :]
    root = np.arange(len(nodes))
    while True:
        m = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], m)
        np.minimum.at(new, root[y], m)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[at], nodes[root[at]]


def _root_of(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The root y of each node that is among the sorted x; others are their own."""
    at = np.minimum(np.searchsorted(x, nodes), len(x) - 1)
    return np.where(x[at] == nodes, y[at], nodes)


#: Rows of sorted keys that are packed to lane groups at a time; a longer run is taken whole.
PACK_ROWS = 1 << 15


def _compare(radius: int):
    def emit(rows: pa.Table) -> pa.RecordBatch | None:
        key = np.stack([rows.column(c).to_numpy() for c in ("_key", "_a", "_b")])
        prints = np.frombuffer(b"".join(rows.column("_print").to_pylist()), np.uint8).reshape(-1, BITS // 8)
        nodes = rows.column("_node").to_numpy()
        new = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        run = np.repeat(np.arange(len(new)), np.diff(np.append(new, key.shape[1])))
        hi = np.append(new, key.shape[1])[1:][run]
        i, j = close_pairs(prints, np.zeros(len(prints), np.int64), hi, radius)
        ok = nodes[i] != nodes[j]
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        sure = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= SURE
        i, j = nodes[i], nodes[j]
        x, y = spanning(i[sure], j[sure])
        # Of the others, those that sure ones have joined already need no verification.
        u, v = np.minimum(i, j)[~sure], np.maximum(i, j)[~sure]
        if len(u) and len(x):
            to = np.stack([_root_of(u, x, y), _root_of(v, x, y)])
            u, v = u[to[0] != to[1]], v[to[0] != to[1]]
        u, v = np.unique(np.stack([u, v]), axis=1)
        kind = np.repeat([True, False], [len(x), len(u)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, u])), pa.array(np.concatenate([y, v])), pa.array(kind)], ["_x", "_y", "_sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < PACK_ROWS:
                continue
            t = pa.Table.from_batches(held)
            last = [t.column(c)[-1].as_py() for c in ("_key", "_a", "_b")]
            same = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("_key", "_a", "_b"), last)])
            n = len(same) - int(np.argmax(~same[::-1])) if not same.all() else 0
            if n and (out := emit(t.slice(0, n))) is not None:
                yield out
            held = t.slice(n).combine_chunks().to_batches()
            size = t.num_rows - n
        if held and (out := emit(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def components(edges: DataFrame) -> DataFrame:
    """Rows _x, _root: each node of the edges (_x, _y) with the smallest node of its connected component.

    Alternating large-star and small-star steps, each cut to the checkpoint folder, until nothing changes.
    """
    e = cut(edges.select(F.greatest("_x", "_y").alias("_x"), F.least("_x", "_y").alias("_y")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("_y").alias("_x"), F.col("_x").alias("_y")))
        low = both.groupBy("_x").agg(F.least(F.min("_y"), F.col("_x")).alias("_m"))
        large = both.join(low, "_x").where("_y > _x").select(F.col("_y").alias("_x"), F.col("_m").alias("_y")).where("_x != _y").distinct()
        low = large.groupBy("_x").agg(F.min("_y").alias("_m"))
        small = large.join(low, "_x").select(F.explode(F.array(F.struct(F.col("_y").alias("_x"), F.col("_m").alias("_y")), F.struct(F.col("_x").alias("_x"), F.col("_m").alias("_y")))).alias("_e")).select("_e.*").where("_x != _y").distinct()
        new = cut(small)
        same = new.agg(F.count("*"), F.sum(F.xxhash64("_x", "_y").cast("decimal(38,0)"))).first()
        was = e.agg(F.count("*"), F.sum(F.xxhash64("_x", "_y").cast("decimal(38,0)"))).first()
        e = new
        if same == was:
            return e.withColumnRenamed("_y", "_root")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct word pairs, as hashes."""
    for batch in batches:
        data, offsets = text_of(batch.column("_t"))
        for a, b in slices(offsets):
            starts, ends, first = word_spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            pairs, pf = _grams(word_hashes(data[offsets[a] : offsets[b]], starts, ends), first, 2)
            pairs, pf = _distinct(pairs, row_of(pf), b - a)
            yield pa.RecordBatch.from_arrays([batch.column("_node").slice(a, b - a), pa.ListArray.from_arrays(pa.array(pf.astype(np.int32)), pa.array(pairs.view(np.int64)))], ["_node", "_set"])


def _verified(pairs: DataFrame, texts: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (_x, _y) of nodes whose texts are similar; of each node's texts one is compared."""
    pairs = cut(pairs)
    n = pairs.count()
    if not n:
        return pairs
    nodes = cut(pairs.select(F.col("_x").alias("_node")).union(pairs.select("_y")).distinct())
    one = cut(join_checked(members, nodes, "_node", "inner", size_of(nodes)).groupBy("_node").agg(F.min("_k").alias("_k")))
    found = join_checked(texts.select("_k", "_t"), one, "_k", "inner", size_of(one)).select("_node", "_t").dropDuplicates(["_node"])
    sets = cut(arrow_map(found, _sets, "_node bigint, _set array<bigint>"))
    a, b = (sets.select(F.col("_node").alias(c), F.col("_set").alias(f"_s{c}")) for c in ("_x", "_y"))
    both = pairs.join(a, "_x").join(b, "_y").withColumn("_n", F.size(F.array_intersect("_s_x", "_s_y")))
    return both.where(F.col("_n") >= SIMILARITY * (F.size("_s_x") + F.size("_s_y") - F.col("_n"))).select("_x", "_y")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows _id, _k, _keep, _rows, _keep_id: the members of each group of near copies, as keep_one() takes them."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_k"), F.col(text_col).alias("_t"))
    signed = cut(arrow_map(texts, _sign, f"_id {id_type}, _k bigint, _print binary, _keys array<bigint>"))
    # A node is a fingerprint; two that shared this hash would only be compared with others as one.
    node = F.xxhash64("_print").alias("_node")
    nodes = signed.select(node, "_print", F.explode("_keys").alias("_key")).distinct()
    heavy = cut(signed.select(node, F.explode("_keys").alias("_key")).groupBy("_key").agg(F.approx_count_distinct("_node").alias("_n")).where(F.col("_n") > TILE_ROWS).select(F.col("_key"), F.ceil(F.col("_n") / TILE_ROWS).cast("int").alias("_tiles")))
    n_heavy = size_of(heavy)
    if n_heavy:
        tiled = join_checked(nodes, heavy, "_key", "left", n_heavy).withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
        own = F.pmod(F.xxhash64("_node", F.lit(7)), F.col("_tiles")).cast("int")
        nodes = tiled.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).select("_key", "_node", "_print", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"))
    else:
        nodes = nodes.select("_key", "_node", "_print", F.lit(0).alias("_a"), F.lit(0).alias("_b"))
    sorted_keys = nodes.repartition("_key", "_a", "_b").sortWithinPartitions("_key", "_a", "_b", "_node")
    edges = cut(arrow_map(sorted_keys, _compare(radius), "_x bigint, _y bigint, _sure boolean"))
    open_pairs = edges.where("not _sure").select("_x", "_y").distinct()
    roots = components(edges.where("_sure").select("_x", "_y").unionByName(_verified(open_pairs, texts, signed.select(node, "_k"))))
    members = signed.groupBy("_id", "_k", node).agg(F.count("*").alias("_rows"))
    copied = members.groupBy("_node").agg(F.sum("_rows").alias("_n")).where("_n > 1").select("_node")
    reach = cut(copied.join(roots.withColumnRenamed("_x", "_node"), "_node", "full").select("_node", F.coalesce("_root", "_node").alias("_root")).unionByName(roots.select(F.col("_root").alias("_node"), "_root")).distinct())
    members = join_checked(members, reach, "_node", "inner", size_of(reach))
    first = members.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_k").alias("k"))).alias("_first"))
    members = members.join(first, "_root")
    return members.select("_id", "_k", (F.col("_id").eqNullSafe(F.col("_first.id")) & (F.col("_k") == F.col("_first.k"))).alias("_keep"), "_rows", F.col("_first.id").alias("_keep_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each document that is in a group of near copies and isn't its smallest id: doc_id, keep_doc_id."""
    return groups(docs, id_col, text_col, radius).where("not _keep").select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_doc_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near copies; all columns as they came."""
    return keep_one(docs, groups(docs, id_col, text_col, radius), id_col, text_col)
