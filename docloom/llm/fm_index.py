"""Substring dedup with a compressed FM-index per shard.

FmIndex holds a shard's words: the Burrows-Wheeler transform in a wavelet matrix (bit planes with rank counts, as many as the
shard's alphabet needs), the longest common prefixes of neighbouring suffixes (a byte each) with their previous and next smaller values (the parent
operation), and the document of each suffix, as 32-bit numbers: about 20 bytes a word, the texts themselves aren't kept. Streamed texts are searched backward, thousands of windows in step with each other: a match is extended
to the left as long as it occurs in another document; when it no longer does, it is cut from the right to the parent's
length. These are the matching statistics; stretches of at least MIN_WORDS are reported.

Which text meets which shard: of each MIN_WORDS - GRAM + 1 consecutive word GRAM-grams the smallest hash is an anchor
(winnowing), so every match of MIN_WORDS holds an anchor that both texts have. Where an anchor comes again and again, as in runs of one word, only
as many stay as each match needs to hold one of the same hash. Around an anchor lies a window, as far as
a match of MIN_WORDS with it can reach; every match lies in the windows of its anchors, and what a window holds of it is
never shorter than MIN_WORDS. Windows of one anchor meet in the anchor's shard. Anchors of one document alone are
left out. Windows that agree in several documents as a whole (told by 128 bits of hashes) are results without a
search and are indexed once, if others differ. The number of shards follows from the amount of text; a shard
that is larger than PART_WORDS, for an anchor that very many documents have, is split by documents and searched with all its windows in each part.
No candidate is left out. Words are told by 64 bits of hash, windows by 128, documents by 64 bits of their id and text, and these aren't
verified against the bytes; but for collisions of them the result is exact.

Words are runs of anything but white space, with all their signs. A result is a run of words each of which is part of a
stretch of MIN_WORDS words that another document has too.

Defined cases: null, empty and shorter texts have no results; several rows of one id and one text are one document; rows of
one id with different texts are different documents; repeats within a document alone don't count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import INF, K1, U64, arrow_map, cut, join_checked, mix, room, row_of, shingles, size_of, slices, text_of, word_hashes, word_spans

MIN_WORDS = 50
GRAM = 25
#: Words of a shard, few enough that its arrays stay in a core's cache; and of a part of a shard that is split.
SHARD_WORDS = 1 << 18
PART_WORDS = 1 << 21


class RankBits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones there are before each position."""
        w = i >> 6
        low = (U64(1) << (i & 63).astype(np.uint64)) - U64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    """Occurrences of symbols before positions, in one bit plane a level from the highest bit on."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.planes: list[RankBits] = []
        self.zeros: list[int] = []
        at = np.arange(alphabet)
        begin = np.zeros(alphabet, np.int64)
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            plane = RankBits(bit.astype(np.uint8))
            zeros = int(len(bit) - bit.sum())
            self.planes.append(plane)
            self.zeros.append(zeros)
            one = plane.rank(begin)
            begin = np.where((at >> level) & 1, zeros + one, begin - one)
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        #: Where each symbol's occurrences begin in the last level.
        self.begin = begin

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = self.begin[symbol]
        for k, level in enumerate(range(self.depth - 1, -1, -1)):
            one = self.planes[k].rank(i)
            i = np.where((symbol >> level) & 1, self.zeros[k] + one, i - one)
        return i - start


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for each power of two the suffixes' ranks by so many symbols; by prefix doubling.

    A rank is the place of the first suffix of its group, and only groups of several suffixes are sorted further.
    """
    n = len(text)
    order = np.argsort(text)
    spot = np.arange(n)
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    key, h = text[order], 1
    ranks: list[np.ndarray] = []
    while n:
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        rank[order[spot]] = np.repeat(spot[first], size)
        several = np.repeat(size > 1, size)
        ranks.append(rank.astype(np.int32))
        spot = spot[several]
        if not len(spot):
            break
        mine = order[spot]
        key = rank[mine] * (n + 2) + rank[np.minimum(mine + h, n)] + 1
        sorted_ = np.argsort(key)
        order[spot] = mine[sorted_]
        key = key[sorted_]
        h *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """lcp[i]: symbols that suffixes i-1 and i in order have in common; 0 at both ends (n+1 entries)."""
    n = len(order)
    length = np.zeros(max(n - 1, 0), np.int64)
    a, b = order[:-1], order[1:]
    for j in range(len(ranks) - 1, -1, -1):
        x, y = ranks[j][np.minimum(a + length, n)], ranks[j][np.minimum(b + length, n)]
        length += (x == y).astype(np.int64) << j
    return np.concatenate([[0], length, [0]]) if n else np.zeros(1, np.int64)


def smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry above 0 the nearest earlier and the nearest later one that is smaller, or the first and the last place; by descent over minima of powers of two."""
    n = len(values)
    minima = [values.astype(np.int32)]
    # Nothing smaller is farther away than the longest stretch without a 0.
    farthest = int(np.diff(np.concatenate([[-1], np.flatnonzero(values == 0), [n]])).max())
    while 2 * (half := 1 << (len(minima) - 1)) <= min(n, farthest):
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    v = minima[0]
    left, right = np.arange(n), np.arange(1, n + 1)
    for k in range(len(minima) - 1, -1, -1):
        low, step = minima[k], 1 << k
        at = left - step
        left = np.where((at >= 0) & (low[np.maximum(at, 0)] >= v), at, left)
        ok = right + step <= n
        right = np.where(ok & (low[np.minimum(right, len(low) - 1)] >= v), right + step, right)
    return np.maximum(left - 1, 0), np.minimum(right, n - 1)


class FmIndex:
    """The words of a shard's pieces, with the document of each piece."""

    def __init__(self, words: np.ndarray, first: np.ndarray, docs: np.ndarray, common: np.ndarray | None = None) -> None:
        """words: hashes of all pieces' words; first: each piece's first word and the end; docs: each piece's document; common: which pieces stand for several documents, so that they are another one for each."""
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        #: The symbols of words.
        self.symbols = ids
        pieces, sigma = len(first) - 1, len(self.vocabulary)
        # Each piece ends with a symbol of its own, which no search can cross.
        ends = first[1:] + np.arange(pieces)
        n = len(words) + pieces
        text = np.empty(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = ids
        text[ends] = sigma + np.arange(pieces)
        alphabet = sigma + pieces
        order, ranks = suffix_order(text)
        self.n = n
        self.names, dense = np.unique(docs, return_inverse=True)
        if common is not None:
            dense = np.where(common, len(self.names) + np.arange(pieces), dense)
        self.doc = np.repeat(dense.astype(np.int32), np.diff(first) + 1)[order]
        change = np.append(np.flatnonzero(self.doc[1:] != self.doc[:-1]) + 1, n).astype(np.int32)
        self.other = change[np.searchsorted(change, np.arange(n), "right")] if n else change
        # No prefix is longer than a piece, so that a byte or two hold it.
        lcp = common_prefixes(order, ranks)
        del ranks
        self.lcp = lcp.astype(np.min_scalar_type(int(lcp.max(initial=0))))
        self.left, self.right = (x.astype(np.int32) for x in smaller(lcp))
        del lcp
        self.matrix = WaveletMatrix(text[order - 1], alphabet)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])

    def number(self, words: np.ndarray) -> np.ndarray:
        """The words' symbols, -1 for those that the shard doesn't have."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def document(self, names: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)

    def matches(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window symbols[begin:end] of document doc: the maximal matches of at least ``least`` words in other documents.

        Gives the windows' numbers, and the matches' first and behind-last positions in symbols.
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(end > begin)
        at, first, d = end[live] - 1, begin[live], doc[live]
        lo, hi, length = np.zeros(len(live), np.int64), np.full(len(live), self.n), np.zeros(len(live), np.int64)

        def report(i: np.ndarray) -> None:
            if len(i):
                out.append((live[i], at[i] + 1, at[i] + 1 + length[i]))

        while len(live):
            c = symbols[at]
            known = np.maximum(c, 0)
            m = len(live)
            both = self.matrix.occurrences(np.concatenate([known, known]), np.concatenate([lo, hi])) + np.concatenate([self.start[known]] * 2)
            x, y = both[:m], both[m:]
            ok = (c >= 0) & (y > x)
            near = np.minimum(x, self.n - 1)
            ok &= (self.doc[near] != d) | (self.other[near] < y)
            fail = np.flatnonzero(~ok)
            report(fail[length[fail] >= least])
            # To the parent; what is already empty skips the word, as does all for a word that the shard lacks.
            skip = fail[(length[fail] == 0) | (c[fail] < 0)]
            l, h = lo[fail], hi[fail]
            left, right = self.lcp[l], self.lcp[h]
            short = np.maximum(left, right)
            lo[fail] = np.where((left == short) & (short > 0), self.left[l], l)
            hi[fail] = np.where((right == short) & (short > 0), self.right[h], h)
            root = fail[short == 0]
            lo[root], hi[root] = 0, self.n
            length[fail] = short
            lo[skip], hi[skip], length[skip] = 0, self.n, 0
            lo[ok], hi[ok] = x[ok], y[ok]
            length[ok] += 1
            at[ok] -= 1
            at[skip] -= 1
            # What a window's matches can still hold is too short once they end before its first ``least`` words do.
            over = (at < first) | (at + 1 + length < first + least)
            if over.any():
                report(np.flatnonzero(over & (length >= least)))
                keep = ~over
                live, at, first, d, lo, hi, length = (v[keep] for v in (live, at, first, d, lo, hi, length))
        z = np.zeros(0, np.int64)
        return tuple(np.concatenate(v) for v in zip(*out)) if out else (z, z, z)


def anchors(words: np.ndarray, first: np.ndarray, least: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions in their row and hashes of the anchors: the smallest of each least - gram + 1 consecutive gram hashes."""
    w = least - gram + 1
    left, row = room(first), row_of(first)
    n = len(words)
    if n < w:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    h = shingles(words, gram)
    h[left < gram] = INF

    def window(op: np.ufunc, v: np.ndarray) -> np.ndarray:
        """op over v[i : i + w]."""
        size, m = 1, v
        while 2 * size <= w:
            m = op(m[:-size], m[size:])
            size *= 2
        return op(m[: n - w + 1], m[w - size : w - size + n - w + 1]) if w > size else m

    low = window(np.minimum, h)
    low[left[: len(low)] < least] = 0  # windows that leave their row
    pad = np.zeros(w - 1, np.uint64)
    n += w - 1
    high = window(np.maximum, np.concatenate([pad, low, pad]))[: len(words)]
    at = np.flatnonzero((high == h) & (h != INF))
    at = at[thinned(row[at], at, h[at], w)]
    return row[at], at - first[row[at]], h[at]


def thinned(row: np.ndarray, at: np.ndarray, h: np.ndarray, w: int) -> np.ndarray:
    """Which anchors stay where one hash comes again and again, as in a run of one word: of such a chain the first, the last and as many between them as leave no gap above w.

    Any w consecutive positions that hold one of a chain so hold one that stays, and equal stretches of two texts still meet by their hash, if not at the same place.
    """
    if not len(at):
        return np.zeros(0, bool)
    gap = np.diff(at)
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (gap > w))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    widest = np.maximum.reduceat(np.where(new, 1, np.append(1, gap)), start)
    nth = np.arange(len(at)) - np.repeat(start, size)
    return (nth % np.repeat(w // widest, size) == 0) | np.append(new[1:], True)


def window_hashes(words: np.ndarray, first: np.ndarray, row: np.ndarray, pos: np.ndarray, reach: int, gram: int) -> np.ndarray:
    """Of each anchor a hash of its window's words and of where it lies in it; by differences of polynomial sums."""
    n = len(words)
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, K1))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])
    size = np.diff(first)[row]
    a, b = np.maximum(pos - reach, 0), np.minimum(pos + gram + reach, size)
    x, y = first[row] + a, first[row] + b
    return mix((sums[y] - sums[x]) * power[n - x] + mix(((b - a) * 4096 + pos - a).astype(np.uint64)))


def _anchors(least: int, gram: int):
    reach = least - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(batch.column("_t"))
            for a, b in slices(offsets):
                d = data[offsets[a] : offsets[b]]
                starts, ends, first = word_spans(d, offsets[a : b + 1] - offsets[a])
                words = word_hashes(d, starts, ends)
                row, pos, h = anchors(words, first, least, gram)
                win = window_hashes(words, first, row, pos, reach, gram)
                size = np.diff(first)[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_d").take(pa.array(row + a)), pa.array(np.maximum(pos - reach, 0).astype(np.int32)), pa.array(np.minimum(pos + gram + reach, size).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(win.view(np.int64))],
                    ["_d", "_from", "_to", "_anchor", "_win"],
                )

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the windows out of the texts."""
    for batch in batches:
        data, offsets = text_of(batch.column("_t"))
        docs, spans = batch.column("_d"), batch.column("_spans")
        flat, ends_of = spans.flatten(), np.concatenate([[0], np.cumsum(spans.value_lengths().to_numpy())])
        x, y = (flat.field(c).to_numpy() for c in ("_from", "_to"))
        texts: list[bytes] = []
        for i in range(batch.num_rows):
            d = data[offsets[i] : offsets[i + 1]]
            starts, ends, _ = word_spans(d, np.array([0, len(d)]))
            raw, at = d.tobytes(), slice(ends_of[i], ends_of[i + 1])
            texts += [raw[p:q] for p, q in zip(starts[x[at]].tolist(), ends[y[at] - 1].tolist())]
        owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends_of)))
        yield pa.RecordBatch.from_arrays([docs.take(owner), pa.array(x), *(flat.field(c) for c in ("_anchor", "_common")), pa.array(texts, pa.binary())], ["_d", "_from", "_anchor", "_common", "_text"])


def _runs(docs: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Intervals of documents, those that overlap or touch as one."""
    order = np.lexsort((x, docs))
    names, d = np.unique(docs[order], return_inverse=True)
    # Documents after each other on one line, so that one running maximum does for all.
    shift = d * (np.int64(1) << 32)
    a, b = x[order] + shift, y[order] + shift
    top = np.maximum.accumulate(b)
    new = np.flatnonzero(np.append(True, a[1:] > top[:-1]))
    last = np.append(new[1:], len(a)) - 1
    return pa.RecordBatch.from_arrays([pa.array(names[d[new]]), pa.array((a[new] - shift[new]).astype(np.int32)), pa.array((top[last] - shift[new]).astype(np.int32))], ["_d", "_from", "_to"])


def _search(least: int):
    def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_of(texts)
        words, counts = [], [np.zeros(1, np.int64)]
        for a, b in slices(offsets):
            d = data[offsets[a] : offsets[b]]
            starts, ends, first = word_spans(d, offsets[a : b + 1] - offsets[a])
            words.append(word_hashes(d, starts, ends))
            counts.append(np.diff(first))
        return np.concatenate(words) if words else np.zeros(0, np.uint64), np.cumsum(np.concatenate(counts))

    def search(index: FmIndex, symbols: np.ndarray, first: np.ndarray, docs: np.ndarray, start: np.ndarray, which: np.ndarray) -> pa.RecordBatch | None:
        s, x, y = index.matches(symbols, first[:-1][which], first[1:][which], index.document(docs[which]), least)
        if not len(s):
            return None
        p = which[s]
        shift = start[p] - first[p]
        return _runs(docs[p], x + shift, y + shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index = None, [], None

        def load(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
            t = pa.Table.from_batches(parts)
            return *words_of(t.column("_text")), t.column("_d").to_numpy(), t.column("_from").to_numpy().astype(np.int64), t.column("_common").to_numpy()

        def build() -> Iterator[pa.RecordBatch]:
            nonlocal index, held
            words, first, docs, start, common = load(held)
            held = []
            index = FmIndex(words, first, docs, common)
            if (out := search(index, index.symbols, first, docs, start, np.flatnonzero(~common))) is not None:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("_shard", "_part", "_guest")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                here, guest = tuple(keys[:2, a]), keys[2, a]
                if here != shard:
                    if held:
                        yield from build()
                    shard, index = here, None
                if not guest:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    yield from build()
                if index is not None:
                    words, first, docs, start, _ = load([batch.slice(a, b - a)])
                    if (out := search(index, index.number(words), first, docs, start, np.arange(len(docs)))) is not None:
                        yield out
        if held:
            yield from build()

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """The runs of words that other documents have too: doc_id, start_word, end_word (behind the last), n_words."""
    names = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    texts = names.withColumn("_d", F.xxhash64("_id", "_t")).select("_id", "_d", "_t")
    marks = arrow_map(texts.select("_d", "_t"), _anchors(least, gram), "_d bigint, _from int, _to int, _anchor bigint, _win bigint").repartition("_anchor")
    same, meet = Window.partitionBy("_anchor", "_win"), Window.partitionBy("_anchor")
    marks = marks.withColumn("_same", F.min("_d").over(same) != F.max("_d").over(same)).withColumn("_n", F.row_number().over(same.orderBy("_d", "_from")))
    marks = marks.withColumn("_meet", F.min("_d").over(meet) != F.max("_d").over(meet)).withColumn("_open", F.max(~F.col("_same")).over(meet))
    marks = cut(marks.where("_meet").select("_d", "_from", "_to", "_anchor", "_same", (~F.col("_same") | ((F.col("_n") == 1) & F.col("_open"))).alias("_cut")))
    done = marks.where("_same").select("_d", "_from", "_to")
    spans = marks.where("_cut")
    total = spans.agg(F.sum(F.col("_to") - F.col("_from"))).first()[0]
    placed = spans.groupBy("_d").agg(F.collect_list(F.struct("_from", "_to", "_anchor", F.col("_same").alias("_common"))).alias("_spans"))
    wanted = cut(spans.select(F.col("_d").alias("_w")).distinct())
    # Of the texts without windows nothing is moved, as long as the list of those with windows is short.
    some = join_checked(texts.select("_d", "_t"), wanted, F.col("_d") == F.col("_w"), "left_semi", size_of(wanted)).dropDuplicates(["_d"])
    windows = arrow_map(some.join(placed, "_d").select("_d", "_t", "_spans"), _windows, "_d bigint, _from int, _anchor bigint, _common boolean, _text binary")
    shard = F.pmod(F.xxhash64("_anchor"), F.lit(max(1, -(-(total or 0) // shard_words)))).cast("int")
    parts = cut(spans.groupBy(shard.alias("_shard")).agg(F.ceil(F.sum(F.col("_to") - F.col("_from")) / part_words).cast("int").alias("_parts")).where("_parts > 1"))
    windows = windows.withColumn("_shard", shard)
    if n_parts := size_of(parts):
        windows = join_checked(windows, parts, "_shard", "left", n_parts)
        own = F.pmod("_d", F.coalesce("_parts", F.lit(1))).cast("int")
        windows = windows.withColumn("_own", own).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).where("_part = _own or not _common").withColumn("_guest", (F.col("_part") != F.col("_own")).cast("int"))
    else:
        windows = windows.withColumn("_part", F.lit(0)).withColumn("_guest", F.lit(0))
    rows = windows.select("_shard", "_part", "_guest", "_d", "_from", "_common", "_text").repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", "_guest")
    hits = arrow_map(rows, _search(least), "_d bigint, _from int, _to int").unionByName(done)
    w = Window.partitionBy("_d").orderBy("_from", "_to")
    runs = hits.withColumn("_new", (F.col("_from") > F.coalesce(F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_d", "_run").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    runs = cut(runs)
    named = join_checked(names.select("_id", F.xxhash64("_id", "_t").alias("_nd")), runs, F.col("_nd") == F.col("_d"), "inner", size_of(runs))
    return named.select(F.col("_id").alias("doc_id"), F.col("_from").alias("start_word"), F.col("_to").alias("end_word"), (F.col("_to") - F.col("_from")).alias("n_words")).distinct()
