"""SentencePiece encoding and decoding of a merge-type (BPE) model with byte fallback.

A sequence of pieces is the one that merging gives if and only if every two neighbours stay as they are when their joint
text is merged again. The encoder therefore walks over a text with the longest matches of an Aho-Corasick automaton and
keeps a match if it is compatible with the piece before it, which re-merging the two decides: the later of their last
merges is undone again and again, and no merge across their border may have come before it. Else it takes the next
shorter piece that is a prefix, and if none is left it backtracks and marks the position in a bitfield of positions from
which no encoding continues, so that no position is tried again.

Texts are first split where no piece of the vocabulary can lie across: before blanks, beside signs that no piece has next to
anything else, and between two characters that no piece holds next to each other. Of a slice of texts the distinct parts are
found by Arrow's dictionary encoding (exact) and walked over together: every step, of the automaton as well as of the walk, is
a few numpy operations over all parts that aren't through. Parts without any border for LONG characters are walked over one by
one, as are those that take very many steps. A character that is no piece becomes its UTF-8 bytes' pieces. Pieces are numbered by rank, characters first, so that of
two the later merge has the larger number.

Defined cases: a null text gives null; an empty one no pieces, and decodes to the empty text; as in the model itself, a text's "▁" can't be told from
a blank afterwards, so that decoding gives a blank; bytes that are no UTF-8 count as U+FFFD, and such a text has no round trip; texts of any length are
taken whole; repeated rows are encoded alike; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_map, slices, text_of

SPACE = "▁"
#: Parts with more characters are walked over one by one, and so are the last FEW parts that are left of a slice.
LONG, FEW = 64, 12
#: Bytes of text that are encoded, or pieces that are decoded, at a time; a longer text comes alone.
SLICE = 1 << 20
#: Pairs of pieces of which the walk one by one remembers whether they are compatible.
REMEMBER = 1 << 15


class Pairs:
    """A map from pairs of small numbers to numbers, as arrays: an open hash table that is asked for many pairs at once."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: np.ndarray, width: int) -> None:
        key = a.astype(np.int64) * width + b
        self.width, self.bits = width, max(4, int(4 * len(key)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(key))
        at = self._slot(key)
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = key[left[free]]  # of several one stays; the others find it taken
            own = self.keys[at[left]] == key[left]
            self.values[at[left[own]]] = value[left[own]]
            left = left[~own]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of the pairs, or -1."""
        key = a.astype(np.int64) * self.width + b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def _merge(rank: dict[str, float], text: str, log: list) -> list[str]:
    """The pieces by merging: again and again the best-scored neighbours, the leftmost of equals. log: gets the merges."""
    at = list(text)
    while True:
        best = max(((rank[a + b], -i) for i, (a, b) in enumerate(zip(at, at[1:])) if a + b in rank), default=None)
        if best is None:
            return at
        i = -best[1]
        log.append((at[i], at[i + 1]))
        at[i : i + 2] = [at[i] + at[i + 1]]


def automaton(pieces: list[tuple[str, int]], char: dict[str, int]) -> dict:
    """The Aho-Corasick automaton of pieces (text, number) as arrays: edges (state, character, state), each state's failure link, piece or -1, and next state with a piece on its way of failure links, or 0."""
    edges: list[dict[int, int]] = [{}]
    piece = [-1]
    for p, k in pieces:
        s = 0
        for c in p:
            c = char[c]
            if c not in edges[s]:
                edges[s][c] = len(edges)
                edges.append({})
                piece.append(-1)
            s = edges[s][c]
        piece[s] = k
    fail, more = [0] * len(edges), [0] * len(edges)
    queue = list(edges[0].values())
    for s in queue:  # it grows: breadth first
        more[s] = fail[s] if piece[fail[s]] >= 0 else more[fail[s]]
        for c, to in edges[s].items():
            f = fail[s]
            while f and c not in edges[f]:
                f = fail[f]
            fail[to] = edges[f].get(c, 0)
            queue.append(to)
    flat = [(s, c, to) for s, e in enumerate(edges) for c, to in e.items()]
    return {"edges": np.array(flat, np.int64).reshape(-1, 3), "fail": np.array(fail, np.int32), "piece": np.array(piece, np.int32), "more": np.array(more, np.int32)}


def tables(model: bytes) -> dict:
    """Of a model what the codec needs, as arrays that can be broadcast (their size is the vocabulary's); worked out once, on the driver."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(len(pieces))]
    ids = {p: i for i, p in enumerate(pieces) if not special[i]}
    rank = {p: sp.get_score(i) for p, i in ids.items()}
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece of this model has a blank inside")
    if missing := {c for p in ids for c in p} - ids.keys():
        raise ValueError(f"characters of pieces that are no pieces: {sorted(missing)[:10]}")
    names = sorted(ids, key=lambda p: (len(p) > 1, -rank[p]))
    order = {p: k for k, p in enumerate(names)}
    # Only pieces that merging their own text gives can occur; the last merge has two halves.
    left, right = np.arange(len(names), dtype=np.int32), np.arange(len(names), dtype=np.int32)
    whole = []
    for p in names:
        log: list[tuple[str, str]] = []
        if len(p) == 1:
            whole.append(p)
        elif _merge(rank, p, log) == [p]:
            whole.append(p)
            left[order[p]], right[order[p]] = order[log[-1][0]], order[log[-1][1]]
    able = set(whole)
    shorter = [next((order[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in able), -1) for p in names]
    joint = np.array([(order[p[:i]], order[p[i:]], order[p]) for p in names for i in range(1, len(p)) if p[:i] in order and p[i:] in order], np.int64).reshape(-1, 3)
    beside = {p[i : i + 2] for p in names for i in range(len(p) - 1)}
    # Signs that no piece has beside any other character: between them and others there is a certain border.
    signs = set(string.punctuation + "\n\t\r")
    while bad := {x for a, b in beside for x, y in ((a, b), (b, a)) if x in signs and y not in signs and y != SPACE}:
        signs -= bad
    return {
        "automaton": automaton([(p, order[p]) for p in whole], order),
        "chars": np.array([ord(p) for p in names if len(p) == 1], np.int64),
        "id": np.array([ids[p] for p in names], np.int32),
        "length": np.array([len(p) for p in names], np.int64),
        "left": left,
        "right": right,
        "shorter": np.array(shorter, np.int32),
        "joint": joint,
        "beside": np.array([(order[a], order[b]) for a, b in beside], np.int64).reshape(-1, 2),
        "signs": np.array([ord(x) for x in signs], np.int64),
        "byte_ids": np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32),
        "bytes": [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)],
    }


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each i, counts[i] of them, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, given: dict) -> None:
        self.id, self.length, self.left, self.right, self.shorter, self.byte_ids = (given[k] for k in ("id", "length", "left", "right", "shorter", "byte_ids"))
        self.n, self.n_chars = len(self.id), len(given["chars"])
        self.joint = Pairs(*given["joint"].T, self.n)
        self.beside = Pairs(*given["beside"].T, np.ones(len(given["beside"]), np.int32), self.n_chars)
        self.char = np.full(0x110000, -1, np.int32)
        self.char[given["chars"]] = np.arange(self.n_chars, dtype=np.int32)
        self.kind = np.zeros(256, np.uint8)
        self.kind[given["signs"]] = 1
        self.kind[ord(" ")] = 2
        self.size = np.array([len(b) for b in given["bytes"]], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(given["bytes"]), np.uint8)
        self.fail, self.piece, self.more = (given["automaton"][k] for k in ("fail", "piece", "more"))
        self.edge = Pairs(*given["automaton"]["edges"].T, self.n_chars)
        self.most = int(self.length.max(initial=1))
        self.fits: dict[int, bool] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a's and b's text gives a and b, of many pairs: the later of their last merges is undone again and again.

        A merge across the border comes first if it is better than the merge that was undone last.
        """
        out = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), self.n)
        while len(live):
            across = self.joint.get(a, b)
            bad = (across >= 0) & (across < limit)
            out[live[bad]] = False
            on = ~bad & (np.maximum(a, b) >= self.n_chars)
            live, a, b = live[on], a[on], b[on]
            later = a > b
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def longest(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each position of the parts (start, end) the longest piece that begins there and ends inside, or -1, from one pass of the automaton.

        Stretches of LONG positions are passed at once, character by character; each goes on for as long as a piece may be.
        """
        best = np.full(len(codes), -1, np.int32)
        n = -(-(end - start) // LONG)
        at = spread(start, n * LONG)[::LONG] if len(n) and n.max() > 1 else start.copy()
        last, stop = np.minimum(at + LONG, np.repeat(end, n)), np.repeat(end, n)
        stop = np.minimum(stop, last + self.most - 1)
        state = np.zeros(len(at), np.int32)
        while len(at):
            c = codes[at]
            to = self.edge.get(state, c)
            lost = np.flatnonzero(to < 0)
            s = state[lost]
            while len(lost):
                up = s > 0
                to[lost[~up]] = 0
                lost, s = lost[up], self.fail[s[up]]
                found = self.edge.get(s, c[lost])
                to[lost] = found
                lost, s = lost[found < 0], s[found < 0]
            state = to
            hit = np.where(self.piece[state] >= 0, state, self.more[state])
            lane = np.flatnonzero(hit)
            hit = hit[lane]
            while len(lane):
                k = self.piece[hit]
                begin = at[lane] + 1 - self.length[k]
                own = begin < last[lane]  # others belong to the next stretch, which finds them, too
                best[begin[own]] = k[own]  # of one beginning the longer come later
                hit = self.more[hit]
                lane, hit = lane[hit > 0], hit[hit > 0]
            at = at + 1
            on = at < stop
            if not on.all():
                at, last, stop, state = at[on], last[on], stop[on], state[on]
        return best

    def together(self, best: np.ndarray, start: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
        """The walk over many parts at once: out gets each piece at the position where it begins; other positions keep -1."""
        failed = np.zeros((len(best) >> 3) + 2, np.uint8)
        back = np.zeros(len(best), np.int64)  # how far before a piece the one before it begins
        first, stop = start.copy(), end.copy()
        at, piece, before = start.copy(), best[start], np.full(len(start), -1, np.int32)
        steps = 0
        while len(at) > FEW and steps < 16 * LONG:
            steps += 1
            has = piece >= 0
            to = np.where(has, at + self.length[piece], at)
            ok = has & ((failed[to >> 3] >> (to & 7).astype(np.uint8) & 1) == 0)
            asked = np.flatnonzero(ok & (before >= 0))
            ok[asked] = self.compatible(before[asked], piece[asked])
            none = np.flatnonzero(~has)
            again = np.flatnonzero(has & ~ok)
            piece[again] = self.shorter[piece[again]]
            if len(none):  # back to the piece before, and its next shorter one
                p = at[none]
                np.bitwise_or.at(failed, p >> 3, (1 << (p & 7)).astype(np.uint8))
                q = p - self.length[before[none]]
                last = out[q]
                out[q] = -1
                at[none] = q
                piece[none] = self.shorter[last]
                r = q - back[q]
                before[none] = np.where(back[q] > 0, out[r], -1)
            good = np.flatnonzero(ok)
            p = at[good]
            out[p] = piece[good]
            back[p] = np.where(before[good] >= 0, self.length[before[good]], 0)
            at[good] = to[good]
            through = np.zeros(len(at), bool)
            through[good] = to[good] == stop[good]
            walk = good[~through[good]]
            before[walk] = piece[walk]
            piece[walk] = best[at[walk]]
            if through.any():
                on = ~through
                at, piece, before, first, stop = at[on], piece[on], before[on], first[on], stop[on]
        for a, b in zip(first.tolist(), stop.tolist()):
            out[a:b] = -1
            self.alone(best, a, b, out)

    def alone(self, best: np.ndarray, start: int, end: int, out: np.ndarray) -> None:
        """The walk over one part."""
        longest, length, shorter, fits = best[start:end].tolist(), self.length, self.shorter, self.fits
        failed, at, piece, before, size = bytearray((end - start >> 3) + 2), 0, longest[0], -1, end - start
        pieces: list[int] = []
        while at < size:
            while piece >= 0:
                to = at + int(length[piece])
                if not failed[to >> 3] >> (to & 7) & 1:
                    if before < 0:
                        break
                    pair = before * self.n + piece
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= REMEMBER:
                            fits.clear()
                        ok = fits[pair] = bool(self.compatible(np.array([before], np.int32), np.array([piece], np.int32))[0])
                    if ok:
                        break
                piece = int(shorter[piece])
            if piece >= 0:
                pieces.append(piece)
                at += int(length[piece])
                before, piece = piece, longest[at] if at < size else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = pieces.pop()
                at -= int(length[last])
                before = pieces[-1] if pieces else -1
                piece = int(shorter[last])
        where = np.array(pieces, np.int32)
        out[start + np.cumsum(self.length[where]) - self.length[where]] = where

    def parts(self, blob: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts of a blob of UTF-8 one after the other, and each part's first, one more at the end."""
        data = np.frombuffer(blob, np.uint8)
        text = blob.decode().replace(" ", SPACE)
        codes = self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        begins = np.flatnonzero((data & 0xC0) != 0x80)  # each character's first byte
        ends = np.append(begins[1:], len(data))
        first = np.searchsorted(begins, offsets)
        new = np.ones(len(codes), bool)
        known = codes >= 0
        pair = np.flatnonzero(known[1:] & known[:-1]) + 1
        new[pair] = self.beside.get(codes[pair - 1], codes[pair]) < 0
        new[first[:-1][first[:-1] < len(codes)]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(codes))
        out = np.full(len(codes), -1, np.int32)
        walk = known[start]
        best = self.longest(codes, start[walk], end[walk])
        short = walk & (end - start <= LONG)
        self.together(best, start[short], end[short], out)
        for a, b in zip(start[walk & ~short].tolist(), end[walk & ~short].tolist()):
            self.alone(best, a, b, out)
        count = np.where(known, out >= 0, ends - begins)
        ids = np.repeat(np.where(known, self.id[out], 0), count)
        if not known.all():
            strange = np.flatnonzero(~known)
            to = np.cumsum(count) - count
            ids[spread(to[strange], count[strange])] = self.byte_ids[data[spread(begins[strange], count[strange])]]
        return ids, np.append(0, np.cumsum(count))[first]

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (with a blank in front of each that isn't empty), and each text's first id, one more at the end."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        kind = self.kind[data]
        new = np.empty(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 2)
        rows = offsets[:-1]
        new[rows[rows < len(data)]] = True
        new[0] = True
        starts = np.flatnonzero(new)
        bounds = np.append(starts, len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = coded.indices.to_numpy()
        joined, at = text_of(coded.dictionary)
        ids, first = self.parts(joined.tobytes(), at)
        count = np.diff(first)[which]
        ends = np.append(0, np.cumsum(count))
        return ids[spread(first[which], count)], ends[np.searchsorted(starts, offsets)]

    def decode_slice(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts, with the blank that encoding put in front, and each text's first byte, one more at the end."""
        size = self.size[ids]
        return self.bytes[spread(self.place[ids], size)], np.append(0, np.cumsum(size))[first]

    def encode(self, text: str) -> list[int]:
        return self.encode_slice(*prepared(pa.array([text])))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of pieces without the blank that encoding put in front."""
        text = self.decode_slice(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes()
        return text.removeprefix(b" ").decode("utf-8", "replace")


def prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the model takes them: a blank in front, and blanks for "▁"; their bytes and offsets."""
    texts = pc.replace_substring(texts.cast(pa.large_string()), SPACE, " ")
    return text_of(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))))


def codec_of(given: dict) -> Codec:
    """The codec of broadcast tables; a worker process keeps it from task to task."""
    if "codec" not in given:
        given["codec"] = Codec(given)
    return given["codec"]


def _readable(texts: pa.Array) -> pa.Array:
    """Texts with U+FFFD for bytes that are no UTF-8."""
    return pa.array([None if x is None else x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())


def encode_batch(codec: Codec, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each text its pieces, their number, and whether decoding them gives the text."""
    strange = None
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        fixed = _readable(texts)
        strange = pc.not_equal(fixed.cast(pa.large_binary()), texts.cast(pa.large_binary())).fill_null(False).to_numpy(zero_copy_only=False)
        texts = fixed
    data, offsets = prepared(texts)
    ids, first = codec.encode_slice(data, offsets)
    back, ends = codec.decode_slice(ids, first)
    if np.array_equal(ends, offsets) and np.array_equal(back, data):
        same = np.ones(len(texts), bool)
    else:
        same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(ends, ends[1:], offsets, offsets[1:])], bool)
    if strange is not None:
        same &= ~strange
    null = texts.is_null()
    mask = null.to_numpy(zero_copy_only=False)
    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids), mask=null if mask.any() else None)
    return lists, pa.array(np.diff(first).astype(np.int32), mask=mask), pa.array(same, mask=mask)


def _encode(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(given.value)
        for batch in batches:
            for a, b in slices(text_of(batch.column("_t"))[1], SLICE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("_id"), *encode_batch(codec, part.column("_t"))], ["doc_id", "pieces", "n_pieces", "round_trip"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, pieces, n_pieces, and round_trip: whether decoding them gives the text."""
    with open(model_path, "rb") as f:
        given = docs.sparkSession.sparkContext.broadcast(tables(f.read()))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return arrow_map(rows, _encode(given), f"doc_id {rows.schema['_id'].dataType.simpleString()}, pieces array<int>, n_pieces int, round_trip boolean")


def decode_batch(codec: Codec, pieces: pa.Array) -> pa.Array:
    """The text of each list of pieces; null for null."""
    sizes = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    data, at = codec.decode_slice(pieces.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)))
    front = (at[1:] > at[:-1]) & (np.append(data, 0)[at[:-1]] == 32)  # the blank that encoding put there
    keep = np.ones(len(data), bool)
    keep[at[:-1][front]] = False
    at = at - np.append(0, np.cumsum(front))
    texts = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(at), pa.py_buffer(data[keep])])
    try:
        texts = texts.cast(pa.large_string())
    except pa.ArrowInvalid:  # of any ids, not those of a text
        texts = _readable(texts)
    return pc.if_else(pieces.is_valid(), texts.cast(pa.string()), pa.scalar(None, pa.string()))


def _decode(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(given.value)
        for batch in batches:
            sizes = batch.column("_p").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(np.append(0, np.cumsum(sizes)), SLICE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("_id"), decode_batch(codec, part.column("_p"))], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """One row for each row of encoded: doc_id, text."""
    with open(model_path, "rb") as f:
        given = encoded.sparkSession.sparkContext.broadcast(tables(f.read()))
    rows = encoded.select(F.col(id_col).alias("_id"), F.col(pieces_col).alias("_p"))
    return arrow_map(rows, _decode(given), f"doc_id {rows.schema['_id'].dataType.simpleString()}, text string")
