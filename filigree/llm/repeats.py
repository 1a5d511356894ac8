"""Removal of strings that an earlier document has, by suffix order.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id. To
find these strings over all documents without sorting all suffixes in one place, every string of that
length is dealt by its minimiser (the least hash of its substrings of `seed_bytes`): consecutive
strings with the same one are a stretch of text, and equal strings always meet in the same shard.

1. `minimisers` of all documents, sorted and packed with their blocks, meet by shard; back comes a bit for each that
   says whether another document has it too. Nine of ten stretches end here.
2. The other stretches meet by shard. Equal ones are one, with the smallest document that has it. For those left, the
   shard builds the Burrows-Wheeler transform and the common prefixes of the collection column-wise:
   each round inserts one symbol of every stretch, from the last to the first, by a sequential merge into
   what is there (`Collection`). Runs of suffixes with common prefixes of ``length`` are the
   equal strings; their smallest document decides which of them are later ones.
3. The answers go back to the blocks, as bit sets, and the bytes go.

Blocks and shards are bounded; a minimiser of more than ``hot`` stretches is dealt again, by each whole string, of which only a
digest of 128 bits and the smallest document travel (`Singles`): so no group that a shard solves is larger, whatever
the text. The text is moved by block in steps 2 and 3 rather than kept, and the steps between are small tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import bounded_batches, materialise, rows_of, through, utf8



def seed_bytes(length: int) -> int:
    """Bytes of the substrings that are hashed: about half of a string, in whole words of eight; few strings share as much by chance."""
    return max(8, (length // 2 + 4) // 8 * 8)


#: Bits of a minimiser that tell shards and minimisers apart; equal ones of different strings only cost time.
KEY_BITS = 40
#: Odd multipliers. Fixed values.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93)


#: Strings of a text that are hashed at once, so that a very long one needs no arrays of its length.
PIECE = 1 << 20


def minimisers(b: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and count of the stretches of strings of ``length`` bytes that have the same minimiser.

    Stretches are cut at the width of the window, so that none is longer than one with a single minimiser can be, and at the
    ends of pieces of a very long text. A string has the same minimiser wherever it is cut.
    """
    if len(b) < PIECE + length:
        return _minimisers(b, length)
    parts = []
    for at in range(0, len(b) - length + 1, PIECE):
        key, start, count = _minimisers(b[at : at + PIECE + length - 1], length)
        parts.append((key, start + at, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _minimisers(b: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(b) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(b, np.uint8)
    word, seed = np.ndarray((len(b) - 7,), "<u8", raw, strides=(1,)), seed_bytes(length)
    h = word[: len(b) - seed + 1] * np.uint64(MIX[0])
    for at in range(8, seed, 8):  # each word by another odd number
        h += word[at : at + len(h)] * np.uint64(MIX[1] * (at + 1) % (1 << 64))
    h ^= h >> np.uint64(29)
    h *= np.uint64(MIX[2])
    h ^= h >> np.uint64(32)
    width, step = length - seed + 1, 1
    while step < width:
        more = min(step, width - step)
        h = np.minimum(h[:-more], h[more:])
        step += more
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(cut, n))
    key = (h[cut] * np.uint64(MIX[3])) >> np.uint64(64 - KEY_BITS)
    width = min(width, 64)  # an answer is as many bits
    parts = -(-count // width)
    if parts.max() > 1:
        key, first, total = np.repeat(key, parts), np.repeat(cut, parts), np.repeat(count, parts)
        at = (np.arange(len(key)) - np.repeat(np.cumsum(parts) - parts, parts)) * width
        cut, count = first + at, np.minimum(width, total - at)
    return key, cut, count


class Block:
    """The documents of one block: places (ids, null ones last), texts, and the stretches of all, in order of the rows."""

    def __init__(self, table: pa.Table, length: int):
        # Rows of a block come in any order; the same order each time keeps answers and questions together.
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "b", "doc_id")), strict=True), key=lambda r: (r[0], r[1], r[2] is None))
        self.places, self.texts, self.ids = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
        made = [minimisers(b, length) for b in self.texts]
        self.key, self.start, self.count = (np.concatenate([m[i] for m in made] or [np.zeros(0, np.uint64 if i == 0 else np.int64)]) for i in range(3))
        self.row = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
        self.place = np.array(self.places, np.int64)[self.row] if rows else np.zeros(0, np.int64)
        self.keys, self.of = np.unique(self.key, return_inverse=True)


def packed(x: np.ndarray) -> bytes:
    """Compressed, the bytes of equal weight together."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def cuts(x: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array and where it stands."""
    if not len(x):
        return
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(x)], strict=True):
        yield int(x[s]), slice(s, e)


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys * np.uint64(n)) >> np.uint64(KEY_BITS)).astype(np.int64)


#: A minimiser that stands oftener in some documents is counted by its different stretches.
OFTEN = 1


def ask_keys(parts: list[tuple], shards: int, length: int) -> Iterator[tuple]:
    """Rows (shard, blocks, keys, several, times) of some documents (block, place, text, keys, starts, counts): one a shard.

    A shard's minimisers, sorted, with the block that asks; whether several places have it there, and how many stretches: different
    ones, or occurrences where they are few. A row for each block besides would hold a minimiser or two where there are thousands of blocks.
    """
    import xxhash

    key, start, count = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
    n = [len(p[3]) for p in parts]
    block, place, doc = (np.repeat(np.array(x, np.int64), n) for x in ([p[0] for p in parts], [p[1] for p in parts], range(len(parts))))
    order = np.lexsort((place, block, key))
    key, block, place = key[order], block[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])) if len(key) else np.zeros(0, int)
    last = np.append(first[1:], len(key)) - 1
    times = last - first + 1
    often = np.flatnonzero(times > OFTEN)
    if len(often):
        group = np.repeat(often, times[often])
        at = order[np.concatenate([np.arange(first[g], last[g] + 1) for g in often.tolist()])]
        made = [xxhash.xxh3_64_intdigest(parts[d][2][s : s + c + length - 1]) for d, s, c in zip(doc[at].tolist(), start[at].tolist(), count[at].tolist(), strict=True)]
        different = np.unique(np.stack([group.astype(np.uint64), np.array(made, np.uint64)]), axis=1)[0].astype(np.int64)
        times[often] = np.bincount(different, minlength=len(times))[often]
    key, block, several = key[first], block[first], place[first] < place[last]
    # Shards are ranges of keys, so they are in order too.
    for shard, part in cuts(shard_of(key, shards)):
        yield shard, packed(block[part].astype("<u4")), packed(key[part]), np.packbits(several[part]).tobytes(), packed(times[part].astype("<u4"))


def answer_keys(blocks: list[bytes], keys: list[bytes], several: list[bytes], times: list[bytes], hot: int) -> Iterator[tuple[int, bytes]]:
    """Rows (block, bits): two bits for each different key that a block asked for, in order: whether it is shared and whether it is hot."""
    lists = [unpacked(k, "<u8") for k in keys]
    if not lists:
        return
    key, block = np.concatenate(lists), np.concatenate([unpacked(b, "<u4") for b in blocks]).astype(np.int64)
    flag = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)) for s, k in zip(several, lists, strict=True)])
    _, of, n = np.unique(key, return_inverse=True, return_counts=True)
    stretches = np.bincount(of, np.concatenate([unpacked(t, "<u4") for t in times]))
    shared, many = ((n > 1) | (np.bincount(of, flag) > 0))[of], (stretches > hot)[of]
    order = np.lexsort((key, block))
    key, block, shared, many = key[order], block[order], shared[order], many[order]
    one = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    block, shared, many = block[one], shared[one], many[one]
    for number, part in cuts(block):
        yield number, np.packbits(np.stack([shared[part], many[part]])).tobytes()


def string_digests(text: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """128 bits (two rows of uint64) of each string of ``length`` bytes: its words of eight through two chains of mixing."""
    word = np.ndarray((len(text) - 7,), "<u8", np.frombuffer(text, np.uint8), strides=(1,))
    out = np.zeros((2, len(starts)), np.uint64)
    for at in range(0, len(starts), PIECE):
        some = starts[at : at + PIECE]
        a, b = np.full(len(some), MIX[3], np.uint64), np.full(len(some), MIX[1], np.uint64)
        for off in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            w = word[some + off]
            a = (a ^ w) * np.uint64(MIX[0])
            a ^= a >> np.uint64(32)
            b = (b + w) ^ (b >> np.uint64(29))
            b *= np.uint64(MIX[2])
            b ^= b >> np.uint64(31)
        out[0, at : at + PIECE], out[1, at : at + PIECE] = a * np.uint64(MIX[3]), b
    return out


class Singles:
    """The strings of the stretches of hot minimisers of a block: all occurrences, and the different ones, with the smallest place here."""

    def __init__(self, block: Block, use: np.ndarray, length: int, shards: int):
        times = block.count[use]
        of = np.repeat(use, times)
        self.row = block.row[of].astype(np.int32)
        self.start = block.start[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        self.place = block.place[of]
        digests = np.zeros((2, len(of)), np.uint64)
        for row, part in cuts(self.row):
            digests[:, part] = string_digests(block.texts[row], self.start[part], length)
        order = np.lexsort((digests[1], digests[0]))
        digests = digests[:, order]
        new = np.concatenate([[True], (digests[:, 1:] != digests[:, :-1]).any(0)]) if len(order) else np.zeros(0, bool)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.names = digests[:, new]  # sorted, so shards, which are ranges of the first 64 bits, are in order too
        self.low = np.full(self.names.shape[1], np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.of, self.place)
        self.shard = shard_of(self.names[0] >> np.uint64(64 - KEY_BITS), shards)


def answer_singles(rows: list[tuple], at_once: int = 1 << 21) -> Iterator[tuple[int, bytes]]:
    """Rows (block, bits): for each string that a block asked for whether a document with a smaller id than the smallest there has it.

    ``rows``: (block, first 64 bits, low, second 64 bits) of one shard, sorted; solved a range of them at a time.
    """
    names = [(unpacked(r[1], "<u8"), unpacked(r[3], "<u8")) for r in rows]
    low = [unpacked(r[2], "<i8") for r in rows]
    bits = [np.zeros(len(x), bool) for x in low]
    pieces = -(-sum(map(len, low)) // at_once)
    least, most = (min(n[0][0] for n in names), max(n[0][-1] for n in names)) if pieces else (0, 0)
    edges = [int(least) + (int(most) - int(least) + 1) * k // pieces for k in range(1, pieces)]
    ends = [[0, *np.searchsorted(n[0], np.array(edges, np.uint64)).tolist(), len(n[0])] for n in names]
    for k in range(pieces):
        parts = [slice(e[k], e[k + 1]) for e in ends]
        a, b, place = (np.concatenate([x[p] for x, p in zip(y, parts, strict=True)]) for y in ([n[0] for n in names], [n[1] for n in names], low))
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(order) else np.zeros(0, bool)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        earliest = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(earliest, of, place)
        later, at = place > earliest[of], 0
        for x, p in zip(bits, parts, strict=True):
            x[p] = later[at : at + p.stop - p.start]
            at += p.stop - p.start
    for r, x in zip(rows, bits, strict=True):
        yield r[0], np.packbits(x).tobytes()


class Stretches:
    """The shared stretches of a block: all occurrences, and the different ones, with the smallest place here."""

    def __init__(self, block: Block, bits: dict[int, bytes], length: int, shards: int):
        import xxhash

        shared, many = np.zeros(len(block.keys), bool), np.zeros(len(block.keys), bool)
        for shard, at in cuts(shard_of(block.keys, shards)):
            if shard in bits:
                got = np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=2 * (at.stop - at.start)).reshape(2, -1)
                shared[at], many[at] = got[0], got[1]
        use = np.flatnonzero(shared[block.of])
        split = many[block.of[use]]
        self.singles = Singles(block, use[split], length, shards)
        of = use[~split]
        self.row, self.start, self.count, self.place = block.row[of], block.start[of], block.count[of], block.place[of]
        text = block.texts
        strings = [text[r][s : s + n + length - 1] for r, s, n in zip(self.row.tolist(), self.start.tolist(), self.count.tolist(), strict=True)]
        digests = np.array([xxhash.xxh3_128_digest(x) for x in strings], "S16") if strings else np.zeros(0, "S16")
        raw = np.frombuffer(digests.tobytes(), ">u8").reshape(-1, 2)
        shard_key = block.key[of]
        self.names, first, self.of = np.unique(raw.view("V16").ravel(), return_index=True, return_inverse=True)
        self.low = np.full(len(self.names), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.of, self.place)
        shard = shard_of(shard_key[first], shards) if len(first) else np.zeros(0, np.int64)
        self.order = np.argsort(shard, kind="stable")
        self.shard = shard[self.order]
        self.first, self.strings, self.key, self.sizes = first, strings, shard_key[first], self.count[first]

    def ask(self, number: int) -> Iterator[tuple]:
        """Rows (shard, block, step, keys, low, sizes, text): of stretches (step 1), and of single strings (step 2)."""
        for shard, at in cuts(self.shard):
            pick = self.order[at]
            text = b"".join(self.strings[i] for i in self.first[pick].tolist())
            yield shard, number, 1, packed(self.key[pick]), packed(self.low[pick]), self.sizes[pick].astype(np.uint8).tobytes(), zstandard.ZstdCompressor(level=3).compress(text)
        one = self.singles
        for shard, at in cuts(one.shard):
            yield shard, number, 2, packed(one.names[0, at]), packed(one.low[at]), b"", packed(one.names[1, at])


class Collection:
    """Suffix order of many strings: Burrows-Wheeler transform and common prefixes, made column-wise.

    In the beginning all strings have their empty suffix, in order of the strings. A round puts one more symbol of every string
    before its suffix. Where the longer suffixes stand follows from the symbols alone: sorted stably, the symbols of
    the transform are the first symbols of all suffixes that are not empty. The arrays are the columns of files that a
    round reads once from front to back and writes once with the new rows merged in; a shard is small enough to
    hold them in memory.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int):
        m = len(starts)
        last = starts + sizes - 1
        # Symbols are bytes plus one, as 0 says that none is left. UTF-8 has no byte 255.
        wide = np.uint16 if len(text) and text.max() == 255 else np.uint8
        text = np.append(text.astype(wide) + wide(1), wide(0))
        self.symbol = np.where(sizes > 0, text[np.maximum(last, 0)], 0).astype(wide)
        small = np.uint8 if max(most, int(sizes.max(initial=0))) < 256 else np.int32
        self.common = np.zeros(m, small)  # common prefix with the row before, as far as ``most``
        self.owner = np.arange(m, dtype=np.int32)
        self.at = sizes.astype(small)  # where the suffix starts in its string
        place = np.arange(m)  # row of each string's longest suffix
        active = np.flatnonzero(sizes > 0)
        done = 0
        while len(active):
            done += 1
            order = np.argsort(self.symbol, kind="stable")
            order = order[int(np.count_nonzero(self.symbol == 0)) :]
            rank = np.empty(len(self.symbol), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            new = rank[place[active]] + m  # rows in the longer order
            fresh = np.zeros(m + len(order), bool)
            fresh[new] = True
            common = np.zeros(m + len(order), small)
            common[~fresh] = self.common
            # Rows whose predecessor changed: the new ones, and those after them.
            touched = fresh.copy()
            touched[1:] |= fresh[:-1]
            touched[: m + 1] = False
            rows = np.flatnonzero(touched) - m
            head = self.symbol[order]
            same = head[rows] == head[rows - 1]
            common[rows[~same] + m] = 0
            rows = rows[same]
            if len(rows):
                # One more than the least common prefix on the way between the two suffixes that follow the equal symbols.
                ways = np.stack([order[rows - 1] + 1, order[rows] + 1], 1)
                by = np.argsort(ways[:, 0], kind="stable")
                padded = np.append(self.common, 0)
                least = np.minimum.reduceat(padded, ways[by].ravel())[::2]
                common[rows[by] + m] = np.minimum(least.astype(np.int64) + 1, most)
            if len(order):
                common[m] = 0
            left = sizes[active] - done
            symbol = np.where(left > 0, text[np.maximum(starts[active] + left - 1, 0)], 0).astype(wide)
            by = np.argsort(new)
            self.symbol = self._merged(self.symbol, fresh, symbol[by])
            self.owner = self._merged(self.owner, fresh, active[by].astype(np.int32))
            self.at = self._merged(self.at, fresh, left[by].astype(small))
            self.common = common
            moved = np.flatnonzero(~fresh)
            place = moved[place]
            place[active] = new
            active = active[left > 0]

    @staticmethod
    def _merged(old: np.ndarray, fresh: np.ndarray, new: np.ndarray) -> np.ndarray:
        out = np.empty(len(fresh), old.dtype)
        out[fresh], out[~fresh] = new, old
        return out


def answer_stretches(rows: list[tuple], length: int, rows_at_once: int = 1 << 17) -> Iterator[tuple[int, bytes]]:
    """Rows (block, bits): for each stretch that a block asked for, 64 bits of which strings an earlier document has.

    ``rows``: (block, keys, low, sizes, text) of one shard. All bits are set if a smaller document has the
    whole stretch; else the bits hold for the smallest document that has it.
    """
    if not rows:
        return
    import xxhash

    keys = np.concatenate([unpacked(r[1], "<u8") for r in rows])
    low = np.concatenate([unpacked(r[2], "<i8") for r in rows])
    counts = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]).astype(np.int64)
    raw = b"".join(zstandard.ZstdDecompressor().decompress(r[4]) for r in rows)
    text = np.frombuffer(raw, np.uint8)
    sizes = counts + length - 1
    starts = np.cumsum(sizes) - sizes
    names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)), "V16")
    _, first, of = np.unique(names, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, of, low)
    bits = np.zeros(len(first), np.uint64)
    # Only different stretches with the same minimiser can share strings.
    key = keys[first]
    order = np.argsort(key, kind="stable")
    group = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
    alone = np.bincount(group)[group] == 1
    order, group = order[~alone], group[~alone]
    at = 0
    while at < len(order):  # whole groups, as many as fit
        upto = np.cumsum(sizes[first[order[at:]]] + 1)
        end = at + max(1, int(np.searchsorted(upto, rows_at_once)))
        end = int(np.searchsorted(group, group[min(end, len(order)) - 1], side="right"))
        pick = order[at:end]
        mine = first[pick]
        made = Collection(text, starts[mine], sizes[mine], length)
        run = np.cumsum(made.common < length) - 1
        whole = made.at.astype(np.int64) + length <= sizes[mine][made.owner]
        earliest = np.full(run[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, run[whole], least[pick][made.owner[whole]])
        later = whole & (earliest[run] < least[pick][made.owner])
        np.bitwise_or.at(bits, pick[made.owner[later]], np.uint64(1) << made.at[later].astype(np.uint64))
        at = end
    out = np.where(low > least[of], np.uint64((1 << 64) - 1), bits[of])
    at = 0
    for r in rows:
        n = len(r[3])
        yield r[0], packed(out[at : at + n])
        at += n


def removed(block: Block, asked: Stretches, answers: dict[int, bytes], singles: dict[int, bytes], length: int) -> Iterator[np.ndarray]:
    """For each document of a block, which of its bytes go."""
    one = asked.singles
    later = np.zeros(len(one.low), bool)
    for shard, at in cuts(one.shard):
        later[at] = np.unpackbits(np.frombuffer(singles[shard], np.uint8), count=at.stop - at.start)
    later = (one.place > one.low[one.of]) | later[one.of]
    single, end = one.start[later], np.searchsorted(one.row[later], np.arange(len(block.texts) + 1))
    bits = np.zeros(len(asked.names), np.uint64)
    for shard, at in cuts(asked.shard):
        bits[asked.order[at]] = unpacked(answers[shard], "<u8")
    mine = np.where(asked.place > asked.low[asked.of], np.uint64((1 << 64) - 1), bits[asked.of])
    by = np.searchsorted(asked.row, np.arange(len(block.texts) + 1))
    for i, b in enumerate(block.texts):
        part = slice(by[i], by[i + 1])
        edge = np.zeros(len(b) + length + 1, np.int32)
        starts = single[end[i] : end[i + 1]]  # of strings of a document, each once
        edge[starts] += 1
        edge[starts + length] -= 1
        for s, n, m in zip(asked.start[part].tolist(), asked.count[part].tolist(), mine[part].tolist(), strict=True):
            if not m:
                continue
            if m & ((1 << n) - 1) == (1 << n) - 1:
                edge[s] += 1
                edge[s + n + length - 1] -= 1
            else:
                for j in range(n):
                    if m >> j & 1:
                        edge[s + j] += 1
                        edge[s + j + length] -= 1
        yield np.cumsum(edge, dtype=np.int32)[: len(b)] > 0


KEYS = "shard int, blocks binary, keys binary, several binary, times binary"
BITS = "block int, shard int, step int, bits binary"
ASKED = "shard int, block int, step int, keys binary, low binary, sizes binary, text binary"


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def drop_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, hot: int = 2000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of each document; ``kept`` are the bytes left, as binary.

    Strings are compared on the texts as they came, within documents, as UTF-8 bytes; a null text is empty. Texts shorter
    than ``length`` lose nothing. Null ids come after all others and are one place, as rows that share an id
    are: a string is not later than itself. One row for each row of ``docs``; no rows give none.
    Blocks have 4 MB of text (up to 64 MB if there are very many, so that what a block asks of a shard stays worth a
    row), and there is a shard for every four.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    place = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), place.alias("place"), utf8(text_col).alias("b"))
    total = d.agg(F.sum(F.octet_length("b"))).head()[0] or 0
    n = max(1, -(-total // (block_bytes or min(64 << 20, max(4 << 20, total // 50_000)))))
    shards = max(1, n // 4)
    d = d.withColumn("block", F.pmod(F.xxhash64("place", "b"), F.lit(n)).cast("int"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows_of(batches):
            for number, at, b in zip(*(batch.column(c).to_pylist() for c in ("block", "place", "b")), strict=True):
                held.append((number, at, b, *minimisers(b, length)))
                size += len(held[-1][3])
            if size >= 1 << 20:
                yield from _table(list(ask_keys(held, shards, length)), KEYS).to_batches()
                held, size = [], 0
        if held:
            yield from _table(list(ask_keys(held, shards, length)), KEYS).to_batches()

    def second(key: tuple, table: pa.Table) -> pa.Table:
        cols = (table.column(c).to_pylist() for c in ("blocks", "keys", "several", "times"))
        return _table([(b, key[0].as_py(), 0, x) for b, x in answer_keys(*cols, hot)], BITS)

    def third(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        bits = dict(zip(got.column("shard").to_pylist(), got.column("bits").to_pylist(), strict=True))
        return _table(list(Stretches(Block(table, length), bits, length, shards).ask(key[0].as_py())), ASKED)

    def fourth(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("step", "block", "keys", "low", "sizes", "text")), strict=True))
        whole, single = [r[1:] for r in rows if r[0] == 1], [(*r[1:4], r[5]) for r in rows if r[0] == 2]
        return _table([(b, key[0].as_py(), 1, x) for b, x in answer_stretches(whole, length)] + [(b, key[0].as_py(), 2, x) for b, x in answer_singles(single)], BITS)

    def fifth(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        block = Block(table, length)
        got_of = {k: {} for k in (0, 1, 2)}
        for s, k, x in zip(*(got.column(c).to_pylist() for c in ("shard", "step", "bits")), strict=True):
            got_of[k][s] = x
        out = []
        asked = Stretches(block, got_of[0], length, shards)
        for i, b, gone in zip(block.ids, block.texts, removed(block, asked, got_of[1], got_of[2], length), strict=True):
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(b) else 0
            out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
        return _table(out, OUT)

    keys = through(d, KEYS, first)
    bits = materialise(keys.groupBy("shard").applyInArrow(second, BITS), "repeats-bits")
    asked = d.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(third, ASKED)
    answers = materialise(asked.groupBy("shard").applyInArrow(fourth, BITS), "repeats-answers")
    got = bits.union(answers)
    return d.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(fifth, OUT)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
