"""N-gram Jaccard join: all documents whose sets of 5-word shingles have a Jaccard
similarity of at least 75/100, as connected components.

1. A pass hashes every text to its set. Equal sets are one node from here on. A linked set shares
   at least share/100 of its shingles with its partner. So of the shingles of one half of the hash
   space (all of them for small sets) at most n/4 may be its own alone. The pass ships short forms
   of these to ranges, which tell each node how many of its shingles others have too. What has
   too few links with nothing; only the rest, the candidates, goes on.
2. A second pass keeps the candidates' sets, packed in blocks of fixed size. Each block sends its
   distinct shingles with counts to ranges and gets their document frequencies back.
3. Two linked sets share a shingle among the first floor(n/4)+1 of each in ascending order of
   frequency. These prefixes, without shingles that no other has, go to tiles of equal shingles;
   a shingle of many sets has several tiles, salted by node. In a tile only sets in the same or
   adjacent size bands (powers of 4/3) can link. Tiles of up to 4 sets give their pairs. Larger ones are
   kept; there each set is paired with the one of its band and of the band below that stands in most
   tiles, and keeps the pair that shares most tiles.
4. Each set is compared with the partner it shares most tiles with, then the other pairs. A pair goes
   through hashed bitmaps, as long as the smaller set's band asks: a bit of one that the other
   lacks is an element not shared, so bit counts bound the overlap from above. What passes is
   decided by intersecting sorted arrays.
5. Components that meet in a kept tile are compared by one set of each, with the one that stands
   in most tiles, the tile's hub.
6. Where components are still apart in a tile, each of its sets is reduced to its difference from the hub.
   Two sets of which one does not link with the hub can link only if their differences share so many
   elements that each shows one among its rarest; so these elements make the next, smaller tiles, again
   with a hub. Tiles of up to BLOCK sets are compared in full, by the same two tests. So every pair in a
   tile is decided or joined already, and a tile of thousands of near copies costs rows in
   proportion to its size. Only tiles that shrink no more are compared in full by pairs of blocks.

Shingles are compared by 64-bit hashes; short forms only ever add candidates.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ENTRIES, LOWER, materialise, mix, scratch, slices, small_batches, span_hashes, tidy, window_hashes, word_spans
from .components import components

WORDS, SHARE = 5, 75
#: Sets of fewer shingles count them all in the first pass, larger ones those of one half of the hash space.
HALVED = 96
#: Bytes of text for each range of the first pass, which then holds some 200,000 entries.
TEXT_A_RANGE = 3_000_000
#: Entries of a range of the later steps on average, and entries that a task holds before it passes them on.
ENTRIES = 200_000
HELD = 1_000_000
#: Bits of a node that name it in the first pass; those below the flag of a counted shingle.
TAG_BITS = 39
#: Shingles in a block of packed sets.
BLOCK_ENTRIES = 500_000
#: The filter that tells which sets are wanted again has 16 bits for each, within these bounds.
FILTER_BITS = (1 << 20, 1 << 28)
#: Tiles of up to so many sets give all pairs at once, and a tile holds up to so many before it is salted.
SMALL, TILE = 4, 4096
#: Rounds in which components of a large tile are compared by one set of each, before all are; sets that are compared
#: in full at once.
STAR_ROUNDS, BLOCK = 3, 256
#: An element is common if more than one in COMMON of the differences from a hub have it; so many differences from a
#: hub are counted together.
COMMON, COUNTED = 16, 256


def sets_of(text: pa.Array, words: int = WORDS):
    """The sorted distinct shingle hashes of each row."""
    for _, off, data in slices(text):
        data = LOWER[data]
        starts, ends, at = word_spans(off, data)
        h = span_hashes(data, starts, ends)
        grams = window_hashes(h, words)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                s = np.sort(grams[a : b - words + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield mix(window_hashes(h[a:b], b - a)) if b > a else h[:0]


def set_id(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def band(n: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Sizes whose ratio is at most 100/share are in the same or adjacent bands."""
    return np.floor(np.log(n) / np.log(100 / share) + 1e-9).astype(np.int64)


def spare(n, share: int):
    """Elements that a set of n may have and its partner lack."""
    return n - -(-share * n // 100)


def bitmap(s: np.ndarray) -> bytes:
    """Four times as many bits as elements or more, a power of 2 from 256 to 65536."""
    bits = min(65536, max(256, 1 << int(4 * len(s) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(mix(s) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def fold(b: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set at a smaller size: position modulo the smaller size."""
    return np.bitwise_or.reduce(b.reshape(-1, size), axis=0)


def may_link(n: int, m: int, overlap: int, share: int) -> bool:
    return 100 * overlap >= share * (n + m - overlap)


def bound(a: bytes, n: int, b: bytes, m: int) -> int:
    """At least the overlap of the sets behind two bitmaps."""
    size = min(len(a), len(b))
    a, b = (fold(np.frombuffer(x, np.uint8), size) for x in (a, b))
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _cuts(where: np.ndarray):
    """The order by `where`, and (value, start, end) of each part of it."""
    order = np.argsort(where, kind="stable")
    first, size = _runs(where[order])
    return order, list(zip(where[order][first].tolist(), first.tolist(), (first + size).tolist(), strict=True))


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys >> np.uint64(1) & np.uint64(0x7FFFFFFF)) % np.uint64(ranges)


# --- first pass: who shares enough ------------------------------------------------------------

#: Kinds of rows on the way to a range: entries (short form and tag), counts (tag and number), documents.
ENTRY, COUNT, DOC = 0, 1, 2


def _first_pass(batches, ranges: int, share: int):
    """(range, kind, blob): short forms of shingles with their node's tag, one mark instead for a
    shingle of several nodes at hand, what those counted, and each document's node and sizes."""
    schema = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
    docs, parts, sizes, tags, seen, held = [], [], [], [], set(), 0
    mask = (1 << TAG_BITS) - 1

    def flush():
        rows = []
        if parts:
            key = np.concatenate(parts)
            lengths = [len(x) for x in parts]
            tag = np.repeat(np.array(tags, np.uint64), lengths)
            counted = np.repeat(np.array(sizes) < HALVED, lengths) | (key & np.uint64(1) == 0)
            order = np.argsort(key)
            key, tag, counted = key[order], tag[order], counted[order]
            first, size = _runs(key)
            own, n = np.unique(tag[np.repeat(size > 1, size) & counted], return_counts=True)
            if len(own):
                rows.append((int(own[0]) % ranges, COUNT, own.tobytes() + n.astype(np.uint32).tobytes()))
            key, value = key[first], np.where(size > 1, np.uint64(0), tag[first] | counted[first].astype(np.uint64) << np.uint64(TAG_BITS))
            order, cuts = _cuts(_range(key, ranges))
            short, value = (key[order] >> np.uint64(32)).astype(np.uint32), value[order]
            low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint8)
            rows += [(r, ENTRY, short[a:b].tobytes() + low[a:b].tobytes() + high[a:b].tobytes()) for r, a, b in cuts]
        if docs:
            d = np.array(docs, np.int64)
            rows.append((int(d[0, 2]) % ranges, DOC, d.tobytes()))
        for x in (docs, parts, sizes, tags):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for b in batches:
        for doc, s in zip(b.column(0).to_pylist(), sets_of(b.column(1)), strict=True):
            n = len(s)
            half = s if n < HALVED else s[s & np.uint64(1) == 0]
            node = set_id(s) if n else 0
            docs.append((0 if doc is None else doc, doc is not None, node, n, len(half)))
            if n and node not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                # A partner of a set that counts all of its shingles shows all of its own.
                parts.append(s if share * n <= 100 * (HALVED - 1) else half)
                sizes.append(n)
                tags.append(node & mask or 1)
                held += len(parts[-1])
            if held >= HELD or len(docs) >= 100_000:
                yield flush()
                held = 0
    if docs:
        yield flush()


def _shared(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a range's entries, how many of each tag's are others' too, packed by bucket; documents pass."""
        short, value, tags, counts, docs = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros((0, 5), np.int64)]
        for kind, x in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind == ENTRY:
                k = len(x) // 9
                short.append(np.frombuffer(x, np.uint32, k))
                value.append(np.frombuffer(x, np.uint32, k, 4 * k).astype(np.uint64) | np.frombuffer(x, np.uint8, k, 8 * k).astype(np.uint64) << np.uint64(32))
            elif kind == COUNT:
                k = len(x) // 12
                tags.append(np.frombuffer(x, np.uint64, k))
                counts.append(np.frombuffer(x, np.uint32, k, 8 * k))
            else:
                docs.append(np.frombuffer(x, np.int64).reshape(-1, 5))
        if short:
            short, value = np.concatenate(short), np.concatenate(value)
            order = np.lexsort((value, short))
            short, value = short[order], value[order]
            first, size = _runs(short)
            shared = np.repeat(value[first] != value[first + size - 1], size)
            once = np.concatenate([[True], (short[1:] != short[:-1]) | (value[1:] != value[:-1])])
            counted = value >> np.uint64(TAG_BITS) == 1
            found, n = np.unique(value[shared & once & counted] & np.uint64((1 << TAG_BITS) - 1), return_counts=True)
            tags.append(found)
            counts.append(n.astype(np.uint32))
        tag, count = np.concatenate(tags), np.concatenate(counts)
        order, cuts = _cuts(tag % np.uint64(buckets))
        tag, count = tag[order], count[order]
        blobs = [tag[a:b].tobytes() + count[a:b].tobytes() for _, a, b in cuts]
        d, m = np.concatenate(docs), len(cuts)
        ids = pa.array(d[:, 0], mask=d[:, 1] == 0)
        cols = [pa.concat_arrays([x, pa.nulls(m, pa.int64())]) for x in (ids, *(pa.array(d[:, i]) for i in (2, 3, 4)))]
        more = [pa.concat_arrays([pa.nulls(len(d), pa.int32()), pa.array([c[0] for c in cuts], pa.int32())]), pa.concat_arrays([pa.nulls(len(d), pa.binary()), pa.array(blobs, pa.binary())])]
        return pa.table([*cols, *more], names=["doc_id", "node", "n", "half", "bucket", "counts"])

    return run


def _by_tag(table: pa.Table) -> pa.Table:
    tags, counts = [], []
    for x in table.column("counts").to_pylist():
        k = len(x) // 12
        tags.append(np.frombuffer(x, np.uint64, k))
        counts.append(np.frombuffer(x, np.uint32, k, 8 * k))
    tag, at = np.unique(np.concatenate(tags), return_inverse=True)
    return pa.table({"tag": pa.array(tag.astype(np.int64)), "shared": pa.array(np.bincount(at, np.concatenate(counts), len(tag)).astype(np.int64))})


# --- second pass: the candidates' sets --------------------------------------------------------


def _place(node: np.ndarray, doc: np.ndarray, bits: int) -> np.ndarray:
    return (mix(node.view(np.uint64) ^ mix(doc.view(np.uint64))) & np.uint64(bits - 1)).astype(np.int64)


def _longs(column) -> np.ndarray:
    """A long column, nulls as -1."""
    return np.asarray(column.fill_null(-1)).astype(np.int64)


def _bits(batches, bits: int):
    chunks: dict[int, np.ndarray] = {}
    for b in batches:
        x = _place(_longs(b.column(0)), _longs(b.column(1)), bits)
        for c in np.unique(x >> 16).tolist():
            chunk = chunks.setdefault(c, np.zeros(1 << 16, bool))
            chunk[x[x >> 16 == c] & 0xFFFF] = True
    rows = sorted(chunks.items())
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([zlib.compress(np.packbits(r[1]).tobytes(), 1) for r in rows], pa.binary())], names=["chunk", "bits"])


def _or_bits(table: pa.Table) -> pa.Table:
    out = np.zeros(1 << 13, np.uint8)
    for x in table.column("bits").to_pylist():
        out |= np.frombuffer(zlib.decompress(x), np.uint8)
    return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})


def _filter_of(wanted: DataFrame, count: int):
    """A bit table, at most FILTER_BITS, of the (node, doc) of wanted."""
    bits = min(max(1 << (16 * count).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    chunks = wanted.mapInArrow(tidy(lambda x: _bits(x, bits)), "chunk int, bits binary").groupBy("chunk").applyInArrow(_or_bits, "chunk int, bits binary")
    flags = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for r in chunks.toLocalIterator():
        flags[r["chunk"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return flags.tobytes()


def _wanted(batches, flags: bytes):
    """(doc, node, n, set) of the documents that the filter may hold."""
    flags = np.frombuffer(flags, np.uint8)
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("value", pa.binary())])
    seen: set[int] = set()
    for b in batches:
        rows, held = [], 0
        for doc, s in zip(b.column(0).to_pylist(), sets_of(b.column(1)), strict=True):
            if not len(s):
                continue
            node = set_id(s)
            bit = int(_place(np.array([node]), np.array([-1 if doc is None else doc]), 8 * len(flags))[0])
            if flags[bit >> 3] >> (7 - (bit & 7)) & 1 and node not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                rows.append((doc, node, s.tobytes()))
                held += len(s)
            if held > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _packed(batches):
    """(block, nodes, sizes, sets) of some BLOCK_ENTRIES shingles each; their ids hold once they are written."""
    from pyspark import TaskContext

    block, nodes, sets, held = TaskContext.get().partitionId() << 32, [], [], 0

    def out():
        sizes = np.array([len(x) // 8 for x in sets], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in (np.array(nodes, np.int64).tobytes(), sizes.tobytes(), b"".join(sets))]], names=["block", "nodes", "sizes", "sets"])

    for b in batches:
        for node, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            nodes.append(node)
            sets.append(s)
            held += len(s) // 8
            if held >= BLOCK_ENTRIES:
                yield out()
                block, nodes, sets, held = block + 1, [], [], 0
    if nodes:
        yield out()


def _block(nodes: bytes, sizes: bytes, sets: bytes):
    return np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(sets, np.uint64)


def _values(batches, value):
    """(node, n, value of the set) of each set of the blocks."""
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            nodes, sizes, sets = _block(*row)
            ends = np.cumsum(sizes)
            for lo in range(0, len(nodes), 256):
                hi = min(lo + 256, len(nodes))
                made = pa.array([value(sets[e - n : e]) for e, n in zip(ends[lo:hi].tolist(), sizes[lo:hi].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[lo:hi]), pa.array(sizes[lo:hi]), made], names=["node", "n", "value"])


# --- frequencies and prefixes -----------------------------------------------------------------


def _distinct(batches, ranges: int):
    """(range, block, blob): each block's distinct shingles and in how many of its sets they are."""
    for b in batches:
        for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h, n = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
            order, cuts = _cuts(_range(h, ranges))
            h, n = h[order], n[order].astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int32()), pa.array([block] * len(cuts), pa.int64()), pa.array([h[x:y].tobytes() + n[x:y].tobytes() for _, x, y in cuts], pa.binary())], names=["range", "block", "counts"])


def _counted(x: bytes):
    k = len(x) // 12
    return np.frombuffer(x, np.uint64, k), np.frombuffer(x, np.uint32, k, 8 * k)


def _frequencies(table: pa.Table) -> pa.Table:
    """To each block its shingles of a range that stand in two sets or more, and in how many."""
    blocks, parts = table.column("block").to_pylist(), [_counted(x) for x in table.column("counts").to_pylist()]
    h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[1] for p in parts]), len(h)).astype(np.uint32)[at]
    out, lo = [], 0
    for own, _ in parts:
        n = total[lo : lo + len(own)]
        lo += len(own)
        out.append(own[n > 1].tobytes() + n[n > 1].tobytes())
    return pa.table({"block": pa.array(blocks, pa.int64()), "counts": pa.array(out, pa.binary())})


def _prefixes(ranges: int, share: int):
    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        """(range, entries): of each set that may link, the shared shingles of its prefix."""
        rows = []
        parts = [_counted(x) for x in counts.column("counts").to_pylist()]
        if len(parts) and blocks.num_rows:
            h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h)
            h, n = h[order], n[order].astype(np.int64)
            for row in zip(*[blocks.column(c).to_pylist() for c in ("nodes", "sizes", "sets")], strict=True):
                rows += _prefix_rows(*_block(*row), h, n, ranges, share)
        return pa.table({"range": pa.array([r[0] for r in rows], pa.int32()), "entries": pa.array([r[1] for r in rows], pa.binary())})

    return run


def prefix(nodes, sizes, sets, h, n, share: int):
    """(shingle, frequency, set) of the shared ones among each set's first floor(n/4)+1 shingles by (frequency, hash).

    h, n: the sorted shingles of two sets or more, and their frequencies.
    """
    at = np.searchsorted(h, sets)
    at[at == len(h)] = 0
    shared = h[at] == sets if len(h) else np.zeros(len(sets), bool)
    which = np.repeat(np.arange(len(nodes)), sizes)
    room = spare(sizes, share) + 1 - (sizes - np.bincount(which[shared], minlength=len(nodes)))
    keep = shared & (room > 0)[which]
    which, key, often = which[keep], sets[keep], n[at[keep]]
    order = np.lexsort((key, often, which))
    which, key, often = which[order], key[order], often[order]
    first, size = _runs(which)
    place = np.arange(len(which)) - np.repeat(first, size)
    keep = place < room[which]
    return key[keep], often[keep], which[keep]


def _prefix_rows(nodes, sizes, sets, h, n, ranges: int, share: int):
    key, often, which = prefix(nodes, sizes, sets, h, n, share)
    node, size = nodes[which], sizes[which].astype(np.uint32)
    salt = mix(node.view(np.uint64)) % (1 + (often - 1) // TILE).astype(np.uint64)
    tile = np.where(often > TILE, mix(key ^ mix(salt + np.uint64(1))), key)
    order, cuts = _cuts(_range(mix(tile), ranges))
    tile, key, node, size, salted = tile[order], key[order], node[order], size[order], (often > TILE).astype(np.uint8)[order]
    return [(r, b"".join(x[a:b].tobytes() for x in (tile, key, node, size, salted))) for r, a, b in cuts]


# --- tiles ------------------------------------------------------------------------------------


def _tiles(share: int):
    def run(table: pa.Table) -> pa.Table:
        """The pairs (u, v, shared tiles, whether only a large tile's) of a range, u < v, and the
        sets of its large tiles as rows (tile, u)."""
        cols: list[list] = [[], [], [], [], []]
        for x in table.column("entries").to_pylist():
            k, at = len(x) // 29, 0
            for c, t in zip(cols, (np.uint64, np.uint64, np.int64, np.uint32, np.uint8), strict=True):
                c.append(np.frombuffer(x, t, k, at))
                at += k * np.dtype(t).itemsize
        tile, key, node, n, salted = (np.concatenate(c) for c in cols)
        order = np.lexsort((node, tile))
        tile, key, node, n, salted = tile[order], key[order], node[order], n[order].astype(np.int64), salted[order]
        first, size = _runs(tile)
        bands = band(n, share)
        pairs = []

        def give(i, j, large: int):
            ok = 100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])
            u, v = node[i[ok]], node[j[ok]]
            pairs.append(np.stack([np.minimum(u, v), np.maximum(u, v), np.ones(len(u), np.int64), np.full(len(u), large)], 1))

        whole = (size <= SMALL) & (salted[first] == 0)
        for k in range(2, SMALL + 1):
            at = first[whole & (size == k)][:, None] + np.arange(k)
            for i in range(k):
                for j in range(i + 1, k):
                    give(at[:, i], at[:, j], 0)
        # How often a set stands in large tiles here: what others were copied from does most.
        big = np.repeat(~whole, size)
        which = np.unique(node, return_inverse=True)[1]
        often = np.bincount(which, big)[which].astype(np.int64)
        for a, k in zip(first[~whole].tolist(), size[~whole].tolist(), strict=True):
            own = bands[a : a + k]
            order = np.lexsort((node[a : a + k], -often[a : a + k], own))
            levels, start = np.unique(own[order], return_index=True)
            hub = order[start]
            for d in (0, 1):
                at = np.searchsorted(levels, own - d)
                at[at == len(levels)] = 0
                ok = np.flatnonzero((levels[at] == own - d) & (hub[at] != np.arange(k)))
                give(a + ok, a + hub[at[ok]], 1)
        p = _summed(np.concatenate(pairs)) if pairs else np.zeros((0, 4), np.int64)
        m = int(big.sum())
        cols = [pa.concat_arrays([pa.array(p[:, 0]), pa.array(node[big])]), *[pa.concat_arrays([pa.array(p[:, i]), pa.nulls(m, pa.int64())]) for i in (1, 2, 3)]]
        return pa.table([*cols, pa.concat_arrays([pa.nulls(len(p), pa.int64()), pa.array(key[big].view(np.int64))])], names=["u", "v", "shared", "large", "tile"])

    return run


def _summed(p: np.ndarray) -> np.ndarray:
    """Rows (u, v, shared, large) with u, v once: shared is summed, large holds if it does for all."""
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    cut = np.flatnonzero(np.concatenate([[True], (p[1:, 0] != p[:-1, 0]) | (p[1:, 1] != p[:-1, 1])])) if len(p) else np.zeros(0, np.int64)
    if not len(cut):
        return p
    return np.stack([p[cut, 0], p[cut, 1], np.add.reduceat(p[:, 2], cut), np.minimum.reduceat(p[:, 3], cut)], 1)


# --- verification -----------------------------------------------------------------------------


def _passes(batches, share: int):
    """Of (u, v, shared, n, m, bitmaps), the (u, v, shared) whose bitmaps leave a link possible."""
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(7)]
        ok = [(u, v, k) for u, v, k, n, m, x, y in zip(*cols, strict=True) if 100 * min(n, m) >= share * max(n, m) and may_link(n, m, bound(x, n, y, m), share)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in ok], pa.int64()) for i in range(3)], names=["u", "v", "shared"])


def _links(batches, share: int):
    """Of (u, v, sets), the (u, v) that link."""
    for b in batches:
        ok = []
        for u, v, x, y in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            if may_link(len(x), len(y), int((x[at] == y).sum()), share):
                ok.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in ok], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()


def _few(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of values that the nodes (each once) need; a count tells whether the nodes may go round."""
    small = nodes.count() <= BROADCAST_ENTRIES // 4
    return values.join(F.broadcast(nodes) if small else nodes, "node", "left_semi")


def _with_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    values = _few(values, _ends(pairs))
    a, b = (values.select(*[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "value")]) for k in "uv")
    return pairs.join(a, F.col("u") == F.col("node_u")).join(b, F.col("v") == F.col("node_v"))


def _verify(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Of pairs (u, v), those that link, written."""
    both = _with_values(pairs, sets).select("u", "v", "value_u", "value_v")
    return materialise(both.mapInArrow(tidy(lambda x: _links(x, share)), "u long, v long"), "links")


def _possible(pairs: DataFrame, bitmaps: DataFrame, share: int) -> DataFrame:
    """Of pairs (u, v, shared), those whose bitmaps leave a link possible, written."""
    both = _with_values(pairs, bitmaps).select("u", "v", "shared", "n_u", "n_v", "value_u", "value_v")
    return materialise(both.mapInArrow(tidy(lambda x: _passes(x, share)), "u long, v long, shared long"), "near")


def _differences(batches, share: int):
    """Of (u, v, k, sets), (u, v, k, linked, take, value): what only one of both sets has, and how many of its rarest
    elements v must show.

    With p = 100 + share and q = 100 - share, x and y link if p * |x ^ y| <= q * (|x| + |y|). With
    differences a and b from u, |x ^ y| = |a| + |b| - 2 * |a & b|. If x links with u and y does not,
    2p * |a & b| >= p * |a| + q * (|u| - |x|) + 1. If x does not, |y| <= |u| + |b| and |a & b| <= |b| give
    200 * |a & b| >= p * |a| - q * (|u| + |x|), which is above 0.
    """
    p, q = 100 + share, 100 - share
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("k", pa.int64()), ("linked", pa.bool_()), ("take", pa.int64()), ("value", pa.binary())])
    for b in batches:
        rows = []
        for u, v, k, x, y in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            d = np.setxor1d(x, y, assume_unique=True)
            over = p * len(d) - q * (len(x) + len(y))
            need = -(-over // 200) if over > 0 else -(-(p * len(d) + q * (len(x) - len(y)) + 1) // (2 * p))
            rows.append((u, v, k, over <= 0, len(d) - need + 1, d.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _differing(batches):
    """(u, part, k, counts): of (u, k, difference), in how many of the differences from u elements are."""
    for b in batches:
        parts: dict[tuple[int, int], list] = {}
        for u, k, x in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            parts.setdefault((u, k), []).append(np.frombuffer(x, np.uint64))
        rows = []
        for (u, k), own in parts.items():
            h, n = np.unique(np.concatenate(own), return_counts=True)
            order, cuts = _cuts(_range(h, 1 + k // COUNTED))
            h, n = h[order], n[order].astype(np.uint32)
            rows += [(u, r, k, h[i:j].tobytes() + n[i:j].tobytes()) for r, i, j in cuts]
        cols = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["u", "part", "k", "counts"])


def _common(table: pa.Table) -> pa.Table:
    """The elements of a part that are common in the differences from u, at most COMMON times a difference's
    size in all parts, and in how many they are."""
    parts, k = [_counted(x) for x in table.column("counts").to_pylist()], table.column("k")[0].as_py()
    h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(h)).astype(np.uint32)
    ok = n.astype(np.int64) * COMMON > k
    return pa.table({"u": table.column("u")[: int(ok.any())], "counts": pa.array([h[ok].tobytes() + n[ok].tobytes()] if ok.any() else [], pa.binary())})


def _narrower(batches):
    """(tile, node): of (u, v, take, difference, common elements), v at the first elements of its difference, those
    that are not common before the others, which go by their number."""
    for b in batches:
        tiles, nodes, held = [], [], 0

        def out(tiles=tiles, nodes=nodes):
            node = np.repeat(np.array([x[0] for x in nodes], np.int64), [x[1] for x in nodes])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles).view(np.int64)), pa.array(node)], names=["tile", "node"])

        for u, v, take, x, common in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            d = np.frombuffer(x, np.uint64)
            n = np.zeros(len(d), np.int64)
            for h, often in map(_counted, common or ()):
                at = np.searchsorted(h, d)
                at[at == len(h)] = 0
                n[h[at] == d] = often[at[h[at] == d]]
            first = np.lexsort((d, n))[:take]
            tiles.append(mix(d[first] ^ mix(np.array([u], np.int64).view(np.uint64))))
            nodes.append((v, len(first)))
            held += len(first)
            if held > HELD:
                yield out()
                tiles.clear()
                nodes.clear()
                held = 0
        if nodes:
            yield out()


def _blocks(share: int):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of a block pair of a tile, from different components, whose bitmaps pass."""
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, root, n, block = (np.asarray(table.column(c)) for c in ("node", "root", "n", "block"))
        bits = [np.frombuffer(x, np.uint8) for x in table.column("value").to_pylist()]
        right = np.flatnonzero(block == j)
        length = np.array([len(x) for x in bits])
        shapes = {k: right[length[right] == k] for k in np.unique(length[right]).tolist()}
        folded: dict[tuple[int, int], np.ndarray] = {}
        us, vs = [], []
        for x in np.flatnonzero(block == i).tolist():
            for k, rows in shapes.items():
                rows_ok = (root[rows] != root[x]) & (100 * np.minimum(n[rows], n[x]) >= share * np.maximum(n[rows], n[x]))
                if i == j:
                    rows_ok &= node[rows] > node[x]
                if not rows_ok.any():
                    continue
                size = min(k, len(bits[x]))
                if (k, size) not in folded:
                    folded[k, size] = np.stack([fold(bits[r], size) for r in rows])
                other, own, m = folded[k, size][rows_ok], fold(bits[x], size), n[rows[rows_ok]]
                both = np.minimum(n[x] - np.bitwise_count(own & ~other).sum(axis=1, dtype=np.int64), m - np.bitwise_count(other & ~own).sum(axis=1, dtype=np.int64))
                hit = rows[rows_ok][100 * both >= share * (n[x] + m - both)]
                us.append(np.minimum(node[x], node[hit]))
                vs.append(np.maximum(node[x], node[hit]))
        empty = np.zeros(0, np.int64)
        return pa.table({"u": pa.array(np.concatenate([empty, *us])), "v": pa.array(np.concatenate([empty, *vs]))})

    return run


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs. share: 50 to 99.

    Words are runs without ASCII white space, A-Z lower-cased. A text of 1 to 4 words is one
    shingle; an empty or null text has none, links with nothing and is its own component. A row
    without an id links like any other, but its id is nobody's component_id: a component of such
    rows alone has none. Repeated rows have equal sets and so share a component. An empty table
    gives none. Only the two named columns are read.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    small_batches(spark)
    with scratch(spark):
        own, label = _components(spark, docs, share)
    out = own.join(label, F.col("node") == F.col("node_"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _candidates(docs: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n, half) of each row, and (node, first, n) of the sets that may link; both written."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
    ranges = int(max(16, size // TEXT_A_RANGE))
    entries = docs.mapInArrow(tidy(lambda x: _first_pass(x, ranges, share)), "range int, kind int, blob binary")
    counted = materialise(entries.groupBy("range").applyInArrow(_shared(ranges // 8 + 1), "doc_id long, node long, n long, half long, bucket int, counts binary"), "counted", keep=True)
    own = counted.where("bucket is null").select("doc_id", "node", "n", "half")
    shared = counted.where("bucket is not null").select("bucket", "counts").groupBy("bucket").applyInArrow(_by_tag, "tag long, shared long")
    nodes = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("half").alias("half"), F.count("*").alias("rows"))
    tag = F.expr(f"if(node & {(1 << TAG_BITS) - 1} = 0, 1, node & {(1 << TAG_BITS) - 1})")
    enough = f"half - coalesce(shared, 0) <= n - cast(ceil({share} * n / 100) as long)"
    found = nodes.withColumn("tag_", tag).join(shared, F.col("tag_") == F.col("tag"), "left").where(enough)
    return own, materialise(found.select("node", "first", "n"), "candidates")


def _components(spark, docs: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of each row and (node_, component) of each set, both written."""
    own, candidates = _candidates(docs, share)
    total = candidates.agg(F.count("*").alias("sets"), F.sum("n").alias("entries")).first()
    links = None
    if total["sets"] > 1:
        links = _all_links(spark, docs, candidates, total["sets"], total["entries"], share)
    nodes = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    label = _rooted(nodes, "node", components(links)) if links is not None else nodes.withColumn("root_node", F.col("node"))
    least = label.groupBy("root_node").agg(F.min("first").alias("component"))
    return own, materialise(label.join(least, "root_node").select(F.col("node").alias("node_"), "component"), "label", keep=True)


def _rooted(df: DataFrame, col: str, roots: DataFrame) -> DataFrame:
    """df with root_<col>, the root of the node in col."""
    r = roots.select(F.col("node").alias("node_"), F.col("root").alias("root_"))
    return df.join(r, F.col(col) == F.col("node_"), "left").withColumn(f"root_{col}", F.coalesce("root_", col)).drop("node_", "root_")


def _best_of(pairs: DataFrame) -> DataFrame:
    """The pair of each node that shares the most tiles."""
    sides = pairs.select("u", F.struct("shared", F.col("v").alias("p")).alias("x")).unionByName(pairs.select(F.col("v").alias("u"), F.struct("shared", F.col("u").alias("p")).alias("x")))
    return sides.groupBy("u").agg(F.max("x").alias("x")).select(F.least("u", "x.p").alias("u"), F.greatest("u", "x.p").alias("v"), F.col("x.shared").alias("shared")).distinct()


def _all_links(spark, docs: DataFrame, candidates: DataFrame, sets_: int, entries: int, share: int) -> DataFrame:
    """Links (u, v) that make the components of all linked sets."""
    flags = spark.sparkContext.broadcast(_filter_of(candidates.select("node", "first"), sets_))
    found = docs.mapInArrow(tidy(lambda x: _wanted(x, flags.value)), "doc_id long, node long, value binary")
    first = candidates.select(F.col("node").alias("node_"), "first")
    found = found.join(first, (F.col("node") == F.col("node_")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").dropDuplicates(["node"])
    blocks = materialise(found.select("node", "value").mapInArrow(tidy(_packed), "block long, nodes binary, sizes binary, sets binary"), "blocks")
    flags.destroy()

    ranges = int(max(16, entries // ENTRIES))
    sent = blocks.select("block", "sets").mapInArrow(tidy(lambda x: _distinct(x, ranges)), "range int, block long, counts binary")
    often = sent.groupBy("range").applyInArrow(_frequencies, "block long, counts binary")
    prefixes = blocks.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(_prefixes(ranges, share), "range int, entries binary")
    tiles = materialise(prefixes.groupBy("range").applyInArrow(_tiles(share), "u long, v long, shared long, large long, tile long"), "tiles")
    large = tiles.where("tile is not null").select("tile", F.col("u").alias("node"))
    pairs = tiles.where("tile is null").groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("large").alias("large"))
    # Large tiles are looked at again in full; of their pairs a node's best is enough for now.
    pairs = materialise(pairs, "sums")
    pairs = materialise(pairs.where("large = 0").select("u", "v", "shared").unionByName(_best_of(pairs.where("large = 1"))).distinct(), "pairs")

    values = blocks.select("nodes", "sizes", "sets")
    sets = values.mapInArrow(tidy(lambda x: _values(x, np.ndarray.tobytes)), "node long, n long, value binary")
    bitmaps = materialise(values.mapInArrow(tidy(lambda x: _values(x, bitmap)), "node long, n long, value binary"), "bitmaps")
    near = _possible(pairs, bitmaps, share)
    best = materialise(_best_of(near).select("u", "v"), "best")
    links = _verify(best, sets, share)
    roots = components(links)
    rest = _rooted(_rooted(near.select("u", "v"), "u", roots), "v", roots).where("root_u <> root_v").select("u", "v")
    rest = materialise(rest.join(best, ["u", "v"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_verify(rest, sets, share))
    if large.isEmpty():
        return links

    # Components that meet in a large tile are first compared by one set of each, with the one
    # that stands in most tiles; a group of near copies grows together in a round or two.
    rows = large.join(large.groupBy("node").agg(F.count("*").alias("often")), "node").withColumn("k", F.lit(1).cast("long"))
    tested = near.select("u", "v")
    for star_round in range(STAR_ROUNDS + 1):
        roots = components(links)
        rows = _apart(rows, roots)
        open_tiles = rows.groupBy("tile").agg(F.max(F.struct("often", "root_node", "node")).alias("hub"), F.sum("k").alias("k"), F.count("*").alias("roots"))
        open_tiles = materialise(open_tiles.where("roots > 1").drop("roots"), "open")
        if open_tiles.isEmpty():
            return links
        if star_round == STAR_ROUNDS:
            break
        star = _of_tiles(rows.drop("k"), open_tiles).where("root_node <> hub.root_node").select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")).distinct()
        star = materialise(star.join(tested, ["u", "v"], "left_anti").withColumn("shared", F.lit(0).cast("long")), "star")
        if star.isEmpty():
            break
        near = _possible(star, bitmaps, share).select("u", "v")
        tested = materialise(tested.unionByName(star.select("u", "v")), "tested")
        new = _verify(near, sets, share)
        if new.isEmpty():
            break
        links = materialise(links.unionByName(new), "links")

    rows = large.join(large.groupBy("node").agg(F.count("*").alias("often")), "node")
    return _by_differences(_of_tiles(rows, open_tiles.select("tile")), sets, bitmaps, links, tested, share)


def _by_differences(rows: DataFrame, sets: DataFrame, bitmaps: DataFrame, links: DataFrame, tested: DataFrame, share: int) -> DataFrame:
    """links and those of components that meet in the tiles of rows (tile, node, often)."""
    sizes: list[int] = []
    while True:
        rows = _rooted(rows, "node", components(links))
        open_tiles = rows.groupBy("tile").agg(F.min("root_node").alias("lo"), F.max("root_node").alias("hi"), F.max(F.struct("often", F.xxhash64("node").alias("h"), "node")).alias("hub"), F.count("*").alias("k"))
        open_tiles = materialise(open_tiles.where("lo < hi").select("tile", "k", F.col("hub.node").alias("hub")), "open")
        if open_tiles.isEmpty():
            return links
        member = materialise(_of_tiles(rows.select("tile", "node", F.col("root_node").alias("root")), open_tiles), "members")
        large = member.where(f"k > {BLOCK}")
        sizes.append(large.count())
        last = not sizes[-1] or len(sizes) > 2 and sizes[-1] >= sizes[-2]
        more = materialise(_in_full(member if last else member.where(f"k <= {BLOCK}"), bitmaps, share).join(tested, ["u", "v"], "left_anti"), "more")
        if not more.isEmpty():
            links = materialise(links.unionByName(_verify(more, sets, share)), "links")
            tested = tested.unionByName(more)
        if last:
            return links
        star = large.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
        star = materialise(star.join(star.groupBy("u").agg(F.count("*").alias("k")), "u"), "star")
        both = _with_values(star, sets).select("u", "v", "k", "value_u", "value_v")
        apart = materialise(both.mapInArrow(tidy(lambda x: _differences(x, share)), "u long, v long, k long, linked boolean, take long, value binary"), "differences")
        counts = apart.select("u", "k", "value").mapInArrow(tidy(_differing), "u long, part int, k long, counts binary").groupBy("u", "part")
        common = counts.applyInArrow(_common, "u long, counts binary").groupBy("u").agg(F.collect_list("counts").alias("counts"))
        narrow = apart.select("u", "v", "take", "value").join(materialise(common, "common"), "u", "left").select("u", "v", "take", "value", "counts")
        rows = materialise(narrow.mapInArrow(tidy(_narrower), "tile long, node long").withColumn("often", F.lit(0).cast("long")), "narrower")
        links = materialise(links.unionByName(apart.where("linked").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))), "links")


def _in_full(member: DataFrame, bitmaps: DataFrame, share: int) -> DataFrame:
    """Of sets (tile, node, root, k), the pairs of a tile from different components whose bitmaps pass. A tile of up to
    BLOCK sets is one group; larger ones are pairs of blocks."""
    member = member.select("tile", "node", "root", F.expr(f"cast(ceil(k / {BLOCK}) as int)").alias("blocks")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    member = member.join(_few(bitmaps, member.select("node").distinct()), "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    member = member.select("tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "n", "value")
    return member.groupBy("tile", "i", "j").applyInArrow(_blocks(share), "u long, v long").distinct()


def _apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of rows (tile, node, often, k), one for each component in a tile, that of the set in most tiles; k is
    summed. Written, so that what has grown together is a row from here on."""
    x = _rooted(rows.select("tile", "node", "often", "k"), "node", roots).groupBy("tile", "root_node")
    x = x.agg(F.max(F.struct("often", (-F.col("node")).alias("least"))).alias("x"), F.sum("k").alias("k"))
    return materialise(x.select("tile", "root_node", (-F.col("x.least")).alias("node"), "x.often", "k"), "apart")


def _open_tiles(member: DataFrame) -> DataFrame:
    """(tile, k) of the tiles whose k sets are of several components, written."""
    tiles = member.groupBy("tile").agg(F.min("root_node").alias("lo"), F.max("root_node").alias("hi"), F.count("*").alias("k"))
    return materialise(tiles.where("lo < hi").select("tile", "k"), "open")


def _of_tiles(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """rows with what tiles (a row for each) has of their tile; a count tells whether tiles may go round."""
    return rows.join(F.broadcast(tiles) if tiles.count() <= BROADCAST_ENTRIES // 8 else tiles, "tile")
