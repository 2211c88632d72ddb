"""Document fingerprints by randomised edit embedding.

A walk reads a text and writes one character a step; a shared random bit for each (step,
character) tells whether it moves on. Two walks over similar texts fall into step again after
an edit, so that the edit distance of texts shows as Hamming distance of what the walks write
(Chakraborty, Goldenberg and Koucky 2016). The fingerprint samples the written string at
shared random steps: at density 2^-level, with the level chosen by length so that every text has
SAMPLES to twice as many samples; the steps of a level are among those of the level below, so
fingerprints of any two lengths can be compared. Each sample is one hex digit of its character.

Bands of sampled digits give candidates, and candidates are verified on their fingerprints; linked
ones make classes (near_classes()).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import materialise, mix, scratch, small_batches, tidy
from .components import components

#: Least number of samples of a text that has as many steps.
SAMPLES = 128
#: The random bits repeat after so many steps; characters share them by a hash to WIDTH.
PERIOD, WIDTH = 4096, 64
#: Code points that a group of texts walks over at once.
CELLS = 4_000_000
BAND = 8
#: Rounds in which classes of a band are compared by one fingerprint of each, before all are; fingerprints in a block of a band.
STAR_ROUNDS, BLOCK = 2, 256


def _salt(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _tables(seed: int):
    """Steps that a character holds the walk for, from each step on; hex digits of characters."""
    at = np.arange(2 * PERIOD * WIDTH, dtype=np.uint64).reshape(2 * PERIOD, WIDTH) % np.uint64(PERIOD * WIDTH)
    moves = (mix(at + _salt(seed)) >> np.uint64(40)) & np.uint64(1) == 1
    stay = np.zeros((2 * PERIOD, WIDTH), np.int32)
    far = np.full(WIDTH, PERIOD, np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):
        far = np.where(moves[j], 1, far + 1)
        stay[j] = far
    digits = (mix(np.arange(WIDTH, dtype=np.uint64) + _salt(seed + 1)) >> np.uint64(20)).astype(np.uint8) & 15
    return np.minimum(stay[:PERIOD], PERIOD), digits


class Walks:
    """Fingerprints of texts. One object holds the shared randomness of a seed."""

    def __init__(self, seed: int = 11):
        self.seed = seed
        self.stay, self.digits = _tables(seed)
        self.flat = self.stay.ravel()
        self.known: dict[int, np.ndarray] = {}  # sampled steps by level
        self.upto: dict[int, int] = {}

    def steps(self, level: int, end: int) -> np.ndarray:
        """Sampled steps below end: those whose hash is 0 modulo 2^level."""
        if self.upto.get(level, -1) < end:
            upto = max(1 << (level + 12), 1 << int(end).bit_length())
            found = []
            for lo in range(0, upto, 1 << 20):
                t = np.arange(lo, min(upto, lo + (1 << 20)), dtype=np.uint64)
                h = mix(t + _salt(self.seed + 2))
                found.append(t[h & np.uint64((1 << level) - 1) == 0].astype(np.int64))
            self.known[level], self.upto[level] = np.concatenate(found), upto
        s = self.known[level]
        return s[: np.searchsorted(s, end)]

    def fingerprints(self, codes: list[np.ndarray]) -> list[str]:
        """codes: the UTF-32 code points of each text."""
        out: list[str] = [""] * len(codes)
        order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
        at = 0
        while at < len(order):
            longest = max(1, len(codes[order[at]]))
            group = order[at : at + max(1, CELLS // longest)]
            at += len(group)
            self._walk([codes[i] for i in group], group, out)
        return out

    def _walk(self, texts: list[np.ndarray], names: list[int], out: list[str]) -> None:
        lengths = np.array([len(t) for t in texts])
        longest = int(lengths[0])
        seen = np.zeros((longest, len(texts)), np.uint8)  # a row for each place in the texts
        for k, t in enumerate(texts):
            seen[: len(t), k] = mix(t.astype(np.uint64)) & np.uint64(WIDTH - 1)
        step = np.zeros(len(texts), np.int64)
        ends = np.empty((longest, len(texts)), np.int32)
        live = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")  # texts that long
        for i, k in enumerate(live.tolist()):
            step[:k] += self.flat[(step[:k] & (PERIOD - 1)) * WIDTH + seen[i, :k]]
            ends[i, :k] = step[:k]
        ends = np.ascontiguousarray(ends.T)
        for k, name in enumerate(names):
            n = int(lengths[k])
            total = int(ends[k, n - 1]) if n else 0
            level = max(0, (total // SAMPLES).bit_length() - 1)
            steps = self.steps(level, total)
            place = np.searchsorted(ends[k, :n], steps, "right")
            out[name] = f"{level}:" + HEX[self.digits[seen[place, k]]].tobytes().decode()

    def likeness(self, a: str, b: str) -> float:
        """Share of equal digits at common steps, 0 to 1; a step that one walk lacks differs."""
        if a == b:
            return 1.0
        (la, a), (lb, b) = ((int(x.split(":")[0]), x.split(":")[1]) for x in (a, b))
        level = max(la, lb)
        a, b = self._at(la, a, level), self._at(lb, b, level)
        k = min(len(a), len(b))
        return float((a[:k] == b[:k]).sum() / max(len(a), len(b), 1))

    def _at(self, own: int, digits: str, level: int) -> np.ndarray:
        x = np.frombuffer(digits.encode(), np.uint8)
        if own < level:
            end = 1 << (own + 12)
            while len(steps := self.steps(own, end)) < len(x):
                end *= 2
            h = mix(steps[: len(x)].astype(np.uint64) + _salt(self.seed + 2))
            x = x[h & np.uint64((1 << level) - 1) == 0]
        return x


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: str, nxt: str) -> str:
    """The last half of text (rounded down) replaced by as many first characters of nxt, or all."""
    k = len(text) // 2
    return text[: len(text) - k] + nxt[:k]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "first", "text"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first boolean, text string"


def _rows(walks: Walks, ids: list, texts: list[str]):
    """Rows of all but the last text, each with its next; whose texts are at the ends stay with them."""
    if len(texts) < 2:
        return []
    new = [edited(a, b) for a, b in zip(texts, texts[1:])]
    prints = walks.fingerprints([points(t) for t in [*texts, *new]])
    own, after = prints[: len(texts)], prints[len(texts) :]
    return [(ids[i], len(texts[i]), hashlib.sha256(new[i].encode("utf-8", "surrogatepass")).hexdigest(), own[i], after[i], walks.likeness(own[i], after[i]), walks.likeness(own[i], own[i + 1]), None, None) for i in range(len(new))]


def _compare(batches, seed: int):
    """Sorted rows of a range in; finished rows out, and the range's first and last text."""
    walks = Walks(seed)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=NAMES)

    ids, texts, size, started = [], [], 0, False
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not started:
                started = True
                yield batch([(i, None, None, None, None, None, None, True, t or "")])
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size > CELLS // 2 and len(ids) > 1:
                if rows := _rows(walks, ids, texts):
                    yield batch(rows)
                ids, texts = ids[-1:], texts[-1:]
                size = len(texts[0])
    if rows := _rows(walks, ids, texts):
        yield batch(rows)
    if ids:
        yield batch([(ids[-1], None, None, None, None, None, None, False, texts[-1])])


def _close(batches, seed: int):
    """The last text of each range with the first of the next."""
    walks = Walks(seed)
    for b in batches:
        rows = []
        for i, t, nxt in zip(*[c.to_pylist() for c in b.columns], strict=True):
            rows.append(_rows(walks, [i, None], [t, nxt])[0][:7])
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=NAMES[:7])


def compare_with_next(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (see edited()), and their likeness to
    it and of the next document's, in ascending order of id, then of a hash of the text, then text;
    the last one's next is the first.

    Null texts are empty; an empty text's fingerprint has no sample. Null ids come first.
    Repeated rows follow each other. A single row is its own next. An empty table gives none.
    Texts are ranged once, by id and hash; what crosses from one range to the next are two texts a range.
    """
    small_batches(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"coalesce(cast(`{text_col}` as string), '') text")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    done = materialise(ranged.mapInArrow(tidy(lambda x: _compare(x, seed)), SCHEMA).withColumn("range", F.spark_partition_id()), "compared")
    edges = done.where("first is not null").select("range", "first", "doc_id", "text")
    # Of ranges that have rows, which follows which: two numbers a range, no text.
    ranges = sorted(r["range"] for r in edges.where("first").select("range").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "range int, after int")
    firsts = edges.where("first").select(F.col("range").alias("after"), F.col("text").alias("next"))
    pairs = edges.where("not first").join(F.broadcast(follows), "range").join(firsts, "after").select("doc_id", "text", "next")
    last = pairs.mapInArrow(tidy(lambda x: _close(x, seed)), SCHEMA.split(", first")[0])
    return done.where("first is null").select(*NAMES[:7]).unionByName(last)


# --- bands and classes ------------------------------------------------------------------------


def _bands(batches, seed: int):
    """(node, key) of each band of a fingerprint, at its own level and at the next coarser one."""
    walks = Walks(seed)
    for b in batches:
        nodes, keys = [], []
        for node, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own, digits = int(p.split(":")[0]), p.split(":")[1]
            for level in (own, own + 1):
                x = walks._at(own, digits, level)
                k = max(1, len(x) // BAND)
                whole = np.zeros((k, BAND), np.uint8)
                whole.reshape(-1)[: min(len(x), k * BAND)] = x[: k * BAND]
                value = np.ascontiguousarray(whole).view(np.uint64)[:, 0]
                place = np.arange(k, dtype=np.uint64) + np.uint64(level << 40)
                nodes.append(np.full(k, node, np.int64))
                keys.append(mix(value ^ mix(place)))
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(keys).view(np.int64))], names=["node", "key"])


def _alike(batches, least: float, seed: int):
    """Of (u, v, fingerprints), the (u, v) whose likeness is enough."""
    walks = Walks(seed)
    for b in batches:
        ok = [(u, v) for u, v, p, q in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True) if walks.likeness(p, q) >= least]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in ok], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _tile(least: float, seed: int):
    def run(table: pa.Table) -> pa.Table:
        """The pairs of two blocks of a band, of different classes, whose fingerprints are alike enough."""
        walks = Walks(seed)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, root, block = (np.asarray(table.column(c)) for c in ("node", "root", "block"))
        prints = [(int(x.split(":")[0]), x.split(":")[1]) for x in table.column("p").to_pylist()]
        us, vs = [], []
        for level in sorted({p[0] for p in prints}):
            # Those of this level with those of it and of finer ones.
            at = np.array([k for k, p in enumerate(prints) if p[0] <= level], np.int64)
            digits = [walks._at(*prints[k], level) for k in at]
            size = np.array([len(d) for d in digits])
            matrix = np.zeros((len(at), max(size.max(), 1)), np.uint8)
            for k, d in enumerate(digits):
                matrix[k, : len(d)] = d
            here = np.array([prints[k][0] == level for k in at])
            left, right = np.flatnonzero(here), np.arange(len(at))
            for k in left.tolist():
                ok = (root[at[right]] != root[at[k]]) & (~here[right] | (node[at[right]] > node[at[k]]))
                ok &= ((block[at[right]] == i) & (block[at[k]] == j)) | ((block[at[right]] == j) & (block[at[k]] == i))
                rows = right[ok]
                same = ((matrix[rows] == matrix[k]) & (matrix[rows] > 0)).sum(axis=1)
                hit = at[rows[same >= least * np.maximum(np.maximum(size[rows], size[k]), 1)]]
                us.append(np.minimum(node[at[k]], node[hit]))
                vs.append(np.maximum(node[at[k]], node[hit]))
        empty = np.zeros(0, np.int64)
        return pa.table({"u": pa.array(np.concatenate([empty, *us])), "v": pa.array(np.concatenate([empty, *vs]))})

    return run


def near_classes(prints: DataFrame, least: float = 0.75, seed: int = 11, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """(doc_id, class_id) of each row: fingerprints that share a band and are at least so alike are
    of one class, whose class_id is its smallest id. Null fingerprints are of no class, null ids
    name none.

    A band is BAND neighbouring samples at one place of a level; each fingerprint has those of its
    own and of the next coarser level, so that texts of up to twice the length share some. Equal
    fingerprints are one node. In a band every node is compared with one that the band has in
    common; classes that still meet in a band are compared by one node of each for a few rounds, then
    in full, in blocks, so that no band is left out however frequent, and none meets in one task.
    """
    spark = prints.sparkSession
    small_batches(spark)
    rows = prints.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{print_col}`").alias("p"), F.xxhash64(F.col(f"`{print_col}`")).alias("node"))
    with scratch(spark):
        nodes = materialise(rows.where("p is not null").groupBy("node", "p").agg(F.min("doc_id").alias("first")), "nodes")
        bands = materialise(nodes.select("node", "p").mapInArrow(tidy(lambda x: _bands(x, seed)), "node long, key long").distinct(), "bands")
        shared = bands.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("hub")).where("k > 1")
        tiles = materialise(bands.join(shared, "key"), "tiles")
        values = nodes.select("node", F.lit(0).cast("long").alias("n"), F.col("p").alias("value"))

        def verified(pairs: DataFrame) -> DataFrame:
            both = jaccard._with_values(materialise(pairs, "pairs"), values).select("u", "v", "value_u", "value_v")
            return materialise(both.mapInArrow(tidy(lambda x: _alike(x, least, seed)), "u long, v long"), "links")

        tested = materialise(tiles.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct(), "tested")
        links = verified(tested)
        tiles = tiles.where("k > 2").select(F.col("key").alias("tile"), "node")
        for _ in range(STAR_ROUNDS):
            roots = components(links)
            open_ = jaccard._open_tiles(jaccard._rooted(tiles, "node", roots))
            one = jaccard._rooted(jaccard._of_tiles(tiles, open_), "node", roots).groupBy("tile", "root_node").agg(F.min("node").alias("node"))
            # A hash of (tile, root) picks the one that the others are compared with, anew in each tile.
            hub = one.groupBy("tile").agg(F.max(F.struct(F.xxhash64("tile", "root_node").alias("h"), "root_node", "node")).alias("hub"))
            star = jaccard._of_tiles(one, hub).where("root_node <> hub.root_node").select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")).distinct()
            star = materialise(star.join(tested, ["u", "v"], "left_anti"), "star")
            new = verified(star)
            tested = materialise(tested.unionByName(star), "tested")
            if new.isEmpty():
                break
            links = materialise(links.unionByName(new), "links")
        roots = components(links)
        open_ = jaccard._open_tiles(jaccard._rooted(tiles, "node", roots)).withColumn("blocks", F.expr(f"cast(ceil(k / {BLOCK}) as int)"))
        member = jaccard._rooted(jaccard._of_tiles(tiles, open_), "node", roots).withColumnRenamed("root_node", "root")
        member = member.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).join(nodes.select("node", "p"), "node")
        member = member.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        member = member.select("tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "p")
        more = materialise(member.groupBy("tile", "i", "j").applyInArrow(_tile(least, seed), "u long, v long").distinct(), "more")
        label = jaccard._rooted(nodes.select("node", "first"), "node", components(links.unionByName(more)))
        least_id = label.groupBy("root_node").agg(F.min("first").alias("class_id"))
        label = materialise(label.join(least_id, "root_node").select(F.col("node").alias("node_"), "class_id"), "label", keep=True)
    return rows.join(label, F.col("node") == F.col("node_"), "left").select("doc_id", F.when(F.col("p").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
