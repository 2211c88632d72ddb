"""Line dedup by log templates.

A line's tokens are its words; a token with a digit is a variable field. A tree of fixed depth
parses lines by their number of tokens, then by their DEPTH leading tokens. In a leaf a token
after these is constant if at least min_docs documents have it at that place, and a variable field
otherwise. What remains is the line's template, if at least `similar` of its tokens are constant. A
template recurs if documents of at least min_docs classes have it, and then its lines are
dropped from every document. A class is all documents of one text; of documents that would lose
more than half their words, those that are near copies by the n-gram Jaccard join are one class
too, so that what only copies of a page share does not recur.

Counts are by 64-bit hashes. Every step sums partial counts of tasks; no leaf meets in one
task. Lines of rare leaves are skipped by a bit table of fixed size, whose false hits cost
time only, since leaves of too few documents have no template that recurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, jaccard
from .common import materialise, mix, scratch, slices, small_batches, span_hashes, tidy, word_spans

DEPTH = 2
MIN_DOCS = 5
#: Constant tokens of a template, in percent of all.
SIMILAR = 60
LEAF_BITS = 1 << 26
FIELD = np.uint64(0x2545F4914F6CDD1D)
STEP = 0x9E3779B97F4A7C15
HELD = 1_000_000
#: Counted tokens that a range holds on average.
ENTRIES = 200_000


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(max(n, 1), STEP, np.uint64))


def _sums(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first + n] - total[first]


class Lines:
    """The lines of a slice of rows: row, byte span, tokens, leaf and hash of all tokens."""

    def __init__(self, off: np.ndarray, data: np.ndarray):
        starts, ends, _ = word_spans(off, data)
        edges = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]))
        edges = edges[edges < len(data)]
        self.row = np.searchsorted(off, edges, "right") - 1
        stop = np.append(edges[1:], len(data)) if len(edges) else edges
        self.start, self.stop = edges, stop  # the newline belongs to its line
        self.first = np.searchsorted(starts, edges)
        self.n = np.searchsorted(starts, stop) - self.first
        self.token = span_hashes(data, starts, ends)
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        self.token[digits[ends] > digits[starts]] = FIELD
        power = _powers(int(self.n.max()) if len(self.n) else 0)
        at = np.arange(len(self.token)) - np.repeat(self.first, self.n)
        with np.errstate(over="ignore"):
            part = self.token * power[at] if len(at) else self.token
            size = self.n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            self.leaf = mix(_sums(part, self.first, np.minimum(self.n, DEPTH)) ^ size ^ np.uint64(1))
            self.exact = mix(_sums(part, self.first, self.n) ^ size ^ np.uint64(2))


def _constants(leaf: np.ndarray, n: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place in `token`, key of (leaf, place in line, token)) of the tokens that may be
    constant. The upper byte of a key is its leaf's."""
    line = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    found = np.flatnonzero((at >= DEPTH) & (token != FIELD))
    with np.errstate(over="ignore"):
        h = mix(leaf[line[found]] ^ mix(token[found] + at[found].astype(np.uint64) * np.uint64(STEP)))
    top = np.uint64(56)
    return line[found], found, leaf[line[found]] >> top << top | h >> np.uint64(8)


class Counts:
    """Documents by hash, summed in a task and passed on in parts (hashes, numbers)."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, row: np.ndarray, h: np.ndarray):
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        self.parts.append(h[keep])
        self.held += int(keep.sum())
        if self.held > HELD:
            yield from self.flush()

    def flush(self):
        if self.held:
            yield np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.held = [], 0


def _leaves(batches):
    def rows(parts):
        for h, n in parts:
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "docs"])

    counts = Counts()
    for b in batches:
        for _, off, data in slices(b.column(0)):
            x = Lines(off, data)
            yield from rows(counts.add(x.row[x.n > 0], x.leaf[x.n > 0]))
    yield from rows(counts.flush())


def _bits(batches):
    chunks: dict[int, np.ndarray] = {}
    for b in batches:
        x = np.asarray(b.column(0)).astype(np.int64) & (LEAF_BITS - 1)
        for c in np.unique(x >> 16).tolist():
            at = x[x >> 16 == c] & 0xFFFF
            np.bitwise_or.at(chunks.setdefault(c, np.zeros(1 << 13, np.uint8)), at >> 3, (128 >> (at & 7)).astype(np.uint8))
    rows = sorted(chunks.items())
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["chunk", "bits"])


def _held(packed: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Whether the bit table has each leaf; it stays packed, since a byte for each bit would be 64 MB in every worker."""
    at = leaf & np.uint64(LEAF_BITS - 1)
    return packed[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


LINE = "row long, text long, words long, line int, n int, leaf long, exact long, tokens binary"


def _candidates(batches, packed: np.ndarray, ranges: int):
    """The lines of leaves that the table holds, as LINE, and (range, counts) of what may be constant in them."""
    counts = Counts()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in LINE.split(", ")] + ["range", "counts"]

    def summed(parts):
        for h, n in parts:
            order, cuts = jaccard._cuts(h % np.uint64(ranges))
            h, n = h[order], n[order].astype(np.uint32)
            k = len(cuts)
            blobs = [h[a:b].tobytes() + n[a:b].tobytes() for _, a, b in cuts]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(k, t) for t in types[:8]], pa.array([c[0] for c in cuts], types[8]), pa.array(blobs, types[9])], names=names)

    for b in batches:
        rows, texts = np.asarray(b.column(0)), np.asarray(b.column(1))
        for lo, off, data in slices(b.column(2)):
            x = Lines(off, data)
            at = np.flatnonzero((x.n > 0) & _held(packed, x.leaf))
            if not len(at):
                continue
            n, first = x.n[at], x.first[at]
            ends = np.cumsum(n)
            token = x.token[np.arange(ends[-1]) + np.repeat(first - (ends - n), n)]
            line, _, key = _constants(x.leaf[at], n, token)
            yield from summed(counts.add(x.row[at][line], key))
            words = np.bincount(x.row, x.n, len(off) - 1).astype(np.int64)
            own = lo + x.row[at]
            place = at - np.searchsorted(x.row, x.row[at])
            raw, cut = token.tobytes(), (8 * ends).tolist()
            tokens = [raw[i:j] for i, j in zip([0, *cut[:-1]], cut, strict=True)]
            cols = [rows[own], texts[own], words[x.row[at]], place, n, x.leaf[at].view(np.int64), x.exact[at].view(np.int64), tokens]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types)], pa.nulls(len(at), types[8]), pa.nulls(len(at), types[9])], names=names)
    yield from summed(counts.flush())


def _frequent(min_docs: int):
    def run(table: pa.Table) -> pa.Table:
        """The keys of a range that at least min_docs documents have."""
        parts = [jaccard._counted(x) for x in table.column("counts").to_pylist()]
        h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(h))
        return pa.table({"key": pa.array(h[n >= min_docs].view(np.int64))})

    return run


def _inside(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is in the sorted table."""
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x if len(table) else np.zeros(len(x), bool)


def _templated(batches, constants: np.ndarray, similar: int):
    """(row, text, words, line, n, exact, template) of the lines that have a template."""
    for b in batches:
        row, text, words, line, n, leaf, exact = (np.asarray(b.column(i)) for i in range(7))
        leaf, n = leaf.view(np.uint64), n.astype(np.int64)
        token = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64)
        _, at, key = _constants(leaf, n, token)
        at = at[~_inside(constants, key)]
        token = token.copy()
        token[at] = FIELD
        first = np.cumsum(n) - n
        place = np.arange(len(token)) - np.repeat(first, n)
        with np.errstate(over="ignore"):
            template = mix(_sums(token * _powers(int(n.max()) if len(n) else 0)[place] if len(token) else token, first, n) ^ leaf)
        constant = _sums((token != FIELD).astype(np.uint64), first, n).astype(np.int64)
        ok = 100 * constant >= similar * n
        cols = [row[ok], text[ok], words[ok], line[ok], n[ok].astype(np.int32), exact[ok], template[ok].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "text", "words", "line", "n", "exact", "template"])


def _sorted_longs(df: DataFrame) -> np.ndarray:
    """A column of longs, few as counted by the caller, as a sorted array."""
    parts = [np.asarray(b.column(0)) for b in df.toArrow().to_batches()]
    return np.sort(np.concatenate([np.zeros(0, np.int64), *parts]).view(np.uint64))


def recurring(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS, similar: int = SIMILAR, entries: int | None = None) -> DataFrame:
    """(row, line, exact) of the lines of recurring templates. row: xxhash64 of id and
    text; exact: hash of the line's tokens."""
    spark = docs.sparkSession
    entries = common.BROADCAST_ENTRIES if entries is None else entries
    row, text = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.xxhash64(F.col(f"`{text_col}`"))
    texts = docs.select(row.alias("row"), text.alias("key"), F.col(f"`{text_col}`").alias("text"))
    leaves = texts.select("text").mapInArrow(tidy(_leaves), "hash long, docs long").groupBy("hash").agg(F.sum("docs").alias("docs")).where(f"docs >= {min_docs}")
    leaves = materialise(leaves, "leaves")
    lines = leaves.agg(F.sum("docs").alias("n")).first()["n"] or 0
    bits = leaves.select("hash").repartition(F.expr(f"(hash & {LEAF_BITS - 1}) >> 16")).mapInArrow(tidy(_bits), "chunk int, bits binary")
    packed = np.zeros((LEAF_BITS >> 16, 1 << 13), np.uint8)
    for r in bits.toLocalIterator():  # at most LEAF_BITS
        packed[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    packed = spark.sparkContext.broadcast(packed.ravel())
    ranges = max(16, 20 * lines // ENTRIES)
    found = materialise(texts.mapInArrow(tidy(lambda x: _candidates(x, packed.value, ranges)), f"{LINE}, range int, counts binary"), "lines")
    packed.destroy()
    constants = materialise(found.where("range is not null").select("range", "counts").groupBy("range").applyInArrow(_frequent(min_docs), "key long"), "constants")
    lines = found.where("range is null").select(*[f.split()[0] for f in LINE.split(", ")])
    # Constants go round in as many parts, by their leaves' upper byte, as keep each part small.
    count, parts = constants.count(), 1
    while count > entries * parts and parts < 256:
        parts *= 2
    of, out = "shiftrightunsigned({0}, 56) % " + str(parts), None
    for part in range(parts):
        table = spark.sparkContext.broadcast(_sorted_longs(constants.where(f"{of.format('key')} = {part}")))
        got = lines.where(f"{of.format('leaf')} = {part}").mapInArrow(tidy(lambda x, table=table: _templated(x, table.value, similar)), "row long, text long, words long, line int, n int, exact long, template long")
        got = materialise(got, "templates")
        table.destroy()
        out = got if out is None else out.unionByName(got)

    def in_classes(rows: DataFrame) -> DataFrame:
        return rows.select("template", "class").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(f"docs >= {min_docs}").select("template")

    def of(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of the templates found, which go round if a count allows: no template meets in one task."""
        found = materialise(found, "found")
        return rows.join(F.broadcast(found) if found.count() <= entries else found, "template", "left_semi")

    hits = materialise(of(out, in_classes(out.withColumn("class", F.col("text")))), "hits")
    over = hits.groupBy("row").agg(F.sum("n").alias("lost"), F.first("words").alias("words"), F.first("text").alias("key")).where("2 * lost > words")
    over = materialise(over.groupBy("key").agg(F.min("row").alias("row")).select("row"), "over")
    some = over.count()
    if some > 1:
        mostly = materialise(texts.join(F.broadcast(over) if some <= entries else over, "row", "left_semi").select("key", "text"), "mostly")
        same = jaccard.similarity_components(mostly, "key").select(F.col("doc_id").alias("text"), "component_id").distinct()
        classed = hits.join(same, "text", "left").withColumn("class", F.coalesce("component_id", "text"))
        hits = of(hits, in_classes(classed))
    return hits.select("row", "line", "exact")


def _cut(x: Lines, off, data, hit_lines: np.ndarray):
    """By row: the text without the hit lines, lines, dropped lines."""
    n = len(off) - 1
    drop = np.zeros(len(x.n), bool)
    drop[hit_lines] = True
    raw = data.tobytes()
    by_row = np.searchsorted(x.row, np.arange(n + 1))
    texts = []
    for i, cut in enumerate(np.bincount(x.row[drop], minlength=n).tolist()):
        if cut:
            a, b = by_row[i], by_row[i + 1]
            kept = b"".join(raw[x.start[j] : x.stop[j]] for j in range(a, b) if not drop[j])
            # A dropped last line takes the newline before it along.
            texts.append(kept[:-1] if drop[b - 1] and kept.endswith(b"\n") else kept)
        else:
            texts.append(raw[off[i] : off[i + 1]])
    return texts, np.diff(by_row).tolist(), np.bincount(x.row[drop], minlength=n).tolist()


def _drop(batches, hits, text_at: int, schema: list[str]):
    """Rows with the text cut, and n_lines and n_dropped behind. hits: of (batch, first row, Lines), its lines to drop."""
    for b in batches:
        texts, lines, dropped = [], [], []
        column = b.column(text_at)
        for lo, off, data in slices(column):
            x = Lines(off, data)
            for col, new in zip((texts, lines, dropped), _cut(x, off, data, hits(b, lo, x)), strict=True):
                col += new
        valid = column.is_valid().to_pylist()
        cols = list(b.columns)[: len(schema) - 2]
        cols[text_at] = pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=schema)


def _by_hash(table: np.ndarray):
    return lambda b, lo, x: np.flatnonzero(_inside(table, x.exact) & (x.n > 0))


def _by_list(b, lo: int, x: Lines) -> np.ndarray:
    listed, rows = b.column(b.num_columns - 1).to_pylist(), np.unique(x.row)
    return np.array([f + j for i, f in zip(rows.tolist(), np.searchsorted(x.row, rows).tolist()) for j in listed[lo + i] or ()], np.int64)


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, similar: int = SIMILAR, broadcast_entries: int | None = None) -> DataFrame:
    """Every row of docs with the lines of recurring templates cut from its text, and n_lines
    and n_dropped.

    Null texts stay null, empty ones empty; both have no line. Lines without a word stay. A
    template counts once for a document however often it stands there; rows of one text count
    once together, whatever their ids. Texts and single lines of any length are parsed whole. An
    empty table gives none. Columns of docs named like ours are replaced. Hashes of the lines to drop
    go to the tasks as a sorted array of 8 bytes each if there are no more than
    broadcast_entries; otherwise the lines are joined by their rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ours = ["n_lines", "n_dropped"]
    docs = docs.drop(*ours).withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    names, text_at = [*docs.columns, *ours], docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField(k, T.LongType()) for k in ours])
    most = common.BROADCAST_ENTRIES if broadcast_entries is None else broadcast_entries
    with scratch(spark):
        hits = materialise(recurring(docs, text_col, id_col, min_docs, similar, broadcast_entries), "hits", keep=True)
    exact = materialise(hits.select("exact").distinct(), "exact")
    if exact.count() <= most:
        table = spark.sparkContext.broadcast(_sorted_longs(exact))
        return docs.mapInArrow(tidy(lambda x: _drop(x, _by_hash(table.value), text_at, names)), schema)
    listed = hits.groupBy("row").agg(F.collect_set("line").alias("__lines"))  # at most a text's lines
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    joined = docs.withColumn("__key", key).join(listed, F.col("__key") == F.col("row"), "left").select(*[f"`{c}`" for c in docs.columns], "__lines")
    return joined.mapInArrow(tidy(lambda x: _drop(x, _by_list, text_at, names)), schema)
