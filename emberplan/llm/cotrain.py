"""Quality classifier by co-training two naive Bayes views.

The text view sees which words and pairs of words a text has and what its characters are; the
metadata view its source, language, size and layout. No feature is in both, and the text view
does not see length: only words that tell the classes apart count. Each is a naive Bayes model, over hashed
words and binned features, so a model is a table of counts and a round of training is one sum
over all documents. Both start from the labelled ones. In each
round every unlabelled document that one view is confident of goes, with that pseudo-label,
into the other view's training. Part of the labelled documents stays out of training: on them each
view's log-odds are calibrated (logistic regression on their histogram), and the calibrated
views are added, less the prior they share.

Which buckets of words and pairs tell the classes apart is found on a bounded sample of labelled
rows (Training.word_rows, those with the least hashes of their ids), so a document's features are
some bytes and the few such buckets that it has; the tables that go round are those and the
models, never texts. Nothing but summed counts comes to the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialise, slices, small_batches, span_hashes, tidy, window_hashes, word_spans
from .divergence import base_counts, class_counts

BINS = 32
TEXT = ("symbols", "upper", "digits", "marks", "other", "beyond_ascii", "word_length", "short_words", "distinct", "repeated", "marked_words", "repeated_lines")
META = ("source", "lang", "chars", "lines", "line_length", "longest_line")
FEATURES = len(TEXT) + len(META)
#: Buckets of hashed words and pairs of words; a bucket counts if its shares in the classes differ by so
#: many standard errors; the log-odds of a document's words stay within bounds.
WORD_BUCKETS, LEAST_Z, MOST_ODDS = 1 << 14, 6.0, 4.0


@dataclass(frozen=True)
class Training:
    rounds: int = 3
    confident: float = 0.98
    smoothing: float = 0.5
    #: One labelled document in so many calibrates and doesn't train.
    calibrate_every: int = 4
    #: Weight of pseudo-labelled documents against labelled ones.
    pseudo_weight: float = 0.25
    #: Labelled rows, about, on which the words that count are chosen.
    word_rows: int = 20_000


@dataclass(frozen=True)
class Model:
    text: np.ndarray  # log-odds of good by (feature, bin)
    words: np.ndarray  # by bucket of words
    chosen: np.ndarray  # whether a bucket counts
    meta: np.ndarray
    priors: tuple[float, float]  # each view's log-odds before any feature
    text_fit: tuple[float, float]
    meta_fit: tuple[float, float]
    prior: float

    def views(self, bins: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """bins: by row and feature; words: the buckets of all rows, sizes: how many each has."""
        k = len(TEXT)
        text = self.priors[0] + self.text[np.arange(k), bins[:, :k]].sum(axis=1)
        text = text + np.clip(np.bincount(np.repeat(np.arange(len(bins)), sizes), self.words[words], len(bins)), -MOST_ODDS, MOST_ODDS)
        meta = self.priors[1] + self.meta[np.arange(len(META)), bins[:, k:]].sum(axis=1)
        return text, meta

    def score(self, bins: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        text, meta = self.views(bins, words, sizes)
        z = self.text_fit[0] + self.text_fit[1] * text + self.meta_fit[0] + self.meta_fit[1] * meta - self.prior
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _share(x, of):
    """Bins of a share: 0, then halving steps from 1/2^15 up, finer above 1/8."""
    s = x / np.maximum(of, 1)
    fine = np.ceil(np.clip(s, 0, 1) * 16 - 2)
    coarse = np.ceil(np.log2(np.maximum(s, 1e-9)) + 15)
    return np.where(s <= 0, 0, np.where(s > 1 / 8, 13 + fine, np.clip(coarse, 1, 12))).astype(np.int64)


def _log(x):
    return np.clip(np.floor(2 * np.log2(np.maximum(x, 1))), 0, BINS - 1).astype(np.int64)


def _buckets(h: np.ndarray, row: np.ndarray, n: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct chosen buckets of words and pairs of neighbours of all rows, and how many each row has."""
    pairs = window_hashes(h, 2)
    inside = np.flatnonzero(row[: len(pairs)] == row[1 : 1 + len(pairs)])
    bucket = np.concatenate([h, pairs[inside]]) & np.uint64(WORD_BUCKETS - 1)
    keep = np.flatnonzero(chosen[bucket.astype(np.int64)])
    row = np.concatenate([row, row[inside]])[keep].astype(np.uint64)
    keyed = np.unique(row << np.uint64(32) | bucket[keep])
    return (keyed & np.uint64(WORD_BUCKETS - 1)).astype(np.uint16), np.bincount((keyed >> np.uint64(32)).astype(np.int64), minlength=n)


def features(text: pa.Array, source: list, lang: list, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (rows, FEATURES), uint8; the distinct chosen buckets of words and pairs of all rows, and how
    many each row has. Null texts count as empty, null names as one name."""
    out, buckets, sizes = [], [], []
    for lo, off, data in slices(text):
        n = len(off) - 1
        starts, ends, at = word_spans(off, data)
        base = base_counts(off, data, starts, ends, at)
        classes = class_counts(off, data)
        chars, words = classes.sum(axis=1), base["n_words"]
        size = ends - starts
        row = np.repeat(np.arange(n), words)
        letters = classes[:, 0] + classes[:, 1] + classes[:, 7]
        low = LOWER[data]
        h = span_hashes(low, starts, ends)
        order = np.lexsort((h, row))
        again = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
        repeats = np.bincount(row[order][1:][again], minlength=n) if len(row) else np.zeros(n)
        last = data[ends - 1] if len(ends) else data[:0]
        marked = ~(((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | (last >= 128))
        newline = np.flatnonzero(data == 10)
        line_row = np.searchsorted(off, newline, "right") - 1
        lines = np.bincount(line_row, minlength=n) + 1
        edges = np.unique(np.concatenate([off[:-1], newline + 1]))
        edges = edges[edges < len(data)]
        lengths = np.diff(np.append(edges, len(data)))
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, np.searchsorted(off, edges, "right") - 1, lengths)
        # Repetition grows with length by itself: bins are taken against the square root.
        cols = [
            _share(classes[:, 4], chars),
            _share(classes[:, 1], letters),
            _share(classes[:, 2], chars),
            _share(classes[:, 5], chars),
            _share(classes[:, 6], chars),
            _share(classes[:, 7], letters),
            np.clip(np.floor(2 * base["word_chars"] / np.maximum(words, 1)), 0, BINS - 1).astype(np.int64),
            _share(np.bincount(row[size <= 3], minlength=n), words),
            _share(repeats, words),
            _share(base["n_repeat_words"], words),
            _share(np.bincount(row[marked], minlength=n), words),
            _share(base["n_dup_lines"], lines),
            np.array([zlib.crc32(str(x).encode()) % BINS for x in source[lo : lo + n]]),
            np.array([zlib.crc32(str(x).encode()) % BINS for x in lang[lo : lo + n]]),
            _log(chars),
            _log(lines),
            _log(chars / lines),
            _log(longest),
        ]
        out.append(np.stack(cols, axis=1).astype(np.uint8))
        found, size = _buckets(h, row, n, chosen)
        buckets.append(found)
        sizes.append(size)
    if not out:
        return np.zeros((0, FEATURES), np.uint8), np.zeros(0, np.uint16), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(buckets), np.concatenate(sizes)


def _word_counts(batches):
    """(good, bucket, docs): in how many labelled documents a bucket is; bucket -1 counts them all."""
    found, n = np.zeros((2, WORD_BUCKETS), np.int64), [0, 0]
    every = np.ones(WORD_BUCKETS, bool)
    for b in batches:
        good = np.asarray(b.column(1))
        for lo, off, data in slices(b.column(0)):
            data = LOWER[data]
            starts, ends, at = word_spans(off, data)
            row = np.repeat(np.arange(len(off) - 1), np.diff(at))
            words, sizes = _buckets(span_hashes(data, starts, ends), row, len(off) - 1, every)
            own = good[lo : lo + len(off) - 1]
            for y in (0, 1):
                n[y] += int((own == y).sum())
                found[y] += np.bincount(words[np.repeat(own == y, sizes)], minlength=WORD_BUCKETS)
    at = np.argwhere(found)
    cols = [np.append(at[:, 0], [0, 1]), np.append(at[:, 1], [-1, -1]), np.append(found[tuple(at.T)], n)]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["good", "bucket", "docs"])


def _gaps(words: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All rows' ascending buckets as gaps between their ranks among the chosen ones, and how many bytes
    each row has. A gap is a byte below 255, behind as many bytes of 255 as it has in it."""
    rank = (np.cumsum(chosen) - 1)[words]
    gap = np.diff(rank, prepend=-1) - 1
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    gap[first] = rank[first]
    n = 1 + gap // 255
    out = np.full(n.sum(), 255, np.uint8)
    out[np.cumsum(n) - 1] = gap % 255
    return out.tobytes(), np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])])


def _ranks(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _gaps wrote: the ranks of all rows, and how many each row has."""
    last = np.flatnonzero(raw != 255)
    gap = np.diff(np.cumsum(raw, dtype=np.int64)[last], prepend=0)
    sizes = np.diff(np.searchsorted(last, np.concatenate([[0], np.cumsum(lengths)])))
    at = np.cumsum(gap + 1)
    before = np.concatenate([[0], at])[np.cumsum(sizes) - sizes]
    return at - 1 - np.repeat(before, sizes), sizes


def _featured(batches, chosen: np.ndarray):
    for b in batches:
        x, words, sizes = features(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), chosen)
        raw, sizes = _gaps(words, sizes, chosen)
        ends = np.cumsum(sizes).tolist()
        own = [r.tobytes() + raw[i:j] for r, i, j in zip(x, [0, *ends], ends)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], names=["doc_id", "bins"])


def _bins(column, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = column.to_pylist()
    bins = np.frombuffer(b"".join([r[:FEATURES] for r in rows]), np.uint8).reshape(-1, FEATURES)
    raw = np.frombuffer(b"".join([r[FEATURES:] for r in rows]), np.uint8)
    ranks, sizes = _ranks(raw, np.array([len(r) - FEATURES for r in rows], np.int64))
    return bins, np.flatnonzero(chosen)[ranks], sizes


def _train_counts(batches, model: Model | None, chosen: np.ndarray, how: Training):
    """(view, good, feature, bin, weight): sums over a task's documents for the next models. The
    buckets of words are the bins of a last feature."""
    sums = np.zeros((2, 2, FEATURES + 1, BINS))
    found = np.zeros((2, WORD_BUCKETS))
    for b in batches:
        (bins, words, sizes), labels = _bins(b.column(0), chosen), np.array([-1 if x is None else x for x in b.column(1).to_pylist()])
        use = [(0, labels, 1.0), (1, labels, 1.0)]
        if model is not None:
            for view, odds in enumerate(model.views(bins, words, sizes)):
                limit = np.log(how.confident / (1 - how.confident))
                guess = np.where(odds > limit, 1, np.where(odds < -limit, 0, -1))
                use.append((1 - view, np.where(labels == -1, guess, -1), how.pseudo_weight))
        for view, y, weight in use:
            for good in (0, 1):
                x = bins[y == good]
                sums[view, good, FEATURES, 0] += weight * len(x)
                for f in range(FEATURES):
                    sums[view, good, f] += weight * np.bincount(x[:, f], minlength=BINS)
                if view == 0:
                    found[good] += weight * np.bincount(words[np.repeat(y == good, sizes)], minlength=WORD_BUCKETS)
    at, more = np.argwhere(sums), np.argwhere(found)
    where = np.concatenate([at, np.stack([0 * more[:, 0], more[:, 0], 0 * more[:, 0] + FEATURES + 1, more[:, 1]], 1)]).astype(np.int32)
    weights = np.concatenate([sums[tuple(at.T)], found[tuple(more.T)]])
    yield pa.RecordBatch.from_arrays([*[pa.array(where[:, i]) for i in range(4)], pa.array(weights)], names=["view", "good", "feature", "bin", "weight"])


def _calibration(batches, model: Model):
    """(view, good, log-odds to a quarter, count)."""
    sums: dict[tuple, int] = {}
    for b in batches:
        features_, labels = _bins(b.column(0), model.chosen), b.column(1).to_pylist()
        for view, odds in enumerate(model.views(*features_)):
            for z, y in zip(np.clip(np.round(odds * 4), -400, 400).astype(int).tolist(), labels, strict=True):
                sums[view, y, z] = sums.get((view, y, z), 0) + 1
    rows = list(sums.items())
    cols = [pa.array([k[i] for k, _ in rows], pa.int32()) for i in range(3)]
    yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in rows], pa.int64())], names=["view", "good", "odds", "n"])


def _naive_bayes(sums: np.ndarray, view: int, how: Training) -> tuple[np.ndarray, float]:
    which = slice(0, len(TEXT)) if view == 0 else slice(len(TEXT), FEATURES)
    c = sums[view][:, which] + how.smoothing
    p = np.log(c / c.sum(axis=2, keepdims=True))
    n = sums[view][:, FEATURES, 0] + how.smoothing
    return p[1] - p[0], float(np.log(n[1] / n[0]))


def _word_odds(found: np.ndarray, rows: np.ndarray, how: Training) -> np.ndarray:
    """Log-odds of good by bucket, from how many of either class's documents have it."""
    p = (found + how.smoothing) / (rows[:, None] + 2 * how.smoothing)
    return np.log(p[1] / p[0])


def tells(found: np.ndarray, rows: np.ndarray, how: Training) -> np.ndarray:
    """Whether a bucket's shares in the two classes differ by more than chance."""
    p = (found + how.smoothing) / (rows[:, None] + 2 * how.smoothing)
    both = (found.sum(axis=0) + how.smoothing) / (rows.sum() + 2 * how.smoothing)
    z = (p[1] - p[0]) / np.sqrt(both * np.maximum(1 - both, 1e-9) * (1 / (rows[0] + how.smoothing) + 1 / (rows[1] + how.smoothing)))
    return np.abs(z) >= LEAST_Z


def _chosen(rows: DataFrame, own: DataFrame, how: Training) -> np.ndarray:
    """The buckets that tell the classes apart on the sample of labelled rows that train."""
    own = own.where(F.expr(f"crc32(cast(id_ as string)) % {how.calibrate_every} <> 0"))
    share = min(1.0, how.word_rows / max(1, own.count()))
    sample = own.where(F.expr(f"{share} >= 1 or xxhash64(cast(id_ as string)) / 18446744073709551616D + 0.5D < {share}"))
    texts = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("id_")).select("text", "good")  # word_rows, about, at any size
    counts = texts.mapInArrow(tidy(_word_counts), "good int, bucket int, docs long").groupBy("good", "bucket").agg(F.sum("docs").alias("docs"))
    found, n = np.zeros((2, WORD_BUCKETS)), np.zeros(2)
    for b in counts.toArrow().to_batches():  # 2 * WORD_BUCKETS + 2 rows at most
        good, bucket, docs = (np.asarray(c) for c in b.columns)
        n[good[bucket < 0]] = docs[bucket < 0]
        found[good[bucket >= 0], bucket[bucket >= 0]] = docs[bucket >= 0]
    return tells(found, n, how)


def _logistic(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Offset and slope (>= 0) of good by log-odds, with weak pulls to their prior values."""
    a, b = 0.0, 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(n * (y - p)).sum() - 0.1 * a, (n * (y - p) * z).sum() - 0.1 * (b - 0.5)])
        hess = np.array([[w.sum() + 0.1, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        step *= min(1, 1 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], max(0.0, b + step[1])
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col="doc_id", text_col="text", source_col="source", lang_col="lang", label_col="quality") -> Model | None:
    """The combined model; None if either class has no label.

    All labelled rows and all unlabelled documents count, repeated rows each. Of several labels
    for one id the least holds. Labels other than 0 and 1, or of absent documents, are left out.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").cast("string").alias(k) for c, k in ((text_col, "text"), (source_col, "source"), (lang_col, "lang"))])
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.col(f"`{label_col}`").cast("int").alias("good")).where("good in (0, 1)").groupBy("id_").agg(F.min("good").alias("good"))
    small_batches(docs.sparkSession)
    chosen = _chosen(rows, own, how)
    bins = rows.mapInArrow(tidy(lambda x: _featured(x, chosen)), "doc_id long, bins binary")
    table = materialise(bins.join(own, F.col("doc_id") == F.col("id_"), "left").select("doc_id", "bins", "good"), "features")
    held_out = F.expr(f"good is not null and crc32(cast(doc_id as string)) % {how.calibrate_every} = 0")
    training = table.select("bins", F.when(~held_out, F.col("good")).alias("good"), held_out.alias("out")).where("not out").drop("out")
    calibrating = table.where(held_out).select("bins", "good")
    model = None
    for _ in range(how.rounds + 1):
        got = training.mapInArrow(tidy(lambda x, m=model: _train_counts(x, m, chosen, how)), "view int, good int, feature int, bin int, weight double")
        sums = np.zeros((2, 2, FEATURES + 1, BINS))
        found = np.zeros((2, WORD_BUCKETS))
        got = got.groupBy("view", "good", "feature", "bin").agg(F.sum("weight").alias("weight"))
        for b in got.toArrow().to_batches():  # 4 * FEATURES * BINS + 2 * WORD_BUCKETS numbers at most
            view, good, feature, bin_, weight = (np.asarray(c) for c in b.columns)
            w = feature > FEATURES
            found[good[w], bin_[w]] = weight[w]
            sums[view[~w], good[~w], feature[~w], bin_[~w]] = weight[~w]
        if not sums[:, :, FEATURES, 0].all():
            return None
        (text, p0), (meta, p1) = _naive_bayes(sums, 0, how), _naive_bayes(sums, 1, how)
        model = Model(text, _word_odds(found, sums[0, :, FEATURES, 0], how), chosen, meta, (p0, p1), (0.0, 1.0), (0.0, 1.0), 0.0)
    got = calibrating.mapInArrow(tidy(lambda x: _calibration(x, model)), "view int, good int, odds int, n long")
    got = got.groupBy("view", "good", "odds").agg(F.sum("n").alias("n")).collect()  # 4 * 801
    fits = []
    for view in (0, 1):
        x = np.array([(r["odds"] / 4, r["good"], r["n"]) for r in got if r["view"] == view], float).reshape(-1, 3)
        fits.append(_logistic(x[:, 0], x[:, 1], x[:, 2]) if len(x) else (0.0, 1.0))
    n = [sum(r["n"] for r in got if r["view"] == 0 and r["good"] == g) + 1 for g in (0, 1)]
    return Model(model.text, model.words, model.chosen, model.meta, model.priors, *fits, float(np.log(n[1] / n[0])))


def _scored(batches, model: Model | None, names: list[str], at: dict[str, int], limit: float, only_kept: bool):
    for b in batches:
        score = np.full(b.num_rows, 0.5)
        if model is not None:
            score = model.score(*features(b.column(at["text"]), b.column(at["source"]).to_pylist(), b.column(at["lang"]).to_pylist(), model.chosen))
        kept = score >= limit
        out = pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array(kept)], names=names)
        yield out.filter(pa.array(kept)) if only_kept else out


def classify(docs: DataFrame, model: Model | None, limit: float = 0.25, only_kept: bool = False, text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """Every row of docs with quality_score (0 to 1) and quality_kept (score >= limit).

    Null and empty texts are scored like any others, texts of any length as a whole; a score of
    exactly the limit is kept. Without a model (no labels of a class)
    scores are 0.5 and all is kept. Columns of docs named like ours are replaced. Repeated rows
    are scored alike; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("quality_score", "quality_kept")
    for c in (text_col, source_col, lang_col):
        docs = docs.withColumn(c, F.col(f"`{c}`").cast("string"))
    names = [*docs.columns, "quality_score", "quality_kept"]
    at = {k: docs.columns.index(c) for k, c in (("text", text_col), ("source", source_col), ("lang", lang_col))}
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField("quality_score", T.DoubleType()), T.StructField("quality_kept", T.BooleanType())])
    return docs.mapInArrow(tidy(lambda x: _scored(x, model, names, at, limit, only_kept)), schema)
