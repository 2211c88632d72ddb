"""Quality rules: base rules, then divergence from a language's reference histograms.

A language's references are two histograms over all its texts: character classes, and its
common words (those that make up at least COMMON of its words) with one bin for the rest. A
document is compared with its language's by Jensen-Shannon distance (square root of the
divergence, base 2). Too short a text is not judged by a histogram: guards give the least number
of characters and of words. The limits fall with length, as the distance of a sample from its
own source does: limit + slack / sqrt(count). For words that alone would not do for short texts,
since a text with no common word has a fixed distance. The word limit is therefore at most halfway
between what samples of the reference itself reach at that number of words and that distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, materialise, mix, slices, small_batches, span_hashes, tidy, window_hashes, word_spans

# The symbols, sentence marks and minima of the rules.
SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "mark", "other", "letter_beyond_ascii")
COMMON = 0.001
#: A language has references from this many words on.
LEAST_WORDS = 2_000
#: Samples of a reference for its distances by length, and the quantile that they reach.
SAMPLES = 400
REACHED = 0.95
#: Words held by a task before it passes counts on.
HELD = 2_000_000

KIND = np.full(256, 6, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58] = 0, 1, 2
KIND[SPACES] = 3
KIND[list(SYMBOLS)] = 4
KIND[list(MARKS)] = 5
KIND[192:] = 7
KIND[128:192] = 8  # UTF-8 continuation bytes: not a character


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    most_repeat_percent: int = 20
    chars_guard: int = 200
    words_guard: int = 50
    class_limit: float = 0.14
    class_slack: float = 2.4
    word_limit: float = 0.12
    word_slack: float = 3.6


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of flags in each [off[i], off[i+1])."""
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def class_counts(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Characters of each class by row."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    return np.bincount(row * 9 + KIND[data], minlength=9 * n).reshape(n, 9)[:, :8]


def base_counts(off: np.ndarray, data: np.ndarray, starts, ends, at) -> dict[str, np.ndarray]:
    """The counts of the base rules by row."""
    n = len(off) - 1
    kinds = KIND[data]
    out = {"n_words": np.diff(at), "word_chars": sums((kinds != 3) & (kinds != 8), off), "n_symbols": sums(kinds == 4, off)}
    # Lines: between newlines and row ends, as spans with a word.
    newline = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([off[:-1], newline + 1])) if len(data) else np.zeros(0, np.int64)
    edges = edges[edges < len(data)]
    stops = np.concatenate([edges[1:], [len(data)]]) if len(edges) else edges
    stops = stops - ((stops > 0) & (data[np.maximum(stops - 1, 0)] == 10)) if len(edges) else stops
    worded = np.searchsorted(starts, stops) > np.searchsorted(starts, edges)
    edges, stops = edges[worded], stops[worded]
    row = np.searchsorted(off, edges, "right") - 1
    h = span_hashes(data, edges, stops)
    order = np.lexsort((h, row))
    again = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][1:][again], minlength=n) if len(row) else np.zeros(n, np.int64)
    # Words in repeated 5-word windows.
    words = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(n), np.diff(at))
    covered = np.zeros(len(words) + 5, bool)
    grams = window_hashes(words, 5)
    if len(grams):
        inside = np.flatnonzero(row[: len(grams)] == row[4 : 4 + len(grams)])
        keyed = mix(grams[inside] ^ mix(row[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keyed, kind="stable")
        s = keyed[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = inside[order[twice]]
        for j in range(5):
            covered[hit + j] = True
    out["n_repeat_words"] = sums(covered[: len(words)], at)
    return out


def _histograms(batches):
    """(lang, word, count) and (lang, null, counts by class) of a task."""
    words: dict[str, list] = {}
    classes: dict[str, np.ndarray] = {}
    held = 0
    schema = pa.schema([("lang", pa.string()), ("word", pa.int64()), ("class", pa.int32()), ("count", pa.int64())])

    def flush():
        for lang, parts in words.items():
            h, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            u, back = np.unique(h, return_inverse=True)
            n = len(u)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(u.view(np.int64)), pa.nulls(n, pa.int32()), pa.array(np.bincount(back, k, n).astype(np.int64))], schema=schema)
        words.clear()

    for b in batches:
        langs = np.array(b.column(0).to_pylist(), object)
        for lo, off, data in slices(b.column(1)):
            counts = class_counts(off, data)
            low = LOWER[data]
            starts, ends, at = word_spans(off, low)
            h = span_hashes(low, starts, ends)
            row = np.repeat(np.arange(len(off) - 1), np.diff(at))
            own = langs[lo : lo + len(off) - 1]
            for lang in {x for x in own if x is not None}:
                mine = own == lang
                classes[lang] = classes.get(lang, 0) + counts[mine].sum(axis=0)
                u, k = np.unique(h[mine[row]], return_counts=True)
                words.setdefault(lang, []).append((u, k))
                held += len(u)
        if held > HELD:
            yield from flush()
            held = 0
    yield from flush()
    for lang, c in classes.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * 8, pa.string()), pa.nulls(8, pa.int64()), pa.array(range(8), pa.int32()), pa.array(c.astype(np.int64))], schema=schema)


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, dict]:
    """By language: class shares, hashes of its common words, and their shares and the rest's.

    Every text with a language counts. A language has at most 1/COMMON common words, so that
    what comes to the driver is bounded by the number of languages.
    """
    rows = docs.selectExpr(f"cast(`{lang_col}` as string) lang", f"cast(`{text_col}` as string) text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(tidy(_histograms), "lang string, word long, class int, count long").groupBy("lang", "word", "class").agg(F.sum("count").alias("count"))
    counts = materialise(counts, "counts")
    total = counts.where("word is not null").groupBy("lang").agg(F.sum("count").alias("total")).where(f"total >= {LEAST_WORDS}")
    common = counts.where("word is not null").join(F.broadcast(total), "lang").where(f"count >= {COMMON} * total").collect()  # 1/COMMON a language at most
    out: dict[str, dict] = {}
    for r in common:
        out.setdefault(r["lang"], {"words": [], "total": r["total"]})["words"].append((r["word"], r["count"]))
    for r in total.collect():
        out.setdefault(r["lang"], {"words": [], "total": r["total"]})
    for r in counts.where("class is not null").collect():  # 8 a language
        if r["lang"] in out:
            out[r["lang"]].setdefault("classes", np.zeros(8))[r["class"]] = r["count"]
    for x in out.values():
        x["words"].sort()
        counted = np.array([c for _, c in x["words"]], float)
        x["hashes"] = np.array([w for w, _ in x["words"]], np.int64).view(np.uint64)
        order = np.argsort(x["hashes"])
        x["hashes"] = x["hashes"][order]
        x["shares"] = np.append(counted[order], x["total"] - counted.sum()) / x["total"]
        x["classes"] = x["classes"] / x["classes"].sum()
        del x["words"]
    return out


def distance(counts: np.ndarray, shares: np.ndarray) -> float:
    """Jensen-Shannon distance of a histogram of counts from one of shares, 0 to 1."""
    p = counts / counts.sum()
    m = (p + shares) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(shares > 0, shares * np.log2(shares / m), 0).sum()
    return float(np.sqrt(max(0.0, kl / 2)))


def word_limits(ref: dict, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in words, and the highest word limit at each: halfway from the distance that samples
    of the reference reach to that of a text without common words.

    Where samples reach the latter, length cannot tell the two apart, and the limit is the latter.
    """
    shares = ref["shares"]
    none = distance(np.eye(len(shares))[-1], shares)
    rng = np.random.default_rng(0)
    at = np.unique(np.round(max(rules.words_guard, 1) * 2 ** np.arange(0, 8, 0.5)).astype(np.int64))
    reached = [np.quantile([distance(x, shares) for x in rng.multinomial(n, shares / shares.sum(), SAMPLES)], REACHED) for n in at]
    return at, np.minimum((np.array(reached) + none) / 2, none)


def _score(batches, refs: dict, limits: dict, rules: Rules):
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for b in batches:
        langs = b.column(1).to_pylist()
        cols: dict[str, list] = {k: [] for k in fields}
        failed, kept, class_d, word_d = [], [], [], []
        for lo, off, data in slices(b.column(2)):
            starts, ends, at = word_spans(off, data)
            base = base_counts(off, data, starts, ends, at)
            for k in fields:
                cols[k] += base[k].tolist()
            counts = class_counts(off, data)
            hashes = span_hashes(LOWER[data], starts, ends)
            for i in range(len(off) - 1):
                n = int(base["n_words"][i])
                bad = n < rules.min_words or 100 * int(base["n_repeat_words"][i]) > rules.most_repeat_percent * n
                failed.append(bad)
                own = refs.get(langs[lo + i])
                best = near = None
                for lang in [langs[lo + i]] if own is not None else refs:
                    ref = refs[lang]
                    c = distance(counts[i], ref["classes"]) if counts[i].sum() >= rules.chars_guard else None
                    w = None
                    if n >= rules.words_guard:
                        h = hashes[at[i] : at[i + 1]]
                        where = np.searchsorted(ref["hashes"], h)
                        k = len(ref["hashes"])
                        where[where == k] = 0
                        where = np.where(ref["hashes"][where] == h, where, k) if k else np.zeros(n, np.int64)
                        w = distance(np.bincount(where, minlength=k + 1), ref["shares"])
                    if best is None or (c or 0) + (w or 0) < (best[0] or 0) + (best[1] or 0):
                        best, near = (c, w), lang
                c, w = best or (None, None)
                class_d.append(c)
                word_d.append(w)
                far = c is not None and c > rules.class_limit + rules.class_slack / counts[i].sum() ** 0.5
                far |= w is not None and w > min(rules.word_limit + rules.word_slack / n**0.5, np.interp(np.log(n), *limits[near])) + 1e-12
                kept.append(not bad and not far)
        arrays = [b.column(0)] + [pa.array(cols[k], pa.int64()) for k in fields] + [pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(class_d, pa.float64()), pa.array(word_d, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *fields, "base_failed", "kept", "class_distance", "word_distance"])


def judge(docs: DataFrame, refs: dict | None = None, rules: Rules = Rules(), id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, class_distance and word_distance of each row.

    Null and empty texts have no words and fail. A distance is null where its guard holds and
    then rejects nothing. A document without a language, or of one without references, is
    compared with the nearest references. Repeated rows are judged alike; an empty table gives
    none. Only the named columns are read.
    """
    small_batches(docs.sparkSession)
    refs = references(docs, lang_col, text_col) if refs is None else refs
    limits = {lang: (np.log(at), most) for lang, (at, most) in ((k, word_limits(x, rules)) for k, x in refs.items())}
    docs = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{lang_col}` as string) lang", f"cast(`{text_col}` as string) text")
    return docs.mapInArrow(
        tidy(lambda x: _score(x, refs, limits, rules)),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double",
    )
