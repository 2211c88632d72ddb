"""Language identification by multilingual mixture inference.

A language is a distribution over hashed n-grams of four bytes of lower-cased text, in which
everything that is no letter is a space. A document's n-grams come from a mixture of languages;
expectation-maximisation estimates its proportions. Of the nested sets of the largest shares
the one with the best penalised likelihood (a penalty for each language, growing with the log of
the n-gram count) is the document's language set.

The models are fitted on a bounded sample of labelled rows: about FIT_ROWS a language, those
with the least hashes of their ids, or all of a rarer one. Predicting sees the text only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, tidy

BUCKETS = 1 << 15
FIT_ROWS = 4_000
#: Added to each bucket's count.
SMOOTHING = 0.05
ROUNDS = 20
#: Shares below this are not tried in a set.
LEAST_SHARE = 0.02
PENALTY = 3.0

FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def folded(text: pa.Array):
    """(first row, offsets, bytes) with letters lower-cased and white space for the rest of ASCII."""
    lower = pa.compute.utf8_lower(text.cast(pa.large_string()))
    for lo, off, data in slices(lower):
        yield lo, off, FOLD[data]


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of one text; no run of spaces counts more than one."""
    data = np.concatenate([[32], data, [32]]).astype(np.uint8)
    space = data == 32
    keep = ~(space[1:] & space[:-1])
    data = data[np.concatenate([[True], keep])].astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.int64)
    h = data[:-3] * np.uint32(0x9E3779B1)
    for j in (1, 2, 3):
        h = (h ^ data[j : len(data) - 3 + j]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def _counts(batches):
    """(lang, bucket, count) of a task's texts."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for lo, off, data in folded(b.column(1)):
            for i in range(len(off) - 1):
                c = np.bincount(grams(data[off[i] : off[i + 1]]), minlength=BUCKETS)
                lang = langs[lo + i]
                sums[lang] = sums.get(lang, 0) + c
    for lang, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], names=["lang", "bucket", "count"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col="doc_id", text_col="text", lang_col="lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in ascending order, log-probabilities (bucket, language) and shares of rows.

    Rows without text or language are left out. A language's sample holds the rows whose hash
    lies in the share fit_rows / rows of the hash's span.
    """
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("h"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    share = {k: min(1.0, fit_rows / n) for k, n in sizes.items()}
    limits = docs.sparkSession.createDataFrame([(k, s) for k, s in share.items()], "lang_ string, share double")  # a row for each language
    rows = rows.join(F.broadcast(limits), F.col("lang") == F.col("lang_")).where("share >= 1 or (h / 18446744073709551616D + 0.5D) < share")
    counts = rows.select("lang", "text").mapInArrow(tidy(_counts), "lang string, bucket int, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count"))
    langs = sorted(sizes)
    table = np.zeros((BUCKETS, len(langs)))
    for r in counts.collect():  # BUCKETS a language at most
        table[r["bucket"], langs.index(r["lang"])] = r["count"]
    table += SMOOTHING
    rows = np.array([sizes[k] for k in langs], float)
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32), rows / rows.sum()


def _mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares and log-likelihood of n-grams with likelihoods p (n-gram, language), n times each."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        joint = p * share
        whole = joint.sum(axis=1)
        new = (n / whole) @ joint / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(buckets: np.ndarray, logs: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """The language set (indices, largest share first) and its shares."""
    at, n = np.unique(buckets, return_counts=True)
    n = n.astype(float)
    rows = logs[at].astype(float)
    top = rows.max(axis=1)
    p = np.exp(rows - top[:, None])
    share, _ = _mixture(p, n)
    order = np.argsort(-share, kind="stable")
    best, cost = None, penalty * np.log(n.sum() + 1)
    for k in range(1, len(order) + 1):
        if k > 1 and share[order[k - 1]] < LEAST_SHARE:
            break
        if k == 1:
            # the single best language need not have the largest share
            one = int(np.argmax(n @ rows))
            found, shares, fit = np.array([one]), np.ones(1), float(n @ (rows[:, one] - top))
        else:
            found = order[:k]
            shares, fit = _mixture(p[:, found], n)
        if best is None or fit - cost * k > best[0]:
            best = (fit - cost * k, found, shares)
    _, found, shares = best
    order = np.argsort(-shares, kind="stable")
    return found[order], shares[order]


def _predict(batches, langs: list[str], logs: np.ndarray, prior: np.ndarray, penalty: float):
    for b in batches:
        pred, score, sets, shares = [], [], [], []
        has_letter = np.array([bool(x) for x in pa.compute.match_substring_regex(b.column(1).fill_null(""), r"\p{L}").to_pylist()])
        for lo, off, data in folded(b.column(1)):
            for i in range(len(off) - 1):
                if not has_letter[lo + i] or not langs:
                    pred.append("und")
                    score.append(0.0)
                    sets.append([])
                    shares.append([])
                    continue
                g = grams(data[off[i] : off[i + 1]])
                if len(g):
                    found, share = infer(g, logs, penalty)
                else:  # a letter or two: all there is to go by is how frequent a language is
                    found = np.array([int(np.argmax(prior))])
                    share = prior[found]
                pred.append(langs[found[0]])
                score.append(float(min(1.0, share[0])))
                sets.append([langs[j] for j in found])
                shares.append([float(s) for s in share])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "langs", "shares"])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], penalty: float = PENALTY, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score (its share), langs and shares (the set) of each row.

    Null texts, texts without a letter, and all texts of a model without languages are `und`
    with score 0 and an empty set. A text too short for an n-gram is of the most frequent
    language, with its share of the rows as score. Ties go to the first language in ascending order. Repeated
    rows get the same; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    langs, logs, prior = model
    logs = docs.sparkSession.sparkContext.broadcast(logs)  # BUCKETS * languages * 4 bytes
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(tidy(lambda x: _predict(x, langs, logs.value, prior, penalty)), "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")
