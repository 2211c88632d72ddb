"""The training-data operators against brute force on small tables."""

import collections
import datetime
import hashlib
import itertools
import json
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberplan.llm import budget, common, components, cotrain, divergence, editwalk, feistel, jaccard, langmix, merkle, packing, templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def words(t):
    return WORD.findall(t or "")


def prose(rng, n, vocabulary=300):
    return " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Texts with copies, near copies, shared lines, short, empty and null ones, and a long one."""
    rng = random.Random(seed)
    texts = [None, "", "  \n\t", "one", "Two Words", "two words", "a b c d", "A B C D e", "é ü 中文 words here " * 4]
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(12)]
    for t in base:
        w = t.split()
        texts += [t, t.upper()]
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                v[rng.randrange(len(v))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(v) + ("\nshared footer line number %d of all pages" % rng.randrange(100)) * (rng.random() < 0.5))
    texts.append(prose(rng, 30_000))
    texts.append(prose(rng, 40) + "\n" + base[0])
    return texts


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, ("en", "de", None)[i % 3] if i is not None else None, f"src{(i or 0) % 4}", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_work_folder_is_the_sessions(spark):
    assert common.work_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


# --- 1 ---------------------------------------------------------------------------------------


def base_rules(t):
    w, seen, covered = words(t), collections.Counter(), set()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen.update(grams)
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_op1(spark, texts):
    t = texts + ["x y z w v\n" * 9, "### a | b\n\n### a | b\n", "a b c d e f a b c d e g h"]
    got = {r["doc_id"]: r for r in divergence.judge(frame(spark, t)).collect()}
    for i, x in enumerate(t):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_rules(x), i
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_op1_distance_and_references(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "of", "and", "stone", "river", "hill", "to"]) + rng.choice(["", "", ","]) for _ in range(200)) for _ in range(40)]
    odd = ["$$$ %%% " * 150 + " ".join(f"q{i}" for i in range(60)), " ".join(f"zz{i}" for i in range(200))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + odd)] + [(98, good[0] + " x", None)], "doc_id LONG, text STRING, lang STRING")
    refs = divergence.references(docs)
    counts = collections.Counter(w.lower() for t in good + odd for w in words(t))
    total = sum(counts.values())
    assert len(refs["en"]["hashes"]) == sum(n >= divergence.COMMON * total for n in counts.values())
    got = {r["doc_id"]: r["kept"] for r in divergence.judge(docs, refs).collect()}
    assert all(got[i] for i in range(40)) and not got[40] and not got[41] and got[98]
    p, q = np.array([3.0, 1.0]), np.array([0.5, 0.5])
    m = (p / 4 + q) / 2
    jsd = (sum(a * np.log2(a / b) for a, b in zip(p / 4, m)) + sum(a * np.log2(a / b) for a, b in zip(q, m))) / 2
    assert abs(divergence.distance(p, q) - jsd**0.5) < 1e-12


def test_op1_against_plain_loops(spark, texts):
    """References, distances and verdicts of a whole table, recomputed one character and word at a time."""
    rng = random.Random(23)
    say = lambda n: " ".join(rng.choice(["stone", "river", "the", "of", "Hill", "and,", "été"]) + rng.choice(["", "", "", "!", "7"]) for _ in range(n))
    t = texts + [say(rng.randrange(45, 500)) for _ in range(40)] + ["$% " * 90 + say(20), "zzz " * 60 + say(5)]
    rows = [(i, x, ("en", "de", None, "xx")[i % 4]) for i, x in enumerate(t)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    lower = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)

    def classes(x):
        kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c in "0123456789" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in "#*$%&|<>" else 5 if c in ".,;:!?'\"()-" else 6 if ord(c) < 128 else 7
        n = collections.Counter(map(kind, x))
        return [n[k] for k in range(8)]

    def apart(p, q):
        p = [x / sum(p) for x in p]
        d = sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q) if a) + sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q) if b)
        return math.sqrt(max(0, d / 2))

    refs = {}
    for lang in ("en", "de", "xx"):
        own = [x for _, x, k in rows if k == lang and x is not None]
        n = collections.Counter(lower(w) for x in own for w in words(x))
        total = sum(n.values())
        if total >= divergence.LEAST_WORDS:
            common = {w: c / total for w, c in n.items() if c >= divergence.COMMON * total}
            sums = [sum(c) for c in zip(*map(classes, own))]
            refs[lang] = common, [x / sum(sums) for x in sums]
    made = divergence.references(docs)
    assert set(made) == set(refs) and len(refs) == 3
    rules, limits = divergence.Rules(), {k: divergence.word_limits(x, divergence.Rules()) for k, x in made.items()}
    kept = []
    for _, x, lang in rows:
        n, _, _, _, repeats = base_rules(x)
        best = []
        for k in [lang] if lang in refs else sorted(refs):
            common, shares = refs[k]
            c = apart(classes(x or ""), shares) if sum(classes(x or "")) >= rules.chars_guard else None
            own = collections.Counter(lower(w) for w in words(x))
            w = apart([own[y] for y in common] + [n - sum(own[y] for y in common)], [*common.values(), 1 - sum(common.values())]) if n >= rules.words_guard else None
            best.append(((c or 0) + (w or 0), k, c, w))
        _, k, c, w = min(best, key=lambda b: b[0])
        far = c is not None and c > rules.class_limit + rules.class_slack / sum(classes(x or "")) ** 0.5
        if w is not None:
            at, most = limits[k]
            # A text without a common word may be at the limit itself, but for rounding.
            far |= w > min(rules.word_limit + rules.word_slack / n**0.5, np.interp(np.log(n), np.log(at), most)) + 1e-12
        kept.append((not (n < 10 or 100 * repeats > 20 * n) and not far, c, w))
    got = {r["doc_id"]: r for r in divergence.judge(docs).collect()}
    for i, (want, c, w) in enumerate(kept):
        r = got[i]
        assert r["kept"] == want, i
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in ((r["class_distance"], c), (r["word_distance"], w))), i
    assert 10 < sum(k for k, _, _ in kept) < len(kept)


def test_op1_short_texts_without_common_words(spark):
    """From the guard on, texts of a language stay and texts without its common words go."""
    rng = random.Random(6)
    say = lambda own, n: " ".join(rng.choice(own) if rng.random() < 0.35 else "".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    common_words = {"en": [f"the{c}" for c in "abcdefghijklmnopqrst"], "de": [f"der{c}" for c in "abcdefghijklmnopqrst"]}
    rows = [(f"{k}{i}", say(common_words[k], 400), k) for k in common_words for i in range(100)]
    refs = divergence.references(spark.createDataFrame(rows, "id STRING, text STRING, lang STRING"))
    sizes = [50, 60, 80, 100, 120] * 40
    short = [(i, say(common_words["en"], n), "en") for i, n in enumerate(sizes)]
    wrong = [(1000 + i, t, "de") for i, t, _ in short]
    gibberish = [(2000 + i, say(["".join(rng.choices("abcdefghijklmnop", k=6))], n), "en") for i, n in enumerate(sizes)]
    rules = divergence.Rules(chars_guard=10**9, most_repeat_percent=100)  # the word check alone
    got = divergence.judge(spark.createDataFrame(short + wrong + gibberish, "doc_id LONG, text STRING, lang STRING"), refs, rules).where("kept").collect()
    kept = collections.Counter(r["doc_id"] // 1000 for r in got)
    assert kept[0] >= 190 and kept[1] == kept[2] == 0
    for ref in refs.values():
        at, most = divergence.word_limits(ref, divergence.Rules())
        none = divergence.distance(np.eye(len(ref["shares"]))[-1], ref["shares"])
        assert at[0] == divergence.Rules().words_guard and (most < none).all()


# --- 2 ---------------------------------------------------------------------------------------


def test_op2(spark):
    a = [("f", i * 100, f"record {i}".encode()) for i in range(300)] + [("g", 0, b"x"), ("g", 0, b"x"), (None, None, None)]
    b = [r for r in a if r[:2] != ("f", 700)] + [("f", 150, b"new"), ("g", 5, None)]
    b = [(f, o, b"bad" if (f, o) == ("f", 20_000) else c) for f, o, c in b]
    schema = "file STRING, offset LONG, content BINARY, digest STRING"
    x, y = (spark.createDataFrame([(*r, "clash") for r in t], schema) for t in (a, b))
    got = {(r["file"], r["offset"], r["status"]) for r in merkle.audit(x, y, leaf=1000, fanout=4, levels=5).collect()}
    assert got == {("f", 700, "missing"), ("f", 150, "extra"), ("g", 5, "extra"), ("f", 20_000, "changed")}
    assert merkle.audit(x, x, leaf=1000, fanout=4, levels=5).count() == 0
    assert merkle.audit(x.limit(0), y.limit(0)).count() == 0
    assert merkle.audit(x.limit(0), y).count() == y.count()


# --- 3 ---------------------------------------------------------------------------------------


def walk(w, text):
    """The written string, step by step."""
    codes = [int(common.mix(np.array([c], np.uint64))[0]) % editwalk.WIDTH for c in map(ord, text)]
    out, i, step = [], 0, 0
    while i < len(codes):
        hold = w.stay[step % editwalk.PERIOD, codes[i]]
        out += [codes[i]] * int(hold)
        step += int(hold)
        i += 1
    return out


def test_op3(spark, texts):
    t = [x for x in texts if x is None or len(x) < 5000] + texts[-1:]
    ids = [i * 3 for i in range(len(t))]
    got = {r["doc_id"]: r for r in editwalk.compare_with_next(frame(spark, t, ids)).collect()}
    w = editwalk.Walks()
    assert len(got) == len(t)
    for k, i in enumerate(ids):
        own, nxt = t[k] or "", t[(k + 1) % len(t)] or ""
        half = len(own) // 2
        new = own[: len(own) - half] + nxt[:half]
        r = got[i]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert [r["fingerprint"], r["edited_fingerprint"]] == w.fingerprints([editwalk.points(own), editwalk.points(new)])
        assert 0 <= r["near_edited"] <= 1 and r["near_next"] == w.likeness(r["fingerprint"], got[ids[(k + 1) % len(t)]]["fingerprint"])
    long = walk(w, t[20])
    level, digits = got[60]["fingerprint"].split(":")
    assert digits == "".join(f"{w.digits[long[s]]:x}" for s in w.steps(int(level), len(long)).tolist())
    assert editwalk.compare_with_next(frame(spark, ["only"])).first()["near_next"] == 1.0
    assert editwalk.compare_with_next(frame(spark, ["x"]).limit(0)).count() == 0


def test_op3_edits_stay_near(spark):
    rng = random.Random(5)
    base = [prose(rng, 200) for _ in range(20)]
    near = [b[:300] + "XY" + b[304:] for b in base]
    w = editwalk.Walks()
    p = w.fingerprints([editwalk.points(x) for x in base + near])
    assert all(w.likeness(p[i], p[i + 20]) > 0.7 for i in range(20)) and all(w.likeness(p[i], p[i + 1]) < 0.4 for i in range(19))
    rows = spark.createDataFrame(list(enumerate(p)) + [(99, p[0]), (98, None), (None, p[1])], "doc_id LONG, fingerprint STRING").withColumn("class_id", F.lit("clash"))
    got = {r["doc_id"]: r["class_id"] for r in editwalk.near_classes(rows, 0.7).collect()}
    assert got == {**{i: i % 20 for i in range(40)}, 99: 0, 98: None, None: 1}
    assert editwalk.near_classes(rows.limit(0)).count() == 0


def alike(w, p, least):
    parent = list(range(len(p)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(i, j) for i, j in itertools.combinations(range(len(p)), 2) if w.likeness(p[i], p[j]) >= least]
    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(p))], links


def test_op3_classes_against_brute_force(spark, monkeypatch):
    """Recall of links at least 0.9 against all pairs: growth, shrinkage and edits over many lengths, and a
    frequent beginning that alone links nobody."""
    monkeypatch.setattr(editwalk, "BLOCK", 40)
    monkeypatch.setattr(editwalk, "STAR_ROUNDS", 1)
    rng = random.Random(17)
    w, texts = editwalk.Walks(), []
    begin = prose(rng, 60)
    for _ in range(60):
        t = prose(rng, rng.randrange(30, 600))
        cut = len(t) // rng.randrange(8, 20)
        texts += [t, t + " " + prose(rng, 1 + len(t) // 60), t[:-cut] if rng.random() < 0.5 else t[cut:]]
        texts.append(t[: len(t) // 2] + "?" * rng.randrange(1, 9) + t[len(t) // 2 :])
        texts.append(begin + prose(rng, rng.randrange(200, 300)))
    p = w.fingerprints([editwalk.points(x) for x in texts])
    want, links = alike(w, p, 0.75)
    got = {r["doc_id"]: r["class_id"] for r in editwalk.near_classes(spark.createDataFrame(list(enumerate(p)), "doc_id LONG, fingerprint STRING")).collect()}
    levels = sum(p[i].split(":")[0] != p[j].split(":")[0] for i, j in links)
    assert len(links) > 60 and levels > 5
    assert sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)
    assert all(want[i] == want[got[i]] for i in range(len(p)))  # nothing that brute force keeps apart


def test_op3_ties_and_missing_ids(spark):
    rows = [(None, "a b"), (None, "c d e"), (5, "x y z"), (5, "x y z"), (5, "other text"), (7, None), (8, "long " * 60_000)]
    got = editwalk.compare_with_next(spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("fingerprint", F.lit("clash")).repartition(5)).collect()
    assert len(got) == len(rows) and sorted(r["n_chars"] for r in got) == sorted(len(t or "") for _, t in rows)
    assert {r["near_next"] for r in got if r["doc_id"] == 5 and r["n_chars"] == 5} >= {1.0}


# --- 4 ---------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = " ".join(f"W{rng.randrange(50)}$$$" for _ in range(60)) if bad else prose(rng, 60) + "."
        rows.append((i, t, "en", f"src{i % 3}", len(t)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows + [(1000, None, None, None, None), (1001, "", "en", "s", 0)], DOCS), spark.createDataFrame(labels + [(5000, 0, 0), (2, None, 1)], "doc_id LONG, quality INT, toxic INT")


def test_op4(spark):
    docs, labels = labelled(spark)
    model = cotrain.train(docs, labels)
    out = cotrain.classify(docs.withColumn("quality_score", F.lit("clash")), model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["quality_kept"] == (i % 4 != 0) for i in range(400)) and len(got) == 402
    assert cotrain.classify(docs, model, only_kept=True).where("doc_id < 400").count() == 300
    assert cotrain.train(docs, labels.where("quality = 1")) is None
    assert cotrain.classify(docs, None).where("quality_kept").count() == 402
    assert cotrain.classify(docs.limit(0), model).count() == 0


def by_hand(docs, labels, how):
    """Scores of all documents by co-training in plain loops over the same features."""
    k, rows, every = len(cotrain.TEXT), [], np.ones(cotrain.WORD_BUCKETS, bool)
    for d in docs:
        bins, words_, _ = cotrain.features(pa.array([d["text"]], pa.string()), [d["source"]], [d["lang"]], every)
        rows.append((d["doc_id"], [[("b", f, int(bins[0, f])) for f in range(k)], [("b", f, int(bins[0, f])) for f in range(k, cotrain.FEATURES)]], [int(x) for x in words_]))
    out = {i for i in labels if zlib.crc32(str(i).encode()) % how.calibrate_every == 0}
    # Words that tell the classes apart among the labelled rows that train.
    s, n = how.smoothing, [sum(labels.get(r[0]) == g and r[0] not in out for r in rows) for g in (0, 1)]
    chosen = set()
    for x in range(cotrain.WORD_BUCKETS):
        c = [sum(labels.get(r[0]) == g and r[0] not in out and x in r[2] for r in rows) for g in (0, 1)]
        p0, p1 = ((c[g] + s) / (n[g] + 2 * s) for g in (0, 1))
        q = (sum(c) + s) / (sum(n) + 2 * s)
        if abs(p1 - p0) / math.sqrt(q * (1 - q) * (1 / (n[0] + s) + 1 / (n[1] + s))) >= cotrain.LEAST_Z:
            chosen.add(x)
    rows = [(i, b, [x for x in w if x in chosen]) for i, b, w in rows]
    assert chosen
    model = None

    def odds(model, row, view):
        prior, weights, word = model[view]
        z = prior + sum(weights[x] for x in row[1][view])
        if view == 0:
            z += max(-cotrain.MOST_ODDS, min(cotrain.MOST_ODDS, sum(word[x] for x in row[2])))
        return z

    for _ in range(how.rounds + 1):
        n, seen, words_ = collections.Counter(), collections.Counter(), collections.Counter()
        for row in rows:
            if row[0] in out:
                continue
            given = [(v, labels[row[0]], 1.0) for v in (0, 1)] if row[0] in labels else []
            if model and not given:
                for v in (0, 1):
                    z = odds(model, row, v)
                    if abs(z) > math.log(how.confident / (1 - how.confident)):
                        given.append((1 - v, int(z > 0), how.pseudo_weight))
            for v, good, weight in given:
                n[v, good] += weight
                for x in row[1][v]:
                    seen[v, good, x] += weight
                if v == 0:
                    for x in row[2]:
                        words_[good, x] += weight
        s, model = how.smoothing, []
        for v in (0, 1):
            weights = {(("b", f, b)): math.log((seen[v, 1, ("b", f, b)] + s) / (n[v, 1] + s * cotrain.BINS)) - math.log((seen[v, 0, ("b", f, b)] + s) / (n[v, 0] + s * cotrain.BINS)) for f in range(cotrain.FEATURES) for b in range(cotrain.BINS)}
            word = {x: math.log((words_[1, x] + s) / (n[0, 1] + 2 * s) / ((words_[0, x] + s) / (n[0, 0] + 2 * s))) for x in chosen} if v == 0 else {}
            model.append((math.log((n[v, 1] + s) / (n[v, 0] + s)), weights, word))
    held = [r for r in rows if r[0] in out]
    fits = [cotrain._logistic(*map(np.array, zip(*[(min(400, max(-400, round(4 * odds(model, r, v)))) / 4, labels[r[0]], 1) for r in held]))) for v in (0, 1)]
    good = sum(labels[r[0]] for r in held)
    prior = math.log((good + 1) / (len(held) - good + 1))
    return {r[0]: 1 / (1 + math.exp(-min(50, max(-50, sum(fits[v][0] + fits[v][1] * odds(model, r, v) for v in (0, 1)) - prior)))) for r in rows}


def test_op4_against_plain_loops(spark):
    docs, labels = labelled(spark, 120)
    docs = docs.where("doc_id < 1000 or doc_id = 1001")
    wanted = by_hand(docs.collect(), {r["doc_id"]: r["quality"] for r in labels.where("quality is not null and doc_id < 1000").collect()}, cotrain.Training())
    got = {r["doc_id"]: r["quality_score"] for r in cotrain.classify(docs, cotrain.train(docs, labels)).collect()}
    assert set(got) == set(wanted) and all(abs(got[i] - wanted[i]) < 1e-6 for i in got)


def test_op4_held_out(spark):
    """Content alone tells good from bad where layout, source and language do not; repeated rows score alike."""
    rng = random.Random(19)
    vocabulary = [[f"{c}{x}" for x in ("stone", "river", "field", "cloud", "paper", "glass")] for c in "gb"]
    say = lambda good: " ".join(rng.choice(vocabulary[1 - good]) if rng.random() < 0.2 else rng.choice("abcdefgh") * 4 for _ in range(60))
    rows = [(i, say(i % 2), "en", "s", 300) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:3], DOCS)
    model = cotrain.train(docs, spark.createDataFrame([(i, i % 2) for i in range(0, 200)], "doc_id LONG, quality INT"))
    got = cotrain.classify(docs, model, limit=0.5).collect()
    assert sum(r["quality_kept"] == bool(r["doc_id"] % 2) for r in got if r["doc_id"] >= 200) >= 190
    assert len({(r["doc_id"], r["quality_score"]) for r in got}) == 400 and len(got) == 403


# --- 5 ---------------------------------------------------------------------------------------

LANGS = {"de": ["der", "und", "schön", "ungen", "keit", "über"], "en": ["the", "and", "thing", "with", "ation", "over"], "fr": ["les", "été", "eaux", "ment", "que", "où"]}


def test_op5(spark):
    rng = random.Random(9)
    say = lambda lang, n: " ".join("".join(rng.choices(LANGS[lang], k=2)) for _ in range(n))
    rows = [(i, say(("de", "en", "fr")[i % 3], 60), ("de", "en", "fr")[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    train = docs.where("doc_id % 2 = 0")
    model = langmix.fit(train)
    test = spark.createDataFrame([(i, t) for i, t, _ in rows if i % 2] + [(900, None), (901, ""), (902, "12 !?"), (903, say("de", 200) + " " + say("fr", 100)), (904, "A.")], "doc_id LONG, text STRING")
    got = {r["doc_id"]: r for r in langmix.predict(test, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if i % 2)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["langs"] == []
    assert got[903]["langs"] == ["de", "fr"] and 0.5 < got[903]["score"] < 0.8
    assert got[904]["lang_pred"] in LANGS
    assert langmix.predict(test, langmix.fit(train.limit(0))).where("lang_pred = 'und'").count() == test.count()


def test_op5_mixture_against_brute_force():
    """Shares by a fine grid, and the set that is best of the nested ones by penalised likelihood."""
    rng = np.random.default_rng(4)
    logs = np.log(rng.dirichlet(np.full(60, 0.3), 3).T + 1e-4).astype(np.float32)
    logs = logs - np.log(np.exp(logs).sum(axis=0))
    for truth in ([1, 0, 0], [0.6, 0.4, 0], [0.2, 0.3, 0.5], [0, 0.1, 0.9]):
        grams_ = rng.choice(60, 900, p=(p := np.exp(logs.astype(float)) @ np.array(truth)) / p.sum())
        at, n = np.unique(grams_, return_counts=True)
        p = np.exp(logs[at].astype(float))
        likelihood = lambda share: float(n @ np.log(p @ share + 1e-300))
        grid = [np.array([a, b, 100 - a - b]) / 100 for a in range(101) for b in range(101 - a)]
        best = max(grid, key=likelihood)
        share, fit = langmix._mixture(p, n.astype(float), 400)
        assert np.abs(share - best).max() < 0.03 and fit > likelihood(best) - 0.5
        order = np.argsort(-langmix._mixture(p, n.astype(float))[0], kind="stable")
        cost = langmix.PENALTY * np.log(len(grams_) + 1)
        sets = {1: max(likelihood(np.eye(3)[i]) for i in range(3))}
        for k in (2, 3):
            sets[k] = max(likelihood(g) for g in grid if all(g[i] == 0 for i in order[k:]))
        found, shares = langmix.infer(grams_, logs)
        assert len(found) == max(sets, key=lambda k: sets[k] - cost * k) and abs(shares.sum() - 1) < 1e-6


def test_op5_repeats_and_clashes(spark):
    rows = [(1, "der und keit", "de"), (1, "der und keit", "de"), (2, "the and thing", "en")] * 20
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").withColumns({"score": F.lit("clash"), "langs": F.lit(1)})
    got = langmix.predict(docs, langmix.fit(docs)).collect()
    assert len(got) == 60 and {(r["doc_id"], r["lang_pred"]) for r in got} == {(1, "de"), (2, "en")}


def test_op1_repeats_clashes_and_empty(spark):
    rows = [(1, "one two three " * 5, "en", "x"), (1, "one two three " * 5, "en", "y"), (2, "w " * 50_000, "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, kept STRING")
    got = divergence.judge(docs).collect()
    assert len(got) == 3 and len({(r["doc_id"], r["n_words"], r["kept"]) for r in got}) == 2 and all(r["base_failed"] for r in got)
    assert divergence.judge(docs.limit(0)).count() == 0


def test_op8_missing_ids(spark):
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (None, None), (3, "x" * 9000)], "doc_id LONG, text STRING")).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 4 and len({r["sequence_id"] for r in rows}) >= 1


# --- 6 ---------------------------------------------------------------------------------------


def shingles(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def check_components(spark, texts):
    sets = [shingles(t) for t in texts]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(frame(spark, texts)).collect()}
    want = linked(sets)
    assert got == {i: (len(s), want[i] if s else i) for i, s in enumerate(sets)}


def test_op6(spark, texts):
    check_components(spark, texts)


def test_op6_star_of_near_copies(spark):
    """Copies that link with their original but hardly with each other, and one common line."""
    rng = random.Random(11)
    base = prose(rng, 100).split()
    texts = []
    for k in range(60):
        v = list(base)
        for at in rng.sample(range(5, 95), 2):
            v[at] = f"k{k}x{at}"
        texts.append(" ".join(v))
    texts.insert(30, " ".join(base))
    texts += [f"the very common line of words {i}" for i in range(40)]
    check_components(spark, texts)


def test_op6_large_tiles(spark, monkeypatch):
    """Tiles that are salted, and groups of a tile that no star of one round joins."""
    rng = random.Random(13)
    monkeypatch.setattr(jaccard, "TILE", 6)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "BLOCK_ENTRIES", 300)
    monkeypatch.setattr(jaccard, "HELD", 500)
    texts = []
    for g in range(3):  # chains: each text links with the one before it only
        own = prose(rng, 130).split()
        for k in range(14):
            v = list(own)
            for at in range(0, 4 * k, 4):
                v[(at * 7) % 130] = f"g{g}chain{at}"
            texts.append(" ".join(v))
    texts += [" ".join(prose(rng, 40).split()) for _ in range(5)] * 2
    check_components(spark, texts)


def near_copies(rng, copies: int, outside: int):
    """Copies of a text with a few words changed, and ones that are too far from it but have words of their own by twos."""
    base = prose(rng, 120).split()
    texts = [list(base) for _ in range(copies + outside)]
    for k, v in enumerate(texts):
        far = k >= copies
        for at in rng.sample(range(5, 115), 5 if far else 2):
            v[at] = f"x{k // 2 if far else k}at{at}"
    for k in range(copies, copies + outside, 2):  # of two, one goes further the same way
        texts[k + 1] = texts[k][:60] + texts[k + 1][60:]
    return [" ".join(v) for v in texts]


def test_op6_large_tiles_narrow(spark, monkeypatch):
    """Sets that are apart in a large tile meet by what they have apart from its hub: blocks are never dealt to blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    full, in_full = [], jaccard._in_full

    def counted(member, *args):
        full.append(member.agg(F.count("*"), F.max("k")).first())
        return in_full(member, *args)

    monkeypatch.setattr(jaccard, "_in_full", counted)
    texts = near_copies(random.Random(17), 150, 60)
    check_components(spark, texts)
    assert len(full) > 1 and all(n <= 40 * len(texts) and (k or 0) <= 16 for n, k in full)


def test_op6_differences_show_enough():
    """Two sets that link, not both with a hub, share one of the elements that their differences from it show."""
    rng = np.random.default_rng(19)
    met = 0
    for share in (50, 75, 99):
        for _ in range(300):
            n = int(rng.integers(3, 250))
            base = rng.choice(np.arange(1, 10_000, dtype=np.uint64), n, replace=False)
            kept = [rng.random(n) >= (100 - share) / 100 * rng.choice([0.2, 0.5, 1.0]) for _ in range(3)]
            kept[2] = np.where(rng.random(n) < 0.9, kept[1], kept[2])
            extra = rng.integers(20_000, 30_000, n, dtype=np.uint64)[: int(rng.integers(0, 1 + n * (100 - share) // 80))]
            hub, x, y = (np.unique(np.concatenate([base[k], e])) for k, e in zip(kept, (extra[:0], extra, extra[: len(extra) * 4 // 5]), strict=True))
            if not min(len(hub), len(x), len(y)):
                continue
            names = ["u", "v", "k", "x", "y"]
            got = list(jaccard._differences([pa.RecordBatch.from_pylist([dict(zip(names, (1, i, 2, hub.tobytes(), s.tobytes()), strict=True)) for i, s in ((2, x), (3, y))])], share))[0].to_pylist()
            for r, s in zip(got, (x, y), strict=True):
                assert r["linked"] == jaccard.may_link(len(hub), len(s), len(np.intersect1d(hub, s)), share)
            if jaccard.may_link(len(x), len(y), len(np.intersect1d(x, y)), share) and not all(r["linked"] for r in got) and len(np.setxor1d(hub, x)) and len(np.setxor1d(hub, y)):
                met += 1
                shown = [set(np.sort(np.frombuffer(r["value"], np.uint64))[: r["take"]].tolist()) for r in got]
                assert shown[0] & shown[1]
    assert met > 30


def test_op6_edges(spark):
    assert jaccard.similarity_components(frame(spark, ["a"]).limit(0)).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "A b  c"), (7, None)]
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("node", F.lit(1))).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("1", "1"), ("1", "1"), ("7", "7"), ("None", "1")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (200, 201), (None, 4)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "u LONG, v LONG").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "HELD", 8)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(25)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u LONG, v LONG")).collect()}
    want = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in range(60):
        for u, v in edges:
            if u != v:
                want[u] = want[v] = min(want[u], want[v])
    assert got == want


# --- 7 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "value", ["2024-02-29", "31/12/1999", "12/31/1999", "01/02/2003", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111", "4111111111111111", "+44 20 7946 0958", "(212) 555-1234", "+1 (743) 555-3824", "152.143.123.131", "jo.smith7@mail.example.com", "04dbebab91ab85687d33eeaaf9ac699e1188f962"]
)
def test_op7_values(value):
    p = feistel.Pseudonyms(b"k")
    new, counts = p.rewrite(f"x {value}, y")
    assert value not in new and sum(counts.values()) == 1 and p.rewrite(new, back=True)[0] == f"x {value}, y"
    assert feistel.Pseudonyms(b"k").rewrite(f"{value}!")[0][:-1] == new[2:-3]
    assert feistel.Pseudonyms(b"other").rewrite(f"x {value}, y")[0] != new
    if "@" not in value and value.count(".") != 3:
        assert re.sub("[A-Za-z0-9]", "", value) == re.sub("[A-Za-z0-9]", "", new[2:-3])


@pytest.mark.parametrize("text", ["4111111111111112", "0000-00-00", "2023-02-30", "256.1.1.1", "1.2.3.4.5", "version 4.0.", "000-12-3456", "GB00 WEST 1234 5698 7654 32", ""])
def test_op7_leaves_what_is_not_valid(text):
    assert feistel.Pseudonyms(b"k").rewrite(text) == (text, {})


def test_op7_permutes():
    f = feistel.Feistel(b"k")
    assert sorted(f.permute(x, 1000, b"t") for x in range(1000)) == list(range(1000))
    days = {f.permute(x, 100, b"d", lambda x: x % 3 == 0) for x in range(0, 100, 3)}
    assert days == set(range(0, 100, 3))
    assert datetime.date.fromisoformat(feistel.Pseudonyms(b"k").rewrite("2024-02-29")[0])


def test_op7_links_dates_and_reads_shorter():
    p = feistel.Pseudonyms(b"k")
    for day in ("2024-02-29", "2001-11-05"):
        y, m, d = day.split("-")
        forms = [f"{y}-{m}-{d}", f"{y}/{m}/{d}", f"{d}/{m}/{y}", f"{d}.{m}.{y}"]
        got = [re.findall(r"\d+", p.rewrite(x)[0]) for x in forms]
        assert got[0] == got[1] == got[2][::-1] == got[3][::-1]
    card, iban = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"
    assert p.rewrite(f"{card} 12/25")[0] == p.rewrite(card)[0] + " 12/25"
    assert p.rewrite(f"1234 {card}")[0] == "1234 " + p.rewrite(card)[0]
    assert p.rewrite(f"{iban} BIC 1")[0] == p.rewrite(iban)[0] + " BIC 1"


def test_op7_long_text_against_its_values():
    """A text of thousands of values is rewritten value by value, in time that grows with it."""
    rng = random.Random(31)
    p, values, new = feistel.Pseudonyms(b"k"), [], []
    for i in range(4000):
        body = "".join(rng.choices("0123456789", k=15))
        v = [f"{rng.randrange(1950, 2050)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", body + feistel.luhn_digit(body), f"{rng.randrange(1, 255)}.0.{i % 200}.7", f"w{i % 50}@mail{i % 3}.org", "4111111111111112"][i % 5]
        values.append(v)
        new.append(p.rewrite(v)[0])
    assert sum(a != b for a, b in zip(values, new)) > 3000
    began = time.process_time()
    got = p.rewrite("; ".join(values))[0]
    assert got == "; ".join(new) and time.process_time() - began < 5


def test_op7_table_against_walks_by_table(spark):
    """Pseudonyms of a table by a permutation that is written out in full."""
    rows = [(i, f"on {1900 + i}-0{1 + i % 9}-1{i % 10}, ip 10.{i}.0.1") for i in range(60)] + [(99, None)]
    f = feistel.Feistel(b"k")
    a = math.isqrt(feistel.DAYS - 1) + 1
    once = lambda x, size, tweak: f._once(x, math.isqrt(size - 1) + 1, -(-size // (math.isqrt(size - 1) + 1)), tweak, False)
    day = lambda n: datetime.date.fromordinal(feistel.DAY_0 + n)
    walk = {n: once(n, feistel.DAYS, b"date") for n in range(a * -(-feistel.DAYS // a))}
    want = {}
    for i, t in rows:
        if t is None:
            want[i] = None
            continue
        x = datetime.date.fromisoformat(t[3:13]).toordinal() - feistel.DAY_0
        y = walk[x]
        while y >= feistel.DAYS or (day(y).day <= 12) != (day(x).day <= 12):
            y = walk[y]
        ip = once(int.from_bytes(bytes([10, i, 0, 1]), "big"), 1 << 32, b"ip")
        want[i] = f"on {day(y)}, ip {'.'.join(map(str, ip.to_bytes(4, 'big')))}"
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert {r["doc_id"]: r["text"] for r in feistel.pseudonymise(docs, b"k").collect()} == want


def test_op7_table(spark):
    rows = [(1, "call +1 (743) 555-3824 or 4111111111111111", 5), (2, "again 4111111111111111", 5), (3, None, 5), (4, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_card INT")
    got = {r["doc_id"]: r for r in feistel.pseudonymise(docs, b"k").collect()}
    assert (got[1]["n_card"], got[1]["n_phone"], got[2]["n_card"], got[3]["text"], got[4]["text"]) == (1, 1, 1, None, "")
    assert got[1]["text"].rsplit(" ", 1)[1] == got[2]["text"].rsplit(" ", 1)[1]
    back = feistel.pseudonymise(feistel.pseudonymise(docs, b"k"), b"k", back=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r[0]: r[1] for r in rows}
    assert feistel.pseudonymise(docs.limit(0), b"k").count() == 0


# --- 8 ---------------------------------------------------------------------------------------


def test_op8(spark, texts):
    from tokenizers import Tokenizer

    t = texts + ["It's <|endoftext|> odd… İΣ 's 1,5!!! (x)", "a\x1cb\x85c"] + texts[:3]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = [[*tok.encode(x or "", add_special_tokens=False).ids, 2] for x in t]
    docs = frame(spark, t).withColumn("length", F.lit("clash"))
    rows = packing.pack(docs).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, own in enumerate(ids):
        parts = sorted((r["start"], r["length"]) for r in by_doc[i])
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) == len(own)
    padding = 0
    for seq in by_seq.values():
        seq = sorted(seq, key=lambda r: r["offset"])
        size = sum(r["length"] for r in seq)
        assert [r["offset"] for r in seq] == [sum(q["length"] for q in seq[:k]) for k in range(len(seq))] and size <= 4096
        padding += 0 if size & (size - 1) == 0 else 4096 - size
    assert padding <= 0.01 * sum(map(len, ids))
    assert packing.pack(docs.limit(0)).count() == 0


def test_op8_best_fit():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 101) for _ in range(300)]
    got = packing.best_fit_decreasing(lengths, 100)
    open_, want = [], []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fits = [k for k in range(len(open_)) if open_[k] >= lengths[i]]
        k = min(fits, key=lambda k: open_[k]) if fits else len(open_)
        if not fits:
            open_.append(100)
        open_[k] -= lengths[i]
    assert sorted(i for w in got for i in w) == list(range(300))
    assert len(got) == len(open_) and sorted(100 - sum(lengths[i] for i in w) for w in got) == sorted(open_)


# --- 9 ---------------------------------------------------------------------------------------


def masked(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in words(line))


def cleaned(texts, m=5):
    """Texts without the lines whose templates stand in m classes."""
    lines = [[(j, masked(x)) for j, x in enumerate((t or "").split("\n")) if words(x)] for t in texts]
    seen = collections.Counter()
    for own in lines:
        seen.update({(len(w), w[:2], p, w[p]) for _, w in own for p in range(2, len(w))})
    general = lambda w: tuple(x if p < 2 or seen[len(w), w[:2], p, x] >= m else "<*>" for p, x in enumerate(w))
    lines = [[(j, v) for j, v in ((j, general(w)) for j, w in own) if 100 * sum(x != "<*>" for x in v) >= 60 * len(v)] for own in lines]

    def found(classes):
        by = collections.defaultdict(set)
        for c, own in zip(classes, lines, strict=True):
            for _, v in own:
                by[v].add(c)
        return {v for v, c in by.items() if len(c) >= m}

    first = found(texts)
    over = sorted({t for t, own in zip(texts, lines, strict=True) if 2 * sum(len(v) for _, v in own if v in first) > len(words(t))})
    near = dict(zip(over, linked([shingles(t) for t in over]), strict=True))
    last = found([(near[t], "class") if t in near else t for t in texts]) & first
    drop = [{j for j, v in own if v in last} for own in lines]
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in d) for t, d in zip(texts, drop, strict=True)]


def test_op9(spark, texts):
    rng = random.Random(4)
    plain = lambda x: x and re.sub("[0-9]", lambda m: "klmnopqrst"[int(m[0])], x)
    prose = lambda rng, n: plain(globals()["prose"](rng, n))  # noqa: E731  words with digits are all alike here
    t = [plain(x) for x in texts] + [f"{prose(rng, 30)}\nLicensed under version {i}.0 of the common terms of use\n{prose(rng, 20)}\n\nsaid the person {rng.choice('xyz')}{'q' * i} to all of the others" for i in range(12)]
    t += [f"{prose(rng, 25)}\nPosted by {prose(rng, 1)} in {prose(rng, 1)}\nHome\n{i}" for i in range(9)]
    t += ["copy of a page with lines\nthat all recur " + "word " * 9] * 7 + ["tail\n"]
    t += [f"{prose(random.Random(5), 30)}\n{prose(random.Random(6), 30)} {prose(rng, 1)}" for _ in range(7)]
    want = cleaned(t)
    for entries in (None, 40):
        docs = frame(spark, t).withColumn("n_lines", F.lit("clash"))
        got = {r["doc_id"]: r for r in templates.drop_templates(docs, broadcast_entries=entries).collect()}
        assert [got[i]["text"] for i in range(len(t))] == want
    assert sum(r["n_dropped"] for r in got.values()) >= 12 + 12 + 18
    assert not any("Posted by" in (r["text"] or "") or "Home" in (r["text"] or "") for r in got.values())
    assert all(got[len(t) - 1 - k]["n_dropped"] == 0 for k in range(7))  # near copies alone
    assert templates.drop_templates(frame(spark, t).limit(0)).count() == 0


def test_op9_copies_do_not_make_lines_recur(spark):
    """Boilerplate over half of a short page goes; lines that only copies of a page share stay."""
    rng = random.Random(12)
    letters = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    footer = "all rights of this site are reserved by its owners " * 4
    pages = [f"{letters(12)}\n{footer}" for _ in range(8)]
    copy = f"{letters(9)}\n{letters(11)}"
    long = "one line that has no end " * 20_000
    t = pages + [copy] * 5 + [copy + " more", f"{copy}\n{footer}", long + "\n" + footer]
    got = {r["doc_id"]: r for r in templates.drop_templates(frame(spark, t)).collect()}
    assert all(got[i]["text"] == x.split("\n")[0] and got[i]["n_dropped"] == 1 for i, x in enumerate(pages))
    assert all(got[i]["text"] == t[i] and got[i]["n_dropped"] == 0 for i in range(8, 14))
    assert got[14]["text"] == copy and got[15]["text"] == long and len(got) == len(t)


# --- 10 --------------------------------------------------------------------------------------


def test_op10_share():
    assert budget.share(100, [(1, 10), (1, 100), (2, 30)]) == [10, 60, 30]
    assert budget.share(7, [(1, 5), (0, 9)]) == [5, 2] and budget.share(3, []) == [] and sum(budget.share(10, [(1, 9)] * 3)) == 10


def planned(total, leaves, weights, epochs):
    """Budgets by leaf, a level at a time: every token that is left is dealt to who is furthest below
    its weight's share and has room. Within a token a node of the exact division."""
    def deal(path, total):
        if path in leaves:
            return {path: total}
        names = sorted({p[: len(path) + 1] for p in leaves if p[: len(path)] == path}, key=lambda p: (p[-1] is None, p[-1] or ""))
        room = {c: sum(n for p, n in leaves.items() if p[: len(c)] == c) * epochs for c in names}
        # The level t at which sum(min(room, t * weight)) is the total.
        lo, hi = 0.0, float(total + 1) * 10
        for _ in range(200):
            t = (lo + hi) / 2
            lo, hi = (t, hi) if sum(min(room[c], t * weights.get(c, 1.0)) for c in names) < total else (lo, t)
        return {k: v for c in names for k, v in deal(c, min(room[c], hi * weights.get(c, 1.0))).items()}

    return deal((), min(total, epochs * sum(leaves.values())))


def test_op10_budgets(spark):
    rng = random.Random(21)
    for seed in range(3):
        leaves = {(f"d{rng.randrange(3)}", rng.choice(["en", "de", None]), f"s{i}"): rng.choice([0, 3, 50, 700, 9000]) for i in range(25)}
        weights = {("d0",): 3.0, ("d1",): 0.5, ("d0", "en"): 4.0, ("d2", "de", "s3"): 2.0}
        table = spark.createDataFrame([(json.dumps(k, separators=(",", ":")), n) for k, n in leaves.items()], "node STRING, tokens LONG")
        total = sum(leaves.values()) * (2 * seed + 1) // 3
        got = {tuple(json.loads(r["node"])): r["budget"] for r in budget.budgets(table, total, 3, weights, 2).collect()}
        want = planned(total, leaves, weights, 2)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 12 for k in want)
        assert sum(got.values()) == min(total, 2 * sum(leaves.values()))


def test_op10_shortages_go_to_siblings_first(spark):
    table = spark.createDataFrame([('["a","x"]', 10), ('["a","y"]', 100), ('["b","x"]', 40)], "node STRING, tokens LONG")
    give = lambda total, weights: {r["node"]: r["budget"] for r in budget.budgets(table, total, 2, weights).collect()}
    assert give(80, {}) == {'["a","x"]': 10, '["a","y"]': 30, '["b","x"]': 40}
    assert give(120, {("b",): 3.0}) == {'["a","x"]': 10, '["a","y"]': 70, '["b","x"]': 40}


def test_op10_prefixes(spark, texts):
    t = [x for x in texts if x is None or len(x) < 2000] * 3
    docs = frame(spark, t).withColumn("mix_tokens", F.lit("clash"))
    levels = {"lang": "lang", "source": "source"}
    out = budget.mix(docs, levels, {("en",): 3.0}, fraction=0.6, max_epochs=2).collect()
    supply, budgets, taken, rows = collections.Counter(), {}, collections.Counter(), collections.defaultdict(list)
    for i, x in enumerate(t):
        supply[("en", "de", None)[i % 3], f"src{i % 4}"] += len(words(x))
    for r in out:
        leaf = r["lang"], r["source"]
        assert r["mix_tokens"] == len(words(r["text"]))
        budgets[leaf] = r["mix_budget"]
        taken[leaf] += r["mix_tokens"]
        rows[leaf, r["mix_epoch"]].append(r)
    want = planned(int(sum(supply.values()) * 0.6), dict(supply), {("en",): 3.0}, 2)
    assert all(abs(budgets.get(k, 0) - v) < 12 for k, v in want.items())
    for leaf, b in budgets.items():
        longest = max(len(words(x)) for x in t)
        assert b <= taken[leaf] < b + longest
        if b > supply[leaf]:  # a whole epoch comes before the next one's prefix
            assert sum(r["mix_tokens"] for r in rows[leaf, 0]) == supply[leaf]
    again = budget.mix(docs, levels, {("en",): 3.0}, fraction=0.6, max_epochs=2)
    assert sorted((r["doc_id"], r["mix_epoch"]) for r in again.collect()) == sorted((r["doc_id"], r["mix_epoch"]) for r in out)
    empty = budget.mix(docs.limit(0), levels)
    assert empty.count() == 0 and empty.columns[-3:] == ["mix_epoch", "mix_tokens", "mix_budget"]
    assert {len(words(r["text"])) for r in budget.mix(docs, levels, total=0).collect()} <= {0}


def test_op10_prefix_order(spark, monkeypatch):
    """The prefix is that of the seeded order, however many rounds find its end."""
    docs = spark.createDataFrame([(i % 390, "w " * (i % 390 % 7)) for i in range(400)], "doc_id LONG, text STRING")
    keyed = docs.select("doc_id", F.expr(budget.WORDS.format("text")).alias("n"), F.xxhash64(F.lit(17), F.lit(0).cast("long"), F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), F.col("text"))).alias("key")).orderBy("key").collect()
    need, want, spent = int(sum(r["n"] for r in keyed) * 0.5), [], 0
    for _, same in itertools.groupby(keyed, key=lambda r: r["key"]):
        same = list(same)
        if spent < need:
            want += [r["doc_id"] for r in same]
        spent += sum(r["n"] for r in same)
    for most, few in ((1000, 100_000), (3, 100_000), (0, 0)):
        monkeypatch.setattr(budget, "ORDERED", most)
        monkeypatch.setattr(budget, "BROADCAST_LEAVES", few)
        assert sorted(r["doc_id"] for r in budget.mix(docs, {"all": "'x'"}, fraction=0.5).collect()) == sorted(want)


def test_op6_tiles_contract_to_components(spark):
    """A component is one row of a tile from round to round, that of the set in most tiles."""
    rows = spark.createDataFrame([(1, n, 9 if n == 4 else 2, 1) for n in range(2, 8)] + [(2, 7, 2, 1)], "tile LONG, node LONG, often LONG, k LONG")
    roots = spark.createDataFrame([(n, 2) for n in range(2, 6)], "node LONG, root LONG")
    got = jaccard._apart(rows, roots)
    assert sorted(tuple(r) for r in got.select("tile", "root_node", "node", "k").collect()) == [(1, 2, 4, 4), (1, 6, 6, 1), (1, 7, 7, 1), (2, 7, 7, 1)]
    again = jaccard._apart(got, spark.createDataFrame([(n, 2) for n in range(2, 8)], "node LONG, root LONG"))
    assert sorted(tuple(r) for r in again.select("tile", "root_node", "node", "k").collect()) == [(1, 2, 4, 6), (2, 2, 7, 1)]


def test_op4_buckets_as_gaps():
    """Chosen buckets of a row take about a byte each, whatever their density, and come back as they were."""
    rng = np.random.default_rng(1)
    for share in (0.001, 0.05, 0.6, 1.0):
        chosen = rng.random(cotrain.WORD_BUCKETS) < share
        where = np.flatnonzero(chosen)
        rows = [np.sort(rng.choice(where, min(len(where), k), replace=False)) for k in (0, 1, 0, 5, 300, len(where), 0)]
        sizes = np.array([len(r) for r in rows])
        raw, lengths = cotrain._gaps(np.concatenate(rows).astype(np.uint16), sizes, chosen)
        ranks, again = cotrain._ranks(np.frombuffer(raw, np.uint8), lengths)
        assert (where[ranks] == np.concatenate(rows)).all() and (again == sizes).all()
        assert len(raw) <= 1.2 * sizes.sum() + 100


def test_op9_bit_table_stays_packed():
    rng = np.random.default_rng(5)
    leaves = rng.integers(-(1 << 63), 1 << 63, 5000, np.int64)
    packed = np.zeros((templates.LEAF_BITS >> 16, 1 << 13), np.uint8)
    (b,) = templates._bits(iter([pa.RecordBatch.from_arrays([pa.array(x)], names=["hash"]) for x in (leaves[:3000], leaves[3000:])]))
    for chunk, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        packed[chunk] = np.frombuffer(bits, np.uint8)
    packed = packed.ravel()
    asked = np.concatenate([leaves, leaves ^ 1, rng.integers(-(1 << 63), 1 << 63, 5000, np.int64)]).view(np.uint64)
    there = {int(x) & (templates.LEAF_BITS - 1) for x in leaves.tolist()}
    expected = [int(x) & (templates.LEAF_BITS - 1) in there for x in asked.tolist()]
    text = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["one two three four\nfive six seven\n"])], names=["row", "text", "t"])
    tracemalloc.start()
    try:
        assert not list(templates._candidates(iter([text]), packed, 16))
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
    assert templates._held(packed, asked).tolist() == expected
