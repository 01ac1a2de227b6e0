"""Line frequency, toxicity, Kneser-Ney and near duplicates against brute force."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowlane.llm import bbit, common, kneserney, linefreq, queries, toxicity
from sparrowlane.llm.components import connected_components

from .fixtures import documents, edge_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- kernels

def test_words_and_shingles():
    texts = ["  A b\x0bC\n\nd ", "", "é\x1cx Y", "a b c d e f", "a b c d e f a b c d e"]
    flat, at = common.split_words(pa.array(texts))
    got = [flat.to_pylist()[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]
    sets = common.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [1, 0, 1, 2, 6]
    assert np.intersect1d(sets[3], sets[4]).size == 2


# ---------------------------------------------------------------- line frequency

def base_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    covered = {i + k for g in grams.values() if len(g) > 1 for i in g for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def judged_by_force(rows, limits):
    """rows: (id, text, host)"""
    norm = lambda line: " ".join(WORD.findall(line.translate(LOWER)))
    first, copies = {}, defaultdict(set)
    for i, t, h in rows:
        key = (h, t or "")
        first[key] = min((x for x in (first.get(key), i) if x is not None), default=None)
        copies[key].add(i)
    number = {k: 1 if limits.equal_texts_once else len(v) for k, v in copies.items()}
    lines = {k: Counter() for k in first}
    for h, t in first:
        for line in t.split("\n"):
            if norm(line):
                lines[h, t][norm(line)] += len(norm(line).split())
    size = Counter()
    held = defaultdict(list)
    for (h, t), ls in lines.items():
        size[h] += number[h, t]
        for line in ls:
            held[h, line].append((h, t))
    total = {k: sum(number[x] for x in v) for k, v in held.items()}
    over = {k: min((first[x] for x in v if first[x] is not None), default=None) for k, v in held.items() if total[k] > limits.most_documents and total[k] > limits.most_share * size[k[0]]}
    out = []
    for i, t, h in rows:
        s = base_statistics(t)
        gone = sum(n for line, n in lines[h, t or ""].items() if (h, line) in over and not (limits.keep_first and over[h, line] == first[h, t or ""]))
        failed = s[0] < limits.base_words or 100 * s[4] > limits.repeat_percent * s[0]
        out.append((i, *s, failed, gone, not failed and s[0] - gone >= limits.least_words and gone <= limits.most_removed * s[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"most_share": 0.1, "equal_texts_once": True, "keep_first": True}])
def test_line_frequency(spark, options):
    rng = random.Random(3)
    boiler = ["Cookie  notice: ACCEPT all", "share this page now"]
    rows = [(i, t, "s") for i, t in edge_rows()]
    for i in range(100, 160):
        own = "\n".join(" ".join(words(rng, 8)) for _ in range(rng.randrange(1, 6)))
        rows.append((i, own + "\n" + rng.choice(boiler) + ("\n" + boiler[0].lower() if i % 3 else ""), rng.choice(["a", "b", None])))
    rows += [(200, " ".join(["again"] * 40), "a"), (201, rows[30][1], rows[30][2]), (202, "a b c d e f g h # $ a b c d e f g h " * 3, "b")]
    limits = linefreq.Limits(most_documents=3, least_words=5, **options)
    got = linefreq.judged(documents(spark, rows, extra="clash"), limits).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == judged_by_force(rows, limits)
    assert any(r["removed_words"] for r in got)
    clean = linefreq.cleaned(documents(spark, rows, extra="clash"), limits)
    assert clean.columns == documents(spark, rows, extra="clash").columns
    kept = sorted(str(r["doc_id"]) for r in got if r["kept"])
    found = clean.collect()
    assert sorted(str(r["doc_id"]) for r in found) == kept
    left = Counter(len(WORD.findall(r["text"])) for r in found)
    assert left == Counter(r["n_words"] - r["removed_words"] for r in got if r["kept"])
    assert linefreq.judged(documents(spark, rows).limit(0), limits).count() == 0


@pytest.mark.parametrize("once", [False, True])
def test_copies_count_as_documents(spark, once):
    rng = random.Random(4)
    text = "\n".join(" ".join(words(rng, 10)) for _ in range(5))
    rows = [(i, text, "a") for i in range(60)] + [(i, " ".join(words(rng, 30)), "a") for i in range(100, 110)]
    got = {r["doc_id"]: r["kept"] for r in linefreq.judged(documents(spark, rows), linefreq.Limits(equal_texts_once=once)).collect()}
    assert got == {i: once or i >= 100 for i, *_ in rows}


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(i % 15, text, "a") for i in range(60)]
    assert all(r["kept"] for r in linefreq.judged(documents(spark, rows)).collect())


def test_a_line_goes_from_a_large_host_as_from_a_small_one(spark):
    held = 25  # documents of each host that hold the line
    texts = lambda i: " ".join(f"w{i}x{k}" for k in range(30)) + ("\nshared line of five words" if i % 10_000 < held else "")
    rows = [(i, texts(i), "large") for i in range(3000)] + [(10_000 + i, texts(10_000 + i), "small") for i in range(40)]
    got = {r["doc_id"]: r["removed_words"] for r in linefreq.judged(documents(spark, rows)).collect()}
    assert got == {i: 5 if i % 10_000 < held else 0 for i, *_ in rows}


# ---------------------------------------------------------------- toxicity

def test_folding():
    assert toxicity.fold("Ѕtuріd 1d10t, l0s​er ｔｒａｓｈ a55 2024!") == ["stupid", "idiot", "ioser", "trash", "ass", "2024"]
    assert toxicity.fold("") == []


def hits_by_force(lexicon, words_):
    """Naive search of every entry at every word."""
    text, out, spared = " " + " ".join(words_) + " ", {}, []
    for e, w in lexicon.weights.items():
        key = " " + (e[:-1] if e.endswith("*") else e + " ")
        for m in re.finditer(f"(?={re.escape(key)})", text):
            if m.start() not in out or w > out[m.start()][1]:
                out[m.start()] = (m.start() + len(key) - 1, w)
    for p in lexicon.exceptions:
        spared += [(m.start(), m.start() + len(p) + 1) for m in re.finditer(f"(?= {re.escape(p)} )", text)]
    return sum(w for s, (e, w) in out.items() if not any(a <= s and e <= b for a, b in spared))


def test_matching_equals_naive_search():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({"ab*": 1.0, "abc": 2.5, "cc": 1.0, "a*": 0.5}, frozenset({"cc x", "x abc"}))
    automaton = lexicon.automaton()
    for _ in range(300):
        w = [rng.choice(["ab", "abc", "cc", "x", "abcd", "b", "a"]) for _ in range(rng.randrange(12))]
        total = hits_by_force(lexicon, w)
        assert lexicon.features(w, automaton) == pytest.approx((math.log1p(100 * total / max(1, len(w))), math.log1p(total)))


def test_hits_of_a_very_long_text_take_linear_time():
    lexicon = toxicity.Lexicon({"bad": 1.0}, frozenset({"not bad"}))
    automaton, seconds = lexicon.automaton(), []
    for n in (100_000, 1_000_000):
        w = ["bad", "not", "bad", "x"] * (n // 4)
        began = time.process_time()
        assert len(lexicon.hits(w, automaton)) == n // 4
        seconds.append(time.process_time() - began)
    assert seconds[1] < 40 * max(seconds[0], 0.05)


def fit_by_force(rows):
    """Entries with weights, exceptions, and the curve, from (text, label) rows that are no copies of each other."""
    toxic, clean = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    folded = [(toxicity.fold(t or ""), y) for t, y in rows]
    have = defaultdict(lambda: [0, 0])
    for w, y in folded:
        for key in {*w, *(x[:k] + "*" for x in w for k in range(4, 13) if k < len(x))}:
            have[key][1 - y] += 1
    good = {}
    for key, (t, f) in have.items():
        n, share = t + f, toxic / (toxic + clean)
        ratio = 2 * ((t * math.log(t / (n * share)) if t else 0) + (f * math.log(f / (n * (1 - share))) if f else 0))
        weight = math.log((t + 0.5) / (toxic + 1) / ((f + 0.5) / (clean + 1)))
        if t >= toxicity.LEAST_TEXTS and t / toxic > f / clean and ratio >= toxicity.LEAST_RATIO and weight >= math.log(toxicity.LEAST_RATE):
            good[key] = (t, weight)
    under = lambda a, b: a != b and a.endswith("*") and b.rstrip("*").startswith(a[:-1]) and len(b.rstrip("*")) > len(a) - 1
    better = {a for a in good for b in good if under(a, b) and good[b][0] >= 0.95 * good[a][0]}
    chosen = {}
    for key in sorted(good, key=lambda k: (len(k.rstrip("*")), k)):
        if key not in better and not any(under(a, key) for a in chosen):
            chosen[key] = good[key][1]
    lexicon, phrases = toxicity.Lexicon(chosen), defaultdict(lambda: [0, 0])
    for w, y in folded:
        at, found = 0, set()
        for i, x in enumerate(w):
            if any(x == e or (e.endswith("*") and x.startswith(e[:-1])) for e in chosen):
                found |= {" ".join(w[a:b]) for a, b in ((i - 1, i + 1), (i, i + 2)) if a >= 0 and b <= len(w)}
        for phrase in found:
            phrases[phrase][1 - y] += 1
    lexicon.exceptions = frozenset(p for p, (t, f) in phrases.items() if not t and f >= 3)
    totals = [(hits_by_force(lexicon, w), len(w), y) for w, y in folded]
    x = np.array([(1, math.log1p(100 * s / max(1, n)), math.log1p(s)) for s, n, _ in totals])
    y = np.array([y for *_, y in totals], float)
    theta = np.zeros(3)
    for _ in range(200):  # damped Newton steps on the regularised loss
        p = 1 / (1 + np.exp(-x @ theta))
        theta -= 0.5 * np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(3), x.T @ (p - y) + 0.01 * theta)
    return lexicon, theta


def test_fit_and_scores_equal_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for i in range(800):
        w = words(rng, rng.randrange(25, 60), 300)
        y = int(i % 16 == 0)
        if y and i % 160:
            w.insert(rng.randrange(len(w)), ["vilewords", "vilest", "nastyone", "nastyone"][i // 16 % 4])
        if not y and i < 5:
            w[3:3] = ["never", "nastyone"]
        rows.append((i, " ".join(w), y))
    docs = documents(spark, [r[:2] for r in rows] + [(1000 + i, rows[0][1]) for i in range(20)])  # copies teach once
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000 + i, 1) for i in range(20)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    want, theta = fit_by_force([(t, y) for _, t, y in rows])
    assert lexicon.weights == pytest.approx(want.weights) and lexicon.weights and lexicon.exceptions == want.exceptions and lexicon.exceptions
    assert (lexicon.bias, *lexicon.slopes) == pytest.approx(tuple(theta), rel=1e-4, abs=1e-4)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, lexicon).collect()}
    for i, t, _ in rows:
        w = toxicity.fold(t)
        s = hits_by_force(want, w)
        z = theta @ (1, math.log1p(100 * s / len(w)), math.log1p(s))
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_too_many_entries_are_an_error(spark):
    rng = random.Random(15)
    rows = [(i, " ".join([*words(rng, 30), *(["vileone", "viletwo", "worst"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(80)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    with pytest.raises(ValueError, match="entries"):
        toxicity.fit(documents(spark, [r[:2] for r in rows]), labels, most_entries=2)


def test_held_out_accuracy(spark, small):
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, small).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [(got[i], t) for i, t in labels.items() if got[i]["held_out"]]
    assert len(held) > 50 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert sum(r["predicted"] == t for r, t in held) / len(held) > 0.95
    assert sum(1 for r, t in held if not t and r["predicted"]) == 0


def test_toxicity_edges(spark):
    rng = random.Random(7)
    plain = [(i, " ".join(words(rng, 50))) for i in range(60)]
    nasty = [(i, " ".join([*words(rng, 40), "vileword", "vileword"])) for i in range(100, 130)]
    docs = documents(spark, plain + nasty + edge_rows(), extra="clash")
    labels = spark.createDataFrame([(i, 0) for i, _ in plain] + [(i, 1) for i, _ in nasty] + [(100, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert any("vii" in k for k in lexicon.weights)
    kept = toxicity.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in plain + edge_rows())
    probe = documents(spark, [(1, "such a V1LEW0RD and vileword here"), (2, None)]).select("doc_id", "text")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(probe, lexicon).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.fit(docs, labels.limit(0)).weights == {}
    assert toxicity.scored(probe.limit(0), lexicon).count() == 0


# ---------------------------------------------------------------- Kneser-Ney

def by_force(train, texts):
    """N, V and for each text: tokens, known, base and score, from the formulas."""
    stream = lambda t: [*WORD.findall((t or "").translate(LOWER)), "</s>"]
    pairs, uni = Counter(), Counter()
    for t in train:
        tokens = stream(t)
        uni.update(tokens)
        pairs.update(zip(["<s>", *tokens[:-1]], tokens, strict=True))
    n, v = sum(uni.values()), len(uni)
    before, after, total = Counter(), defaultdict(list), Counter()
    for (a, b), c in pairs.items():
        before[b] += 1
        after[a].append(c)
        total[a] += c
    d = kneserney.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = kneserney.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    cut = lambda c, x: 0 if not c else x[min(c, 3) - 1]
    a = sum(before.values())
    free = sum(cut(c, e) for c in before.values()) / a if a else 1.0
    p1 = lambda w: max(before[w] - cut(before[w], e), 0) / max(1, a) + free / (v + 1)

    def p(u, w):
        if not total[u]:
            return p1(w)
        return (max(pairs[u, w] - cut(pairs[u, w], d), 0) + sum(cut(c, d) for c in after[u]) * p1(w)) / total[u]

    out = []
    for i, t in texts:
        tokens = stream(t)
        out.append((i, len(tokens), sum(w in uni for w in tokens), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tokens), sum(math.log10(p(u, w)) for u, w in zip(["<s>", *tokens[:-1]], tokens, strict=True))))
    return out, p, uni


def test_kneser_ney_equals_formulas(spark):
    rng = random.Random(8)
    rows = edge_rows() + [(i, " ".join(words(rng, rng.randrange(1, 80), 60)).upper() if i % 2 else " ".join(words(rng, 30, 60))) for i in range(300, 380)]
    train = [r for r in rows if r[0] is None or r[0] % 3]
    df = documents(spark, rows, extra="clash")
    model = kneserney.train(documents(spark, train, extra="clash"), parts=8)
    got = sorted(((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in kneserney.score(df, model).collect()))
    want, p, uni = by_force([t for _, t, *_ in train], [(str(i), t) for i, t, *_ in rows])
    want.sort()
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5])
    for u in ("<s>", "w1", "never seen"):
        assert sum(p(u, w) for w in uni) + p(u, "another unseen") == pytest.approx(1)


def third_order_by_force(train):
    """The probability of w after (u, v) in order three, by the formulas; u is None for a first word."""
    stream = lambda t: ["<s>", *WORD.findall((t or "").translate(LOWER)), "</s>"]
    triples, starts, uni = Counter(), Counter(), Counter()
    for t in train:
        tokens = stream(t)
        uni.update(tokens[1:])
        starts[tokens[0], tokens[1]] += 1
        triples.update(zip(tokens, tokens[1:], tokens[2:]))
    pairs = Counter((v, w) for _, v, w in triples)
    pairs.update(starts)
    words_ = Counter(w for _, w in pairs)
    found = [kneserney.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (words_, pairs, triples)]
    cut = lambda c, d: 0 if not c else d[min(c, 3) - 1]
    a = sum(words_.values())
    p1 = lambda w: (words_[w] - cut(words_[w], found[0])) / a + sum(cut(c, found[0]) for c in words_.values()) / a / (len(uni) + 1)
    after_pair, after_word = defaultdict(list), defaultdict(list)
    for (u, v, _), c in triples.items():
        after_pair[u, v].append(c)
    for (v, _), c in pairs.items():
        after_word[v].append(c)

    def p(u, v, w):
        low = p1(w)
        for seen, c, d in ((after_word[v], pairs[v, w], found[1]), (after_pair[u, v], triples[u, v, w], found[2])):
            low = (c - cut(c, d) + sum(cut(x, d) for x in seen) * low) / sum(seen) if seen else low
        return low

    return p, uni, stream


def test_kneser_ney_of_order_three(spark, monkeypatch):
    monkeypatch.setattr(kneserney, "SAMPLE", 1)
    rng = random.Random(12)
    rows = edge_rows() + [(i, " ".join(words(rng, rng.randrange(1, 60), 12)).upper() if i % 2 else " ".join(words(rng, 40, 50))) for i in range(300, 400)]
    train = [r for r in rows if r[0] is None or r[0] % 3]
    p, uni, stream = third_order_by_force([t for _, t, *_ in train])
    want = []
    for i, t, *_ in rows:
        tokens = stream(t)
        want.append((str(i), len(tokens) - 1, sum(math.log10(p(u, v, w)) for u, v, w in zip([None, *tokens], tokens, tokens[1:]))))
    for parts in (1, 8, 64):
        model = kneserney.train(documents(spark, train, extra="clash"), parts=parts, order=3)
        assert parts < 64 or (len(model.frequent) > 5 and model.spread_pairs and model.pairs)
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in kneserney.score(documents(spark, rows, extra="clash"), model).collect())
        for a, b in zip(got, sorted(want), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
    for u, v in ((None, "<s>"), ("<s>", "w1"), ("w1", "w2"), ("w1", "never seen")):
        assert sum(p(u, v, w) for w in uni) + p(u, v, "another unseen") == pytest.approx(1)


@pytest.mark.parametrize("n", [0, 1, 5, 40, 3000])
def test_bucketed_keys(n):
    rng = np.random.default_rng(16)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64))
    at, rest = kneserney.bucketed(keys)
    if len(keys):
        place, found = kneserney.places(at, rest, np.concatenate((keys[::-1], rng.integers(0, 1 << 63, 500, dtype=np.uint64))))
        assert found[: len(keys)].all() and (place[: len(keys)] == np.arange(len(keys))[::-1]).all() and not found[len(keys) :].any()
    assert len(at) == (1 << max(0, (len(keys) // kneserney.BUCKET_KEYS).bit_length())) + 1 and at[-1] == len(keys) and rest.itemsize == 4


def test_a_store_that_cannot_be_mapped_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(kneserney, "READ_BYTES", 4000)
    rng = random.Random(13)
    texts = [" ".join(words(rng, 40, 60)) for _ in range(80)]
    model = kneserney.train(documents(spark, list(enumerate(texts))), parts=16, order=3)
    before, tokens, offsets = kneserney.token_stream(pa.array(texts))
    read = kneserney.MappedModel(model, mappable=False)
    for a, b in zip(read.probabilities(before, tokens, offsets), model.mapped().probabilities(before, tokens, offsets), strict=True):
        assert (a == b).all()
    assert read.held <= 4000 or len(read.open) == 1


def test_kneser_ney_query_is_of_order_three(spark, tiny):
    docs = common.read_table(spark, tiny, "documents").select("doc_id", "text")
    held_out = common.id_remainder(F.col("doc_id"), 7) == 2
    found = {r["doc_id"]: r["score"] for r in queries.op8_kneser_ney(spark, tiny).collect()}
    p, _, stream = third_order_by_force([r["text"] for r in docs.where(~held_out).collect()])
    for r in docs.limit(20).collect():
        tokens = stream(r["text"])
        assert found[r["doc_id"]] == pytest.approx(sum(math.log10(p(u, v, w)) for u, v, w in zip([None, *tokens], tokens, tokens[1:])))


def test_kneser_ney_without_training(spark):
    df = documents(spark, edge_rows())
    model = kneserney.train(df.limit(0))
    rows = kneserney.score(df, model).collect()
    assert len(rows) == len(edge_rows()) and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in rows)
    assert kneserney.score(df.limit(0), model).count() == 0


# ---------------------------------------------------------------- near duplicates

def near_by_force(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 4 >= 3 * max(len(sets[i]), len(sets[j])):
                c = len(sets[i] & sets[j])
                if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                    root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        groups[top(i)].append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    out = []
    for i, (d, *_) in enumerate(rows):
        c = low[top(i)] if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def near_rows(seed=9, group=70):
    rng = random.Random(seed)
    rows = edge_rows()
    original = words(rng, 120, 3000)
    for i in range(group):  # copies of one original that are often not near each other
        copy = list(original)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(copy)))
    passage = words(rng, 60, 3000)
    for i in range(group):  # a shared passage in short texts
        rows.append((2000 + i, " ".join(passage + words(rng, rng.randrange(5, 60), 3000))))
    return rows


@pytest.mark.parametrize("block, ids", [(2048, 1_000_000), (8, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, ids):
    monkeypatch.setattr(bbit, "BLOCK", block)
    monkeypatch.setattr(bbit, "MOST_BROADCAST_IDS", ids)  # 0: texts are found by a shuffled join
    rows = near_rows()
    got = bbit.near_duplicates(documents(spark, rows, extra="clash")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr) == near_by_force(rows)


def test_one_row_of_each_group_stays(spark):
    rows = near_rows(group=20)
    docs = documents(spark, rows + rows, extra="clash")
    out = bbit.without_near_duplicates(docs)
    assert out.columns == docs.columns
    found = out.collect()
    # near copies of one id are one group; rows of one id with other texts are others
    sets = {(r["doc_id"], r["text"]) for r in found}
    assert len(sets) == len(found)
    kept = {v[0] for v in near_by_force(rows) if v[3]}
    assert {r["doc_id"] for r in found} == kept
    assert sum(r["doc_id"] == 8 for r in found) == 1 and sum(r["doc_id"] == 1 for r in found) == 1


def test_near_duplicates_of_nothing(spark):
    assert bbit.near_duplicates(documents(spark, edge_rows()).limit(0)).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(10)
    found, true = [], []
    for _ in range(60):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        n = int(rng.integers(150, 300))
        b = np.concatenate((a[:n], rng.integers(0, 2**63, 300 - n).astype(np.uint64)))
        bits = [np.frombuffer(bbit.packed_bits(bbit.minima(np.sort(x))), np.uint64) for x in (a, b)]
        found.append(float(bbit.estimates(bits[0], bits[1])))
        true.append(n / (600 - n))
    error = np.array(found) - np.array(true)
    assert abs(error.mean()) < 0.02 and np.abs(error).max() < 0.15


@pytest.mark.parametrize("hub", [3, 100_000])
def test_components(spark, hub):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), hub).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == root
