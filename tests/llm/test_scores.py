"""Language model, classifier and rules, token counts, URL filter, mixing, top-k: brute force and defined cases."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import common, hmm, mixing, quality_classifier, quality_rules, textstats, token_counts, topk, trees, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- language model ----------------------------------------------------------------------------------------------------


def small_model(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    start, step, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hmm.Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), np.full(states, 1 / states))


def paths(model, seq):
    """Likelihood and posterior sums over all state paths."""
    k = len(model.start)
    total, emits, steps, starts = 0.0, np.zeros_like(model.emit), np.zeros((k, k)), np.zeros(k)
    for p in itertools.product(range(k), repeat=len(seq)):
        w = model.start[p[0]] * model.emit[seq[0], p[0]]
        for t in range(1, len(seq)):
            w *= model.step[p[t - 1], p[t]] * model.emit[seq[t], p[t]]
        total += w
        starts[p[0]] += w
        for t, s in enumerate(p):
            emits[seq[t], s] += w
            if t:
                steps[p[t - 1], s] += w
    return total, emits / total, steps / total, starts / total


def test_forward_and_expected_counts_against_all_paths():
    model = small_model()
    seqs = [[0, 1, 2, 3, 4, 1], [2], [4, 4, 0], [1, 3]]
    flat, size = np.concatenate([np.array(s, np.int32) for s in seqs]), np.array([len(s) for s in seqs])
    start = np.cumsum(size) - size
    got = hmm.forward(model, flat, start, size)
    want = [paths(model, s) for s in seqs]
    assert np.allclose(got, [math.log10(w[0]) for w in want])
    e, s, p, fit = hmm.expected(model, flat, start, size, np.ones(4, bool))
    assert math.isclose(fit, sum(math.log(w[0]) for w in want))
    assert np.allclose(e, sum(w[1] for w in want)) and np.allclose(s, sum(w[2] for w in want)) and np.allclose(p, sum(w[3] for w in want))


def test_segments_count_every_token_and_step_once():
    """Counts by overlapping segments come near those of the whole sequence, and their totals are exact."""
    rng = np.random.default_rng(2)
    model = small_model()
    size = np.array([3000, 1, 256, 257, 700])
    flat = rng.integers(0, 5, size.sum()).astype(np.int32)
    start = np.cumsum(size) - size
    whole = hmm.expected(model, flat, start, size, np.ones(5, bool))
    parts = hmm.expected(model, flat, *hmm.segments(start, size))
    assert math.isclose(parts[0].sum(), size.sum()) and math.isclose(parts[1].sum(), size.sum() - 5) and math.isclose(parts[2].sum(), 5)
    assert all(np.allclose(a, b, rtol=1e-3) for a, b in zip(parts, whole, strict=True))


def test_score_is_the_sum_over_all_paths(spark):
    """Scores of tiny texts by enumerating the state paths, each word with its own emissions, those from the posteriors of every training text."""
    texts = [(i, t) for i, t in enumerate(["the cat sat", "The cat", "a dog sat on the cat", "", "zebra the", "on on on"] * 4 + ["unheard zebra"] * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    held = lambda i: crc32(str(i).encode()) % 5 == 1
    training = docs.where(common.fold_of("doc_id", hmm.FOLDS) != hmm.HELD_OUT)
    counts = common.settled(hmm.count_words(training), "t")
    lex = hmm.lexicon(counts, head=3, classes=2)
    first = hmm.first_model(common.settled(hmm.code(docs, lex), "t"), lex, 3)
    c = {r["word"].encode(): r["c"] for r in counts.collect()}
    head, k = lex.symbols, 3
    coded = lambda t: ([*hmm.words_of(t), hmm.END], [lex.at[w] if w in lex.at else head + hmm.tail_class(w, 2) for w in [*hmm.words_of(t), hmm.END]])
    emits, steps, starts, by_word = np.zeros((head + 2, k)), np.zeros((k, k)), np.zeros(k), defaultdict(lambda: np.zeros(k))
    for i, t in texts:
        if held(i):
            continue
        words, seq = coded(t)
        _, e, s, p = paths(first, seq)
        emits, steps, starts = emits + e, steps + s, starts + p
        for place, w in enumerate(words):
            if w not in lex.at:  # the place as a symbol of its own: its posterior alone
                own = hmm.Hmm(first.start, first.step, np.vstack([first.emit, first.emit[seq[place]]]), first.share)
                by_word[w] += paths(own, [*seq[:place], head + 2, *seq[place + 1 :]])[1][head + 2]
    model = hmm.normalised(emits, steps, starts, lex.symbol_share())
    inside = {}
    for n in range(2):
        own = [w for w in by_word if hmm.tail_class(w, 2) == n]
        assert all(math.isclose(by_word[w].sum(), c[w]) for w in own)
        total = emits[head + n].sum()
        g = emits[head + n] / total if total else model.share
        part = lambda w, g=g: np.maximum(1, np.rint(hmm.COARSE * (by_word[w] + hmm.TAU * g) / (c[w] + hmm.TAU))) / hmm.COARSE
        weight = {w: (c[w] + 0.5) * part(w) for w in own} | {None: 0.5 * g}
        z = sum(weight.values())
        inside |= {(n, w): x / z for w, x in weight.items()}
    assert len(by_word) >= 3 and set(c) - set(lex.at) == set(by_word)
    want = {}
    for i, t in texts:
        words, seq = coded(t)
        rows = [model.emit[s] * (1 if w in lex.at else inside[s - head, w if w in c else None]) for w, s in zip(words, seq, strict=True)]
        want[i] = math.log10(paths(hmm.Hmm(model.start, model.step, np.array(rows), model.share), range(len(rows)))[0])
    got = {r["doc_id"]: r["score"] for r in hmm.lm_scores(docs, states=3, max_passes=1, head=3, classes=2).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)
    # in each state, head words and each class's known words and one unknown make a distribution
    each = model.emit[:head].sum(axis=0) + sum(model.emit[head + n] * x for (n, _), x in inside.items())
    assert np.allclose(each, 1)


def test_long_texts_do_not_underflow():
    model = small_model()
    flat = np.tile(np.arange(5, dtype=np.int32), 20_000)
    ll = hmm.forward(model, flat, np.array([0]), np.array([len(flat)]))[0]
    assert np.isfinite(ll) and ll < -10_000


def test_scores(spark, sf):
    docs = docs_of(spark, sf).select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, "  \n"), (-3, "zzzq unseen-word"), (-3, "zzzq unseen-word"), (None, "the")], docs.schema)
    rows = docs.unionByName(odd)
    got = hmm.lm_scores(rows, head=300, classes=16).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in rows.collect()]
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + [" "]
    c = Counter(w for i, t in texts if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(words(t)), sum(w in c for w in words(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in texts)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_word_probabilities_sum_to_one(spark, sf):
    """Symbols and, within a class, its known words and one unknown make a distribution."""
    counts = common.settled(hmm.count_words(docs_of(spark, sf)), "t")
    lex = hmm.lexicon(counts, head=40, classes=8)
    c = {r["word"].encode(): r["c"] for r in counts.collect()}
    assert lex.total == sum(c.values()) and lex.kinds == len(c)
    for k in range(8):
        own = [w for w in c if w not in lex.at and hmm.tail_class(w, 8) == k]
        assert lex.class_words[k] == sum(c[w] for w in own) and lex.class_kinds[k] == len(own)
        total = lex.class_words[k] + 0.5 * (lex.class_kinds[k] + 1)
        assert math.isclose(sum((c[w] + 0.5) / total for w in own) + 0.5 / total, 1)


def test_scores_without_training_texts(spark):
    held = next(i for i in range(100) if crc32(str(i).encode()) % 5 == 1)
    r = hmm.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and np.isfinite(r["score"])
    assert hmm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- statistics, classifier, rules ---------------------------------------------------------------------------------------


def plain_repeats(words):
    n = len(words)
    seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    return len({i + j for i in range(n - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)})


@pytest.mark.parametrize("text", ["", " \n\t", "a", "A b c # $ | é\n\nA b c # $ | é\n x", "the cat " * 40, " ".join(map(str, range(50))) + " " + " ".join(map(str, range(9))), "one two\nOne two\none two"])
def test_stats_against_definitions(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    s = dict(zip(textstats.COUNTS, textstats.stats_of(text), strict=True))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert s["n_words"] == len(words) and s["word_chars"] == sum(map(len, words)) and s["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
    assert s["n_dup_lines"] == len(lines) - len(set(lines)) and s["n_repeat_words"] == plain_repeats(words)


def test_repeats_on_random_texts():
    rng = np.random.default_rng(7)
    for n in (5, 9, 30, 400):
        for kinds in (2, 5, 60):
            w = [b"%d" % i for i in rng.integers(0, kinds, n)]
            assert textstats.repeated_window_words(w) == plain_repeats(w)


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(8)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.1)).astype(float)
    model = trees.fit(x, y, monotone={0: -1, 1: 1})
    probe = np.tile(rng.random((40, 1, 3)), (1, 50, 1))
    for j, sign in ((0, -1), (1, 1)):
        p = probe.copy()
        p[:, :, j] = np.linspace(0, 1, 50)
        steps = np.diff(model.probability(p.reshape(-1, 3)).reshape(40, 50), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert (((model.probability(x) > 0.5) == (y > 0.5)).mean()) > 0.85
    assert len(trees.fit(x, np.ones(3000)).roots) == 0


def test_quality_classifier_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d = quality_classifier.quality_scores(docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (d["predicted"] == d["quality"]).mean() > 0.97
    assert d["score"].between(0, 1).all() and ((d["score"] >= 0.7) == (d["predicted"] == 1)).all()


def test_compiled_rules_equal_numpy(spark, sf):
    docs, labels = docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    stats = common.settled(textstats.text_stats(docs, "doc_id"), "t")
    x, y = quality_rules.labelled_sample(stats, labels, "quality", 500)
    model = quality_classifier.fit_ensemble(x, y)
    assert model.rules and all(" " in d for d in model.describe())
    rows = textstats.with_features(stats).withColumn("score", model.column()).toPandas()
    m = quality_classifier.rule_matrix(rows[[f"f_{n}" for n in quality_rules.NAMES]].to_numpy(), [p for p, _ in model.rules])
    assert np.allclose(rows["score"], 1 / (1 + np.exp(-(model.bias + m @ np.array([w for _, w in model.rules])))))


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "some text", "z"), (2, "", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = quality_classifier.quality_scores(docs, labels).collect()
    assert len(out) == 4 and {(r["score"], r["predicted"]) for r in out} == {(1.0, 1)}
    assert quality_classifier.keep_quality(docs, labels).count() == 4
    good = quality_classifier.keep_quality(docs, spark.createDataFrame([(1, 1), (3, 1), (2, 1)], "doc_id long, quality int"))
    assert good.columns == docs.columns
    rules = quality_rules.quality_rules(docs, labels).collect()
    assert [(r["n_words"], r["base_failed"], r["kept"]) for r in sorted(rules, key=lambda r: r["n_words"])] == [(0, True, False)] * 3 + [(2, True, False)]
    assert quality_rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_rules_keep_plain_prose_and_drop_noise(spark):
    sf = "/root/testdata/sf0.1"
    d = quality_rules.quality_rules(docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert (d["kept"] == (d["quality"] == 1)).mean() > 0.98


# -- token counts ---------------------------------------------------------------------------------------------------------


def test_rollup_against_brute_force(spark, sf, tmp_path):
    docs = docs_of(spark, sf)
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "", "en", None, 0), (-3, "a a b", "en", "s", 5), (-3, "a a b", "en", "s", 5), (None, "a a b", "en", "t", 5)], docs.schema)
    rows = docs.unionByName(odd)
    path = P.path("byte_bpe_50k.tiktoken")
    got = {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in token_counts.corpus_rollup(rows, path, P.PATTERN, str(tmp_path)).collect()}
    enc = token_counts._encoder(path, P.PATTERN)
    first = {}
    for r in rows.collect():
        t = r["text"] or ""
        k = (r["doc_id"] is None, r["doc_id"] or 0, r["source"] is not None, r["source"] or "", r["lang"] is not None, r["lang"] or "")
        if t not in first or k < first[t][0]:
            first[t] = (k, r["source"], r["lang"])
    want = Counter()
    tokens = Counter()
    for t, (_, source, lang) in first.items():
        n = len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w])
        if n:
            want[source, lang, "words-1"] += 1
            tokens[source, lang, "words-1"] += n
        want[source, lang, "bpe-50k"] += 1
        tokens[source, lang, "bpe-50k"] += len(enc.encode_ordinary(t)) if n else 0
    assert got == {k: (v, tokens[k]) for k, v in want.items()}


def test_batches_commit_once(spark, tmp_path):
    led = token_counts.Ledger(spark, str(tmp_path / "a"))
    row = "source string, lang string, version string, sign int, documents long, tokens long"
    plus = spark.createDataFrame([("s", "en", "v", 1, 2, 30), ("s", None, "v", 1, 1, 5)], row)
    assert led.totals().count() == 0
    assert led.commit("b1", plus) and not led.commit("b1", plus) and led.commit("none", plus.limit(0))
    assert led.commit("b2", spark.createDataFrame([("s", None, "v", -1, 1, 5), ("s", "en", "v", -1, 1, 10), ("s", "en", "v", 1, 1, 12)], row))
    assert [tuple(r) for r in led.totals().collect()] == [("s", "en", "v", 2, 32)]
    other = token_counts.Ledger(spark, str(tmp_path / "b"))
    assert led.compact(other, "all") and [tuple(r) for r in other.totals().collect()] == [("s", "en", "v", 2, 32)]
    with pytest.raises(ValueError):
        led.commit("../x", plus)


# -- URLs -----------------------------------------------------------------------------------------------------------------


def test_rules_longest_wins(spark):
    urls = ["https://A.Example.ORG/en/1?x", "http://example.org/es/2", "https://b.org/", "https://b.org", "http://x.com/fr/1#t", "http://x.com/de/", "http://notorg/", "no scheme", None, "https://x.com?u=://y.org/", "http://example.orgy/es/"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["rule_verdict"]) for r in url_filter.with_rule(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}
    assert got == {
        0: ("a.example.org", "/en/1", "example.org/en/1", "block"), 1: ("example.org", "/es/2", "example.org/es/", "block"), 2: ("b.org", "/", "org/", "allow"), 3: ("b.org", "", None, None), 4: ("x.com", "/fr/1", "com/fr/", "allow"),
        5: ("x.com", "/de/", "com/de/", "block"), 6: ("notorg", "/", None, None), 7: ("", "", None, None), 8: ("", "", None, None), 9: ("x.com", "", None, None), 10: ("example.orgy", "/es/", None, None),
    }


def test_char_model_is_a_distribution():
    rows = Counter()
    for s in ("abcab", "abd", "bca"):
        s = url_filter.START + s
        for i in range(1, len(s)):
            for k in range(min(url_filter.MAX_ORDER, i) + 1):
                rows[s[i - k : i], s[i]] += 1
    m = url_filter.CharModel([(c, x, n) for (c, x), n in rows.items()])
    for context in ("", "a", "ab", "zz", url_filter.START):
        seen = sum(m.probability(context, c) for c in "abcd")
        assert math.isclose(seen + (url_filter.ALPHABET - 4) * m.probability(context, "~"), 1)
    assert m.log_likelihood("abc") > m.log_likelihood("cba")


def test_url_verdicts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, "nothing")], pages.schema)
    out = url_filter.url_verdicts(pages.unionByName(odd)).toPandas()
    assert len(out) == pages.count() + 2 and set(out["verdict"]) <= {"allow", "block"} and (out[out.page_id < 0].verdict == "block").all()
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0
    net = spark.createDataFrame([(1, "http://a.net/x")], pages.schema)
    assert url_filter.url_verdicts(net).first()["verdict"] == "allow"


def brute_verdicts(pages):
    """(page_id, host, path, rule, verdict) of every page by plain loops over the definitions."""
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    parts = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = "" if rest is None else re.split("[/?#]", rest)[0]
        path = "" if rest is None else re.split("[?#]", rest[len(host) :])[0]
        host = lower(host)
        fit = [(len(h + p), h + p, k) for k, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parts.append((i, host, path, *(max(fit)[1:] if fit else (None, None))))
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 5 == 0
    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    for i, host, path, _, kind in parts:
        if kind and not held(i):
            s = "\x02" + host + path
            for j in range(1, len(s)):
                for k in range(min(5, j) + 1):
                    counts[kind][s[j - k : j]][s[j]] += 1

    def p(kind, context, char):
        shorter = p(kind, context[1:], char) if context else 1 / 256
        own = counts[kind].get(context)
        return shorter if not own else (own[char] + len(own) * shorter) / (sum(own.values()) + len(own))

    def ratio(t):
        s = "\x02" + t
        return sum(math.log(p("allow", s[max(0, j - 5) : j], s[j])) - math.log(p("block", s[max(0, j - 5) : j], s[j])) for j in range(1, len(s))) / max(len(t), 1)

    good, bad = [[0] * 400 for _ in range(2)]
    for i, host, path, _, kind in parts:
        if kind and held(i):
            (good if kind == "allow" else bad)[min(399, max(0, math.floor((ratio(host + path) + 8) * 25)))] += 1
    errors = [sum(good[:c]) / sum(good) + 1 - sum(bad[:c]) / sum(bad) for c in range(401)]
    best = [c for c in range(401) if errors[c] <= min(errors) + 1e-12]
    threshold = best[len(best) // 2] / 25 - 8
    return [(i, h, q, r, k or ("allow" if h + q and ratio(h + q) >= threshold else "block")) for i, h, q, r, k in parts]


def test_url_verdicts_against_brute_force(spark):
    """Ruled and other URLs, repeated rows, clashing columns, a very long URL, nulls; every context has its count."""
    rng = np.random.default_rng(12)
    words = ["news", "shop", "blog", "win", "cheap", "wiki", "page", "item", "a", "zz"]
    urls = []
    for i in range(260):
        path = "/" + "/".join(rng.choice(words, rng.integers(0, 4)))
        host = f"{rng.choice(words)}.{rng.choice(['org', 'com', 'net', 'example.org', 'de'])}"
        urls.append((i, f"http://{host}/{rng.choice(['fr', 'de', 'es', 'en'])}{path}"))
    urls += [(7, urls[7][1]), (500, None), (501, "nothing"), (502, "http://long.net/" + "shop/" * 2000), (None, "ftp://blog.net/page")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({"kind": F.lit(3), "host": F.lit("x"), "ratio": F.lit(1.0)})
    want = Counter(brute_verdicts(urls))
    for most in (150_000, 60):
        got = Counter(tuple(r) for r in url_filter.url_verdicts(pages, max_contexts=most).select("page_id", "host", "path", "rule", "verdict").collect())
        assert got == want
    assert {v for _, _, _, r, v in want if r is None} == {"allow", "block"}


def test_models_tell_held_out_urls(spark):
    """On labelled URLs of the calibration fold, the ratio agrees with the rules nearly always."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    df = url_filter.with_rule(pages.select("page_id", "url")).where("rule is not null").withColumn("s", F.concat("host", "path")).withColumn("kind", F.col("rule_verdict"))
    held = common.fold_of("page_id", url_filter.FOLDS) == 0
    models = url_filter.train(df.where(~held), 150_000)
    out = url_filter.ratio(df.where(held).select("kind", "s"), models)
    t = url_filter.calibrate(out)
    d = out.toPandas()
    assert ((d["ratio"] >= t) == (d["kind"] == "allow")).mean() > 0.95


def test_no_context_is_dropped(spark, monkeypatch):
    """Ratios with 40 contexts at hand are those with all; one kind is rare, so its contexts are not the heaviest."""
    monkeypatch.setattr(url_filter, "CHUNK", 500)
    rng = np.random.default_rng(12)
    urls = [("block" if i % 20 == 0 else "allow", f"{'bad' if i % 20 == 0 else 'fine'}{rng.integers(9)}.org/{rng.integers(100_000)}") for i in range(400)]
    df = spark.createDataFrame(urls, "kind string, s string").repartition(3)
    probe = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(urls)] + [(1000, ""), (1001, "zz.net/9"), (1001, "zz.net/9")], "page_id long, s string").repartition(4)
    few, every = ({(r["page_id"], r["s"], round(r["ratio"], 9)) for r in url_filter.ratio(probe, url_filter.train(df, n)).collect()} for n in (40, 150_000))
    assert few == every and len(every) == 402
    assert url_filter.ratio(probe, url_filter.train(df, 40)).count() == 403


# -- mixing ---------------------------------------------------------------------------------------------------------------


def test_mixing_targets_and_fixed_size(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), None, None if i % 11 == 0 else f"s{min(i % 7, 4)}", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.taken_words(docs).toPandas()
    again = mixing.taken_words(docs.repartition(5)).toPandas()
    key = ["doc_id", "copies"]
    assert out[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()
    by = out.groupby(out["source"].fillna("~")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weights = dict(zip(sorted(by.index), [5, 2, 1, 5, 2, 1], strict=False))
    left, want = set(by.index), {}
    total = by["size"].sum()
    while left:
        w = sum(weights[s] for s in left)
        share = {s: weights[s] * (total - sum(want.values())) / w for s in left}
        over = {s for s in left if share[s] > 3 * by.loc[s, "size"]}
        if not over:
            want |= share
            break
        want |= {s: 3 * by.loc[s, "size"] for s in over}
        left -= over
    for s, r in by.iterrows():
        assert math.isclose(r["target"], want[s]) and abs(r["taken"] - r["target"]) <= 60
    assert (out["taken"] <= 3 * out["size"]).all() and (out["copies"] <= 3).all()
    assert math.isclose(sum(want.values()), total)


def brute_mix(rows, rest_of):
    """(doc_id, size, drawn) of one source without whole copies, by sorting it as a whole; also the order by U alone."""
    sized = [(d, len((t or "").split()), (int(hashlib.md5(f"mix:{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12) for d, t in rows]
    words, n = sum(s for _, s, _ in sized), sum(s > 0 for _, s, _ in sized)
    rest = rest_of(words)
    odds = rest / (words - rest) / (words / n)

    def draw(order):
        out, before = [], 0
        for d, s, _ in sorted((x for x in sized if x[1]), key=order):
            out.append((d, s, before + s / 2 <= rest))
            before += s
        return Counter(out)

    return draw(lambda x: (x[2] / (1 - x[2])) / (odds * x[1])), draw(lambda x: x[2])


def test_mixing_ranks_by_random_odds_over_inclusion_odds(spark):
    rng = np.random.default_rng(4)
    size = rng.integers(1, 400, 500)
    small = [(i, " ".join(["a"] * int(n)), None, "a", 0) for i, n in enumerate(size)]
    # b holds far more words than its weight gives it, so a is held to its cap and b is sampled
    big = [(1000 + i, " ".join(["b"] * int(n)), None, "b", 0) for i, n in enumerate(rng.integers(1, 400, 4000))]
    out = mixing.taken_words(spark.createDataFrame(small + big, DOCS)).toPandas()
    assert (out[out["source"] == "a"]["copies"] == 3).all()
    b = out[out["source"] == "b"]
    pareto, plain = brute_mix([(r[0], r[1]) for r in big], lambda words: b["target"].iloc[0])
    assert Counter((d, s, c == 1) for d, s, c in zip(b["doc_id"], b["size"], b["copies"])) == pareto != plain
    assert abs(b["taken"].sum() - b["target"].iloc[0]) <= 200
    drawn = b[b["copies"] == 1]["size"]
    assert drawn.mean() > b["size"].mean() * 1.02  # longer documents are likelier


def test_mixing_takes_some_of_many_repeated_rows(spark):
    rows = [(None, "a b c", None, "hot", 0)] * 3000 + [(i, "w " * (1 + i % 5), None, "cold", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    out = mixing.taken_words(docs).toPandas()
    hot = out[out["source"] == "hot"]
    assert abs(hot["taken"].sum() - hot["target"].iloc[0]) <= 3 and 0 < (hot["copies"] == 1).sum() < 3000
    one = mixing.taken_words(docs.where("source = 'hot'")).toPandas()  # a single source: its target is its size
    assert (one["taken"] == one["size"]).all()


def test_mixing_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, None, "a", 0)] + [(i, "w w", None, "b", 0) for i in range(2, 40)], DOCS)
    out = mixing.taken_words(docs).toPandas().set_index("doc_id")
    assert out.loc[1, "size"] == 300_000 and (out["taken"] <= 3 * out["size"]).all()


def test_mixing_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", None, 0), (2, "a b", "en", "x", 3), (2, "a b", "en", "x", 3)], DOCS).withColumn("size", F.lit("mine"))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("doc_id = 2").count() == 2
    assert mixing.mixed(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, "", "en", "x", 0)], DOCS)
    assert mixing.taken_words(alone).first()["taken"] == 0


# -- search ---------------------------------------------------------------------------------------------------------------


def brute(vectors, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(b) == len(a))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("tile_bytes", [32 << 20, 300])
def test_topk_against_brute_force(spark, tile_bytes):
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(400)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, [1.0, 2.0]), (None, [0.0] * 6), (7, rows[7][1]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, tile_bytes=tile_bytes, fan_in=3).collect()}
    assert got == brute(single, 5)


def test_topk_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_words_by_columns_are_those_of_the_texts():
    texts = ["", " \n ", "  A b\x0bc \t", "É é\u00a0x\u2003y Zz", "one", "a\x1cb\x00 C\r\n\n\x0cd "]
    words, size = hmm.split_words(pa.array(["left out", *texts], pa.string()).slice(1))
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in hmm.words_of(t)]
    assert size.tolist() == [len(hmm.words_of(t)) for t in texts]
    assert hmm.tail_classes(words, 64).tolist() == [hmm.tail_class(w.encode(), 64) for w in words.to_pylist()]


def test_sums_of_a_pass_are_shuffled_by_parts():
    one = [np.arange(6.0), np.ones(4), np.full(6, 0.5)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 0], pa.int32()), pa.array([x.tobytes() for x in one], pa.binary())], names=["part", "sums"])
    got = {p: np.frombuffer(b).tolist() for out in hmm.added(iter([batch, batch])) for p, b in zip(*(out.column(c).to_pylist() for c in ("part", "sums")), strict=True)}
    assert got == {0: (2 * (one[0] + one[2])).tolist(), 1: [2.0] * 4}


def test_forward_rows_of_tiny_odds_do_not_vanish():
    model = small_model(3, 4, 7)
    model.emit[1] = 1e-90
    flat = np.array([1] * 50 + [0, 1])
    got = hmm.forward(model, flat, np.array([0, 50, 52]), np.array([50, 2, 0]))
    assert abs(got[0] + 90 * 50) < 1e-6 and -100 < got[1] < -90 and got[2] == 0
