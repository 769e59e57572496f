"""Near-dedup and line dedup against brute force, and their defined cases."""

import random
from collections import defaultdict

import numpy as np
import pytest

from rasterloom.llm import buckets, common, line_dedup, near_dedup
from rasterloom.llm.common import dealt_join

WORDS = [f"w{i}" for i in range(900)]


def components_of(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return w


@pytest.fixture(scope="module")
def texts():
    """Groups of near copies of growing distance, exact copies, shared passages, short and empty texts."""
    rng = random.Random(1)
    out = []
    for size in (40, 120, 400):
        for _ in range(12):
            base = [rng.choice(WORDS) for _ in range(size)]
            out += [" ".join(edited(rng, base, k)) for k in (0, 0, 1, 2, size // 60, size // 40, size // 25)]
    passage = [rng.choice(WORDS) for _ in range(70)]
    out += [" ".join(passage + [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]) for _ in range(120)]
    out += ["one two three", "ONE two three", "one two", "", "  \n", "a"]
    return out


def test_near_classes_against_brute_force(spark, texts):
    docs = near_dedup.numbered(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in near_dedup.near_classes(docs).collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.similar(texts[i], texts[j])]
    root = components_of(len(texts), links)
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    assert {i: r["class_id"] for i, r in got.items()} == {i: first[r] for i, r in enumerate(root)}
    assert all(r["kept"] == (r["class_id"] == i) for i, r in got.items())
    assert any(a != b for a, b in links)


def test_short_near_copies_share_a_bucket():
    """Texts of 6 to 20 words and the same with words added at either end, at a similarity of 0.8 or more."""
    rng = random.Random(6)
    pairs, met = 0, 0
    for _ in range(3000):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(6, 21))]
        more = [rng.choice(WORDS) for _ in range(rng.randrange(1, 4))]
        other = base + more if rng.random() < 0.5 else more + base
        if near_dedup.similar(" ".join(base), " ".join(other)):
            a, b = (near_dedup.element_keys(near_dedup.words_of(" ".join(w))) for w in (base, other))
            pairs += 1
            met += bool(set(a.tolist()) & set(b.tolist()))
    assert pairs > 500 and met >= 0.998 * pairs


def test_short_near_classes_against_brute_force(spark):
    """Eight words and the same with one more: 4 against 5 k-mers, a similarity of 0.8 exactly."""
    rng = random.Random(7)
    texts = []
    for _ in range(300):
        base = [rng.choice(WORDS) for _ in range(8)]
        texts += [" ".join(base), " ".join([*base, rng.choice(WORDS)])]
    docs = near_dedup.numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert all(near_dedup.similar(texts[i], texts[i + 1]) for i in range(0, 600, 2))
    assert got == {i: i - i % 2 for i in range(600)}


def alignment(a, b):
    """The longest common subsequence by the full table."""
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


def changed(rng, words, share):
    """Words replaced, dropped or added at random places."""
    out = []
    for w in words:
        if rng.random() >= share:
            out.append(w)
        elif (kind := rng.randrange(3)) != 1:
            out += [rng.choice(WORDS)] if kind == 0 else [w, rng.choice(WORDS)]
    return out


def test_alignment_is_exact(monkeypatch):
    """In one block and in blocks of few words, with and without a band."""
    rng = random.Random(2)
    for width in (16_384, 7, 1):
        monkeypatch.setattr(near_dedup, "WIDTH", width)
        for _ in range(150):
            a = [rng.randrange(12) for _ in range(rng.randrange(0, 40))]
            b = [rng.randrange(12) for _ in range(rng.randrange(0, 40))]
            whole = alignment(a, b)
            assert near_dedup.common_words(a, b) == whole
            ahead, behind = len(a) - whole, len(b) - whole  # the shift that an alignment of this length can have
            assert near_dedup.common_words(a, b, ahead, behind) == whole
            assert near_dedup.common_words(a, b, 2, 2) <= whole


def test_verification_is_the_full_alignment(monkeypatch):
    """Two texts are linked if and only if they align at 0.8 by the full table."""
    rng = random.Random(8)
    linked = 0
    for trial in range(300):
        monkeypatch.setattr(near_dedup, "WIDTH", 16_384 if trial % 2 else 16)
        a = [rng.choice(WORDS[: rng.choice([5, 900])]) for _ in range(rng.randrange(1, 120))]
        b = changed(rng, a, rng.choice([0.02, 0.05, 0.1, 0.2]))
        if rng.random() < 0.3:  # a block moved
            b = b[len(b) // 6 :] + b[: len(b) // 6]
        both = alignment(a, b)
        near = a == b or both >= 0.8 * (len(a) + len(b) - both) - 1e-9
        assert near_dedup.similar(" ".join(a), " ".join(b)) == near_dedup.similar(" ".join(b), " ".join(a)) == near
        linked += near
    assert 100 < linked < 280


@pytest.mark.parametrize("size", [20, 40, 100, 300, 1000])
@pytest.mark.parametrize("share", [0.03, 0.05, 0.07, 0.1])
def test_recall_of_pairs_that_align(size, share):
    """Of the pairs that align at 0.8 by the full alignment, nine in ten and more meet and are linked."""
    rng = random.Random(12)
    near = met = 0
    while near < 150:
        a = [rng.choice(WORDS) for _ in range(size)]
        b = changed(rng, a, share)
        both = alignment(a, b) if size <= 100 and near < 40 else near_dedup.common_words(a, b)  # equal by the test above
        if both < 0.8 * (len(a) + len(b) - both):
            continue
        near += 1
        x, y = (set(near_dedup.element_keys(near_dedup.words_of(" ".join(w))).tolist()) for w in (a, b))
        met += bool(x & y) and near_dedup.similar(" ".join(a), " ".join(b))
    assert met >= 0.9 * near


def test_shared_parts_are_counted(monkeypatch):
    rng = np.random.default_rng(13)
    parts = [np.unique(rng.integers(0, 10**12 if i % 2 else 300, 200)) for i in range(30)] + [np.zeros(0, np.int64)]
    pairs = [(i, np.arange(i + 1, 31)) for i in range(31)]
    for bits in (1 << 20, 64):
        monkeypatch.setattr(buckets, "BITS", bits)
        for (i, others), n in zip(pairs, buckets.shared_parts(parts, pairs), strict=True):
            assert n.tolist() == [len(np.intersect1d(parts[i], parts[j])) for j in others]


@pytest.mark.parametrize("share, least", [(0.01, 0.99), (0.02, 0.99), (0.03, 0.98), (0.05, 0.93)])
def test_recall_of_planted_near_copies(share, least):
    """Texts of 60 to 600 words and copies with that share of their words changed: candidates and links alike."""
    rng = random.Random(9)
    met = 0
    for _ in range(200):
        a = [rng.choice(WORDS) for _ in range(rng.randrange(60, 600))]
        b = changed(rng, a, share)
        x, y = (set(near_dedup.element_keys(near_dedup.words_of(" ".join(w))).tolist()) for w in (a, b))
        met += bool(x & y) and near_dedup.similar(" ".join(a), " ".join(b))
    assert met >= least * 200


def test_half_rewritten_texts_are_left_alone():
    rng = random.Random(10)
    for _ in range(50):
        a = [rng.choice(WORDS) for _ in range(200)]
        b = a[:140] + [rng.choice(WORDS) for _ in range(60)]
        assert not near_dedup.similar(" ".join(a), " ".join(b))


def test_very_long_near_copies():
    rng = random.Random(11)
    a = [rng.choice(WORDS) for _ in range(60_000)]
    assert near_dedup.similar(" ".join(a), " ".join(changed(rng, a, 0.02)))
    assert near_dedup.similar(" ".join(a), " ".join(a[:30_000] + [rng.choice(WORDS) for _ in range(5000)] + a[30_000:]))
    assert not near_dedup.similar(" ".join(a), " ".join(a[:45_000] + [rng.choice(WORDS) for _ in range(15_000)]))


def test_keys_of_very_many_rows_are_dealt(spark):
    rows = spark.createDataFrame([(1, i) for i in range(2000)] + [(k, k) for k in range(2, 50)], "key long, i long")
    side = spark.createDataFrame([(1, "hot", 2000)] + [(k, f"c{k}", 1) for k in range(2, 49)], "key long, name string, n long")
    assert dealt_join(rows, side, "key", "i").count() == 2047
    left = dealt_join(rows, side, "key", "i", "left")
    assert left.columns == ["key", "i", "name"] and left.count() == 2048 and left.where("name is null").count() == 1
    assert dealt_join(rows, side, "key", "i", "left_semi").count() == 2047


def test_near_dedup_defined_cases(spark):
    rows = [(None, "a b c d e f", 9), (5, "A b  c d e f", 8), (5, "A b  c d e f", 8), (7, None, 7), (8, "", 6), (9, "x y z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted((r["doc_id"], r["row"]) for r in kept.collect()) == [(5, 8), (7, 7), (9, 5)]
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_large_bucket_of_unlike_items_is_settled(spark):
    """Three hundred items in one bucket, alike only to their neighbours: one class, though the star links few."""
    n = 300
    found = spark.createDataFrame([(1, 0, i) for i in range(1, n)], "bh long, lead long, id long")
    payload = spark.createDataFrame([(i, str(i)) for i in range(n)], "id long, text string")
    like = buckets.Likeness(lambda t, names: (int(t), frozenset()), lambda a, b: abs(a[0] - b[0]) <= 1, lambda n, m: 0 * m)
    roots = {r["id"]: r["root"] for r in buckets.classes(found, payload, like).collect()}
    assert set(roots) == set(range(n)) and len(set(roots.values())) == 1


def test_large_class_meets_only_the_others(spark, monkeypatch):
    """Hundreds of items of one class and some others in two open buckets, in small blocks: the classes are those of all links."""
    monkeypatch.setattr(buckets, "BLOCK", 7)
    n = 260
    rows = [(h, 0, i) for h in (1, 2) for i in range(1, n)]
    found = spark.createDataFrame(rows, "bh long, lead long, id long")
    payload = spark.createDataFrame([(i, str(i)) for i in range(n)], "id long, text string")

    def alike(a, b):  # most are like 0; 200 to 229 form a class of their own, 230 and 231 belong to 5, the others to none
        a, b = sorted((a[0], b[0]))
        return b < 200 or (200 <= a and b < 230) or (a, b) in ((5, 230), (229, 240), (230, 231))

    like = buckets.Likeness(lambda t, names: (int(t), frozenset()), alike, lambda n, m: 0 * m)
    roots = {r["id"]: r["root"] for r in buckets.classes(found, payload, like).collect()}
    want = {i: 0 for i in (*range(200), 230, 231)} | {i: 200 for i in (*range(200, 230), 240)}
    assert roots == want


def test_long_texts_of_one_bucket_are_cut_by_bytes(spark, monkeypatch):
    """Long unlike texts with one passage in common, and near copies among them, in blocks of few bytes."""
    monkeypatch.setattr(buckets, "BLOCK_BYTES", 200_000)
    rng = random.Random(14)
    rows = [[rng.choice(WORDS) for _ in range(rng.choice([400, 9000]))] for _ in range(40)]
    rows += [changed(rng, rows[i], 0.05) for i in range(0, 40, 4)]
    payload = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "id long, text string")
    found = spark.createDataFrame([(1, 0, i) for i in range(1, 50)], "bh long, lead long, id long")
    roots = {r["id"]: r["root"] for r in buckets.classes(found, payload, near_dedup.LIKENESS).collect()}
    assert {i: r for i, r in roots.items() if r != i} == {40 + i: 4 * i for i in range(10)}


def test_components_by_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)]
    df = spark.createDataFrame(edges, "a long, b long")
    monkeypatch.setattr(buckets, "LOCAL_EDGES", 20)
    got = {r["id"]: r["root"] for r in buckets.components(df).collect()}
    root = components_of(400, edges)
    groups = defaultdict(set)
    for a, b in edges:
        if a != b:
            groups[root[a]] |= {a, b}
    assert got == {i: min(g) for g in groups.values() for i in g}


def test_chunk_and_stream_stars_link_every_bucket(spark):
    rng = np.random.default_rng(4)
    rows = []
    for chunk in range(4):
        ids = np.unique(rng.integers(0, 60, 30)).astype(np.int64)
        keys = rng.integers(0, 12, (len(ids), 3)).astype(np.int64) + np.array([0, 100, 200])
        keys = (ids[:, None] % 12) + np.array([0, 100, 200]) if chunk % 2 else keys
        bands, links = buckets.chunk_stars(ids, keys.reshape(-1), np.full(len(ids), 3))
        rows += [(int(i), b, [(x["bh"], x["lead"]) for x in k], k2.tolist()) for i, b, k, k2 in zip(ids, bands.to_pylist(), links.to_pylist(), keys, strict=True)]
    sketches = spark.createDataFrame([r[:3] for r in rows], f"id long, {buckets.SKETCH}")
    found = buckets.members(sketches).collect()
    by = defaultdict(set)
    for i, _, _, keys in rows:
        for k in keys:
            by[k].add(i)
    links = defaultdict(list)
    for r in found:
        links[r["bh"]].append((r["lead"], r["id"]))
    for k, ids in by.items():
        root = components_of(60, links[k])
        assert len({root[i] for i in ids}) == 1
        assert len(links[k]) <= 4 * len(ids)


@pytest.fixture(scope="module")
def paged():
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 40))) for _ in range(60)]
    docs = []
    for i in range(150):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base)
            if rng.random() < 0.3:
                words = line.split()
                words[rng.randrange(len(words))] = rng.choice(WORDS)
                line = " ".join(words)
            lines.append(line.upper() if rng.random() < 0.1 else line)
        docs.append((i, "\n".join([*lines, "", "ok"])))
    return docs


def test_lines_against_brute_force(spark, paged):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(paged, "doc_id long, text string")).collect()}
    first = {}
    for i, t in paged:
        for line in t.split("\n"):
            if n := line_dedup.normal(line):
                first.setdefault(n, len(first))
    lines = list(first)
    links = [(a, b) for a in range(len(lines)) for b in range(a) if line_dedup.similar(lines[a], lines[b])]
    root = components_of(len(lines), links)
    seen, want = set(), {}
    for i, t in paged:
        kept = []
        for line in t.split("\n"):
            n = line_dedup.normal(line)
            if n and root[first[n]] in seen:
                continue
            if n:
                seen.add(root[first[n]])
            kept.append(line)
        want[i] = "\n".join(kept)
    assert got == want and links


def test_line_dedup_defined_cases(spark):
    rows = [(1, "Same line here", "x", 14), (2, " same  LINE here\nother", "y", 22), (2, " same  LINE here\nother", "z", 22), (None, "other", "w", 5), (3, None, "v", None), (4, "\n \n", "u", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lost string, n_chars long")
    out = line_dedup.dedup_lines(docs.withColumnRenamed("lost", "tag"))
    got = sorted(((r["doc_id"], r["text"], r["tag"], r["n_chars"], r["n_lines"], r["n_lost"]) for r in out.collect()), key=lambda r: r[2])
    assert got == [(4, "\n \n", "u", 3, 3, 0), (3, None, "v", None, 0, 0), (None, "", "w", 0, 1, 1), (1, "Same line here", "x", 14, 1, 0), (2, "other", "y", 5, 2, 1), (2, "", "z", 0, 2, 2)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    # columns of the names that the operator uses inside or makes
    assert line_dedup.dedup_lines(docs).select("lost").count() == 6
    clash = docs.withColumnRenamed("lost", "ROW").withColumnRenamed("n_chars", "n_lost")
    assert line_dedup.dedup_lines(clash).columns == ["doc_id", "text", "ROW", "n_lines", "n_lost"]
    assert line_dedup.dedup_lines(clash, counts=False).select(*clash.columns).count() == 6


def test_texts_are_not_shuffled_to_line_numbers(spark, paged):
    """Above the table that deals the texts, exchanges carry numbers alone, with broadcasts off as well."""
    docs = spark.createDataFrame(paged, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.dedup_lines(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "ShuffledHashJoin" in plan
    assert rows == sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))


def test_copies_without_ids_keep_one(spark):
    docs = spark.createDataFrame([(None, "one line\nanother line")] * 40 + [(7, "one line")], "doc_id long, text string").repartition(3)
    out = line_dedup.dedup_lines(docs).collect()
    assert sum(r["n_lines"] - r["n_lost"] for r in out) == 2
    assert [r["n_lost"] for r in out if r["doc_id"] == 7] == [0]


def test_minhash_of_long_lines_is_whole(spark):
    """The only difference stands at the end of a line of 60,000 characters."""
    base = " ".join(f"q{i}" for i in range(10_000))
    a, b = base, base + " tail"
    out = {r["doc_id"]: r["n_lost"] for r in line_dedup.dedup_lines(spark.createDataFrame([(1, a), (2, b), (3, base[:20_000])], "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 1, 3: 0}


def test_rows_of_other_keys_pass_one_join(spark):
    rows = spark.range(4000).selectExpr("IF(id < 2000, -5L, id) AS key", "id AS i")
    side = rows.groupBy("key").count().withColumnRenamed("count", "n")
    made = dealt_join(rows, side, "key", "i")
    assert made.count() == 4000
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # before, all rows went through a join with the hot keys first


def test_shingles_as_numbers_are_those_of_the_texts():
    plain = ["abcdefgh", "abcdefghi" * 3, "x" * 40, "é" + "abcdefgh" * 2, "0123456789abcdefgh"]
    for lines in (plain, [*plain, "一丁" * 9, "\U0001f600abcdefgh"], [*plain, "short", ""], [*plain, "".join(map(chr, range(0x400, 0x540)))], []):
        sets = line_dedup.shingle_sets(lines)
        assert [len(x) for x in sets] == [len(line_dedup.shingles(x)) for x in lines]
        for i, x in enumerate(lines):
            for j, y in enumerate(lines):
                assert len(np.intersect1d(sets[i], sets[j])) == len(line_dedup.shingles(x) & line_dedup.shingles(y))
                assert line_dedup.LIKENESS.met(sets[i], sets[j]) == line_dedup.similar(x, y)


def test_large_class_takes_its_outsiders_without_blocks(spark, monkeypatch):
    value = {i: 0 if i == 0 else 5 if i <= 250 else 14 for i in range(271)}  # the least item is unlike the last twenty
    found = common.settled(spark.createDataFrame([(7, 0, i) for i in range(1, 271)], "bh long, lead long, id long"), "t")
    payload = spark.createDataFrame([(i, str(v)) for i, v in value.items()], "id long, text string")
    like = buckets.Likeness(lambda t, names: (int(t), frozenset()), lambda a, b: abs(a[0] - b[0]) <= 10, lambda n, m: 0 * m)
    monkeypatch.setattr(buckets, "_tiles", lambda *_: pytest.fail("cut into blocks"))
    roots = {r["id"]: r["root"] for r in buckets.classes(found, payload, like).collect()}
    assert roots == dict.fromkeys(value, 0)


def test_texts_stay_in_their_buckets_at_any_size(spark, sf):
    plain = near_dedup.numbered(spark.read.parquet(f"{sf}/documents.parquet"))
    joined = plain.join(plain.select("row").limit(5).hint("shuffle_hash"), "row", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
