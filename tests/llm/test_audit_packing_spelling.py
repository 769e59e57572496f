"""Operators 11 to 13 against brute force, with odd rows, small blocks and dealt groups."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterloom.llm import packing, source_audit, spelling

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank string, word string, n string"
JSON = P.path("byte_bpe_50k.json")


def odd_rows():
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "Alpha beta ALPHA", "en", "a"), (3, "Alpha beta ALPHA", "en", "a"), (None, "alpha beta", "en", "b"),
        (4, "alpha É é gamma-beta beta2beta", "en", "b"), (5, "nothing shared", "de", "a"), (6, "!!! 123", "de", "z"), (7, "Alpha", "", ""), (8, "ALPHA", None, ""), (9, "alpha", "", None),
        (10, " ".join(["alpha", "beta", "delta"] * 4000), "en", "c"), (11, "x" * 70000 + " beta", "en", "c"), (12, "delta delta", "en", "a"), (13, "delta", "en", "b"),
    ]
    return [(*r, "v", "r", "w", "n") for r in rows]


# -- 11 ---------------------------------------------------------------------------------------------------------------


def terms_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text).split(" ")


def brute_divergence(rows, least=3, top=200):
    docs = [(r[2] or "", r[3] or "", Counter(t for t in terms_of(r[1] or "") if t)) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in d[2])
        kept = [t for t, n in seen.items() if n >= least]
        by = defaultdict(Counter)
        for _, source, c in own:
            by[source].update({t: c[t] for t in kept if c[t]})
        whole = sum(by.values(), Counter())

        def p_of(c, v=len(kept), kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + v) for t in kept}

        p, q = {s: p_of(c) for s, c in by.items()}, p_of(whole)
        for s in by:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in by if o != s]
            tops = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", tops)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def divergence(spark, rows, **kw):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, source_audit.source_divergence(docs, **kw).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_of_odd_rows(spark, monkeypatch):
    rows = odd_rows()
    assert divergence(spark, rows) == brute_divergence(rows)
    assert divergence(spark, rows, top=1) == brute_divergence(rows, top=1)
    assert divergence(spark, rows, least=1) == brute_divergence(rows, least=1)
    assert divergence(spark, []) == []


def test_divergence_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = source_audit.source_divergence(docs, top=20).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, top=20)


def test_blocks_and_slices_change_nothing(monkeypatch):
    texts = [("en", "a", "one two two Three"), ("en", "b", "two three"), ("de", "a", "two " * 50), ("en", "a", ""), ("en", "a", "one " * 30 + "two")]

    def total(block, size):
        monkeypatch.setattr(source_audit, "SLICE", size)
        out = Counter()
        held = source_audit.Block()
        for i, t in enumerate(texts):
            held.add(*t)
            if i % block == block - 1 or i == len(texts) - 1:
                for b in held.runs():
                    for lang, term, source, d, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                        out[lang, term, source, "d"] += d
                        out[lang, term, source, "n"] += n
                held = source_audit.Block()
        return out

    assert total(1, 7) == total(5, 1 << 20) == total(2, 3)


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    whole = rng.integers(1, 9 * 10**15, 500)
    count = (whole * rng.random(500)).astype(np.int64)
    assert source_audit.share(count, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole, strict=True)]


def test_streamed_runs_meet_across_batches():
    import pyarrow as pa

    rows = [("en", t, s, d, d + 1) for t in "abcdef" for s in ("x", "y", "y", "z") for d in (1, 1)]
    want = None
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], names=source_audit.RUN) for i in range(0, len(rows), size)]
        got = [r for b in source_audit._sources_of_terms(3)(iter(batches)) for r in b.to_pylist()]
        want = want or got
        assert got == want and len(got) == 6 and got[0]["sources"] == ["x", "y", "z"] and got[0]["counts"] == [4, 8, 4]


# -- 12 ---------------------------------------------------------------------------------------------------------------


TOKENIZER = Tokenizer.from_file(JSON)
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return [*TOKENIZER.encode(text, add_special_tokens=False).ids, 0]


def check_packing(pieces, docs, capacity=1024):
    """Every id in one piece, gapless sequences, no padding; docs is a list of (id, text)."""
    want = Counter((d, tuple(ids_of(t or ""))) for d, t in docs)
    by_seq, whole, ready = defaultdict(list), defaultdict(list), Counter()
    for r in pieces:
        by_seq[r["sequence_id"]].append(r)
        whole[r["doc_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0
    for d, rows in whole.items():
        rows = sorted(rows, key=lambda r: (r["doc_tokens"], r["start"]))
        n = sum(k for (x, _), k in want.items() if x == d)
        if n == 1:
            ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist()
            assert len(ids) == rows[0]["doc_tokens"]
            ready[d, tuple(ids)] += 1
        else:  # equal ids: all pieces, in any order
            assert sum(r["length"] for r in rows) == sum(len(i) * k for (x, i), k in want.items() if x == d)
            ready.update({k: v for k, v in want.items() if k[0] == d})
    assert ready == want


def test_packing_of_odd_rows(spark):
    rows = [*odd_rows(), (20, "<|endoftext|> it's\n\n  été 漢字 \t", None, None, None, None, None, None)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), JSON).collect()
    check_packing(pieces, [(r[0], r[1]) for r in rows])
    assert packing.pack(spark.createDataFrame([], SCHEMA), JSON).count() == 0


def test_packing_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(docs.repartition(4), JSON)
    check_packing(pieces.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    whole = packing.sequences(pieces)
    assert whole.where("length(ids) <> 4 * length or padded <> length").count() == 0


def test_small_capacity_and_other_key(spark):
    docs = spark.createDataFrame([("a", "one two three four five six seven"), ("b", "eight"), ("c", None)], "name string, text string")
    rows = packing.pack(docs, JSON, capacity=4, end_id=7, key="name").collect()
    assert max(r["offset"] + r["length"] for r in rows) <= 4 and {r["name"] for r in rows} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        packing.pack(docs, JSON, capacity=1000, key="name")


def test_parts_have_the_ids_of_the_whole(monkeypatch):
    text = "Words, words'll go on  and on\n\nhere; 12 34 été été _x_ y  z " * 40 + "x" * 300 + " end of it"
    monkeypatch.setattr(packing, "PART", 50)
    cut = packing.parts(text)
    assert len(cut) > 20 and "".join(cut) == text
    assert [i for p in cut for i in ids_of(p)[:-1]] == ids_of(text)[:-1]


def test_pieces_have_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 3)
    encode = packing.encoder.__wrapped__(JSON)
    # a character of each class and plane, unassigned ones too, in places where the pattern could split
    every = [chr(c) for c in range(0, 0x33500, 61) if not 0xD800 <= c < 0xE000] + ["\u0558", "\U00018d10", "\x1c", "\x85", "\u200b", "\u00a0"]
    for text in ["".join(map(chr, range(256))), "".join(a + b + " " for a in map(chr, range(256)) for b in "a1 !\n"), "", " ", "it's  a\n\n test ", "z" * 500, *(f"a{c}b 1{c}2 {c}{c} !{c}?{c}" for c in every)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(text)[:-1], ascii(text)


@given(st.integers(0, 10_000), st.sampled_from([2, 8, 1024]))
def test_cuts_fill(n, capacity):
    got = packing.cuts(n, capacity)
    assert sum(got) == n and all(capacity % x == 0 for x in got) and len(set(got) - {capacity}) == len([x for x in got if x < capacity])


# -- 13 ---------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_variants(rows, least=5, ratio=5):
    counts = Counter()
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in lower).split(" "):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if run and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least}
    form, near = {}, {}
    for w, n in words.items():
        found = [v for v in words if one_edit(w, v)]
        near[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def variants(docs, **kw):
    return sorted(map(tuple, spelling.spelling_variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def spelled():
    rows = [(i, " ".join(["Colour"] * 40 + ["colours"] * 300 + ["color"] * 9 + ["colourx"] * 6 + ["colouur", "éclairé", "eclairé"] * 5)) for i in range(2)]
    rows += [(None, "colour " * 3), (None, None), (7, ""), (7, "COLOUR-colours2colours"), (7, "COLOUR-colours2colours"), (8, "ab" * 5000 + " "), (9, ("a" * 3000 + " ") * 6 + ("a" * 2999 + " ") * 5)]
    # chains: each form five times as frequent as the one before it
    rows += [(20 + k, f"{w} " * n) for k, (w, n) in enumerate([("chainx", 5), ("chaing", 25), ("chaings", 125), ("chaingst", 625)])]
    # many words of one half
    rows += [(40 + k, f"prefix{a}{b} " * 6) for k, (a, b) in enumerate(itertools.product("abcdef", repeat=2))]
    return [(d, t, "x", "y", "z", "r", "w", "n") for d, t in rows]


@pytest.mark.parametrize("group", [3, 20_000])
def test_variants_of_odd_rows(spark, group):
    rows = spelled()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_variants([(r[0], r[1]) for r in rows])
    assert variants(docs, group=group) == want
    assert any(w[0] == "chainx" and w[2] == "chaingst" for w in want)
    assert variants(docs.limit(0)) == []


def test_variants_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert variants(docs, group=50) == brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()])


WORDS = st.lists(st.text(alphabet="abé", min_size=6, max_size=9), min_size=1, max_size=40, unique=True)


@settings(max_examples=150, deadline=None)
@given(WORDS)
def test_automaton_numbers_and_neighbours(words):
    order = sorted(words)
    a = spelling.Automaton(order)
    assert [a.number(w) for w in order] == list(range(len(order)))
    assert a.number("zzzzzz") is None
    for w in words:
        for half in (3, len(w) // 2):
            assert a.near(w, half) == {i for i, v in enumerate(order) if v.startswith(w[:half]) and one_edit(w, v)}


def test_automaton_is_minimal():
    a = spelling.Automaton(sorted(x + y for x in ("abc", "abd", "xyz") for y in ("ing", "ed", "s")))
    # right languages: start, after "a", after "x", after "ab"; one each after "abc"/"abd"/"xyz", "xy"; then of i, in, e, end
    assert len(a.ends) == len({(e, tuple(sorted((c, t) for c, (t, _) in h.items()))) for e, h in zip(a.ends, a.hops, strict=True)})
