"""LM scoring: a hidden Markov language model trained by Baum-Welch, with exact forward likelihoods.

Tokens are ASCII-lower-cased words and one end for each text. Words are counted over all training texts. The
``head`` most frequent words (the end among them) are known to every task as one bounded dictionary, with a
row of the emission table each. Every other word of the training texts has its emissions too, as a row of a
distributed table of (word, state) that grows with the corpus and is joined with the texts; tasks and driver
hold sums of such words by class alone, a class being the words with equal hash of the last three bytes. A
word that the training texts lack has the emission of its class's one unknown word.

With E(w, j) the expected count of word w in state j, c its count, g the shares of its class's expected counts
by state: w's profile is p(j) = (E(w, j) + TAU g(j)) / (c + TAU), rounded to a byte, and a state that emits the class emits w in
it with (c + 0.5) p(j) / Z(j), the unknown word with 0.5 g(j) / Z(j), where Z sums these over the class. So all words and,
for each class, one unknown one make a distribution in each state, and every text has an exact probability.

Each Baum-Welch pass runs over all training tokens: every task sums expected counts by numpy over segments of
``SEGMENT`` tokens, Spark adds the tasks' sums by symbol, and the driver normalises a table of fixed size
(symbols x states). A segment's recursions also run over the ``OVERLAP`` tokens before and after it, whose counts belong to its neighbours,
so every token and every step of a text is counted once, with its context. Passes end when the training likelihood gains less than ``GAIN`` a
token, after ``max_passes`` at the latest. A class's words share one profile until the last pass, when posteriors need the class
alone; that pass sums expected counts by word as well. The starting point comes from a
mixture of unigrams fitted to a bounded sample (``SEED_SEGMENTS`` segments from anywhere in the training texts), which only breaks the symmetry. Scoring
runs the scaled forward recursion over whole texts, many side by side, each step for all texts still going.

Defined cases: a null text is empty: its only token is the end; with no training texts, N and V are 0, base
scores are 0 for each token and the model is uniform; repeated rows are trained on and scored each; a null
doc_id counts as the empty text in the fold's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hashed_sample, heaviest, settled, small_batches, text_or_empty, tidy, trim

FOLDS, HELD_OUT = 5, 1
#: The end of a text; no word holds a space.
END = b" "
SEGMENT, OVERLAP = 256, 16
#: Segments of SEED_TOKENS tokens that the first model is fitted to.
SEED_SEGMENTS, SEED_TOKENS = 8000, 128
#: Nats a token: passes that gain less are the last.
GAIN = 0.002
#: Tokens in memory at once in a task.
TOKENS = 300_000
#: Steps between two scalings of a text's forward row; a step's odds are far above the cube root of the least double.
SCALED = 3
#: Bytes of text whose words a task counts at once.
COUNTED = 24 << 20
#: Symbols of a part of a task's sums: a row of the shuffle.
PART = 4096
#: Weight of the overall distribution in a state's emissions, in tokens.
PRIOR = 500.0
#: Weight of its class's profile in a word's, in tokens.
TAU = 1.0
#: A word's expected counts are summed in whole parts of 1 / FINE, its profile is stored in parts of 1 / COARSE, at least one a state.
FINE, COARSE = 1 << 16, 127


def words_of(text: str) -> list[bytes]:
    """ASCII-lower-cased words: bytes.lower and bytes.split touch ASCII alone."""
    return text.encode("utf-8").lower().split()


def tail_class(word: bytes, classes: int) -> int:
    return crc32(word[-3:]) % classes


def tail_classes(words: pa.Array, classes: int) -> np.ndarray:
    """The same for a column of words without nulls."""
    tails = pc.binary_slice(words.cast(pa.binary()), -3).dictionary_encode()
    return np.array([tail_class(t, classes) for t in tails.dictionary.to_pylist()], dtype=np.int32)[tails.indices.to_numpy()]


def class_of(classes: int) -> Column:
    """The same for a column ``word``."""
    return (F.crc32(F.expr("substring(encode(word, 'UTF-8'), -3)")) % classes).cast("int")


@dataclass
class Lexicon:
    """What a task knows of the training counts: the head words, and the classes of the rest."""

    at: dict[bytes, int]
    counts: np.ndarray  # of head words, by rank
    symbols: int  # the number of head words; classes come after them
    classes: int
    class_words: np.ndarray  # n of each class
    class_kinds: np.ndarray  # v of each class
    total: int
    kinds: int

    @property
    def size(self) -> int:
        return self.symbols + self.classes

    def symbol_share(self) -> np.ndarray:
        n = np.concatenate([self.counts.astype(float), self.class_words]) + 0.5
        return n / n.sum()


@dataclass
class Hmm:
    start: np.ndarray  # (K,)
    step: np.ndarray  # (K, K)
    emit: np.ndarray  # (symbols, K)
    share: np.ndarray  # (K,) of states over all tokens


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` for a column without nulls: all words in a row, as strings, and how many each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words, edge = cut.flatten(), np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy())])
    some = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty strings
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), np.diff(before[edge])


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: over all texts of ``docs``; partial counts in the tasks, then one shuffle by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        texts = size = 0

        def flush():
            found = pa.chunked_array(held, pa.string()).value_counts()
            words = pa.concat_arrays([found.field("values"), pa.array([END.decode()], pa.string())])
            out = pa.RecordBatch.from_arrays([words, pa.concat_arrays([found.field("counts"), pa.array([texts], pa.int64())])], names=["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.column("text").slice(a, 1024)
                words, _ = split_words(part)
                held.append(words)
                texts += len(part)
                size += words.nbytes
                if size > COUNTED:
                    yield flush()
                    texts = size = 0
        if texts:
            yield flush()

    return small_batches(docs).select(text_or_empty().alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, *, head: int, classes: int) -> Lexicon:
    rows = heaviest(counts.where(F.col("word") != END.decode()), "c", head - 1).toPandas().sort_values(["c", "word"], ascending=[False, True])
    n_end = counts.where(F.col("word") == END.decode()).agg(F.sum("c")).first()[0] or 0
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    names = [END, *(w.encode() for w in rows["word"])]
    c = np.array([n_end, *rows["c"]], dtype=np.int64)
    # all words by class, the head's share taken off
    by = counts.where(F.col("word") != END.decode()).groupBy(class_of(classes).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    n, v = np.zeros(classes), np.zeros(classes)
    n[by["k"]], v[by["k"]] = by["n"], by["v"]
    for w, k in zip(names[1:], c[1:], strict=True):
        n[tail_class(w, classes)] -= k
        v[tail_class(w, classes)] -= 1
    return Lexicon({w: i for i, w in enumerate(names)}, c, len(names), classes, n, v, int(total["n"] or 0), int(total["v"]))


CODED = "key long, doc_id {0}, held_out boolean, n_tokens long, n_known long, known_log double, symbols array<int>, rare array<string>, at array<int>"
CODED_NAMES = ["key", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "symbols", "rare", "at"]


def code(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Each text as symbols (a head word's rank, or the number of head words plus a class), with its words beyond the head.

    rare holds each such word once, at the place in rare of every one of their occurrences. n_known and known_log, the sum of log10(c + 0.5),
    are those of head words.
    """
    head = pa.array([w.decode() for w in lex.at], pa.string())  # by rank
    shared = docs.sparkSession.sparkContext.broadcast((head, lex.counts, lex.classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts, classes = shared.value
        log_c = np.log10(counts + 0.5)
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                words, size = split_words(batch.column("text"))
                last = np.cumsum(size + 1) - 1  # the place of each text's end
                s = np.empty(len(words) + len(size), dtype=np.int32)
                inner = np.ones(len(s), dtype=bool)
                inner[last] = False
                s[inner] = pc.index_in(words, value_set=head).fill_null(-1).to_numpy()
                s[last] = 0
                text = np.repeat(np.arange(len(size)), size + 1)
                beyond = np.flatnonzero(s < 0)
                known = np.where(s >= 0, counts[s] > 0, False)
                logs = np.where(s >= 0, log_c[s], 0.0)
                coded = words.filter(pa.array(s[inner] < 0)).dictionary_encode()
                kinds, which = coded.dictionary, coded.indices.to_numpy()
                s[beyond] = len(head) + tail_classes(kinds, classes)[which]
                own, at = np.unique(text[beyond] * max(len(kinds), 1) + which, return_inverse=True)
                owner, kind = np.divmod(own, max(len(kinds), 1))
                edge = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])
                cols = [
                    pa.array(size + 1, pa.int64()), pa.array(np.bincount(text, known, len(size)).astype(np.int64)), pa.array(np.bincount(text, logs, len(size))),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]), pa.int32()), pa.array(s)),
                    pa.ListArray.from_arrays(pa.array(edge, pa.int32()), kinds.take(pa.array(kind))),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(beyond, np.concatenate([[0], last + 1])), pa.int32()), pa.array((at - edge[text[beyond]]).astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "doc_id", "held_out")] + cols, names=CODED_NAMES)

    rows = small_batches(docs).select(F.monotonically_increasing_id().alias("key"), "doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, CODED.format(dict(docs.dtypes)["doc_id"]))


# -- recursion ---------------------------------------------------------------------------------------


def forward(model: Hmm, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol sequence flat[start : start + size], by the scaled forward recursion."""
    order = np.argsort(-size, kind="stable")
    begin, size = start[order], size[order]
    ll = np.zeros(len(size))
    top = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(top + 1), side="left")  # of more than t symbols
    alpha = np.tile(model.start, (live[0], 1))
    for t in range(top):
        m, after = live[t], live[t + 1]
        if t:
            alpha = alpha[:m] @ model.step
        alpha *= model.emit.take(flat[begin[:m] + t], axis=0)
        if after < m:  # these end here
            ll[after:m] += np.log10(alpha[after:].sum(axis=1))
        if t % SCALED == SCALED - 1:
            scale = alpha[:after].sum(axis=1)
            alpha[:after] /= scale[:, None]
            ll[:after] += np.log10(scale)
    out = np.empty(len(size))
    out[order] = ll
    return out


def expected(model: Hmm, flat: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None, watch=None) -> tuple:
    """Expected counts (emissions (S, K), steps (K, K), starts (K,)) and the log-likelihood of segments.

    Only places lo..hi of a segment count, and the steps into them; the others are context. ``watch`` is shown the places in
    ``flat``, their symbols and their posteriors (none outside lo..hi).
    """
    lo = np.zeros_like(size) if lo is None else lo
    hi = size if hi is None else hi
    order = np.argsort(-size, kind="stable")
    begin, size, first, lo, hi = start[order], size[order], first[order], lo[order], hi[order]
    k = len(model.start)
    steps, starts, fit = np.zeros((k, k)), np.zeros(k), 0.0
    top = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(top), side="left")
    edge = np.concatenate([[0], np.cumsum(live)])
    places = np.concatenate([begin[:m] + t for t, m in enumerate(live)]) if top else np.zeros(0, np.int64)
    s = flat[places]
    own = np.concatenate([(lo[:m] <= t) & (t < hi[:m]) for t, m in enumerate(live)]) if top else np.zeros(0, bool)
    # by steps: forward rows, which become posteriors on the way back, and scaled emissions
    g, odds, scales = np.empty((len(s), k)), np.empty((len(s), k)), np.empty(len(s))
    alpha = np.where(first[:, None], model.start, model.share)
    for t in range(top):
        at = slice(edge[t], edge[t + 1])
        if t:
            alpha = alpha[: live[t]] @ model.step
        b, scale = model.emit.take(s[at], axis=0, out=odds[at], mode="clip"), scales[at]
        np.einsum("ij,ij->i", alpha, b, out=scale)
        b /= scale[:, None]
        alpha = np.multiply(alpha, b, out=g[at])
    fit += float(np.log(scales[own]).sum())
    beta = np.ones((live[-1] if top else 0, k))
    for t in range(top - 1, -1, -1):
        at = slice(edge[t], edge[t + 1])
        if live[t] > len(beta):
            beta = np.vstack([beta, np.ones((live[t] - len(beta), k))])
        g[at] *= beta
        if t:
            onward = np.multiply(odds[at], beta, out=odds[at])
            before, mine = g[edge[t - 1] : edge[t - 1] + live[t]], own[at]
            steps += before.T @ onward if mine.all() else before[mine].T @ onward[mine]
            beta = onward @ model.step.T
    if top:
        g[~own] = 0
        starts += g[: live[0]][first[: live[0]]].sum(axis=0)
        emits = np.stack([np.bincount(s, g[:, j], minlength=len(model.emit)) for j in range(k)], axis=1)
        if watch:
            watch(places, s, g)
    else:
        emits = np.zeros_like(model.emit)
    return emits, steps * model.step, starts, fit


def segments(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, size, first, lo, hi of the segments of sequences, with their overlaps."""
    parts = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    a, b = nth * SEGMENT, np.minimum((nth + 1) * SEGMENT, size[owner])
    left, right = np.maximum(a - OVERLAP, 0), np.minimum(b + OVERLAP, size[owner])
    return start[owner] + left, right - left, nth == 0, a - left, b - left


def lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and sizes of an Arrow list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1], np.diff(offsets)


def normalised(emits: np.ndarray, steps: np.ndarray, starts: np.ndarray, share: np.ndarray) -> Hmm:
    k = len(starts)
    occupied = emits.sum(axis=0)
    emit = (emits + PRIOR * share[:, None]) / (occupied + PRIOR)
    step = (steps + 1.0) / (steps + 1.0).sum(axis=1, keepdims=True)
    start = (starts + 1.0) / (starts + 1.0).sum()
    return Hmm(start, step, emit, (occupied + 1.0) / (occupied + 1.0).sum() if k else occupied)


def seeded(sample: list[np.ndarray], share: np.ndarray, states: int, rounds=25) -> Hmm:
    """A mixture of unigrams over segments of the sample, as the states' first emissions."""
    rng = np.random.default_rng(1)
    size = len(share)
    bags = [b for s in sample for b in np.array_split(s, max(1, len(s) // 64)) if len(b)]
    if not bags:
        return normalised(np.zeros((size, states)), np.zeros((states, states)), np.zeros(states), share)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    syms = np.concatenate(bags)
    # farthest-first seeds: each new state starts from the segment that the present states explain worst
    emit = np.repeat(share[:, None], states, axis=1)
    lengths = np.bincount(bag, minlength=len(bags))
    seen = np.bincount(bag, np.log(share[syms]), len(bags)) / lengths
    best = None
    for j in range(states):
        pick = int(rng.integers(len(bags))) if best is None else int(np.argmin(np.where(lengths >= 16, best - seen, np.inf)))
        own = np.bincount(syms[bag == pick], minlength=size).astype(float)
        emit[:, j] = (own + 30 * share) / (own.sum() + 30)
        fit = np.bincount(bag, np.log(emit[syms, j]), len(bags)) / lengths
        best = fit if best is None else np.maximum(best, fit)
    mix = np.full(states, 1 / states)
    for _ in range(rounds):
        ll = np.stack([np.bincount(bag, np.log(emit[syms, j]), len(bags)) for j in range(states)], axis=1) + np.log(mix)
        r = np.exp(ll - ll.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        own = np.stack([np.bincount(syms, r[bag, j], size) for j in range(states)], axis=1)
        emit = (own + PRIOR * share[:, None]) / (own.sum(axis=0) + PRIOR)
        mix = (r.sum(axis=0) + 1) / (len(bags) + states)
    step = 0.02 * np.tile(mix, (states, 1)) + 0.98 * np.eye(states)
    return Hmm(mix.copy(), step, emit, mix)


def places_of(rare, at) -> tuple[np.ndarray, int]:
    """For each occurrence of a word beyond the head in a batch, in order, its place among all texts' such words; and how many these are.

    ``rare`` is the sizes of the texts' lists, ``at`` the column of places within them.
    """
    values, _, size = lists(at)
    return values + np.repeat(np.cumsum(rare) - rare, size), int(rare.sum())


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, sums as bytes) to one row a part; a task holds its parts' sums alone."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums"), strict=True):
            own = np.frombuffer(sums.as_buffer())
            total[part] = total[part] + own if part in total else own.copy()
    for part, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"])


def baum_welch(coded: DataFrame, model: Hmm, share: np.ndarray, symbols: int | None = None) -> tuple[Hmm, float, np.ndarray, DataFrame | None]:
    """One pass over all training texts: the next model, the log-likelihood a token under the one given, and the expected counts.

    With ``symbols``, the number of head words, there is also the table of word, c, e0.. (in parts of 1 / FINE) of all words beyond the head.
    """
    k = len(model.start)
    shared = coded.sparkSession.sparkContext.broadcast(model)
    states = [f"e{j}" for j in range(k)]
    names = ["row", "word", "c", *states]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emits, steps, starts, fit = np.zeros_like(model.emit), np.zeros((k, k)), np.zeros(k), 0.0
        seen: list[tuple] = []

        def watch(places, syms, g):
            own = (syms >= symbols) & (g.sum(axis=1) > 0.5)
            seen.append((places[own], g[own]))

        for batch in batches:
            flat, at, size = lists(batch.column("symbols"))
            parts = segments(at, size)
            edge = np.cumsum(parts[1])
            for at_token in range(0, int(edge[-1]) if len(edge) else 0, TOKENS):
                own = slice(*np.searchsorted(edge, [at_token, at_token + TOKENS], side="right"))
                if at_token == 0:
                    own = slice(0, own.stop)
                e, s, p, f = expected(model, flat, *(x[own] for x in parts), watch=watch if symbols is not None else None)
                emits += e
                steps += s
                starts += p
                fit += f
            if seen:
                which, n = places_of(lists(batch.column("rare"))[2], batch.column("at"))
                places, g = (np.concatenate(x) for x in zip(*seen, strict=True))
                seen.clear()
                which = which[np.searchsorted(np.flatnonzero(flat >= symbols), places)]
                sums = [pa.array(np.rint(FINE * np.bincount(which, g[:, j], minlength=n)), pa.float64()) for j in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), batch.column("rare").flatten(), pa.array(np.bincount(which, minlength=n)), *sums], names=names)
        rows = np.vstack([emits, steps, starts[None], np.full((1, k), fit)])
        if symbols is None:
            for i, part in enumerate(np.split(rows, range(PART, len(rows), PART))):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "sums"])
            return
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.nulls(len(used), pa.string()), pa.array(np.zeros(len(used), np.int64)), *[pa.array(rows[used, j]) for j in range(k)]], names=names)

    training = coded.where(~F.col("held_out"))
    table, words = np.zeros((len(share) + k + 2, k)), None
    if symbols is None:
        parts = training.select("symbols").mapInArrow(run, "part int, sums binary").repartition(-(-len(table) // PART), "part").mapInArrow(tidy(added), "part int, sums binary")
        for row in parts.collect():  # head + classes + states + 2 rows of the table in all
            table[row["part"] * PART :][:PART] += np.frombuffer(row["sums"]).reshape(-1, k)
    else:
        sums = training.select("symbols", "rare", "at").mapInArrow(run, "row int, word string, c long, " + ", ".join(f"{n} double" for n in states))
        sums = settled(sums.groupBy("row", "word").agg(F.sum("c").alias("c"), *[F.sum(n).alias(n) for n in states]), "op1-words")
        found = sums.where("row >= 0").toPandas()  # at most as many
        table[found["row"]] = found[states].to_numpy()
        words = sums.where("row < 0").drop("row")
    shared.unpersist()
    trim()
    emits = table[: len(share)]
    return normalised(emits, table[len(share) : -2], table[-2], share), table[-1, 0] / max(emits.sum(), 1.0), emits, words


@dataclass
class Classes:
    """Of each class and state: the shares g of expected counts, and the sums Z of words and the unknown word."""

    g: np.ndarray
    z: np.ndarray


def profiles(words: DataFrame, emits: np.ndarray, share: np.ndarray, lex: Lexicon) -> tuple[DataFrame, Classes]:
    """word, c and profile p of each word beyond the head, and the classes' sums; ``share`` is the states' own, for classes without words."""
    k = len(share)
    own = emits[lex.symbols :]
    total = own.sum(axis=1, keepdims=True)
    g = np.where(total > 0, own / np.where(total > 0, total, 1.0), share)
    by_class = words.sparkSession.createDataFrame([(i, row.tolist()) for i, row in enumerate(g)], "k int, g array<double>")  # one row a class
    p = F.array(*[F.greatest(F.lit(1.0), F.rint(COARSE * (F.col(f"e{j}") / FINE + TAU * F.col("g")[j]) / (F.col("c") + TAU))) for j in range(k)]).cast("array<tinyint>")
    table = words.withColumn("k", class_of(lex.classes)).join(F.broadcast(by_class), "k").select("word", "c", "k", p.alias("p"))
    sums = table.groupBy("k").agg(*[F.sum((F.col("c") + 0.5) * F.col("p")[j] / COARSE).alias(f"z{j}") for j in range(k)]).toPandas()
    z = 0.5 * g
    z[sums["k"]] += sums[[f"z{j}" for j in range(k)]].to_numpy()
    return table.select("word", "c", "p"), Classes(g, z)


def score(coded: DataFrame, model: Hmm, words: DataFrame, classes: Classes) -> DataFrame:
    """The columns of ``coded`` that sums need, rare_known and rare_log of words beyond the head, and path_log: log10 of a text's probability."""
    shared = coded.sparkSession.sparkContext.broadcast((model, classes))
    keep = CODED_NAMES[:6]
    types = dict(coded.dtypes)
    pairs = coded.select("key", F.posexplode("rare").alias("i", "word"))
    found = pairs.join(words, "word").groupBy("key").agg(F.collect_list(F.struct("i", "c", "p")).alias("found"))  # as many as the text has words beyond the head
    rows = coded.select(*keep, "symbols", F.size("rare").alias("n_rare"), "at").join(found, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, classes = shared.value
        k, head = len(model.start), len(model.emit) - len(classes.z)
        unknown = model.emit.copy()
        unknown[head:] *= 0.5 * classes.g / classes.z
        for batch in batches:
            flat, begin, size = lists(batch.column("symbols"))
            flat = flat.copy()
            n_rare = batch.column("n_rare").to_numpy()
            which, n = places_of(n_rare, batch.column("at"))
            beyond = np.flatnonzero(flat >= head)
            kind = np.zeros(n, np.int64)
            kind[which] = flat[beyond] - head
            got = batch.column("found")
            i, c, p = (got.flatten().field(f) for f in ("i", "c", "p"))
            owner = np.repeat(np.arange(len(batch)), got.value_lengths().fill_null(0).to_numpy())
            slot = (np.cumsum(n_rare) - n_rare)[owner] + i.to_numpy()
            c, p = c.to_numpy(), p.flatten().to_numpy().reshape(-1, k) / COARSE
            own = kind[slot]
            count, row = np.zeros(n, np.int64), np.full(n, -1)
            count[slot], row[slot] = c, len(unknown) + np.arange(len(slot))
            flat[beyond] = np.where(row[which] >= 0, row[which], flat[beyond])
            emit = np.vstack([unknown, model.emit[head + own] * (c[:, None] + 0.5) * p / classes.z[own]])
            ll = forward(Hmm(model.start, model.step, emit, model.share), flat, begin, size)
            text = np.repeat(np.arange(len(batch)), lists(batch.column("at"))[2])
            known = np.bincount(text, count[which] > 0, len(batch)).astype(np.int64)
            logs = np.bincount(text, np.log10(count[which] + 0.5), len(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in keep], pa.array(known), pa.array(logs, pa.float64()), pa.array(ll)], names=[*keep, "rare_known", "rare_log", "path_log"])

    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", rare_known long, rare_log double, path_log double")


def first_model(coded: DataFrame, lex: Lexicon, states: int) -> Hmm:
    places = F.explode(F.sequence(F.lit(0), F.floor((F.size("symbols") - 1) / SEED_TOKENS).cast("int")))
    parts = coded.where(~F.col("held_out")).select("key", "symbols", places.alias("part"))
    parts = parts.select("key", "part", F.slice("symbols", F.col("part") * SEED_TOKENS + 1, SEED_TOKENS).alias("s"))
    rows = hashed_sample(parts, SEED_SEGMENTS, "key", "part")
    return seeded([np.array(r, dtype=np.int32) for r in rows.toPandas()["s"]], lex.symbol_share(), states)


def train(coded: DataFrame, lex: Lexicon, *, states: int, max_passes: int) -> tuple[Hmm, DataFrame, Classes]:
    """The model, the profiles of the words beyond the head, and their classes: passes by class, then one by word."""
    share = lex.symbol_share()
    model = first_model(coded, lex, states)
    seen = -np.inf
    for _ in range(max_passes - 1):
        model, fit, _, _ = baum_welch(coded, model, share)
        if fit - seen < GAIN:
            break
        seen = fit
    model, _, emits, words = baum_welch(coded, model, share, lex.symbols)
    return model, *profiles(words, emits, model.share, lex)


def lm_scores(docs: DataFrame, *, states=8, max_passes=4, head=100_000, classes=2048) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    training = docs.where(fold_of("doc_id", FOLDS) != HELD_OUT)
    counts = settled(count_words(training), "op1-counts")
    lex = lexicon(counts, head=head, classes=classes)
    coded = settled(code(docs, lex), "op1-coded")
    model, words, by_class = train(coded, lex, states=states, max_passes=max_passes)
    return score(coded, model, words, by_class).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("known_log") + F.col("rare_log") - F.col("n_tokens") * float(np.log10(lex.total + 0.5 * (lex.kinds + 1)))).alias("base_score"),
        F.col("path_log").alias("score"),
    )
