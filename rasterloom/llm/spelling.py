"""Spelling variants: words one edit apart, by forward and backward minimal acyclic automata.

If two words differ by one inserted, deleted or replaced character, they agree on the first half of either or on its second half. So each
word asks twice: among the words that begin with its first half, whose automaton it follows exactly for that half and with one error beyond; and, all
reversed, among those that end with its second half. An automaton numbers its words in order (each transition carries the count of
words before it), so a path's number finds the word and its count. What the backward pass finds is dropped if it begins with the first
half, since the forward pass has it.

Words are dealt by the half that must match: a word is asked for under its own half and listed under the halves of words
one shorter and one longer. A task takes whole halves in order, builds one automaton for ``GROUP`` listed words, asks, and drops it. Of
a half shared by more than ``GROUP`` words the list is dealt to several tasks and each question goes to all of these. No pair leaves its task: a word's
neighbours come out as their number and the best of them.

Defined cases: null texts have no words, a null doc_id is the empty text before the colon; each row counts, equal rows too; without words there are no rows; ties between forms go to the
smallest in code-point order; a form is at least ``ratio`` times as frequent, so following forms ends. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, small_batches, text_or_empty, tidy

LEAST = 6
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
DELETE = 199
HELD = 250_000
GROUP = 20_000
CHARS = 4_000_000


def words_of(doc_id: str, text: str) -> Counter[str]:
    """Words of at least LEAST code points, with the deletions that the rule asks for."""
    lower = text.encode().lower().decode()
    runs = Counter(RUN.findall(lower)) if len(lower) < CHARS else Counter(m.group() for m in RUN.finditer(lower))
    seed, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % DELETE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST:
                continue
        out[run] += n
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            held.update(words_of(doc_id.as_py(), text.as_py()))
            if len(held) >= HELD:
                yield from flush()
    yield from flush()


def word_counts(docs: DataFrame, least: int = 5) -> DataFrame:
    """word, n: the words of at least ``least`` occurrences."""
    given = small_batches(docs).select(text_or_empty("doc_id").alias("id"), text_or_empty().alias("text"))
    return given.mapInArrow(tidy(_counts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """Minimal acyclic automaton of distinct words in code-point order; a word's number is its place in that order."""

    def __init__(self, words: list[str]) -> None:
        self.hops: list[dict[str, tuple[int, int]]] = []  # by state: character to (state, words before)
        self.ends: list[bool] = []
        size: list[int] = []
        known: dict[tuple, int] = {}

        def state(end: bool, edges: list[tuple[str, int]]) -> int:
            same = (end, tuple(edges))
            if same not in known:
                known[same] = len(self.ends)
                at, hops = int(end), {}
                for c, t in edges:
                    hops[c] = (t, at)
                    at += size[t]
                self.hops.append(hops)
                self.ends.append(end)
                size.append(at)
            return known[same]

        # the states along the last word stay open until the next word leaves them
        path: list[list] = [[False, []]]
        last = ""
        for word in [*words, ""]:
            same = 0
            most = min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            while len(path) - 1 > same:
                s = state(*path.pop())
                path[-1][1].append((last[len(path) - 1], s))
            path += [[False, []] for _ in word[same:]]
            if word:
                path[-1][0] = True
            last = word
        self.root = state(*path[0])

    def number(self, word: str, s: int | None = None, at: int = 0, first: int = 0) -> int | None:
        """The number of the word that goes on from state s with word[first:]."""
        s = self.root if s is None else s
        for i in range(first, len(word)):
            hop = self.hops[s].get(word[i])
            if hop is None:
                return None
            s, at = hop[0], at + hop[1]
        return at if self.ends[s] else None

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with word[:half] and go on with one error."""
        found: set[int | None] = set()
        s, at, n = self.root, 0, len(word)
        for i in range(n + 1):
            if i >= half:
                own = word[i] if i < n else ""
                for c, (t, before) in self.hops[s].items():
                    if c != own:
                        found.add(self.number(word, t, at + before, i))  # c inserted
                        if own:
                            found.add(self.number(word, t, at + before, i + 1))  # c instead
                if own and (i + 1 == n or word[i + 1] != own):  # of equal neighbours the last goes
                    found.add(self.number(word, s, at, i + 1))
            if i == n:
                break
            hop = self.hops[s].get(word[i])
            if hop is None:
                break
            s, at = hop[0], at + hop[1]
        return found - {None}  # type: ignore[return-value]


def best_near(listed: dict[str, int], asked: list[str], backward: bool) -> Iterator[tuple[str, int, int, str]]:
    """word, number of near words, the best one's count, the best one; oriented words in, words as they are read out."""
    order = sorted(listed)
    automaton = Automaton(order)
    for word in asked:
        half = (len(word) + 1) // 2 if backward else len(word) // 2
        own, found = word, [order[i] for i in automaton.near(word, half)]
        if backward:
            own, found = word[::-1], [v[::-1] for v in found]
            found = [v for v in found if not v.startswith(own[: len(own) // 2])]
        if found:
            top = min(found, key=lambda v: (-listed[v[::-1] if backward else v], v))
            yield own, len(found), listed[top[::-1] if backward else top], top


ENTRY = ["key", "part", "word", "n", "listed", "asked"]
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _searches(group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: dict[str, int] = {}
        asked: list[str] = []
        held = chars = 0
        last: tuple = ()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, chars
            rows = list(best_near(listed, asked, last[0].startswith("B"))) if asked else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)
            listed.clear()
            asked.clear()
            held = chars = 0

        for batch in batches:
            for key, part, word, n, is_listed, is_asked in zip(*[batch.column(c).to_pylist() for c in ENTRY], strict=True):
                if (key, part) != last:
                    # a dealt half stands alone, so that a question meets each word once
                    if last and (held >= group or chars >= CHARS or key[0] != last[0][0] or part >= 0 or last[1] >= 0):
                        yield from flush()
                    last = (key, part)
                if is_listed:
                    listed[word] = n
                if is_asked:
                    asked.append(word)
                held += 1
                chars += len(word)
        if last:
            yield from flush()

    return run


def _halves(word: Column, lengths: list[Column], own: Column, tag: str) -> Column:
    """Entries of an oriented word: listed under each length of ``lengths``, asked for under its own."""
    each = F.array_distinct(F.array(*[n.cast("int") for n in lengths]))
    return F.transform(each, lambda h: F.struct(F.concat(F.lit(tag), word.substr(F.lit(1), h)).alias("key"), word.alias("word"), (h == own.cast("int")).alias("asked")))


def near_words(words: DataFrame, *, group: int = GROUP) -> DataFrame:
    """word, n_near, form_n, form for the words (word, n) that have near words: how many, and the most frequent of them."""
    w, n = F.col("word"), F.length("word")
    down = [F.floor(x / 2) for x in (n - 1, n, n + 1)]
    up = [F.floor(x / 2) for x in (n, n + 1, n + 2)]
    entries = words.select("n", F.explode(F.concat(_halves(w, down, down[1], "F"), _halves(F.reverse(w), up, up[1], "B"))).alias("e")).select("e.*", "n")
    sizes = entries.groupBy("key").count()
    total = 4 * words.count()
    bound = max(group, total // 100_000)  # so at most 100,000 halves are dealt
    hot = settled(sizes.where(F.col("count") > bound).select("key", F.ceil(F.col("count") / bound).cast("int").alias("parts")), "op13-hot")
    d = entries.withColumns({"part": F.lit(-1), "listed": F.lit(True)})
    if not hot.isEmpty():
        d = entries.join(F.broadcast(hot), "key", "left").withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
        where = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).when(F.col("asked"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
        d = d.withColumn("part", F.explode(where)).withColumn("listed", F.col("parts").isNull() | (F.col("part") == F.col("own")))
    found = d.select(*ENTRY).repartition("key", "part").sortWithinPartitions("key", "part", "word").mapInArrow(tidy(_searches(group)), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("k"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.k")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the rows (word, form): where following forms ends; each round doubles the steps."""
    r = settled(forms.select("word", F.col("form").alias("root")), "op13-roots")
    while True:
        further = r.select(F.col("word").alias("root"), F.col("root").alias("next"))
        r = settled(r.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "op13-roots")
        moved = not r.where("moved").isEmpty()
        r = r.drop("moved")
        if not moved:
            return r


def spelling_variants(docs: DataFrame, *, least: int = 5, ratio: int = 5, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root: every word of at least ``least`` occurrences."""
    words = settled(word_counts(docs, least), "op13-words")
    both = words.join(near_words(words, group=group), "word", "left")
    better = F.col("form_n") >= ratio * F.col("n")
    out = settled(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("form")).alias("form"), F.when(better, F.col("form_n")).alias("form_n")), "op13-forms")
    return out.join(roots(out.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
