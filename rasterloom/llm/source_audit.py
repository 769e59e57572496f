"""How far the sources of a language are from each other, by sorted runs of (language, term, source, document).

A task tokenises its documents, sorts blocks of (language, term, source, document) and scans the runs: a run gives the number of its
documents and its count. Those partial runs are dealt by (language, term), sorted by source, and scanned again as a
stream; a term of at least ``least`` documents of its language goes on as one row with its sources and their counts. With the totals
known, each task turns its terms into partial sums for each pair of sources and its own best terms for each source; sums and
tops are then merged. A pair's terms that neither source has all contribute the same, so they are counted, not visited.

A term's rows are combined before they are dealt, so a word in every document costs one row for each source and block. Terms of one
language go to many tasks. A task holds one block (``BLOCK`` tokens), one term's sources, and for a language of s
sources two tables of s x s numbers: the result has as many rows.

Defined cases: null text, language and source are ''; each row is a document, equal rows too; a text of no terms still makes its group
occur; a language without kept terms gives pairs of value 0 and no terms; no documents give no rows; ties go by UTF-8 order; long texts are
read in slices. Columns other than lang, source and text are not looked at. All numbers are exact integers while a language has fewer
than 9 * 10^15 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dealt_join, settled, small_batches, text_or_empty, tidy

#: Bytes of a term, lower-cased; all others become spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK = 1 << 22
SLICE = 1 << 20
ROWS = 1 << 16
SCALE = 10**9
#: A task gives its pair sums away when it holds more than this many.
CELLS = 1 << 22


def slices(raw: bytes) -> Iterator[bytes]:
    """``raw``, whose terms are parted by spaces, in parts of about SLICE bytes."""
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SLICE else raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def scan(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key and document: each run's key, its number of documents, its count."""
    new = np.r_[True, key[1:] != key[:-1]]
    starts = np.flatnonzero(new)
    new[1:] |= doc[1:] != doc[:-1]
    return key[starts], np.add.reduceat(new.astype(np.int64), starts), np.add.reduceat(n, starts)


class Block:
    """Tokens of some documents, as numbers, until they are sorted and scanned."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[int, int, np.ndarray, np.ndarray | None]] = []
        self.docs = self.tokens = 0

    def add(self, lang: str, source: str, text: str) -> None:
        group, terms = self.groups.setdefault((lang, source), len(self.groups)), self.terms
        raw = text.encode().translate(LETTERS)
        for part in slices(raw):
            words = part.split()
            ids = np.fromiter((terms.setdefault(w, len(terms)) for w in words), np.int64, len(words))
            n = None
            if len(raw) > SLICE:
                ids, n = np.unique(ids, return_counts=True)
            if len(ids):
                self.parts.append((group, self.docs, ids, n))
                self.tokens += len(ids)
        self.docs += 1

    def runs(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        sizes = [len(p[2]) for p in self.parts]
        key = np.concatenate([p[2] for p in self.parts]) * len(self.groups) + np.repeat([p[0] for p in self.parts], sizes)
        doc = np.repeat([p[1] for p in self.parts], sizes)
        n = np.concatenate([np.ones(len(p[2]), np.int64) if p[3] is None else p[3] for p in self.parts])
        self.parts = []
        order = np.argsort(key * self.docs + doc, kind="stable")
        key, docs, n = scan(key[order], doc[order], n[order])
        names, groups = pa.array(list(self.terms), pa.binary()), list(self.groups)
        langs, sources = pa.array([g[0] for g in groups]), pa.array([g[1] for g in groups])
        for at in range(0, len(key), ROWS):
            term, group = np.divmod(key[at : at + ROWS], len(groups))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), names.take(pa.array(term)).cast(pa.string()), sources.take(pa.array(group)), pa.array(docs[at : at + ROWS]), pa.array(n[at : at + ROWS])], names=RUN)


RUN = ["lang", "term", "source", "docs", "n"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = Block()
    for batch in batches:
        for lang, source, text in zip(*[batch.column(c) for c in ("lang", "source", "text")], strict=True):
            block.add(lang.as_py(), source.as_py(), text.as_py())
            if block.tokens >= BLOCK or block.docs >= 1 << 20:
                yield from block.runs()
                block = Block()
    yield from block.runs()


def _changes(table: pa.Table, cols: list[str]) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for c in cols:
        col = table[c]
        out[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return out


def _sources_of_terms(least: int):
    """Rows sorted by lang, term, source to one row for each term of at least ``least`` documents."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def summed(t: pa.Table) -> pa.Table:
        """One row for each lang, term and source."""
        starts = np.flatnonzero(_changes(t, ["lang", "term", "source"]))
        sums = [pa.array(np.add.reduceat(t[c].to_numpy(), starts)) for c in ("docs", "n")]
        first = t.take(pa.array(starts))
        return pa.table([first["lang"], first["term"], first["source"], *sums], names=RUN)

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(_changes(t, ["lang", "term"]))
        ends = np.r_[starts[1:], t.num_rows]
        kept = np.add.reduceat(t["docs"].to_numpy(), starts) >= least
        total = np.add.reduceat(t["n"].to_numpy(), starts)[kept]
        t = t.filter(pa.array(np.repeat(kept, ends - starts)))
        first = (ends - starts)[kept].cumsum() - (ends - starts)[kept]
        offsets = pa.array(np.r_[first, t.num_rows].astype(np.int32))
        at = pa.array(first)
        t = t.combine_chunks()
        flat = [t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c] for c in ("source", "n")]
        lists = [pa.ListArray.from_arrays(offsets, f.chunk(0) if isinstance(f, pa.ChunkedArray) else f) for f in flat]
        yield from pa.table([t["lang"].take(at), t["term"].take(at), pa.array(total), *lists], schema=schema).combine_chunks().to_batches(max_chunksize=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).select(RUN)
            t = summed((pa.concat_tables([held, t]) if held is not None else t).combine_chunks())
            last = int(np.flatnonzero(_changes(t, ["lang", "term"]))[-1])
            if last:
                yield from emit(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield from emit(held)

    return run


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """lang, term, total, sources, counts: the terms in at least ``least`` documents of their language, with what each source has."""
    given = small_batches(docs).select(*[text_or_empty(c).alias(c) for c in ("lang", "source", "text")])
    runs = given.mapInArrow(tidy(_blocks), "lang string, term string, source string, docs long, n long")
    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(tidy(_sources_of_terms(least)), "lang string, term string, total long, sources array<string>, counts array<long>")


def languages(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, vocabulary, lang_total, sources (array of source, total; every source that occurs): one row for each language."""
    groups = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    own = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("total"))
    whole = terms.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_total"))
    listed = groups.join(own, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("groups"))
    return listed.join(whole, "lang", "left").na.fill(0, ["vocabulary", "lang_total"])


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / whole), exact by long division in base 1000; count <= whole < 9 * 10^15."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


class Language:
    """Partial sums and best terms of one language in one task."""

    def __init__(self, names: list[str], totals: list[int], vocabulary: int, lang_total: int, top: int) -> None:
        s = len(names)
        self.names, self.top = names, top
        self.whole = np.array(totals, np.int64) + vocabulary
        self.lang_whole = np.int64(lang_total + vocabulary)
        self.none = share(np.ones(s, np.int64), self.whole)
        self.value, self.seen = np.zeros((s, s), np.int64), np.zeros((s, s), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in names]
        self.bar = np.zeros(s, np.int64)

    def add(self, terms: pa.Array, total: np.ndarray, row: np.ndarray, source: np.ndarray, count: np.ndarray) -> None:
        """Terms and their entries: entry i says that term row[i] has count[i] in source[i]."""
        p = np.tile(self.none, (len(total), 1))
        own = p[row, source] = share(count + 1, self.whole[source])
        has = np.zeros(p.shape, dtype=bool)
        has[row, source] = True
        np.add.at(self.value, source, (own[:, None] - p[row]) ** 2 // p[row])
        back = np.zeros_like(self.value)  # by the source that has the term, to those that lack it
        np.add.at(back, source, np.where(has[row], 0, (p[row] - own[:, None]) ** 2 // own[:, None]))
        self.value += back.T
        n, each = has.sum(axis=0), has.astype(np.float64)
        self.seen += n[:, None] + n[None, :] - np.rint(each.T @ each).astype(np.int64)
        q = share(total + 1, self.lang_whole)[row]
        value = (own - q) ** 2 // q
        for i in np.flatnonzero((own > q) & (value >= self.bar[source])):
            best = self.best[source[i]]
            best.append((-int(value[i]), terms[int(row[i])].as_py().encode()))
            if len(best) >= 8 * self.top:
                self.cut(source[i])

    def cut(self, s: int) -> None:
        self.best[s].sort()
        del self.best[s][self.top :]
        if len(self.best[s]) == self.top:
            self.bar[s] = -self.best[s][-1][0]

    def rows(self) -> tuple[list, ...]:
        s, t = np.nonzero(self.seen)
        s, t = s[s != t], t[s != t]
        part, source, item = ["pair"] * len(s), [self.names[i] for i in s], [self.names[i] for i in t]
        value, seen = self.value[s, t].tolist(), self.seen[s, t].tolist()
        for i, name in enumerate(self.names):
            self.cut(i)
            part += ["term"] * len(self.best[i])
            source += [name] * len(self.best[i])
            item += [w.decode() for _, w in self.best[i]]
            value += [-v for v, _ in self.best[i]]
            seen += [0] * len(self.best[i])
        return part, source, item, value, seen


def _partials(top: int):
    def given_away(held: dict[str, Language]) -> Iterator[pa.RecordBatch]:
        for lang, x in held.items():
            part, source, item, value, seen = x.rows()
            out = pa.table({"lang": pa.array([lang] * len(part), pa.string()), "part": pa.array(part, pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64()), "seen": pa.array(seen, pa.int64())})
            yield from out.to_batches(max_chunksize=ROWS)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Language] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            starts = np.flatnonzero(_changes(t, ["lang"])) if t.num_rows else []
            for a, b in zip(starts, [*starts[1:], t.num_rows], strict=True):
                lang = batch["lang"][int(a)].as_py()
                if lang not in held:
                    groups = batch["groups"][int(a)].as_py()
                    held[lang] = Language([g["source"] for g in groups], [g["total"] for g in groups], batch["vocabulary"][int(a)].as_py(), batch["lang_total"][int(a)].as_py(), top)
                x = held[lang]
                # so many terms at a time that entries x sources stay few
                s = len(x.names)
                step = max(1, 500_000 // (s * s))
                names = pa.array(x.names, pa.string())
                for at in range(int(a), int(b), step):
                    part = batch.slice(at, min(step, int(b) - at))
                    sources, sizes = part["sources"].flatten(), pc.list_value_length(part["sources"]).to_numpy(zero_copy_only=False)
                    x.add(part["term"], part["total"].to_numpy(), np.repeat(np.arange(part.num_rows), sizes), pc.index_in(sources, names).to_numpy(zero_copy_only=False).astype(np.int64), part["counts"].flatten().to_numpy())
                if sum(len(y.names) ** 2 for y in held.values()) > CELLS:
                    yield from given_away(held)
        yield from given_away(held)

    return run


def source_divergence(docs: DataFrame, *, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: for each source its divergence from each other source of the language (part pair,
    item the other), and the terms that it has more of than the language has (part term, at most ``top``)."""
    terms = settled(kept_terms(docs, least), "op11-terms")
    langs = settled(languages(docs, terms), "op11-languages")
    joined = dealt_join(terms, langs.withColumn("n", F.col("vocabulary")), "lang", "term")
    partial = settled(joined.select("lang", "term", "total", "sources", "counts", "groups", "vocabulary", "lang_total").mapInArrow(tidy(_partials(top)), "lang string, part string, source string, item string, value long, seen long"), "op11-partials")

    one = langs.select("lang", "vocabulary", "groups", F.explode("groups").alias("g"))
    two = one.select("lang", "vocabulary", F.col("g.source").alias("source"), F.col("g.total").alias("total"), F.explode("groups").alias("h")).where("h.source <> source")
    pairs = two.select("lang", "source", F.col("h.source").alias("item"), "vocabulary", *[F.expr(f"1 + {SCALE} div greatest({t} + vocabulary, 1)").alias(c) for c, t in (("p", "total"), ("q", "h.total"))])
    sums = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    absent = F.expr("(vocabulary - coalesce(seen, 0)) * ((p - q) * (p - q) div q)")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + absent).alias("value"))

    order = [F.col("value").desc(), F.col("item")]
    # tops of tops: many tasks first, then one for each source
    found = partial.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(32)))
    found = found.withColumn("k", F.row_number().over(W.partitionBy("lang", "source", "deal").orderBy(*order))).where(F.col("k") <= top).drop("k", "deal")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    return pairs.select("*", rank).unionByName(found.select("*", rank).where(F.col("rank") <= top))
