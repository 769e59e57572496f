"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is split by the public pattern, and the distinct pieces that a worker has not met yet go through one
recursive query: rows (piece, position, token) start as single bytes; each round joins neighbours with the
merge table, finds every piece's minimum rank and contracts its occurrences from the left, until no pair
of a piece merges. Decoding joins the ids of whole texts with the vocabulary and concatenates in order.

A round contracts each piece's leftmost occurrence. For long pieces (over ``LONG`` bytes) a second query contracts
all occurrences of the minimum-rank pair in one round wherever the token made cannot itself merge at a lower rank
(``safe``), which gives the same ids in far fewer rounds.

Memory is bounded: pieces go to DuckDB in blocks of ``BLOCK_BYTES``, known pieces are held up to ``KNOWN`` a task, and
long texts are cut where the pattern splits anyway. A task opens its own DuckDB database and closes it when it ends, however it
ends; a worker keeps only the vocabulary's arrays, of a fixed size. Defined cases: a null text is empty and has no tokens, the
digest of the empty string, and decodes to no bytes; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_or_empty, tidy
from .token_counts import PIECE, pieces

BLOCK_BYTES = 1 << 17
KNOWN = 250_000
GROUP_CHARS = 500_000

#: Pieces of more bytes are contracted by the second query, many occurrences in a round.
LONG = 256

# k is piece << 40 | position; positions of a piece stay dense, so a neighbour is k + 1. c is the piece's
# minimum of rank << 40 | position: the leftmost occurrence of its minimum-rank pair.
CONTRACT = """
WITH RECURSIVE t(step, k, id) AS (
  SELECT 0, k, id FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT a.k >> 40 AS w, (merges.m << 40) | (a.k & 1099511627775) AS c
     FROM t a JOIN t b ON b.k = a.k + 1 JOIN merges ON merges.pair = ((a.id << 20) | b.id)
   ), best AS (SELECT w, min(c) AS c FROM pairs GROUP BY w)
   SELECT step + 1, k - CASE WHEN (k & 1099511627775) > (c & 1099511627775) THEN 1 ELSE 0 END,
          CASE WHEN (k & 1099511627775) = (c & 1099511627775) THEN c >> 40 ELSE id END
   FROM t JOIN best ON k >> 40 = w WHERE (k & 1099511627775) <> (c & 1099511627775) + 1)
), last AS (SELECT k >> 40 AS w, max(step) AS step FROM t GROUP BY ALL)
SELECT t.k >> 40 AS w, list(id ORDER BY k) AS ids FROM t JOIN last ON last.w = t.k >> 40 AND last.step = t.step GROUP BY ALL
"""

# neighbouring hits, of pairs like (a, a), are taken alternately from the left
CONTRACT_LONG = """
WITH RECURSIVE t(step, w, pos, id) AS (
  SELECT 0, k >> 40, k & 1099511627775, id FROM start
  UNION ALL
  SELECT step + 1, w, pos, CASE WHEN hit THEN lo ELSE id END FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) AS gone FROM (
      SELECT *, coalesce(m = lo, false) AND CASE
          WHEN NOT safe THEN pos = min(CASE WHEN m = lo THEN pos END) OVER (PARTITION BY w)
          WHEN id = nxt THEN (rn - max(CASE WHEN m IS DISTINCT FROM lo THEN rn ELSE 0 END) OVER (PARTITION BY w ORDER BY pos)) % 2 = 1
          ELSE true END AS hit FROM (
        SELECT *, min(m) OVER (PARTITION BY w) AS lo FROM (
          SELECT p.*, merges.m, merges.safe FROM (
            SELECT *, lead(id) OVER (PARTITION BY w ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY w ORDER BY pos) AS rn FROM t
          ) p LEFT JOIN merges ON merges.pair = ((p.id << 20) | p.nxt)
        )
      ) WHERE lo IS NOT NULL
    )
  ) WHERE NOT gone
), last AS (SELECT w, max(step) AS step FROM t GROUP BY w)
SELECT w, list(id ORDER BY pos) AS ids FROM t SEMI JOIN last USING (w, step) GROUP BY w
"""


@dataclass(frozen=True)
class Tables:
    """What a worker keeps of a vocabulary file."""

    ranks: dict[bytes, int]
    merges: pa.Table  # pair, m, safe
    vocab: pa.Table  # id, bytes (as Latin-1 text)


@cache
def tables(path: str) -> Tables:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    merges = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, made = np.array(merges, dtype=np.int64).reshape(-1, 3).T
    size = max(ranks.values()) + 1
    lowest = np.full(size, 1 << 30)  # of the merges that a token takes part in
    np.minimum.at(lowest, left, made)
    np.minimum.at(lowest, right, made)
    token = [""] * size
    for t, m in ranks.items():
        token[m] = t.decode("latin-1")
    return Tables(ranks, pa.table({"pair": left << 20 | right, "m": made, "safe": lowest[made] > made}), pa.table({"id": pa.array(range(size), pa.int32()), "bytes": pa.array(token)}))


class Vocabulary:
    """The encoder of one task: a DuckDB database with the merge table, and the pieces known so far. To be closed."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        given = tables(path)
        self.ranks, self.find = given.ranks, regex.compile(pattern).findall
        self.decimal = list(map(str, range(given.vocab.num_rows)))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self._load("merges", given.merges)
        self._load("vocab", given.vocab)
        self.byte_id = np.array([given.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[str, int] = {}
        self.reset()

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def close(self) -> None:
        self.db.close()
        self.reset()

    def reset(self) -> None:
        self.known.clear()
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Encode pieces that are not known yet."""
        block: list[str] = []
        size = 0
        for piece in new:
            block.append(piece)
            size += len(piece)
            if size >= BLOCK_BYTES:
                self._contract(block)
                block, size = [], 0
        if block:
            self._contract(block)

    def _contract(self, block: list[str]) -> None:
        raw = [p.encode() for p in block]
        found: list[list[int] | None] = [None if (r := self.ranks.get(b)) is None else [r] for b in raw]
        for query, own in ((CONTRACT, lambda b: len(b) <= LONG), (CONTRACT_LONG, lambda b: len(b) > LONG)):
            left = [i for i, b in enumerate(raw) if found[i] is None and own(b)]
            if not left:
                continue
            lengths = np.array([len(raw[i]) for i in left])
            codes = np.frombuffer(b"".join(raw[i] for i in left), dtype=np.uint8)
            pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.db.register("start", pa.table({"k": np.repeat(np.array(left, np.int64), lengths) << 40 | pos, "id": self.byte_id[codes]}))
            out = self.db.sql(query).to_arrow_table()
            self.db.unregister("start")
            for i, ids in zip(out.column("w").to_pylist(), out.column("ids").to_pylist(), strict=True):
                found[i] = ids
        base = len(self.size)
        self.known.update(zip(block, range(base, base + len(block)), strict=True))
        size = np.array([len(ids) for ids in found], dtype=np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [[p for part in pieces(t) for p in self.find(part)] if len(t) > PIECE else self.find(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.reset()
            new = set().union(*split)
        self._learn(list(new))
        out = []
        for parts in split:
            i = np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))
            size = self.size[i]
            out.append(self.flat[np.repeat(self.start[i] - np.cumsum(size) + size, size) + np.arange(size.sum())])
        return out

    def shown(self, ids: np.ndarray) -> str:
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))

    def encode(self, texts: list[str]) -> list[tuple[str, np.ndarray]]:
        """For each text the decimal ids joined by a space, and the ids."""
        return [(self.shown(ids), ids) for ids in self.ids(texts)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list, by an ordered aggregation over (text, position, id)."""
        lengths = np.array([len(x) for x in ids])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.db.register("toks", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), lengths), "pos": np.arange(len(flat), dtype=np.int64), "id": flat}))
        rows = self.db.sql("SELECT doc, string_agg(bytes, '' ORDER BY pos) FROM toks JOIN vocab USING (id) GROUP BY doc").fetchall()
        self.db.unregister("toks")
        out = [b""] * len(ids)
        for doc, shown in rows:
            out[doc] = shown.encode("latin-1")
        return out


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """Consecutive texts of GROUP_CHARS characters or the first beyond, so that one query serves many."""
    block, size = [], 0
    for t in texts:
        block.append(t.as_py())
        size += len(block[-1])
        if size >= GROUP_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_documents(docs: DataFrame, path: str, pattern: str, *, digests: bool = False) -> DataFrame:
    """``docs`` with ids (array<int>) and decoded (binary), or with n_tokens, ids_sha256 and decoded_sha256 for them.

    Columns of ``docs`` under those names are replaced.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    keep = [c for c in docs.columns if c not in made]
    types = dict(docs.dtypes)
    rows = small_batches(docs).select(*keep, text_or_empty().alias("__text"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + (", n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ", ids array<int>, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Vocabulary(path, pattern)) as v:
            for batch in batches:
                at = 0
                for texts in _groups(batch.column("__text")):
                    coded = v.ids(texts)
                    raw = v.decode(coded)
                    kept = [batch.column(c).slice(at, len(texts)) for c in keep]
                    at += len(texts)
                    if digests:
                        made_cols = [
                            pa.array([len(ids) for ids in coded], pa.int64()),
                            pa.array([hashlib.sha256(s.encode()).hexdigest() for s in map(v.shown, coded)]),
                            pa.array([hashlib.sha256(b).hexdigest() for b in raw]),
                        ]
                    else:
                        offsets = np.cumsum([0, *map(len, coded)])
                        flat = np.concatenate(coded).astype(np.int32)
                        made_cols = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(raw, pa.binary())]
                    yield pa.RecordBatch.from_arrays(kept + made_cols, names=[*keep, *made])

    return rows.mapInArrow(tidy(run), schema)
