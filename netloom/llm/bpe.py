"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark tasks.

Spark partitions the documents. In each task a text is cut at places where a match of the
pattern surely starts, so that the same cut comes up again and again; matches that were not
seen before go to DuckDB together. There every match is a word with a row for each token position
(a match that is a token as a whole has one row). A round joins the rows of the words at work with
the merge table and contracts each word's pair of least rank; the recursion ends when no word has
a pair left. An ordered aggregation over the vocabulary turns the
ids back into bytes. Texts are then put together from the ids and bytes of their words.

In words of over SHORT bytes, pairs of least rank are contracted from left to right, all that
don't overlap in one round, unless the new token could form a pair of a smaller rank (some
vocabularies have such tokens): then only the leftmost. A word of over LONG bytes is encoded in pieces that overlap. Two encodings are
joined at a token that both have at the same place: each two neighbours of the result then stand
side by side in an encoding, and that makes the whole one the encoding (a contraction across their
border would have happened there, too). Pieces without a common token are joined and encoded anew.
So the work on a word grows with its length, not with its square.

Defined cases: a null or empty text has no ids and decodes to nothing; every row is encoded by
itself, so repeated rows, null or repeated ids and empty tables need no care; other columns are
carried along, and a column named like an output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

#: Cuts (and matches) that a worker remembers at most; then it begins anew, so memory stays bounded.
CACHE_ENTRIES = 400_000
#: Matches that one recursive query takes, and the positions they may have together.
QUERY_WORDS, QUERY_BYTES = 60_000, 600_000
#: Bytes of a word from which it is encoded in pieces, and bytes from one piece to the next (each has twice as many).
LONG, STEP = 256, 96

#: Between two characters that aren't space, a single space always starts a match of the pattern.
CUT = re.compile(r"(?<=\S)(?= \S)")

#: Words of up to SHORT bytes: in each round the leftmost pair of least rank of each word; all rows of a word at work go on to the next round.
SHORT = 40
ENCODE = """
WITH RECURSIVE state(w, pos, nxt, tok, done) AS (
  SELECT w, pos, nxt, tok, false FROM positions
  UNION ALL
  (WITH pairs AS (
    SELECT a.w, a.pos, b.pos AS mid, b.nxt AS stop, merges.id
    FROM state a JOIN state b ON b.w = a.w AND b.pos = a.nxt JOIN merges ON merges.l = a.tok AND merges.r = b.tok
    WHERE NOT a.done AND NOT b.done
  ),
  least AS (SELECT w, min((id::BIGINT << 32) + pos) AS m FROM pairs GROUP BY w),
  chosen AS (SELECT pairs.* FROM pairs JOIN least ON pairs.w = least.w AND pairs.id = m >> 32 AND pairs.pos = m & 4294967295)
  SELECT s.w, s.pos, CASE WHEN c.pos = s.pos THEN c.stop ELSE s.nxt END, CASE WHEN c.pos = s.pos THEN c.id ELSE s.tok END, c.w IS NULL
  FROM state s LEFT JOIN chosen c ON c.w = s.w WHERE NOT s.done AND (c.w IS NULL OR s.pos <> c.mid))
)
SELECT w, pos, tok FROM state WHERE done ORDER BY w, pos
"""

#: Longer words: all pairs of least rank in one round where that is safe; only rows that change are written.
ENCODE_LONG = """
WITH RECURSIVE state(w, pos, nxt, tok) USING KEY (w, pos) AS (
  SELECT w, pos, nxt, tok FROM positions
  UNION
  (WITH live AS (SELECT s.w, s.pos, s.nxt, s.tok FROM recurring.state s JOIN (SELECT DISTINCT w FROM state) at_work ON s.w = at_work.w WHERE s.tok >= 0),
  pairs AS (
    SELECT a.w, a.pos, b.pos AS mid, b.nxt AS stop, merges.id, merges.alone
    FROM live a JOIN live b ON b.w = a.w AND b.pos = a.nxt JOIN merges ON merges.l = a.tok AND merges.r = b.tok
  ),
  least AS (SELECT pairs.* FROM pairs JOIN (SELECT w, min(id) AS id FROM pairs GROUP BY w) m ON pairs.w = m.w AND pairs.id = m.id),
  numbered AS (SELECT *, row_number() OVER o AS k, coalesce(lag(mid) OVER o = pos, false) AS goes_on FROM least WINDOW o AS (PARTITION BY w ORDER BY pos)),
  runs AS (SELECT *, max(CASE WHEN NOT goes_on THEN k END) OVER (PARTITION BY w ORDER BY pos) AS first FROM numbered),
  chosen AS (SELECT * FROM runs WHERE (k - first) % 2 = 0 AND (k = 1 OR NOT alone))
  SELECT w, pos, stop, id FROM chosen UNION ALL SELECT w, mid, mid, -1 FROM chosen)
)
SELECT w, pos, tok FROM state WHERE tok >= 0 ORDER BY w, pos
"""

DECODE = """
SELECT w, list(vocabulary.bytes ORDER BY pos) AS bytes
FROM encoded JOIN vocabulary ON vocabulary.id = encoded.tok
GROUP BY w ORDER BY w
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def places(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the items of ragged ``rows`` stand, one row after another, and how many each has."""
    n = offsets[rows + 1] - offsets[rows]
    return np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


class Ragged:
    """Rows of items that are appended to."""

    def __init__(self, kind: type) -> None:
        self.items, self.offsets = np.zeros(0, kind), np.zeros(1, np.int64)

    def extend(self, items: np.ndarray, counts: np.ndarray) -> None:
        self.items = np.concatenate([self.items, items])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = places(self.offsets, rows)
        return self.items[at], n


class Encoder:
    """A DuckDB connection with the merge table and what the worker has encoded lately."""

    def __init__(self, data: bytes, pattern: str, most: int | None = None) -> None:
        self.ranks = read_ranks(data)
        self.match = regex.compile(pattern).findall
        self.most = most or CACHE_ENTRIES
        pairs = [(a, b, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None]
        inverted = {part for a, b, rank in pairs for part in (a, b) if part > rank}  # tokens that form pairs of a smaller rank
        left, right, ids = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True)) if pairs else (pa.array([], pa.int32()),) * 3
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.db.register("merge_rows", pa.table({"l": left, "r": right, "id": ids, "alone": pa.array([rank in inverted for _, _, rank in pairs], pa.bool_())}))
        self.db.register("token_rows", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM token_rows")
        self.bytes = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.forget_words()
        self.forget_cuts()

    def forget_words(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.decoded = Ragged(np.int32), Ragged(np.uint8)

    def forget_cuts(self) -> None:
        self.cuts: dict[str, int] = {}
        self.word_of = Ragged(np.int64)

    def contracted(self, words: list[bytes]) -> tuple[pa.Table, np.ndarray]:
        """Rows w, pos, tok of the words' encodings, in order, and how many each has."""
        lengths = np.array([len(x) for x in words])
        whole = np.array([self.ranks.get(x, -1) for x in words], np.int32)
        n = np.where(whole >= 0, 1, lengths)
        w = np.repeat(np.arange(len(words), dtype=np.int32), n)
        pos = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        one = whole[w] >= 0
        tok = np.where(one, whole[w], 0)
        tok[~one] = self.bytes[np.frombuffer(b"".join([x for x, k in zip(words, whole.tolist(), strict=True) if k < 0]), np.uint8)]
        self.db.register("positions", pa.table({"w": w, "pos": pos, "nxt": np.where(one, lengths[w], pos + 1).astype(np.int32), "tok": tok}))
        found = self.db.sql(ENCODE if lengths.max() <= SHORT else ENCODE_LONG).to_arrow_table().combine_chunks()
        return found, np.bincount(np.asarray(found.column("w")), minlength=len(words))

    def in_lots(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
        """Numbers of words, their token counts and rows, as many at once as a query takes."""
        sizes = np.array([len(x) for x in words])
        first = 0
        while first < len(words):
            last = first + max(int(np.searchsorted(np.cumsum(sizes[first : first + QUERY_WORDS]), QUERY_BYTES, "right")), 1)
            rows, n = self.contracted(words[first:last])
            yield np.arange(first, last), n, rows
            first = last

    def long_word(self, word: bytes) -> np.ndarray:
        """Ids of a long word, by pieces that are joined at common tokens."""
        pieces = [(a, min(a + 2 * STEP, len(word))) for a in range(0, max(len(word) - STEP, 1), STEP)]
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        while True:
            new = [p for p in pieces if p not in known]
            for numbers, n, rows in self.in_lots([word[a:b] for a, b in new]):
                ends = np.cumsum(n)
                pos, tok = (np.asarray(rows.column(c)) for c in ("pos", "tok"))
                for k, at, count in zip(numbers.tolist(), ends.tolist(), n.tolist(), strict=True):
                    known[new[k]] = pos[at - count : at] + new[k][0], tok[at - count : at]
            joined, out, begin, apart = [pieces[0]], [], 0, False
            for one, two in zip(pieces, pieces[1:], strict=False):
                (p, t), (q, u) = known[one], known[two]
                # a token of both: it begins at the same place and has the same id
                p2, t2 = p[np.searchsorted(p, max(begin, two[0])) :], t[np.searchsorted(p, max(begin, two[0])) :]
                at = np.searchsorted(q, p2)
                common = np.flatnonzero((q[np.minimum(at, len(q) - 1)] == p2) & (u[np.minimum(at, len(u) - 1)] == t2))
                if len(common):
                    cut = int(p2[common[0]])
                    out.append(t[(p >= begin) & (p < cut)])
                    begin = cut
                    joined.append(two)
                else:
                    apart = True
                    joined[-1] = (joined[-1][0], two[1])
                    begin = max(begin, two[0])
            if not apart:
                p, t = known[pieces[-1]]
                return np.concatenate([*out, t[p >= begin]])
            pieces = joined

    def learn_words(self, words: list[str]) -> None:
        data = [x.encode() for x in words]
        long = [i for i, x in enumerate(data) if len(x) > LONG and x not in self.ranks]
        short = [i for i, x in enumerate(data) if len(x) <= SHORT]
        between = np.setdiff1d(np.arange(len(data)), short + long).tolist()
        ids, counts = [], []
        for some in (short, between):
            for _, n, rows in self.in_lots([data[i] for i in some]):
                ids.append(np.asarray(rows.column("tok")))
                counts.append(n)
        for i in long:
            ids.append(self.long_word(data[i]))
            counts.append(np.array([len(ids[-1])]))
        flat, n = np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([*counts, np.zeros(0, np.int64)])
        self.db.register("encoded", pa.table({"w": np.repeat(np.arange(len(n)), n), "pos": np.arange(len(flat)), "tok": flat}))
        back = self.db.sql(DECODE).to_arrow_table().column("bytes").combine_chunks()
        offsets, values = np.asarray(back.offsets), back.values
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1][offsets].astype(np.int64)
        self.decoded.extend(np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends))
        self.ids.extend(flat, n)
        for k, i in enumerate([*short, *between, *long], len(self.words)):
            self.words[words[i]] = k

    def learn(self, cuts: list[str]) -> None:
        """Encodes cuts that aren't known yet; words that are forgotten take all cuts with them."""
        matches = [self.match(cut) for cut in cuts]
        flat = list(chain.from_iterable(matches))
        new = list(dict.fromkeys(flat).keys() - self.words.keys())
        if self.words and len(self.words) + len(new) > self.most:
            self.forget_words()
            self.forget_cuts()
            new = list(dict.fromkeys(flat))
        if new:
            self.learn_words(new)
        self.word_of.extend(np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, matches), np.int64, len(matches)))
        self.cuts.update(zip(cuts, range(len(self.cuts), len(self.cuts) + len(cuts)), strict=True))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and decoded bytes of each text."""
        cut = [CUT.split(x) for x in texts]
        flat = list(chain.from_iterable(cut))
        number = np.fromiter(map(self.cuts.get, flat, repeat(-1)), np.int64, len(flat))
        if (number < 0).any():
            unknown = np.flatnonzero(number < 0)
            new = list(dict.fromkeys(map(flat.__getitem__, unknown.tolist())))
            if len(self.cuts) + len(new) <= self.most:
                cuts = self.cuts
                self.learn(new)
                if cuts is self.cuts:
                    number[unknown] = np.fromiter(map(self.cuts.__getitem__, map(flat.__getitem__, unknown.tolist())), np.int64, len(unknown))
            if (number < 0).any():  # all was forgotten on the way, or must be
                self.forget_cuts()
                self.learn(list(dict.fromkeys(flat)))
                number = np.fromiter(map(self.cuts.__getitem__, flat), np.int64, len(flat))
        n_cuts = np.fromiter(map(len, cut), np.int64, len(cut))
        first = 0
        ends = np.cumsum(n_cuts)
        size = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        while first < len(texts):  # about a million characters at once
            last = max(int(np.searchsorted(size, (size[first - 1] if first else 0) + (1 << 20), "right")), first + 1)
            a, b = ends[first] - n_cuts[first], ends[last - 1]
            words, n_words = self.word_of.take(number[a:b])
            ids, n_ids = self.ids.take(words)
            decoded, n_bytes = self.decoded.take(words)
            edge = np.concatenate([[0], np.cumsum(n_words)])[np.concatenate([[0], np.cumsum(n_cuts[first:last])])]
            at_id, at_byte = (np.concatenate([[0], np.cumsum(n)])[edge].tolist() for n in (n_ids, n_bytes))
            for k in range(last - first):
                yield ids[at_id[k] : at_id[k + 1]], decoded[at_byte[k] : at_byte[k + 1]]
            first = last


_encoders: dict[tuple[int, str, int], Encoder] = {}


def encoder(data: bytes, pattern: str, most: int) -> Encoder:
    """One encoder for a vocabulary and pattern in each Python worker."""
    key = (hash(data), pattern, most)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data, pattern, most)
    return _encoders[key]


def bpe(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", digests: bool = False, carry: list[str] | None = None, remember: int = CACHE_ENTRIES, lot_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with its texts encoded and the ids decoded again.

    ranks: content of a .tiktoken file (about 1 MB, sent with the task). Adds ``ids`` (array of
    int) and ``decoded`` (binary), or with ``digests`` n_tokens, ids_sha256 and decoded_sha256;
    columns of ``docs`` with these names are replaced. carry: the columns of ``docs`` to keep (all).
    remember: cuts of a generation that a worker keeps. lot_bytes: text that it takes at once; both bound its memory.
    """
    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())]
    names = {name for name, _ in added}
    carried = [c for c in (docs.columns if carry is None else carry) if c not in names]
    schema = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(n, kind) for n, kind in added)])
    payload = docs.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch, texts in chunks(batches, "__text", lot_bytes):
            known = known or encoder(payload.value, pattern, remember)
            out = known.encode([x.decode() for x in texts])
            if digests:
                rows = [(len(a), hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) for a, b in out]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            else:
                rows = list(out)
                ends = np.cumsum([0] + [len(a) for a, _ in rows]).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([a for a, _ in rows]))), pa.array([b.tobytes() for _, b in rows], pa.binary())]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*carried, *(n for n, _ in added)])

    return docs.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{text_col}`").alias("__text")).mapInArrow(encode, schema)
