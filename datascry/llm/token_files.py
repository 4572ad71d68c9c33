"""Token ids of documents in files compressed by a grammar.

A shard holds consecutive documents.  Pairs of ids that are frequent in it become
nonterminals, round after round; the shard's bytes hold the rules with the lengths that they
expand to, so any token can be found without decoding what precedes it.
Shards are rows of a Parquet table: Spark's committed writer makes retries safe on any store.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from datascry.llm import common
from datascry.llm.annotate import _quoted
from datascry.llm.words import chunks

#: Tokens after which a shard is closed, fewest uses of a rule, and the share of
#: symbols that a round must save for another one to follow.
SHARD_TOKENS, LEAST_USES, LEAST_GAIN = 1 << 20, 4, 1 / 256
MOST_CACHED = 1_500_000
#: Bytes of texts encoded at once (one longer text alone).
AT_ONCE = 1 << 20
_MAGIC = b"RPG1"


# ------------------------------------------------------------ tokens


class Encoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library.

    ``split`` says that it is a byte-level tokenizer that ignores case, never joins what white
    space parts and takes letters as one piece: a text's ids are then
    those of its words, and each word is encoded once and kept.  Else texts are encoded whole.
    """

    def __init__(self, path: str, split: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.split = Tokenizer.from_file(path), split
        self._clear()

    @staticmethod
    def of(path: str, split: bool) -> Encoder:
        """The encoder of this Python process, which later tasks find with its words."""
        kept = sys.modules.setdefault("_datascry_encoders", types.ModuleType("_datascry_encoders")).__dict__
        if (path, split) not in kept:
            kept[path, split] = Encoder(path, split)
        return kept[path, split]

    def _clear(self) -> None:
        self.codes = _Codes()
        self.ids, self.starts, self.used = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 12, dtype=np.int64), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Ids of the words that have got a code since the last time, in the order of codes.

        Letters go to the model straight away, letters with marks after them are
        put together of both, all others go through the library whole."""
        known, tokenize = self.codes, self.tokenizer.model.tokenize
        first = len(known) - len(known.new)
        others: dict[bytes, list[int]] = {}
        parts: list[tuple[bytes, bytes] | None] = []
        for w in known.new:
            m = _MARKED.fullmatch(w)
            parts.append(m and (m[1], m[2]))
            if m is None:
                others[w] = []
            elif m[2]:
                others[m[2]] = []
        for w, ids in zip(others, self._encode([w.decode() for w in others])):
            others[w] = ids
        found: list[list[int]] = []
        cores: dict[bytes, list[int]] = {}
        for w, part in zip(known.new, parts):
            if part is None:
                found.append(others[w])
                continue
            core = part[0].lower() if part[0].isascii() else part[0].decode().lower().encode()
            ids = cores.get(core)
            if ids is None:
                n = known.get(core, first)
                if n < first:
                    ids = self.ids[self.starts[n] : self.starts[n + 1]].tolist()
                else:
                    ids = [t.id for t in tokenize(core.decode() if core.isascii() else core.decode("latin-1").translate(_SHOWN))]
                cores[core] = ids
            found.append(ids + others[part[1]] if part[1] else ids)
        flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(known) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.starts[first + 1 : len(known) + 1] = self.used + np.cumsum(np.fromiter(map(len, found), dtype=np.int64))
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        known.new = []

    def __call__(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.split:
            return [np.array(ids, dtype=np.uint32) for ids in self._encode([t.decode() for t in texts])]
        if len(self.codes) > MOST_CACHED:
            self._clear()
        words = [t.split() for t in texts]  # of bytes: at ASCII white space alone
        n = np.cumsum([len(w) for w in words])
        at = np.fromiter(map(self.codes.__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64, count=int(n[-1]))
        if self.codes.new:
            self._learn()
        starts, ends = self.starts[at], self.starts[at + 1]
        upto = np.append(0, np.cumsum(ends - starts))[np.append(0, n)]
        flat = _gather(self.ids, starts, ends)
        return [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]


class _Codes(dict):
    """Numbers words in the order in which they are met, and lists new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


#: Letters, then marks that open no special token: no piece spans both.
_MARKED = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]*)")
#: Byte-level vocabularies show bytes that are no printable Latin-1 sign by the code points from 256 on.
_SHOWN = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def _gather(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``values[start:end]`` of all spans, one after the other."""
    size = ends - starts
    upto = np.cumsum(size)
    if not len(upto) or not upto[-1]:
        return values[:0]
    return values[np.arange(upto[-1]) + np.repeat(starts - (upto - size), size)]


# ------------------------------------------------------------ grammar


def re_pair(codes: np.ndarray, ends: np.ndarray, n_codes: int, least: int = LEAST_USES, gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``symbols, rules, offsets``: codes below ``n_codes`` with frequent pairs replaced.

    ``ends[d]`` is where document d ends; its last code stays by itself, so no pair
    reaches from one to the next.  In a round every place weighs its pair by the pair's
    frequency, a place outweighing both neighbours is taken, and pairs taken
    ``least`` times become rules.  Symbol ``n_codes + i`` stands for the pair ``rules[i]``.
    """
    seq = codes.astype(np.uint32)
    wall = np.zeros(len(seq), dtype=bool)
    wall[ends - 1] = True
    rules: list[np.ndarray] = []
    size = n_codes
    bits = max(10, min(19, len(seq).bit_length()))
    buckets = 1 << bits
    while len(seq) > 2 * least:
        bucket = (seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
        bucket[wall[:-1] | wall[1:]] = buckets  # of no pair
        uses = np.bincount(bucket, minlength=buckets + 1)
        uses[buckets] = 0
        # a place for each bucket by its uses: the order in which pairs go first
        weight = np.where(uses < least, 0, (uses << bits) + np.arange(buckets + 1))
        mine = weight[bucket]
        top = mine > 0
        top[1:] &= mine[1:] > mine[:-1]
        top[:-1] &= mine[:-1] >= mine[1:]
        taken = np.flatnonzero(top)
        pairs = seq[taken].astype(np.int64) * size + seq[taken + 1]
        found, which, uses = np.unique(pairs, return_inverse=True, return_counts=True)
        kept = uses >= least
        mask = kept[which]
        taken = taken[mask]
        if not len(taken):
            break
        rules.append(np.stack([found[kept] // size, found[kept] % size], axis=1))
        seq[taken] = (size + np.cumsum(kept) - 1)[which[mask]]
        size += int(kept.sum())
        stay = np.ones(len(seq), dtype=bool)
        stay[taken + 1] = False
        seq, wall = seq[stay], wall[stay]
        if len(taken) < gain * len(stay):
            break
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)
    return seq, table, np.append(0, np.flatnonzero(wall) + 1)


def expansion_lengths(rules: np.ndarray, n_codes: int) -> np.ndarray:
    """How many codes each symbol stands for; a rule's sides come before it."""
    out = [1] * n_codes
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return np.array(out, dtype=np.int64)


class Shard:
    """Documents of one shard; ``bytes(shard)`` and ``Shard.read`` are the file format.

    Little-endian: ``RPG1``; numbers of documents, alphabet, rules and symbols and the bytes of a
    symbol (5 uint32); ids (int64), which of them are null (uint8), symbol
    offsets and tokens (uint32); the alphabet, the rules and their expansion lengths (uint32); the symbols.
    """

    def __init__(self, ids, null, offsets, tokens, alphabet, rules, lengths, symbols):
        self.ids, self.null, self.offsets, self.tokens = ids, null, offsets, tokens
        self.alphabet, self.rules, self.lengths, self.symbols = alphabet, rules, lengths, symbols
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def of(ids: Sequence[int | None], documents: Sequence[np.ndarray]) -> Shard:
        tokens = np.array([len(d) for d in documents], dtype=np.int64)
        flat = np.concatenate(documents)
        alphabet, codes = _dense(flat)
        symbols, rules, offsets = re_pair(codes, np.cumsum(tokens), len(alphabet))
        lengths = expansion_lengths(rules, len(alphabet))[len(alphabet) :]
        null = np.array([i is None for i in ids], dtype=np.uint8)
        return Shard(np.array([i or 0 for i in ids], dtype=np.int64), null, offsets, tokens, alphabet, rules, lengths, symbols)

    def __bytes__(self) -> bytes:
        wide = len(self.alphabet) + len(self.rules) > 1 << 16
        head = struct.pack("<5I", len(self.ids), len(self.alphabet), len(self.rules), len(self.symbols), 4 if wide else 2)
        parts = [self.ids.astype("<i8"), self.null, *[x.astype("<u4") for x in (self.offsets, self.tokens, self.alphabet, self.rules, self.lengths)], self.symbols.astype("<u4" if wide else "<u2")]
        return b"".join([_MAGIC, head, *[p.tobytes() for p in parts]])

    @staticmethod
    def read(body: bytes) -> Shard:
        if body[:4] != _MAGIC:
            raise ValueError("no shard of token ids")
        docs, alphabet, rules, symbols, width = struct.unpack_from("<5I", body, 4)
        at, out = 24, []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs + 1), ("<u4", docs), ("<u4", alphabet), ("<u4", 2 * rules), ("<u4", rules), (f"<u{width}", symbols)):
            out.append(np.frombuffer(body, dtype=kind, count=n, offset=at))
            at += out[-1].nbytes
        if at != len(body):
            raise ValueError("a shard of token ids is cut off")
        ids, null, offsets, tokens, alphabet, rules, lengths, symbols = out
        return Shard(ids, null, offsets.astype(np.int64), tokens.astype(np.int64), alphabet, rules.reshape(-1, 2).astype(np.int64), lengths.astype(np.int64), symbols.astype(np.int64))

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of every symbol, one symbol after the other, and where each begins."""
        if self._flat is None:
            n = len(self.alphabet)
            size = np.concatenate([np.ones(n, dtype=np.int64), self.lengths])
            begin = np.append(0, np.cumsum(size))
            flat = np.zeros(begin[-1], dtype=np.uint32)
            flat[:n] = self.alphabet
            # a rule is written once both its sides are: as many rounds as rules are deep
            deep = np.zeros(len(size), dtype=np.int64)
            for i, (a, b) in enumerate(self.rules.tolist(), n):
                deep[i] = 1 + max(deep[a], deep[b])
            for level in range(1, int(deep.max(initial=0)) + 1):
                i = np.flatnonzero(deep == level)
                for side, shift in ((self.rules[i - n, 0], np.zeros(len(i), dtype=np.int64)), (self.rules[i - n, 1], size[self.rules[i - n, 0]])):
                    to = begin[i] + shift
                    flat[_gather(np.arange(len(flat)), to, to + size[side])] = _gather(flat, begin[side], begin[side + 1])
            self._flat = flat, begin
        return self._flat

    def document(self, d: int) -> np.ndarray:
        """All tokens of document d."""
        flat, begin = self._expanded()
        s = self.symbols[self.offsets[d] : self.offsets[d + 1]]
        return _gather(flat, begin[s], begin[s + 1])

    def slice(self, d: int, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end`` of document d: symbols are found by the lengths they
        expand to, and of those at the ends only the needed branch is followed."""
        s = self.symbols[self.offsets[d] : self.offsets[d + 1]]
        n = len(self.alphabet)
        size = np.concatenate([np.ones(n, dtype=np.int64), self.lengths])
        upto = np.cumsum(size[s])
        start, end = max(0, start), min(end, int(upto[-1]) if len(upto) else 0)
        out: list[int] = []
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        first, last = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, end, "left"))
        stack = [(int(x), int(upto[i] - size[x])) for i, x in zip(range(last, first - 1, -1), s[first : last + 1][::-1])]
        while stack:
            x, at = stack.pop()
            if at >= end or at + size[x] <= start:
                continue
            if x < n:
                out.append(int(self.alphabet[x]))
            else:
                a, b = self.rules[x - n].tolist()
                stack += [(b, at + int(size[a])), (a, at)]
        return np.array(out, dtype=np.uint32)


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and each id's place among them."""
    seen = np.zeros(int(ids.max()) + 1, dtype=bool)
    seen[ids] = True
    return np.flatnonzero(seen).astype(np.uint32), (np.cumsum(seen) - 1)[ids]


# ------------------------------------------------------------ tables


SHARDS = "part int, shard int, before long, n_docs int, n_tokens long, body binary"


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, split: bool = False, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Writes the ids of every whole text (null: empty), each with ``end_id`` appended, in
    ascending order of ids: null ids first, ties by a hash of the text.

    ``tokenizer`` is a file that executors can open; ``split`` as in :class:`Encoder`.
    Documents are dealt to tasks by ranges of ids, so a task's shards are consecutive;
    it holds one shard at a time, or one longer document.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(docs[_quoted(id_col)].cast("long").alias("id"), docs[_quoted(text_col)].alias("text"))
    # equal rows may be dealt to several tasks: where they were read tells them apart
    rows = rows.select("id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("place")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder.of(tokenizer, split), np.array([end_id], dtype=np.uint32)
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        part = shard = before = n = 0

        def closed() -> pa.RecordBatch:
            values = [part, shard, before, len(ids), n, bytes(Shard.of(ids, held))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "shard", "before", "n_docs", "n_tokens", "body"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            for lo, hi, data, offsets in chunks(batch.column(2), AT_ONCE):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                for doc, tokens in zip(batch.column(1)[lo:hi].to_pylist(), encode(texts), strict=True):
                    ids.append(doc)
                    held.append(np.append(tokens, end))
                    n += len(held[-1])
                    if n >= shard_tokens:
                        yield closed()
                        shard, before, n = shard + 1, before + n, 0
                        ids, held = [], []
        if ids:
            yield closed()

    dealt.mapInArrow(run, SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the tokens of all shards before: a running sum over parts,
    of which there are no more than partitions when they were written."""
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    earlier = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(base), "part").select("part", "shard", (F.col("base") + F.col("before")).alias("start"), "body")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and ``ids`` (array, unless left out) of each
    document, decoded from the shards."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Shard.read(body.as_py())
                sums, all_ids = [], []
                for d in range(len(s.ids)):
                    ids = s.document(d)
                    if len(ids) != s.tokens[d]:
                        raise ValueError("a shard does not hold as many tokens as it says")
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if with_ids:
                        all_ids.append(ids.astype(np.int64))
                starts = start + np.cumsum(s.tokens) - s.tokens
                arrays = [pa.array(s.ids, mask=s.null.astype(bool)), pa.array(starts), pa.array(s.tokens), pa.array(sums, pa.int64())]
                if with_ids:
                    arrays.append(pa.array(all_ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split(" ")[0] for f in fields.split(", ")])

    return read_shards(spark, path).select("start", "body").mapInArrow(run, fields)
