"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each slot, one bit for each language; the
AND of an n-gram's slots is the set of all languages that contain it.  A text's
n-grams are looked up at once, the bits of each language are counted, the
counts are corrected for that language's false positives, and the largest
share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascry.llm import annotate
from datascry.llm import words as w

UNKNOWN = "und"
_U = np.uint64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the CRC-32 of the id as text falls to the held-out part (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(base, codes, bounds, plain)``: the 4-byte grams of lower-cased texts, and
    whether each text has an ASCII letter.

    Bytes that belong to no letter count as spaces.  Grams whose middle bytes
    are spaces are left out, so a gram never reaches over a gap.
    """
    column = column.fill_null("") if column.null_count else column
    for base, _, data, offsets in w.chunks(pc.utf8_lower(column)):
        letter = _LETTER[data]
        clean = np.where(letter, data, np.uint8(0x20)).astype(np.uint32)
        n = max(0, len(data) - 3)
        code = clean[:n] | clean[1 : n + 1] << np.uint32(8) | clean[2 : n + 2] << np.uint32(16) | clean[3 : n + 3] << np.uint32(24)
        ok = letter[1 : n + 1] & letter[2 : n + 2]
        for back in (1, 2, 3):
            at = offsets[1:-1] - back
            ok[at[(at >= 0) & (at < n)]] = False
        total = np.concatenate([[0], np.cumsum(ok)])
        plain = np.concatenate([[0], np.cumsum(letter & (data < 0x80))])
        yield base, code[ok], total[np.minimum(offsets, n)], plain[offsets[1:]] > plain[offsets[:-1]]


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, gram, n`` of batches of ``lang, text``."""
    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column(1).filter(pc.equal(langs, lang))
            for _, codes, _, _ in grams(texts):
                gram, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )


@dataclass
class Filters:
    """``slots[word, slot]``: bit l % 64 of word l // 64 stands for language l."""

    langs: list[str]
    slots: np.ndarray
    hashes: int
    false_positive: np.ndarray

    @staticmethod
    def build(members: dict[str, np.ndarray], bits: int = 18, hashes: int = 2) -> Filters:
        langs = sorted(members)
        slots = np.zeros(((len(langs) + 63) // 64, 1 << bits), dtype=_U)
        fill = []
        for i, lang in enumerate(langs):
            used = np.zeros(1 << bits, dtype=bool)
            for at in _places(members[lang], bits, hashes):
                used[at] = True
            slots[i // 64, used] |= _U(1) << _U(i % 64)
            fill.append(used.mean())
        return Filters(langs, slots, hashes, np.array(fill) ** hashes)

    def languages(self, codes: np.ndarray) -> np.ndarray:
        """Bitmask, in words of 64 languages, of all languages that contain each gram."""
        bits = int(self.slots.shape[1]).bit_length() - 1
        out = None
        for at in _places(codes, bits, self.hashes):
            found = self.slots[:, at]
            out = found if out is None else out & found
        return out

    def shares(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text and language, the corrected share of its grams."""
        masks = self.languages(codes)
        n = np.maximum(np.diff(bounds), 1)
        out = np.zeros((len(n), len(self.langs)))
        for i in range(len(self.langs)):
            hit = (masks[i // 64] >> _U(i % 64)) & _U(1)
            total = np.concatenate([[0], np.cumsum(hit.astype(np.int64))])
            seen = (total[bounds[1:]] - total[bounds[:-1]]) / n
            out[:, i] = np.clip((seen - self.false_positive[i]) / (1 - self.false_positive[i]), 0, 1)
        return out


def _places(codes: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    mixed = w._mixed(codes.astype(_U) + _U(1))
    for i in range(hashes):
        yield ((mixed >> _U(i * bits)) & _U((1 << bits) - 1)).astype(np.int64)


def learn(train: DataFrame, docs_per_language: int = 2000, grams_per_language: int = 6000, bits: int = 18) -> Filters:
    """Filters from ``lang, text`` rows.

    About ``docs_per_language`` texts of each language are used, those with
    the least hashes; of a language's grams, the ``grams_per_language`` most
    frequent enter its slice.  Both bounds keep the model's size fixed.
    """
    rows = train.filter("lang is not null and text is not null").select("lang", "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    # the upper 53 bits of a hash of the text, as a number from 0 to 1
    draw = F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 11) / F.lit(float(1 << 53))
    sample = rows.join(F.broadcast(counts), "lang").filter(draw * F.col("docs") < docs_per_language).select("lang", "text")
    counted = sample.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, grams_per_language).alias("top")
    )
    members = {r.lang: np.array([x.gram for x in r.top], dtype=np.int64) for r in top.collect()}
    return Filters.build(members, bits)


FIELDS = "lang_pred string, score double"


def _predicted(column: pa.Array, filters: Filters) -> list[pa.Array]:
    names, scores = [], []
    for base, codes, bounds, plain in grams(column):
        n = len(bounds) - 1
        if not filters.langs:
            names += [UNKNOWN] * n
            scores.append(np.zeros(n))
            continue
        share = filters.shares(codes, bounds)
        best = share.argmax(axis=1)
        score = share[np.arange(n), best]
        for i, lettered in enumerate(plain.tolist()):
            if not lettered:
                # what lies beyond ASCII may be signs alone
                lettered = any(c.isalpha() for c in column[base + i].as_py() or "")
            names.append(filters.langs[best[i]] if lettered else UNKNOWN)
            score[i] *= lettered
        scores.append(score)
    return [pa.array(names, pa.string()), pa.array(np.concatenate(scores))]


def predict(docs: DataFrame, filters: Filters, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with ``lang_pred`` and ``score``, 0 to 1.

    Only the text is looked at.  Null texts, and texts without a letter, are
    ``und`` with score 0; a text whose grams no language knows gets the first
    language with score 0; ties go to the first name.  With no language
    learned all are ``und``.  Clashing new columns get leading underscores.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)  # a fixed number of slots
    return annotate.add_columns(docs, "text", lambda c: _predicted(c, model.value), FIELDS, keep)
