"""Exact n-gram Jaccard self-join by universe-partition pigeonhole.

Two sets of at least Jaccard t differ in at most H tokens.  Tokens are hashed
into m segments, m by size band; if one side's segments could between them
absorb more than H differences, the two sets must agree in a segment, or (in the
small bands) differ in one by one token, which one-deletion neighbourhoods
find.  So each set is indexed under its segment subsets, and in small bands
under those less one token.  Signatures of one set alone are dropped, the others
have their cost, the number of sets that hold them, and each set keeps only its
H + 1 cheapest counting the lone ones, which still cannot miss a partner.  Sets
whose tokens fall too unevenly for the guarantee meet by prefix filtering.
Candidates pass an exact bitmap bound and are then verified token by token.

Pairs within a signature's group are never all emitted.  A star around each
group's least set comes first.  Then, in rounds, some sets outside the group's
largest component meet all others that are in other components than they are,
and are done; so is a group of one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datascry.llm import annotate, common
from datascry.llm import words as w
from datascry.llm.components import components

_U = np.uint64
#: Bits of the exact bitmap bound: for all sets in stars, for all in the rounds
#: that follow, and there for sets of at least :data:`LARGE` tokens.
BITMAP, WIDE, WIDEST, LARGE = 256, 1024, 4096, 1024
#: Bits of the prefilter for wanted sets, and most sets that a task remembers.
FILTER_BITS, REMEMBERED = 1 << 26, 1 << 18
#: Documents sampled to find signatures that very many sets have, and parts of each.
SAMPLE, PARTS = 20_000, 64
#: Centres that a group gives in each round, by hash, and from the last on.
CENTRES = (4, 64, 1024)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(base, tokens, bounds)``: sorted distinct shingle hashes of each text."""
    for base, _, data, offsets in w.chunks(column):
        part = w.Texts(data, offsets, w.WORD, lower=True)
        codes = part.hashes()
        gram = w.grams(codes, k)
        sets = []
        for a, b in zip(part.first[:-1].tolist(), part.first[1:].tolist(), strict=True):
            if b - a >= k:
                sets.append(np.unique(gram[a : b - k + 1]))
            elif b > a:
                sets.append(w.word_spans(codes, np.array([a]), np.array([b])))
            else:
                sets.append(codes[:0])
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        yield base, np.concatenate(sets), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def node_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set, by its content."""
    return w._mixed(_sums(w._mixed(tokens), bounds) + np.diff(bounds).astype(_U)) >> _U(1)


class Scheme:
    """Size bands of ratio ``ratio`` and, for each, its segments and threshold.

    ``percent`` is the Jaccard bound.  Band b is for pairs whose smaller set has
    ``edges[b]`` to ``edges[b + 1] - 1`` tokens; a larger set also enters the
    band below its own if it can have partners there.
    """

    def __init__(self, percent: int = 80, ratio: float = 1.6, deletion_below: int = 32, largest: int = 1 << 40):
        self.percent = percent
        edges = [1]
        while edges[-1] < largest:
            edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
        self.edges = np.array(edges, dtype=np.int64)
        top = self.edges[1:] - 1
        worst = self.differences(top, self.partner(top))
        self.deletes = top < deletion_below
        # without deletions, room for segments left empty by chance
        spare = np.ceil(worst * 0.12 + 2 * np.sqrt(worst) * 0.5 + 2).astype(np.int64)
        self.segments = np.where(self.deletes, (worst + 2) // 2, worst + 1 + spare)

    def differences(self, a, b):
        """Most tokens in one of two linked sets of these sizes but not in both."""
        p = self.percent
        return (a + b) * (100 - p) // (100 + p)

    def partner(self, n):
        """Size of the largest set that one of n tokens can be linked with."""
        return n * 100 // self.percent

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1

    def roles(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For the own band and the one below: which sets enter, band, and H."""
        own = self.bands(sizes)
        below = np.maximum(own - 1, 0)
        least = self.edges[own]
        enters = (own > 0) & (self.partner(least - 1) >= sizes)
        return [
            (sizes > 0, own, self.differences(sizes, self.partner(sizes))),
            (enters, below, self.differences(sizes, np.minimum(least - 1, sizes))),
        ]

    def _segments(self, tokens: np.ndarray, bounds: np.ndarray):
        """For each role: which tokens enter, their sets and where segments start,
        and for each set whether it enters, its band, its room (differences that
        its segments absorb) and H."""
        sizes = np.diff(bounds)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        for enters, band, most in self.roles(sizes):
            pick = enters[rows]
            tok, row = tokens[pick], rows[pick]
            m = self.segments[band][row].astype(_U)
            segment = ((tok >> _U(32)) * m) >> _U(32)  # rises with the token
            new = np.ones(len(tok), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(tok)))
            who = row[start]
            room = np.bincount(who, np.where(self.deletes[band][who], np.minimum(size, 2), 1), len(sizes)).astype(np.int64)
            yield pick, row, segment, start, size, enters, band, room, most

    def budgets(self, tokens: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """For each role: signatures a set may keep beyond those it shares with no
        other; sets that must keep all have a budget beyond any count."""
        for *_, band, room, most in self._segments(tokens, bounds):
            yield np.where(self.deletes[band] | (room <= most), np.int64(1 << 40), most + 1 - room)

    def signatures(self, tokens: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each role: set of each signature, and the signatures."""
        sizes = np.diff(bounds)
        values = w._mixed(tokens ^ _U(0x5851F42D4C957F2D))
        for pick, row, segment, start, size, enters, band, room, most in self._segments(tokens, bounds):
            val, who = values[pick], row[start]
            total = _sums(val, np.append(start, len(val))) if len(start) else val[:0]
            salt = w._mixed(band[who].astype(_U) * _U(1 << 32) + segment[start] + _U(1))
            exact = w._mixed(total + salt)
            inner = np.repeat(np.arange(len(start)), size)
            drop = self.deletes[band][row] & (size[inner] > 1)
            less = w._mixed(total[inner[drop]] - val[drop] + salt[inner[drop]])
            sets, sigs = np.concatenate([who, row[drop]]), np.concatenate([exact, less])
            # too uneven for the guarantee: prefix tokens too, in a namespace of the band's own
            short = np.flatnonzero(enters & (room <= most))
            extra_rows, extra = [], []
            for i in short.tolist():
                n = int(sizes[i])
                mine = tokens[bounds[i] : bounds[i] + n - -(-n * self.percent // 100) + 1]
                extra_rows.append(np.full(len(mine), i))
                extra.append(w._mixed(mine + w._mixed(np.array([band[i] + (1 << 20)], dtype=_U))))
            if extra:
                sets, sigs = np.concatenate([sets, *extra_rows]), np.concatenate([sigs, *extra])
            yield sets, sigs


class Worker:
    """What executors do with texts; ``wanted`` is the bitmap of wanted sets."""

    def __init__(self, scheme: Scheme, k: int):
        self.scheme, self.k = scheme, k

    def members(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list]]:
        """Set name and size, and its budget in each role."""
        for base, tokens, bounds in shingle_sets(column, self.k):
            n = np.diff(bounds)
            yield base + np.arange(len(n)), [w.signed(node_ids(tokens, bounds)), n, *self.scheme.budgets(tokens, bounds)]

    def index(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``sig, who`` (name times two, plus the role); most copies of a set in a task come once."""
        seen: set[int] = set()
        for batch in batches:
            for _, tokens, bounds in shingle_sets(batch.column(0), self.k):
                tokens, bounds, names = self._unseen(tokens, bounds, seen)
                for role, (sets, sigs) in enumerate(self.scheme.signatures(tokens, bounds)):
                    who = names[sets] * _U(2) + _U(role)
                    for lo in range(0, len(sigs), 1 << 17):
                        part = slice(lo, lo + (1 << 17))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(w.signed(sigs[part])), pa.array(w.signed(who[part]))], names=["sig", "who"]
                        )

    def sets(self, batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sorted tokens and bitmaps of the sets that ``wanted`` may hold."""
        seen: set[int] = set()
        for batch in batches:
            for _, tokens, bounds in shingle_sets(batch.column(0), self.k):
                tokens, bounds, names = self._unseen(tokens, bounds, seen)
                at = (names % _U(FILTER_BITS)).astype(np.int64)
                hit = (wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                out = np.flatnonzero((hit > 0) & (np.diff(bounds) > 0))
                if len(out):
                    sets = [tokens[bounds[i] : bounds[i + 1]] for i in out.tolist()]
                    wide = [_bitmap(x, WIDEST) for x in sets]
                    narrow = w.signed(np.array([_narrowed(x, BITMAP) for x in wide]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(w.signed(names[out])),
                            pa.array([w.signed(s) for s in sets], pa.list_(pa.int64())),
                            *[pa.array(b) for b in narrow.T.copy()],
                            pa.array([w.signed(_narrowed(x, WIDE)) for x in wide], pa.list_(pa.int64())),
                            pa.array([w.signed(x) if len(s) >= LARGE else None for s, x in zip(sets, wide, strict=True)], pa.list_(pa.int64())),
                        ],
                        names=["node", "tokens", "b0", "b1", "b2", "b3", "wide", "widest"],
                    )

    @staticmethod
    def _unseen(tokens: np.ndarray, bounds: np.ndarray, seen: set[int]):
        """Without the sets that ``seen`` remembers; it forgets all once it is full."""
        names = node_ids(tokens, bounds)
        fresh = np.zeros(len(names), dtype=bool)
        for i, name in enumerate(names.tolist()):
            if name not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                fresh[i] = True
        if fresh.all():
            return tokens, bounds, names
        size = np.diff(bounds)
        return (
            tokens[np.repeat(fresh, size)],
            np.concatenate([[0], np.cumsum(size[fresh])]),
            names[fresh],
        )


SETS = "node long, tokens array<long>, b0 long, b1 long, b2 long, b3 long, wide array<long>, widest array<long>"


def _bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the tokens in each of ``bits`` cells: sets that differ in d tokens
    differ in at most d bits."""
    cell = (w._mixed(tokens ^ _U(0x2545F4914F6CDD1D)) % _U(bits)).astype(np.int64)
    odd = np.bincount(cell, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _narrowed(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of fewer bits, a divisor of the width."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, bits // 64), axis=0)


def _bitmap_of(nodes: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits (8 MB), set for the names in ``nodes``; made on the
    executors, its size the same for any input."""
    per = 32768  # bits of one bitmap of bitmap_construct_agg
    at = F.col("node") % FILTER_BITS
    rows = (
        nodes.select(F.floor(at / per).cast("int").alias("bucket"), (at % per).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:
        out[r.bucket * per // 8 : (r.bucket + 1) * per // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def _room(percent: int, differ: Column) -> Column:
    """Sets ``a`` and ``b`` that differ in ``differ`` tokens or more may meet the bound."""
    return differ * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)


def _sizes_close(percent: int) -> Column:
    a, b = F.col("a.n"), F.col("b.n")
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _bits_apart(names: list[str]) -> Column:
    apart = [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in names]
    return sum(apart[1:], apart[0])


def _arrays_apart(name: str) -> Column:
    each = F.zip_with(F.col(f"a.{name}"), F.col(f"b.{name}"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` (and what else their rows have) that meet the bound, by their tokens."""
    one = sets.select(F.col("node").alias("u"), F.col("tokens").alias("tu"))
    two = sets.select(F.col("node").alias("v"), F.col("tokens").alias("tv"))
    both = F.size(F.array_intersect("tu", "tv"))
    either = F.size("tu") + F.size("tv") - both
    return pairs.join(one, "u").join(two, "v").filter(100 * both >= percent * either).select(*pairs.columns)


def _heavy(docs: DataFrame, worker: Worker, n_docs: int) -> DataFrame:
    """Signatures that about a thousandth of all documents have, from a sample of
    about :data:`SAMPLE` documents: so many at most that they can be broadcast.

    They only decide how rows are dealt, not what comes out.
    """
    sample = docs.select("text").sample(min(1.0, SAMPLE / max(n_docs, 1)), 5)
    counts = sample.mapInArrow(worker.index, "sig long, who long").groupBy("sig").agg(F.count(F.lit(1)).alias("held"))
    return counts.filter(F.col("held") >= max(SAMPLE // 1000, 4)).select("sig", F.lit(True).alias("heavy"))


def _index(docs: DataFrame, worker: Worker, n_docs: int) -> DataFrame:
    """``sig, node, role, cost`` of signatures that several sets have; cost is about
    the number of those.

    Each signature's rows are counted where they meet.  Those of heavy ones meet in
    :data:`PARTS` parts, whose counts are then summed.
    """
    heavy = F.broadcast(common.cut(_heavy(docs, worker, n_docs), "jaccard-heavy"))
    part = F.when(F.col("heavy"), F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")).otherwise(F.lit(-1))
    met = W.partitionBy("sig", "part")
    rows = (
        docs.select("text")
        .mapInArrow(worker.index, "sig long, who long")
        .join(heavy, "sig", "left")
        .select("sig", "who", F.shiftrightunsigned("who", 1).alias("node"), "heavy")
        .select("sig", "who", "node", part.alias("part"))
        .withColumns({"least": F.min("node").over(met), "most": F.max("node").over(met), "cost": F.count("node").over(met)})
        .filter("part >= 0 or least < most")
        .select("sig", "who", "node", "part", "least", "most", "cost")
    )
    rows = common.cut(rows, "jaccard-signatures")
    # one row for each heavy signature
    sums = (
        rows.filter("part >= 0")
        .groupBy("sig", "part")
        .agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("cost").alias("cost"))
        .groupBy("sig")
        .agg(F.min("least").alias("first"), F.max("most").alias("last"), F.sum("cost").alias("sum"))
    )
    sums = common.cut(sums, "jaccard-heavy-sums")
    return rows.join(F.broadcast(sums), "sig", "left").filter("part < 0 or first < last").select(
        "sig", "node", F.col("who").bitwiseAND(F.lit(1)).alias("role"), F.coalesce("sum", "cost").alias("cost")
    )


def _open_groups(rows: DataFrame) -> DataFrame:
    """``rows`` of groups that are not one component yet, written out.

    What is known of a group is written before it is joined with its rows, here
    and in :func:`_centres`: only then can Spark deal a very large group's rows
    to many tasks.
    """
    rows = common.cut(rows, "jaccard-placed")
    mixed = rows.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    mixed = common.cut(mixed.select("sig"), "jaccard-mixed")
    out = common.cut(rows.join(mixed, "sig", "left_semi"), "jaccard-open")
    common.drop_path(rows.sparkSession, rows.scratch_path)
    common.drop_path(rows.sparkSession, mixed.scratch_path)
    return out


def _renamed(df: DataFrame, names: DataFrame | None, column: str, to: str) -> DataFrame:
    """``df`` with ``to``: what ``names`` (``component, into``) has for a column, else the column."""
    if names is None:
        return df.withColumn(to, F.col(column))
    new = names.select(F.col("component").alias(column), F.col("into").alias(to))
    return df.join(new, column, "left").withColumn(to, F.coalesce(to, column))


def _centres(rows: DataFrame, counts: DataFrame, names: DataFrame | None, done: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` sets of each group outside its largest component that have not been
    centres before (``done``), one from each of so many parts by hash.

    ``counts`` has the sets of each component in each group, by the names that
    components had in ``rows``; ``names`` has what became of those.
    """
    now = _renamed(counts, names, "component", "into")
    held = now.groupBy("sig", "into").agg(F.sum("held").alias("held"))
    main = held.groupBy("sig").agg(F.max_by("into", F.struct("held", "into")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    outside = common.cut(now.join(main, "sig").filter("into <> main").select("sig", "component"), "jaccard-outside")
    left = rows.select("sig", "node", "component").join(outside, ["sig", "component"]).select("sig", "node")
    left = left.join(done, ["sig", "node"], "left_anti")
    out = left.groupBy("sig", F.pmod(F.xxhash64("node"), F.lit(most)).alias("part")).agg(F.min("node").alias("node")).select("sig", "node")
    return common.cut(out, "jaccard-centres")


def link_sets(docs: DataFrame, k: int = 5, percent: int = 80, scheme: Scheme | None = None):
    """``(members, links)``: ``doc_id, node, n`` of each row, and links ``u, v``
    between names of sets, enough to connect all that are linked."""
    spark = docs.sparkSession
    worker = Worker(scheme or Scheme(percent), k)
    members = common.cut(
        annotate.emit_rows(docs.select("doc_id", "text"), "text", ["doc_id"], worker.members, "node long, n long, keep0 long, keep1 long"),
        "jaccard-members",
    )
    index = _index(docs, worker, members.count()).distinct()
    sizes = members.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("keep0").alias("keep0"), F.first("keep1").alias("keep1"))
    mine = W.partitionBy("node", "role")
    # lone signatures are the cheapest: of H + 1, what they leave
    budget = F.when(F.col("role") == 0, F.col("keep0")).otherwise(F.col("keep1")) + F.count("sig").over(mine)
    kept = (
        index.join(sizes, "node")
        .withColumn("budget", budget)
        .withColumn("rank", F.row_number().over(mine.orderBy("cost", "sig")))
        .filter("rank <= budget")
        .select("sig", "node", "n")
        .distinct()
    )
    kept = common.cut(kept, "jaccard-kept")
    wanted = spark.sparkContext.broadcast(_bitmap_of(kept.select("node").distinct()))
    sets = common.cut(
        docs.select("text")
        .mapInArrow(lambda batches: worker.sets(batches, wanted.value), SETS)
        .dropDuplicates(["node"])
        .join(kept.select("node").distinct(), "node", "left_semi"),
        "jaccard-sets",
    )
    narrow = ["b0", "b1", "b2", "b3"]
    bits = sets.select("node", *narrow)
    groups = common.cut(kept.join(bits, "node"), "jaccard-groups")

    # first a star in each group: its least set against the others
    least = groups.groupBy("sig").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    least = common.cut(least, "jaccard-least")
    centre = least.join(kept, ["sig", "node"]).join(bits, "node")
    stars = (
        centre.alias("a")
        .join(groups.alias("b"), F.col("a.sig") == F.col("b.sig"))
        .filter((F.col("a.node") < F.col("b.node")) & _sizes_close(percent) & _room(percent, _bits_apart(narrow)))
        .select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
        .distinct()
    )
    links = [common.cut(_verified(stars, sets, percent), "jaccard-stars")]

    # then rounds among sets that no path of links connects yet
    part = components(links[0])
    placed = kept.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    wide = sets.select("node", *[F.col("wide")[i].alias(f"w{i}") for i in range(WIDE // 64)], "widest")
    names = [f"w{i}" for i in range(WIDE // 64)]
    placed = _open_groups(placed)
    rows = common.cut(placed.join(wide, "node"), "jaccard-rows")
    common.release(spark, groups, kept, placed)
    # rows stay as they are; what changes is the names of their components
    counts = common.cut(rows.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("held")), "jaccard-counts")
    into: DataFrame | None = None
    done = least.select("sig", "node")  # these have met all others
    turn = 0
    while True:
        centres = _centres(rows, counts, into, done, CENTRES[min(turn, len(CENTRES) - 1)])
        if centres.isEmpty():
            break
        met = (
            rows.join(centres, ["sig", "node"])
            .alias("a")
            .join(rows.alias("b"), F.col("a.sig") == F.col("b.sig"))
            .filter(
                (F.col("a.component") != F.col("b.component"))
                & _sizes_close(percent)
                & _room(percent, _bits_apart(names))
                & F.coalesce(_room(percent, _arrays_apart("widest")), F.lit(True))
            )
        )
        # components go with the pair, so that only their names need merging
        first = F.col("a.node") < F.col("b.node")
        met = met.select(
            *[F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(u) for c, u in (("node", "u"), ("component", "c"))],
            *[F.when(first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(v) for c, v in (("node", "v"), ("component", "d"))],
        ).distinct()
        met = _renamed(_renamed(met, into, "c", "cu"), into, "d", "cv").filter("cu <> cv").select("u", "v", "cu", "cv")
        found = common.cut(_verified(met, sets, percent), "jaccard-links")
        done = common.cut(done.unionByName(centres), "jaccard-done")
        if not found.isEmpty():
            links.append(found.select("u", "v"))
            merged = components(found.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
            merged = merged.select(F.col("node").alias("component"), F.col("component").alias("into")).filter("component <> into")
            if into is not None:
                older = into.select("component", F.col("into").alias("was"))
                merged = _renamed(older, merged, "was", "into").select("component", "into").unionByName(merged)
            into = common.cut(merged, "jaccard-into")
        turn += 1
    common.release(spark, sets, rows)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return members, out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, scheme: Scheme | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``.

    A document's set is that of its distinct k-word shingles, ASCII letters
    lower-cased; one of fewer words has its whole sequence as its only
    shingle.  Documents link where ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest doc_id reachable by links.

    Null texts and texts without words have empty sets and link with nothing,
    so they are their own component.  Rows with a null id link like others,
    but never name a component (null if there is no other name).  Rows that
    share an id are joined only by what their texts link.  An empty table
    gives no rows; other columns are ignored.  Tokens are known by hashes
    modulo 2**61 - 1 and whole sets by 63 bits over them.
    """
    members, links = link_sets(docs, k, percent, scheme)
    part = components(links)
    named = (
        members.filter("n > 0")
        .join(part, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("doc_id", "n", "component")
    )
    named = common.cut(named, "jaccard-named")
    # written, so that the join below can deal a very large component to many tasks
    names = common.cut(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-names")
    empty = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest id; null ids stay.

    Of rows that repeat an id, those of the component that bears it stay.
    """
    marks = near_duplicates(docs, k, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(marks, docs["doc_id"] == marks["gone"], "left_anti")
