"""Packing of tokenised documents into fixed windows by non-negative least squares.

A document is its token ids and an end id.  It gives whole windows and a remainder
shorter than one.  The histogram of remainder lengths has fewer entries than a window has
tokens, however many documents there are, and everything planned on the driver is of
that size.

1. *Combinations*: all pairs and triples of lengths that fill a window exactly.
2. *Non-negative least squares*: coordinate descent finds repeat counts ``x >= 0`` that
   minimise ``|A x - histogram|``, column j of A holding the lengths of combination j.
3. *Rounding*, largest counts first, never beyond what the histogram still has.
4. *Residuals*: greedy best-fit-decreasing combinations that fill a window exactly, as often
   as lengths allow; what is left is laid end to end and cut at window ends.  The last, partial
   window becomes windows of powers of two, so nothing is padded.

A document's place then follows from its length and its rank among documents of that
length.  Ranks are taken in salted groups, so that one length may hold most documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.staging import materialize, share, shared, shuffle_partitions
from geoloom.llm.tokens import default_vocabulary, encoder


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Pairs and triples, in ascending order, of the given lengths that sum to the window."""
    have, ordered = set(lengths), sorted(set(lengths))
    pairs = [(a, window - a) for a in ordered if 2 * a <= window and window - a in have]
    triples = [(a, b, window - a - b) for i, a in enumerate(ordered) if 3 * a <= window for b in ordered[i:] if a + 2 * b <= window and window - a - b in have]
    return pairs + triples


def nnls(columns: list[tuple[int, ...]], target: dict[int, int], sweeps: int = 10_000, tolerance: float = 0.25) -> list[float]:
    """Coordinate descent for ``min |A x - target|, x >= 0``; a column lists its lengths, repeats included.

    A sweep visits the columns that still break an optimum's conditions, and none is left at the end: no column could take more
    than ``tolerance`` documents of its lengths, nor should one in use give back more.  ``sweeps`` only guards against an endless loop.
    """
    if not columns:
        return []
    at = {k: i for i, k in enumerate(target)}
    left = [float(v) for v in target.values()]
    weights = [[(at[a], c.count(a)) for a in dict.fromkeys(c)] for c in columns]
    norms = [sum(m * m for _, m in w) for w in weights]
    width = max(map(len, weights))
    rows = np.array([[i for i, _ in w] + [len(left)] * (width - len(w)) for w in weights])
    times = np.array([[m for _, m in w] + [0] * (width - len(w)) for w in weights])
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        pull = (np.append(left, 0.0)[rows] * times).sum(axis=1)
        now = np.array(x)
        broken = np.flatnonzero((pull > tolerance) | (now > 0) & (pull < -tolerance))
        if not len(broken):
            break
        for j in broken.tolist():
            w = weights[j]
            step = sum(m * left[i] for i, m in w) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                for i, m in w:
                    left[i] -= m * step
    return x


@dataclass
class Plan:
    """Where the document of rank k among those with remainder r goes.

    ``slots``: (r, first rank, past rank, first sequence, offset).  ``stream``: (r, first rank,
    past rank, position of the first).  ``bounds``: where the stream's last, short windows begin
    and end; before them each window is full.
    """

    window: int
    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    stream: list[tuple[int, int, int, int]] = field(default_factory=list)
    bounds: list[int] = field(default_factory=lambda: [0])
    stream_base: int = 0

    def segment(self, pos: int) -> tuple[int, int, int]:
        """The sequence, its first position and its end, for a position of the stream."""
        if pos < self.bounds[0]:
            n = pos // self.window
            return self.stream_base + n, n * self.window, (n + 1) * self.window
        i = bisect_right(self.bounds, pos) - 1
        return self.stream_base + self.bounds[0] // self.window + i, self.bounds[i], self.bounds[i + 1]


def make_plan(histogram: dict[int, int], window: int) -> Plan:
    """A plan for all remainders; the histogram maps a length, 1 to window-1, to its documents."""
    counts = {r: c for r, c in histogram.items() if r and c}
    plan, used, sequence = Plan(window), dict.fromkeys(counts, 0), 0

    def take(combo: tuple[int, ...], times: int) -> None:
        nonlocal sequence
        offset = 0
        for r in combo:
            plan.slots.append((r, used[r], used[r] + times, sequence, offset))
            used[r] += times
            counts[r] -= times
            offset += r
        sequence += times

    columns = combinations(list(counts), window)
    repeats = nnls(columns, counts)
    for j in sorted(range(len(columns)), key=lambda i: (-repeats[i], i)):
        if repeats[j] < 0.5:
            break
        combo = columns[j]
        times = min(round(repeats[j]), *(counts[a] // combo.count(a) for a in combo))
        if times > 0:
            take(combo, times)

    for r in sorted(counts, reverse=True):
        while counts[r] > 0:
            combo, gap, rest = [r], window - r, {**counts, r: counts[r] - 1}
            for s in sorted((s for s, c in counts.items() if c > 0 and s <= gap), reverse=True):
                while s <= gap and rest[s] > 0:
                    combo.append(s)
                    rest[s] -= 1
                    gap -= s
            if gap:
                break
            take(tuple(combo), min(counts[a] // combo.count(a) for a in set(combo)))
        if counts[r] > 0:
            plan.stream.append((r, used[r], used[r] + counts[r], 0))
            counts[r] = 0
    position, laid = 0, []
    for r, lo, hi, _ in plan.stream:
        laid.append((r, lo, hi, position))
        position += r * (hi - lo)
    plan.stream, plan.stream_base = laid, sequence
    plan.bounds = [position // window * window]
    rest = position - plan.bounds[0]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            plan.bounds.append(plan.bounds[-1] + (1 << bit))
    return plan


def _tokenise(path: str, window: int, whole: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], dtype="<u4")
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                n, crcs, rest_crc, ids = [], [], [], []
                for text in part.column(2).to_pylist():
                    x = np.concatenate([encode(text or ""), end]).astype("<u4")
                    full = len(x) // window * window
                    n.append(len(x))
                    crcs.append([zlib.crc32(x[i : i + window].tobytes()) for i in range(0, full, window)])
                    rest_crc.append(zlib.crc32(x[full:].tobytes()))
                    ids.append((x if whole else x[full:]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest_crc, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "row", "n", "crcs", "rest_crc", "ids"],
                )

    return run


def _place(plan_of, window: int, first_seq: int, cut: bool, whole: bool):
    """Pieces of ranked documents.  Without ids only what is not cut is placed (``cut`` False) or else only what is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared(plan_of)
        slots = sorted(plan.slots)
        keys = [(s[0], s[1]) for s in slots]
        stream = {s[0]: s for s in plan.stream}
        for batch in batches:
            out: list[tuple] = []
            for d in batch.to_pylist():
                n, ids, start0 = d["n"], d["ids"], 0 if whole else d["n"] // window * window
                full, r = divmod(n, window)

                def piece(start, length, seq, offset, crc, d=d, ids=ids, start0=start0, n=n):
                    raw = None
                    if ids is not None:
                        raw = ids[4 * (start - start0) : 4 * (start - start0 + length)]
                        crc = zlib.crc32(raw)
                    out.append((d["doc_id"], start, length, crc, n, seq, offset, raw if whole else None))

                if whole or not cut:
                    for i in range(full):
                        if whole:
                            piece(i * window, window, d["f"] + i, 0, None)
                        else:
                            out.append((d["doc_id"], i * window, window, d["crcs"][i], n, d["f"] + i, 0, None))
                if not r:
                    continue
                lane = stream.get(r)
                if lane is None or d["k"] < lane[1]:
                    if whole or not cut:
                        i = bisect_right(keys, (r, d["k"])) - 1
                        _, lo, _, seq, offset = slots[i]
                        piece(full * window, r, first_seq + seq + d["k"] - lo, offset, d["rest_crc"])
                    continue
                pos = lane[3] + (d["k"] - lane[1]) * r
                seq, begin, stop = plan.segment(pos)
                if pos + r <= stop:
                    if whole or not cut:
                        piece(full * window, r, first_seq + seq, pos - begin, d["rest_crc"])
                elif whole or cut:
                    at = pos
                    while at < pos + r:
                        seq, begin, stop = plan.segment(at)
                        size = min(stop, pos + r) - at
                        piece(full * window + at - pos, size, first_seq + seq, at - begin, None)
                        at += size
            for a in range(0, len(out), 5000):
                cols = list(zip(*out[a : a + 5000], strict=True))
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def _is_cut(plan: Plan, window: int):
    """A column: the remainder of this ranked document crosses a window's end."""
    if not plan.stream:
        return F.lit(False)
    lanes = F.create_map(*[x for r, lo, _, base in plan.stream for x in (F.lit(r), F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(base).cast("long").alias("base")))])
    lane = F.try_element_at(lanes, F.col("r").cast("int"))
    pos = lane["base"] + (F.col("k") - lane["lo"]) * F.col("r")
    crosses = (pos % window + F.col("r") > window) | (pos + F.col("r") > plan.bounds[0])
    return lane.isNotNull() & (F.col("k") >= lane["lo"]) & crosses


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Every id of every input row lies in exactly one piece.  Null and empty texts have the
    end id alone.  Rows with null or repeated ids are packed as documents of their own.
    ``ids`` are little-endian unsigned 32-bit ids.  Sequences are full windows, but for the last
    few, whose lengths are powers of two.  An empty table gives no pieces; other columns
    are ignored.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    table = materialize(src.mapInArrow(_tokenise(path, window, with_ids, end_id), "doc_id long, row long, n long, crcs array<long>, rest_crc long, ids binary"), "token-ids")

    meta = table.select("doc_id", "row", "n", "crcs", "rest_crc", (F.col("n") % window).cast("int").alias("r"))
    histogram = {x["r"]: x["c"] for x in meta.groupBy("r").agg(F.count(F.lit(1)).alias("c")).collect()}  # fewer rows than the window has tokens
    plan = make_plan(histogram, window)

    most = max(1, sum(histogram.values()) // (4 * shuffle_partitions(spark)))
    salts = spark.createDataFrame([(r, -(-c // most)) for r, c in histogram.items()], "r int, salts long")
    salted = meta.join(F.broadcast(salts), "r").withColumn("salt", F.pmod(F.xxhash64("row"), "salts"))
    groups = salted.groupBy("r", "salt").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("crcs")).alias("full")).orderBy("r", "salt").collect()  # at most window + 4 x partitions rows
    starts, ranks, full = [], {}, 0
    for g in groups:
        starts.append((g["r"], g["salt"], ranks.get(g["r"], 0), full))
        ranks[g["r"]] = ranks.get(g["r"], 0) + g["c"]
        full += g["full"]
    firsts = spark.createDataFrame(starts, "r int, salt long, k0 long, f0 long")
    w = Window.partitionBy("r", "salt").orderBy("row")
    ranked = salted.join(F.broadcast(firsts), ["r", "salt"]).select(
        "doc_id", "row", "n", "crcs", "rest_crc", "r",
        (F.col("k0") + F.row_number().over(w) - 1).alias("k"),
        (F.col("f0") + F.sum(F.size("crcs")).over(w) - F.size("crcs")).alias("f"),
    )
    ranked = materialize(ranked, "ranked")

    plan_of = share(spark, plan)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    cols = ["doc_id", "n", "crcs", "rest_crc", "k", "f", "ids"]
    if with_ids:
        return ranked.join(table.select("row", "ids"), "row").select(cols).mapInArrow(_place(plan_of, window, full, True, True), schema)
    plain = ranked.withColumn("ids", F.lit(None).cast("binary")).select(cols).mapInArrow(_place(plan_of, window, full, False, False), schema)
    crossing = ranked.where(_is_cut(plan, window)).join(table.select("row", "ids"), "row").select(cols).mapInArrow(_place(plan_of, window, full, True, False), schema)
    return plain.unionByName(crossing).drop("ids")
