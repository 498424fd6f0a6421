"""Suffix-array dedup by depth-limited radix sort.

Suffixes are ordered only as deep as the threshold (400 bytes), by most-significant-digit passes. A digit is a stretch of
bytes, compared by its 64-bit fingerprint; a pass keeps the suffixes whose digit is not alone, and after the last one equal
groups are exactly the repeated windows. Suffixes that start close together share most of their bytes, so the first passes
take one digit for many suffixes:

1. the anchor: the 64-byte stretch with the least fingerprint inside the window (the leftmost of equal ones). Equal windows
   have equal anchors at equal distances. Windows with one anchor form a run; a run whose anchor occurs nowhere else is closed.
2. the whole run, from its first window's start to its last one's end: where two are equal, all their windows are repeated.
3. nodes of STEP neighbouring windows of a run: the bytes common to all of them (alone: none is repeated) and the bytes
   that all of them span (repeated: all are).
4. the windows of nodes that pass 3 leaves open: the ends of repeated stretches.

Digits go to tasks by ranges of their fingerprints, so the windows of one passage, however many documents hold it, are
spread over all tasks. What one pass tells the next is a bit table of fixed size; what passes it by chance is sorted out by
the next pass. Texts are read again in each pass, which costs less than keeping their suffixes.

A removed byte is one that a repeated window covers. Nothing is capped or sampled.

Suffixes may be of bytes or of words (``Unit``): a passage of given words that stands elsewhere too need not have 400 bytes, so
``repeated_spans`` can tell it beside what it removes, by the same passes over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropcube.llm import kernels as K
from cropcube.llm.shared import Scratch, bitmap, ranges_of
from cropcube.session import ship

SIZE = 400
ANCHOR = 64
#: Windows of a node are ANCHOR // 4 neighbours or fewer.
STEP = 16
#: Most bits of a table that one pass hands to the next: 16 MB.
TABLE_BITS = 27
#: Digits that a task sorts at once; with the bytes of text that are worked on at once, what bounds a worker's memory.
CHUNK = 1 << 18
PIECE = 1 << 18
_SPAN = np.uint64(0x5851F42D4C957F2D)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values (two running minima of blocks)."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    p = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    p[: len(h)] = h
    p = p.reshape(blocks, width)
    left = np.minimum.accumulate(p, axis=1).reshape(-1)
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


@dataclass(frozen=True)
class Unit:
    """What suffixes are made of: windows of ``size`` bytes, or words, with anchors of ``anchor`` and nodes of ``step`` windows."""

    size: int
    anchor: int
    step: int
    words: bool = False

    def __post_init__(self):
        if not self.step < self.anchor < self.size < 1024 * self.step:
            raise ValueError("the anchor is longer than a step and shorter than the window")

    @property
    def least_bytes(self) -> int:
        return 2 * self.size - 1 if self.words else self.size

    def symbols(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            return raw, offsets
        starts, ends, first = K.word_bounds(raw, offsets, K.NOT_SPACE)
        return K.span_hashes(raw, starts, ends, fold=False), first


class Runs:
    """The runs of a piece of texts: windows [first, last] of one anchor place each, and the document of each run."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, unit: Unit):
        size, anchor = unit.size, unit.anchor
        self.size, self.step = size, unit.step
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.place = self.doc = empty
        self.anchor = np.zeros(0, np.uint64)
        self.sums = np.zeros(1, np.uint64)
        lengths = np.diff(offsets)
        if not (lengths >= size).any():
            return
        self.sums = K.prefix_hash(raw)
        h = K.window_hash(self.sums, slice(0, len(raw) - anchor + 1), anchor)
        # upper half of the fingerprint, then the place: ties fall to the leftmost
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_min(key, size - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del key
        new = np.empty(len(place), bool)
        new[0] = True
        np.not_equal(place[1:], place[:-1], out=new[1:])
        new[offsets[:-1][offsets[:-1] < len(place)]] = True
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(place)]]) - 1
        doc = np.searchsorted(offsets, first, "right") - 1
        last = np.minimum(last, offsets[doc + 1] - size)  # no window across texts
        ok = last >= first
        self.first, self.last, self.doc = first[ok], last[ok], doc[ok]
        self.place = place[self.first]
        self.anchor = h[self.place]

    def take(self, keep: np.ndarray) -> Runs:
        for name in ("first", "last", "doc", "place", "anchor"):
            setattr(self, name, getattr(self, name)[keep])
        return self

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fingerprints of the bytes [a, b)."""
        _, inverse = K._powers(len(self.sums))
        with np.errstate(over="ignore"):
            return K.mix((self.sums[b] - self.sums[a]) * inverse[a] + (b - a).astype(np.uint64) * _SPAN)

    def whole(self) -> np.ndarray:
        """Of each run its bytes, with the place of its anchor in them: equal ones are runs of equal windows."""
        with np.errstate(over="ignore"):
            return K.mix(self.span(self.first, self.last + self.size) + (self.place - self.first).astype(np.uint64) * _SPAN)

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, node, whether it has all its windows): node m has the windows that start ``m * step`` and up to ``step - 1`` more before the anchor."""
        near, far = self.place - self.last, self.place - self.first
        lo, hi = near // self.step, far // self.step
        count = hi - lo + 1
        run = np.repeat(np.arange(len(lo)), count)
        m = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + lo[run]
        return run, m, (m * self.step >= near[run]) & (m * self.step + self.step - 1 <= far[run])

    def common(self, run: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Fingerprints of the bytes that all windows of a node share."""
        at = self.place[run] - m * self.step
        return self.span(at, at - self.step + 1 + self.size)


def runs_of(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple[int, Runs, np.ndarray]]:
    """Of pieces of a batch: the first text, its runs, and where each text begins in the piece."""
    raw, offsets = K.texts_of(batch.column(batch.schema.get_field_index("text")))
    for i, j in K.groups(offsets, PIECE):
        symbols, begin = unit.symbols(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, Runs(symbols, begin, unit), begin


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def cuts(values: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    edges = np.array([(x << 64) // ranges for x in range(1, ranges)], np.uint64)
    cut = [0, *np.searchsorted(values, edges).tolist(), len(values)]
    return [(r, a, b) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def repeated_anchors(texts: DataFrame, unit: Unit, ranges: int) -> DataFrame:
    """Pass 1: fingerprints of the anchors of two or more runs. A task sends each of its own once, marked if it has several."""

    def emit(batches):
        held, n = [], 0
        for batch in batches:
            for _, runs, _ in runs_of(batch, unit):
                held.append(runs.anchor)
                n += len(runs.anchor)
                if n >= CHUNK:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    def sent(held):
        values, count = np.unique(np.concatenate(held), return_counts=True)
        rows = cuts(values, ranges)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r for r, _, _ in rows], pa.int32()),
                pa.array([K.pack(values[a:b]) for _, a, b in rows], pa.binary()),
                pa.array([np.packbits(count[a:b] > 1).tobytes() for _, a, b in rows], pa.binary()),
            ],
            ["r", "vals", "twice"],
        )

    def judged(table: pa.Table) -> pa.Table:
        parts = [K.unpack(x.as_py()) for x in table.column("vals")]
        twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)) for x, p in zip(table.column("twice"), parts, strict=True)]
        values, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        many = (count > 1) | (np.bincount(inverse, np.concatenate(twice), len(values)) > 0)
        return pa.table({"anchor": signed(values[many])})

    return texts.select("text").mapInArrow(emit, "r int, vals binary, twice binary").groupBy("r").applyInArrow(judged, "anchor long")


def open_runs(texts: DataFrame, unit: Unit, table) -> DataFrame:
    """Pass 2's digits: the runs whose anchor is not alone, of every text (``key``); places count from the text's start."""

    def emit(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            for i, runs, base in runs_of(batch, unit):
                runs.take(table.value.holds(runs.anchor))
                if len(runs.first):
                    at = base[runs.doc]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[i + runs.doc].astype(np.int64)),
                            pa.array(runs.first - at),
                            pa.array(runs.place - at),
                            pa.array(runs.last - at),
                            signed(runs.anchor),
                            signed(runs.whole()),
                        ],
                        ["key", "first", "place", "last", "anchor", "run"],
                    )

    return texts.select("key", "text").mapInArrow(emit, "key long, first long, place long, last long, anchor long, run long")


def repeated_digits(texts: DataFrame, unit: Unit, digits, ranges: int) -> DataFrame:
    """Passes 3 and 4: ``(run, tag, value)`` of the digits that are not alone; ``digits`` gives a piece's digits, runs and tags."""

    def emit(batches):
        held, n = [], 0
        for batch in batches:
            for _, runs, _ in runs_of(batch, unit):
                found = digits(runs)
                if len(found[0]):
                    held.append(found)
                    n += len(found[0])
                if n >= CHUNK:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    def sent(held):
        value, run, tag = distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
        rows = cuts(value, ranges)
        return pa.RecordBatch.from_arrays(
            [pa.array([r for r, _, _ in rows], pa.int32())]
            + [pa.array([f(a, b) for _, a, b in rows], pa.binary()) for f in (lambda a, b: K.pack(value[a:b]), lambda a, b: run[a:b].tobytes(), lambda a, b: tag[a:b].tobytes())],
            ["r", "vals", "runs", "tags"],
        )

    def distinct(value, run, tag):
        order = np.lexsort((tag, run, value))
        value, run, tag = value[order], run[order], tag[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (run[1:] != run[:-1]) | (tag[1:] != tag[:-1])
        return value[new], run[new], tag[new]

    def judged(table: pa.Table) -> pa.Table:
        value, run, tag = distinct(
            np.concatenate([K.unpack(x.as_py()) for x in table.column("vals")]),
            np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("runs")]),
            np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("tags")]),
        )
        edge = np.concatenate([[True], value[1:] != value[:-1], [True]])
        alone = edge[:-1] & edge[1:]
        return pa.table({"run": signed(run[~alone]), "tag": pa.array(tag[~alone].astype(np.int32)), "value": signed(value[~alone])})

    return texts.select("text").mapInArrow(emit, "r int, vals binary, runs binary, tags binary").groupBy("r").applyInArrow(judged, "run long, tag int, value long")


#: Tags of pass 3 from here on are of the bytes that a node spans, those below of the bytes its windows share.
SPANNED = 1 << 15


def repeated_windows(docs: DataFrame, text_col: str, unit: Unit, scratch: Scratch) -> DataFrame:
    """``(key, found)``: of each text (by its hash) with repeated windows the runs they are in, and which of their windows."""
    spark = docs.sparkSession
    ranges = ranges_of(docs)
    step = unit.step
    texts = docs.select(F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= unit.least_bytes)
    share = spark.sparkContext.broadcast

    anchors = share(bitmap(scratch.table(repeated_anchors(texts, unit, ranges)), F.col("anchor"), TABLE_BITS))
    runs = scratch.table(open_runs(texts, unit, anchors))
    anchors.destroy()
    equal = scratch.table(runs.groupBy("run").agg(F.count("*").alias("n"), F.min("anchor").alias("anchor")))
    mixed = equal.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    mixed_at = share(bitmap(scratch.table(mixed), F.col("anchor"), TABLE_BITS))

    def by_node(r: Runs):
        r.take(mixed_at.value.holds(r.anchor))
        whole = r.whole()
        run, m, full = r.nodes()
        at = r.place[run] - m * step
        shared = r.common(run, m)
        run2, m2, at2 = run[full], m[full], at[full]
        spanned = r.span(at2 - step + 1, at2 + unit.size)
        return np.concatenate([shared, spanned]), whole[np.concatenate([run, run2])], np.concatenate([m, m2 | SPANNED]).astype(np.uint16)

    nodes = scratch.table(repeated_digits(texts, unit, by_node, ranges))
    # a node of a single run is open if its shared symbols are repeated and its spanned ones are not; every node with its
    # shared symbols, also of runs and nodes that are settled, then shows its windows
    core = F.max(F.when(F.col("tag") < SPANNED, F.col("value"))).alias("core")
    ends = nodes.groupBy("run", F.col("tag").bitwiseAND(SPANNED - 1).alias("m")).agg(F.max("tag").alias("top"), core).where(F.col("top") < SPANNED)
    ends = ends.join(equal.where("n > 1").select("run"), "run", "left_anti")
    open_at = share(bitmap(scratch.table(ends), F.col("core"), TABLE_BITS))

    def by_window(r: Runs):
        r.take(mixed_at.value.holds(r.anchor))
        whole = r.whole()
        run, m, _ = r.nodes()
        hit = open_at.value.holds(r.common(run, m))
        run, m = run[hit], m[hit]
        run, back = np.repeat(run, step), (m[:, None] * step + np.arange(step)).ravel()
        at = r.place[run] - back
        ok = (at >= r.first[run]) & (at <= r.last[run])
        run, back, at = run[ok], back[ok], at[ok]
        return r.span(at, at + unit.size), whole[run], back.astype(np.uint16)

    singles = repeated_digits(texts, unit, by_window, ranges)
    backs = nodes.where(F.col("tag") >= SPANNED).select("run", ((F.col("tag") - SPANNED) * step).alias("lo"), ((F.col("tag") - SPANNED) * step + step - 1).alias("hi"))
    backs = backs.union(singles.select("run", F.col("tag").alias("lo"), F.col("tag").alias("hi")))
    whole = equal.where("n > 1").select("run", F.lit(0).alias("lo"), F.lit(1 << 30).alias("hi"))
    # written, so that the join has plain inputs and a run of very many texts can be split
    backs = scratch.table(backs.union(whole).groupBy("run").agg(F.collect_set(F.struct("lo", "hi")).alias("backs")))
    found = runs.select("key", "run", "first", "place", "last").distinct().join(backs, "run")
    return found.groupBy("key").agg(F.collect_list(F.struct("first", "place", "last", "backs")).alias("found"))


def repeated_spans(
    docs: DataFrame, text_col: str = "text", size: int = SIZE, anchor: int = ANCHOR, keep: list[str] | None = None, with_kept: bool = True, passage: int | None = None
) -> DataFrame:
    """``docs``' columns ``keep`` (all if None) and ``n_bytes``, ``spans`` (removed byte runs, in order), ``n_removed``, ``kept_sha256``,
    if ``with_kept`` ``kept``, and if ``passage`` ``n_passage_words``: words in windows of that many words that stand elsewhere too.

    A null text is empty; texts shorter than ``size`` keep all bytes, texts of any length are taken whole; equal texts of ``size``
    bytes or more lose all, and so does each of repeated rows. Rows are judged on the input, an empty table gives no rows. ``kept`` is
    binary, since a window may end inside a character. Columns of ``docs`` of these names are replaced. Windows are told apart by
    64-bit fingerprints. What stands elsewhere stands in another row or at another place of the same one.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "repeats")
    names = ["n_bytes", "spans", "n_removed", "kept_sha256", "kept", "n_passage_words"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    found = {"cropcube_found": repeated_windows(docs, text_col, Unit(size, anchor, STEP), scratch)}
    if passage:
        found["cropcube_passages"] = repeated_windows(docs, text_col, Unit(passage, max(4, passage // 6), max(3, passage // 12), True), scratch)

    def pieces(batches):
        for batch in batches:
            _, offsets = K.texts_of(batch.column(batch.schema.get_field_index(text_col)))
            yield from (batch.slice(i, j - i) for i, j in K.groups(offsets, PIECE))

    def judge(batches):
        for batch in pieces(batches):
            texts_ = batch.column(batch.schema.get_field_index(text_col))
            raw, offsets = K.texts_of(texts_)
            where = batch.column(batch.schema.get_field_index("cropcube_found"))
            doc, start, end = covered(where, size)
            told = np.zeros(batch.num_rows, np.int64)
            if passage:
                d, x, y = covered(batch.column(batch.schema.get_field_index("cropcube_passages")), passage)
                told = np.bincount(d, y - x, batch.num_rows).astype(np.int64)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            removed = np.bincount(doc, end - start, batch.num_rows).astype(np.int64)
            digest, kept = [], []
            for d in range(batch.num_rows):
                data = raw[offsets[d] : offsets[d + 1]].tobytes()
                if first[d] < first[d + 1]:
                    a, b = start[first[d] : first[d + 1]].tolist(), end[first[d] : first[d + 1]].tolist()
                    data = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True))
                digest.append(hashlib.sha256(data).hexdigest())
                if with_kept:
                    kept.append(data)
            pairs = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            out |= {"n_bytes": pa.array(np.diff(offsets)), "spans": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pairs)}
            out |= {"n_removed": pa.array(removed), "kept_sha256": pa.array(digest, pa.string())}
            if with_kept:
                out["kept"] = pa.array(kept, pa.binary())
            if passage:
                out["n_passage_words"] = pa.array(told)
            yield pa.RecordBatch.from_pydict(out)

    joined = docs.select(*dict.fromkeys([*keep, text_col])).withColumn("cropcube_key", F.xxhash64(F.col(text_col)))
    for name, table in found.items():
        joined = joined.join(table.select(F.col("key").alias("cropcube_key"), F.col("found").alias(name)), "cropcube_key", "left")
    added = "n_bytes long, spans array<struct<start: long, end: long>>, n_removed long, kept_sha256 string" + ", kept binary" * with_kept + ", n_passage_words long" * bool(passage)
    schema = T.StructType([docs.schema[c] for c in keep] + T.StructType.fromDDL(added).fields)
    return joined.drop("cropcube_key").mapInArrow(judge, schema)


def covered(found: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (or words) under the repeated windows of each text of a batch: (text, start, end) of disjoint runs in order; runs that touch are one."""
    lengths = lambda x: np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = found.flatten()
    text = np.repeat(np.arange(len(found)), lengths(found))
    backs = runs.field("backs")
    run = np.repeat(np.arange(len(runs)), lengths(backs))
    near = backs.flatten()
    place = number(runs.field("place"))[run]
    a = np.maximum(number(runs.field("first"))[run], place - number(near.field("hi")))
    z = np.minimum(number(runs.field("last"))[run], place - number(near.field("lo")))
    ok = a <= z
    text, a, z = text[run][ok], a[ok], z[ok] + size
    if not len(a):
        return text, a, z
    wide = int(z.max()) + 2  # each text's places lie apart from the next one's
    order = np.lexsort((a, text))
    begin = text[order] * wide + a[order]
    reach = np.maximum.accumulate(text[order] * wide + z[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    last = np.append(new[1:], len(begin)) - 1
    text = begin[new] // wide
    return text, begin[new] - text * wide, reach[last] - text * wide
