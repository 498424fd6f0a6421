"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word n-gram fingerprints; equal sets are one node from the start. The global order of n-grams
(rarer levels first, then the fingerprint) is cut into fragments: every set is cut with them, the overlap of a pair is counted in
each fragment on its own, and the partial counts are summed per pair. A pair is a link if its sum reaches the similarity
(``links``); nothing else makes links.

Which pairs are counted follows from the same order. Sets of na and nb n-grams with the similarity t share t (na + nb) / (1 + t)
of them or more, so they share one that stands at most ``n - t (na + nb) / (1 + t)`` places from the start of both. An entry of the
index is an n-gram of such a prefix with the greatest size of a partner that it still serves (``top``): a pair is asked for where
each one's size is within the other's ``top``. No pair with the similarity is missed, and nothing is capped.

Groups of near copies never become all their pairs. First each set is counted against two members of each of its postings (the
one with the fewest rare n-grams, and one by hash); the links found so make components, which is linear in the entries. Then only
pairs of *different* components are left, and of those only pairs whose parity bits differ in few enough places (each n-gram
flips one bit of its set, so two sets differ in at least as many n-grams as bits). Without the first step (``stars=False``) the
components are the same; it is the plan for groups of copies.

N-grams of very many sets are dealt out: by the hash of the set while the index is made, and in blocks of BLOCK sets when pairs are
looked for, so that no task holds such an n-gram. What is left is quadratic in one case only: sets that share nearly all of the
n-grams asked for, are of different components and yet are not similar.

Texts are read again in each pass instead of being kept as sets: reading costs less than the disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropcube.llm import kernels as K
from cropcube.llm.graph import components
from cropcube.llm.shared import Scratch, Sparse, bitmap, ranges_of
from cropcube.session import ship

WORDS = 5
#: Similarity as a fraction of whole numbers: 75 / 100.
NUM, DEN = 75, 100
#: Fragments of the global order: all but the last are of n-grams of level 0, by fingerprint; the last has the frequent ones.
FRAGMENTS = 4
#: Bits of a set's parity: so many, or as many as it has n-grams (the next power of two), but no more than MOST_PARITY.
PARITY = 1024
MOST_PARITY = 1 << 17
#: Cells of the table of levels (bytes of the broadcast), and bits of an n-gram that are counted.
LEVEL_BITS = 24
COUNT_BITS = 34
#: Document frequency from which n-grams have a level above 0: 16, then each power of two.
LEVEL_FROM = 4
FILTER_BITS = 26
#: Level from which an n-gram's entries are dealt out by their sets' hash: 2**SALT_FROM of them or so to a task.
SALT_FROM = 10
#: Sets of a block of an n-gram's entries.
BLOCK = 128
#: N-grams that a task sorts at once, and bytes of text that it cuts into sets at once.
CHUNK = 500_000
PIECE = 1 << 18


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of runs of texts: first and last text, sorted distinct n-grams of all, and where each text's begin."""
    raw, offsets = K.texts_of(column)
    for i, j in K.groups(offsets, PIECE):
        part, local = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = K.word_bounds(part, local, K.NOT_SPACE)
        h, at = K.shingles(K.span_hashes(part, starts, ends), first, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            h[a:b].sort()
        keep = np.ones(len(h), bool)
        if len(h):
            keep[1:] = h[1:] != h[:-1]
            keep[at[:-1][at[:-1] < len(h)]] = True
        total = np.concatenate([[0], np.cumsum(keep)])
        yield i, j, h[keep], total[at]


def set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An order-free 64-bit fingerprint of each set (0 for an empty one)."""
    n = np.diff(at)
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * (h >> np.uint64(7) | np.uint64(1)), dtype=np.uint64)])
        out = K.mix((s[at[1:]] - s[at[:-1]]) ^ (n.astype(np.uint64) << np.uint64(40)))
    out[n == 0] = 0
    return out


def parities(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set its parity: bit k tells whether an odd number of its n-grams is of cell k."""
    out: list[bytes] = []
    size = np.diff(at)
    long = size > PARITY
    for i in range(0, len(size), 512):
        n = len(size[i : i + 512])
        a, z = at[i], at[i + n]
        short = np.repeat(~long[i : i + n], size[i : i + n])
        cell = np.repeat(np.arange(n), size[i : i + n])[short] * PARITY + cells_of(h[a:z][short], PARITY)
        rows = np.packbits(np.bincount(cell, minlength=n * PARITY).reshape(n, PARITY).astype(np.uint8) & 1, axis=1)
        out += [x.tobytes() for x in rows]
    for d in np.flatnonzero(long).tolist():
        bits = min(MOST_PARITY, 1 << int(size[d] - 1).bit_length())
        out[d] = np.packbits(np.bincount(cells_of(h[at[d] : at[d + 1]], bits), minlength=bits).astype(np.uint8) & 1).tobytes()
    return out


def cells_of(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)


def folded(parity: bytes, size: int) -> np.ndarray:
    """The parity of fewer cells: the halves of a longer one stand over each other."""
    out = np.frombuffer(parity, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def differing(parity: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which the parities of rows ``a`` and ``b`` differ: the sets differ in that many n-grams or more."""
    size = np.array([len(x) for x in parity], np.int64)
    least = np.minimum(size[a], size[b])
    out = np.zeros(len(a), np.int64)
    for w in np.unique(least).tolist():
        each = np.flatnonzero(least == w)
        step = max(1, (8 << 20) // w)
        for i in range(0, len(each), step):
            part = each[i : i + step]
            rows, place = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
            bits = np.stack([folded(parity[r], w) for r in rows.tolist()]).view(np.uint64)
            out[part] = np.bitwise_count(bits[place[: len(part)]] ^ bits[place[len(part) :]]).sum(axis=1, dtype=np.int64)
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def described(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, h, at in sets_of(batch.column(1), k):
                n = np.diff(at)
                bits = pa.array(parities(h, at), pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(set_ids(h, at).view(np.int64), mask=n == 0), bits], ["id", "n", "sid", "parity"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n long, sid long, parity binary")


def by_range(values: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of sorted ``bits``-bit values begins."""
    edges = [(x << bits) // ranges for x in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]]).astype(np.int64)


def levels(docs: DataFrame, text_col: str, k: int, spark: SparkSession) -> np.ndarray:
    """Table of ``2**LEVEL_BITS`` bytes: the greatest level of any n-gram in the cell; it only sets the order.

    All n-grams of all documents are counted, each range of them in one task; the tasks return fixed-size parts of
    the table, so what reaches the driver and is sent back does not grow with the data.
    """
    ranges = ranges_of(docs)

    def emit(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, h, _ in sets_of(batch.column(0), k):
                held.append(h)
                size += len(h)
                if size >= 3 * CHUNK:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(held):
        values, counts = np.unique(np.concatenate(held) >> np.uint64(64 - COUNT_BITS), return_counts=True)
        edge = by_range(values, COUNT_BITS, ranges)
        rows = [(r, a, b) for r, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if b > a]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r for r, _, _ in rows], pa.int32()),
                pa.array([squeeze(K.pack(values[a:b])) for _, a, b in rows], pa.binary()),
                pa.array([squeeze(np.minimum(counts[a:b], 1 << 30).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()) for _, a, b in rows], pa.binary()),
            ],
            ["r", "vals", "counts"],
        )

    def summed(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        values = np.concatenate([K.unpack(unsqueeze(b.as_py())) for b in table.column("vals")])
        planes = (np.frombuffer(unsqueeze(b.as_py()), np.uint8).reshape(4, -1) for b in table.column("counts"))
        counts = np.concatenate([p.T.copy().view(np.uint32)[:, 0] for p in planes]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        total = np.add.reduceat(counts, new)
        hot = total >= (1 << LEVEL_FROM)
        cell = (values[new][hot] >> np.uint64(COUNT_BITS - LEVEL_BITS)).astype(np.int64)
        level = np.minimum(np.log2(total[hot]).astype(np.int64) - LEVEL_FROM + 1, 15).astype(np.uint8)
        lo, hi = (((x << COUNT_BITS) // ranges) >> (COUNT_BITS - LEVEL_BITS) for x in (r, r + 1))
        part = np.zeros(hi - lo + 1, np.uint8)
        np.maximum.at(part, cell - lo, level)
        return pa.table({"at": pa.array([lo]), "part": pa.array([squeeze(part)])})

    rows = (
        docs.select(F.col(text_col).cast("string"))
        .mapInArrow(emit, "r int, vals binary, counts binary")
        .groupBy("r")
        .applyInArrow(summed, "at long, part binary")
        .collect()
    )
    out = np.zeros((1 << LEVEL_BITS) + 1, np.uint8)
    for x in rows:
        part = np.frombuffer(unsqueeze(bytes(x.part)), np.uint8)
        here = out[x["at"] : x["at"] + len(part)]
        np.maximum(here, part[: len(here)], out=here)
    return out[:-1]


def squeeze(x: bytes | np.ndarray) -> bytes:
    x = bytes(x)
    return len(x).to_bytes(8, "little") + bytes(pa.compress(x, "zstd", asbytes=True))


def unsqueeze(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def spare(n: np.ndarray) -> np.ndarray:
    """How many shared n-grams of the prefixes a pair needs to be counted."""
    return np.ones_like(n)


def prefixes(h: np.ndarray, at: np.ndarray, table: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n-grams of every set in the global order, as long as the smallest partner asks for, and whose they are."""
    return entries_of(h, at, table, num, den)[:2]


def entries_of(h: np.ndarray, at: np.ndarray, table: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first n-grams of every set in the global order (level, fingerprint), whose they are, and their ``top``.

    ``top`` is the greatest size of a set that can have the similarity and shares no n-gram of an earlier place; n-grams whose
    ``top`` is under the least size of any partner are left out.
    """
    n = np.diff(at)
    want = n - -(-num * n // den) + spare(n)  # places up to the one that the smallest partner needs
    want[n == 0] = 0
    level = table[(h >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
    cold = level == 0
    total = np.concatenate([[0], np.cumsum(cold)])
    have = total[at[1:]] - total[at[:-1]]
    doc = np.repeat(np.arange(len(n)), n)
    place = total[1:] - total[at[:-1]][doc] - 1
    take = cold & (place < want[doc])
    for d in np.flatnonzero(have < want).tolist():
        a, b = at[d], at[d + 1]
        order = np.argsort(level[a:b], kind="stable")[: want[d]]  # h is sorted: equal levels stay in order
        take[a:b] = False
        take[a + order] = True
        place[a + order] = np.arange(len(order))
    doc, place = doc[take], place[take]
    return h[take], doc, (num + den) * (n[doc] - place) // num - n[doc]


def index(docs: DataFrame, text_col: str, k: int, num: int, den: int, table, spark: SparkSession) -> DataFrame:
    """What the n-grams have that two or more sets hold in their prefixes: entries and pairs.

    Entries ``(gram, sid, n, top, salted)`` are of n-grams of three sets or more. Pairs ``(sid, other, star)`` are those of n-grams of two
    sets, and, marked by ``star``, of every entry with two heads of its n-gram (``heads_of``). Where an n-gram's sets are dealt to
    several tasks (``salted``) there are entries only.
    """
    ranges = ranges_of(docs)

    def emit(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, h, at in sets_of(batch.column(0), k):
                sid = set_ids(h, at)
                g, d, top = entries_of(h, at, table.value.get(), num, den)
                first = np.zeros(len(sid), bool)
                first[np.unique(sid, return_index=True)[1]] = True
                keep = first[d]  # copies of a set are one
                g, d, top = g[keep], d[keep], top[keep]
                level = table.value.get()[(g >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)].astype(np.int64) + LEVEL_FROM - 1
                salt = (sid[d] >> np.uint64(40)).astype(np.int64) % (1 << np.maximum(0, level - SALT_FROM))
                salt[level >= SALT_FROM] += 1
                held.append((g, salt.astype(np.int32), sid[d], np.diff(at)[d].astype(np.uint32), top.astype(np.uint32)))
                size += len(g)
                if size >= CHUNK:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def packed(held):
        g, salt, s, n, top = (np.concatenate(x) for x in zip(*held, strict=True))
        r = (g >> np.uint64(32)).astype(np.int64) * ranges >> 32
        held.clear()
        order = np.lexsort((g, salt, r))
        g, salt, r, s, n, top = (x[order] for x in (g, salt, r, s, n, top))
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(r)), bool), (r[1:] != r[:-1]) | (salt[1:] != salt[:-1])]))
        ends = [*new[1:].tolist(), len(r)]
        rows = list(zip(new.tolist(), ends, strict=True))
        raw = lambda x: pa.array([x[a:b].tobytes() for a, b in rows], pa.binary())
        grams = pa.array([K.pack(g[a:b]) for a, b in rows], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(r[new]), pa.array(salt[new].astype(np.int64)), grams, raw(s), raw(n), raw(top)], ["r", "salt", "grams", "sids", "ns", "tops"])

    def met(part: pa.Table) -> pa.Table:
        raw = lambda c, kind: np.concatenate([np.frombuffer(b.as_py(), kind) for b in part.column(c)])
        g = np.concatenate([K.unpack(b.as_py()) for b in part.column("grams")])
        s, n, top = raw("sids", np.uint64), raw("ns", np.uint32).astype(np.int64), raw("tops", np.uint32).astype(np.int64)
        order = np.lexsort((s, g))
        g, s, n, top = g[order], s[order], n[order], top[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        g, s, n, top = g[new], s[new], n[new], top[new]
        salted = part.column("salt")[0].as_py() > 0
        pairs = [np.zeros((0, 3), np.uint64)]
        if not salted:  # all entries of these n-grams are here
            for _ in range(2):
                keep = served(g, n, top)
                g, s, n, top = g[keep], s[keep], n[keep], top[keep]
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]))
            size = np.diff(np.append(start, len(g)))
            each = np.repeat(size, size)
            for star, one, two in [(0, start[size == 2], start[size == 2] + 1), *((1, np.flatnonzero(each > 2), h[each > 2]) for h in heads_of(s, n, top, start, size))]:
                ok = (s[one] != s[two]) & (n[one] <= top[two]) & (n[two] <= top[one])
                x, y = s[one][ok].view(np.int64), s[two][ok].view(np.int64)
                pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y), np.full(len(x), star)], axis=1).view(np.uint64))
            g, s, n, top = g[each > 2], s[each > 2], n[each > 2], top[each > 2]
        met_ = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
        none, blank = pa.nulls(len(met_), pa.int64()), pa.nulls(len(g), pa.int64())
        columns = {"gram": (signed(g), none), "sid": (signed(s), pa.array(met_[:, 0])), "n": (pa.array(n), none), "top": (pa.array(top), none), "other": (blank, pa.array(met_[:, 1]))}
        columns |= {"star": (pa.nulls(len(g), pa.bool_()), pa.array(met_[:, 2] == 1)), "salted": (pa.array(np.full(len(g), salted)), pa.nulls(len(met_), pa.bool_()))}
        return pa.table({c: pa.concat_arrays(v) for c, v in columns.items()})

    kinds = "r long, salt long, grams binary, sids binary, ns binary, tops binary"
    met_kinds = "gram long, sid long, n long, top long, other long, star boolean, salted boolean"
    return docs.select(F.col(text_col).cast("string")).mapInArrow(emit, kinds).groupBy("r", "salt").applyInArrow(met, met_kinds)


def heads_of(s: np.ndarray, n: np.ndarray, top: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """For each entry the place of a head of its n-gram: of the set with the fewest rare n-grams, then of the one with the least hash."""
    if not len(s):
        return
    h = K.mix(s.copy())
    posting = np.repeat(np.arange(len(start)), size)
    for order in (np.lexsort((h, n - top, posting)), np.lexsort((h, posting))):
        yield np.repeat(order[start], size)


def served(g: np.ndarray, n: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Entries, sorted by n-gram, that another one of their n-gram can stand against."""
    if not len(g):
        return np.zeros(0, bool)
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(start, len(g)))
    spread = lambda x: np.repeat(x, size)
    return (spread(size) > 1) & (top >= spread(np.minimum.reduceat(n, start))) & (n <= spread(np.maximum.reduceat(top, start)))


def star_pairs(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)``: every entry with two heads of its n-gram, where their sizes serve each other; for n-grams that are in several tasks."""
    member = F.struct("sid", "n", "top")
    by_hash = F.xxhash64("sid")
    heads = entries.groupBy("gram").agg(
        F.min(F.struct((F.col("n") - F.col("top")).alias("off"), by_hash.alias("h"), member.alias("m"))).alias("c"), F.min(F.struct(by_hash.alias("h"), member.alias("m"))).alias("d")
    )
    # written, and joined by sort and merge, so that the join has plain inputs and an n-gram of very many sets can be split
    both = entries.join(scratch.table(heads).hint("merge"), "gram").select("sid", "n", "top", F.explode(F.array("c.m", "d.m")).alias("m"))
    both = both.where("sid <> m.sid AND n <= m.top AND m.n <= top")
    return both.select(F.least("sid", "m.sid").alias("a"), F.greatest("sid", "m.sid").alias("b")).distinct()


def near_in_parity(pairs: DataFrame, parity: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) whose parities do not rule out the similarity."""
    pairs = scratch.table(pairs)
    of = lambda c: parity.select(F.col("sid").alias(c), F.col("n").alias("n" + c), F.col("parity").alias("p" + c))

    def test(batches):
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            both = batch.column(4).to_pylist() + batch.column(5).to_pylist()
            ok = pa.array((num + den) * differing(both, np.arange(len(n)), np.arange(len(n)) + len(n)) <= (den - num) * n)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(test, "a long, b long")


def crossing_pairs(entries: DataFrame, roots: DataFrame, parity: DataFrame, least: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """``(a, b)``: all pairs of different components that share an entry, serve each other and whose parities are near enough.

    Postings of fewer than ``least`` entries are left out.

    In a posting the entries of its main component only stand against the others (``odd``). Where a posting has more entries than
    BLOCK, blocks of the odd ones meet blocks of all.
    """
    rooted = entries.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = scratch.table(rooted)
    main = F.min_by("root", F.struct(F.col("n") - F.col("top"), F.xxhash64("root"))).alias("main")
    heads = rooted.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), main, F.min("n").alias("low"), F.max("top").alias("high"), F.count("*").alias("k")).where(f"r0 <> r1 AND k >= {least}")
    # written and merged, as in ``star_pairs``
    heads = scratch.table(heads)
    live = rooted.join(heads.select("gram", "main", "low", "high").hint("merge"), "gram").where("top >= low AND n <= high")
    live = scratch.table(live.select("gram", "sid", "n", "top", "root", (F.col("root") != F.col("main")).alias("odd")))
    blocks = lambda c: F.expr(f"cast(pow(2, greatest(0, ceil(log2({c} / {BLOCK})))) as int)")
    size = live.groupBy("gram").agg(F.count("*").alias("k"), F.count_if("odd").alias("o")).where("k > 1 AND o > 0").select("gram", blocks("o").alias("bo"), blocks("k").alias("bk"))
    size = scratch.table(size)
    h = F.xxhash64("sid")
    alone = F.col("bk") == 1
    none = F.expr("cast(array() as array<struct<i: int, j: int, side: int>>)")
    deal = lambda many, i, j, side: F.transform(F.sequence(F.lit(0), F.col(many) - 1), lambda x: F.struct(i(x).cast("int").alias("i"), j(x).cast("int").alias("j"), F.lit(side).alias("side")))
    as_odd = deal("bk", lambda x: F.pmod(h, "bo"), lambda x: x, 0)
    as_any = deal("bo", lambda x: x, lambda x: F.pmod(h, "bk"), 1)
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    dealt = live.join(size.hint("merge"), "gram").withColumn("to", F.explode(F.when(alone, one).otherwise(F.concat(F.when(F.col("odd"), as_odd).otherwise(none), as_any))))
    ranges = ranges_of(rooted)
    dealt = dealt.select(F.shiftright(F.shiftrightunsigned("gram", 32) * ranges, 32).alias("r"), "to.i", "to.j", "to.side", "gram", "sid", "n", "top", "root").join(parity.select("sid", "parity"), "sid")

    def found(part: pa.Table) -> pa.Table:
        gram, sid, n, top, root, side = (part.column(c).to_numpy() for c in ("gram", "sid", "n", "top", "root", "side"))
        bits = part.column("parity").to_pylist()
        kinds, row, ident = np.unique(sid, return_index=True, return_inverse=True)
        keys = [np.zeros(0, np.int64)]
        held = 0
        for a, b in index_pairs(gram, side):
            ok = (root[a] != root[b]) & (n[a] <= top[b]) & (n[b] <= top[a])
            a, b = ident[a[ok]], ident[b[ok]]
            keys.append(np.minimum(a, b) * len(kinds) + np.maximum(a, b))
            held += len(a)
            if held > 4_000_000:
                keys, held = [np.unique(np.concatenate(keys))], 0
        every = np.unique(np.concatenate(keys))
        a, b = row[every // len(kinds)], row[every % len(kinds)]
        near = (num + den) * differing(bits, a, b) <= (den - num) * (n[a] + n[b])
        a, b = a[near], b[near]
        return pa.table({"a": pa.array(np.minimum(sid[a], sid[b])), "b": pa.array(np.maximum(sid[a], sid[b]))})

    return dealt.groupBy("r", "i", "j").applyInArrow(found, "a long, b long").distinct()


def index_pairs(gram: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the same n-gram against each other (side 2), or of side 0 against side 1: runs of pairs of rows."""
    order = np.lexsort((side, gram))
    if not len(order):
        return
    g, s = gram[order], side[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(start, len(g)))
    whole = s[start] == 2
    for k in np.unique(size[whole]).tolist():
        i, j = np.triu_indices(k, 1)
        at = start[whole & (size == k)]
        step = max(1, 2_000_000 // max(1, len(i)))
        for x in range(0, len(at), step):
            base = at[x : x + step, None]
            yield order[(base + i).ravel()], order[(base + j).ravel()]
    for a, k in zip(start[~whole].tolist(), size[~whole].tolist(), strict=True):
        cut = a + int(np.searchsorted(s[a : a + k], 1))
        x, y = np.meshgrid(order[a:cut], order[cut : a + k], indexing="ij")
        yield x.ravel(), y.ravel()


def pieces_of(ids: DataFrame, docs: DataFrame, text_col: str, k: int, table, scratch: Scratch) -> DataFrame:
    """``(sid, f, n, grams)``: the sets of the ids in column ``sid``, cut by fragment, read from the texts again."""
    ids = scratch.table(ids.distinct())
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids, F.col("sid"), FILTER_BITS))

    def emit(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, _, h, at in sets_of(batch.column(0), k):
                sid = set_ids(h, at)
                rows: list[tuple[int, int, int, bytes]] = []
                for d in np.flatnonzero(wanted.value.holds(sid) & (sid != 0)).tolist():
                    if (x := int(sid.view(np.int64)[d])) not in seen:
                        seen.add(x)
                        one = h[at[d] : at[d + 1]]
                        f = fragment_of(one, table.value.get())
                        rows += [(x, y, len(one), K.pack(one[f == y])) for y in np.unique(f).tolist()]
                if rows:
                    columns = zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["sid", "f", "n", "grams"])

    sets = docs.select(F.col(text_col).cast("string")).mapInArrow(emit, "sid long, f long, n long, grams binary")
    out = scratch.table(sets.join(ids, "sid", "left_semi").groupBy("sid", "f").agg(F.first("n").alias("n"), F.first("grams").alias("grams")))
    wanted.destroy()
    return out


def fragment_of(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The fragment of the global order that an n-gram is in."""
    cold = ((h >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)).astype(np.int64)
    return np.where(table[(h >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)] > 0, FRAGMENTS - 1, cold)


def links(pairs: DataFrame, docs: DataFrame, text_col: str, k: int, num: int, den: int, table, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b) of set ids those with the similarity: overlaps are counted in each fragment and summed per pair."""

    pairs = scratch.table(pairs)
    pieces = pieces_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")), docs, text_col, k, table, scratch)
    of = lambda c: pieces.select(F.col("sid").alias(c), "f", F.col("n").alias("n" + c), F.col("grams").alias("g" + c))
    both = pairs.join(of("a"), "a").join(of("b"), ["b", "f"]).select("a", "b", "na", "nb", "ga", "gb")

    def count(batches):
        for batch in batches:
            last, mine, part = None, None, []
            for ga, gb in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if ga != last:
                    last, mine = ga, K.unpack(ga)
                other = K.unpack(gb)
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                part.append(int((mine[at] == other).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(part, pa.int64())], ["a", "b", "na", "nb", "part"])

    parts = both.mapInArrow(count, "a long, b long, na long, nb long, part long")
    total = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    out = scratch.table(total.where(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))
    scratch.drop(pieces)
    return out


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, num: int = NUM, den: int = DEN, stars: bool = True
) -> DataFrame:
    """``(id, n, component)`` for every row: its set's size, and the least id that links of Jaccard num/den reach.

    A null or blank text has the empty set: n 0, linked with nothing, its component its own id. A text of fewer than k words, but
    not none, is one n-gram; a text of any length is taken whole. Rows are judged one by one, so a repeated row is a copy of the
    first; of equal least ids it does not matter which row has it. Null ids take part; the least id ignores them. Only the two
    columns named are read, so other columns of any name are no matter. An empty table gives no rows. Sets and n-grams are
    64-bit fingerprints, so results are right but for collisions of those.
    """
    spark = docs.sparkSession
    ship(spark)
    if not 0 < num <= den:
        raise ValueError("the similarity is num/den, above 0 and at most 1")
    scratch = Scratch(spark, "ngram-join")
    told = scratch.table(described(docs, id_col, text_col, k))
    table = spark.sparkContext.broadcast(Sparse(levels(docs, text_col, k, spark)))
    found = scratch.table(index(docs, text_col, k, num, den, table, spark))
    entries = found.where("gram IS NOT NULL").select("gram", "sid", "n", "top", "salted")
    pairs = found.where("gram IS NULL").select(F.col("sid").alias("a"), F.col("other").alias("b"), "star")
    bits = scratch.table(told.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("parity").alias("parity")))
    counted = lambda asked: links(near_in_parity(asked, bits, num, den, scratch), docs, text_col, k, num, den, table, scratch)

    # n-grams of two sets, and for groups of near copies every set with two heads of each of its n-grams
    asked = pairs.where(F.lit(stars) | ~F.col("star")).select("a", "b")
    if stars:
        asked = asked.union(star_pairs(entries.where("salted"), scratch))
    first = counted(asked.distinct())
    roots = scratch.table(components(first, scratch))

    # all pairs that are left, between components; of an n-gram that is in several tasks, those of two sets are settled by the stars
    second = links(crossing_pairs(entries, roots, bits, 3 if stars else 2, num, den, scratch), docs, text_col, k, num, den, table, scratch)
    table.destroy()

    # components of all links, and the least id of each
    known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = components(known.union(second), scratch).select(F.col("node").alias("sid"), "root")
    rows = told.select("id", "n", "sid").join(final, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rows = scratch.table(rows.select("id", "n", "root"))
    # written, so that the join has plain inputs and a large component can be split
    lowest = scratch.table(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component")))
    return rows.join(lowest, "root", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
