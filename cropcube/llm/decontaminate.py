"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items form one suffix automaton over words (its size is bounded by
``block_words``; more items make further automata, each in its own pass over the batches). Training
texts stream through it: the automaton's length after each word is the longest run of words ending
there that some item holds. A run of ``window`` words, or a whole shorter item, is a hit.

Only stretches whose consecutive word pairs all occur in items can hold a hit, so a bit table of
pairs finds those stretches by array operations and the automaton reads just them, on the words'
own bytes.

Nulls: a null text, like an empty one, has no words and is never contaminated; a null item text is
an item without windows. Items with a text and a null id count for ``n_hit`` like others, and in ``items`` together as one NULL
at the end. Repeated rows are judged one by one. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropcube.llm import kernels as K
from cropcube.session import ship

WINDOW = 13
#: Words of items in one automaton.
BLOCK_WORDS = 1_000_000
TABLE_BITS = 22
_PAIR = np.uint64(0xA0761D6478BD642F)


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words: runs of ASCII letters, digits and non-ASCII characters."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = K.word_bounds(raw, np.array([0, len(raw)]), K.ALNUM)
    data = raw.tobytes().lower()  # bytes.lower folds A-Z alone
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class ItemAutomaton:
    """Generalised suffix automaton of items, with the items that each state's windows occur in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, words in items if words]
        sequences = [words for _, words in items if words]
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.next)
        owners: list[set[int]] = [set() for _ in range(n)]
        whole: list[set[int]] = [set() for _ in range(n)]
        for k, words in enumerate(sequences):
            state = 0
            for w in words:
                state = self.next[state][w]
                owners[state].add(k)
            if len(words) < window:
                whole[state].add(k)
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in reversed(order):  # an item holds a state's strings if it holds those of a state below
            if self.link[v] > 0 and self.length[self.link[v]] >= window:
                owners[self.link[v]] |= owners[v]
        #: For the state whose strings' lengths reach the window: the items with that window.
        self.window_state: list[int] = [0] * n
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        sizes = [len(words) for words in sequences]
        for v in order:
            up = self.link[v]
            self.window_state[v] = 0 if self.length[v] < window else v if self.length[up] < window else self.window_state[up]
            self.short[v] = self.short[up] + [(sizes[k], k) for k in sorted(whole[v])]
        self.owners = [sorted(owners[v]) if self.window_state[v] == v else [] for v in range(n)]
        self.shortest = min([window, *sizes]) if sizes else 0
        pairs = {(a, b) for words in sequences for a, b in zip(words, words[1:], strict=False)} if self.shortest > 1 else set()
        singles = {w for words in sequences for w in words} if self.shortest == 1 else set()
        self.table = np.zeros(1 << TABLE_BITS, bool)
        if pairs:
            a, b = (hash_words(list(x)) for x in zip(*sorted(pairs), strict=True))
            self.table[cells(a, b)] = True
        if singles:
            self.table[(hash_words(sorted(singles)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit runs of words [start, end) of one stretch, and the items whose windows occur in it."""
        state = length = 0
        runs: list[tuple[int, int]] = []
        found: set[int] = set()

        def hit(a: int, b: int) -> None:
            while runs and runs[-1][1] >= a:
                a0, b0 = runs.pop()
                a, b = min(a, a0), max(b, b0)
            runs.append((a, b))

        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            if length >= self.window:
                hit(i + 1 - length, i + 1)
                # the state read may hold longer strings only; its window's state has them all
                found.update(self.owners[self.window_state[state]])
            for size, k in self.short[state]:
                if size <= length:
                    hit(i + 1 - size, i + 1)
                    found.add(k)
        return runs, found


def hash_words(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return K.span_hashes(raw, ends - np.array([len(w) for w in words]), ends)


def cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (K.mix(a * _PAIR + b) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def scan_batch(auto: ItemAutomaton, column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[int]]], dict[int, list]]:
    """Words of every text; for texts with hits the word runs and items; their runs as byte spans."""
    raw, offsets = K.texts_of(column)
    n_words = np.zeros(len(offsets) - 1, np.int64)
    hits: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    spans: dict[int, list[tuple[int, int]]] = {}
    least = auto.shortest
    for i, j in K.groups(offsets):
        part = raw[offsets[i] : offsets[j]]
        local = offsets[i : j + 1] - offsets[i]
        starts, ends, first = K.word_bounds(part, local, K.ALNUM)
        n_words[i:j] = np.diff(first)
        if not least or not len(starts):
            continue
        h = K.span_hashes(part, starts, ends)
        if least > 1:
            ok = np.zeros(len(h) + 1, bool)
            ok[: len(h) - 1] = auto.table[cells(h[:-1], h[1:])]
            cut = first[1:-1] - 1
            ok[cut[cut >= 0]] = False  # pairs across two texts
            need = least - 1
        else:
            ok = np.append(auto.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)], False)
            need = 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ok]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        long = b - a >= need
        if least == 1:  # stretches end with their text
            bounds = np.unique(np.concatenate([first, a[long], b[long]]))
            a2, b2 = bounds[:-1], bounds[1:]
            inside = ok[a2]
            a, b = a2[inside], b2[inside] - 1
        else:
            a, b = a[long], b[long]
        for x, y in zip(a.tolist(), (b + 1).tolist(), strict=True):
            d = int(np.searchsorted(first, x, "right")) - 1
            words = [part[s:e].tobytes().lower() for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)]
            runs, found = auto.scan(words)
            if runs:
                at = hits.setdefault(i + d, ([], set()))
                at[0].extend((x - int(first[d]) + s, x - int(first[d]) + e) for s, e in runs)
                at[1].update(found)
                spans.setdefault(i + d, []).extend((int(starts[x + s] - local[d]), int(ends[x + e - 1] - local[d])) for s, e in runs)
    return n_words, hits, spans


SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The test items, the stated query set, in blocks of bounded size; rows come one partition at a time."""
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = item_words(row[1])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs``' columns ``keep`` (all if None) and ``n_words``, ``n_hit``, ``items``, ``spans``.

    ``spans`` are the hit byte spans of the text's UTF-8 form, merged and in order; ``items`` the ids of
    items with a window in the text, sorted as strings, NULL last. Columns of ``docs`` of these names are replaced.
    Map-only: no shuffle, whatever the size of ``docs``.
    """
    ship(docs.sparkSession)
    blocks = list(blocks_of(benchmark, item_id, item_text, block_words)) or [[]]
    names = [f.name for f in SCHEMA]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    carried = keep if text_col in keep else [*keep, text_col]
    df = docs.select(*carried)
    for k, block in enumerate(blocks):
        auto = ItemAutomaton(block, window)
        last = k == len(blocks) - 1
        cols = keep if last else carried
        schema = T.StructType([df.schema[c] for c in cols] + SCHEMA.fields)

        def run(batches, auto=auto, cols=cols, more=k > 0, last=last):
            for batch in batches:
                text = batch.column(batch.schema.get_field_index(text_col))
                n_words, hits, spans = scan_batch(auto, text)
                n = batch.num_rows
                runs: list = [merged(hits[d][0]) if d in hits else [] for d in range(n)]
                items: list = [ordered({auto.names[x] for x in hits[d][1]}) if d in hits else [] for d in range(n)]
                where: list = [merged(spans[d]) if d in spans else [] for d in range(n)]
                old = batch.column(batch.schema.get_field_index("word_runs")).to_pylist() if more else None
                if more:
                    runs = [merged([(r["start"], r["end"]) for r in o] + r0) for o, r0 in zip(old, runs, strict=True)]
                    items = [ordered({*o, *x}) for o, x in zip(batch.column(batch.schema.get_field_index("items")).to_pylist(), items, strict=True)]
                    where = [merged([(r["start"], r["end"]) for r in o] + r0) for o, r0 in zip(batch.column(batch.schema.get_field_index("spans")).to_pylist(), where, strict=True)]
                data = [pa.array(n_words), pa.array([sum(e - s for s, e in r) for r in runs], pa.int64())]
                data += [pa.array(items, _ARROW[2]), pa.array([[{"start": s, "end": e} for s, e in r] for r in where], _ARROW[3])]
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in cols] + data
                out = [*cols, *names]
                if not last:
                    arrays.append(pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], _ARROW[3]))
                    out.append("word_runs")
                yield pa.RecordBatch.from_arrays(arrays, out)

        if not last:
            schema = schema.add("word_runs", SCHEMA["spans"].dataType)
        df = df.mapInArrow(run, schema)
    return df


def ordered(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs or byte spans as sorted, disjoint spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated() -> F.Column:
    """Share limit of the contract: a twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def remove_spans(docs: DataFrame, text_col: str = "text", max_share: float = 0.05) -> DataFrame:
    """``decontaminate``'s rows after removal: texts over the share limit go, hit spans of the rest are cut out."""

    def cut(batches):
        for batch in batches:
            i, j = batch.schema.get_field_index(text_col), batch.schema.get_field_index("spans")
            texts = []
            for t, spans in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True):
                if spans:
                    b = t.encode()
                    edge = [0, *(x for s in spans for x in (s["start"], s["end"])), len(b)]
                    t = b"".join(b[a:e] for a, e in zip(edge[::2], edge[1::2], strict=True)).decode("utf-8", "replace")
                texts.append(t)
            yield batch.set_column(i, text_col, pa.array(texts, batch.column(i).type))

    kept = docs.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.lit(max_share) * F.col("n_words")))
    return kept.mapInArrow(cut, kept.schema)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
