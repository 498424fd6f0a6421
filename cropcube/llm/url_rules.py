"""URL filters by a sort-merge range join.

A host's labels in reverse, each with a dot behind it, are its canonical key: a rule's host and all its subdomains are then the
keys that begin with the rule's key, an interval of the sorted keys. Pages and intervals are dealt by ranges of keys (bounds from a
bounded sample of keys, which only sets the balance; equal keys can be split, since a hash of the page stands behind them). Each range is
swept in order of keys with a stack of the rules' hosts that are open at the place: they are nested, since intervals are prefixes. On
the stack a url's path is held against the rules of each open host. The longest rule (host and path together, then the longer
host) wins; among repeated rules block wins.

A null url, or one without ``://``, has an empty host and path. Pages without a rule get the default verdict. Rules with a null
host or path are dropped. Repeated pages are judged one by one.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropcube.llm.shared import partitions
from cropcube.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of the sample that bounds are taken from.
SAMPLE = 20_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract cuts them."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def bounds_of(keys: DataFrame, ranges: int) -> list[str]:
    """Up to ``ranges`` - 1 keys that cut a bounded, deterministic sample of them evenly."""
    n = keys.count()
    if n > SAMPLE:
        keys = keys.where(F.pmod(F.xxhash64("cc_key", F.lit(5)), F.lit(1 << 30)) < F.lit(int((1 << 30) * SAMPLE / n)))
    found = sorted((r.cc_key.encode() for r in keys.collect()))
    return sorted({found[len(found) * x // ranges] for x in range(1, ranges)}) if found else []


class Sweep:
    """Rules in key order, and a stack of the hosts open at the current key."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        self.hosts: list[str] = []
        self.paths: list[dict[str, tuple[str, str]]] = []
        for key, path, host, verdict in sorted(set(rules)):  # allow before block: block replaces it
            if not self.hosts or self.hosts[-1] != key:
                self.hosts.append(key)
                self.paths.append({})
            self.paths[-1][path] = (host + path, verdict)
        self.lengths = [sorted({len(p) for p in d}, reverse=True) for d in self.paths]
        self.next = 0
        self.stack: list[int] = []

    def at(self, key: str) -> list[int]:
        """The open hosts at ``key``; keys come in order."""
        while self.stack and not key.startswith(self.hosts[self.stack[-1]]):
            self.stack.pop()
        while self.next < len(self.hosts) and self.hosts[self.next] <= key:
            if key.startswith(self.hosts[self.next]):
                self.stack.append(self.next)
            self.next += 1
        return self.stack

    def best(self, path: str) -> tuple[str, str] | None:
        found, most = None, (-1, -1)
        for h in self.stack:
            for n in self.lengths[h]:
                rule = self.paths[h].get(path[:n]) if n <= len(path) else None
                if rule is not None:
                    rank = (len(rule[0]), len(self.hosts[h]))
                    if rank > most:
                        found, most = rule, rank
                    break
        return found


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """``pages``' columns ``keep`` (all if None) and ``host``, ``path``, ``rule``, ``verdict``; columns of these names are replaced.

    ``rules``: columns host, path, verdict (allow or block).
    """
    spark = pages.sparkSession
    ship(spark)
    ranges = partitions(spark)
    named = ["host", "path", "rule", "verdict"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in named]
    host, path = host_path(F.col(url_col))
    df = pages.select(*keep, host.alias("host"), path.alias("path"), F.col(id_col).alias("cc_id"))
    # the page's own hash stands behind the url, so that equal urls can be dealt to several ranges
    df = df.withColumn("cc_key", F.concat(host_key(F.col("host")), F.lit("\0"), "path", F.lit("\0"), F.hex(F.xxhash64("cc_id")))).drop("cc_id")
    bounds = bounds_of(df.select("cc_key"), ranges)
    marked = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        F.translate("host", UPPER, LOWER).alias("cc_host"), F.col("path").alias("cc_path"), F.col("verdict").alias("cc_verdict")
    )
    marked = marked.withColumn("cc_from", host_key(F.col("cc_host")))

    def deal(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("cc_key")).to_pylist()
            yield batch.append_column("cc_range", pa.array([bisect.bisect_right(bounds, k.encode()) for k in keys], pa.int32()))

    def deal_rules(batches):
        for batch in batches:
            at, to = [], []
            for i, k in enumerate(batch.column(batch.schema.get_field_index("cc_from")).to_pylist()):
                first = bisect.bisect_right(bounds, k.encode())
                last = bisect.bisect_right(bounds, k.encode() + b"\xff")
                to.extend(range(first, last + 1))
                at.extend([i] * (last + 1 - first))
            yield batch.take(pa.array(at, pa.int64())).append_column("cc_range", pa.array(to, pa.int32()))

    def with_range(schema: T.StructType) -> T.StructType:
        return T.StructType([*schema.fields, T.StructField("cc_range", T.IntegerType())])

    left = df.mapInArrow(deal, with_range(df.schema))
    right = marked.mapInArrow(deal_rules, with_range(marked.schema))

    def sweep(pages_: pa.Table, rules_: pa.Table) -> pa.Table:
        s = Sweep(list(zip(*(rules_.column(c).to_pylist() for c in ("cc_from", "cc_path", "cc_host", "cc_verdict")), strict=True)))
        keys, paths = pages_.column("cc_key").to_pylist(), pages_.column("path").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        rule: list[str | None] = [None] * len(keys)
        verdict = [default] * len(keys)
        last = None
        for i in order:
            here = keys[i].split("\0", 1)[0]
            if here != last:
                s.at(here)
                last = here
            if s.stack and (found := s.best(paths[i])):
                rule[i], verdict[i] = found
        out = {c: pages_.column(c) for c in [*keep, "host", "path"]}
        return pa.table(out | {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())})

    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(c, T.StringType()) for c in named])
    return left.groupBy("cc_range").cogroup(right.groupBy("cc_range")).applyInArrow(sweep, schema)


