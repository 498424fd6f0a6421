"""Secret scans over a trigram inverted index, in DataFrame and SQL functions alone.

From each rule's regular expression follows a Boolean query over trigrams that every match must contain (after lower-casing):
``trigram_query``, as alternatives of trigrams that must all occur (``clauses``). The index (``postings``) holds, for each trigram
that the rules ask for and each block of 32,768 rows, the rows that have it, as a bitmap. A rule's candidates are the rows in the
intersection of a clause's postings, for any of its clauses; only they are verified with the expression itself. A rule without
mandatory trigrams scans every document.

Rows get numbers when the table is written to the shared folder, so postings mean the same rows whenever they are read. The rows of
a block were neighbours in one task, so a task makes few bitmaps and the index has a few bytes a row.

Matches are leftmost and do not overlap, for each rule by itself; ``least`` drops those whose ``group`` is too short after they
were found. Places are code points, ends exclusive. A null or empty text has no matches, one of any length is scanned whole; rows are
judged one by one, repeated ones alike, and an empty table gives no rows. Columns of ``docs`` named like a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropcube.llm.shared import Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` means the same to Java and Python; ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in their order, then those that the method adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]+", 0, 27),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("live_key", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$&*+,;=-]+@"),
)
#: Marks around matches while places are counted; texts have others in their stead.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
#: Most strings that the analysis of an expression follows at once, and most clauses of a query (beyond them it asks for less).
MOST = 24
MOST_CLAUSES = 64
#: Array elements that are folded at once; even, so that every fold begins between two matches.
FOLD = 256

Query = bool | str | tuple


def both(a: Query, b: Query, op: str) -> Query:
    if a is (op == "or") or b is (op == "or"):
        return op == "or"
    if isinstance(a, bool):
        return b
    if isinstance(b, bool) or a == b:
        return a
    return (op, a, b)


def of_strings(found: set[str]) -> Query:
    """At least one of the strings occurs: each by all its trigrams."""
    out: Query = False
    for s in sorted(s for s in found if not any(t != s and t in s for t in found)):
        one: Query = True
        for i in range(len(s) - 2):
            one = both(one, s[i : i + 3], "and")
        out = both(out, one, "or")
    return out


def trigram_query(pattern: str) -> Query:
    """What every lower-cased match contains: True (nothing known), a trigram, or ("and" / "or", query, query)."""
    query, exact = _walk(parser.parse(pattern))
    return both(query, of_strings(exact), "and") if exact is not None else query


def _walk(items) -> tuple[Query, set[str] | None]:
    """Of a sequence: a query that its matches meet, and all it can match (None: not few strings)."""
    query: Query = True
    run: set[str] | None = {""}
    whole = True

    def end():
        nonlocal query, run, whole
        query = both(query, of_strings(run), "and")
        run, whole = {""}, False

    for op, arg in items:
        more: set[str] | None = None
        if op is C.LITERAL:
            more = {chr(arg).lower()}
        elif op is C.SUBPATTERN:
            inner, more = _walk(arg[3])
            query = both(query, inner, "and")
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for _, e in parts):
                more = set().union(*(e for _, e in parts))
            inner = False
            for q, e in parts:
                inner = both(inner, both(q, of_strings(e), "and") if e is not None else q, "or")
            query = both(query, inner, "and")
        elif op is C.MAX_REPEAT and arg[1] == 1 and arg[0] == 0:
            _, e = _walk(arg[2])
            more = None if e is None else e | {""}
        elif op is C.MAX_REPEAT and arg[0] >= 1:
            inner, e = _walk(arg[2])
            query = both(query, inner, "and")
            if e is not None:
                query = both(query, of_strings(e), "and")
        elif op is C.IN and len(arg) <= 8 and all(x is C.LITERAL for x, _ in arg):
            more = {chr(x).lower() for _, x in arg}
        if more is not None and len(run) * len(more) <= MOST:
            run = {a + b for a in run for b in more}
        else:
            end()
            if more is not None and len(more) <= MOST:
                run = more
    if whole:
        return query, run
    end()
    return query, None


def trigrams(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return trigrams(query[1]) | trigrams(query[2])
    return set() if isinstance(query, bool) else {query}


def clauses(query: Query) -> list[frozenset[str]]:
    """The query as alternatives of trigrams that must all occur; of two parts that make too many the one with fewer alternatives."""
    if isinstance(query, bool):
        return [frozenset()] if query else []
    if isinstance(query, str):
        return [frozenset([query])]
    a, b = (clauses(x) for x in query[1:])
    if query[0] == "and":
        found = {x | y for x in a for y in b}
        if len(found) > MOST_CLAUSES:
            return min(a, b, key=len)
    else:
        found = {*a, *b}
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def postings(rows: DataFrame, id_col: str, text_col: str, grams: list[str]) -> DataFrame:
    """``(gram, bucket, bits)``: the index of ``grams`` (numbered from 0) over rows numbered from 0."""
    listed = ", ".join(f"named_struct('k', {k}, 'g', {literal(g)})" for k, g in enumerate(grams))
    held = F.expr(f"explode(transform(array(lower({text_col})), t -> transform(filter(array({listed}), x -> contains(t, x.g)), x -> x.k))[0])")
    at = rows.select((F.col(id_col) + 1).alias("at"), held.alias("gram"))
    return at.groupBy("gram", F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))


def candidates(index: DataFrame, queries: list[Query], grams: list[str]) -> DataFrame:
    """``(id, rules)``: rows that meet the query of a rule or more, by intersecting postings; bit k of ``rules`` is for the k-th rule.

    Rules whose query is True (nothing known) are not in it: every row is a candidate of theirs.
    """
    asked = [(k, c, grams.index(g), len(clause)) for k, q in enumerate(queries) if q is not True for c, clause in enumerate(clauses(q)) for g in sorted(clause)]
    values = ", ".join(map(str, asked)) or "(0, 0, -1, 1)"
    wanted = F.broadcast(index.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(rule, clause, gram, need)"))  # the rules' own size
    met = index.join(wanted, "gram").groupBy("rule", "clause", "need", "bucket").agg(F.count("*").alias("n"), F.expr("bitmap_and_agg(bits)").alias("bits"))
    either = met.where("n = need").groupBy("rule", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    octets = "transform(sequence(0, 4095), i -> named_struct('i', i, 'b', cast(conv(hex(substring(bits, i + 1, 1)), 16, 10) as int)))"
    octet = either.select("rule", "bucket", F.expr(f"explode(filter({octets}, x -> x.b > 0))").alias("x"))
    rows = octet.select("rule", "bucket", "x", F.expr("explode(filter(sequence(0, 7), k -> shiftright(x.b, k) % 2 = 1))").alias("k"))
    return rows.select(F.expr("(bucket - 1) * 32768 + x.i * 8 + k").alias("id"), "rule").groupBy("id").agg(F.expr("bit_or(shiftleft(1L, rule))").alias("rules"))


def bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def in_folds(array: str, before: str, merge: str, start: str, step: str) -> str:
    """A fold over a long array that collects: its parts of FOLD elements are folded one by one, so nothing long is copied for each element.

    ``before`` tells of a part (``c``) what later parts need to know of it, ``merge`` joins two of these (``a``, ``b``) and ``start``
    is the first. ``step`` takes the state ``a`` (``at``, ``i``, ``out``) and the element ``x``.
    """
    number = f"sequence(0, greatest(0, (size({array}) - 1) div {FOLD}))"
    part = f"slice({array}, k * {FOLD} + 1, {FOLD})"
    told = f"transform({number}, k -> {bound('c', part, before)})"
    empty = "cast(array() as array<struct<start:int,end:int,size:int>>)"
    fold = f"aggregate({part}, named_struct('at', aggregate(slice(told, 1, k), {start}, (a, b) -> {merge}), 'i', 0, 'out', {empty}), (a, x) -> {step}, a -> a.out)"
    return bound("told", told, f"flatten(transform({number}, k -> {fold}))")


def found_spans(rule: Rule, text: str) -> Column:
    """Spans of one rule in column ``text`` (without marks): the text is cut at its matches and lengths are summed."""
    cut = f"split(regexp_replace({text}, {literal(exact(rule))}, '{OPEN}$0{CLOSE}'), '[{OPEN}{CLOSE}]', -1)"
    # parts alternate: between matches, match, between, ...
    size = f"char_length(regexp_extract(x, {literal(rule.pattern)}, {rule.group}))" if rule.group else "char_length(x)"
    one = "named_struct('start', a.at, 'end', a.at + char_length(x), 'size', 0)"
    step = f"named_struct('at', a.at + char_length(x), 'i', a.i + 1, 'out', if(a.i % 2 = 1 and {size} >= {rule.least}, array_append(a.out, {one}), a.out))"
    return F.expr(bound("p", cut, in_folds("p", "aggregate(c, 0, (a, x) -> a + char_length(x))", "a + b", "0", step)))


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, text_col: str = "text", base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, is_base), by start and then the rules' order.

    A column ``spans`` of ``docs`` is replaced.
    """
    rules = (*base, *added)
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*(trigrams(q) for q in queries)))
    scratch = Scratch(docs.sparkSession, "secrets")
    clean = F.translate(F.col(text_col).cast("string"), OPEN + CLOSE, OTHER + OTHER)
    marked = F.col(text_col).rlike(f"[{OPEN}{CLOSE}]")
    rows = scratch.table(docs.withColumn("cc_id", F.monotonically_increasing_id()))
    index = scratch.table(postings(rows, "cc_id", text_col, grams))
    passed = candidates(index, queries, grams).select(F.col("id").alias("cc_id"), F.col("rules").alias("cc_rules"))
    df = rows.join(passed, "cc_id", "left")
    df = df.withColumn("cc_text", F.when(marked, clean).otherwise(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    none = F.expr("cast(array() as array<struct<start:int,end:int,size:int>>)")
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        asked = F.lit(True) if query is True else F.coalesce(F.col("cc_rules"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        # a cheap test for any match at all stands before the cutting
        df = df.withColumn(f"cc_{k}", F.when(asked & F.col("cc_text").rlike(exact(rule)), found_spans(rule, "cc_text")).otherwise(none))
    every = [
        f"transform(cc_{k}, s -> named_struct('start', s.start, 'rank', {k}, 'end', s.end, 'kind', '{r.kind}', 'is_base', {str(k < len(base)).lower()}))"
        for k, r in enumerate(rules)
    ]
    spans = F.expr(f"transform(array_sort(concat({', '.join(every)})), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'is_base', s.is_base))")
    out = df.withColumn("spans", spans)
    return out.select(*[c for c in docs.columns if c != "spans"], "spans")


def exact(rule: Rule) -> str:
    """The expression with ``least`` in it where that finds the same: in runs of one class, which are matched in full."""
    if rule.group == 0 and (m := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)):
        return f"{m[1]}{{{rule.least},}}"
    return rule.pattern


def joined(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``scan``'s rows with every span's text replaced; spans that overlap become one. ``spans`` goes."""
    # the text between two groups of spans that overlap: from the greatest end so far to the next start that is not before it
    gap = "named_struct('start', a.at, 'end', x.start, 'size', 0)"
    step = f"named_struct('at', greatest(a.at, x.end), 'i', a.i + 1, 'out', if((k = 0 and a.i = 0) or x.start >= a.at, array_append(a.out, {gap}), a.out))"
    gaps = in_folds("spans", "aggregate(c, 0, (a, x) -> greatest(a, x.end))", "greatest(a, b)", "0", step)
    df = docs.withColumn("cc_gaps", F.when(F.size("spans") > 0, F.expr(gaps)))
    here = "array_join(transform(c, x -> substring(t, x.start - c[0].start + 1, x.end - x.start)), '{mark}')"
    part = bound("t", f"substring({text_col}, c[0].start + 1, element_at(c, -1).end - c[0].start)", here)
    parts = f"transform(sequence(0, (size(cc_gaps) - 1) div {FOLD}), k -> {bound('c', f'slice(cc_gaps, k * {FOLD} + 1, {FOLD})', part)})".replace("{mark}", mark)
    tail = f"substring({text_col}, array_max(transform(spans, s -> s.end)) + 1)"
    return df.withColumn(text_col, F.when(F.size("spans") > 0, F.expr(f"concat(array_join({parts}, '{mark}'), '{mark}', {tail})")).otherwise(F.col(text_col))).drop("cc_gaps", "spans")
