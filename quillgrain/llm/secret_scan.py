"""Secret scanning through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived on
the driver: every match holds all trigrams of one of its clauses. The index
holds (text key, trigram) postings of the trigrams that some rule asks for;
postings are intersected key by key, and only the candidates are verified with
the expression itself. A rule without mandatory trigrams scans every text.

Texts are keyed by a 64-bit hash, so copies share their postings; a clash of
hashes would only add a candidate. A text travels to its candidates only if it
has an anchor (the first trigram of a clause), all others send their row alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

MAX_STRINGS = 64
FOLD = 256


class Rule(NamedTuple):
    """Leftmost non-overlapping matches count if the ``measured`` group has ``least`` characters."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1


def either_case(word: str) -> str:
    """A pattern for ``word`` in either case of A-Z; inline flags differ between engines."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base kinds, in their order (fixed values).
BASE_RULES = [
    Rule("assign", "(" + "|".join(map(either_case, ["password", "passwd", "secret", "token"])) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]+", 0, 16),
]
#: Further kinds.
MORE_RULES = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 24),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
]

#: None: any text may match. Else clauses, each a set of trigrams that must all occur.
Query = list[frozenset[str]] | None


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _absorb(clauses: list[frozenset[str]]) -> list[frozenset[str]]:
    """Drop clauses that imply another one."""
    distinct = list(dict.fromkeys(clauses))
    return [c for c in distinct if not any(d < c for d in distinct)]


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _absorb([x | y for x in a for y in b])


def trigram_query(pattern: str) -> Query:
    """Trigrams of the ASCII-lower-cased text that every match of ``pattern`` must hold."""
    from re import _constants as k
    from re import _parser

    def literal(chars) -> set[str] | None:
        """The strings of a one-character item, lower-cased, if few."""
        op, arg = chars
        if op is k.LITERAL:
            return {chr(arg).lower()}
        if op is k.IN and not any(x[0] is k.NEGATE for x in arg):
            out: set[str] = set()
            for what, value in arg:
                if what is k.LITERAL:
                    out.add(chr(value).lower())
                elif what is k.RANGE and value[1] - value[0] < 4:
                    out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out if len(out) <= 6 else None
        return None

    def flush(exact: set[str]) -> Query:
        clauses = [_trigrams(s) for s in exact]
        return None if not all(clauses) else _absorb(clauses)

    def walk(items) -> tuple[set[str] | None, Query]:
        """The exact strings of a sequence if they are few, and what any match needs."""
        exact, need, whole = {""}, None, True
        for op, arg in items:
            got, inner = literal((op, arg)), None
            if got is None and op is k.SUBPATTERN:
                got, inner = walk(arg[3])
            elif got is None and op is k.BRANCH:
                parts = [walk(x) for x in arg[1]]
                got = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
                inner = None if any(p[1] is None for p in parts) else _absorb([c for p in parts for c in p[1]])
            elif got is None and op in (k.MAX_REPEAT, k.MIN_REPEAT):
                low, high, body = arg
                once, inner = walk(body)
                if once is not None and (low, high) == (0, 1):
                    got, inner = once | {""}, None
                elif once is not None and low == high and low <= 8:
                    got = {""}
                    for _ in range(low):
                        got = {a + b for a in got for b in once}
                elif low == 0:
                    inner = None
            if got is not None and len(exact) * len(got) <= MAX_STRINGS:
                exact = {a + b for a in exact for b in got}
                continue
            need = _and(_and(need, flush(exact)), inner if got is None else flush(got))
            exact, whole = {""}, False
        return (exact, flush(exact)) if whole else (None, _and(need, flush(exact)))

    return walk(_parser.parse(pattern))[1]


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<kind, first, last>> in code points, last exclusive, of one rule."""
    matches, measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured))

    def located(found: Column) -> Column:
        # The text between matches and the matches themselves tile the text.
        gaps = F.split(text, rule.pattern, -1)
        tiles = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")), lambda t: F.struct(F.length(t["g"]).alias("g"), F.length(t["m"]).alias("m")))
        nothing = F.array().cast("array<struct<first:int,last:int>>")

        def fold(block: Column, base: Column) -> Column:
            """Spans of a block of tiles that starts at ``base``."""

            def step(acc: Column, t: Column) -> Column:
                first = acc["at"] + t["g"]
                last = first + t["m"]
                return F.struct(last.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("first"), last.alias("last")))).alias("out"))

            return F.aggregate(block, F.struct(base.alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])

        def in_blocks(t: Column) -> Column:
            # A fold copies what it has gathered; blocks keep that short in texts with many matches.
            n = F.size(found)
            blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int")), lambda b: F.slice(t, b * FOLD + 1, F.lit(FOLD)))
            sizes = lambda bs: F.transform(bs, lambda b: F.struct(F.aggregate(b, F.lit(0), lambda s, x: s + x["g"] + x["m"]).alias("g"), F.lit(0).alias("m")))
            return let(blocks, lambda bs: let(fold(sizes(bs), F.lit(0)), lambda ends: F.flatten(F.transform(bs, lambda b, i: fold(b, F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)["last"]))))))

        return let(tiles, in_blocks)

    empty = F.array().cast("array<struct<first:int,last:int,kind:string,n:int>>")

    def long_enough(found: Column) -> Column:
        sized = F.arrays_zip(located(found).alias("p"), measured.alias("v"))
        return F.transform(F.filter(sized, lambda s: F.length(s["v"]) >= rule.least), lambda s: F.struct(s["p"]["first"].alias("first"), s["p"]["last"].alias("last"), F.lit(rule.kind).alias("kind"), F.lit(0).alias("n")))

    return let(matches, lambda found: F.when(F.size(found) == 0, empty).otherwise(long_enough(found)))


class Index(NamedTuple):
    """The trigrams that the rules ask for, and each rule's clauses as positions in that list."""

    trigrams: list[str]
    clauses: list[list[list[int]] | None]

    @classmethod
    def of(cls, rules: Sequence[Rule]) -> Index:
        queries = [trigram_query(r.pattern) for r in rules]
        trigrams = sorted({t for q in queries if q for c in q for t in c})
        return cls(trigrams, [q and [sorted(trigrams.index(t) for t in c) for c in q] for q in queries])


BITS = 62


def postings(docs: DataFrame, index: Index, text: Column, key: Column) -> DataFrame:
    """(key, trigram position): which of the index's trigrams each text holds."""
    low = F.lower(text)
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i)) for i, t in enumerate(index.trigrams))))
    return docs.select(key.alias("key"), low.alias("low")).select("key", F.explode(held).alias("trigram"))


def candidates(found: DataFrame, index: Index) -> DataFrame:
    """(key, rules): intersected postings; rules is an array of the positions of possible rules."""
    words = range(-(-len(index.trigrams) // BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("trigram"), F.lit(BITS)).cast("int"))
    masks = [F.bit_or(F.when(F.floor(F.col("trigram") / BITS) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words]
    by_key = found.groupBy("key").agg(*masks)

    def holds(clause: list[int]) -> Column:
        test = F.lit(True)
        for w in words:
            want = sum(1 << (t % BITS) for t in clause if t // BITS == w)
            test = test & (F.col(f"m{w}").bitwiseAND(F.lit(want).cast("long")) == F.lit(want).cast("long"))
        return test

    def any_of(clauses: list[list[int]]) -> Column:
        test = F.lit(False)
        for c in clauses:
            test = test | holds(c)
        return test

    asked = [F.when(any_of(clauses), F.lit(n)) for n, clauses in enumerate(index.clauses) if clauses]
    return by_key.select("key", F.array_compact(F.array(*asked)).alias("rules")).filter(F.size("rules") > 0)


def scan(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found, the spans of all rules by start, then order of the rules.

    Null texts count as empty. Every row comes back, repeated ones repeated.
    """
    index = Index.of(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text)
    no_spans = F.array().cast("array<struct<first:int,last:int,kind:string,n:int>>")
    number = lambda found, n: F.transform(found, lambda s: s.withField("n", F.lit(n)))
    full = [number(_full_scan(text, r), n) for n, r in enumerate(rules) if not index.clauses[n]]
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), text.alias("text"), (F.flatten(F.array(*full)) if full else no_spans).alias("full"))
    if index.trigrams:
        anchor = F.lit(False)
        for t in sorted({index.trigrams[c[0]] for q in index.clauses if q for c in q}):
            anchor = anchor | F.contains(F.lower(F.col("text")), F.lit(t))
        # Written out, so that the join below reads plain rows: a group of copies can then be split.
        hits = cut(candidates(postings(docs, index, text, key), index), "secret-candidates")
        rows = rows.withColumn("text", F.when(anchor, F.col("text"))).join(hits, "key", "left")
        asked = [F.when(F.array_contains("rules", n), number(spans(F.col("text"), r), n)).otherwise(no_spans) for n, r in enumerate(rules) if index.clauses[n]]
        rows = rows.withColumn("found", F.when(F.col("rules").isNull() | F.col("text").isNull(), F.col("full")).otherwise(F.concat("full", *asked)))
    else:
        rows = rows.withColumn("found", F.col("full"))
    order = F.transform("found", lambda s: F.struct(s["first"].alias("first"), s["n"].alias("n"), s["last"].alias("last"), s["kind"].alias("kind")))
    return rows.select("doc_id", F.sort_array(order).alias("found"))


def _full_scan(text: Column, rule: Rule) -> Column:
    """``spans`` with a cheap test in front where the measured group is the whole match of one class."""
    simple = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    if simple and rule.measured == 0:
        # Maximal runs of a class that are long enough are the runs of at least that length.
        rule = rule._replace(pattern=f"{simple[1]}{{{rule.least},}}")
        empty = F.array().cast("array<struct<first:int,last:int,kind:string,n:int>>")
        return F.when(text.rlike(rule.pattern), spans(text, rule)).otherwise(empty)
    return spans(text, rule)


def joined(found: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end of spans, comma-joined; of some kinds only if given."""
    chosen = found if kinds is None else F.filter(found, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    found = scan(docs, [*BASE_RULES, *MORE_RULES], id_col, text_col)
    base = [r.kind for r in BASE_RULES]
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias("n_" + k) for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("found"), base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
