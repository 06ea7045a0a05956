"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match
must contain. The index is a written table of postings: one row for each trigram that some
query names and each document that has it. A document is named by its id and by hash and length
of its text, so no text is in the index and none is shuffled for it. Postings of a document
come together once; a conjunction holds where all its trigrams are there, a query where one of
its conjunctions holds, and what is left are candidates, (document, rules). Only their texts
are verified, each with its candidate rules. Rules without mandatory trigrams (hex) scan every
text fully.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, staged

try:
    import re._constants as sre
    import re._parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: Exact strings that a part of a pattern may stand for before it counts as anything.
MAX_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern in syntax that Java and Python share; a match counts if its group has least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, then those that are added to them. Fixed values.
BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("login", r"://[A-Za-z0-9._-]+:[^\x00-\x20/:@]+@", 0, 8),
)
RULES = BASE_RULES + ADDED_RULES

ALL = frozenset()  # the query that every text satisfies


def _or(a: frozenset, b: frozenset) -> frozenset:
    """Queries are sets of conjunctions, each a frozenset of trigrams; the empty set is true."""
    return ALL if not a or not b else frozenset(x for x in a | b if not any(y < x for y in a | b))


def _and(a: frozenset, b: frozenset) -> frozenset:
    return b if not a else a if not b else frozenset(x | y for x in a for y in b)


def _grams(strings: set[str]) -> frozenset:
    """What each text that has one of the strings must hold."""
    out = None
    for s in strings:
        one = frozenset({frozenset(s[i : i + 3] for i in range(len(s) - 2))}) if len(s) > 2 else ALL
        out = one if out is None else _or(out, one)
    return out or ALL


def trigram_query(pattern: str) -> frozenset:
    """Boolean trigram query of a pattern, over lower-cased text: any of the conjunctions, all trigrams of it.

    Walks the parsed pattern from left to right and keeps the set of strings that end in the
    current place; where that set gets unbounded, the trigrams so far are conjoined to the query.
    """

    def strings(op, arg) -> set[str] | None:
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN and all(k in (sre.LITERAL, sre.RANGE) for k, _ in arg):
            found = {chr(v).lower() for k, v in arg if k is sre.LITERAL} | {chr(c).lower() for k, v in arg if k is sre.RANGE for c in range(v[0], min(v[1], v[0] + 64) + 1)}
            return found if len(found) <= 8 else None
        if op is sre.MAX_REPEAT and arg[1] <= 1:
            inner = exact(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        if op is sre.SUBPATTERN:
            return exact(arg[3])
        if op is sre.BRANCH:
            parts = [exact(x) for x in arg[1]]
            return None if any(x is None for x in parts) else set().union(*parts)
        return None

    def exact(sequence) -> set[str] | None:
        out = {""}
        for op, arg in sequence:
            own = strings(op, arg)
            if own is None or len(out) * len(own) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in own}
        return out

    def walk(sequence) -> frozenset:
        query, tail = ALL, {""}
        for op, arg in sequence:
            own = strings(op, arg)
            if own is not None and len(tail) * len(own) <= MAX_STRINGS:
                tail = {a + b for a in tail for b in own}
                continue
            query, tail = _and(query, _grams(tail)), {""}
            if own is not None:
                tail = own
            elif op is sre.SUBPATTERN:
                query = _and(query, walk(arg[3]))
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                query = _and(query, walk(arg[2]))
            elif op is sre.BRANCH:
                either = None
                for x in arg[1]:
                    either = walk(x) if either is None else _or(either, walk(x))
                query = _and(query, either or ALL)
        return _and(query, _grams(tail))

    return walk(sre_parse.parse(pattern))


def plan(rules: tuple[Rule, ...]) -> tuple[list[str], dict[str, frozenset]]:
    """All trigrams that the rules' queries name, in order, and the query of each rule."""
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    return sorted({t for q in asked.values() for c in q for t in c}), asked


KEY = ("__id", "__hash", "__length")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the columns that name a document in the index."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__id": F.col(id_col), "__hash": F.xxhash64(text), "__length": F.octet_length(text)})


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram as its place in trigrams, __id, __hash, __length) of each trigram that a text has, A-Z lower-cased."""
    lowered = _keyed(docs, id_col, text_col).select(*KEY, ascii_lower(F.col(text_col)).alias("__lower"))
    there = F.array(*[F.when(F.contains("__lower", F.lit(t)), F.lit(n)) for n, t in enumerate(trigrams)]) if trigrams else F.array().cast("array<int>")
    return lowered.select(F.explode(F.array_compact(there)).alias("trigram"), *KEY)


def candidates(index: DataFrame, trigrams: list[str], queries: list[frozenset]) -> DataFrame:
    """(__id, __hash, __length, rules): documents that fulfil a query or more; bit n of rules stands for query n. Queries that are always true are left out."""
    words = [F.bit_or(F.when(F.col("trigram").between(at, at + 61), F.expr(f"shiftleft(1L, trigram - {at})")).otherwise(F.lit(0).cast("long"))) for at in range(0, max(len(trigrams), 1), 62)]
    together = index.groupBy(*KEY).agg(F.array(*words).alias("__bits"))
    rules = F.lit(0).cast("long")
    for n, query in enumerate(queries):
        if query:
            rules = rules.bitwiseOR(F.when(_holds(F.col("__bits"), query, trigrams), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")))
    return together.select(*KEY, rules.alias("rules")).where("rules <> 0")


def _candidates_of(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> tuple[DataFrame, list[frozenset]]:
    """Written candidates of docs, from a written index, and the queries of the rules."""
    trigrams, asked = plan(rules)
    queries = [asked[r.kind] for r in rules]
    return staged(candidates(staged(postings(docs, trigrams, id_col, text_col), "postings"), trigrams, queries), "candidates"), queries


def _same(a: DataFrame, b: DataFrame) -> Column:
    one = None
    for c in KEY:
        one = a[c].eqNullSafe(b[c]) if one is None else one & a[c].eqNullSafe(b[c])
    return one


def _holds(bits: Column, query: frozenset, trigrams: list[str]) -> Column:
    """The query on posting bits: intersect the postings of each conjunction, unite the conjunctions."""
    where = {t: divmod(i, 62) for i, t in enumerate(trigrams)}
    either = None
    for conjunction in sorted(query, key=sorted):
        masks: dict[int, int] = {}
        for t in conjunction:
            masks[where[t][0]] = masks.get(where[t][0], 0) | 1 << where[t][1]
        every = None
        for w, mask in sorted(masks.items()):
            one = bits[w].bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long")
            every = one if every is None else every & one
        either = every if either is None else either | every
    return F.lit(True) if either is None else either


def _java(rule: Rule) -> str:
    """For kinds that are one run of characters after a prefix, matches that are too short are never begun."""
    return rule.pattern[:-1] + "{%d,}" % rule.least if rule.kind == "hex" else rule.pattern


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of the rule's matches, leftmost and without overlap; those that are too short are dropped."""
    pattern = F.lit(_java(rule))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, _java(rule), -1)
    lengths = F.transform(whole, lambda m: F.length(m))
    own = lengths if rule.group == 0 else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m))
    zipped = F.arrays_zip(lengths.alias("whole"), own.alias("own"), F.transform(F.slice(between, 1, F.size(whole)), lambda p: F.length(p)).alias("gap"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["whole"]
        hit = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(F.size(whole) > 0, folded).otherwise(none)


def _named(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every document: (id_col, found), found an array of (start, rank, kind, end) by start, then by the rules' order.

    Whole texts are scanned. Rows that agree in id and in hash (64 bits) and length of their text
    are one document of the index; each row has its result. A null or empty text has an empty
    array; an empty table gives an empty result; other columns are ignored whatever their names. Positions are code points, ends exclusive. Matches of one
    kind never overlap; those of different kinds may.
    """
    found, queries = _candidates_of(docs, rules, id_col, text_col)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def shaped(rank: int, text: str) -> Column:
        return F.transform(_spans(F.col(text), rules[rank]), _named(rank, rules[rank].kind))

    texts = _keyed(docs.select(id_col, text_col), id_col, text_col).select(*KEY, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    asked_for = texts.join(found, _same(texts, found)).select(*[texts[c] for c in KEY], "__text", "rules")
    parts = [F.when(F.col("rules").bitwiseAND(F.lit(1 << n).cast("long")) != 0, shaped(n, "__text")).otherwise(none) for n, q in enumerate(queries) if q]
    verified = asked_for.select(*KEY, F.concat(none, *parts).alias("verified")).where(F.size("verified") > 0)
    verified = staged(verified.groupBy(*KEY).agg(F.first("verified").alias("verified")), "verified")  # repeated rows are one document of the index
    full = [shaped(n, "__text") for n, q in enumerate(queries) if not q]
    scanned = texts.select(*KEY, F.concat(none, *full).alias("full"))
    both = F.array_sort(F.concat("full", F.coalesce("verified", none)))
    return scanned.join(verified, _same(scanned, verified), "left").select(scanned["__id"].alias(id_col), both.alias("found"))


def _written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans as text."""
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.size(F.filter("found", _of_rank(n))).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)]
    return scanned.select(id_col, *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with the same columns, every secret in text_col replaced by mark; overlapping spans are replaced together.

    Null texts stay null. Candidates come from the index, as in scan, and are joined to the rows.
    """
    found, queries = _candidates_of(docs, rules, id_col, text_col)
    keyed = _keyed(docs, id_col, text_col)
    out = keyed.join(found, _same(keyed, found), "left").select(*[keyed[c] for c in docs.columns], found["rules"].alias("__rules"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    wanted = lambda n: F.lit(True) if not queries[n] else F.coalesce(F.col("__rules").bitwiseAND(F.lit(1 << n).cast("long")) != 0, F.lit(False))
    out = out.withColumn("__spans", F.array_sort(F.concat(*[F.when(wanted(n), _spans(text, r)).otherwise(none) for n, r in enumerate(rules)])))

    def step(acc, s):
        inside = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["text"]).otherwise(F.concat(acc["text"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("text"),
        )

    folded = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step, lambda a: F.concat(a["text"], text.substr(a["at"] + 1, F.length(text))))
    return out.withColumn(text_col, F.when(F.size("__spans") > 0, folded).otherwise(F.col(text_col))).drop("__rules", "__spans")
