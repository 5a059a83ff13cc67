"""Secret scans by one combined automaton.

All rules are compiled into one minimal automaton that reads every byte of a text once
and says which rules can match. Only for those rules are the spans then settled:
the mirrored automaton of the rule, run backwards, marks every byte at which a
match begins; from the leftmost mark on the anchored automaton runs to the longest
end; the next match begins behind it. Matches whose tail is too short are
dropped but still taken up, as a search with the plain pattern and a length check would do.

Defined results: a null or empty text has no spans; repeated rows have equal spans; an
empty table gives no rows; other columns stay as they are. Spans count code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automaton import Automaton, compile_patterns

COUNTED = 8
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A match is the head and one or more bytes of the class ``tail``; it counts with ``least`` of them."""

    kind: str
    head: str
    tail: str
    least: int


# Patterns and lengths of the three base kinds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
RULES = BASE + (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abeprs]-", "[A-Za-z0-9-]", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 20),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY", "-", 5),
)


@lru_cache(maxsize=8)
def combined(rules: tuple[Rule, ...]) -> Automaton:
    """All rules at once, saying which can match. Lengths are counted only where no head announces a match,
    and there up to COUNTED, since counters multiply states; the exact length is settled afterwards."""
    return compile_patterns(
        [r.head + r.tail + ("+" if r.head else f"{{{min(r.least, COUNTED)},}}") for r in rules], anywhere=True)


@lru_cache(maxsize=64)
def _settlers(rule: Rule) -> tuple[Automaton, Automaton, Automaton]:
    whole = rule.head + rule.tail + "+"
    return (compile_patterns([whole], anywhere=True, mirror=True), compile_patterns([whole], anywhere=False),
            compile_patterns([rule.head], anywhere=False))


def _longest(auto: Automaton, data: bytes, at: int) -> int:
    """End of the longest match that begins at ``at``, or -1."""
    step, first, dead = auto.step, auto.first, auto.dead
    s, best = auto.start, at if auto.start >= first else -1
    for i in range(at, len(data)):
        s = step[s + data[i]]
        if s >= first:
            best = i + 1
        elif s == dead:
            break
    return best


def _matches(rule: Rule, data: bytes) -> list[tuple[int, int]]:
    back, whole, head = _settlers(rule)
    step, first, s, starts = back.step, back.first, back.start, []
    for i in range(len(data) - 1, -1, -1):
        s = step[s + data[i]]
        if s >= first:
            starts.append(i)
    out, free = [], 0
    for at in reversed(starts):
        if at >= free:
            free = _longest(whole, data, at)
            if free - _longest(head, data, at) >= rule.least:
                out.append((at, free))
    return out


def find(data: bytes, rules: tuple[Rule, ...] = RULES, auto: Automaton | None = None) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end) of all matches in code points, in order."""
    auto = auto or combined(rules)
    step, first, s, met = auto.step, auto.first, auto.start, set()
    for b in data:
        s = step[s + b]
        if s >= first:
            met.add(s)
    if not met:
        return []
    bits = 0
    for s in met:
        bits |= auto.accepts[s]
    spans = [(a, k, b) for k, rule in enumerate(rules) if bits >> k & 1 for a, b in _matches(rule, data)]
    if not data.isascii():
        heads = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
        spans = [(int(heads[a]), k, int(heads[b])) for a, k, b in spans]
    return sorted(spans)


def secrets_of(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of a text column, by start and then by the order of the rules."""
    kinds, auto = [r.kind for r in rules], combined(rules)  # compiled here, sent with the tasks

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        data = texts.cast(pa.binary())
        return pa.array([[(kinds[k], a, b) for a, k, b in find(t.as_py() or b"", rules, auto)] for t in data], kind)

    return scan(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every found span replaced by its kind in brackets; overlapping spans count once."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    kept = F.aggregate(spans, start, lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
        s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))))
    return F.transform(F.array(kept), lambda k: F.concat(k["out"], F.substring(text, k["at"] + 1, F.char_length(text))))[0]


def with_secrets(df: DataFrame, text: str = "text", into: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return df.withColumn(into, secrets_of(text, rules))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_table(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base matches, the digest of the base spans and all spans."""
    found = with_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(F.col("secrets")).alias("spans"))
