"""Rule bitmask ledger for document quality, in DataFrame functions only.

``evaluate`` looks at every text once and stores what it measured together with one
failure bit per rule. Policies are masks over those bits, so a new policy version, its
verdicts and the ablation of each of its rules are bitwise work on the ledger and never
touch a text again.

Defined results: a null or empty text has no words and fails ``too_few_words``; a text
of white space only likewise. Repeated rows are judged each on its own. Columns of the
input other than the text pass through; one that carries a ledger column's name is
replaced by the ledger's. An empty table gives an empty ledger with the same columns.
A text of any length stays one cell: work and memory are in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
HAS_WORD = r"[^\x20\x09-\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` of the measures (by name) is true; ``bit`` never changes its meaning."""

    name: str
    bit: int
    fails: Callable[[Column], Column]


#: Bits are append-only: a ledger written today stays readable under later rule lists.
RULES = (
    Rule("too_few_words", 0, lambda m: m["n_words"] < 50),
    Rule("repeated_trigrams", 1, lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", 2, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", 3, lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("upper_case", 4, lambda m: 2 * m["n_upper"] > m["word_chars"]),
    Rule("short_words", 5, lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", 6, lambda m: m["word_chars"] > 20 * m["n_words"]),
)


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is rejected if any of these rules failed."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_trigrams"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def _bound(value: Column, body) -> Column:
    """``body`` over ``value`` computed once: a lambda variable is not expanded where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside a window of three that the text has twice or more.

    Windows are compared by a 64-bit hash. A sort of plain longs tells whether any
    window repeats; only then are (hash, place) pairs sorted to find the places.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _bound(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        # a window adds three words, less those the next window covers as well
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(3)), F.lit(3))),
            F.lit(0),
            lambda total, n: total + n,
        )

    counted = _bound(
        windows(words),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(places(h), covered)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def _words_of(text: Column) -> Column:
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), WHITE[1:], text)
    return F.array_remove(F.split(spaced, " "), "")


def judge(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct of all measures (long) and ``failed_bits`` of one text, each evaluated once.

    The words, the lines and the measures are bound as lambda variables. A filter on the
    result can thus be pushed anywhere without computing its parts again for every use.
    """
    t = F.coalesce(text, F.lit(""))

    def measures(words: Column, lines: Column) -> Column:
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_upper": F.length(F.regexp_replace(t, r"[^A-Z]+", "")),
        }
        return F.struct(*[values[m].cast("long").alias(m) for m in MEASURES])

    def entry(m: Column) -> Column:
        bits = [F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
        return F.struct(*[m[k].alias(k) for k in MEASURES], reduce(lambda a, b: a.bitwiseOR(b), bits).alias("failed_bits"))

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(HAS_WORD))
    return _bound(_words_of(t), lambda w: _bound(_bound(lines, lambda x: measures(w, x)), entry))


def evaluate(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger: the input's columns, the measures, and ``failed_bits`` (long)."""
    own = [*MEASURES, "failed_bits"]
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    name = "_ledger"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    return docs.select(*others, judge(F.col(f"`{text}`"), rules).alias(name)).select(
        *others, *[F.col(f"{name}.{k}") for k in own]
    )


def apply_policy(ledger: DataFrame, policy: Policy = STANDARD, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``kept``, the verdict of one policy version, from the stored bits alone."""
    return ledger.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablations(ledger: DataFrame, policy: Policy = STANDARD, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule of the policy: what it rejects, and what only it rejects.

    ``n_failed`` documents fail the rule, ``n_only`` would be kept without it,
    ``n_kept_without`` is the size of the corpus under the policy less this rule.
    One bitwise aggregation over the ledger; the result has a row per rule.
    """
    mask = policy.mask(rules)
    chosen = [r for r in rules if r.name in policy.rules]
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask))

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")

    wide = ledger.agg(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                count(bits.bitwiseAND(F.lit(1 << r.bit)) != 0).alias("n_failed"),
                count(bits == F.lit(1 << r.bit)).alias("n_only"),
                count(bits.bitwiseAND(F.lit(mask & ~(1 << r.bit))) == 0).alias("n_kept_without"),
            ).alias(f"r{r.bit}")
            for r in chosen
        ]
    )
    one = F.explode(F.array(*[F.col(f"r{r.bit}") for r in chosen])).alias("r")
    return wide.select(F.lit(policy.version).alias("policy"), one).select("policy", "r.*")


def reject(docs: DataFrame, policy: Policy = STANDARD, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    failed = judge(F.col(f"`{text}`"), rules)["failed_bits"]
    return docs.filter(failed.bitwiseAND(F.lit(policy.mask(rules))) == 0)
