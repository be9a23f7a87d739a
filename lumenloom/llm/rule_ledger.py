"""Quality rules as a bitmask ledger.

Every rule is evaluated once: the ledger keeps the rule's measurement and, in ``failures``, one bit a
rule. A policy is a versioned set of rules, i.e. a mask; a document is kept under it if
``failures & mask = 0``. Policies can be added, changed and ablated later from the ledger alone, by
bitwise operations and one small aggregate over distinct bitmasks; no text is read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import SPACE_CLASS, fresh, words

WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A name and the condition, over measurement columns, under which a text fails."""

    name: str
    fails: str


#: A rule's place in this tuple is its bit; append, never reorder.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars > 20 * n_words"),
)

#: Versions are never edited; a change is a new version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines"),
    # at sf0.1, of 22 labelled documents that only repeat lines (more than a fifth of them), 20 are labelled good
    "v2": ("too_few_words", "repeated_windows", "symbol_heavy", "word_length"),
}
PRODUCTION = "v2"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    Words are runs without ASCII white space. n_lines: lines with a word; n_dup_lines: of these, the ones
    equal to an earlier one. n_repeat_words: words inside some window of eight words that occurs twice or
    more, windows told apart by a 64-bit hash. A null text has no word; columns of these names in
    ``docs`` are replaced.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    base = docs.drop(*made)
    hold, win, srt, again_ = (fresh(base.columns, x) for x in ("ledger_held", "ledger_windows", "ledger_sorted", "ledger_again"))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(rf"[^{SPACE_CLASS[1:-1]}]"))
    first = base.withColumn(hold, F.struct(words(F.col(text)).alias("words"), lines.alias("lines"), F.length(F.regexp_replace(raw, f"[^{SYMBOLS}]+", "")).alias("symbols")))
    second = first.withColumn(hold, F.struct(F.size(f"{hold}.words").alias("n"), F.length(F.array_join(f"{hold}.words", "")).alias("chars"), f"{hold}.symbols", F.size(f"{hold}.lines").alias("lines"), F.size(F.array_distinct(f"{hold}.lines")).alias("distinct"), F.transform(f"{hold}.words", lambda w: F.xxhash64(w)).alias("hashes")))
    windows = f"transform(sequence(1, greatest(1, {hold}.n - {WINDOW_WORDS - 1})), i -> xxhash64(slice({hold}.hashes, i, {WINDOW_WORDS})))"
    third = second.withColumn(win, F.expr(f"CASE WHEN {hold}.n >= {WINDOW_WORDS} THEN {windows} ELSE array() END"))
    # positions of windows that occur again: neighbours in hash order; skipped where all are distinct
    fourth = third.withColumn(srt, F.expr(f"CASE WHEN size(array_distinct({win})) < size({win}) THEN array_sort(transform({win}, (h, i) -> struct(h, i))) ELSE array() END"))
    again = f"transform(filter({srt}, (x, k) -> x.h = get({srt}, k - 1).h OR x.h = get({srt}, k + 1).h), x -> x.i)"
    fifth = fourth.withColumn(again_, F.expr(f"CASE WHEN size({srt}) > 0 THEN array_sort({again}) ELSE array() END"))
    covered = f"aggregate({again_}, struct(-{WINDOW_WORDS} AS last, 0 AS n), (s, p) -> struct(p AS last, s.n + least({WINDOW_WORDS}, p - s.last) AS n), s -> s.n)"
    return fifth.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.col(f"{hold}.n").cast("long").alias("n_words"),
        F.col(f"{hold}.chars").cast("long").alias("word_chars"),
        F.col(f"{hold}.symbols").cast("long").alias("n_symbols"),
        F.col(f"{hold}.lines").cast("long").alias("n_lines"),
        (F.col(f"{hold}.lines") - F.col(f"{hold}.distinct")).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
    )


def failures(rules: Sequence[Rule] = RULES) -> Column:
    """One bit for each rule that fails; a null condition does not fail."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    known = {rule.name: 1 << k for k, rule in enumerate(rules)}
    return sum(known[x] for x in dict.fromkeys(names))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``measure`` of the documents with ``failures`` (long, one bit a rule)."""
    return measure(docs).withColumn("failures", failures(rules))


def passes(names: Sequence[str], rules: Sequence[Rule] = RULES, column: str = "failures") -> Column:
    """Whether no rule of a policy failed."""
    return F.col(column).bitwiseAND(F.lit(mask(names, rules))) == 0


def ablations(entries: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents, kept, failing the rule, and failing it alone (what dropping the rule regains).

    Counts come from distinct bitmasks, at most 2**rules of them however many documents there are. An
    empty ledger gives the same rows with zeros.
    """
    masks = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    cells = [(p, r, mask(names, rules), mask([r], rules)) for p, names in policies.items() for r in names]
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    f = F.col("failures")
    rows = [
        F.struct(
            F.lit(p).alias("policy"),
            F.lit(r).alias("rule"),
            count(F.lit(True)).alias("documents"),
            count(f.bitwiseAND(F.lit(whole)) == 0).alias("kept"),
            count(f.bitwiseAND(F.lit(bit)) != 0).alias("failed"),
            count(f.bitwiseAND(F.lit(whole)) == bit).alias("failed_alone"),
            (F.coalesce(F.bit_or(f), F.lit(0)).bitwiseAND(F.lit(bit)) != 0).alias("ever_failed"),
        )
        for p, r, whole, bit in cells
    ]
    return masks.agg(F.array(*rows).alias("cells")).select(F.inline("cells"))
