"""Quality rules kept as a bitmask ledger.

Each text is measured once and every rule is evaluated once; the ledger holds the
measurements and one failure bit per rule. Policies are masks over those bits with a
version name: applying one, comparing several, or leaving out single rules needs the
ledger alone, by bitwise operations, and never the texts again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import unwrapped, whole
from lagwise.llm.textstats import MEASURES, measured


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; whole numbers only, so that no result hangs
    on how a quotient is rounded. The rule's bit is its place in the list, for ever."""

    name: str
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("shouting", "100 * n_upper_words > 40 * n_words"),
    Rule("exclamations", "100 * n_exclaim > 30 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("digits", "100 * n_digits > 30 * word_chars"),
    Rule("control_characters", "100 * n_rare_bytes > 5 * word_chars"),
    Rule("few_distinct_words", "n_words >= 100 and 100 * n_distinct < 5 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A text is rejected if it fails any of ``rules``, or ``limit`` of ``soft`` ones."""

    version: str
    rules: tuple[str, ...]
    soft: tuple[str, ...] = ()
    limit: int = 2


BASE = Policy("base", ("too_few_words", "repeated_windows"))
V1 = Policy("v1", (*BASE.rules, "symbols", "repeated_lines", "shouting", "exclamations"))
V2 = Policy(
    "v2", V1.rules, soft=("word_length", "digits", "control_characters", "few_distinct_words"), limit=1
)
POLICIES = (BASE, V1, V2)


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[n] for n in names)


def fail_bits(rules: Sequence[Rule] = RULES) -> Column:
    """Failure bits over measurement columns."""
    if len(rules) > 63:
        raise ValueError("at most 63 rules fit a ledger")
    return sum(
        (F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)),
        F.lit(0).cast("long"),
    )


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, the measurements and ``fail_bits``, a row per row of ``docs``.

    Null and empty texts have all measurements 0 and fail ``too_few_words``. Repeated rows
    are judged alike, each on its own. Columns outside ``keep`` are not read, so their names
    cannot clash; no rows give no rows.
    """
    found = docs.select(*keep, measured(F.col(text)).alias("_m")).select(
        *keep, *(F.col(f"_m.{n}").alias(n) for n in MEASURES)
    )
    return found.withColumn("fail_bits", fail_bits(rules))


def passes(policy: Policy, bits: Column | str = "fail_bits", rules: Sequence[Rule] = RULES) -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    fine = bits.bitwiseAND(F.lit(mask(policy.rules, rules)).cast("long")) == 0
    if policy.soft:
        fine &= F.bit_count(bits.bitwiseAND(F.lit(mask(policy.soft, rules)).cast("long"))) < policy.limit
    return fine


def apply_policies(entries: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """The ledger with one boolean ``kept_<version>`` per policy."""
    return entries.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablations(entries: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule, rejected, only_by_it): texts that fail each rule of a policy, and those that
    the policy without this rule would keep.

    The ledger is first counted by bit pattern, of which there are at most 2^rules and in
    practice dozens; everything else works on those counts.
    """
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = []
    for name in (*policy.rules, *policy.soft):
        bit = F.lit(mask([name], rules)).cast("long")
        without = Policy(
            policy.version,
            tuple(r for r in policy.rules if r != name),
            tuple(r for r in policy.soft if r != name),
            policy.limit,
        )
        failed = F.col("fail_bits").bitwiseAND(bit) != 0
        rows.append((name, failed, ~passes(policy) & passes(without)))
    sums = counts.agg(
        *(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{kind}_{i}") for i, row in enumerate(rows) for kind, c in zip("ab", row[1:]))
    )
    lines = F.array(
        *(
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(f"a_{i}", F.lit(0)).alias("rejected"),
                F.coalesce(f"b_{i}", F.lit(0)).alias("only_by_it"),
            )
            for i, (name, _, _) in enumerate(rows)
        )
    )
    return sums.select(F.inline(lines))


def quality_rules(docs: DataFrame, policy: Policy = V1) -> DataFrame:
    """The query's digest: base measurements, ``base_failed`` and the policy's verdict."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE.rules)).cast("long")) != 0
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "fail_bits",
    )


def keep_good(docs: DataFrame, policy: Policy = V1, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass base rules and policy, all columns as they are."""
    judged = whole(docs).select("_row", measured(F.col(f"_row.`{text}`")).alias("_m")).select("_row", "_m.*")
    judged = judged.withColumn("_bits", fail_bits())
    return unwrapped(judged.where(passes(BASE, "_bits") & passes(policy, "_bits")))
