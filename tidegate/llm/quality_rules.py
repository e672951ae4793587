"""Quality rules kept as a ledger of bit masks.

Every rule is evaluated once over each whole text; the ledger holds the measurements and one bit for each rule that failed. A
policy is a version, a mask of the rules that count and how many of them may fail: applying another policy, or asking what each
rule alone takes away, needs the masks only.

Null and empty texts have no words and fail the rule on the number of words. Very long texts are measured whole, within their row.
Repeated rows get equal ledgers. A rule on a rate holds at its limit: only what exceeds it fails. Columns of the input stay as they
are, whatever they are called, but for those that the ledger itself names, which it replaces. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import SPACES, WORD, unused


@dataclass(frozen=True)
class Rule:
    """fails: of the measurements."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Policy:
    """Rows with more than ``allowed`` failures among the rules of ``mask`` go; those of ``always`` may never fail."""

    version: int
    mask: int
    allowed: int = 0


def rules() -> list[Rule]:
    """In the order of their bits. Thresholds on rates ask for enough text to tell a rate."""
    n, c = F.col("n_words"), F.col
    return [
        Rule("few_words", n < 50),
        Rule("repeated_words", 100 * c("n_repeat_words") > 50 * n),
        Rule("symbols", 100 * c("n_symbols") > 30 * n),
        Rule("repeated_lines", (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 50 * c("n_lines"))),
        Rule("long_words", c("word_chars") > 25 * n),
        Rule("short_words", c("word_chars") < 2 * n),
    ]


BASE = 0b000011
#: The policy that holds: the base rules, then all that mark junk beyond doubt.
CURRENT = Policy(version=1, mask=0b111111)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text.

    n_repeat_words counts the positions in three-word windows that the text has twice or more. Windows are sorted with their places
    within the row, so that nothing is shuffled: equal neighbours mark their places, and each place covers three positions less
    what the next one covers too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines, triples, ordered, places = (unused(docs, x) for x in ("_words", "_lines", "_triples", "_ordered", "_places"))
    staged = docs.withColumns(
        {
            words: F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            lines: F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
        }
    )
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )
    staged = staged.withColumn(triples, windows)
    in_order = F.sort_array(F.transform(triples, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    staged = staged.withColumn(ordered, F.when(F.size(F.array_distinct(triples)) < F.size(triples), in_order))
    twice = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["t"] == x["t"]) | (F.get(ordered, i + 1)["t"] == x["t"]))
    staged = staged.withColumn(places, F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, SPACES, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)),
    }
    # out of a generator, below which Spark can't push a filter: pushed, it would repeat every measurement inside it
    one = F.inline(F.array(F.struct(*[v.cast("long").alias(k) for k, v in measures.items()])))
    return staged.select(*[f"`{x}`" for x in docs.columns if x.lower() not in measures], one)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measurements and failed_rules, a bit mask in the order of ``rules()``."""
    mask = F.lit(0)
    for bit, rule in enumerate(rules()):
        mask = mask.bitwiseOR(F.when(rule.fails, F.lit(1 << bit)).otherwise(F.lit(0)))
    return measured(docs, text_col).withColumn("failed_rules", mask)


def kept(policy: Policy = CURRENT) -> Column:
    """Whether a row of a ledger passes a policy."""
    return F.bit_count(F.col("failed_rules").bitwiseAND(F.lit(policy.mask))) <= policy.allowed


def passing(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows that pass, with their own columns, whatever these are called."""
    whole = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))
    return ledger(whole).filter(kept(policy)).select("_row.*")


def ablations(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that it fails, that it alone takes away, and rows kept without it. One pass, small result."""
    mask = F.col("failed_rules").bitwiseAND(F.lit(policy.mask))
    names = [(bit, r.name) for bit, r in enumerate(rules()) if policy.mask >> bit & 1]
    counts = rows.groupBy(mask.alias("m")).agg(F.count("*").alias("n"))
    out = counts.select(
        "n", "m", F.explode(F.array(*[F.struct(F.lit(1 << b).alias("bit"), F.lit(n).alias("rule")) for b, n in names])).alias("r")
    )
    without = F.bit_count(F.col("m").bitwiseAND(F.bitwise_not(F.col("r.bit")))) <= policy.allowed
    failed = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    alone = without & (F.bit_count("m") > policy.allowed)
    return out.groupBy(F.col("r.rule").alias("rule"), F.lit(policy.version).alias("version")).agg(
        *[F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(k) for x, k in ((failed, "n_failed"), (alone, "n_alone"), (without, "n_kept_without"))]
    )
