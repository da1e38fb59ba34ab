"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; policies are
masks over those bits, so a new policy version, or the ablation of a rule, needs no second look at any text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table
from tessera.llm.words import Words, codes, no_nulls, repeats, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_STRUCT = pa.struct([(m, pa.int64()) for m in MEASURES])


def measure(texts: pa.Array) -> pa.Array:
    """The measurements of each text, as a struct (null texts count as empty)."""
    texts = no_nulls(texts)
    out = []
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        w = Words(part, lower=False)
        n = w.docs
        per = lambda mask, off=w.off: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
        n_words = np.diff(w.at)
        word_chars = per(w.inside & ((w.data & 0xC0) != 0x80))
        n_symbols = per(_SYMBOL[w.data])
        # Lines end at \n or at the document's end; one without a word doesn't count as repeated.
        breaks = np.flatnonzero(w.data == 10)
        start = np.sort(np.concatenate([w.off[:-1], breaks + 1]))
        end = np.sort(np.concatenate([breaks, w.off[1:]]))
        line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(w.off, breaks, "right") - 1]))
        start = np.minimum(start, end)
        seen = np.concatenate([[0], np.cumsum(w.inside)])
        has = seen[end] > seen[start]
        number, _ = codes(w.data, w.data != 10, start)
        _, later = repeats(number[has], line_doc[has])
        n_lines = np.bincount(line_doc, minlength=n)
        n_dup = np.bincount(line_doc[has][later], minlength=n)
        grams, first = w.gram_codes(3)
        often, _ = repeats(grams, w.doc[first])
        covered = np.zeros(len(w.doc) + 3, bool)
        for j in range(3):
            covered[first[often] + j] = True
        n_repeat = np.bincount(w.doc[covered[: len(w.doc)]], minlength=n)
        out.append([n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat])
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], fields=list(_STRUCT))


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measure(texts: pa.Array) -> pa.Array:
    return measure(texts)


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements holds. The bit is its place in the ledger, for ever."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "short_words", "word_chars < 3 * n_words"),
    Rule(5, "long_words", "word_chars > 12 * n_words"),
)
#: Policy versions: the rules that reject a document. A version is never changed, only followed by another.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"),
}
CURRENT = "v1"


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def ledger(docs: DataFrame, text_col: str = "text", into: str = "quality_ledger") -> DataFrame:
    """docs with a struct column (``into``, which replaces one of that name): the measurements and failed_bits.

    Null and empty texts have no words and fail few_words. Rows are independent: repeated rows each get their entry,
    other columns are left as they are, and an empty table stays one. No shuffle.
    """
    m = F.col(f"`{into}`")
    with_m = docs.withColumn(into, _measure(F.col(f"`{text_col}`").cast("string")))
    bits = F.lit(0).cast("bigint")
    for r in RULES:
        cond = r.fails
        for name in MEASURES:
            cond = cond.replace(name, f"`{into}`.{name}")
        bits = bits + F.when(F.expr(cond), F.lit(1 << r.bit)).otherwise(0).cast("bigint")
    return with_m.withColumn(into, F.struct(*[m[x].alias(x) for x in MEASURES], bits.alias("failed_bits")))


def verdict(failed_bits: Column, policy: str = CURRENT) -> Column:
    """True where no rule of the policy failed."""
    return failed_bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) == 0


def apply_policy(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs."""
    own = "__quality_ledger"
    while own in docs.columns:
        own += "_"
    return ledger(docs, text_col, own).where(verdict(F.col(own)["failed_bits"], policy)).drop(own)


def ablation(entries: DataFrame, *policies: str, into: str = "quality_ledger") -> DataFrame:
    """(policy, rule, n_failed, n_only_this): rows that fail a rule, and rows that only it rejects, which its removal would bring back.

    Rows are first counted by their failed bits, of which there are at most 2**rules, so the shuffle is tiny whatever the input,
    and any number of policies is answered by one pass.
    """
    counts = entries.groupBy(F.col(into)["failed_bits"].alias("bits")).agg(F.count("*").alias("n"))
    rules = [(p, r.name, 1 << r.bit, mask(POLICIES[p])) for p in policies or (CURRENT,) for r in RULES if r.name in POLICIES[p]]
    rules = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(bit).cast("bigint").alias("bit"), F.lit(m).cast("bigint").alias("mask")) for p, r, bit, m in rules])
    each = counts.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.policy").alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.mask")) == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("quality_ledger")
    base = q["failed_bits"].bitwiseAND(F.lit(mask(POLICIES["base"])).cast("bigint")) != 0
    return ledger(docs).select(
        "doc_id", *[q[m].alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"), verdict(q["failed_bits"]).alias("kept"), q["failed_bits"].alias("failed_bits"),
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
g AS (SELECT k, i, words[i:i+2] AS gram FROM w, unnest(range(1, len(words) - 1)) AS r(i)),
h AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM h, unnest([0, 1, 2]) AS o(j) GROUP BY k),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT
           - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 63) = 0 AS kept, failed_bits FROM b
"""


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """The ablation of every rule of every policy, from one ledger."""
    return ablation(ledger(table(spark, sf_dir, "documents").select("text")), *POLICIES)


ABLATION_SQL = f"""
WITH b AS ({OP7_SQL}),
r AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{r.name}', {1 << r.bit}, {mask(names)})" for p, names in POLICIES.items() for r in RULES if r.name in names)}) AS t(policy, rule, bit, mask))
SELECT policy, rule, count(*) FILTER ((failed_bits & bit) <> 0) AS n_failed, count(*) FILTER ((failed_bits & mask) = bit) AS n_only_this FROM b, r GROUP BY 1, 2
"""
