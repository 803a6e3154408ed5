"""Quality rules by a bitmask ledger.

`ledger` evaluates every rule once per document and keeps the measurements and one failure bit per rule.
`apply_policy` reads only the bits: a policy is a version, a mask of rules and the number of failures it
tolerates. `ablations` says what each policy would keep without one of its rules, by one aggregation of the
distinct masks; no text is read again.

Defined results: a null or empty text has no words, so all counts are 0 and `too_few_words` fails; repeated
rows give repeated results; an empty table gives no rows; columns other than the id and the text are not read, so their
names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bangs", "n_distinct_words")


def _c(name: str) -> Column:
    return F.col(name)


#: Rule k has bit k. New rules go to the end, so that stored masks keep their meaning.
RULE_NAMES = ("too_few_words", "repeated_windows", "symbol_heavy", "upper_case_heavy", "bang_heavy", "word_length", "duplicate_lines", "few_distinct_words")


def rules() -> dict[str, Column]:
    """Each is true where the document fails. Integers only, so any engine gives the same bits."""
    return {
        "too_few_words": _c("n_words") < 50,
        "repeated_windows": 100 * _c("n_repeat_words") > 50 * _c("n_words"),
        "symbol_heavy": 10 * _c("n_symbols") > _c("n_words") * 3,
        "upper_case_heavy": (_c("n_letters") > 0) & (10 * _c("n_upper") > 3 * _c("n_letters")),
        "bang_heavy": 10 * _c("n_bangs") > _c("n_words") * 3,
        "word_length": (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 12 * _c("n_words")),
        "duplicate_lines": 10 * _c("n_dup_lines") > 3 * _c("n_lines"),
        "few_distinct_words": 50 * _c("n_distinct_words") < _c("n_words"),
    }


def mask_of(*names: str) -> int:
    return sum(1 << RULE_NAMES.index(n) for n in names)


@dataclass(frozen=True)
class Policy:
    """Documents that fail more than `tolerate` of the rules in `mask` are dropped."""

    version: str
    mask: int
    tolerate: int = 0


BASE = Policy("base-1", mask_of("too_few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("strict-1", mask_of(*RULE_NAMES)),
    Policy("lenient-1", mask_of("symbol_heavy", "upper_case_heavy", "bang_heavy", "duplicate_lines", "few_distinct_words"), tolerate=1),
)
DEFAULT = POLICIES[1]


def _measure(batch: pa.RecordBatch):
    for a, b, data, offsets in K.text_blocks(batch.column(1)):
        starts, ends, first = K.spans(data, offsets, K.PLAIN)
        n_words = np.diff(first)
        inside = K.PLAIN[data]
        lead = (data & 0xC0) != 0x80
        upper = (data >= 0x41) & (data <= 0x5A)
        # Two-byte upper case of Latin-1: 0xC3 0x80-0x9E.
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lower_ascii = K.LOWER[data]
        letters = ((lower_ascii >= 0x61) & (lower_ascii <= 0x7A)) | (data >= 0xC0)

        h = K.span_hashes(data, starts, ends)
        doc = K.owners(first)
        repeat_words, distinct_words = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        if len(h):
            order = np.lexsort((h, doc))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            distinct_words = np.bincount(doc[order][new], minlength=b - a)
        if len(h) > 2:
            same = doc[2:] == doc[:-2]
            at = np.flatnonzero(same)
            window = K.mix(h[at] + K.mix(h[at + 1] + K.mix(h[at + 2])))
            owner = doc[at]
            order = np.lexsort((window, owner))
            w, o = window[order], owner[order]
            equal = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
            twice = np.zeros(len(w), bool)
            twice[1:] |= equal
            twice[:-1] |= equal
            hit = np.zeros(len(h), bool)
            where = at[order[twice]]
            hit[where] = hit[where + 1] = hit[where + 2] = True
            repeat_words = np.bincount(doc[hit], minlength=b - a)

        n_lines, dup_lines = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        raw = data.tobytes()
        for i in range(b - a):
            lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            n_lines[i], dup_lines[i] = len(lines), len(lines) - len(set(lines))
        values = (n_words, K.sums(inside & lead, offsets), K.sums(SYMBOLS[data], offsets), dup_lines, repeat_words, n_lines, K.sums(letters, offsets), K.sums(upper, offsets), K.sums(data == 0x21, offsets), distinct_words)
        yield [batch.column(0).slice(a, b - a), *(pa.array(v, pa.int64()) for v in values)]


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and what the rules look at. One narrow pass over the text."""
    out = K.schema(**{id_col: docs.schema[id_col].dataType.simpleString()}, **dict.fromkeys(MEASURES, "bigint"))
    return K.map_arrow(docs.select(id_col, text_col), _measure, out)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and `failures`, a long with bit k set where rule k failed."""
    bits = sum((F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(rules()[name] for name in RULE_NAMES)), F.lit(0).cast("long"))
    return measurements(docs, id_col, text_col).withColumn("failures", bits)


def passes(policy: Policy, failures: str | Column = "failures") -> Column:
    failures = F.col(failures) if isinstance(failures, str) else failures
    return F.bit_count(failures.bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.tolerate


def apply_policy(rows: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    return rows.withColumn(column, passes(policy))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and each rule of it: documents kept with the whole policy and with that rule left out.

    The ledger is first summed by mask (2^rules rows at most), and only those few rows meet the policies."""
    by_mask = rows.groupBy("failures").agg(F.count("*").alias("n"))
    asks = [(p.version, RULE_NAMES[k], p.mask, p.mask & ~(1 << k), p.tolerate) for p in policies for k in range(len(RULE_NAMES)) if p.mask >> k & 1]
    plan = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("without_rule"), F.lit(m).cast("long").alias("m"), F.lit(l).cast("long").alias("less"), F.lit(t).alias("t")) for v, r, m, l, t in asks]))
    kept = lambda mask: F.sum(F.when(F.bit_count(F.col("failures").bitwiseAND(F.col(mask))) <= F.col("a.t"), F.col("n")).otherwise(F.lit(0)))
    return by_mask.withColumn("a", plan).groupBy(F.col("a.policy").alias("policy"), F.col("a.without_rule").alias("without_rule")).agg(kept("a.m").alias("kept"), kept("a.less").alias("kept_without"))
