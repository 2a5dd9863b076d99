"""Quality rules: a decision list learned from labelled statistics.

One pass over a text gives its counts; shares of them are the features. Sequential covering
learns rules for low-quality documents from a bounded sample of labelled rows: a rule grows
condition by condition on two thirds of the rows, is pruned back on the last third, and the rows
it covers are taken out before the next one. The list becomes one ordered Spark conditional.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.common import query, slices, table, utf8, words

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Labelled rows the rules are learned from at most, the first by a hash of the id.
SAMPLE_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct")
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?.,;:-_=+~^/\\()[]{}'\"@`"
_BLANK = b" \t\n\r\x0b\x0c"


def counts(text: bytes | None) -> tuple[int, ...]:
    """The numbers of ``COUNTS``, over the whole text."""
    text = text or b""
    w = words(text)
    joined = b"".join(w)
    without = lambda chars: len(joined) - len(joined.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return (len(w), len(joined.translate(None, _CONTINUED)), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(w),
            without(_UPPER), without(_DIGITS), without(_MARKS), len(lines), len(set(w)))


def repeated_words(w: list[bytes]) -> int:
    """Words inside windows of five words that stand twice or more in the text."""
    joined, starts, ends, at = b" ".join(w), [], [], 0
    for x in w:
        starts.append(at)
        at += len(x)
        ends.append(at)
        at += 1
    windows = [joined[s:e] for s, e in zip(starts, ends[WINDOW - 1:])]
    if len(set(windows)) == len(windows):
        return 0
    found, total, reach = Counter(windows), 0, 0
    for i, x in enumerate(windows):
        if found[x] > 1:
            total += i + WINDOW - max(i, reach)
            reach = i + WINDOW
    return total


def with_counts(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """``docs`` with a struct column ``prefix`` of the counts of each text."""
    made = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [counts(t) for t in utf8(b, text)]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(cols, names=list(COUNTS))], names=[*b.schema.names, prefix])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(prefix, made)]))


def features(c: str) -> dict[str, Column]:
    """Shares that rules may test, from a struct of counts."""
    n, chars, lines = (F.greatest(F.col(f"{c}.{x}"), F.lit(1)) for x in ("n_words", "word_chars", "n_lines"))
    return {
        "words": F.col(f"{c}.n_words").cast("double"), "chars_per_word": F.col(f"{c}.word_chars") / n, "symbols_per_word": F.col(f"{c}.n_symbols") / n,
        "dup_line_share": F.col(f"{c}.n_dup_lines") / lines, "repeat_share": F.col(f"{c}.n_repeat_words") / n, "upper_share": F.col(f"{c}.n_upper") / chars,
        "digit_share": F.col(f"{c}.n_digits") / chars, "marks_per_word": F.col(f"{c}.n_marks") / n, "words_per_line": F.col(f"{c}.n_words") / lines,
        "distinct_share": F.col(f"{c}.n_distinct") / n,
    }


def base_failed(c: str) -> Column:
    n, repeats = F.col(f"{c}.n_words"), F.col(f"{c}.n_repeat_words")
    return (n < MIN_WORDS) | (repeats * 100 > n * MAX_REPEAT_PERCENT)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] >= F.lit(self.threshold) if self.above else f[self.feature] < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _cuts(v: np.ndarray, bad: np.ndarray, most: int = 128) -> np.ndarray:
    """Values halfway between neighbours, taken evenly over the rows and over the bad ones."""
    at = np.linspace(0, 1, most)
    u = np.unique(np.concatenate([np.quantile(v, at, method="nearest"), np.quantile(v[bad], at, method="nearest")]))
    return (u[1:] + u[:-1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule, inside = (), np.ones(len(bad), bool)
    while (p0 := int((inside & bad).sum())) and (n0 := int((inside & ~bad).sum())):
        best, chosen = 1e-9, None
        for name, v in x.items():
            v_in, bad_in = v[inside], bad[inside]
            order = np.argsort(v_in, kind="stable")
            sorted_v, p_upto, n_upto = v_in[order], np.concatenate([[0], np.cumsum(bad_in[order])]), np.concatenate([[0], np.cumsum(~bad_in[order])])
            for cut in _cuts(v_in, bad_in):
                k = int(np.searchsorted(sorted_v, cut))
                for above, p, n in ((True, p0 - p_upto[k], n0 - n_upto[k]), (False, p_upto[k], n_upto[k])):
                    if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best:
                        best, chosen = gain, Condition(name, above, float(cut))
        if chosen is None:
            break
        rule, inside = (*rule, chosen), inside & chosen.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = _covers(r, x, len(bad))
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    kept = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(kept, key=lambda r: (round(worth(r), 9), -len(r)), default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, support: int = 3, most: int = 32) -> list[Rule]:
    """Rules for the bad rows, in order. A rule that covers under ``support`` bad rows, or of whose
    rows under ``precision`` are bad, ends the list. No rows, or rows of one kind, give no rule."""
    rules: list[Rule] = []
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < most and bad.any() and not bad.all():
        pick = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        rule = _prune(_grow(*pick(~third)), *pick(third))
        covered = _covers(rule, x, len(bad))
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not rule or p < support or p < precision * (p + n):
            break
        rules.append(rule)
        x, third, bad = {k: v[~covered] for k, v in x.items()}, third[~covered], bad[~covered]
    return rules


def verdict(rules: list[Rule], f: dict[str, Column]) -> tuple[Column, Column]:
    """(kept, number of the rule that fired or null), as ordered conditionals."""
    fired = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        held = rule[0].column(f)
        for c in rule[1:]:
            held = held & c.column(f)
        fired = F.when(held, F.lit(i)).otherwise(fired)
    return fired.isNull(), fired


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn the list from labelled documents that pass the base rules; label 0 is low quality."""
    picked = labels.select(F.col(id).alias("_id"), F.col(label).alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(
        F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")  # at most ``sample`` rows
    stats = with_counts(rows, "_text", "c").where(~base_failed("c"))
    seen = stats.select("_id", "_y", *[v.alias(k) for k, v in features("c").items()]).orderBy(F.xxhash64("_id"), "_id").limit(sample).toPandas()
    return learn({k: seen[k].to_numpy(np.float64) for k in features("c")}, seen["_y"].to_numpy() == 0)


def judged(docs: DataFrame, rules: list[Rule], id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, kept and the rule that fired.

    Null and empty texts have counts of 0 and fail the base rules. Repeated rows stay; an empty
    table gives no rows; other columns aren't read.
    """
    kept, fired = verdict(rules, features("c"))
    return with_counts(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "c").select(
        F.col("id").alias(id), *[f"c.{x}" for x in COUNTS[:5]], base_failed("c").alias("base_failed"), (~base_failed("c") & kept).alias("kept"), fired.alias("rule"))


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the list. Columns are kept.

    Null, empty and blank texts fail the base rules and go; null ids and repeated rows are judged
    like others, each by its own text. An empty table gives no rows.
    """
    c = "c"
    while c in docs.columns:
        c = "_" + c
    kept, _ = verdict(rules, features(c))
    return with_counts(docs, text, c).where(~base_failed(c) & kept).select(*docs.columns)


@query("op5_quality_rules")
def _op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
