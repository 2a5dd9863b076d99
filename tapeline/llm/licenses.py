"""License scans: ordered signature rules behind a keyword gate. Built-in functions only.

A text is brought to words in lower case with one space between them. Texts that hold none of the
gate words are done. In the others every word that some rule starts with is a place to try: the
rules of that word, and no others, are matched against the next few words. Of the matches found,
one that lies inside a match of higher priority, or inside a longer one of its own, gives way.
All of it happens inside the row of the text: nothing is shuffled, and as a match covers a bounded
number of words, each place looks back over a bounded number of earlier ones.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import query, table
from tapeline.llm.license_rules import GATES, MOST_WORDS, TIERS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: ASCII but for letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GATE = f" (?:{'|'.join(GATES)}) "
MATCH = "array<struct<start:bigint,length:bigint,rule:string,label:string,priority:int,confidence:double,place:int>>"


def first_words(pattern: str) -> list[str]:
    """The literal words that a pattern may start with."""
    group = re.match(r"\(\?:([a-z0-9|]+)\) ", pattern)
    optional = re.match(r"\(\?:([a-z0-9]+) [^()]*\)\?(.*)", pattern)
    if group:
        return group[1].split("|")
    if optional:
        return [optional[1], *first_words(optional[2])]
    word = re.match(r"[a-z0-9]*", pattern)[0]
    rest = pattern[len(word):]
    if re.match(r"\[cs\]", rest):  # either spelling
        return [word + c + first for c in "cs" for first in first_words(rest[4:])]
    if rest[:1] == "?":
        raise ValueError(f"no literal word starts {pattern!r}")
    return [word]


def rules(tiers=TIERS) -> list[tuple[str, str, str, str, int, float]]:
    """(first word, rule, label, pattern, priority, confidence) in order, one row per first word."""
    out = []
    for tier, listed, priority, confidence in tiers:
        for k, (label, pattern) in enumerate(listed):
            whole = f"^(?:{pattern.replace('.{', '[^' + chr(10) + ']{')}) "
            out += [(word, f"{tier}-{k}", label, whole, priority, confidence) for word in first_words(pattern)]
    return out


def normal(text: Column) -> Column:
    """The words in lower case (A-Z only) with one space between them and none around."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, " "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def _within(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _matches(words: Column, listed: list[tuple]) -> Column:
    """Per place with a match, in order of places, the matches that start there."""
    by_word: dict[str, list[dict]] = {}
    for place, rule in enumerate(listed):
        by_word.setdefault(rule[0], []).append(dict(zip(("rule", "label", "pattern", "priority", "confidence", "place"), (*rule[1:], place))))
    rules_of = F.from_json(F.lit(json.dumps(by_word)), "map<string,array<struct<rule:string,label:string,pattern:string,priority:int,confidence:double,place:int>>>")
    starts = F.array(*map(F.lit, by_word))

    def tried(i: Column) -> Column:
        ahead = F.concat(F.concat_ws(" ", F.slice(words, i + 1, MOST_WORDS)), F.lit(" "))
        met = _within(ahead, lambda text: F.transform(F.element_at(rules_of, F.get(words, i)), lambda r: F.struct(
            i.cast("bigint").alias("start"), _spaces(F.call_function("regexp_extract", text, r["pattern"], F.lit(0))).alias("length"),
            *[r[c].alias(c) for c in ("rule", "label", "priority", "confidence", "place")])))
        return F.filter(met, lambda m: m["length"] > 0)

    here = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(starts, F.get(words, i)))
    return F.filter(F.transform(here, tried), lambda found: F.size(found) > 0)


def _outranks(e: Column, d: Column) -> Column:
    inside = (e["start"] <= d["start"]) & (e["start"] + e["length"] >= d["start"] + d["length"])
    rank = [F.struct(x["priority"], x["length"], -x["place"]) for x in (e, d)]
    return inside & (rank[0] > rank[1])


def _kept(places: Column) -> Column:
    """The matches of all places that no other one outranks."""
    def at(found: Column, k: Column) -> Column:
        near = F.slice(places, F.greatest(k - F.lit(MOST_WORDS - 2), F.lit(1)), F.least(k + 1, F.lit(MOST_WORDS)))
        return F.filter(found, lambda d: ~F.exists(near, lambda others: F.exists(others, lambda e: _outranks(e, d))))

    return F.flatten(F.transform(places, at))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", tiers=TIERS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, matches, detections, score.

    A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. A
    match has the start (in words, from 0) and length of the words that a rule covers, and the
    rule's name, label, priority and confidence; a rule is tried at every place, over the next
    ``MOST_WORDS`` words, so a longer stretch is found as far as those reach. ``matches`` are all,
    ``detections`` those not inside one of higher priority, or of the same priority and longer, or
    the same stretch by an earlier rule. ``score`` is the greatest confidence of the detections, 0
    without any. Null, empty and blank texts have no words and empty arrays. Whole texts are read.
    Repeated rows stay; an empty table gives no rows; other columns aren't read.
    """
    read = docs.select(F.col(id).alias("_id"), normal(F.col(text)).alias("_text"))
    held = F.concat(F.lit(" "), F.col("_text"), F.lit(" ")).rlike(GATE)
    n = F.when(F.col("_text") == "", F.lit(0)).otherwise(_spaces(F.col("_text")) + 1).cast("bigint")
    whole = f"struct<matches:{MATCH},detections:{MATCH}>"
    # bound to variables, so that no rewriting of the plan can make it anew for every word or place
    found = _within(F.split("_text", " "), lambda words: _within(_matches(words, rules(tiers)), lambda places: F.struct(F.flatten(places).alias("matches"), _kept(places).alias("detections"))))
    none = F.struct(F.array().cast(MATCH).alias("matches"), F.array().cast(MATCH).alias("detections"))
    scanned = read.select("_id", n.alias("n_words"), F.when(held, found.cast(whole)).otherwise(none).alias("_found"))
    return scanned.select(F.col("_id").alias(id), "n_words", "_found.matches", "_found.detections",
                          F.coalesce(F.array_max(F.transform("_found.detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"))


def _labels(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"])))


def _sql() -> str:
    listed = ", ".join(f"('{w}', '{label}', '{pattern}', {priority}, {confidence}, {k})" for k, (w, _, label, pattern, priority, confidence) in enumerate(rules()))
    return rf"""
WITH r(w, label, pattern, priority, confidence, place) AS (VALUES {listed}),
n AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}', ' ', 'g')) AS t FROM documents),
d AS (SELECT doc_id, t, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM n),
s AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i, unnest([array_to_string(w[j + 1:j + {MOST_WORDS}], ' ') || ' ' for j in range(len(w))]) AS ahead
      FROM d WHERE regexp_matches(' ' || t || ' ', '{GATE}')),
x AS (SELECT doc_id, i, label, priority, confidence, place, regexp_extract(ahead, pattern) AS x FROM s JOIN r ON r.w = s.w),
m AS (SELECT doc_id, i AS lo, len(x) - len(replace(x, ' ', '')) AS n, label, priority, confidence, place FROM x WHERE x <> ''),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m e WHERE e.doc_id = m.doc_id AND e.lo <= m.lo AND e.lo + e.n >= m.lo + m.n
      AND (e.priority > m.priority OR (e.priority = m.priority AND (e.n > m.n OR (e.n = m.n AND e.place < m.place)))))),
b AS (SELECT doc_id, count(*) AS n_base, min(lo) AS first_word, max(lo) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM m WHERE priority = 0 GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k UNION SELECT doc_id, label FROM m WHERE priority = 0) GROUP BY doc_id),
c AS (SELECT doc_id, max(confidence)::DOUBLE AS score FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""


@query("op12_license_scan", _sql())
def _op12(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["priority"] == 0)
    found = found.select("doc_id", "n_words", "score", "detections", base.alias("base"))
    starts = F.transform("base", lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(_labels(F.col("base")), ",").alias("base_labels"), F.array_join(_labels(F.concat("base", "detections")), ",").alias("labels"), "score")
