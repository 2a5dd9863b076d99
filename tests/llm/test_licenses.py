from __future__ import annotations

import random
import re

from compare import duck, run
from conftest_llm import DATA
from hypothesis import HealthCheck, given, settings, strategies

from tapeline.llm import license_rules, licenses
from tapeline.llm.common import ORACLES

RULES = licenses.rules()


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def by_hand(text):
    """(words, matches, detections, score): every rule at every word, every match against every other; no gates."""
    w = words_of(text)
    found = set()
    for i in range(len(w)):
        ahead = " ".join(w[i:i + license_rules.MOST_WORDS]) + " "
        for place, (_, rule, label, pattern, priority, confidence) in enumerate(RULES):
            if m := re.match(pattern, ahead):
                found.add((i, m[0].count(" "), rule, label, priority, confidence))
    # a rule has several first words, but one place matches only one of them
    order = {rule: k for k, (_, rule, *_) in reversed(list(enumerate(RULES)))}

    def outranks(e, d):
        return e[0] <= d[0] and e[0] + e[1] >= d[0] + d[1] and (e[4], e[1], -order[e[2]]) > (d[4], d[1], -order[d[2]])

    kept = {d for d in found if not any(outranks(e, d) for e in found)}
    return len(w), sorted(found), sorted(kept), max((d[5] for d in kept), default=0.0)


def shown(row):
    return (row.n_words, *[sorted((m.start, m.length, m.rule, m.label, m.priority, m.confidence) for m in ms) for ms in (row.matches, row.detections)], row.score)


def test_query(spark):
    ok, message, n = run(spark, duck(DATA), "op12", licenses._op12, ORACLES["op12_license_scan"], DATA)
    assert ok and n, message


def test_number_of_rules():
    assert sum(len(listed) for _, listed, _, _ in license_rules.TIERS) > 300


EXAMPLES: list[str] = []


@settings(max_examples=2, derandomize=True, database=None, deadline=None, suppress_health_check=list(HealthCheck))
@given(strategies.data())
def collect_examples(data):
    for _, listed, _, _ in license_rules.TIERS:
        for _, pattern in listed:
            EXAMPLES.append(data.draw(strategies.from_regex(re.compile(pattern.replace(".{", "[a-z ]{"), re.ASCII), fullmatch=True)))


def test_every_rule(spark):
    """Texts drawn from every rule, alone and run together, in capitals and with punctuation."""
    collect_examples()
    rng = random.Random(1)
    texts = list(EXAMPLES)
    texts += [", ".join(t.split(" ")).upper() for t in rng.sample(EXAMPLES, 60)]
    texts += [" or ".join(rng.sample(EXAMPLES, 12)) for _ in range(12)]
    texts += ["mit mit license license mit license", "the apache license of the general public license", "MIT-License/Apache License", "xmit license", "mit licenses é mit licenseé", "mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: shown(r) for r in licenses.scan(docs).collect()}
    want = {i: by_hand(t) for i, t in enumerate(texts)}
    assert [texts[i] for i in want if got[i] != want[i]] == []
    assert len({m[2] for _, ms, _, _ in want.values() for m in ms}) > 300  # the rules do fire


def test_suppression():
    """The lesser license is no plain one, and its version is told apart."""
    text = "under the GNU Lesser General Public License, version 2.1 or any later version"
    _, matches, kept, score = by_hand(text)
    assert {m[3] for m in matches} >= {"gpl", "lgpl", "lgpl-2.1"} and [(d[3], d[0]) for d in kept] == [("lgpl-2.1-or-later", 2)] and score == 0.8


def test_long_text(spark):
    """Thousands of detections in one text, each far from the others or beside them."""
    text = " ".join(["word " * 30 + "mit license apache license version 2.0"] * 700 + ["mit license"] * 1500)
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert shown(row)[0] == 700 * 37 + 3000 and len(row.detections) == 2 * 700 + 1500
    assert [d.start for d in row.detections[:4]] == [30, 32, 67, 69] and row.detections[-1].start == row.n_words - 2


def test_odd_rows(spark, odd_docs):
    got = licenses.scan(odd_docs)
    assert got.columns == ["doc_id", "n_words", "matches", "detections", "score"]
    assert sorted(str((r.doc_id, r.n_words, r.score)) for r in got.collect()) == sorted(str((r.doc_id, len(words_of(r.text)), 0.0)) for r in odd_docs.collect())
    assert licenses.scan(odd_docs.limit(0)).collect() == []


def test_plan_is_native(spark):
    assert not re.search("Python|Pandas|Arrow", licenses._op12(spark, DATA)._jdf.queryExecution().toString())
