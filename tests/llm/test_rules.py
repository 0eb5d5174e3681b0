import re
from collections import Counter

from spanforge.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, c in Counter(grams).items() if c > 1}
    hit = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_counts_match_brute_force(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
        out = rules.apply_rules(docs).collect()
        assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
        assert not any(r.kept and r.base_failed for r in out)


def test_order_changes_work_and_not_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ways = [rules.apply_rules(docs, order, statistics=False).collect() for order in (list(rules.RULES), list(rules.RULES)[::-1])]
    assert {(r.doc_id, r.kept) for r in ways[0]} == {(r.doc_id, r.kept) for r in ways[1]}
    assert any(r.rules_run == 1 for r in ways[0] if not r.kept)


def test_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    out = rules.apply_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("n_words >= 50").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_empty(no_docs):
    assert rules.apply_rules(no_docs).count() == 0


def test_order_by_marginal_rejections_per_second():
    bit = {k: 1 << i for i, k in enumerate(rules.RULES)}
    seconds = dict.fromkeys(rules.STATISTICS, 1.0) | {"n_repeat_words": 10.0}
    # symbols rejects most, but nothing that duplicate_lines has left
    rejecting = {0: 50, bit["duplicate_lines"] | bit["symbols"]: 40, bit["capitals"]: 5, bit["symbols"]: 1, bit["repeated_trigrams"]: 6}
    order = rules.ordered(seconds, rejecting)
    assert order[:2] == ["duplicate_lines", "capitals"] and sorted(order) == sorted(rules.RULES)
    # with all its statistics known a rule costs nothing and goes first
    assert rules.ordered(seconds, {bit["repeated_trigrams"]: 1, bit["capitals"]: 90}, rules.COUNTED)[0] == "repeated_trigrams"
    assert sorted(rules.ordered({}, {})) == sorted(rules.RULES)


def test_rules_read_what_they_say():
    for k, rule in rules.RULES.items():
        t = rules.Text("One line HERE and there #1\n" * 40)
        rule(t)
        assert {s for s in rules.STATISTICS if s in vars(t)} == set(rules.READS[k]), k
