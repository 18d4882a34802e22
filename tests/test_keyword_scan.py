"""Keywords in one reading: no shuffle of words, and the same ranks for texts of one id as for a text alone."""

import random
import re

from paperloom.operators import keyword_scan, keywords
from paperloom.plans import documents

WORDS = "the The don't DON'T it's I'm who whom alpha beta gamma Delta cat e.g. U.S. x1 abc_def and/or end. end! well-known -- - $5.00 2024-01-02 (foo) é naïve Ärger thé the² İİ İç ½x 中文 the中 ́the ſo . ! ?".split()


def texts(n, seed=0):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(WORDS) + rnd.choice([" ", " ", "\n", "\xa0", ""]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_words_are_not_shuffled(spark):
    """Word by word, 1 GB of documents took more disk than there is; now each text is dealt out once, and the plan deals out none."""
    df = spark.createDataFrame(list(enumerate(texts(50))), "doc_id long, text string")
    for find in (keywords.sentence_tfidf, keywords.phrases, keywords.keywords, keywords.word_frequencies):
        plan = find(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning") == 1 and "Join" not in plan
    assert "hashpartitioning" not in documents.run(df)._jdf.queryExecution().executedPlan().toString()


def test_stopwords_as_a_tree_are_those_of_the_list():
    listed = re.compile(keywords.STOP_PATTERN.removeprefix("(?i)"))
    for t in texts(2_000):
        low = t.lower()
        assert [m.span() for m in keyword_scan._STOP.finditer(low)] == [m.span() for m in listed.finditer(low)]


def test_collected_texts_rank_as_one_alone():
    read = keyword_scan.Parts(3).read
    for t in texts(500, 1):
        s, p = read(t)
        several = keyword_scan.Several()
        several.add(s, p)
        for one, many in ((keyword_scan.tfidf(s, 30), several.tfidf(30)), (keyword_scan.rake(p, 30), several.rake(30)), (keyword_scan.merged(s, p, 15), several.merged(15))):
            assert [k for k, _ in one] == [k for k, _ in many] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(one, many))


def test_repeated_and_missing_ids(spark):
    """As SQL groups them: texts of one id are one document, rows without an id have words but no phrases."""
    rows = [(1, "Blue sky. Blue sea."), (1, "Blue sky. Green sea."), (None, "Red moon"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r["rank"], r.keyword, round(r.score, 6)) for r in keywords.phrases(df).orderBy("doc_id", "rank").collect()]
    assert [g[:3] for g in got] == [(1, 1, "blue sky blue sea"), (1, 2, "blue sky green sea")]
    assert [(r.doc_id, r.keyword) for r in keywords.keywords(df).filter("doc_id is null").orderBy("rank").collect()] == [(None, "red"), (None, "moon")]
    assert [(r.term, r.n) for r in keywords.word_frequencies(df, 2).filter("doc_id = 1").orderBy("rank").collect()] == [("blue", 3), ("sky", 2)]


def test_halves_are_rounded_up():
    assert keyword_scan.rounded(0.0009765625) == 976563 and keyword_scan.rounded(1.5) == 1_500_000_000 and keyword_scan.rounded(0.1 + 0.2) == 300_000_000
