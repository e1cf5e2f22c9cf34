import math
import re
from collections import Counter

import brute
from pollweave.llm import quality, queries


def counts(text):
    words = brute.spaced(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if brute.spaced(x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered), failed)


def found(df):
    return brute.rows(df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                "n_repeat_words", "base_failed"))


def test_counts_equal_brute_force(llm):
    docs = brute.read("documents")
    expected = sorted(((d, *counts(t)) for d, t in zip(docs.doc_id, docs.text, strict=True)),
                      key=brute.key)
    df = queries.op3_likelihood_ratio(llm, brute.SMALL)
    assert found(df) == expected
    assert any(r[5] for r in expected) and any(r[4] for r in expected)


TEXTS = [
    (1, "a b c d e f g h i j k", 1), (1, "a b c d e f g h i j k", 1), (2, None, 1), (3, "", 1),
    (None, "x y\nx y\n\n \nx y\n" * 3, 1), (4, "p q r s t " * 7000, 1),
    (5, "one two three four five six seven eight nine ten eleven   é", 1),
    (6, "a a a a a a", 1), (7, "# * $ % & | < > ##", 1),
    (8, " ".join(map(str, range(300))) + " 7 8 9 10 11", 1),
]


def test_edges_and_clashing_names(llm):
    df = llm.createDataFrame(TEXTS, "doc_id long, text string, quality int")
    labels = llm.createDataFrame([(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    judged = quality.judge(df, model)
    assert judged.columns == ["doc_id", "text", "quality", "quality_"]
    expected = sorted(((d, *counts(t)) for d, t, _ in TEXTS), key=brute.key)
    assert found(judged.select("doc_id", "quality_.*")) == expected
    empty = llm.createDataFrame([], labels.schema)
    assert quality.fit(df, empty).threshold == -math.inf
    assert set(quality.fit(df, empty).weights) == {0}
    none = llm.createDataFrame([], df.schema)
    assert quality.judge(none, quality.fit(none, labels)).count() == 0


def test_score_is_the_mean_log_ratio(llm):
    docs = brute.read("documents")
    labels = brute.read("labels")
    spark_docs = llm.createDataFrame(docs[["doc_id", "text"]])
    model = quality.fit(spark_docs, llm.createDataFrame(labels))
    assert len(model.weights) == 2 * quality.BUCKETS
    rows = quality.judge(spark_docs, model).select("doc_id", "quality.*").toPandas()
    rows = rows.merge(labels, on="doc_id")
    good = rows[(rows.quality == 1) & (rows.toxic == 0) & ~rows.base_failed]
    assert good.kept.mean() > 0.97
    assert rows[rows.quality == 0].kept.mean() < 0.3
    assert ((rows.score >= model.threshold) & ~rows.base_failed == rows.kept).all()
    # one text's score, gram by gram, with Spark's own hash of each word and pair
    text = "The and attion to the and"
    one = llm.createDataFrame([(1, text)], "doc_id long, text string")
    hashed = llm.createDataFrame([(w,) for w in text.split()], "w string").selectExpr(
        "xxhash64(w) h").collect()
    hashes = [r.h for r in hashed]
    pairs = [r.p for r in llm.createDataFrame(
        list(zip(hashes, hashes[1:], strict=False)), "a long, b long").selectExpr(
            "xxhash64(a, b) p").collect()]
    grams = [h % quality.BUCKETS for h in hashes] + [
        p % quality.BUCKETS + quality.BUCKETS for p in pairs]
    expected = sum(model.weights[g] for g in grams) / len(grams) / 10_000
    assert math.isclose(quality.judge(one, model).first().quality.score, expected)


def test_toxic_words_are_learned_and_held_out_rows_judged(llm):
    clean = "the and of a in to is on by at it as or be for with from this that was".split()
    words = lambda n, extra: " ".join(
        [clean[(n * 7 + k * (1 + n % 5) + k // 9) % 20] for k in range(60)][:50] + extra)
    vile = ["zorg", "brakk", "mulv"]
    docs, labels = [], []
    for n in range(240):
        bad = n % 4 == 0
        extra = [vile[n // 4 % 3], f"w{n}", vile[(n // 4 + 1) % 3]] if bad else [f"w{n}"]
        docs.append((n, words(n, extra)))
        if n < 160:
            labels.append((n, 1, int(bad)))
    df = llm.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(df, llm.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = {r.doc_id: r.quality.score for r in quality.judge(df, model).collect()}
    kept = {n for n, score in scores.items() if score >= model.threshold and n >= 160}
    assert not any(n % 4 == 0 for n in kept) and len(kept) >= 54


def test_labels_of_all_rows_count(llm):
    rows = 20_500
    df = llm.range(rows).selectExpr("id doc_id", "'common words' text")
    labels = llm.range(rows).selectExpr("id doc_id", "1 quality", "0 toxic")
    model = quality.fit(df, labels)
    # trusted and raw counts are the same, so every seen bucket's ratio is that of none
    assert set(model.weights) == {0}
