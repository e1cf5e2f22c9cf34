import re
import zlib
from collections import Counter

import brute
from pollweave.llm import language, queries


def grams(text):
    count = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        if not all(c.isalpha() for c in word):
            continue
        edged = f"_{word}_"
        count.update(word)
        count.update(edged[i : i + 2] for i in range(len(edged) - 1))
        count.update(edged[i : i + 3] for i in range(len(edged) - 2))
    return count


def order(count):
    number = lambda g: sum(ord(c) << 21 * n for n, c in enumerate(reversed(g)))
    top = sorted(count, key=lambda g: (-count[g], number(g)))[: language.PROFILE]
    return {g: n for n, g in enumerate(top)}


def packed(g):
    return sum(ord(c) << 21 * n for n, c in enumerate(reversed(g)))


def test_profiles_equal_plain_counts():
    texts = ["The cat, the hat!", "", "123", "É é ñandú  über-straße", "漢字 漢", "a", "it's I'm"]
    row, gram, count = language.profiles(texts)
    for n, text in enumerate(texts):
        own = {int(g): int(c) for r, g, c in zip(row, gram, count, strict=True) if r == n}
        assert own == {packed(g): c for g, c in grams(text).items()}


def test_long_texts_are_counted_in_slices(monkeypatch):
    texts = ["The cat, the hat! ß x" * 9, "no.end" * 7, "a b  c\n\nd", "漢字" * 11, ". . 1", "ΣΑΣ ας",
             "word", "-" * 30 + "z", "x" * 40]
    whole = [language.profiles([t]) for t in texts]
    for size in (1, 2, 3, 5, 1000):
        monkeypatch.setattr(language, "_CHUNK", size)
        for text, (_, gram, count) in zip(texts, whole, strict=True):
            _, own, number = language.profiles([text])
            assert dict(zip(own.tolist(), number.tolist(), strict=True)) == dict(
                zip(gram.tolist(), count.tolist(), strict=True)), (size, text)
        assert [low for low, _ in language._chunks(texts)][0] == 0
        assert sum(high - low for low, high in language._chunks(texts)) == len(texts)


def test_a_text_of_30_mb_needs_little_more_than_itself():
    import tracemalloc

    text = "über the wall and on to the sea. " * 950_000
    tracemalloc.start()
    language.profiles([text])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 500 << 20


def test_only_teachable_rows_take_places(llm):
    rows = [(n, None if n % 2 else "12 !", "en") for n in range(3000)]
    rows += [(n, "the dog and the cat", "en") for n in range(3000, 3030)]
    rows += [(n, "le chien et le chat", "fr") for n in range(4000, 4030)]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, most=20)
    assert model.languages == ["en", "fr"]


def test_query_is_right_on_held_out_documents(llm):
    docs = brute.read("documents", "/root/testdata/sf0.01")
    found = queries.op5_rank_order(llm, "/root/testdata/sf0.01").toPandas().merge(docs, on="doc_id")
    assert len(found) == len(docs)
    held = found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (held == found.held_out).all()
    assert found.score.between(0, 1).all()
    letters = found.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert ((found.lang_pred == "und") == ~letters).all()
    own = found[held & letters]
    assert (own.lang_pred == own.lang).mean() > 0.95


def test_prediction_equals_brute_force(llm):
    docs = brute.read("documents").head(60)
    df = llm.createDataFrame(docs[["doc_id", "text", "lang"]])
    learned = {}
    for d in docs.itertuples():
        if zlib.crc32(str(d.doc_id).encode()) % 3 != 1 and d.lang and d.text:
            learned.setdefault(d.lang, Counter()).update(grams(d.text))
    learned = {lang: order(count) for lang, count in learned.items()}
    rows = language.predict(df, language.fit(df)).collect()
    by = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in rows:
        own = order(grams(by[r.key]))
        away = {lang: sum(abs(p[g] - n) if g in p else language.PROFILE for g, n in own.items())
                for lang, p in learned.items()}
        best = min(sorted(away), key=away.get)
        assert r.lang_pred == best
        assert abs(r.score - (1 - away[best] / (language.PROFILE * len(own)))) < 1e-12


ROWS = [
    (1, "the the cat and the dog", "en", "x"), (1, "the the cat and the dog", "en", "x"),
    (2, None, "en", "x"), (3, "", "fr", "x"), (5, "le chat et le chien", "fr", "x"),
    (6, "le chien et le chat", "fr", "x"), (None, "the dog", None, "x"), (8, "the dog", None, "x"),
    (9, "12 !! __", "en", "x"), (10, "the " * 100_000, "en", "x"), (11, "x퟿漢", "fr", "x"),
]


def test_edges(llm):
    df = llm.createDataFrame(ROWS, "doc_id long, text string, lang string, lang_pred string")
    found = language.predict(df, language.fit(df))
    assert found.columns == ["key", "held_out", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(ROWS)
    by = {r.key: r for r in rows}
    assert by[2].lang_pred == by[3].lang_pred == by[9].lang_pred == "und"
    assert by[2].score == 0 and not by[None].held_out and by[8].lang_pred == "en"
    empty = df.limit(0)
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.predict(df, language.fit(empty)).collect()} == {"und"}
