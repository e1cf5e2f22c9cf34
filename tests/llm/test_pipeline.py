import brute
import pytest
from pollweave.llm import common, quality
from test_packing import check
from test_similar import classes
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from pollweave.llm import encoding


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def without_repeats(docs, window=50):
    words = {k: brute.spaced(t) for k, t in docs}
    least = {}
    for key, own in words.items():
        for i in range(len(own) - window + 1):
            w = tuple(own[i : i + window])
            least[w] = min(key, least.get(w, key))
    out = {}
    for key, own in words.items():
        gone = set()
        for i in range(len(own) - window + 1):
            if least[tuple(own[i : i + window])] < key:
                gone.update(range(i, i + window))
        out[key] = [w for i, w in enumerate(own) if i not in gone]
    return {k: w for k, w in out.items() if w or not words[k]}


def without_windows(docs, items, window=10):
    windows = set()
    for text in items:
        own = brute.plain(text)
        n = min(window, len(own))
        windows |= {tuple(own[i : i + n]) for i in range(len(own) - n + 1) if n}
    out = {}
    for key, text in docs:
        own, gone = brute.plain(text), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    gone.update(range(i, i + n))
        if not own or len(gone) < len(own):
            out[key] = [w for i, w in enumerate(own) if i not in gone]
    return out


@pytest.fixture(scope="module")
def stages(llm):
    """Input and output of every stage on the smallest tables."""
    docs = llm.read.parquet(f"{brute.SMALL}/documents.parquet")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(stage(llm, docs, brute.SMALL), "stage")
        found.append((name, docs, out))
        docs = out
    return found


def test_stages_keep_the_columns(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, docs, out in stages[:-1]:
        assert out.columns == columns and out.dtypes == docs.dtypes
        assert out.where("n_chars <> length(text)").count() == 0
        assert 0 < out.count() <= docs.count()


def test_quality_keeps_what_the_rules_keep(llm, stages):
    _, docs, out = stages[0]
    model = quality.fit(docs, llm.read.parquet(f"{brute.SMALL}/labels.parquet"))
    kept = quality.judge(docs, model, keep=["doc_id", "text"]).where("quality.kept")
    assert pairs(out) == pairs(kept) and out.count() < docs.count()


def test_one_of_each_class_stays(stages):
    _, docs, out = stages[1]
    rows = pairs(docs)
    least = {key for key, own, _, _ in classes(rows) if key == own}
    assert [k for k, _ in pairs(out)] == sorted(least)
    assert len(least) < len(rows)


def test_repeated_passages_go(stages):
    _, docs, out = stages[2]
    expected = without_repeats(pairs(docs))
    assert {k: brute.spaced(t) for k, t in pairs(out)} == expected
    assert pairs(docs) != pairs(out)


def test_benchmark_passages_go(stages):
    _, docs, out = stages[3]
    expected = without_windows(pairs(docs), brute.read("benchmark").text)
    assert {k: brute.plain(t) for k, t in pairs(out)} == expected
    assert pairs(docs) != pairs(out)


def test_all_tokens_are_packed(stages):
    _, docs, out = stages[4]
    tokenizer = Tokenizer.from_file(encoding.path())
    assert check(out.collect(), pairs(docs), tokenizer, 1024) < 0.02


def test_run_is_the_stages(llm, stages):
    run = driver.queries()["pipeline"](llm, brute.SMALL)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert brute.rows(run.select(*columns)) == brute.rows(stages[-1][2].select(*columns))


def test_empty_and_odd_rows(llm):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (None, "a b", "en", "s", 3),
            (2, " ".join(f"w{n}" for n in range(80)), "en", None, None)] * 2
    for data in (rows, []):
        docs = llm.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.staged(stage(llm, docs, brute.SMALL), "odd")
        assert docs.count() <= len(data)
        assert {r.doc_id for r in docs.collect()} <= {2}
        assert corpus_pipeline.packed(llm, docs, brute.SMALL).count() >= 0
