import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from pollweave.llm import encoding, packing, queries
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(encoding.path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(rows, docs, tokenizer, window):
    """Every id in one piece, sequences full and gapless; the share of padding."""
    ids = defaultdict(list)
    for key, text in docs:
        ids[key].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        key = r["key"] if "key" in r else r["doc_id"]
        seen[key, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, own in ids.items():
        for one in {tuple(x) for x in own}:
            times = own.count(list(one))
            parts = sorted((r.start, r.length, r.ids_crc32) for r in seen[key, len(one)])
            expected = [
                (a, min(window, len(one) - a), crc(one[a : a + window]))
                for other in own if len(other) == len(one)
                for a in range(0, len(one), window)]
            assert sorted(expected) == parts and times
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    total = sum(n for own in sequences.values() for _, n in own)
    return 1 - total / (window * len(sequences)) if sequences else 0


def test_query_packs_every_id_with_little_padding(llm, tokenizer):
    docs = list(brute.read("documents")[["doc_id", "text"]].itertuples(index=False))
    rows = queries.op9_least_squares(llm, brute.SMALL).collect()
    assert check(rows, docs, tokenizer, 1024) < 0.01


ODD = [
    (1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "it's <|endoftext|> × \n\n x"),
    (4, "tick " * 9000), (5, " ".join(map(str, range(700)))), (6, "漢字 é  \t z"),
]


def test_edges(llm, tokenizer):
    df = llm.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, start int")
    rows = packing.pack(packing.pieces(df, window=64, with_ids=True), 64).collect()
    check(rows, ODD, tokenizer, 64)
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    empty = packing.pieces(df.limit(0))
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("window", [2, 7, 64, 1024])
def test_plan_uses_every_piece_once(window):
    rng = np.random.default_rng(window)
    for size in (0, 3, 5000, 200_000):
        lengths = np.minimum(rng.geometric(min(0.9, 3 / window), size), window)
        histogram = np.bincount(lengths, minlength=window + 1)
        plan = packing.plan(histogram)
        if not size:
            assert plan.sequences == 0
            continue
        order = np.argsort(lengths, kind="stable")
        rank = np.arange(size) - np.searchsorted(lengths[order], lengths[order])
        sequence, offset = plan.place(lengths[order], rank)
        used = np.bincount(sequence, weights=lengths[order], minlength=plan.sequences)
        assert len(used) == plan.sequences and used.max() <= window and used.min() > 0
        by = np.lexsort((offset, sequence))
        s, o, n = sequence[by], offset[by], lengths[order][by]
        opens = np.append(True, s[1:] != s[:-1])
        assert (o[opens] == 0).all() and (o[1:] == o[:-1] + n[:-1])[~opens[1:]].all()
        if size == 200_000:
            assert 1 - lengths.sum() / (window * plan.sequences) < 0.001


def test_least_squares_meet_an_exact_histogram():
    parts = packing.combinations(32)
    assert (parts.sum(axis=1) == 32).all()
    x = np.random.default_rng(1).integers(0, 9, len(parts))
    histogram = np.bincount(parts.ravel(), weights=((parts > 0) * x[:, None]).ravel(), minlength=33)
    found = packing.repeat_counts(histogram, parts, 4000)
    back = np.bincount(parts.ravel(), weights=((parts > 0) * found[:, None]).ravel(), minlength=33)
    assert (found >= 0).all() and np.abs(back - histogram).max() < 0.5


def test_encoder_equals_the_tokenizer(tokenizer):
    import random

    import pyarrow as pa

    rng = random.Random(4)
    texts = ["".join(rng.choice(" \n\t\rab1!é.×'½µ\x1c 漢<|") for _ in range(rng.randrange(40)))
             for _ in range(4000)]
    texts += ["it's", "'s 't", " <|endoftext|>", "a  b", "x\n\n y", None, "", "  ", "ǅ Ȁ"]
    ids, first = encoding.Encoder(encoding.path()).batch(pa.array(texts))
    for n, text in enumerate(texts):
        assert ids[first[n] : first[n + 1]].tolist() == tokenizer.encode(
            text or "", add_special_tokens=False).ids
