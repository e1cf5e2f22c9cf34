"""Plain versions of the operators, row by row, for small tables."""

from __future__ import annotations

import hashlib
import re

import pandas as pd

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}
SMALL = "/root/testdata/sf0.001"


def read(name, folder=SMALL):
    return pd.read_parquet(f"{folder}/{name}.parquet")


def spaced(text):
    return SPACED.findall(text or "")


def plain(text):
    return PLAIN.findall((text or "").translate(FOLD))


def sha256(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def contamination(docs, items, window=10):
    """Rows of (doc_id, n_words, n_hit, n_items, digest, contaminated)."""
    windows = {}
    for item, text in items:
        found = plain(text)
        n = min(window, len(found))
        for i in range(len(found) - n + 1 if n else 0):
            windows.setdefault(tuple(found[i : i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        found, hit, names = plain(text), set(), set()
        for n in lengths:
            for i in range(len(found) - n + 1):
                owners = windows.get(tuple(found[i : i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    names |= owners
        out.append((doc, len(found), len(hit), len(names), sha256(",".join(sorted(names))),
                    bool(hit)))
    return out


def key(row):
    return tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)
