import random
import re

import brute
import pytest
from pollweave.llm import license_rules, licenses, queries

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def base(docs):
    out = []
    for doc, text in docs:
        words, places, labels = brute.plain(text), [], set()
        for label, phrase in PHRASES.items():
            phrase = phrase.split()
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    places.append(i)
                    labels.add(label)
        out.append((doc, len(words), len(places), min(places, default=None),
                    max(places, default=None), ",".join(sorted(labels))))
    return sorted(out, key=brute.key)


def test_query_equals_brute_force(llm):
    docs = brute.read("documents")[["doc_id", "text"]].itertuples(index=False)
    df = queries.op2_signatures(llm, brute.SMALL)
    found = brute.rows(
        df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    expected = base(docs)
    assert found == expected and any(r[2] for r in expected)
    assert df.where("n_base > 0 and (labels = '' or score = 0)").count() == 0
    assert df.where("score < 0 or score > 1").count() == 0


TEXTS = [
    (1, "Licensed under the Apache License, Version 2.0.", 0),
    (1, "Licensed under the Apache License, Version 2.0.", 0),
    (2, None, 0), (3, "", 0), (None, "MIT\n\nLICENSE mit license", 0),
    (4, "GNU General   Public License" + " x" * 30_000 + " general public license", 0),
    (5, "mit license " * 1500, 0), (6, "permit license mitlicense émit license", 0),
    (7, "SPDX-License-Identifier: CC-BY-NC-4.0", 0),
    (8, "Released into the public domain. Not a MIT licence.", 0),
    (9, "https://www.gnu.org/licenses/gpl-3.0.html", 0),
]


def suppressed(detections):
    """All pairs: what is left after containment suppression."""
    def beats(e, d):
        if e is d or e.start > d.start or e.ends < d.ends:
            return False
        if e.priority != d.priority:
            return e.priority < d.priority
        return (e.ends - e.start, -e.rule) > (d.ends - d.start, -d.rule)
    return [d for d in detections if not any(beats(e, d) for e in detections)]


def test_edges(llm):
    df = llm.createDataFrame(TEXTS, "doc_id long, text string, licenses int")
    rows = licenses.scan(df).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "licenses", "licenses_"}
    assert len(rows) == len(TEXTS)
    for row in rows:
        found = row.licenses_
        if row.doc_id != 5:
            assert sorted(found.kept) == sorted(suppressed(found.detections))
        words = brute.plain(row.text)
        rules = {r["id"]: re.compile(r["pattern"]) for r in license_rules.rules()}
        for d in found.detections:
            body = " ".join(words[d.start : d.ends])
            match = rules[d.rule].match(f" {body} ", 1)
            assert match and match.end() == len(body) + 1 or d.kind == "title"
    by = {r.doc_id: r.licenses_ for r in rows}
    base_rows = [(r.doc_id, r.licenses_.n_words,
                  sum(d.kind == "base" for d in r.licenses_.detections)) for r in rows]
    assert sorted(base_rows, key=brute.key) == [b[:3] for b in base([t[:2] for t in TEXTS])]
    labels = {k: {d.label for d in v.kept} for k, v in by.items()}
    assert labels[1] == {"apache-2.0"} and labels[7] == {"cc-by-nc-4.0"}
    assert labels[8] == {"public-domain"} and labels[9] == {"gpl-3.0"} and not labels[6]
    assert llm.createDataFrame([], df.schema).transform(licenses.scan).count() == 0


@pytest.mark.parametrize("rule", license_rules.rules(), ids=lambda r: str(r["id"]))
def test_rules_are_sound(rule):
    re.compile(rule["pattern"])
    assert rule["keyword"] in ["", *license_rules.KEYWORDS] and 0 < rule["score"] <= 1


def test_there_are_hundreds_of_rules():
    assert len(license_rules.rules()) > 200


def sample(pattern, pick):
    """A text that the pattern matches; ``pick`` chooses among alternatives."""
    out = []
    for kind, value in pattern:
        kind = str(kind)
        if kind == "LITERAL":
            out.append(chr(value))
        elif kind == "IN":
            first = value[0]
            out.append("x" if str(first[0]) == "CATEGORY" else chr(pick.choice(value)[1]))
        elif kind == "BRANCH":
            out.append(sample(pick.choice(value[1]), pick))
        elif kind == "SUBPATTERN":
            out.append(sample(value[3], pick))
        elif kind == "MAX_REPEAT":
            low, high, body = value
            n = low + (pick.random() < 0.3 and high > low)
            out += [sample(body, pick) for _ in range(n)]
        elif kind == "ASSERT":
            out.append(sample(value[1], pick) if value[0] > 0 else "")
        else:
            raise ValueError(kind)
    return "".join(out)


def test_every_rule_opens_its_texts(llm):
    rows = []
    for rule in license_rules.rules():
        pick = random.Random(rule["id"])
        texts = {sample(re._parser.parse(rule["pattern"]), pick).strip() for _ in range(12)}
        assert all(re.search(rule["pattern"], f" {t} ") for t in texts)
        rows += [(rule["id"], t) for t in texts]
        rows += [(rule["id"], f"({t.upper()})".replace(" ", "-")) for t in texts]
    df = llm.createDataFrame(rows, "rule int, text string").repartition(8)
    found = licenses.scan(df).select("rule", "text", "licenses.detections.rule").toDF(
        "rule", "text", "found")
    assert [(r.rule, r.text) for r in found.collect() if r.rule not in r.found] == []


def test_texts_without_a_license_word(llm):
    texts = {
        "Released under the GPL version 3": "gpl-3.0", "Distributed under CC BY 4.0": "cc-by-4.0",
        "available under MPL 2.0": "mpl-2.0", "https://scripts.sil.org/OFL": "ofl-1.1",
        "wtfpl.net": "wtfpl", "mariadb.com/bsl11": "busl-1.1",
        "published under Creative Commons BY-SA 4.0": "cc-by-sa-4.0",
        "Berkeley Software Distribution": "bsd", "an accurate account by 4.0": None,
    }
    df = llm.createDataFrame(list(texts.items()), "text string, label string")
    for row in licenses.scan(df).collect():
        assert {d.label for d in row.licenses.kept} == ({row.label} if row.label else set())


def test_families_hold_what_their_rules_match(llm):
    """A text runs a rule by itself only where a rule of its family matches."""
    families = licenses._families()
    dealt = [rule["id"] for family in families for rule in family]
    assert sorted(dealt) == list(range(len(license_rules.rules()))) and len(families) < 80
    assert all(len({(r["keyword"], r["kind"]) for r in family}) == 1 for family in families)
    rows = ["a licensed driver of public warranty gnu bsd apache copyright rail spdx"]
    for rule in license_rules.rules()[::7]:
        pick = random.Random(rule["id"])
        rows.append(sample(re._parser.parse(rule["pattern"]), pick).strip())
        rows.append(f"mit{rows[-1]}s license")
    df = llm.createDataFrame([(f" {t} ", license_rules.KEYWORDS) for t in rows],
                             "normal string, keywords array<string>").coalesce(1)
    found = df.select("normal", *[licenses._holds(f).alias(str(n)) for n, f in enumerate(families)])
    for row in found.collect():
        expected = [any(re.search(r["pattern"], row.normal) for r in f) for f in families]
        assert list(row)[1:] == expected
    assert not any(list(found.first())[1:])
