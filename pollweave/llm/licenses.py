"""License scan by ordered signature rules, in one pass of DataFrame functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from pollweave.llm import license_rules
from pollweave.llm.common import free_name, settled

# A-Z count as their lower case, so both are letters of words here. All other ASCII characters
# are listed one by one: Java looks such a class up in one table.
LETTER = "[^" + "".join(rf"\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]"
WORD = rf"{LETTER}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK = "\x01"
_RULES = "array<struct<id:int,label:string,kind:string,priority:int,score:double,pattern:string,family:int>>"
_FOUND = "array<struct<start:int,ends:int,priority:int,rule:int,label:string,kind:string,score:double>>"
_LEVELS = sorted({priority for priority, _ in license_rules.KINDS.values()})
# Rules of one keyword and kind that are looked for together before each by itself.
FAMILY = 12


def scan(df: DataFrame, keep: list | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default: all) with a struct ``licenses`` (or ``licenses_`` ...).

    Its fields: ``n_words``; ``detections``, all places where a rule matches; ``kept``,
    those left after suppression; both as (start, ends, priority, rule, label, kind,
    score) with word numbers from 0, ``ends`` exclusive. Words are runs of ASCII letters
    and digits and of non-ASCII characters, A-Z lower-cased. A detection goes if a
    detection of a stronger priority contains it, or one of its own priority that is
    longer, or the same interval from an earlier rule. A rule's own matches don't overlap.

    Every row is judged by itself: nothing is shuffled, repeated rows give repeated
    results. Null and empty texts have no words and no detections; an empty table gives
    no rows.
    """
    keep = df.columns if keep is None else keep
    name = free_name(df.select(*keep), "licenses")
    families = _families()
    rules = F.from_json(F.lit(json.dumps(_rules(families))), _RULES)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Lower-casing more than A-Z opens a text to more rules at most; the rules decide.
    gate = F.array_compact(F.array(*[
        F.when(_opened(k), F.lit(k)) for k in license_rules.KEYWORDS]))
    one = df.select(F.struct(*keep).alias("row"), body.alias("text")).select(
        "row",
        "text",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.lower("text").alias("low"),
    ).select("row", "text", "n_words", gate.alias("keywords"))
    lowered = F.translate("text", UPPER, LOWER)
    normal = F.concat(
        F.lit(" "), F.array_join(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), " "),
        F.lit(" "))
    two = one.select(
        "row", "n_words", "keywords",
        F.when(F.size("keywords") > 0, normal).alias("normal"))
    near = two.select(
        "row", "n_words", "normal",
        F.when(
            F.col("normal").isNotNull(),
            F.array_compact(F.array(*[
                F.when(_holds(family), F.lit(n)) for n, family in enumerate(families)])),
        ).otherwise(F.array().cast("array<int>")).alias("families"))
    matching = F.filter(
        F.filter(rules, lambda r: F.array_contains(F.col("families"), r["family"])),
        lambda r: F.rlike("normal", r["pattern"]))
    three = near.select(
        "row", "n_words",
        F.when(F.size("families") > 0, F.flatten(F.transform(matching, _places)))
        .otherwise(F.array().cast(_FOUND)).alias("found"))
    kept = F.aggregate(
        F.array_sort(F.transform(
            "found",
            lambda d: F.struct(
                d["start"], (-d["ends"]).alias("wider"), d["priority"], d["rule"],
                d.alias("all")))),
        F.struct(
            *[F.lit(-1).alias(f"reach{p}") for p in _LEVELS],
            F.array().cast(_FOUND).alias("kept")),
        _swept,
        lambda state: state["kept"],
    )
    result = F.struct("n_words", F.col("found").alias("detections"), kept.alias("kept"))
    return settled(three, "row", result, name)


def _opened(keyword: str):
    """Whether the lower-cased text holds the keyword or one of its other fragments."""
    opened = F.contains("low", F.lit(keyword))
    if keyword in license_rules.WHOLE:
        opened &= F.rlike("low", F.lit(rf"(?<!{LETTER}){keyword}(?!{LETTER})"))
    for fragment in license_rules.ALSO.get(keyword, []):
        opened |= F.contains("low", F.lit(fragment))
    return opened


def _families() -> list[list[dict]]:
    """The rules dealt to families: some of one keyword and kind."""
    alike: dict[tuple, list[dict]] = {}
    for rule in license_rules.rules():
        alike.setdefault((rule["keyword"], rule["kind"]), []).append(rule)
    return [found[i : i + FAMILY] for found in alike.values() for i in range(0, len(found), FAMILY)]


def _rules(families: list[list[dict]]) -> list[dict]:
    """All rules in their order, with the number of their family."""
    return sorted(
        ({**rule, "family": n} for n, family in enumerate(families) for rule in family),
        key=lambda rule: rule["id"])


def _holds(family: list[dict]):
    """Whether one of the rules matches: the text has their keyword and one of the patterns.

    One pattern of the plan, compiled once; a rule's own is compiled again for every text.
    That of a family takes the space in front as part of the match, which finds places faster.
    """
    before = license_rules.BEFORE
    either = "|".join(rule["pattern"].removeprefix(before) for rule in family)
    return F.array_contains("keywords", family[0]["keyword"]) & F.rlike(
        "normal", F.lit(rf" (?:{either})"))


def _places(rule):
    """Where one rule matches: each match is marked, then its word number read off."""
    normal = F.col("normal")
    marked = F.split(F.regexp_replace(normal, rule["pattern"], F.lit(_MARK + "$0")), " ")
    starts = F.filter(
        F.transform(marked, lambda w, n: F.when(w.startswith(_MARK), n - 1)),
        lambda n: n.isNotNull())
    widths = F.transform(
        F.regexp_extract_all(normal, rule["pattern"], F.lit(0)),
        lambda m: F.char_length(m) - F.char_length(F.replace(m, F.lit(" "), F.lit(""))) + 1)
    return F.zip_with(
        starts, widths,
        lambda start, width: F.struct(
            start.alias("start"), (start + width).alias("ends"), rule["priority"].alias("priority"),
            rule["id"].alias("rule"), rule["label"].alias("label"), rule["kind"].alias("kind"),
            rule["score"].alias("score")))


def _swept(state, d):
    """One detection, in order of start, wider first, stronger first, earlier rule first.

    All that contain it and may suppress it came before, so the farthest end that each
    priority has reached decides.
    """
    reached = F.lit(-1)
    for level in _LEVELS:
        reached = F.greatest(
            reached, F.when(d["priority"] >= level, state[f"reach{level}"]).otherwise(-1))
    gone = reached >= d["all"]["ends"]
    return F.struct(
        *[
            F.greatest(
                state[f"reach{level}"],
                F.when(d["priority"] == level, d["all"]["ends"]).otherwise(-1),
            ).alias(f"reach{level}")
            for level in _LEVELS
        ],
        F.when(gone, state["kept"]).otherwise(
            F.concat(state["kept"], F.array(d["all"]))).alias("kept"))
