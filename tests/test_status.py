"""The status job on hand-made polls with hand-worked results."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pollweave.plans import publishing, reconcile as rec, status_queries, war_queries
from pollweave.plans import status as st
from pollweave.plans.translation import owned_columns
from pollweave.sources import documents as docs
from pollweave.sources import state

P1, P2, P3 = 1_724_000_000, 1_724_003_600, 1_724_007_200


def put_primary(landing, poll, **over):
    status = {
        "time": 1000 + 172800 // 2,
        "planetStatus": [
            {"index": 0, "owner": 1, "health": 5, "maxHealth": 1, "players": 10,
             "regenPerSecond": 2.0, "attacking": []},
            {"index": 7, "owner": "2", "health": 400, "maxHealth": 1000, "players": 3,
             "attacking": [1]},
            {"index": 9, "owner": "Terminids", "health": 8},
            {"index": 12, "owner": 9},
        ],
        "planetActiveEffects": [
            {"planetIndex": 7, "galacticEffectId": 30},
            {"planetIndex": 7, "galacticEffectId": 20},
            {"planetIndex": 7, "galacticEffectId": 30},
            {"planetIndex": 0, "galacticEffectId": 11},
        ],
        "campaigns": [
            {"id": 1, "planetIndex": 7, "faction": 2, "type": 0, "campaignId": 5},
            {"id": 2, "planetIndex": 9, "faction": 0, "type": 1, "campaignId": 6},
            {"id": 3, "planetIndex": 12, "type": "4"},
            {"id": 4, "planetIndex": None, "type": 0},
        ],
        "planetEvents": [
            {"id": 50, "planetIndex": 7, "eventType": 1, "race": 3, "health": 250000,
             "maxHealth": 1000000, "startTime": 1000, "expireTime": 1000 + 172800},
        ],
        "spaceStations": [{"planetIndex": 7, "activeEffectIds": [1],
                           "currentElectionEndWarTime": 1724000000}],
    }
    info = {"planetInfos": [
        {"index": 0, "name": "Alpha", "sector": 5},
        {"index": 7, "name": "", "sector": "Far"},
        {"index": 20, "name": "Lone", "sector": 99},
    ]}
    body = {
        "status": status,
        "info": info,
        "assignment": [{"id32": 77, "setting": {"overrideBrief": "do it"}, "progress": [1],
                        "expiration": 1724000000}],
        "stats": {"statistics": {"playerCount": 5}, "started": "s", "ended": "e"},
        "news": [{"id": i, "published": 1724000000 + i, "type": 0, "message": f"m{i}"}
                 for i in range(40)],
    }
    body["status"] = {**status, **over.pop("status", {})}
    body.update(over)
    for name, doc in body.items():
        if doc is not None:
            landing.put(name, poll, doc)


def put_aggregate(landing, poll, **over):
    war = {
        "time": 1000,
        "planetStatus": [
            {"index": 0, "owner": 1, "health": 6, "players": 0, "regenPerSecond": 1.5},
            {"index": 7, "owner": 2, "health": 300, "players": 44, "regenPerSecond": 0},
        ],
        "planetActiveEffects": [{"index": 7, "galacticEffectId": 99}],
        "campaigns": [{"id": 1, "planetIndex": 7, "race": 2, "type": 0, "count": 3}],
        "planetEvents": [],
        "statistics": {"playerCount": 1},
    }
    body = {
        "warStatus": {**war, **over.pop("war", {})},
        "majorOrders": [{"id32": 88, "setting": {"overrideTitle": "T", "tasks": [{"a": 1}]}}],
        "news": [{"id": 5, "published": 3, "message": "agg"}],
        "spaceStations": [],
    }
    body.update(over)
    landing.put("live", poll, body)


def put_rest(landing, poll, **over):
    body = {
        "war": {"statistics": {"playerCount": 1234}, "started": "a", "ended": "b"},
        "planets": [
            {"index": 0, "name": "Other", "sector": "Core", "maxHealth": 2_000_000,
             "statistics": {}},
            {"index": 7, "name": "Seven", "sector": "Rim", "maxHealth": 500},
            {"index": 9, "name": "Nine", "sector": "Rim", "maxHealth": 0,
             "statistics": {"missionsWon": 30, "missionsLost": 10, "missionTime": 7200,
                            "terminidKills": 100, "automatonKills": 0, "deaths": 0,
                            "helldiversDeaths": 8, "otherDeaths": 99, "accuracy": 87.5}},
        ],
        "campaigns": [],
        "assignments": [{"id": 66, "title": "R", "expiration": "2024-09-01T00:00:00Z"}],
        "dispatches": [{"id": 1, "published": "2024-08-01T00:00:00Z", "type": 0, "message": "r"}],
    }
    body.update(over)
    for name, doc in body.items():
        landing.put(name, poll, doc)


def sources(spark, landing):
    folder = landing.folder
    return (
        st.read_primary(spark, folder), st.read_aggregate(spark, folder), st.read_rest(spark, folder)
    )


def by(df, *keys):
    return {
        tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict(True)
        for r in df.collect()
    }


def test_primary_alone(spark, landing):
    put_primary(landing, P1)
    status = rec.reconcile(*sources(spark, landing))
    entities = by(status.entities, "entity_id")
    assert sorted(entities) == [0, 7, 9, 12, 20]
    assert entities[0]["name"] == "Alpha" and entities[0]["sector"] == "Canopus"
    assert entities[0]["owner"] == "Humans" and entities[0]["effects"] == [11]
    # Maximum 1 is relative, nothing is cached: the health stands in; regen is the own one.
    assert entities[0]["max_health"] == 5 and entities[0]["resistance"] == 144000.0
    assert entities[7]["name"] == "PLANET_7" and entities[7]["sector"] == "Far"
    assert entities[7]["effects"] == [30, 20] and entities[7]["max_health"] == 1000
    assert entities[7]["attacking"] is True and entities[0]["attacking"] is False
    assert entities[9]["owner"] == "Terminids" and entities[12]["owner"] == "Unknown"
    assert entities[20]["owner"] == "Unknown" and entities[20]["sector"] == ""
    assert entities[20]["health"] == 0 and entities[20]["max_health"] == 0

    contests = by(status.contests, "entity_id")
    assert sorted(contests) == [7, 9, 12]  # one per entity, none without an entity
    event = contests[7]
    assert event["contest_id"] == 50 and event["faction"] == "Automaton"
    assert event["contest_class"] == "defense" and event["level"] == 20
    assert event["defenders_progress"] == 75.0
    assert event["attackers_rate"] == 2.083 and event["attackers_progress"] == 49.99
    assert event["remaining_time"] == 86400 and event["defenders_rate"] is None
    # Faction 0 is falsy: the entity's owner; type 1 without an event is a survey.
    assert contests[9]["faction"] == "Terminids" and contests[9]["contest_class"] == "recon"
    assert contests[12]["contest_class"] == "defense" and contests[12]["faction"] == "Unknown"

    recon = by(status.recon, "entity_id")
    assert list(recon) == [9] and recon[9]["success_per_hour"] is None
    assert status.war.first()["players"] == 0
    assignment = status.assignments.first()
    assert assignment["id"] == 77 and assignment["title"] == "MAJOR ORDER"
    assert assignment["briefing"] == "do it" and assignment["source"] == "primary"
    assert assignment["expiration"] == "2024-08-18T16:53:20Z" and assignment["deadline"] == ""
    bulletins = status.bulletins.collect()
    assert sorted(r["id"] for r in bulletins) == list(range(10, 40))
    station = status.stations.first()
    assert station["effects"] == [1] and station["election_end"] == "2024-08-18T16:53:20Z"


def test_all_sources(spark, landing):
    put_primary(landing, P1)
    put_aggregate(landing, P1)
    put_rest(landing, P1)
    status = rec.reconcile(*sources(spark, landing))
    assert status.polls.first()["source"] == "primary"
    entities = by(status.entities, "entity_id")
    assert entities[0]["players"] == 10  # the overlay's 0 does not count
    assert entities[7]["players"] == 44 and entities[7]["effects"] == [99]
    assert entities[0]["effects"] == [11]
    assert entities[0]["name"] == "Alpha" and entities[0]["sector"] == "Core"
    assert entities[7]["name"] == "Seven" and entities[7]["sector"] == "Rim"
    assert entities[0]["max_health"] == 2_000_000 and entities[7]["max_health"] == 1000
    assert entities[0]["resistance"] == 0.27  # 1.5 * 3600 / 2e6 * 100
    assert entities[7]["resistance"] == 0.0
    assert entities[9]["max_health"] == 8  # both maxima are relative: health
    contests = by(status.contests, "entity_id")
    assert contests[9]["name"] == "Nine" and contests[9]["sector"] == "Rim"
    recon = by(status.recon, "entity_id")[9]
    assert recon["success_per_hour"] == 15.0 and recon["fail_per_hour"] == 5.0
    assert recon["enemies_per_hour"] == 50.0 and recon["deaths_per_hour"] == 4.0
    assert recon["success_rate"] == 75.0 and recon["fail_rate"] == 25.0
    assert status.war.first()["players"] == 44
    assignment = status.assignments.first()
    assert assignment["id"] == 88 and assignment["title"] == "T"
    assert json.loads(assignment["tasks"]) == [{"a": 1}]
    assert assignment["deadline"] == "2024-09-01T00:00:00Z"
    assert assignment["server_time"] == "2024-08-18T16:53:20Z"
    assert [r["message"] for r in status.bulletins.collect()] == ["r"]


SUBSETS = {
    "A": ("aggregate", 88, 44, 1),
    "R": ("rest", 66, 1234, 1),
    "AR": ("aggregate", 88, 44, 1),
    "PA": ("primary", 88, 44, 1),
    "PR": ("primary", 77, 1234, 1),
}


def test_subsets_of_sources(spark, landing):
    writers = {"P": put_primary, "A": put_aggregate, "R": put_rest}
    polls = {letters: P1 + 300 * i for i, letters in enumerate(SUBSETS)}
    for letters, poll in polls.items():
        for letter in letters:
            writers[letter](landing, poll)
    status = rec.reconcile(*sources(spark, landing))
    chosen, war = by(status.polls, "poll_ts"), by(status.war, "poll_ts")
    assignments = by(status.assignments, "poll_ts")
    bulletins = status.bulletins.collect()
    for letters, (base, assignment, players, messages) in SUBSETS.items():
        poll = polls[letters]
        assert chosen[poll]["source"] == base
        assert assignments[poll]["id"] == assignment
        assert war[poll]["players"] == players
        found = [r for r in bulletins if r["poll_ts"] == poll]
        assert len(found) == messages
        if "R" not in letters:
            assert found[0]["published"] == ""  # the aggregate's times are unusable
    entities = by(status.entities, "poll_ts", "entity_id")
    only = entities[(polls["A"], 7)]
    assert only["name"] == "PLANET_7" and only["max_health"] == 300
    both = entities[(polls["AR"], 7)]
    assert both["name"] == "Seven" and both["sector"] == "Rim"
    # 500 is a relative maximum, too, and nothing better was ever seen.
    assert both["max_health"] == 300


def test_no_source_at_all(spark, landing):
    with pytest.raises(RuntimeError):
        rec.reconcile(*sources(spark, landing))


def test_a_source_counts_only_when_complete(spark, landing):
    put_primary(landing, P1, news='{"broken": ')
    put_aggregate(landing, P1)
    status = rec.reconcile(*sources(spark, landing))
    assert status.polls.first()["source"] == "aggregate"
    report = by(
        docs.defects(spark, {"news": (f"{landing.folder}/news", docs.NEWS),
                             "live": (f"{landing.folder}/live", docs.LIVE),
                             "gone": (f"{landing.folder}/gone", docs.LIVE)}),
        "source",
    )
    assert report["news"]["defective"] == 1 and report["news"]["ok"] is False
    assert report["live"]["ok"] is True and report["gone"]["rows"] == 0


def three_polls(landing):
    put_primary(landing, P1)
    put_aggregate(landing, P1)
    put_rest(landing, P1)
    moved = {"planetEvents": [
        {"id": 50, "planetIndex": 7, "eventType": 1, "race": 3, "health": 150000,
         "maxHealth": 1000000, "startTime": 1000, "expireTime": 173800}]}
    put_primary(landing, P2, assignment=[], status={**moved, "planetActiveEffects": [],
                                                    "spaceStations": []})
    put_primary(landing, P3, assignment=[], status={**moved, "planetActiveEffects": []})


def check_three_polls(entities, contests, assignments, stations):
    # The maximum of the first poll is remembered, as are its effects.
    assert entities[(P2, 0)]["max_health"] == 2_000_000
    assert entities[(P2, 7)]["effects"] == [99] and entities[(P3, 7)]["effects"] == [99]
    assert contests[(P1, 7)]["defenders_rate"] is None
    assert contests[(P2, 7)]["defenders_rate"] == 10.0  # 75 -> 85 in one hour
    assert contests[(P3, 7)]["defenders_rate"] is None  # no change
    assert assignments[P2]["id"] == 88 and assignments[P3]["id"] == 88
    assert stations[P2]["effects"] == [1] and stations[P3]["source"] == "primary"


def test_poll_by_poll_equals_all_at_once(spark, landing, tmp_path):
    three_polls(landing)
    folder = str(tmp_path / "state")
    seen = [{}, {}, {}, {}]
    everything = sources(spark, landing)
    for poll in (P1, P2, P3, P3):  # the last poll is repeated, as after a failure
        carried = rec.load_carried(spark, folder, poll)
        status = rec.reconcile(*[source.at(poll) for source in everything], carried)
        rec.save_carried(rec.carry_over(status, carried), folder, poll)
        for found, table, keys in zip(
            seen,
            (status.entities, status.contests, status.assignments, status.stations),
            (["poll_ts", "entity_id"], ["poll_ts", "entity_id"], ["poll_ts"], ["poll_ts"]),
        ):
            found.update(by(table, *keys))
    whole = rec.reconcile(*everything)
    check_three_polls(
        by(whole.entities, "poll_ts", "entity_id"), by(whole.contests, "poll_ts", "entity_id"),
        by(whole.assignments, "poll_ts"), by(whole.stations, "poll_ts"),
    )
    assert seen[0] == by(whole.entities, "poll_ts", "entity_id")
    assert seen[1] == by(whole.contests, "poll_ts", "entity_id")
    assert seen[2] == by(whole.assignments, "poll_ts")


def series_document(*stamps):
    return {"data": [{"timestampUtc": s, "totalPlayerCount": 10 + i, "playerCountHumans": i,
                      "playerCountTerminids": 2, "impactMultiplier": 0.5}
                     for i, s in enumerate(stamps)]}


def test_series_and_history(spark, landing, tmp_path):
    landing.put("series", P1, series_document("t1", "t2"))
    landing.put("series", P2, series_document("t2"))
    landing.put("series", P3, series_document())
    series = st.read_series(spark, landing.folder)
    latest = by(series, "poll_ts")
    assert sorted(latest) == [P1, P2] and latest[P1]["total_players"] == 11
    assert latest[P1]["factions"] == {"Humans": 1, "Terminids": 2, "Automatons": 0, "Illuminate": 0}
    first = st.series_history(series)
    assert [r["timestamp"] for r in first.collect()] == ["t2"]
    folder = str(tmp_path / "history")
    records = first.select("timestamp", "total_players")
    order = [F.desc("timestamp")]
    state.append_history(spark, folder, records, ["timestamp"], order, 1, k=3)
    more = spark.createDataFrame([(f"t{i}", i) for i in (2, 3, 4, 5)], records.schema)
    for _ in range(2):  # a repeated run changes nothing
        kept = state.append_history(spark, folder, more, ["timestamp"], order, 2, k=3)
        assert sorted(r["timestamp"] for r in kept.collect()) == ["t3", "t4", "t5"]


def test_documents(spark, landing, tmp_path):
    three_polls(landing)
    landing.put("series", P1, series_document("t1"))
    landing.put("translated", P1, {"mo_brief": {"title": "M", "translated": "X"},
                                   "items": [{"id": 1, "translated": "n"}, None, "x", 3]})
    landing.put("translated", P2, "not json")
    status = rec.reconcile(*sources(spark, landing))
    translations = docs.read_documents(
        spark, f"{landing.folder}/translated", docs.TRANSLATIONS
    )
    owned = owned_columns(status.polls, translations)
    folder = str(tmp_path / "out")
    series = st.read_series(spark, landing.folder)
    publishing.publish(status, folder, series, owned)
    publishing.publish_documents(status, folder, series, owned)
    written = {
        r["poll_ts"]: json.loads(r["value"])
        for r in spark.read.text(f"{folder}/documents").collect()
    }
    assert sorted(written) == [P1, P2, P3]
    first = written[P1]
    assert first["fetchedAt"] == "2024-08-19T00:53:20+08:00" and first["source"] == "primary"
    assert [p["index"] for p in first["planets"]] == [0, 7, 9, 12, 20]
    assert [c["planet"]["index"] for c in first["campaigns"]] == [9, 12, 7]
    assert first["assignments"]["id"] == 88 and first["dss"]["planetIndex"] == 7
    assert first["recon_stats"]["9"]["successRate"] == 75.0
    assert first["impactMultiplier"] == 0.5
    assert first["war"]["statistics"] == {"playerCount": 44, "missionsWon": 0, "missionsLost": 0}
    assert first["assignments"]["tasks"] == [{"a": 1}]
    assert first["player_distribution"] == {"total": 10, "humans": 0, "terminids": 2,
                                            "automatons": 0, "illuminate": 0, "updatedAt": "t1"}
    assert first["major_order"] == {"title": "M", "brief": "", "translated_brief": "X",
                                    "translated_at": ""}
    assert [n["id"] for n in first["news"]] == [1]
    # The second poll's document is defective: what was there before stays.
    assert written[P2]["news"] == first["news"] and written[P2]["major_order"]["title"] == "M"

    # The rows are complete too, and writing them again replaces them.
    publishing.publish(status, folder, series, owned)
    assert spark.read.json(f"{folder}/entities").count() == 15
    polls = by(spark.read.json(f"{folder}/polls"), "poll_ts")
    assert polls[P1]["fetched_at"] == first["fetchedAt"] and polls[P1]["source"] == "primary"
    assert by(spark.read.json(f"{folder}/series"), "poll_ts")[P1]["impact_multiplier"] == 0.5
    assert by(spark.read.json(f"{folder}/owned"), "poll_ts")[P1]["major_order"]["title"] == "M"
    for name in ("contests", "bulletins", "assignments", "stations", "war", "recon"):
        assert spark.read.json(f"{folder}/{name}").count() > 0, name


ROOTS = {  # document -> (root, whether the primary source still counts)
    "status": [("null", False), ("[]", False), ("3", False), ("{", False), ("{}", True)],
    "info": [("null", False), ("[]", False), ("{}", True)],
    "assignment": [("null", True), ("[]", True), ('{"id": 5}', True), ('"x"', False)],
    "stats": [("null", True), ("{}", True), ("[1]", False)],
    "news": [("null", True), ("[]", True), ("7", False)],
}


def test_roots_decide_whether_a_source_counts(spark, landing):
    expected = {}
    poll = P1
    for name, roots in ROOTS.items():
        for root, counts in roots:
            poll += 300
            put_primary(landing, poll)
            landing.put(name, poll, root)
            expected[poll] = counts
    found = {r["poll_ts"] for r in st.read_primary(spark, landing.folder).polls.collect()}
    assert found == {p for p, counts in expected.items() if counts}


def test_live_document_must_be_an_object(spark, landing):
    put_aggregate(landing, P1)
    landing.put("live", P2, "[]")
    landing.put("live", P3, "null")
    found = st.read_aggregate(spark, landing.folder).polls
    assert [r["poll_ts"] for r in found.collect()] == [P1]


def test_fractions_in_statistics_lose_nothing(spark, landing):
    put_primary(landing, P1)
    put_rest(landing, P1)
    status = rec.reconcile(*sources(spark, landing))
    row = by(status.recon, "entity_id")[9]
    assert row["success_per_hour"] == 15.0 and row["deaths_per_hour"] == 4.0


def test_primary_bulletins_keep_their_order(spark, landing):
    put_primary(landing, P1, news=[{"id": i, "message": str(i)} for i in (3, 9, 5)])
    status = rec.reconcile(*sources(spark, landing))
    document = json.loads(publishing.poll_documents(status).first()["document"])
    assert [d["id"] for d in document["dispatches"]] == [3, 9, 5]


def test_unknown_fields_of_rest_rows_are_passed_on(spark, landing, tmp_path):
    put_rest(landing, P1, **{
        "war": {"statistics": {"playerCount": 4, "shots": 10**12}, "now": "n"},
        "planets": [
            {"index": 1, "name": "A", "biome": {"slug": "é\"x"}, "hash": 4129041127,
             "statistics": {"missionsWon": 2, "revives": 0.5}, "hazards": [], "event": None},
            {"index": 2, "name": "B"}],
        "campaigns": [{"id": 9, "priority": 1.5,
                       "planet": {"index": 1, "name": "A", "position": {"x": 0.25}}}],
        "dispatches": [{"id": 3, "message": "m", "tags": [1, "two"]}],
    })
    status = rec.reconcile(*sources(spark, landing))
    document = json.loads(publishing.poll_documents(status).first()["document"])
    one, two = document["planets"]
    assert one["biome"] == {"slug": "é\"x"} and one["hash"] == 4129041127 and one["hazards"] == []
    assert one["statistics"] == {"missionsWon": 2, "revives": 0.5} and one["event"] is None
    assert one["name"] == "A" and "event" in one and "biome" not in two
    contest = document["campaigns"][0]
    assert contest["priority"] == 1.5 and contest["planet"]["position"] == {"x": 0.25}
    assert contest["planet"]["name"] == "A"
    assert document["dispatches"][0]["tags"] == [1, "two"]
    assert document["war"]["now"] == "n" and document["war"]["statistics"]["shots"] == 10**12
    assert document["war"]["statistics"]["playerCount"] == 4
    folder = str(tmp_path / "rows")
    publishing.publish(status, folder)
    rows = by(spark.read.json(f"{folder}/entities"), "entity_id")
    assert rows[1]["extra"]["hash"] == 4129041127 and rows[2]["extra"] is None
    # Another source's rows have no such fields.
    put_primary(landing, P1)
    status = rec.reconcile(*sources(spark, landing))
    document = json.loads(publishing.poll_documents(status).first()["document"])
    assert all("biome" not in p for p in document["planets"])
    assert document["dispatches"][0]["tags"] == [1, "two"]


@pytest.mark.parametrize("part", [1, 2, 7, 4096])
def test_documents_in_parts_are_the_same(spark, landing, tmp_path, part):
    three_polls(landing)
    status = rec.reconcile(*sources(spark, landing))
    whole = {r["poll_ts"]: r["document"] for r in publishing.poll_documents(status).collect()}
    assert [len(json.loads(whole[p])["planets"]) for p in (P1, P2, P3)] == [5, 5, 5]
    folder = str(tmp_path / "out")
    for _ in range(2):  # written again, they are replaced
        publishing.publish_documents(status, folder, part=part)
    texts = {r["poll_ts"]: r["document"] for r in publishing.read_documents(spark, folder).collect()}
    assert {p: t.replace("\n", "") for p, t in texts.items()} == whole
    assert {p: json.loads(t) for p, t in texts.items()} == {
        p: json.loads(t) for p, t in whole.items()}


def test_a_large_poll_is_written_by_many_tasks(spark, tmp_path):
    empty = lambda ddl: lambda: spark.createDataFrame([], ddl)
    entities = spark.range(60_000).selectExpr(
        f"{P1}L as poll_ts", "id as entity_id", "'rest' as source", "'n' || id as name",
        "'' as sector", "'Humans' as owner", "id as health", "id as max_health", "id as players",
        "false as attacking", "0.5D as resistance", "array(id) as effects",
        "cast(null as string) as extra")
    single = "poll_ts bigint, source string"
    status = st.Status(
        spark.createDataFrame([(P1, "rest")], single),
        entities=lambda: entities,
        contests=empty(f"{single}, seq bigint, contest_id bigint, faction string, type string, "
                       "event_kind bigint, contest_class string, attackers_progress double, "
                       "defenders_progress double, attackers_rate double, defenders_rate double, "
                       "start_time bigint, remaining_time bigint, level int, count bigint, "
                       "entity_id bigint, name string, sector string, owner string, "
                       "extra string, place_extra string"),
        bulletins=empty("poll_ts bigint, seq bigint, id bigint, published string, type string, "
                        "message string, extra string"),
        assignments=empty(f"{single}, id bigint, briefing string, title string, tasks string, "
                          "progress array<bigint>, expiration string, deadline string, "
                          "server_time string"),
        stations=empty(f"{single}, entity_id bigint, effects array<bigint>, election_end string"),
        war=empty(f"{single}, time bigint, players bigint, missions_won bigint, "
                  "missions_lost bigint, started string, ended string, extra string, "
                  "statistics_extra string"),
        recon=empty("poll_ts bigint, entity_id bigint, success_per_hour double, "
                    "fail_per_hour double, enemies_per_hour double, deaths_per_hour double, "
                    "success_rate double, fail_rate double"),
    )
    parts = publishing.document_parts(status).collect()
    assert sorted(r["part"] for r in parts) == list(range(15))  # 60 000 rows and 16 others
    folder = str(tmp_path / "out")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")  # as if the poll were larger
        publishing.publish_documents(status, folder)
    finally:
        spark.conf.set(name, before)
    files = spark.read.text(f"{folder}/documents").select("_metadata.file_name").distinct().count()
    assert files > 1
    text = publishing.read_documents(spark, folder).first()["document"]
    document = json.loads(text)
    assert [p["index"] for p in document["planets"]] == list(range(60_000))
    assert document["campaigns"] is None and document["war"] is None


def test_documents_in_a_table_read_as_those_in_folders(spark, landing, tmp_path):
    landing.put("news", P1, [{"id": 1}])
    landing.put("news", P2, '{"broken": ')
    landing.put("news", P3, "null")
    table = str(tmp_path / "table")
    folder = f"{landing.folder}/news"
    whole = spark.read.schema("value string, poll_ts bigint").text(folder, wholetext=True)
    docs.archive(whole.where(f"poll_ts < {P3}"), table)
    docs.archive(whole.where(f"poll_ts >= {P3}"), table)
    found = [docs.read_with_defects(spark, path, docs.NEWS, nullable=True).select(
        "poll_ts", "value", F.to_json("doc")) for path in (folder, table)]
    assert sorted(found[0].collect()) == sorted(found[1].collect())
    assert found[1].count() == 3


def test_a_table_and_folders_are_read_together(spark, landing):
    landing.put("news", P1, [{"id": 1}])
    rows = spark.createDataFrame([('[{"id": 2}]', P2), ("nothing", P3)], "value string, poll_ts bigint")
    docs.archive(rows, f"{landing.folder}/news")
    found = docs.read_documents(spark, f"{landing.folder}/news", docs.NEWS)
    assert sorted(found.select("poll_ts", "doc.id").collect()) == [(P1, [1]), (P2, [2])]
    assert [r.poll_ts for r in docs.read_documents(
        spark, f"{landing.folder}/news", docs.NEWS, since=P2).collect()] == [P2]


@pytest.mark.parametrize("plan, name, key, size", [
    (war_queries, "part", "p_partkey", war_queries.ENTITIES),
    (status_queries, "customer", "c_custkey", status_queries.CUSTOMERS)])
def test_files_of_a_landing_do_not_grow_with_its_polls(spark, tmp_path, plan, name, key, size):
    polls = 60
    rows = spark.range(0, polls * size, 10).withColumnRenamed("id", key)
    if name == "customer":
        rows = rows.selectExpr(
            key, "'c' c_name", "1 c_nationkey", "1.5D c_acctbal", "'m' c_mktsegment")
    rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = plan._land(spark, str(tmp_path))
    for kind in os.listdir(folder):
        files = [f for _, _, found in os.walk(f"{folder}/{kind}") for f in found
                 if f.startswith("part-")]
        assert 0 < len(files) < polls / 3, kind


def test_lists_of_documents_are_worked_out_once(spark, landing):
    put_rest(landing, P1)
    status = rec.reconcile(*sources(spark, landing))
    # What is numbered is written rows: no table is left to be worked out again.
    plan = publishing.fragments(status)._jdf.queryExecution().optimizedPlan().toString()
    assert "maxHealth" not in plan and "campaignType" not in plan
