"""Edits of sections against a plain loop over the log, and extension tracks."""

import random

from stridelake.operators import editing

SECTIONS = "section_id long, section_type string, sport_type string, name string, accepted boolean, disabled boolean, superseded_by long, track_id long, base string, first int, last int"
KINDS = ["create", "accept", "rename", "reference", "reset_reference", "trim", "trim", "trim", "expand", "reset_bounds", "disable", "enable", "supersede", "delete", "odd"]


def plain(sections, events):
    now, dead = {}, set()
    for s in sections:
        now[s[0]] = dict(zip([c.split()[0] for c in SECTIONS.split(", ")], s), original=None, refused=0)
    sports, known, early = {s[0]: s[2] for s in sections}, set(now), {}
    for at, i, kind, name, track, first, last, other in sorted(events, key=lambda e: (e[0], e[2])):
        s = now.get(i)
        if kind == "create" and i not in known and last > first:
            now[i] = {"section_id": i, "section_type": "custom", "sport_type": sports.get(other), "name": name, "accepted": True, "disabled": False, "superseded_by": None, "track_id": track, "base": "track", "first": first, "last": last, "original": None, "refused": early.get(i, 0)}
            known.add(i)
            continue
        if s is None:
            early[i] = early.get(i, 0) + 1
            continue
        place = s["base"], s["first"], s["last"], s["track_id"]
        if i in dead:
            pass
        elif kind == "rename":
            s.update(name=name, accepted=True)
        elif kind == "accept":
            s["accepted"] = True
        elif kind in ("disable", "enable"):
            s["disabled"] = kind == "disable"
        elif kind == "supersede":
            s["superseded_by"] = other
        elif kind == "reset_reference":
            s["accepted"] = False
        elif kind == "delete":
            dead.add(i)
        elif kind == "reference" and last - first >= 1:
            s.update(accepted=True, track_id=track, base="track", first=first, last=last)
        elif kind == "trim" and 0 <= first < last <= s["last"] - s["first"] and last - first >= 4:
            s.update(accepted=True, original=s["original"] or place, last=s["first"] + last, first=s["first"] + first)
        elif kind == "expand" and last - first >= 4:
            s.update(accepted=True, original=s["original"] or place, track_id=track, base="track", first=first, last=last)
        elif kind == "reset_bounds" and s["original"]:
            s["base"], s["first"], s["last"], s["track_id"] = s["original"]
            s.update(original=None, accepted=s["section_type"] == "custom")
        else:
            s["refused"] += 1
    out = []
    for i, s in now.items():
        if i not in dead:
            by = None if s["superseded_by"] in dead else s["superseded_by"]
            out.append((i, s["section_type"], s["sport_type"], s["name"], s["accepted"], s["disabled"], by, s["track_id"], s["base"], s["first"], s["last"], s["original"] is not None, s["refused"]))
    return sorted(map(str, out))


def test_folded_log(spark):
    rng = random.Random(1)
    sections = [(i, rng.choice(["auto", "custom"]), rng.choice(["Ride", "Run"]), rng.choice([None, "a"]), False, False, rng.choice([None, i + 1]), None, "own", 0, rng.randint(3, 30)) for i in range(40)]
    events = []
    for at in range(900):
        first = rng.randint(-1, 6)
        events.append((at, rng.randint(0, 49), rng.choice(KINDS[:-2]) if rng.random() < 0.97 else rng.choice(KINDS), rng.choice(["x", "y", None]), rng.randint(0, 5), first, first + rng.randint(0, 25), rng.randint(0, 45)))
    s, e = spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(events, editing.EVENTS).repartition(4)
    got = editing.folded(s, e)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(sections, events)
    assert sorted(str(tuple(r)) for r in editing.folded(s, e.limit(0)).collect()) == plain(sections, [])
    assert editing.folded(s.limit(0), e.limit(0)).count() == 0
    alls = editing.folded(s, editing.accept_all(s, 5))
    assert alls.filter("section_type = 'auto' and not accepted").count() == 0 and alls.filter("section_type = 'custom' and accepted").count() == 0


def test_extension_and_polylines(spark):
    at = lambda k: 46 + k * 0.0009  # noqa: E731  some 100 m apart
    tracks = spark.createDataFrame([(1, k + 1, at(k), 7.0) for k in range(30)] + [(2, k + 1, at(29 - k), 7.0) for k in range(30)] + [(3, 1, 46.0, 7.0), (3, 2, 46.1, 7.0)], "track_id long, seq int, lat double, lng double")
    lines = [(10, p, at(5 + p), 7.0001) for p in range(6)] + [(20, p, at(5 + p), 7.0001) for p in range(6)] + [(30, p, at(5 + p), 7.5) for p in range(3)] + [(40, p, at(p), 7.0) for p in range(3)] + [(50, 0, 46.0, 7.0)]
    line = spark.createDataFrame(lines, "section_id long, point int, lat double, lng double")
    own = spark.createDataFrame([(10, 1), (20, 2), (30, 1), (40, 3), (50, 1), (60, None)], "section_id long, track_id long")
    got = {r["section_id"]: (r["track_id"], r["first"], r["last"], r["fixes"]) for r in editing.extension(own, line, tracks, 50.0).collect()}
    assert got == {10: (1, 6, 11, 30), 20: (2, 20, 25, 30), 30: (1, 6, 8, 30)}  # the third by the fixes nearest to its ends
    s = spark.createDataFrame([(10, "auto", "Ride", "track", 1, 3, 14), (20, "custom", "Ride", "own", None, 1, 3), (40, "auto", "Ride", "own", None, 0, 0)], "section_id long, section_type string, sport_type string, base string, track_id long, first int, last int")
    found = editing.polylines(s, line, tracks)
    assert sorted((r["section_id"], r["point"]) for r in found.collect()) == [(10, p) for p in range(12)] + [(20, 0), (20, 1), (20, 2), (40, 0)]
    assert {r["section_id"]: round(r["section_meters"]) for r in editing.long_enough(found).collect()} == {10: 1101, 20: 200}
    sports = spark.createDataFrame([(1, "Ride"), (2, "Run"), (3, "Ride")], "track_id long, sport_type string")
    m = {(r["section_id"], r["track_id"]): (r["first"], r["last"], r["direction"]) for r in editing.rematched(s, found, tracks, sports).collect()}
    assert m[10, 1] == (2, 15, "same") and m[20, 1][2] == "same" and all(t != 2 for _, t in m)


def test_a_made_section_beside_one_of_its_number(spark):
    """section 1,000,001 is there already when section 1 has one made that is shown under that number."""
    from types import SimpleNamespace

    from stridelake.plans import registry

    s = spark.createDataFrame([(1, "auto", "A", "Ride", 1000.0, False, None), (1_000_001, "auto", "B", "Run", 500.0, False, None)], "section_id long, section_type string, name string, sport_type string, section_meters double, disabled boolean, superseded_by long")
    got = registry.OVER_TABLES["g18_edit_log"](SimpleNamespace(sections=s))
    rows = sorted((r["section_id"], r["name"], r["base"], r["first"], r["last"], r["refused"]) for r in got.collect())
    assert rows == [(1, "A", "own", 0, 10, 0), (1_000_001, "B", "own", 0, 5, 0), (1_000_001, "Made", "track", 3, 11, 1), (2_000_001, "Made", "track", 3, 11, 1)]
