"""Edits of sections: a log of events folded into the table, extension tracks, and the rematch of what changed.

A section's polyline is the stretch `first` to `last` (positions, both
included) of a line: its own stored line (`base` 'own') or a track's fixes
(`base` 'track', with `track_id`). So trimming, expanding and taking another
reference change numbers, and the original comes back by dropping them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.detection import step_lengths
from stridelake.operators.graph import ensure_checkpoint_dir
from stridelake.operators.spatial import radius_join
from stridelake.operators.upkeep import best_spans

# Fewest points and metres of a trimmed or expanded section; reach of an extension track.
LEAST_POINTS, LEAST_METRES, EXTENSION_M = 5, 50.0, 100.0
#: An event: at (order of events), section_id, kind and what the kind needs.
EVENTS = "at long, section_id long, kind string, name string, track_id long, first int, last int, other_id long"
#: What events set; the fold keeps it in this order.
STATE = [
    ("name", "string"), ("accepted", "boolean"), ("disabled", "boolean"), ("superseded_by", "long"), ("track_id", "long"),
    ("base", "string"), ("first", "int"), ("last", "int"), ("original_base", "string"), ("original_first", "int"), ("original_last", "int"), ("original_track", "long"), ("gone", "boolean"), ("refused", "int"),
]


def _new(state: Column, **changes) -> Column:
    """A state with some fields changed."""
    return F.struct(*(F.coalesce(changes[n], F.lit(None)).cast(t).alias(n) if n in changes else state[n].alias(n) for n, t in STATE))


def _step(state: Column, e: Column) -> Column:
    """The state after one event; an event that its section does not allow counts as refused and changes nothing else."""
    kind = e["kind"]
    size = state["last"] - state["first"] + 1
    length = e["last"] - e["first"] + 1
    trims = (e["first"] >= 0) & (e["first"] < e["last"]) & (e["last"] < size) & (length >= LEAST_POINTS)
    backup = {
        "original_base": F.coalesce(state["original_base"], state["base"]),
        "original_first": F.when(state["original_base"].isNull(), state["first"]).otherwise(state["original_first"]),
        "original_last": F.when(state["original_base"].isNull(), state["last"]).otherwise(state["original_last"]),
        "original_track": F.when(state["original_base"].isNull(), state["track_id"]).otherwise(state["original_track"]),
    }
    none, yes = F.lit(None), F.lit(True)
    return (
        F.when(state["gone"], _new(state, refused=state["refused"] + 1))
        .when(kind == "rename", _new(state, name=e["name"], accepted=yes))
        .when(kind == "accept", _new(state, accepted=yes))
        .when(kind.isin("disable", "enable"), _new(state, disabled=kind == "disable"))
        .when(kind == "supersede", _new(state, superseded_by=e["other_id"]))
        .when(kind == "reset_reference", _new(state, accepted=F.lit(False)))
        .when(kind == "delete", _new(state, gone=yes))
        .when((kind == "reference") & (length >= 2), _new(state, accepted=yes, track_id=e["track_id"], base=F.lit("track"), first=e["first"], last=e["last"]))
        .when((kind == "trim") & trims, _new(state, accepted=yes, first=state["first"] + e["first"], last=state["first"] + e["last"], **backup))
        .when((kind == "expand") & (length >= LEAST_POINTS), _new(state, accepted=yes, track_id=e["track_id"], base=F.lit("track"), first=e["first"], last=e["last"], **backup))
        .when(
            (kind == "reset_bounds") & state["original_base"].isNotNull(),
            _new(state, accepted=e["custom"], base=state["original_base"], first=state["original_first"], last=state["original_last"], track_id=state["original_track"], original_base=none, original_first=none, original_last=none, original_track=none),
        )
        .otherwise(_new(state, refused=state["refused"] + 1))
    )


def folded(sections: DataFrame, events: DataFrame) -> DataFrame:
    """The table of sections after a log of edits, and for each section how many of its events were refused.

    sections: section_id, section_type, sport_type, name, accepted, disabled,
    superseded_by, track_id, base, first, last. events: EVENTS, in order of
    `at` (of equal ones by kind). Kinds: create (a custom section from a
    stretch of a track, with name and, as other_id, the section whose sport it
    takes), accept, rename (accepts), reference (another track's stretch;
    accepts), reset_reference, trim (positions within the section as it is
    then; accepts), expand (a stretch of an extension track; accepts),
    reset_bounds (back to what was before the first trim or expansion; a
    custom section stays accepted), disable, enable, supersede (by other_id),
    delete (for good; sections that it superseded are free again).

    Refused: trims that are no stretch of five points or more within the
    section, expansions of fewer than five points, a reset without an
    original, anything after a delete, kinds that are not known, and events of
    a section that is not there. A second create of an id is refused, too. The
    log of one section is one array in the JVM: what users did to it by hand.
    """
    ensure_checkpoint_dir(sections.sparkSession)
    made = events.filter("kind = 'create' and last > first").groupBy("section_id").agg(F.min(F.struct("at", "name", "track_id", "first", "last", "other_id")).alias("c"))
    sport = sections.select(F.col("section_id").alias("other"), F.col("sport_type"))
    made = made.join(sections.select("section_id"), "section_id", "left_anti").join(sport, F.col("c.other_id") == F.col("other"), "left")
    new = made.select(
        "section_id", F.lit("custom").alias("section_type"), "sport_type", "c.name", F.lit(True).alias("accepted"), F.lit(False).alias("disabled"), F.lit(None).cast("long").alias("superseded_by"),
        "c.track_id", F.lit("track").alias("base"), "c.first", "c.last", F.col("c.at").alias("born"),
    )
    all_of = sections.select(*(c for c in new.columns if c != "born"), F.lit(None).cast("long").alias("born")).unionByName(new)
    log = events.groupBy(F.col("section_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("at", "kind", "name", "track_id", "first", "last", "other_id"))).alias("log"))
    both = all_of.join(log.hint("merge"), F.col("section_id") == F.col("of"), "left")
    # What made a section is no edit of it; what came before it, or makes it again, is refused.
    mine = F.filter(F.coalesce("log", F.array().cast("array<struct<at: long, kind: string, name: string, track_id: long, first: int, last: int, other_id: long>>")), lambda e: ~((e["kind"] == "create") & e["at"].eqNullSafe(F.col("born"))))
    mine = F.transform(mine, lambda e: F.struct(F.when((e["kind"] == "create") | (e["at"] < F.col("born")), "refuse").otherwise(e["kind"]).alias("kind"), *(e[n].alias(n) for n in ("name", "track_id", "first", "last", "other_id")), (F.col("section_type") == "custom").alias("custom")))
    fields = {"gone": F.lit(False), "refused": F.lit(0), **{n: F.lit(None) for n, _ in STATE if n.startswith("original")}}
    start = F.struct(*(fields.get(n, F.col(n)).cast(t).alias(n) for n, t in STATE))
    state = both.withColumn("s", F.aggregate(mine, start, _step)).select("section_id", "section_type", "sport_type", "s").checkpoint()  # the fold is made once
    out, gone = state.filter("not s.gone"), state.filter("s.gone").select(F.col("section_id").alias("dead"))
    free = out.join(gone.hint("merge"), F.col("s.superseded_by") == F.col("dead"), "left")
    return free.select(
        "section_id", "section_type", "sport_type", "s.name", "s.accepted", "s.disabled", F.when(F.col("dead").isNull(), F.col("s.superseded_by")).alias("superseded_by"),
        "s.track_id", "s.base", "s.first", "s.last", F.col("s.original_base").isNotNull().alias("trimmed"), "s.refused",
    )


def accept_all(sections: DataFrame, at: int) -> DataFrame:
    """Events that accept all enabled automatic sections that are not accepted yet."""
    some = sections.filter("section_type = 'auto' and not accepted and not disabled")
    return some.select(F.lit(at).cast("long").alias("at"), "section_id", F.lit("accept").alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in EVENTS.split(", ")[3:])))


def polylines(sections: DataFrame, lines: DataFrame, tracks: DataFrame) -> DataFrame:
    """section_id, point (from 0), lat, lng of each section's stretch of its own line (section_id, point) or of a track (track_id, seq)."""
    s = sections.select("section_id", "base", "track_id", "first", "last")
    # Lines are far larger than the file that they come from, so they are never broadcast.
    own = s.filter("base = 'own'").join(lines.select("section_id", F.col("point").alias("at"), "lat", "lng").hint("merge"), "section_id")
    of_track = s.filter("base = 'track'").join(tracks.select("track_id", F.col("seq").alias("at"), "lat", "lng").hint("merge"), "track_id")
    both = own.select("section_id", "first", "last", "at", "lat", "lng").unionByName(of_track.select("section_id", "first", "last", "at", "lat", "lng"))
    return both.filter(F.col("at").between(F.col("first"), F.col("last"))).select("section_id", (F.col("at") - F.col("first")).cast("int").alias("point"), "lat", "lng")


def long_enough(points: DataFrame, least_m: float = LEAST_METRES) -> DataFrame:
    """Sections whose polyline is at least that long, with its length."""
    steps = step_lengths(points.select(F.col("section_id").alias("track_id"), F.col("point").alias("seq"), "lat", "lng"))
    return steps.groupBy(F.col("track_id").alias("section_id")).agg(F.round(F.sum("step"), 3).alias("section_meters")).filter(F.col("section_meters") >= least_m)


def extension(sections: DataFrame, lines: DataFrame, tracks: DataFrame, threshold_m: float = EXTENSION_M, max_gap: int = 1) -> DataFrame:
    """section_id, track_id, first, last, fixes: where each section lies on the track that represents it.

    It is the longest run of the track's fixes within the threshold of the
    polyline (ties: the earlier one); without any, the stretch between the
    fixes nearest to the polyline's ends (ties: the earlier fix). Sections of
    under two points or without a track, and tracks of under three fixes, have
    no row. The track itself is what users extend a section along.
    """
    sizes = tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("fixes")).filter("fixes >= 3")
    ends = lines.groupBy("section_id").agg(*(f(F.struct("point", "lat", "lng")).alias(n) for n, f in (("a", F.min), ("b", F.max))), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    ensure_checkpoint_dir(tracks.sparkSession)
    wanted = sections.select("section_id", "track_id").join(sizes.hint("merge"), "track_id").join(ends.hint("merge"), "section_id").checkpoint()
    own = lines.join(wanted.select("section_id").hint("merge"), "section_id", "left_semi")
    # Only a section's own track is of interest: each section meets a copy of it, keyed by the section.
    on_track = wanted.select("section_id", "track_id").join(tracks.select("track_id", "seq", "lat", "lng").hint("merge"), "track_id").select(F.col("section_id").alias("track_id"), "seq", "lat", "lng")
    near = radius_join(on_track, own.select(F.col("section_id").alias("track_id"), F.col("lat").alias("rlat"), F.col("lng").alias("rlng")), threshold_m, ["track_id"]).select("track_id", "seq").distinct()
    runs = portions_of(near, max_gap).filter("points >= 2")
    best = runs.groupBy(F.col("track_id").alias("s1")).agg(F.max(F.struct((F.col("last") - F.col("first")).alias("size"), (-F.col("first")).alias("f"), "first", "last")).alias("r")).checkpoint()
    far = wanted.join(best.hint("merge"), F.col("section_id") == F.col("s1"), "left_anti")
    gap = lambda end: (F.pow(F.col("lat") - F.col(f"{end}.lat"), 2) + F.pow(F.col("lng") - F.col(f"{end}.lng"), 2)).alias("gap")
    nearest = lambda end: F.min(F.struct(gap(end), "seq"))["seq"]
    fall = far.join(tracks.select("track_id", "seq", "lat", "lng").hint("merge"), "track_id").groupBy(F.col("section_id").alias("s2")).agg(nearest("a").alias("p"), nearest("b").alias("q"))
    out = wanted.join(best.hint("merge"), F.col("section_id") == F.col("s1"), "left").join(fall.hint("merge"), F.col("section_id") == F.col("s2"), "left")
    return out.select("section_id", "track_id", F.coalesce("r.first", F.least("p", "q")).alias("first"), F.coalesce("r.last", F.greatest("p", "q")).alias("last"), "fixes")


def portions_of(near: DataFrame, max_gap: int) -> DataFrame:
    """Runs of positions (track_id, seq) over gaps of at most max_gap."""
    w = Window.partitionBy("track_id").orderBy("seq")
    starts = near.withColumn("s", (F.coalesce(F.col("seq") - F.lag("seq").over(w), F.lit(10**9)) > max_gap + 1).cast("int"))
    runs = starts.withColumn("run", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("track_id", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("points"))


def rematched(sections: DataFrame, lines: DataFrame, tracks: DataFrame, track_sports: DataFrame, custom=(50.0, 0.8), relaxed=(125.0, 0.4)) -> DataFrame:
    """Stretches of the tracks of a section's sport on it, with the thresholds of its type (custom, or automatic ones after a change)."""
    out = []
    for kind, (threshold, least) in (("custom", custom), ("auto", relaxed)):
        some = sections.filter(F.col("section_type") == kind).select("section_id", "sport_type")
        found = best_spans(tracks, lines.join(some.select("section_id"), "section_id", "left_semi"), threshold, least)
        out.append(found.join(some, "section_id").join(track_sports, ["track_id", "sport_type"], "left_semi").drop("sport_type"))
    return out[0].unionByName(out[1])
