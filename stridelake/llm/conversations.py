"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A conversation's rows, in order of turn, become one whose role initials match
(s?(ua)+)? at the least cost. An item is "the first i rows are read and the
automaton of that expression is in state q"; its weight is (cost, audit), the
audit being the initials of the edits in order. A deduction reads a row (Keep,
Rerole, Delete) or writes one (Insert): its weight is never less than that of
the item that it follows from, and it keeps the order of weights, since two
audits of one item and one cost are never one the start of the other. So items
are popped from an agenda by weight, and the first weight of an item is final.

Conversations of any length are cut into segments: rows are put in order by
ranges, and each task derives, for each state that a segment may be entered in,
the lightest way to each state it may be left in. Segments are then joined in
order. Texts go through one task a conversation, for its hash, one at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import Scratch

# Costs of edits, and the white space that counts for nothing.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: States: nothing written, after a system row, after a user row, after an assistant row; what each may be followed by.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The state after a row that is written or given another role.
WRITTEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows of a segment.
SEGMENT = 512

Weight = tuple[int, str]
#: A row as the agenda sees it: initial of its role, whether it must go, whether it is truncated, and how many copies follow, which must go.
Row = tuple[str, bool, bool, int]


def lightest(rows: list[Row], start: int) -> dict[int, Weight]:
    """From state `start`, the lightest (cost, audit) of reading all rows, for each state to end in."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    ends: dict[int, Weight] = {}
    while agenda and len(ends) < len(NEXT):
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, WRITTEN[q]))
        if i == len(rows):
            ends[q] = cost, audit
            continue
        initial, must, truncated, copies = rows[i]
        more, cost_more = "D" * copies, DELETE * copies
        heapq.heappush(agenda, (cost + DELETE + cost_more, audit + "D" + more, i + 1, q))
        if not must:
            cost += cost_more + TRUNCATED * truncated
            if initial in NEXT[q]:
                heapq.heappush(agenda, (cost, audit + "K" + more, i + 1, NEXT[q][initial]))
            heapq.heappush(agenda, (cost + REROLE, audit + "R" + more, i + 1, WRITTEN[q]))
    return ends


def joined(so_far: dict[int, Weight], ways: list[dict]) -> dict[int, Weight]:
    """The lightest weights after a further segment, whose ways are {from, to, cost, audit}."""
    out: dict[int, Weight] = {}
    for w in ways:
        if (before := so_far.get(w["from"])) is not None:
            new = before[0] + w["cost"], before[1] + w["audit"]
            if w["to"] not in out or new < out[w["to"]]:
                out[w["to"]] = new
    return out


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[str]:
    """`role:text` of the rows that an audit leaves or writes, in order."""
    at, state = 0, START
    for role, text in rows:
        while audit[at] == "I":
            at, state = at + 1, WRITTEN[state]
            yield ROLE[state] + ":"
        if audit[at] == "K":
            state = NEXT[state][role[:1]]
            yield f"{role}:{text}"
        elif audit[at] == "R":
            state = WRITTEN[state]
            yield f"{ROLE[state]}:{text}"
        at += 1
    for _ in audit[at:]:
        state = WRITTEN[state]
        yield ROLE[state] + ":"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, b.num_rows, 256):  # few rows at a time as Python objects
            yield from b.slice(k, 256).to_pylist()


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


WAYS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to segments: their place, initials at both ends, illegal neighbours, and the lightest ways through."""
    rows: list[Row] = []
    head, conv, known = None, None, False  # known: the conversation began in this partition, so its first segment starts at START
    initials = ["", "", 0]

    def done() -> pa.RecordBatch:
        ways = [{"from": s, "to": q, "cost": c, "audit": a} for s in ([START] if known else NEXT) for q, (c, a) in lightest(rows, s).items()]
        return _table({
            "conv": ([conv], pa.int64()), "turn": ([head["turn"]], pa.int64()), "role": ([head["role"]], pa.string()), "sha": ([head["sha"]], pa.binary()),
            "head": ([initials[0]], pa.string()), "tail": ([initials[1]], pa.string()), "illegal": ([initials[2]], pa.int64()), "ways": ([ways], WAYS),
        })

    first = True
    for r in _rows(batches):
        new = first or r["conv"] != conv
        if rows and (new or len(rows) == SEGMENT):
            yield done()
            rows = []
        if not rows:
            head, conv, known, initials = r, r["conv"], new and not first, [r["initial"], r["initial"], 0]
        else:
            initials[2] += initials[1] + r["initial"] not in LEGAL
            initials[1] = r["initial"]
        initials[2] += (r["n"] - 1) * (2 * r["initial"] not in LEGAL)
        rows.append((r["initial"], r["must"], r["truncated"], r["n"] - 1))
        first = False
    if rows:
        yield done()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order to one row for each conversation: illegal neighbours, cost and audit."""
    conv, tail, illegal, so_far = None, None, 0, None

    def done() -> pa.RecordBatch:
        cost, audit = min(so_far[q] for q in (START, ASSISTANT) if q in so_far)
        return _table({"conv": ([conv], pa.int64()), "illegal": ([illegal], pa.int64()), "cost": ([cost], pa.int64()), "audit": ([audit], pa.string())})

    for r in _rows(batches):
        if so_far is None or r["conv"] != conv:
            if so_far is not None:
                yield done()
            conv, tail, illegal, so_far = r["conv"], None, 0, {START: (0, "")}
        illegal += r["illegal"] + (tail is not None and tail + r["head"] not in LEGAL)
        tail, so_far = r["tail"], joined(so_far, r["ways"])
    if so_far is not None:
        yield done()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of a head with its audit and then its rows, in order, to the hash of the repaired rows."""
    for _, group in itertools.groupby(_rows(batches), key=lambda r: r["conv"]):
        head, sha = next(group), hashlib.sha256()
        each = ((r["role"], r["text"]) for r in group for _ in range(r["n"]))
        for k, line in enumerate(repaired(each, head["text"])):
            sha.update((b"\n" if k else b"") + line.encode("utf-8"))
        yield _table({"conv": ([head["conv"]], pa.int64()), "repaired_sha256": ([sha.hexdigest()], pa.string())})


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, n: rows after the damage that crc32 of `conv:turn` rules; a row that is repeated has n = 2. Nulls are one space."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(words(conv), F.lit(":"), words(turn)).cast("binary")) % 20
    return rows.filter(kind != 0).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(words(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(words(text), ENDS, "")).otherwise(words(text)).alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _in_order() -> list[Column]:
    return [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("sha")]


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of rows.

    Rows are first damaged by rule, unless `damage` is false. A conversation's
    rows are taken by turn (nulls first; of equal turns by role, then by the
    SHA-256 of the text). Nulls in role or text are one space; rows whose conv
    is null are one conversation. Each row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated. gaps counts the turns
    that are missing between the first and the last (at most 2**63 - 1).
    A conversation without rows after damage has zeros, an empty audit and the
    hash of nothing. Other columns are ignored; empty input gives no rows.

    Texts are shuffled once. All else works on 50 bytes a row: copies are
    counted by partial aggregation, first occurrences are an aggregation and a
    sort-merge join, and rows are put in order by ranges, so a conversation of
    any length is spread over tasks; its segments, its audit and the stream
    of its texts into one hash are what one task must see.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    given = rows.select(F.col(conv).cast("long").alias("conv"))
    if damage:
        now = damaged(rows, conv, turn, role, text)
    else:
        words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        now = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), words(role).alias("role"), words(text).alias("text"), F.lit(1).cast("long").alias("n"))
    now = now.withColumn("sha", F.unhex(F.sha2("text", 256)))
    seen = F.rtrim("text", F.lit(SPACE))
    marks = scratch.save(
        now.select("conv", "turn", "role", "sha", "n", (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(*ENDS)).alias("open"))
        .groupBy("conv", "turn", "role", "sha", "blank", "open").agg(F.sum("n").alias("n")),
        "marks",
    )
    first = scratch.save(marks.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s"))
    later = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    must = F.col("blank") | later
    faults = scratch.save(
        marks.join(first.hint("merge"), same).select(
            "conv", "turn", "role", "sha", "n", F.substring("role", 1, 1).alias("initial"), must.alias("must"), (~must & F.col("open")).alias("truncated"),
            F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blanks"), F.when(F.col("blank"), 0).when(later, F.col("n")).otherwise(F.col("n") - 1).alias("copies"),
        ),
        "faults",
    )
    scratch.drop(marks)
    scratch.drop(first)
    of_turn = faults.groupBy("conv", "turn").agg(F.sum("blanks").alias("blank"), F.sum("copies").alias("duplicate"), F.sum(F.col("truncated").cast("long")).alias("truncated"))
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count("turn")
    counts = of_turn.groupBy("conv").agg(
        F.least(F.coalesce(span, F.lit(0)), F.lit(2**63 - 1)).cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated"))
    )
    segments = (
        faults.select("conv", "turn", "role", "sha", "n", "initial", "must", "truncated").repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order())
        .mapInArrow(_segments, "conv long, turn long, role string, sha binary, head string, tail string, illegal long, ways array<struct<from: int, to: int, cost: long, audit: string>>")
    )
    repairs = segments.repartition("conv").sortWithinPartitions(*_in_order()).mapInArrow(_joined, "conv long, illegal long, cost long, audit string")
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [given.distinct(), counts, repairs]
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p, allowMissingColumns=True)
    heads = scratch.save(
        each.groupBy("conv").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in figures), F.coalesce(F.max("audit"), F.lit("")).alias("audit")), "heads"
    )
    stream = heads.select("conv", F.lit(0).alias("of"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"), F.lit(b"").alias("sha")).unionByName(
        now.withColumn("of", F.lit(1))
    )
    hashes = (
        stream.repartition("conv").sortWithinPartitions("conv", "of", *_in_order()[1:]).select("conv", "role", "text", "n")
        .mapInArrow(_hashed, "conv long, repaired_sha256 string")
    )
    return heads.join(hashes.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).select(F.col("conv").alias("conv_id"), *figures, "audit", "repaired_sha256")


def oracle_sql() -> str:
    """DuckDB SQL: the table of CRC-32 from its polynomial, then a walk over rows that keeps the lightest (cost, audit) of each state as one string."""
    add = lambda v, cost, edit: f"printf('%09d', left({v}, 9)::int + {cost}) || substr({v}, 10) || '{edit}'"
    read = lambda v, edit, cost: add(v, f"({cost} + open)", edit)
    kept = lambda v, initial: f"case when not must and initial = '{initial}' then {read(v, 'K', 0)} end"
    turned = lambda v: f"case when not must then {read(v, 'R', REROLE)} end"
    ins = lambda v: add(v, INSERT, "I")
    closed = f"""select *, least(c3, {ins('w2')}) w3 from (select *, c0 w0, c1 w1, least(c2, {ins('c0')}, {ins('c1')}, {ins('c3')}) w2 from"""
    return f"""
        with recursive tab as (
            select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t
        ),
        keyed as (
            select conv_id, turn, coalesce(role, ' ') "role", coalesce(text, ' ') "text",
                coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k
            from conversations
        ),
        kinds as (
            select *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 kind
            from keyed, tab
        ),
        damaged as (
            select conv_id, turn, case when kind = 4 then 'user' else "role" end "role",
                case when kind = 1 then '' when kind = 2 then translate("text", '.!?', '') else "text" end "text"
            from (select * from kinds union all select * from kinds where kind = 3) where kind <> 0
        ),
        marked as (
            select *, row_number() over (partition by conv_id, "role", "text" order by i) copy,
                rtrim("text", chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) seen, left("role", 1) initial
            from (select *, row_number() over (partition by conv_id order by turn nulls first, "role", sha256("text")) i from damaged)
        ),
        faults as (
            select *, seen = '' blank, seen <> '' and copy > 1 again, seen = '' or copy > 1 must,
                (seen <> '' and copy = 1 and right(seen, 1) not in ('.', '!', '?'))::int "open"
            from marked
        ),
        figures as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, sum(blank::int) blank, sum(again::int) duplicate, sum("open") truncated,
                sum((before is not null and before || initial not in ('su', 'ua', 'au'))::int) illegal
            from (select *, lag(initial) over (partition by conv_id order by i) before from faults) group by conv_id
        ),
        walk as (
            select distinct conv_id, 0::bigint i, '000000000' c0, null::varchar c1, null::varchar c2, null::varchar c3 from conversations
            union all
            select v.conv_id, f.i, {add('w0', DELETE, 'D')}, least({add('w1', DELETE, 'D')}, {kept('w0', 's')}),
                least({add('w2', DELETE, 'D')}, {kept('w0', 'u')}, {kept('w1', 'u')}, {kept('w3', 'u')}, {turned('w0')}, {turned('w1')}, {turned('w3')}),
                least({add('w3', DELETE, 'D')}, {kept('w2', 'a')}, {turned('w2')})
            from ({closed} walk)) v join faults f on f.conv_id is not distinct from v.conv_id and f.i = v.i + 1
        ),
        best as (
            select conv_id, least(w0, w3) b from ({closed} (select * from walk qualify i = max(i) over (partition by conv_id))))
        ),
        edits as (
            select conv_id, p, edit, sum((edit <> 'I')::int) over w i, sum((edit <> 'D')::int) over w e
            from (select conv_id, substr(b, 10) audit, unnest(range(1, len(b) - 8)) p, substr(b, 9 + p, 1) edit from best)
            window w as (partition by conv_id order by p)
        ),
        lines as (
            select d.conv_id, d.p, d.edit, d.e, f."role", f."text", f.initial,
                max(case when d.e = 1 and d.edit = 'K' and f.initial = 's' then 1 else 0 end) over (partition by d.conv_id) system
            from edits d left join faults f on f.conv_id is not distinct from d.conv_id and f.i = d.i and d.edit <> 'I'
        ),
        whole as (
            select conv_id, string_agg(case when edit = 'K' then "role" when (e - system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else "text" end, chr(10) order by p) s
            from lines where edit <> 'D' group by conv_id
        )
        select b.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
            coalesce(illegal, 0)::bigint illegal, left(b, 9)::bigint "cost", substr(b, 10) audit, sha256(coalesce(s, '')) repaired_sha256
        from best b left join figures f on f.conv_id is not distinct from b.conv_id left join whole w on w.conv_id is not distinct from b.conv_id
    """
