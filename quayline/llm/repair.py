"""Conversation repair: the cheapest edits that make a conversation alternate, found by iterative-deepening A*.

A conversation is right if its roles' initials are `(s?(ua)+)?`. A row may be kept, given the role that is due,
or deleted; a row with the role that is due and no text may be inserted anywhere. Of equally cheap edits the
least in ASCII order of their initials counts.

Rows are put in order by a range sort. A conversation that lies within a task is searched there at once. One
that the sort splits, or that is longer than a segment, comes as segments: their costs from each state of the
alternation to each other are folded backwards, every segment is then searched for itself against the cost
that remains behind it, and a last pass strings the segments together. Both passes stream over segments and
hold one.

A null role, text or turn counts as one blank where it is text; rows without a turn come first. Rows that share
a turn are ordered by role, then text. Repeated rows are duplicates. Rows without conv_id form a conversation of
their own. A conversation all of whose rows the damage drops is reported with zeros; an empty table gives no
rows. Other columns than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import in_batches, stored

#: What a conversation has come to: nothing yet, or the role of its last row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The role that is due next: what an inserted row or one of a changed role gets.
DUE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
AFTER = {(NOTHING, "s"): SYSTEM, (USER, "a"): ASSISTANT, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER}
#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Rows that are still due at the end of a conversation, by state, and what they cost.
TAIL = ("", "II", "I", "")
ENDS = tuple(INSERT * len(tail) for tail in TAIL)
#: A row's first fault.
RIGHT, BLANK, DUPLICATE, CUT = "-bdt"
#: Rows and characters of a segment.
SEGMENT, SEGMENT_TEXT = 256, 4 << 20
FAR = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [column.split()[0] for column in REPORT.split(", ")]
SEGMENTS = "part int, seq int, transfer array<long>, turns array<long>, roles array<string>, texts array<string>, faults string"


def edits(initials: str, faults: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, next row, next state) in ASCII order of the edits."""
    found = [("D", DELETE, i + 1, state), ("I", INSERT, i, DUE[state])]
    if faults[i] not in (BLANK, DUPLICATE):
        stays = TRUNCATED if faults[i] == CUT else 0
        kept = AFTER.get((state, initials[i]))
        if kept is not None:
            found.append(("K", stays, i + 1, kept))
        found.append(("R", REROLE + stays, i + 1, DUE[state]))
    return found


def searched(initials: str, faults: str, entry: int = NOTHING, ends: Iterable[int] = ENDS) -> tuple[str, int]:
    """The cheapest edits of rows from a state on, and the state they end in; `ends` is what each costs from there.

    Depth-first search in ASCII order of the edits, under a bound that grows to the least cost it has shown to
    be needed. States that failed are remembered with what they need at least.
    """
    n, ends = len(initials), tuple(ends)
    if not n:
        return "", entry
    rest = [min(ends)] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if faults[i] != RIGHT else 0)
    needs: dict[tuple[int, int], int] = {}

    def least(i: int, state: int) -> int:
        return ends[state] if i == n else needs.get((i, state), rest[i])

    while True:
        path, low = [], [FAR]
        stack = [(0, entry, least(0, entry), iter(edits(initials, faults, 0, entry)))]
        while stack:
            i, state, bound, todo = stack[-1]
            for name, cost, j, after in todo:
                needed = cost + least(j, after)
                if needed > bound:
                    low[-1] = min(low[-1], needed)
                    continue
                path.append((name, cost))
                if j == n:
                    return "".join(edit for edit, _ in path), after
                low.append(FAR)
                stack.append((j, after, bound - cost, iter(edits(initials, faults, j, after))))
                break
            else:
                stack.pop()
                failed = needs[i, state] = max(least(i, state), low.pop())
                if stack:
                    low[-1] = min(low[-1], path.pop()[1] + failed)


def transfer(initials: str, faults: str) -> list[int]:
    """The least cost of a segment from each state to each state, row by row."""
    out: list[int] = []
    for entry in range(4):
        costs = [FAR] * 4
        costs[entry] = 0
        for i in range(len(initials)):
            for _ in range(2):
                for state in range(4):
                    costs[DUE[state]] = min(costs[DUE[state]], costs[state] + INSERT)
            now = [FAR] * 4
            for state in range(4):
                for name, cost, _, after in edits(initials, faults, i, state):
                    if name != "I":
                        now[after] = min(now[after], costs[state] + cost, FAR)
            costs = now
        out += costs
    return out


class Report:
    """What is said about one conversation, segment after segment."""

    def __init__(self):
        self.state, self.cost, self.audit = NOTHING, 0, []
        self.first = self.last = None
        self.distinct = self.illegal = 0
        self.faults = dict.fromkeys((BLANK, DUPLICATE, CUT), 0)
        self.before: str | None = None
        self.hash, self.any = hashlib.sha256(), False

    def add(self, turns: list[int | None], roles: list[str], texts: list[str], faults: str, audit: str) -> None:
        for turn in turns:
            if turn is not None and turn != self.last:
                self.first, self.last = turn if self.first is None else self.first, turn
                self.distinct += 1
        for role in roles:
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
        for fault in self.faults:
            self.faults[fault] += faults.count(fault)
        self.edit(audit, roles, texts, faults)

    def edit(self, audit: str, roles: list[str], texts: list[str], faults: str) -> None:
        self.audit.append(audit)
        i = 0
        for edit in audit:
            if edit == "D":
                self.cost += DELETE
                i += 1
                continue
            self.state = AFTER[self.state, roles[i][0]] if edit == "K" else DUE[self.state]
            if edit == "I":
                self.cost += INSERT
                self.line(ROLES[self.state], "")
                continue
            self.cost += (REROLE if edit == "R" else 0) + (TRUNCATED if faults[i] == CUT else 0)
            self.line(roles[i] if edit == "K" else ROLES[self.state], texts[i])
            i += 1

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True

    def told(self) -> dict:
        self.edit(TAIL[self.state], [], [], "")
        return {
            "gaps": 0 if self.first is None else self.last - self.first + 1 - self.distinct,
            "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT],
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest(),
        }


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after the damage that the checksum of `conv_id:turn` asks for."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return rows.where(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def in_order(turn: Column) -> Column:
    """Sorts rows without a turn before all others."""
    return F.struct(turn.isNotNull().alias("given"), turn.alias("turn"))


def with_first(rows: DataFrame) -> DataFrame:
    """Equal rows as one with `copies`, and whether its conversation has that role and text in no earlier turn.

    Both are aggregates, so that rows met very often are combined before they move.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn(
        "digest", F.sha2(F.concat("role", F.lit(":"), "text"), 256)
    )
    first = rows.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("same")).agg(F.min(in_order(F.col("turn"))).alias("first"))
    found = rows.join(first, rows.conv_id.eqNullSafe(first.of) & (rows.digest == first.same))
    return found.withColumn("is_first", in_order(F.col("turn")).eqNullSafe(F.col("first"))).drop("of", "same", "first", "digest")


def fault(text: str, is_first: bool) -> str:
    text = text.rstrip(BLANKS)
    return BLANK if not text else DUPLICATE if not is_first else RIGHT if text[-1] in ".!?" else CUT


def segments(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """Reports of the conversations that lie within a task; segments, without a report, of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        conv, held, whole, out = None, [], False, []

        def filled(is_whole: bool) -> dict:
            nonlocal seq, held, size
            turns, roles, texts, faults = map(list, zip(*held))
            initials, faults = [role[:1] for role in roles], "".join(faults)
            held, size, seq = [], 0, seq + 1
            if is_whole:
                report = Report()
                report.add(turns, roles, texts, faults, searched(initials, faults)[0])
                return {"conv_id": conv, **report.told()}
            return {
                "conv_id": conv, "part": part, "seq": seq, "transfer": transfer(initials, faults),
                "turns": turns, "roles": roles, "texts": texts, "faults": faults,
            }

        started = False
        for batch in batches:
            for row in batch.to_pylist():
                if not started or row["conv_id"] != conv:
                    if held:
                        out.append(filled(whole))
                    # The task's first conversation may have begun in an earlier task.
                    conv, whole, started = row["conv_id"], started, True
                for copy in range(row["copies"]):
                    if held and (len(held) >= most or size >= SEGMENT_TEXT):
                        whole = False
                        out.append(filled(False))
                    held.append((row["turn"], row["role"], row["text"], fault(row["text"], row["is_first"] and not copy)))
                    size += len(row["text"])
                    if len(out) >= most:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        if held:
            out.append(filled(False))  # it may go on in a later task
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    columns = f"{kind}, {SEGMENTS}, {REPORT}"
    schema = arrow(rows, columns)
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_batches(dealt).mapInArrow(run, columns)


def arrow(df: DataFrame, columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(columns), prefers_large_types=False)


def remaining(parts: DataFrame) -> DataFrame:
    """(part, seq, ends): what each segment's end costs from each state, folded from the last segment backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ends, started = None, list(ENDS), False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not started or row["conv_id"] != conv:
                    conv, ends, started = row["conv_id"], list(ENDS), True
                out.append({"part": row["part"], "seq": row["seq"], "ends": ends})
                costs = row["transfer"]
                ends = [min(costs[4 * s + t] + ends[t] for t in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_pylist(out, schema)

    columns = "part int, seq int, ends array<long>"
    schema = arrow(parts, columns)
    dealt = parts.select("conv_id", "part", "seq", "transfer").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    return dealt.mapInArrow(run, columns)


def strung(parts: DataFrame, kind: str) -> DataFrame:
    """Reports of conversations in segments: each is searched from every state, then the states that follow are picked."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits = [
                [searched([role[:1] for role in row["roles"]], row["faults"], entry, row["ends"])[0] for entry in range(4)]
                for row in batch.select(["roles", "faults", "ends"]).to_pylist()
            ]
            yield batch.drop_columns(["ends"]).append_column("audits", pa.array(audits, pa.list_(pa.string())))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, report = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if report is None or row["conv_id"] != conv:
                    if report:
                        out.append({"conv_id": conv, **report.told()})
                    conv, report = row["conv_id"], Report()
                report.add(row["turns"], row["roles"], row["texts"], row["faults"], row["audits"][report.state])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if report:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, **report.told()}], schema)

    columns = "conv_id, part, seq, turns, roles, texts, faults".split(", ")
    found = parts.join(remaining(parts), ["part", "seq"]).select(*columns, "ends")
    found = found.mapInArrow(search, f"{kind}, part int, seq int, turns array<long>, roles array<string>, texts array<string>, faults string, audits array<string>")
    schema = arrow(parts, f"{kind}, {REPORT}")
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(fold, f"{kind}, {REPORT}")


def repaired(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of `rows` as they are.

    `rows` has conv_id, turn, role and text without nulls in the last two, and `copies` of each row.
    """
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    found = stored(segments(with_first(rows), kind, most), "conversations")
    done = found.where("part IS NULL").select("conv_id", *NAMES)
    return done.unionByName(strung(found.where("part IS NOT NULL"), kind).select("conv_id", *NAMES))


def after_damage(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The report of every original conversation after the damage of `damaged`."""
    found = repaired(damaged(rows), most).withColumnRenamed("conv_id", "of")
    every = rows.select("conv_id").distinct()
    report = every.join(found, every.conv_id.eqNullSafe(found.of), "left").drop("of")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return report.na.fill(dict.fromkeys(NAMES, 0) | nothing)


def check_sql() -> str:
    """The same reports by SQL: the least of (cost, edits) for each state, folded over a conversation's rows."""

    def add(entry: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {entry} = '~' THEN '~' ELSE lpad((left({entry}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({entry}, 10) || '{edit}' END"

    state = [f"acc[{n}]" for n in range(1, 5)]
    due = [[0, 1, 3], [2]]  # the states after which a user's, an assistant's row is due
    insert = [state[0], state[1]] + [
        f"least({', '.join([state[to], *(add(state[n], str(INSERT), 'I') for n in own)])})" for to, own in zip((USER, ASSISTANT), due)
    ]
    stays = f"(CASE WHEN x[2] = 't' THEN {TRUNCATED} ELSE 0 END)"
    gone = [add(s, str(DELETE), "D") for s in state]
    kept = lambda n, initial: f"CASE WHEN x[1] = '{initial}' THEN {add(state[n], stays, 'K')} ELSE '~' END"  # noqa: E731
    other = lambda n: add(state[n], f"{REROLE} + {stays}", "R")  # noqa: E731
    row = [gone[0], f"least({gone[1]}, {kept(0, 's')})"] + [
        f"least({', '.join([gone[to], *(kept(n, initial) for n in own), *(other(n) for n in own)])})"
        for to, initial, own in zip((USER, ASSISTANT), "ua", due)
    ]
    return rf"""
WITH steps AS (
  SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
          for i in range(256)] AS t
), sums AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT for c in
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
      lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295::BIGINT) % 20 AS fate
  FROM conversations, steps
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM sums WHERE fate <> 0
), placed AS (
  SELECT *, left(role, 1) AS initial, regexp_replace(text, '[ 	-]+$', '') AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM damaged
), rows AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before,
    CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM placed
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list([initial, fault] ORDER BY place) AS own
  FROM rows GROUP BY conv_id
), walked AS (
  SELECT *, list_reduce(list_prepend(['000000000', '~', '~', '~'],
    list_concat(flatten([[['', ''], ['', ''], r] for r in own]), [['', ''], ['', '']])),
    lambda acc, x: CASE WHEN x[2] = '' THEN [{', '.join(insert)}]
      WHEN x[2] IN ('b', 'd') THEN [{', '.join(gone)}] ELSE [{', '.join(row)}] END) AS found
  FROM told
), best AS (
  SELECT *, left(least(found[1], found[4]), 9)::BIGINT AS cost, substr(least(found[1], found[4]), 10) AS audit FROM walked
), edits AS (
  SELECT conv_id, i, substr(audit, i, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM best)
), lines AS (
  SELECT *, sum((edit <> 'I')::INT) OVER w AS place, sum((edit <> 'D')::INT) OVER w AS line FROM edits
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), spoken AS (
  SELECT l.*, r.role, r.text, max((l.line = 1 AND l.edit = 'K' AND r.initial = 's')::INT) OVER (PARTITION BY l.conv_id) AS system
  FROM lines l LEFT JOIN rows r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.place = r.place AND l.edit <> 'I'
  WHERE l.edit <> 'D'
), hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (line - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS digest FROM spoken GROUP BY conv_id
)
SELECT c.conv_id, {', '.join(f'coalesce(b.{n}, 0)::BIGINT AS {n}' for n in NAMES[:6])},
  coalesce(b.audit, '') AS audit, coalesce(h.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN hashed h ON c.conv_id IS NOT DISTINCT FROM h.conv_id
"""
