"""Conversation structure repair by depth-first branch-and-bound.

A conversation should read as an optional system turn and then pairs of user and assistant, or be empty. Edits of its turns, in
order of turn: Keep (0), Rerole to user or assistant (3), Delete (4, required for blank and duplicate turns), Insert an empty user or
assistant turn anywhere (3); a truncated turn that is not deleted costs 3 more. Wanted are the cheapest edits, and of equally cheap
ones those whose initials (the audit) come first in ASCII.

The search is over (turn, role that stands last), with an explicit stack:

* each letter has one outcome at a node, so an audit is a path; children are visited in ASCII order, and of two paths of one cost the
  earlier has the smaller audit;
* a backward pass gives suffix lower bounds, the cost of finishing when the order of edits does not count;
* the incumbent is the best (cost, audit) so far; a prefix whose cost plus bound does not beat it is cut;
* the dominance table keeps the cost of the prefix that first came to a node; a later one that is no cheaper is cut there.

When the stack is empty the incumbent is proved. Only one code of a turn is held at a time (no texts), so a task's memory does not
follow its longest texts. Spark marks duplicates by a window over (conversation, role, text), streams the codes of each conversation in
order of turn through the search, and streams the texts along the decisions once. A conversation is one stream of one task, as
its result (one order of edits, one hash) is sequential; it is never gathered.

Edge cases: nulls in role and text stand for one space, in the damage's key too. Null turns come first; rows of equal turns are ordered
by role, then by a hash of the text. An empty role has no initial and is never kept as it is. Rows repeated whole are duplicates of the first. A null conv_id is a conversation. A conversation
without rows gives zeros, an empty audit and the hash of the empty string. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACES = " \t\n\x0b\x0c\r"
_FINE, _BLANK, _DUPLICATE, _CUT = range(4)
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # what may be inserted, or what a turn becomes, behind each state
_KEPT = {"s": (_SYSTEM, None, None, None), "u": (_USER, _USER, None, _USER), "a": (None, None, _ASSISTANT, None)}
_NONE = (None, None, None, None)
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ORDER = ["conv_id", "part", "known", "turn", "role", "digest", "kind"]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the checksum of ``conv_id:turn`` chooses."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return (
        rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("fate"))
        .where("fate <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def _keyed(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).select(
        "*", F.col("turn").isNotNull().alias("known"), F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("digest")
    )


def _coded(keyed: DataFrame) -> DataFrame:
    """Every turn's place, role and first fault, without its text."""
    bare = F.rtrim("text", F.lit(_SPACES))
    slim = keyed.select("conv_id", "known", "turn", "role", "digest", (bare == "").alias("bare"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    number = F.expr("row_number() OVER (PARTITION BY conv_id, role, digest ORDER BY known, turn)")
    fault = F.when(F.col("bare"), _BLANK).when(number > 1, _DUPLICATE).when(~F.col("ended"), _CUT).otherwise(_FINE)
    return slim.select("conv_id", "known", "turn", "role", "digest", fault.alias("fault"))


def suffix_bounds(turns: list[tuple[str, int]]) -> list[tuple[int, int, int, int]]:
    """Least cost of finishing from (turn, state), for every turn and the end."""
    bounds = [(0, INSERT * 2, INSERT, 0)]
    for initial, fault in reversed(turns):
        after = bounds[-1]
        kept, more = _KEPT.get(initial, _NONE), TRUNCATED * (fault == _CUT)
        step = []
        for state in range(4):
            best = DELETE + after[state]
            if fault in (_FINE, _CUT):
                best = min(best, REROLE + more + after[_NEXT[state]])
                if kept[state] is not None:
                    best = min(best, more + after[kept[state]])
            step.append(best)
        user = min(step[_USER], INSERT + step[_ASSISTANT])
        bounds.append((min(step[_START], INSERT + user), min(step[_SYSTEM], INSERT + user), user, min(step[_ASSISTANT], INSERT + step[_USER])))
    return bounds[::-1]


def _children(turns: list[tuple[str, int]], at: int, state: int, cost: int) -> list[tuple[int, int, int, int]]:
    """(turn, state, cost, letter) of the edits at a node, in ASCII order of their letters."""
    found = [(at, _NEXT[state], cost + INSERT, 73)]  # I
    if at < len(turns):
        initial, fault = turns[at]
        found.insert(0, (at + 1, state, cost + DELETE, 68))  # D
        if fault in (_FINE, _CUT):
            cost += TRUNCATED * (fault == _CUT)
            kept = _KEPT.get(initial, _NONE)[state]
            if kept is not None:
                found.append((at + 1, kept, cost, 75))  # K
            found.append((at + 1, _NEXT[state], cost + REROLE, 82))  # R
    return found


def _dive(turns: list[tuple[str, int]], bounds: list[tuple[int, int, int, int]]) -> int:
    """Cost of the path that takes the child of least cost and bound at every node: the first incumbent."""
    at, state, cost = 0, _START, 0
    while at < len(turns) or state not in (_START, _ASSISTANT):
        at, state, cost, _ = min(_children(turns, at, state, cost), key=lambda c: (c[2] + bounds[c[0]][c[1]], -c[0]))
    return cost


def search(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the best repair of ``turns``, given as (role's initial, first fault)."""
    bounds = suffix_bounds(turns)
    best, audit = _dive(turns, bounds), None  # any audit of this cost beats none
    reached: dict[int, int] = {}  # dominance: node -> cost of the prefix that holds it
    path = bytearray()
    stack = [(0, _START, 0, 0, 0)]
    while stack:
        at, state, cost, depth, letter = stack.pop()
        least = cost + bounds[at][state]
        if least > best or least == best and audit is not None:
            continue
        node = 4 * at + state
        if node in reached and reached[node] <= cost:
            continue
        reached[node] = cost
        if depth:
            del path[depth - 1 :]
            path.append(letter)
        if at == len(turns) and state in (_START, _ASSISTANT):
            best, audit = cost, bytes(path)
            continue
        for child in reversed(_children(turns, at, state, cost)):
            if child[2] + bounds[child[0]][child[1]] <= best:
                stack.append((*child[:3], depth + 1, child[3]))
    return best, (audit or b"").decode()


def _decisions(name, keys: list[tuple], turns: list[tuple[str, int]], report: dict) -> Iterator[tuple]:
    """Rows of the decision table: a summary, then a row for each turn that stays, with the roles inserted before it."""
    cost, audit = search(turns)
    waiting: list[str] = []
    kept, at, state = [], 0, _START
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            waiting.append(_NAMES[state])
            continue
        if letter in "KR":
            role = keys[at][2]
            if letter == "R":
                state = _NEXT[state]
                role = _NAMES[state]
            else:
                state = _KEPT[turns[at][0]][state]
            kept.append((name, 1, *keys[at], 0, [*waiting, role], None, None, None))
            waiting = []
        at += 1
    values = [report[k] for k in REPORT[:-1]]
    yield (name, 0, None, None, None, None, 0, None, audit, [*values, cost], None)
    yield from kept
    if waiting:
        yield (name, 2, None, None, None, None, 0, waiting, None, None, None)


_DECISION = "part INT, known BOOLEAN, turn BIGINT, role STRING, digest BINARY, kind INT, roles ARRAY<STRING>, audit STRING, report ARRAY<BIGINT>, text STRING"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _records(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(first, rows).columns), strict=True)


def decisions(keyed: DataFrame) -> DataFrame:
    """The decision table: per conversation a summary with audit and report, and a row for each turn that stays."""
    conv = keyed.schema["conv_id"]
    schema = StructType([conv, *StructType.fromDDL(_DECISION)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def solved() -> Iterator[tuple]:
            now, keys, turns = None, [], []
            for name, known, turn, role, digest, fault in _records(batches):
                if now is None or now[0] != name:
                    if now is not None:
                        yield from _decisions(now[0], keys, turns, _report(keys, turns))
                    now, keys, turns = (name,), [], []
                keys.append((known, turn, role, digest))
                turns.append((role[:1], fault))
            if now is not None:
                yield from _decisions(now[0], keys, turns, _report(keys, turns))

        yield from _batches(solved(), to_arrow_schema(schema))

    order = ["conv_id", "known", "turn", "role", "digest", "fault"]
    # of equal rows the one that is no duplicate comes first
    first = F.when(F.col("fault") == _DUPLICATE, 1).otherwise(0)
    return _coded(keyed).repartition("conv_id").sortWithinPartitions(*order[:-1], first).select(*order).mapInArrow(run, schema)


def _report(keys: list[tuple], turns: list[tuple[str, int]]) -> dict:
    """Counts of a conversation's faults; its turns are in order."""
    numbered = [turn for known, turn, _, _ in keys if known]
    gaps = numbered[-1] - numbered[0] + 1 - len(set(numbered)) if numbered else 0
    faults = [fault for _, fault in turns]
    pairs = zip(turns, turns[1:], strict=False)
    return {
        "gaps": gaps,
        "blank": faults.count(_BLANK),
        "duplicate": faults.count(_DUPLICATE),
        "truncated": faults.count(_CUT),
        "illegal": sum(a + b not in _LEGAL for (a, _), (b, _) in pairs),
    }


def _repaired(rows: DataFrame) -> DataFrame:
    """Per conversation, in order within a partition: its summary (kind 0, with audit and report), then its repaired turns (kind 1)."""
    keyed = _keyed(rows)
    plan = decisions(keyed)
    texts = keyed.select("conv_id", F.lit(1).alias("part"), "known", "turn", "role", "digest", F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("roles", "array<string>"), ("audit", "string"), ("report", "array<bigint>"))), "text")
    schema = StructType([keyed.schema["conv_id"], *StructType.fromDDL("kind INT, position BIGINT, role STRING, text STRING, audit STRING, report ARRAY<BIGINT>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def lines() -> Iterator[tuple]:
            position, expected, roles = 0, None, []
            for name, part, known, turn, role, digest, kind, named, audit, report, text in _records(batches):
                if part == 0:
                    position, expected = 0, None
                    yield (name, 0, None, None, None, audit, report)
                elif part == 2:
                    for role in named:
                        yield (name, 1, position, role, "", None, None)
                        position += 1
                elif kind == 0:
                    expected, roles = (known, turn, role, digest), named
                elif expected == (known, turn, role, digest):
                    expected = None
                    for role in roles[:-1]:
                        yield (name, 1, position, role, "", None, None)
                        position += 1
                    yield (name, 1, position, roles[-1], text, None, None)
                    position += 1

        yield from _batches(lines(), to_arrow_schema(schema))

    return plan.union(texts).repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text) of every repaired conversation's turns."""
    return _repaired(rows).where("kind = 1").select("conv_id", "position", "role", "text")


def repair_reports(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``conversations`` (of ``rows`` without it): counts of faults, cost, audit and the hash of its repaired lines."""
    found = _repaired(rows)
    conv = found.schema["conv_id"]
    schema = StructType([conv, *StructType.fromDDL("audit STRING, report ARRAY<BIGINT>, repaired_sha256 STRING")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def hashed() -> Iterator[tuple]:
            head, digest = None, None
            for name, kind, position, role, text, audit, report in _records(batches):
                if kind == 0:
                    if head:
                        yield (*head, digest.hexdigest())
                    head, digest = (name, audit, report), hashlib.sha256()
                else:
                    digest.update((f"\n{role}:{text}" if position else f"{role}:{text}").encode())
            if head:
                yield (*head, digest.hexdigest())

        yield from _batches(hashed(), to_arrow_schema(schema))

    reports = found.mapInArrow(run, schema)
    every = (rows if conversations is None else conversations).select("conv_id").distinct().alias("c")
    empty = hashlib.sha256().hexdigest()
    return every.join(reports.alias("r"), F.expr("c.conv_id <=> r.conv_id"), "left").select(
        "c.conv_id",
        *(F.coalesce(F.col("r.report")[k], F.lit(0)).cast("bigint").alias(name) for k, name in enumerate(REPORT)),
        F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("r.repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
