"""Repair of conversation structure by weighted interval parsing in Chomsky normal form.

A conversation has to read as roles (s?(ua)+)? : an optional system turn, then user and assistant in turns. A turn may be kept (0), given the
role user or assistant (1) or deleted (2, the only way for blank and duplicate turns); an empty turn may be inserted anywhere (5); a truncated
turn that is not deleted costs 5 more. Of the cheapest edits the ASCII-least string of their initials (K, R, D, I) counts.

The grammar's nonterminals are <p,q>, "these turns lead from p to q", over the states nothing (0), system (S), user (U), assistant (A); its
binary rules are <p,q> -> <p,r> <r,q>, its terminals a turn with one edit, closed under insertions before and after. A cell of the chart holds
the least (cost, audit) of each nonterminal over a span. Cells are combined bottom-up by span length. As the nonterminals are pairs of
states, every split of a span gives the same cell, so one split a span is enough and spans of doubling lengths make the chart. (Of two audits
of one cell and cost none begins with the other, since both name the same turns and further insertions cost more: the order of audits
survives concatenation.)

On Spark: equal turns are counted before anything moves; turns are range-sorted, so that a conversation is a run of rows, in one partition or
more; a turn is a duplicate if its first place (an aggregate by role and text digest) is earlier; each task parses the part of a conversation
that it holds into one cell, and the few cells of a conversation are combined. Only what names turns goes that way; texts meet their edits in
order in a last pass, one row at a time. A conversation's audit is one string, so a task holds some bytes for each turn of one conversation.

Defined results: a null role or text counts as one space; turns come in order of turn (nulls first), then role, then text; repeated rows are
repeated turns; a role counts by its first character, a turn whose role is empty can't be kept; roles that the pattern doesn't know can only be
reroled or deleted; a null conv_id is a conversation; very long texts are read as they are; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.common import arrow_rows, cut, table

#: States of a conversation so far, and those in which it may end.
STATES, ENDS = "0SUA", "0A"
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: How an initial moves on: (before, after) pairs of states.
MOVES = {"s": ["0S"], "u": ["0U", "SU", "AU"], "a": ["UA"]}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
NEVER = (1 << 60, "")
WHITE = " \t\n\x0b\x0c\r"

#: Pairs of states that some turns connect, and for each of them the pairs of which it is made.
PAIRS = [p + q for p in STATES for q in STATES if p == q or q in "UA" or p + q == "0S"]
RULES = [[(PAIRS.index(p + r), PAIRS.index(r + q)) for r in STATES if p + r in PAIRS and r + q in PAIRS] for p, q in PAIRS]
Cell = tuple[tuple[int, str], ...]


def join(x: Cell, y: Cell) -> Cell:
    """The cell of two spans that follow each other: for each nonterminal the least of its rules."""
    out = []
    for rule in RULES:
        if len(rule) == 1:
            (i, j), = rule
            out.append((x[i][0] + y[j][0], x[i][1] + y[j][1]))
        else:
            cost = min(x[i][0] + y[j][0] for i, j in rule)
            out.append((cost, min(x[i][1] + y[j][1] for i, j in rule if x[i][0] + y[j][0] == cost)))
    return tuple(out)


def cell(ways: dict[str, tuple[int, str]]) -> Cell:
    return tuple(ways.get(p, NEVER) for p in PAIRS)


#: Insertions alone: none, one, or two in a row; more lead nowhere new.
INSERTIONS = cell({p: (0, "") if p[0] == p[1] else (INSERT * (1 if p in MOVES["u"] + MOVES["a"] else 2), "I" * (1 if p in MOVES["u"] + MOVES["a"] else 2)) for p in PAIRS if p != "0S"})


def terminal(symbol: str) -> Cell:
    """The cell of one turn: its initial (s, u, a, or x for others), in upper case if truncated; d if it must be deleted."""
    more = TRUNCATED if symbol.isupper() else 0
    ways = {s + s: (DELETE, "D") for s in STATES}
    if symbol != "d":
        ways |= {p: (RENAME + more, "R") for k in "ua" for p in MOVES[k]}
        ways |= {p: (more, "K") for p in MOVES.get(symbol.lower(), [])}
    return join(join(INSERTIONS, cell(ways)), INSERTIONS)


TERMINALS = {s: terminal(s) for s in "suaxSUAXd"}
#: Cells of short spans that a task remembers.
SHORT, REMEMBERED = 8, 100_000


def combine(cells: list[Cell], spans: list[str] | None = None, known: dict[str, Cell] | None = None) -> Cell:
    """The cell over all of the cells, bottom-up by span length. spans: what each stands for, to look short ones up in known."""
    while len(cells) > 1:
        above, wider = [], []
        for k in range(0, len(cells) - 1, 2):
            span = spans[k] + spans[k + 1] if spans else ""
            made = known.get(span) if span else None
            if made is None:
                made = join(cells[k], cells[k + 1])
                if span and len(known) < REMEMBERED:
                    known[span] = made
            above.append(made)
            wider.append(span if len(span) <= SHORT // 2 else "")
        if len(cells) % 2:
            above.append(cells[-1])
            wider.append(spans[-1] if spans else "")
        spans = wider if spans and all(wider[: len(above) // 2]) else None
        cells = above
    return cells[0] if cells else INSERTIONS


def best_of(whole: Cell) -> tuple[int, str]:
    """The least (cost, audit) with which a conversation may end."""
    return min(whole[PAIRS.index("0" + e)] for e in ENDS)


_numbers = [(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")]
PARTS = [("part", pa.int64()), *_numbers, ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
AUDITS = [("part", pa.int64()), ("audit", pa.string()), ("stats", pa.list_(pa.int64()))]
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def runs(rows: Iterator[tuple], key: int) -> Iterator[list[tuple]]:
    """Consecutive rows whose first `key` fields agree."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][:key] != row[:key]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def slices(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 2000:
            yield arrow_rows(held, schema)
            held = []
    yield arrow_rows(held, schema)


def parse_part(rows: list[tuple], known: dict[str, Cell]) -> tuple:
    """The record of consecutive turns (conv_id, part, idx, turn, copies, initial, blank, truncated, again) of one conversation."""
    symbols, blank, duplicate, truncated, illegal, turns = [], 0, 0, 0, 0, 0
    first = last = first_turn = last_turn = None
    for _, _, _, turn, copies, initial, is_blank, is_truncated, again in rows:
        if not copies:
            continue
        if is_blank or again:
            symbols.append("d" * copies)
            blank, duplicate = (blank + copies, duplicate) if is_blank else (blank, duplicate + copies)
        else:
            symbol = initial if initial in MOVES else "x"
            symbols.append((symbol.upper() if is_truncated else symbol) + "d" * (copies - 1))
            truncated, duplicate = truncated + bool(is_truncated), duplicate + copies - 1
        illegal += copies - 1 + (last is not None and last + initial not in LEGAL)
        if turn is not None:
            turns += turn != last_turn
            first_turn, last_turn = turn if first_turn is None else first_turn, turn
        first, last = initial if first is None else first, initial
    word = "".join(symbols)
    made = combine([TERMINALS[s] for s in word], list(word), known)
    return (*rows[0][:2], len(word), blank, duplicate, truncated, illegal, turns, first_turn, last_turn, first, last, [c for c, _ in made], [a for _, a in made])


def solve(parts: list[tuple]) -> Iterator[tuple]:
    """A conversation's record (part -1) with its numbers and audit, then each part's share of the audit."""
    sums = [0] * 4
    turns, first_turn, last_turn, last = 0, None, None, None
    for _, _, _, blank, duplicate, truncated, illegal, own, start, end, initial, final, _, _ in parts:
        sums = [a + b for a, b in zip(sums, (blank, duplicate, truncated, illegal), strict=True)]
        if initial is not None:
            sums[3] += last is not None and last + initial not in LEGAL
            last = final
        if start is not None:
            turns += own - (start == last_turn)
            first_turn, last_turn = start if first_turn is None else first_turn, end
    cost, audit = best_of(combine([tuple(zip(p[-2], p[-1], strict=True)) for p in parts if p[2]]))
    gaps = last_turn - first_turn + 1 - turns if turns else 0
    yield parts[0][0], -1, audit, [gaps, *sums, cost]
    at = 0
    for p in parts:
        start, left = at, p[2]
        while left:
            left -= audit[at] != "I"
            at += 1
        if p is parts[-1]:
            at = len(audit)
        yield p[0], p[1], audit[start:at], None


def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, None, audit, stats) for each conversation, then (conv_id, edit, role, text) for each turn that its repair leaves, from rows
    (conv_id, part, idx, copies, role, text or audit, stats) in order."""
    conv, share, at, state = None, "", 0, "0"

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(share) and share[at] == "I":
            state = "A" if state == "U" else "U"
            yield conv, "I", NAMES[state.lower()], ""
            at += 1

    for conv_id, part, idx, copies, role, text, stats in rows:
        if idx < 0:
            yield from inserted()
            conv, share, at = conv_id, text, 0
            if part < 0:
                share, state = "", "0"
                yield conv_id, None, text, stats
            continue
        for _ in range(copies):
            yield from inserted()
            edit = share[at]
            at += 1
            if edit != "D":
                state = "S" if edit == "K" and role[:1] == "s" else "A" if state == "U" else "U"
                yield conv, edit, role if edit == "K" else NAMES[state.lower()], text
    yield from inserted()


def repair(rows: DataFrame) -> DataFrame:
    """Turns and edits of rows(conv_id, turn, role, text, copies), a row being so many equal turns (0: none, the conversation counts):
    conv_id, part, idx, copies, role, text, stats, in order within a partition, a conversation's rows in one. For digests() and turns()."""
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    none = F.col("copies") == 0
    rows = rows.select(
        "conv_id", F.when(~none, F.col("turn")).cast("long").alias("turn"), *(F.when(none, "").otherwise(F.coalesce(c, F.lit(" "))).alias(c) for c in ("role", "text")), F.col("copies").cast("long").alias("copies")
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = ["conv_id", "turn", "role"]
    placed = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    turns = cut(placed.withColumns({"part": F.spark_partition_id().cast("long"), "idx": F.monotonically_increasing_id()}), "turns")

    bare = F.rtrim("text", F.lit(WHITE))
    named = turns.select(
        "conv_id", "part", "idx", "turn", "copies", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut_off"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )
    place = F.struct("part", "idx")
    earliest = named.where("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(place).alias("earliest"))
    marked = named.join(earliest, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    marked = marked.select("conv_id", "part", "idx", "turn", "copies", "initial", "blank", "cut_off", F.coalesce(place > F.col("earliest"), F.lit(False)).alias("again"))

    def arrow(fields: list) -> pa.Schema:
        return pa.schema([("conv_id", KINDS[kind]), *fields])

    parts_schema, audits_schema = arrow(PARTS), arrow(AUDITS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Cell] = {}
        yield from slices((parse_part(run, known) for run in runs(records(batches), 2)), parts_schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from slices((r for run in runs(records(batches), 1) for r in solve(run)), audits_schema)

    parts = marked.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "idx").mapInArrow(parse, from_arrow_schema(parts_schema))
    audits = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(settle, from_arrow_schema(audits_schema))
    named_edits = audits.select("conv_id", "part", F.lit(-1).cast("long").alias("idx"), F.lit(0).cast("long").alias("copies"), F.lit("").alias("role"), F.col("audit").alias("text"), "stats")
    both = named_edits.unionByName(turns.select("conv_id", "part", "idx", "copies", "role", "text", F.lit(None).cast("array<bigint>").alias("stats")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx")


#: Arrow kinds of conv_id.
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text, edit (K, R or I) of each turn that repair() leaves."""
    schema = pa.schema([("conv_id", KINDS[repaired.schema["conv_id"].dataType.simpleString()]), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed() -> Iterator[tuple]:
            position = 0
            for conv_id, edit, role, text in edited(records(batches)):
                if edit is None:
                    position = 0
                else:
                    yield conv_id, position, role, text, edit
                    position += 1

        yield from slices(placed(), schema)

    return repaired.mapInArrow(run, from_arrow_schema(schema))


def repair_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
    numbers = [(c, pa.int64()) for c in STATS]
    schema = pa.schema([("conv_id", KINDS[repaired.schema["conv_id"].dataType.simpleString()]), *numbers, ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            head, digest, between = None, None, ""
            for conv_id, edit, a, b in edited(records(batches)):
                if edit is None:
                    if head:
                        yield (*head, digest.hexdigest())
                    head, digest, between = (conv_id, *b, a), hashlib.sha256(), ""
                else:
                    digest.update(f"{between}{a}:{b}".encode("utf-8", "surrogatepass"))
                    between = "\n"
            if head:
                yield (*head, digest.hexdigest())

        yield from slices(hashed(), schema)

    return repaired.mapInArrow(run, from_arrow_schema(schema))


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with copies, damaged by crc32('conv_id:turn') modulo 20: 0 drops a turn, 1 empties its text, 2 takes its
    .!? out, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(repair(damage(table(spark, sf_dir, "conversations"))))


def _sql() -> str:
    """A recursive query that goes through the turns once, with the least (cost, audit, repaired text) of each state."""
    def step(state: str, cost: str, letter: str, text: str = "") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t{' || ' + text if text else ''}}}"

    line = lambda state, role: f"(CASE WHEN {state}.a IS NULL OR {state}.t = '' THEN '' ELSE chr(10) END) || {role} || ':'"
    never = "{'c': 999999999, 'a': '', 't': ''}"

    def turn(after: str, kept: str, new: str, before: str) -> str:
        ways = [step(after, "2", "D")]
        for s in before:
            ways.append(f"CASE WHEN sym = '{kept}' AND NOT must THEN {step(s, 'more', 'K', line(s, 'role') + ' || text')} ELSE {never} END")
            if new:
                full = line(s, f"'{new}'") + " || text"
                ways.append(f"CASE WHEN NOT must THEN {step(s, '1 + more', 'R', full)} ELSE {never} END")
        return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]

    user, helper = "'user'", "'assistant'"
    u = lambda s: step(s, "5", "I", line(s, user))
    a = lambda s: step(s, "5", "I", line(s, helper))
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, tab
), e AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE k <> 0
), f AS (
  SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    lead(substr(role, 1, 1)) OVER w AS following, substr(role, 1, 1) AS sym
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), g AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut_off FROM f
), h AS (
  SELECT *, blank OR seen > 1 AS must, CASE WHEN cut_off AND NOT blank AND seen = 1 THEN 5 ELSE 0 END AS more FROM g
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen > 1) AS duplicate,
    count(*) FILTER (more > 0) AS truncated, count(*) FILTER (following IS NOT NULL AND sym || following NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS size
  FROM h GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': '', 't': ''}} AS s0, {never} AS ss, {{'c': 5, 'a': 'I', 't': 'user:'}} AS su, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS sa FROM n
  UNION ALL
  SELECT conv_id, pos, s0, ss, least(su, {u('s0')}, {u('ss')}, {u('sa')}) AS su,
    least(sa, {a('su')}, {a('p.u0')}, {a('p.us')}) AS sa
  FROM (
    SELECT *, {{'u0': {u('s0')}, 'us': {u('ss')}}} AS p FROM (
      SELECT h.conv_id, h.pos, {turn('s0', '', '', '')} AS s0, {turn('ss', 's', '', ['s0'])} AS ss, {turn('su', 'u', 'user', ['s0', 'ss', 'sa'])} AS su, {turn('sa', 'a', 'assistant', ['su'])} AS sa
      FROM (SELECT conv_id, pos, s0 , ss, su, sa FROM walk) walk JOIN h ON h.conv_id IS NOT DISTINCT FROM walk.conv_id AND h.pos = walk.pos + 1
    )
  )
)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  coalesce(least(s0, sa).c, 0)::BIGINT AS cost, coalesce(least(s0, sa).a, '') AS audit, sha256(coalesce(least(s0, sa).t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM o.conv_id AND walk.pos = n.size
"""


OP11_SQL = _sql()
