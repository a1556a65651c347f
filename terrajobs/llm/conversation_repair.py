"""Repair of broken conversations at least cost, by bidirectional search of an edit lattice.

A node of the lattice is (rows read, state of the grammar of roles); an edge is one edit:
keep, change the role, delete a row, insert an empty turn. The grammar takes an optional
system turn and then pairs of a user and an assistant turn, or nothing. Two searches of
Dijkstra's kind run towards each other from the first and the last node. They end when their
heaps' tops together cost more than the best meeting, so every crossing of equal cost has been
seen. The forward nodes that lead to a crossing are marked; from the start the least letter
that some cheapest path goes on with is then taken again and again, over all crossings at
once, which gives the least of the concatenated audits exactly, also where one path's audit
begins with the whole of another's.

Spark finds the duplicates and sorts each conversation's rows. The search sees one byte a
row, and texts are read once more in order to write the repaired turns, one at a time: no
conversation's texts are held together anywhere.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrajobs.llm.common import released, small_batches

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3  # costs; the last is added for a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)  # states, by the turn written last
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_NEXT = (USER, USER, ASSISTANT, USER)  # what a changed or inserted turn is, by state
_BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_FROM = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}  # states in which a turn may be kept
_TRUNCATED, _GONE = 4, 8  # bits of a row's symbol beside its initial's state
_SPACE = r"\x20\x09-\x0D"


def _onward(v: int, symbols: bytes) -> list[tuple[str, int, int]]:
    """(letter, cost, node) of the edits possible at a node."""
    i, g = divmod(v, 4)
    out = [("I", INSERT, 4 * i + _NEXT[g])]
    if i < len(symbols):
        s, w = symbols[i], 4 * i + 4
        out.append(("D", DELETE, w + g))
        if not s & _GONE:
            more = UNFINISHED if s & _TRUNCATED else 0
            out.append(("R", REROLE + more, w + _NEXT[g]))
            if g in _FROM.get(s & 3, ()):
                out.append(("K", KEEP + more, w + (s & 3)))
    return out


def _backward(v: int, symbols: bytes) -> list[tuple[int, int]]:
    """(cost, node) of the edits that lead to a node."""
    i, g = divmod(v, 4)
    out = [(INSERT, 4 * i + h) for h in _BEFORE[g]]
    if i:
        s, w = symbols[i - 1], 4 * i - 4
        out.append((DELETE, w + g))
        if not s & _GONE:
            more = UNFINISHED if s & _TRUNCATED else 0
            out += [(REROLE + more, w + h) for h in _BEFORE[g]]
            if s & 3 == g:
                out += [(KEEP + more, w + h) for h in _FROM.get(g, ())]
    return out


def cheapest_edits(symbols: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows given as symbols: the state of the role's
    initial, 0 for others, with bits for truncated rows and for those that must go."""
    ends = (4 * len(symbols) + START, 4 * len(symbols) + ASSISTANT)
    size = 4 * len(symbols) + 4
    far = [array("q", [-1]) * size, array("q", [-1]) * size]  # least costs known, from the start and to the end
    settled = [bytearray(size), bytearray(size)]
    heaps: list[list[tuple[int, int]]] = [[(0, 0)], [(0, v) for v in ends]]
    far[0][0] = far[1][ends[0]] = far[1][ends[1]] = 0
    best = 0 if not symbols else -1
    while heaps[0] and heaps[1] and (best < 0 or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        d, v = heapq.heappop(heaps[side])
        if settled[side][v]:
            continue
        settled[side][v] = 1
        edges = _backward(v, symbols) if side else [e[1:] for e in _onward(v, symbols)]
        own, other = far[side], far[1 - side]
        for cost, w in edges:
            if own[w] < 0 or d + cost < own[w]:
                own[w] = d + cost
                heapq.heappush(heaps[side], (d + cost, w))
                if other[w] >= 0 and (best < 0 or own[w] + other[w] < best):
                    best = own[w] + other[w]
    # what still has to be paid; a cost that is not final yet is too high, and equals no sum below
    left, reached = far[1], [v for v in range(size) if settled[0][v]]
    crossings = [v for v in reached if left[v] == best - far[0][v] or any(0 <= left[w] == best - far[0][v] - cost for _, cost, w in _onward(v, symbols))]
    while crossings:
        v = crossings.pop()
        left[v] = best - far[0][v]
        for cost, u in _backward(v, symbols):
            if settled[0][u] and left[u] != best - far[0][u] and far[0][u] + cost == far[0][v]:
                left[u] = best - far[0][u]
                crossings.append(u)
    front, audit = {0}, []
    while not any(v in ends and left[v] == 0 for v in front):
        steps = [(letter, w) for v in front for letter, cost, w in _onward(v, symbols) if 0 <= left[w] == left[v] - cost]
        least = min(steps)[0]
        audit.append(least)
        front = {w for letter, w in steps if letter == least}
    return best, "".join(audit)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the crc32 of ``conv_id:turn``, modulo
    20: 0 drops the row, 1 empties its text, 2 takes away its ``.!?``, 3 repeats it (two
    copies), 4 makes its role ``user``. Nulls are one space, in the key too."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(shown(text_col), ".!?", "")).otherwise(shown(text_col))
    return conversations.filter(kind != 0).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(shown(role_col)).alias("role"),
        text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Null roles and texts as one space, and ``key``, the text's digest."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), copies.alias("copies"), F.unhex(F.md5(text)).alias("key"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation's rows in one partition and in order, its head (kind 0) first."""
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "key")


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Tally:
    """What is counted over one conversation's rows in order."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.symbols = conv, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, blank: bool, truncated: bool, known: bool, copies: int) -> None:
        initial = role[:1]
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1
        self.initial = initial
        state = _INITIALS.get(initial, 0)
        stays = not blank and not known
        self.symbols += bytes([state + (_GONE if not stays else _TRUNCATED if truncated else 0)])
        self.symbols += bytes([state + _GONE]) * (copies - 1)
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - stays
            self.truncated += stays and truncated

    def report(self) -> tuple:
        cost, audit = cheapest_edits(bytes(self.symbols))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, int(self.truncated), self.illegal, cost, audit


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row per conversation.

    Takes conv_id, turn, role, text and optionally ``copies``; a row of no copies is none,
    though its conversation is returned. Rows stand by turn (nulls first), then role, then
    the text's MD5. Each row's first fault counts: blank, duplicate (role and text seen before
    in the conversation) or truncated (the last character that is no white space is none of
    ``.!?``). ``illegal`` counts neighbours whose roles' initials are not su, ua or au, and
    ``gaps`` the numbers missing between the first and the last turn. ``audit`` has the
    initials of the cheapest edits (Keep, Rerole, Delete, Insert), the ASCII-least of equally
    cheap ones. Null roles and texts are one space; rows of a null conv_id are one
    conversation; an empty table gives an empty result; other columns are not read.
    """
    keyed = _keyed(small_batches(conversations))
    blank, ended = ~F.col("text").rlike(f"[^{_SPACE}]"), F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    light = keyed.filter("copies > 0").select("conv_id", "turn", "role", "key", "copies", blank.alias("blank"), (~ended).alias("unfinished"))
    rows = light.groupBy("conv_id", "turn", "role", "key").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("unfinished").alias("unfinished"))
    earliest = rows.groupBy("conv_id", "role", "key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")).filter("n > 1")
    earliest = earliest.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), F.col("first.turn").alias("first"), F.lit(True).alias("many"))
    same: Column = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    marked = rows.join(earliest, same, "left").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "blank", "unfinished", (F.col("many").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).alias("known"), "copies")
    heads = keyed.select("conv_id").distinct().selectExpr("conv_id", "0 as kind", "cast(null as long) as turn", "'' as role", "cast('' as binary) as key", "false as blank", "false as unfinished", "false as known", "0L as copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Tally | None = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(columns)], names=["conv_id", *_REPORT, "audit"])

        for batch in batches:
            done = []
            for conv, kind, turn, role, _, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if now is not None:
                        done.append(now.report())
                    now = _Tally(conv)
                else:
                    now.add(turn, role, *row)
            if done:
                yield out(done)
        if now is not None:
            yield out([now.report()])

    return _in_order(heads.unionByName(marked)).mapInArrow(released(run), "conv_id long, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str, str]]]]:
    """(report, its repaired turns (edit, role, text) one by one) of each conversation."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for head in rows:
        conv, _, _, _, _, _, *report, audit = head

        def turns(audit: str = audit) -> Iterator[tuple[str, str, str]]:
            state = START
            for edit in audit:
                role, text = "", ""
                if edit != "I":
                    _, _, _, role, _, text, *_ = next(rows)
                if edit == "D":
                    continue
                state = _INITIALS[role[:1]] if edit == "K" else _NEXT[state]
                yield edit, role if edit == "K" else _ROLES[state], text

        own = turns()
        yield (conv, *report, audit), own
        for _ in own:  # what the caller has left
            pass


def _with_audits(conversations: DataFrame, found: DataFrame) -> DataFrame:
    rows = _keyed(small_batches(conversations)).withColumn("copies", F.explode(F.expr("array_repeat(1L, cast(copies as int))")))
    empty = [F.lit(None).cast("long").alias(c) for c in _REPORT] + [F.lit(None).cast("string").alias("audit")]
    rows = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "text", *empty)
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").cast("binary").alias("key"), F.lit("").alias("text"), *_REPORT, "audit")
    return _in_order(heads.unionByName(rows))


def repaired(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns after the repair that ``audits`` found,
    numbered from 0. Deleted rows are left out, inserted ones have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for report, turns in _walk(batches):
            held: list[tuple] = []
            for n, turn in enumerate(turns):
                held.append((report[0], n, *turn))
                if len(held) == 1000:
                    yield out(held)
                    held = []
            if held:
                yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["conv_id", "position", "edit", "role", "text"])

    return _with_audits(conversations, audits(conversations) if found is None else found).mapInArrow(released(run), "conv_id long, position long, edit string, role string, text string")


def digests(conversations: DataFrame) -> DataFrame:
    """``audits`` of the damaged conversations with the digest of their repaired turns; every
    conversation is returned, also one that lost all its rows."""
    broken = damaged(conversations)
    whole = broken.unionByName(conversations.select(F.col("conv_id").cast("long")).distinct().selectExpr("conv_id", "cast(null as long) as turn", "' ' as role", "' ' as text", "0L as copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for report, turns in _walk(batches):
            digest = hashlib.sha256()
            for n, (_, role, text) in enumerate(turns):
                digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            held.append((*report, digest.hexdigest()))
            if len(held) == 500:
                yield out(held)
                held = []
        if held:
            yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        columns = enumerate(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 6 else pa.int64()) for k, c in columns], names=["conv_id", *_REPORT, "audit", "repaired_sha256"])

    return _with_audits(whole, audits(whole)).mapInArrow(released(run), "conv_id long, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string")


def _oracle() -> str:
    """A recursion from each conversation's last row to its first over the grammar's four states.
    A state's value is cost (nine digits), audit, chr(1) and the lines still to come, so the
    least string has the least cost and then the least audit."""
    at = lambda v: f"instr({v}, chr(1))"
    step = lambda cost, letter, line, v: f"lpad((substr({v}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({v}, 10, {at(v)} - 10) || chr(1) || {line} || substr({v}, {at(v)} + 1)"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    own = "chr(10) || role || ':' || text"
    keep = lambda pairs: "CASE " + " ".join(f"WHEN NOT gone AND initial = '{c}' THEN {step('more', 'K', own, f'q{g}')}" for c, g in pairs) + " END"
    rerole = lambda line, g: f"CASE WHEN NOT gone THEN {step('3 + more', 'R', f'{line} || text', f'q{g}')} END"
    read = {0: (user, 2, [("s", 1), ("u", 2)]), 1: (user, 2, [("u", 2)]), 2: (assistant, 3, [("a", 3)]), 3: (user, 2, [("u", 2)])}
    steps = ", ".join(f"least({step(4, 'D', chr(39) * 2, f'q{g}')}, {rerole(line, to)}, {keep(pairs)}) AS p{g}" for g, (line, to, pairs) in read.items())
    paired = f"*, least(p2, {step(3, 'I', assistant, 'p3')}) AS q2, least(p3, {step(3, 'I', user, 'p2')}) AS q3"
    closed = f"least(p0, {step(3, 'I', user, 'q2')}) AS q0, least(p1, {step(3, 'I', user, 'q2')}) AS q1, q2, q3"
    end = "lpad('0', 9, '0') || chr(1)"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
shown AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ascii(s)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM shown WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, left(role, 1) AS initial,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS unfinished
  FROM broken),
told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS known, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed),
judged AS (
  SELECT *, blank OR known AS gone, CASE WHEN unfinished THEN 3 ELSE 0 END AS more FROM told),
report AS (
  SELECT c.conv_id, count(j.i) AS n, coalesce(max(j.turn) - min(j.turn) + 1 - count(DISTINCT j.turn), 0)::BIGINT AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (known AND NOT blank) AS duplicate, count(*) FILTER (unfinished AND NOT gone) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
best AS (
  SELECT conv_id, n AS i, {step(3, 'I', user, 'q2')} AS q1, q2, q3, q0
  FROM (SELECT *, {step(3, 'I', assistant, 'q3')} AS q2 FROM (SELECT conv_id, n, {end} AS q0, {end} AS q3 FROM report))
  UNION ALL
  SELECT conv_id, i, q1, q2, q3, q0 FROM (SELECT conv_id, i, {closed} FROM (SELECT {paired} FROM (SELECT b.conv_id, b.i - 1 AS i, {steps}
    FROM best b JOIN judged r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i))))
SELECT r.conv_id, gaps, blank, duplicate, truncated, illegal, substr(q0, 1, 9)::BIGINT AS cost, substr(q0, 10, {at('q0')} - 10) AS audit, sha256(substr(q0, {at('q0')} + 2)) AS repaired_sha256
FROM report r JOIN best b ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.i = 0
"""


ORACLE = _oracle()
