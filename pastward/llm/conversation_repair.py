"""Cheapest repair of the role structure of conversations, by block tables over normalised cost vectors.

A repaired conversation has role initials ``(s?(ua)+)?``. Kept, rerolled, deleted and inserted rows cost fixed numbers, so what the rest of
a conversation costs is a vector with one number for each of four states: nothing written yet, after a system row, after a user
row, after an assistant row. Inserts and deletes bound the differences inside a vector, so less its last number there are only a
few vectors, and a row is one of nine symbols. Tables state for each vector and each block of ``BLOCK`` symbols, in reverse, the
vector before the block: conversations are taken from the end by one look-up per block, and blocks are then expanded backward into the
vectors of their rows. From the vectors the edits are read off from the start, at each place the least letter that stays on a
cheapest way, which is the ASCII-least audit.

Rows are sorted over the cluster by conversation and turn, so a conversation of any size spreads over partitions. Each partition states
what its first and last conversation do to every vector; these two rows per partition give the vectors at the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.llm.work import Work
from pastward.operators.skew import joined_to_groups

# Costs of the edits, and of leaving a truncated row in.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK = 4
STATES = range(4)  # nothing yet, after system, after user, after assistant
AFTER = (2, 2, 3, 2)  # the state after a user or assistant row, which of the two fits each state
ROLES = ("s", "u", "a")
SYMBOLS = 9  # a row to be deleted; then, by initial (s, u, a, other), a sound row and a truncated one
SPACE = " \t\n\x0b\x0c\r"


def _kept(state: int, symbol: int) -> int | None:
    """The state after keeping the row in this state, if it may stand there."""
    role = (symbol - 1) // 2
    if role == 0:
        return 1 if state == 0 else None
    return AFTER[state] if symbol and role in (1, 2) and AFTER[state] == role + 1 else None


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in STATES:
        costs = [min(costs[q], INSERT + costs[AFTER[q]]) for q in STATES]
    return tuple(costs)


def _before(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from those after it."""
    out = []
    for q in STATES:
        ways = [DELETE + costs[q]]
        if symbol:
            more = TRUNCATED * ((symbol - 1) % 2)
            ways.append(REROLE + more + costs[AFTER[q]])
            if (to := _kept(q, symbol)) is not None:
                ways.append(KEEP + more + costs[to])
        out.append(min(ways))
    return _with_inserts(out)


END = _with_inserts([0, 10**6, 10**6, 0])


class Tables:
    """Vectors as numbers (0 is the vector at the end), what rows and blocks make of them, and the edits they stand for."""

    def __init__(self) -> None:
        vectors, known = [END], {END: 0}
        self.row: list[int] = []  # vector * SYMBOLS + symbol -> vector before
        self.edits: list[list[tuple[str, int, int]]] = []  # the same -> for each state: letters, next state, cost
        for vector in vectors:
            for symbol in range(SYMBOLS):
                before = _before(symbol, vector)
                normal = tuple(x - before[3] for x in before)
                if normal not in known:
                    known[normal] = len(vectors)
                    vectors.append(normal)
                self.row.append(known[normal])
                self.edits.append([self._edit(q, symbol, vector, before) for q in STATES])
        self.vectors = vectors
        self.blocks = SYMBOLS**BLOCK
        self.block: list[int] = []  # vector * blocks + code -> vector before the block
        for v in range(len(vectors)):
            for symbols in product(range(SYMBOLS), repeat=BLOCK):
                at = v
                for s in reversed(symbols):
                    at = self.row[at * SYMBOLS + s]
                self.block.append(at)

    @staticmethod
    def _edit(state: int, symbol: int, after: tuple[int, ...], before: tuple[int, ...]) -> tuple[str, int, int]:
        letters, start, more = "", state, TRUNCATED * ((symbol - 1) % 2)
        while True:
            to = _kept(state, symbol)
            if DELETE + after[state] == before[state]:
                return letters + "D", state, before[start] - after[state]
            if INSERT + before[AFTER[state]] == before[state]:
                letters, state = letters + "I", AFTER[state]
            elif to is not None and KEEP + more + after[to] == before[state]:
                return letters + "K", to, before[start] - after[to]
            else:
                return letters + "R", AFTER[state], before[start] - after[AFTER[state]]

    def expanded(self, symbols: bytes, last: int) -> tuple[list[int], int]:
        """The vector after each row, and the one before the first, from the vector after the last."""
        at, i, ends = last, len(symbols), []
        while i >= BLOCK:
            i -= BLOCK
            ends.append(at)
            code = 0
            for s in symbols[i : i + BLOCK]:
                code = code * SYMBOLS + s
            at = self.block[at * self.blocks + code]
        after = [0] * len(symbols)
        for low, v in [(i + BLOCK * (len(ends) - 1 - k), end) for k, end in enumerate(ends)]:
            for j in range(low + BLOCK - 1, low - 1, -1):
                after[j] = v
                v = self.row[v * SYMBOLS + symbols[j]]
        for j in range(i - 1, -1, -1):
            after[j] = at
            at = self.row[at * SYMBOLS + symbols[j]]
        return after, at


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


class _Trace:
    """Reads the edits of one conversation off its vectors, row by row."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.state, self.cost, self.audit = conv_id, 0, 0, []
        self.digest, self.lines, self.faults, self.illegal, self.initial = hashlib.sha256(), 0, [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0

    def _write(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        return role, text

    def _inserted(self, state: int) -> str:
        return "user" if AFTER[state] == 2 else "assistant"

    def row(self, turn, role: str, text: str, symbol: int, fault: int, copies: int, vector: int) -> Iterator[tuple[str, str | None, str | None]]:
        """Takes a row and its copies; yields edits as (letter, role, text), deletions with the row deleted."""
        initial = role[:1]
        pairs = [] if self.initial is None else [self.initial + initial]
        self.illegal += sum(p not in ("su", "ua", "au") for p in pairs) + copies - 1
        self.initial = initial
        self.faults[fault] += 1
        self.faults[1 if fault == 1 else 2] += copies - 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        letters, state, cost = tables().edits[vector * SYMBOLS + symbol][self.state]
        now = self.state
        for letter in letters:
            if letter == "D":
                yield letter, role, text
            elif letter == "I":
                yield letter, *self._write(self._inserted(now), "")
                now = AFTER[now]
            else:
                yield letter, *self._write(role if letter == "K" else self._inserted(now), text)
        for _ in range(copies - 1):
            yield "D", role, text
        self.audit.append(letters + "D" * (copies - 1))
        self.state, self.cost = state, self.cost + cost + DELETE * (copies - 1)

    def end(self) -> Iterator[tuple[str, str, str]]:
        while END[self.state]:
            yield "I", *self._write(self._inserted(self.state), "")
            self.audit.append("I")
            self.state, self.cost = AFTER[self.state], self.cost + INSERT

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _found(conv_type: str) -> str:
    return f"conv_id {conv_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _edited(conv_type: str) -> str:
    return f"conv_id {conv_type}, number bigint, edit string, role string, text string"


def _symbols(rows: DataFrame, work: Work) -> DataFrame:
    """Distinct rows with ``copies``, their first ``fault`` (1 blank, 2 duplicate, 3 truncated, 0 none) and their symbol."""
    texts = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    once = work.put(texts.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")))
    parts = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull().cast("string"), F.sha2("role", 256), F.sha2("text", 256)]
    keyed = once.withColumn("same", F.concat_ws(":", *parts))
    counted = keyed.groupBy("same").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("first_is_null"))
    groups = work.put(counted.where("n > 1"))
    held = joined_to_groups(keyed, groups, ["same"], "n")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    again = F.coalesce(F.when(F.col("first_is_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn")), F.lit(False))
    fault = F.when(bare == "", 1).when(again, 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    held = held.withColumn("fault", fault).withColumn("symbol", F.when(F.col("fault").isin(1, 2), 0).otherwise(1 + 2 * place + (F.col("fault") == 3).cast("int")))
    return held.select("conv_id", "turn", "role", "text", "copies", "fault", "symbol")


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rows of the partition's first and last conversation make of each vector."""
    table = tables()
    part, first, now, symbols, kept = None, True, None, bytearray(), []

    def close() -> None:
        kept.append((now, part, [table.expanded(bytes(symbols), v)[1] for v in range(len(table.vectors))]))

    schema = None
    for rows in batches:
        schema = rows.schema.field("conv_id").type
        flags, of = rows.column("symbol").to_pylist(), rows.column("conv_id").to_pylist()
        for conv_id, group in groupby(range(len(of)), of.__getitem__):
            if part is None:
                part, now = rows.column("part")[0].as_py(), conv_id
            elif conv_id != now:
                if first:
                    close()
                first, now = False, conv_id
                symbols.clear()
            symbols += bytes(flags[k] for k in group)
    if part is not None:
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], schema), pa.array([k[1] for k in kept], pa.int32()), pa.array([k[2] for k in kept], pa.list_(pa.int32()))], ["conv_id", "part", "to"]
        )


def _cuts(maps: list) -> dict[tuple, int]:
    """The vector after the last row that a partition has of a conversation, for conversations of several partitions."""
    out: dict[tuple, int] = {}
    order = sorted(maps, key=lambda r: (r["conv_id"] is None, *((r["conv_id"],) if r["conv_id"] is not None else ()), r["part"]))
    for conv_id, pieces in groupby(order, lambda r: r["conv_id"]):
        pieces, at = list(pieces), 0
        if len(pieces) > 1:
            for piece in reversed(pieces):
                out[conv_id, piece["part"]] = at
                at = piece["to"][at]
    return out


COLUMNS = ("turn", "role", "text", "symbol", "fault", "copies")


def _rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for rows in batches:
        yield from zip(*(rows.column(n).to_pylist() for n in names))


def _pieces(cuts: dict[tuple, int]):
    """Rows of conversations that several partitions share, each with its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.Schema] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for rows in batches:
                if not kinds:
                    own = [rows.schema.field(n) for n in ("conv_id", "part", *COLUMNS)]
                    kinds.append(pa.schema([*own, ("number", pa.int64()), ("vector", pa.int32())]))
                yield rows

        for (conv_id, part), group in groupby(_rows_of(typed(), "conv_id", "part", *COLUMNS), lambda r: r[:2]):
            if (conv_id, part) in cuts:
                rows = list(group)
                after, _ = tables().expanded(bytes(r[5] for r in rows), cuts[conv_id, part])
                out = [(*r, number, v) for number, (r, v) in enumerate(zip(rows, after))]
                for low in range(0, len(out), 4096):
                    yield _written(out[low : low + 4096], kinds[0])

    return run


def _written(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema.names)


def _traced(cuts: dict[tuple, int] | None, edits: bool):
    """Summaries, or edits, of whole conversations that stream by in order; with ``cuts`` those it names are left out and vectors found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, table = None, [], tables()
        long, text = pa.int64(), pa.string()
        if edits:
            own = [("number", long), ("edit", text), ("role", text), ("text", text)]
        else:
            own = [*((n, long) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", text), ("repaired_sha256", text)]

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for rows in batches:
                kind = kind or pa.schema([("conv_id", rows.schema.field("conv_id").type), *own])
                yield rows

        names = ("conv_id", "part", *COLUMNS, *(() if cuts is not None else ("vector",)))
        for conv_id, group in groupby(_rows_of(typed(), *names), lambda r: r[0]):
            if cuts is not None:
                rows = list(group)
                if (conv_id, rows[0][1]) in cuts:
                    continue
                after, _ = table.expanded(bytes(r[5] for r in rows), 0)
                group = ((*r, v) for r, v in zip(rows, after))
            trace, number = _Trace(conv_id), 0

            def steps():
                for r in group:
                    yield from trace.row(*r[2:])
                yield from trace.end()

            for step in steps():
                if edits:
                    done.append((conv_id, number, *step))
                    number += 1
                    if len(done) >= 4096:
                        yield _written(done, kind)
                        done.clear()
            if not edits:
                done.append(trace.summary())
                if len(done) >= 4096:
                    yield _written(done, kind)
                    done.clear()
        if done:
            yield _written(done, kind)

    return run


def _run(rows: DataFrame, edits: bool) -> DataFrame:
    work = Work(rows.sparkSession)
    conv_type = dict(rows.dtypes)["conv_id"]
    order = ["conv_id", "turn", "role", "text"]
    if rows.sparkSession.sparkContext.getCheckpointDir() is None:
        rows.sparkSession.sparkContext.setCheckpointDir(work.root)
    held = _symbols(rows, work).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    symbols = held.select("conv_id", "part", "symbol")
    # two rows per partition at most
    cuts = _cuts(symbols.mapInArrow(_maps, f"conv_id {conv_type}, part int, to array<int>").collect())
    shape = _edited(conv_type) if edits else _found(conv_type)
    whole = held.mapInArrow(_traced(cuts, edits), shape)
    if not cuts:
        return whole
    kinds = f"conv_id {conv_type}, part int, turn {dict(rows.dtypes)['turn']}, role string, text string, symbol int, fault int, copies bigint, number bigint, vector int"
    pieces = held.mapInArrow(_pieces(cuts), kinds).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", "number")
    return whole.unionByName(pieces.mapInArrow(_traced(None, edits), shape))


def audited(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): its faults, its cheapest repair's cost and letters, and a digest.

    Rows are taken by turn (nulls first), then role and text. A row's first fault counts: ``blank`` (nothing but white space), ``duplicate``
    (role and text seen earlier) or ``truncated`` (its last other character is none of ``.!?``). ``gaps`` are the turns missing between the least and
    the largest, nulls ignored; ``illegal`` counts neighbours whose role initials are not su, ua or au. Letters are K(eep), R(erole to user or
    assistant), D(elete, required for blank rows and duplicates) and I(nsert an empty user or assistant row); of equally cheap repairs the
    ASCII-least is taken. The digest is the SHA-256 of the repaired ``role:text`` lines.

    Null roles and texts are one space. Null conversations are one conversation. Repeated rows count as often as they occur; they
    collapse before they are sorted. An empty table gives an empty table; other columns are not read. A conversation of any number of rows is
    spread over partitions; only its digest and audit, which are sequential, stream through one task, row by row.
    """
    return _run(rows, False)


def repaired(rows: DataFrame) -> DataFrame:
    """The edits of the cheapest repair, in order: conv_id, number, edit (K, R, D, I), role and text. Without the D rows it is the repaired table.

    Deleted rows show what was deleted, the others what is written. Otherwise as :func:`audited`.
    """
    return _run(rows, True)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` as the query wants them: the CRC-32 of ``conv_id:turn`` (null: one space) modulo 20 drops a row (0), empties its text (1), takes its
    ``.!?`` away (2), repeats it (3) or makes its role user (4)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    code = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    hurt = rows.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(code == 0, F.array().cast("array<int>")).when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return hurt.drop("copy")


def with_all(found: DataFrame, rows: DataFrame) -> DataFrame:
    """:func:`audited` with every conversation of ``rows``; those it does not have get zeros, an empty audit and the empty text's digest."""
    ids = rows.select(F.col("conv_id").alias("of_id")).distinct()
    joined = ids.join(found, ids["of_id"].eqNullSafe(found["conv_id"]), "left")

    def value(name: str, kind: str) -> Column:
        none = F.lit(0).cast("long") if kind == "bigint" else F.sha2(F.lit(b""), 256) if name == "repaired_sha256" else F.lit("")
        return F.coalesce(found[name], none).alias(name)

    return joined.select(F.col("of_id").alias("conv_id"), *[value(n, k) for n, k in found.dtypes if n != "conv_id"])


# The repair in SQL, one row at a time: cost vectors from the end (states: nothing yet, after system, user, assistant), then letters from the start.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM conversations, crc),
hurt AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS past FROM numbered),
rows AS (
  SELECT *, left(role, 1) AS x, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         past IS NOT NULL AND left(past, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen),
costs AS (
  SELECT DISTINCT conv_id, n AS i, [0, 4, 2, 0] AS g FROM rows
  UNION ALL
  SELECT conv_id, i, [least(b0, 2 + hu), least(bs, 2 + hu), hu, least(ba, 2 + bu)]
  FROM (
    SELECT *, least(bu, 2 + ba) AS hu
    FROM (
      SELECT c.conv_id, c.i - 1 AS i,
             least(3 + g[1], CASE WHEN fault NOT IN (1, 2) THEN least(2 + t + g[3], CASE x WHEN 's' THEN t + g[2] WHEN 'u' THEN t + g[3] END) END) AS b0,
             least(3 + g[2], CASE WHEN fault NOT IN (1, 2) THEN least(2 + t + g[3], CASE x WHEN 'u' THEN t + g[3] END) END) AS bs,
             least(3 + g[3], CASE WHEN fault NOT IN (1, 2) THEN least(2 + t + g[4], CASE x WHEN 'a' THEN t + g[4] END) END) AS bu,
             least(3 + g[4], CASE WHEN fault NOT IN (1, 2) THEN least(2 + t + g[3], CASE x WHEN 'u' THEN t + g[3] END) END) AS ba
      FROM costs c JOIN (SELECT *, (fault = 3)::INTEGER AS t FROM rows) r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.i = r.i))),
ways AS (
  SELECT h.conv_id, h.i, h.g AS h, a.g, r.role, r.text, r.x, (r.fault = 3)::INTEGER AS t, r.fault IN (1, 2) AS forced
  FROM costs h LEFT JOIN costs a ON a.conv_id IS NOT DISTINCT FROM h.conv_id AND a.i = h.i + 1 LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM h.conv_id AND r.i = h.i + 1),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines, h[1] AS cost FROM ways WHERE i = 0
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE later END, audit || edit,
         CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                   ELSE list_append(lines, CASE later WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'I' THEN '' ELSE text END) END, cost
  FROM (
    SELECT *, CASE WHEN g IS NOT NULL AND 3 + g[q] = h[q] THEN 'D' WHEN 2 + h[later] = h[q] THEN 'I'
                   WHEN g IS NOT NULL AND kept IS NOT NULL AND t + g[kept] = h[q] THEN 'K' WHEN g IS NOT NULL THEN 'R' END AS edit
    FROM (
      SELECT *, CASE WHEN forced THEN NULL WHEN x = 's' AND q = 1 THEN 2 WHEN x = 'u' AND later = 3 THEN 3 WHEN x = 'a' AND later = 4 THEN 4 END AS kept
      FROM (SELECT w.*, v.h, v.g, v.role, v.text, v.x, v.t, v.forced, CASE q WHEN 3 THEN 4 ELSE 3 END AS later
            FROM walk w JOIN ways v ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND v.i = w.i)))
  WHERE edit IS NOT NULL),
ended AS (SELECT w.* FROM walk w JOIN ways v ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND v.i = w.i WHERE v.g IS NULL AND v.h[q] = 0),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
