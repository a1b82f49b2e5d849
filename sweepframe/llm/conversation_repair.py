"""Operator 12: repair of a conversation's structure at the least cost, by depth-first branch and bound.

A conversation's rows are taken in order; each is kept, given another role or deleted, and turns may be inserted, so that the initials of the roles become
nothing, or an optional system turn and then user and assistant in turn. The search works on chunks of a conversation: from each state that a chunk
may be entered with (nothing yet, system, user or assistant last) it finds the cheapest edits to each state it may be left with, the least string of edits'
initials among equals. It keeps an explicit stack, bounds the rest from below by its least cost from each row and state, holds the best solution so far as
(cost, audit), and a table of the best (cost, audit) met at each (row, state), which ends every worse prefix; it stops when the stack is empty, so
the optimum is proved. Two prefixes of equal cost at one (row, state) are never one the beginning of the other, as only insertions could tell them apart in
length and these cost, so the lesser prefix stays the lesser whatever follows, and chunks can be joined in the same way.

Rows are sorted by ranges of (conversation, turn, role, text), so a conversation of any length is spread over tasks. One that lies within a chunk is
settled where it is read. Of the others the chunks' tables meet, some hundred bytes and the audits each, and the chosen edits go back to the chunks;
their repaired texts are then hashed in order as they stream by, as a digest of a whole conversation has to be.

Defined results: a null conversation is one of its own; a null turn comes first and counts for no gap; null roles and texts are one space. Rows of one turn
are taken by role and text; equal ones are duplicates of the first. An empty role has no initial: it can't be kept and stands in no legal pair. Texts and
conversations of any length are taken whole; an empty table gives an empty result; columns other than conv_id, turn, role and text, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sweepframe.llm.common import written

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Rows and bytes of text after which a chunk ends.
CHUNK_ROWS, CHUNK_BYTES = 2_000, 4 << 20
#: The states by the role of the last turn so far.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, where a turn with this initial leads.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: From each state, the role that a changed or inserted turn gets.
ROLE = ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLANK = re.compile(r"[^\x20\x09-\x0D]")


# --------------------------------------------------------------------------------------------------------------- the search


def steps(initial: str, fault: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, letters in order."""
    out = [("D", DELETE, state)]
    if fault not in "bd":
        extra = CUT if fault == "t" else 0
        if initial in NEXT[state]:
            out.append(("K", extra, NEXT[state][initial]))
        out.append(("R", REROLE + extra, NEXT[state][ROLE[state][0]]))
    return out


def bounds(initials: list[str], faults: str) -> list[list[int]]:
    """For each row and state, the least cost of the rest of the rows, whatever state they end in."""
    low = [[0] * 4 for _ in range(len(faults) + 1)]
    for i in range(len(faults) - 1, -1, -1):
        own = [min(c + low[i + 1][t] for _, c, t in steps(initials[i], faults[i], s)) for s in range(4)]
        for _ in range(2):  # an insertion, or two
            own = [min(own[s], INSERT + own[NEXT[s][ROLE[s][0]]]) for s in range(4)]
        low[i] = own
    return low


def cheapest(initials: list[str], faults: str, entry: int, low: list[list[int]] | None = None) -> list[tuple[int, str] | None]:
    """The least (cost, audit) from the entry state to each state, None where no edits lead there."""
    n = len(faults)
    low = bounds(initials, faults) if low is None else low
    best: list[tuple[int, str] | None] = [None] * 4
    for goal in range(4):
        met: dict[tuple[int, int], tuple[int, str]] = {}
        incumbent: tuple[int, str] | None = None
        stack = [(0, entry, 0, "")]
        while stack:
            i, state, cost, audit = stack.pop()
            if incumbent is not None:
                least = cost + low[i][state]
                if least > incumbent[0] or least == incumbent[0] and audit > incumbent[1][: len(audit)]:
                    continue
            known = met.get((i, state))
            if known is not None and known <= (cost, audit):
                continue
            met[i, state] = (cost, audit)
            if i == n and state == goal and (incumbent is None or (cost, audit) < incumbent):
                incumbent = (cost, audit)
            ways = [(i + 1, t, cost + c, letter) for letter, c, t in steps(initials[i], faults[i], state)] if i < n else []
            ways.append((i, NEXT[state][ROLE[state][0]], cost + INSERT, "I"))
            # The most promising way is looked at first: it goes on the stack last.
            ways.sort(key=lambda w: (w[2] + low[w[0]][w[1]], w[3]), reverse=True)
            stack += [(k, t, c, audit + letter) for k, t, c, letter in ways]
        best[goal] = incumbent
    return best


def repaired(roles: list[str], texts: list[str], entry: int, audit: str) -> tuple[list[str], int]:
    """The turns that an audit leaves, as role:text, and the state after them."""
    out, i, state = [], 0, entry
    for letter in audit:
        if letter in "IR":
            out.append(f"{ROLE[state]}:{'' if letter == 'I' else texts[i]}")
            state = NEXT[state][ROLE[state][0]]
        elif letter == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = NEXT[state][roles[i][0]]
        i += letter != "I"
    return out, state


# ------------------------------------------------------------------------------------------------------------------- chunks


class Chunk:
    """Successive rows of one conversation and what its neighbours need to know of them."""

    def __init__(self):
        self.roles, self.texts, self.faults, self.bytes = [], [], [], 0
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if not (last := BLANK.findall(text[-64:]) or BLANK.findall(text)):
            fault = "b"
        else:
            fault = "d" if again else "." if last[-1] in ".!?" else "t"
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.bytes += len(text)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def illegal(self) -> int:
        return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(self.roles[:-1], self.roles[1:], strict=True))

    def ways(self, entries: tuple[int, ...]) -> list[list[tuple[int, str] | None]]:
        initials, faults = [r[:1] for r in self.roles], "".join(self.faults)
        low = bounds(initials, faults)
        return [cheapest(initials, faults, s, low) if s in entries else [None] * 4 for s in range(4)]

    def counts(self) -> list[int]:
        return [self.faults.count(k) for k in "bdt"]


def settled(chunk: Chunk) -> dict:
    """The result of a conversation that is one chunk."""
    ways = chunk.ways((NOTHING,))[NOTHING]
    cost, audit = min(w for w in (ways[NOTHING], ways[ASSISTANT]) if w is not None)
    gaps = chunk.last_turn - chunk.first_turn + 1 - chunk.turns if chunk.turns else 0
    text = "\n".join(repaired(chunk.roles, chunk.texts, NOTHING, audit)[0])
    blank, duplicate, truncated = chunk.counts()
    return {"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": chunk.illegal(), "cost": cost, "audit": audit, "repaired_sha256": digest(text)}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class Best:
    """A way through the chunks so far: the last chunk's audit and state at its entry, and the way before it."""

    __slots__ = ("cost", "audit", "entry", "before")

    def __init__(self, cost: int, audit: str, entry: int, before: Best | None):
        self.cost, self.audit, self.entry, self.before = cost, audit, entry, before

    def less(self, other: Best) -> bool:
        """True if (cost, audit) is less; only the chunks since both were one way are compared."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, mine, theirs = self, other, [], []
        while a is not b and a is not None:
            mine.append(a.audit)
            theirs.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def onward(ways: list[Best | None], table: list[list[tuple[int, str] | None]]) -> list[Best | None]:
    """The best way to each state after one more chunk."""
    out: list[Best | None] = [None] * 4
    for entry, way in enumerate(ways):
        for exit_, found in enumerate(table[entry]):
            if way is not None and found is not None:
                new = Best(way.cost + found[0], found[1], entry, way)
                if out[exit_] is None or new.less(out[exit_]):
                    out[exit_] = new
    return out


# ------------------------------------------------------------------------------------------------------------ conversations


def at(turn: str = "turn") -> Column:
    """Turns in order, nulls first."""
    return F.struct(F.col(turn).isNotNull().alias("some"), F.col(turn).alias("turn"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that the CRC-32 of `conv_id:turn` deals out; nulls of role and text are one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "k")
    return rows.withColumn("k", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k")


def with_firsts(rows: DataFrame, hot: int = 1_000, most: int = 1_000_000) -> DataFrame:
    """rows and, where their conversation has one of equal role and text in another turn, the first such turn as `first` (a struct as at() gives it).

    Texts are compared by MD5. Only what is found in several turns is joined back: keys of `hot` rows or more by broadcast (more rows if these were over `most` keys), the others by shuffle.
    """
    rows = rows.withColumn("digest", F.md5("text"))
    own = rows.groupBy("conv_id", "role", "digest").agg(F.min(at()).alias("first"), F.max(at()).alias("last"), F.count("*").alias("n")).where("first <> last")
    own = written(own.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first", "n"), "repeated")
    n, total = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    if n <= most:
        return rows.join(F.broadcast(own.drop("n")), same, "left").drop("c", "r", "d", "digest")
    hot = max(hot, -(-total // most))
    rows = rows.join(F.broadcast(own.where(F.col("n") >= hot).drop("n").withColumnRenamed("first", "often")), same, "left").drop("c", "r", "d")
    rows = rows.join(own.where(F.col("n") < hot).drop("n"), same & F.col("often").isNull(), "left")
    return rows.withColumn("first", F.coalesce("often", "first")).drop("c", "r", "d", "digest", "often")


def repair(conversations: DataFrame) -> DataFrame:
    """For each conv_id of rows (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of the repaired turns."""
    found = repair_turns(conversations)
    zero = {k: F.coalesce(k, F.lit(0)).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(digest(""))).alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repair() of the rows after damage, with every conv_id of the rows before it."""
    found = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("c")).distinct()
    return every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("c").alias("conv_id"), *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(digest(""))).alias("repaired_sha256"),
    )


def repair_turns(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(conv_id and RESULT) of rows (conv_id, turn, role, text)."""
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType
    order = ["conv_id", "turn", "role", "text"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = with_firsts(rows.select(*order)).select("conv_id", "turn", "role", "text", (F.col("first").isNotNull() & (at() > F.col("first"))).alias("again")).repartitionByRange(n, *order).sortWithinPartitions(*order)

    way = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
    parts = T.StructType([
        T.StructField("conv_id", kind), *T.StructType.fromDDL(RESULT), T.StructField("k", T.LongType()), T.StructField("table", way), *T.StructType.fromDDL("roles array<string>, texts array<string>, first_turn long, last_turn long, turns long"),
    ])
    into = to_arrow_schema(parts)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, out, held = TaskContext.get().partitionId() << 32, 0, [], 0
        # The chunk being read; whether it begins its conversation for sure; the row before.
        own, whole, before = Chunk(), False, None

        def ended(last: bool) -> dict:
            if whole and last:
                return {"conv_id": before[0], **settled(own)}
            blank, duplicate, truncated = own.counts()
            table = [None if w is None else {"cost": w[0], "audit": w[1]} for row in own.ways((NOTHING,) if whole else (0, 1, 2, 3)) for w in row]
            return {
                "conv_id": before[0], "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": own.illegal(), "k": base + k, "table": table,
                "roles": own.roles, "texts": own.texts, "first_turn": own.first_turn, "last_turn": own.last_turn, "turns": own.turns,
            }

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                new = before is None or row[0] != before[0]
                if before is not None and (new or len(own.roles) >= chunk_rows or own.bytes >= chunk_bytes):
                    # The first conversation of a task may have begun in the task before, and its last may go on in the next.
                    out.append(ended(new))
                    held += own.bytes
                    k, own, whole = k + 1, Chunk(), new
                own.add(row[1], row[2], row[3], row[4] or row[:4] == before)
                before = row[:4]
                if len(out) >= 2_000 or held >= chunk_bytes:
                    yield pa.RecordBatch.from_pylist(out, schema=into)
                    out, held = [], 0
        if before is not None:
            out.append(ended(False))
        yield pa.RecordBatch.from_pylist(out, schema=into)

    found = written(sorted_rows.mapInArrow(chunks, parts), "chunks")
    names = T.StructType.fromDDL(RESULT).names
    done = found.where("k is null").select("conv_id", *names)

    # Conversations of several chunks: their tables meet in order of k.
    split = found.where("k is not null")
    chosen = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("at long, entry int, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, last boolean")])
    chosen_into = to_arrow_schema(chosen)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def ended() -> Iterator[pa.RecordBatch]:
            ends = [w for w in (state["ways"][NOTHING], state["ways"][ASSISTANT]) if w is not None]
            # Insertions at the end of the last chunk are part of its table, so one of both is there.
            best = ends[1] if len(ends) > 1 and ends[1].less(ends[0]) else ends[0]
            path, way = [], best
            while way.before is not None:
                path.append((way.entry, way.audit))
                way = way.before
            first, last = state["turn"]
            sums = {"gaps": last - first + 1 - state["turns"] if first is not None else 0, **state["sums"], "cost": best.cost}
            rows = [{"conv_id": state["id"], "at": k, "entry": entry, "audit": audit, "last": k == state["ks"][-1], **sums} for k, (entry, audit) in zip(state["ks"], reversed(path), strict=True)]
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 1000], schema=chosen_into)

        for batch in batches:
            for row in batch.to_pylist():
                if state and row["conv_id"] != state["id"]:
                    yield from ended()
                    state = {}
                if not state:
                    state = {"id": row["conv_id"], "ways": [Best(0, "", NOTHING, None), None, None, None], "ks": [], "turn": (None, None), "turns": 0, "role": None, "sums": dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)}
                table = [[None if w is None else (w["cost"], w["audit"]) for w in row["table"][s * 4 : s * 4 + 4]] for s in range(4)]
                state["ways"] = onward(state["ways"], table)
                state["ks"].append(row["k"])
                for name in state["sums"]:
                    state["sums"][name] += row[name]
                if state["role"] is not None:
                    state["sums"]["illegal"] += state["role"][:1] + row["first_role"][:1] not in ("su", "ua", "au")
                state["role"] = row["last_role"]
                if row["turns"]:
                    first, last = state["turn"]
                    state["turns"] += row["turns"] - (last == row["first_turn"])
                    state["turn"] = (row["first_turn"] if first is None else first, row["last_turn"])
        if state:
            yield from ended()

    narrow = split.select("conv_id", "k", "table", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns", F.element_at("roles", 1).alias("first_role"), F.element_at("roles", -1).alias("last_role"))
    decided = written(narrow.repartition(n, "conv_id").sortWithinPartitions("conv_id", "k").mapInArrow(choose, chosen), "chosen")

    # Each chunk's turns, and then the digest of all in order.
    pieces = split.select("k", "roles", "texts").join(decided, F.col("k") == F.col("at")).select(*decided.columns, "roles", "texts")
    texts = T.StructType([*chosen, T.StructField("text", T.StringType()), T.StructField("some", T.BooleanType())])
    texts_into = to_arrow_schema(texts)

    def turn_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                turns, _ = repaired(row.pop("roles"), row.pop("texts"), row["entry"], row["audit"])
                yield pa.RecordBatch.from_pylist([{**row, "text": "\n".join(turns), "some": bool(turns)}], schema=texts_into)

    results = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(RESULT)])
    results_into = to_arrow_schema(results)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, audit, some = hashlib.sha256(), [], False
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["some"]:
                    sha.update(("\n" * some + row["text"]).encode("utf-8", "surrogatepass"))
                    some = True
                audit.append(row["audit"])
                if row["last"]:
                    yield pa.RecordBatch.from_pylist([{**{k: row[k] for k in ("conv_id", *names[:6])}, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=results_into)
                    sha, audit, some = hashlib.sha256(), [], False

    joined = pieces.mapInArrow(turn_texts, texts).repartition(n, "conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(hashed, results)
    return done.unionByName(joined.select("conv_id", *names))


# ------------------------------------------------------------------------------------------------------------------- as SQL


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _plus(state: str, cost: str, letter: str, where: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {where} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}} END"


#: The states before a row with all insertions that may come first: z nothing, s system, u user, v assistant last.
_INSERTED = f"SELECT *, {_least('u1', *(_plus(k, '5', 'I') for k in ('v1',)))} AS u2 FROM (SELECT *, {_least('v', _plus('u1', '5', 'I'))} AS v1 FROM (SELECT *, {_least('u', _plus('z', '5', 'I'), _plus('s', '5', 'I'), _plus('v', '5', 'I'))} AS u1 FROM walk))"
_MAY = "fault NOT IN ('b', 'd')"
_CUT = "CASE WHEN fault = 't' THEN 5 ELSE 0 END"

#: repair_damaged() by a recursive query, a row of each conversation at a time, over the best (cost, audit) of each state.
ORACLE = rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations),
crc AS (SELECT *, xor(list_reduce(bytes, lambda a, b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS k FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM crc, (VALUES (0), (1)) v(again) WHERE k <> 0 AND (again = 0 OR k = 3)),
line AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
faulty AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '.' ELSE 't' END AS fault,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) || substr(role, 1, 1) AS pair FROM line),
every AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': ''}} AS z, NULL::STRUCT(c INTEGER, a VARCHAR) AS s, NULL::STRUCT(c INTEGER, a VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR) AS v FROM every
  UNION ALL SELECT w.conv_id, f.n, {_plus('z', '2', 'D')}, {_least(_plus('s', '2', 'D'), _plus('z', _CUT, 'K', f"initial = 's' AND {_MAY}"))},
    {_least(_plus('u2', '2', 'D'), *(_plus(k, _CUT, 'K', f"initial = 'u' AND {_MAY}") for k in ('z', 's', 'v1')), *(_plus(k, f'1 + {_CUT}', 'R', _MAY) for k in ('z', 's', 'v1')))},
    {_least(_plus('v1', '2', 'D'), _plus('u2', _CUT, 'K', f"initial = 'a' AND {_MAY}"), _plus('u2', f'1 + {_CUT}', 'R', _MAY))}
  FROM ({_INSERTED}) w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1),
done AS (SELECT conv_id, {_least('z', 'v1')} AS best FROM ({_INSERTED}) w WHERE n = (SELECT count(*) FROM faulty f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id)),
letter AS (SELECT conv_id, p, substr(best.a, p, 1) AS letter FROM done, LATERAL (SELECT unnest(range(1, length(best.a) + 1)) AS p)),
put AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS n FROM letter),
turns AS (SELECT a.conv_id, p, letter, f.role, f.text, f.initial, row_number() OVER (PARTITION BY a.conv_id ORDER BY p) AS o FROM put a LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.n = a.n WHERE letter <> 'D'),
placed AS (SELECT *, o - max(CASE WHEN o = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS place FROM turns),
texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM placed GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM every e JOIN done ON done.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM e.conv_id
"""
