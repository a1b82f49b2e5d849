"""Conversation repair against enumeration of all edits, and whole tables against a plain version; chunks of a few rows give the same."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sweepframe.llm import conversation_repair as cr
from sweepframe.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def enumerated(roles, faults, most_inserts=3):
    """The least (cost, audit) over all edits with a few insertions that give legal role initials."""
    best = None
    for ops in itertools.product(*[["D"] if f in "bd" else ["D", "K", "Ru", "Ra"] for f in faults]):
        base = sum({"D": 2, "K": 0, "R": 1}[o[0]] + (5 if f == "t" and o != "D" else 0) for o, f in zip(ops, faults, strict=True))
        for k in range(most_inserts + 1):
            if best is not None and base + 5 * k > best[0]:
                break
            for places in itertools.combinations_with_replacement(range(len(ops) + 1), k):
                for inserted in itertools.product("ua", repeat=k):
                    initials, audit, extra = "", "", list(zip(places, inserted, strict=True))
                    for i in range(len(ops) + 1):
                        for _, c in (e for e in extra if e[0] == i):
                            initials, audit = initials + c, audit + "I"
                        if i < len(ops):
                            audit += ops[i][0]
                            initials += "" if ops[i] == "D" else (roles[i][:1] or "?") if ops[i] == "K" else ops[i][1]
                    if re.fullmatch("(s?(ua)+)?", initials):
                        found = (base + 5 * k, audit)
                        best = found if best is None or found < best else best
    return best


def test_search_finds_the_optimum():
    r = random.Random(2)
    for _ in range(150):
        n = r.randint(0, 4)
        roles = [r.choice(["user", "assistant", "system", "tool", "", " "]) for _ in range(n)]
        faults = "".join(r.choice("....tbd") for _ in range(n))
        ways = cr.cheapest([x[:1] for x in roles], faults, cr.NOTHING)
        assert min(w for w in (ways[cr.NOTHING], ways[cr.ASSISTANT]) if w) == enumerated(roles, faults)


def test_joined_chunks_equal_one_search():
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(2, 40)
        initials, faults = [r.choice("uuaas x") for _ in range(n)], "".join(r.choice("......ttbd") for _ in range(n))
        want = cr.cheapest(initials, faults, cr.NOTHING)
        ways, at = [cr.Best(0, "", cr.NOTHING, None), None, None, None], 0
        while at < n:
            end = min(n, at + r.randint(1, 7))
            ways = cr.onward(ways, [cr.cheapest(initials[at:end], faults[at:end], s) for s in range(4)])
            at = end
        for way, w in zip(ways, want, strict=True):
            audit, cost = [], None if way is None else way.cost
            while way is not None and way.before is not None:
                audit.append(way.audit)
                way = way.before
            assert (None if cost is None else (cost, "".join(reversed(audit)))) == w


def plain(rows):
    """The result for each conv_id, by a table of the best edits to each state after each row."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]  # noqa: B018
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            convs[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), ""
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults += "b" if not last else "d" if (role, text) in seen else "." if last[-1] in ".!?" else "t"
            seen.add((role, text))
        moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        best = {"": (0, "", ())}

        def inserted(best):
            for _ in range(3):
                for (a, c), b in moves.items():
                    if a in best and c != "s":
                        new = (best[a][0] + 5, best[a][1] + "I", best[a][2] + (("user:", "assistant:")[c == "a"],))
                        best[b] = min(best.get(b, new), new)
            return best

        for (_, role, text), fault in zip(own, faults, strict=True):
            new = {}
            for a, (cost, audit, turns) in inserted(best).items():
                ways = [(a, (cost + 2, audit + "D", turns))]
                if fault not in "bd":
                    extra = 5 * (fault == "t")
                    if (a, role[:1]) in moves:
                        ways.append((moves[a, role[:1]], (cost + extra, audit + "K", (*turns, f"{role}:{text}"))))
                    ways += [(moves[a, c[0]], (cost + extra + 1, audit + "R", (*turns, f"{c}:{text}"))) for c in ("user", "assistant") if (a, c[0]) in moves]
                for b, w in ways:
                    new[b] = min(new.get(b, w), w)
            best = new
        cost, audit, turns = min(w for a, w in inserted(best).items() if a in ("", "a"))
        at = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own[:-1], own[1:], strict=True))
        out[conv] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


def odd_rows():
    r = random.Random(6)
    rows = [(None, None, None, None), (None, 3, "user", "Null id."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 2, "", "x!"), (2, 5, "user", " \n\t"), (3, 1, "tool", "é日😀?"), (3, 1, "tool", "again"), (4, 9, "user", "y" * 100_000 + "." + " " * 5_000)]
    for conv in range(10, 60):
        for turn in range(r.randint(1, 12)):
            rows.append((conv, turn * r.choice([1, 1, 2]), r.choice(["user", "assistant", "system", "User", "other"]), r.choice(["Fine.", "Yes!", "no end", "", f"Text {turn}.", None])))
    rows += [(99, k // 2, "user" if k % 2 == 0 else "assistant", f"Long {k % 50}.") for k in range(900)]
    return rows + rows[:3] + rows[40:60]


@pytest.mark.parametrize(("chunk_rows", "chunk_bytes"), [(cr.CHUNK_ROWS, cr.CHUNK_BYTES), (3, 1 << 20), (7, 40)])
def test_repair_equals_plain_version(spark, chunk_rows, chunk_bytes, monkeypatch):
    turns = cr.repair_turns
    monkeypatch.setattr(cr, "repair_turns", lambda rows: turns(rows, chunk_rows, chunk_bytes))
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit("clash")).withColumn("audit", F.lit(1)).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in cr.repair_damaged(frame).collect()}
    assert got == plain(rows)


def test_repeated_texts_beyond_a_broadcast(spark):
    rows = cr.damaged(spark.createDataFrame(odd_rows(), SCHEMA))
    want = sorted(map(repr, cr.with_firsts(rows).collect()))
    assert sorted(map(repr, cr.with_firsts(rows, hot=10, most=5).collect())) == want and any("first=Row" in w for w in want)


def test_empty_table_and_undamaged_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair_damaged(empty).count() == 0 and cr.repair(empty).count() == 0
    (row,) = cr.repair(spark.createDataFrame([(1, 1, "assistant", "Hello."), (1, 0, "user", "Hi!")], SCHEMA)).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi!\nassistant:Hello.").hexdigest())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01").collect()} == plain(rows)


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_sql_equals_plain_version(rows):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in db.sql(cr.ORACLE).fetchall()} == plain(rows)
