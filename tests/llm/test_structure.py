import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from parlance.llm import structure as S
from parlance.llm.catalog import queries
from parlance.runtime import stored

SHAPE = "conv_id bigint, turn bigint, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        how = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if how == 3 else 1)
    return out


def faults(rows):
    """Fault of every row; rows in order."""
    out, seen = [], set()
    for _, _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else
                   "truncated" if visible[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Dynamic program over whole strings: (cost, initials, repaired) of the best; every insert anywhere."""
    best = {"": (0, "", ())}
    fronts = {"": "", "s": "s", "u": "u", "a": "ua"}

    def inserted(front):
        # Up to three inserts at one place.
        for _ in range(3):
            more = dict(front)
            for roles, (cost, audit, out) in front.items():
                for role in ("user", "assistant"):
                    keep(more, fronts[roles] + role[0], (cost + 2, audit + "I", out + ((role, ""),)))
            front = more
        return front

    def keep(table, roles, found):
        # Only fronts of the pattern are kept, as one per state.
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        roles = roles[-1:]
        if roles not in table or found[:2] < table[roles][:2]:
            table[roles] = found

    for (_, _, role, text), mark in zip(rows, marks):
        after = {}
        for roles, (cost, audit, out) in inserted(best).items():
            front = fronts[roles]
            found = after.get(roles)
            if found is None or (cost + 3, audit + "D") < found[:2]:
                after[roles] = (cost + 3, audit + "D", out)
            if mark not in ("blank", "duplicate"):
                more = mark == "truncated"
                keep(after, front + (role[:1] or "?"), (cost + more, audit + "K", out + ((role, text),)))
                for new in ("user", "assistant"):
                    keep(after, front + new[0], (cost + 2 + more, audit + "R", out + ((new, text),)))
        best = after
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damage(rows):
        convs[r[0]].append(r)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, f"{r[2]}:{r[3]}".encode()))
        marks = faults(mine)
        cost, audit, kept = cheapest(mine, marks)
        turns = [r[1] for r in mine if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        assert PATTERN.match("".join(r[:1] for r, _ in kept))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def through(spark, rows, block=S.BLOCK):
    raw, copies = S.damaged(spark.createDataFrame(rows, SHAPE))
    return got(S.report(S.repair(stored(S.lines(raw, copies=copies)), block)).withColumnRenamed("conv", "conv_id"))


def some_rows(seed, convs=60, most=14):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "So it is!  ", "a. b", "Again.", "x" * 70 + ".", "x" * 70 + "y."]
    rows = []
    for c in range(convs):
        turn = 0
        for _ in range(rnd.randrange(most)):
            turn += rnd.choice([0, 1, 1, 1, 2, 5])
            rows.append((c if c else None, turn if rnd.random() > 0.05 else None,
                         rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
                         rnd.choice([*texts, f"Text {rnd.random()}.", None])))
    return rows


@pytest.mark.parametrize("seed, block", [(1, S.BLOCK), (2, 3), (3, 2)])
def test_against_whole_strings(spark, seed, block):
    rows = some_rows(seed)
    assert through(spark, rows, block) == expected(rows)


def test_initials_are_the_least_of_all_edit_strings():
    """The dynamic program above against every string of edits, on all short conversations."""
    for n in range(4):
        for roles in product(["user", "assistant", "system", "tool"], repeat=n):
            rows = [(1, i, r, f"{i}" + "." * (i != 1)) for i, r in enumerate(roles)]
            marks = faults(rows)
            best = min(_all(rows, marks))
            steps = S.Steps()
            tables = [S.line_table((r[2][:1] or "?") + ("!" if m else ".")) for r, m in zip(rows, marks)]
            last = S.ending(S.joined(tables, steps)[S.NOTHING])
            at = S.crossings(tables, S.NOTHING, last, steps)
            audit = "".join(min((c, e) for q, c, e in S.edits((r[2][:1] or "?") + ("!" if m else "."), a) if q == b)[1]
                            for r, m, a, b in zip(rows, marks, at, at[1:])) + "I" * S.CLOSING[last]
            assert audit == best[1] == cheapest(rows, marks)[1]


def _all(rows, marks, i=0, roles="", cost=0, audit="", bound=10):
    if cost > bound or not re.fullmatch(r"s?(ua)*u?", roles):
        return
    if i == len(rows) and PATTERN.match(roles):
        yield cost, audit
    for r in "ua":
        yield from _all(rows, marks, i, roles + r, cost + 2, audit + "I", bound)
    if i < len(rows):
        more = marks[i] == "truncated"
        yield from _all(rows, marks, i + 1, roles, cost + 3, audit + "D", bound)
        yield from _all(rows, marks, i + 1, roles + rows[i][2][:1], cost + more, audit + "K", bound)
        for r in "ua":
            yield from _all(rows, marks, i + 1, roles + r, cost + 2 + more, audit + "R", bound)


def test_a_long_conversation_in_small_blocks(spark):
    rnd = random.Random(7)
    rows = [(1, i, rnd.choice(["user", "assistant", "tool"]), rnd.choice(["Yes.", "No", f"{i}."])) for i in range(600)]
    assert through(spark, rows, block=4) == through(spark, rows) == expected(rows)


def test_many_copies_and_very_long_texts(spark):
    rows = [(1, None, "user", "Same.")] * 3000 + [(1, 2, "assistant", "word " * 200_000 + ".")] + [(2, 0, "user", "")] * 500
    assert through(spark, rows, block=16) == expected(rows)


def test_empty_table_and_dropped_conversations(spark):
    assert through(spark, []) == {}
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert through(spark, [(gone, 0, "user", "Hello.")]) == {
        gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_extra_columns_and_text_keys(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi.", 5, 6), ("a", 2, "assistant", "Ho.", 5, 6)],
                               "conv string, n int, who string, text string, seq int, copies int")
    out = S.report(S.repair(stored(S.lines(df, "conv", "n", "who")))).collect()
    assert [(r["conv"], r["audit"], r["cost"]) for r in out] == [("a", "KK", 0)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries()["op11_hirschberg_repair"](spark, sf)) == expected(rows)
