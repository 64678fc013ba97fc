import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from cleanloom.llm import conversation_repair as C
from cleanloom.llm.conversation_repair import audits, damaged, decisions, gathered, numbered, query, repair, repaired_lines, signs

LEGAL = re.compile(r"(s?(ua)+)?")


def brute(turns):
    """Least (cost, audit, repaired text) of all edits of (role, text) turns, tried one by one."""
    seen, faults = set(), []
    for role, text in turns:
        words = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    gap = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    each = []
    for (role, text), fault in zip(turns, faults, strict=True):
        more = 3 * (fault == "truncated")
        own = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            own += [(more, "K", [(role, text)]), (3 + more, "R", [("user", text)]), (3 + more, "R", [("assistant", text)])]
        each.append([(3 * len(g) + c, "I" * len(g) + e, [*((r, "") for r in g), *lines]) for g in gap for c, e, lines in own])
    best = None
    for choice in itertools.product(*each, [(3 * len(g), "I" * len(g), [(r, "") for r in g]) for g in gap]):
        lines = [x for _, _, part in choice for x in part]
        if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in lines)):
            found = (sum(c for c, _, _ in choice), "".join(e for _, e, _ in choice), "\n".join(f"{r}:{t}" for r, t in lines))
            best = min(best or found, found)
    return best, faults


def expected(rows):
    """The query's row for the turns (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    (cost, audit, text), faults = brute([(r, t) for _, r, t in rows])
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def made(rng, n):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", ""], ["One.", "Two?", "Three", " ", "Four! ", "", "a\nb."]
    return [(rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_audits_equal_brute_force(spark):
    rng = random.Random(13)
    convs = {k: made(rng, k % 5) for k in range(60)} | {None: made(rng, 3)}
    turns = spark.createDataFrame([(c, *t, 1) for c, rows in convs.items() for t in rows], "conv_id long, turn long, role string, text string, rid int")
    got = {r[0]: tuple(r[1:]) for r in audits(turns, numbered(turns)).collect()}
    assert got == {c: expected(rows) for c, rows in convs.items() if rows}


def test_repair_equals_a_letter_by_letter_search():
    """Long conversations against the other way round: least cost to go from each place and state, then the least letter."""
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("0123456789abcdef" if rng.random() < 0.3 else "1212de") for _ in range(rng.randint(0, 40)))
        steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        n, far = len(text), 10**9
        need = {0: "u", 1: "u", 2: "a", 3: "u"}
        go = [[far] * 4 for _ in range(n + 1)]
        go[n] = [0, 6, 3, 0]

        def options(i, state, text=text, n=n, steps=steps, need=need):
            yield 3, "I", i, steps[state, need[state]]
            if i < n:
                fault, own = divmod(int(text[i], 16), 4)
                yield 4, "D", i + 1, state
                if fault in (0, 3):
                    more = 3 * (fault == 3)
                    if own < 3 and (state, "sua"[own]) in steps:
                        yield more, "K", i + 1, steps[state, "sua"[own]]
                    yield 3 + more, "R", i + 1, steps[state, need[state]]

        for i in range(n - 1, -1, -1):
            for _ in range(3):  # inserts lead from one state to the next
                for state in range(4):
                    go[i][state] = min(c + go[j][to] for c, _, j, to in options(i, state))
        i, state, audit = 0, 0, ""
        while i < n or state not in (0, 3):
            cost, letter, j, to = min((o for o in options(i, state) if o[0] + go[o[2]][o[3]] == go[i][state]), key=lambda o: o[1])
            audit, i, state = audit + letter, j, to
        cost, edits = repair(text)
        assert (cost, "".join(edits)) == (go[0][0], audit), text


def test_damage(spark):
    rows = [(c, t, "assistant", "Is it. So!?") for c in (1, 2, None) for t in (None, *range(30))]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: "Is it So"}.get(kind, text)
        want += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = map(tuple, damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    key = lambda r: tuple((x is None, x or 0) for x in r[:2])
    assert sorted(got, key=key) == sorted(want, key=key)
    nulls = spark.createDataFrame([(1, 3, None, None)], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in damaged(nulls).collect()] in ([], [(1, 3, " ", " ")], [(1, 3, " ", "")], [(1, 3, "user", " ")], [(1, 3, " ", " ")] * 2)


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, *x[1:]) for c in range(80) for t, x in enumerate(made(rng, rng.randint(1, 7)))]
    rows += [(None, None, "user", "Hi."), (None, 1, None, None), (80, 5, "user", "Gone?"), (81, 2, "system", "Only."), *([(82, None, "user", "Same.")] * 4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv_id", C.F.col("conv_id"))
    turns.coalesce(1).write.parquet(f"{tmp_path}/t")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/t/*.parquet'")
    want = {tuple(r) for r in db.execute(C.SQL).fetchall()}
    frame = query(turns)
    got = {tuple(r) for r in frame.collect()}
    assert not got ^ want, "\n".join(map(repr, sorted(got ^ want, key=str)))
    assert len(want) == len({r[0] for r in rows})
    assert frame.columns == [d[0] for d in db.execute(C.SQL).description]


def test_one_long_conversation_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"Turn {t}" + rng.choice(["", ".", "."])) for t in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    table = numbered(turns)
    decided = decisions(gathered(signs(table)))
    row = decided.collect()[0]
    assert len(row.parts) > 80 and "".join(p.edits for p in row.parts) == row.audit
    lines = [x for r in repaired_lines(table, decided).orderBy("rid").collect() for x in r["lines"]]
    assert LEGAL.fullmatch("".join(x[0] for x in lines))
    got = audits(turns, table).collect()[0]
    assert got.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest() and got.gaps == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_empty_table(spark, kind):
    assert query(spark.createDataFrame([], f"conv_id {kind}, turn long, role string, text string")).collect() == []
