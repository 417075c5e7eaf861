"""Conversation repair against all edits of short conversations, and in pieces of long ones."""

import binascii
import hashlib
import itertools
import random
import re

import pytest

from palimpsest.llm import dialogue

GRAMMAR = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """The plain definition of each row's first fault."""
    out, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(BLANKS)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_hand(rows):
    """(cost, audit, repaired turns): every choice of edits for every turn, with up to two inserts anywhere."""
    rows = [(t, r or " ", " " if x is None else x) for t, r, x in rows]
    faults = faults_of(rows)
    inserts = [[(3 * n, "I" * n, [(r, "") for r in c]) for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]][0]
    steps = []
    for (_, role, text), f in zip(rows, faults, strict=True):
        more = 3 if f == "truncated" else 0
        mine = [(4, "D", [])]
        if f in ("", "truncated"):
            mine += [(more, "K", [(role, text)])] + [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        steps += [inserts, mine]
    best = (10**9, "", [])
    for chosen in itertools.product(*steps, inserts):
        out = [x for _, _, turns in chosen for x in turns]
        if sum(c for c, _, _ in chosen) <= best[0] and GRAMMAR.fullmatch("".join(r[0] for r, _ in out)):
            best = min(best, (sum(c for c, _, _ in chosen), "".join(e for _, e, _ in chosen), out), key=lambda x: x[:2])
    return best


def lazily(rows):
    """The same by memoised search from the end, for longer conversations: states are (turn, inserts, matched so far)."""
    rows = [(t, r or " ", " " if x is None else x) for t, r, x in rows]
    faults, n = faults_of(rows), len(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    level = {g: (0, "", []) if g in ("", "a") else None for g in follow}
    for i in range(n, -1, -1):
        here = {}
        if i < n:
            _, role, text = rows[i]
            more = 3 if faults[i] == "truncated" else 0
            for g in follow:
                found = [(level[g][0] + 4, "D" + level[g][1], level[g][2])]
                if faults[i] in ("", "truncated"):
                    for r, e, c in ((role, "K", more), ("user", "R", 3 + more), ("assistant", "R", 3 + more)):
                        if r[0] in follow[g]:
                            x = level[r[0]]
                            found.append((x[0] + c, e + x[1], [(r, text), *x[2]]))
                here[g] = min(found, key=lambda x: x[:2])
        else:
            here = {g: x or (10**9, "", []) for g, x in level.items()}
        for _ in range(3):
            here = {g: min([here[g], *[(here[r[0]][0] + 3, "I" + here[r[0]][1], [(r, ""), *here[r[0]][2]]) for r in ("user", "assistant") if r[0] in follow[g]]], key=lambda x: x[:2]) for g in follow}
        level = here
    return level[""]


def conversation(r, n):
    return [(r.choice([None, *range(n)]) if r.random() < 0.1 else k, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), r.choice(["a.", "b?", "c", " \n", "", None, "d!", "e. ", f"x{k}.", f"y{k}", f"z{k}."])) for k in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or " ", " " if x[2] is None else x[2]))


def expected(conv, rows):
    rows = ordered(rows)
    cost, audit, out = lazily(rows)
    turns = [t for t, _, _ in rows if t is not None]
    faults = faults_of([(t, a or " ", " " if x is None else x) for t, a, x in rows])
    initials = [(r or " ")[0] for _, r, _ in rows]
    return {
        "conv_id": conv,
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    }


def test_cheapest_edits_are_the_least_of_all():
    r = random.Random(3)
    for _ in range(50):
        rows = ordered(conversation(r, r.randint(0, 3)))
        assert lazily(rows)[:2] == by_hand(rows)[:2]
        assert lazily(rows)[2] == by_hand(rows)[2]


def test_chunks_give_what_the_whole_gives():
    r = random.Random(4)
    for _ in range(200):
        codes = bytes(r.choice([0, 3, 4, 4, 4, 7, 8, 8, 8, 11, 5, 10, 12, 15]) for _ in range(r.randint(1, 40)))
        size = r.randint(1, 7)
        parts = [codes[i : i + size] for i in range(0, len(codes), size)]
        cost, edits = dialogue.cheapest(codes)
        states, costs, ranks = dialogue.chained(*zip(*[dialogue.matrix(p) for p in parts], strict=True))
        got = []
        for part, state, c, k in zip(parts, states, costs, ranks, strict=True):
            choices = dialogue.backward(part, tuple(c), tuple(k))[3]
            mine, state = dialogue.forward(choices, state)
            got += mine
        got[-1] += dialogue.endings()[2][state]
        assert (got, dialogue.spent(list(codes), got)) == (edits, cost)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(dialogue, "CHUNK", 5)
    monkeypatch.setattr(dialogue, "LONG", 12)


def rows_of(convs):
    return [(c, t, r, x, "k", 7) for c, rows in convs.items() for t, r, x in rows]


SCHEMA = "conv_id long, turn long, role string, text string, key string, seq int"


def cases():
    r = random.Random(5)
    convs = {c: conversation(r, r.randint(1, 9)) for c in range(30)}
    convs[30] = [(k, "user", "same.") for k in range(60)]  # a third of all rows has one text
    convs[31] = conversation(r, 150)
    convs[32] = [(None, None, None)] * 9
    convs[33] = [(0, "user", "long " * 50_000 + "."), (1, "assistant", "long " * 50_000)]
    convs[None] = conversation(r, 8)
    return convs


@pytest.mark.parametrize("cut", [False, True])
def test_conversations_of_many_tasks(spark, cut, request):
    if cut:
        request.getfixturevalue("small")
    convs = cases()
    found = {x["conv_id"]: x.asDict() for x in dialogue.audited(spark.createDataFrame(rows_of(convs), SCHEMA).repartition(3)).collect()}
    assert found == {c: expected(c, rows) for c, rows in convs.items()}


@pytest.mark.parametrize("cut", [False, True])
def test_turns_are_what_the_audit_says(spark, cut, request):
    if cut:
        request.getfixturevalue("small")
    convs = cases()
    rows = dialogue.repaired_turns(spark.createDataFrame(rows_of(convs), SCHEMA).repartition(3)).collect()
    for c, given in convs.items():
        cost, audit, out = lazily(ordered(given))
        mine = sorted((x for x in rows if x["conv_id"] == c), key=lambda x: x["at"])
        kept = [x for x in mine if x["edit"] != "D"]
        assert sorted("".join(x["edit"] for x in mine)) == sorted(audit)
        assert sorted((x["role"], x["text"]) for x in kept) == sorted(out)
        assert len({x["at"] for x in mine if x["edit"] != "I"}) == len(given)


def test_damage_is_what_the_checksum_says(spark):
    rows = [(c, t, r, x) for c, t in itertools.product([None, *range(40)], [None, 0, 1, 2]) for r, x in [("assistant", "Yes. No! Why?")]]
    got = sorted(((x["conv_id"], x["turn"], x["role"], x["text"]) for x in dialogue.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        kind = binascii.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want, key=repr)


def test_the_query_on_its_tables(spark, tmp_path):
    r = random.Random(6)
    rows = [(c, t, role, x) for c in range(60) for t, role, x in conversation(r, r.randint(1, 4))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {x["conv_id"]: x.asDict() for x in dialogue.op12_conversation_repair(spark, str(tmp_path)).collect()}
    left = {}
    for x in dialogue.damaged(spark.read.parquet(str(tmp_path / "conversations.parquet"))).collect():
        left.setdefault(x["conv_id"], []).append((x["turn"], x["role"], x["text"]))
    assert set(found) == set(range(60)) and len(left) < 60
    empty = expected(None, [])
    assert found == {c: expected(c, left[c]) if c in left else empty | {"conv_id": c} for c in range(60)}


def test_an_empty_table(spark):
    assert dialogue.audited(spark.createDataFrame([], SCHEMA)).count() == 0
