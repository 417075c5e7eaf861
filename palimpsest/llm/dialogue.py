"""Conversation repair: the cheapest edits that make roles alternate and drop faulty turns.

Three weighted machines are composed. The input acceptor is a conversation's turns, each
a role's initial and a fault; the edit transducer keeps (K), reroles (R), deletes (D) or
inserts (I) a turn; the acceptor of role grammar takes ``(s?(ua)+)?``. The composition is
made lazily, for the turns that occur, and remembered. Weights are pairs of a cost and
the edits' initials, least first. Shortest paths are found in topological order from the
last turn back: a path's weight then grows at its front only, which keeps the order of
strings, and it is enough to know how the strings of the four grammar states compare.
Inserts are put before the turn that follows them, so no string of as many turns starts
another one.

That makes a run of turns a 4 x 4 matrix of such weights, which can be multiplied in
pieces. Turns are sorted by ranges of (conversation, turn), so a long conversation is
many tasks'. A conversation that lies within a range is repaired where it is; what
touches a range's ends, or is longer than ``LONG`` turns or ``LONG_BYTES``, is cut into
chunks of ``CHUNK`` turns: their matrices meet (one small row for a chunk), and each
chunk then finds its own edits. Only the hash of a whole conversation is made in one
task, turn by turn.

Rows: null roles and texts count as one space, as do empty roles. A null ``conv_id`` is a
conversation, null turns come first, and rows with the same turn are taken in the order of
role, text's first 64 characters and its hash. Roles that start with another letter than s, u or a can be reroled or
deleted only. Repeated rows are duplicates. An empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a chunk; turns and characters of a conversation that a task holds.
CHUNK, LONG, LONG_BYTES = 4096, 1 << 16, 32 << 20
INF = 1 << 60
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
OK, BLANK, DUPLICATE, CUT = range(4)
FAULTS = ("", "blank", "duplicate", "truncated")
SYMBOLS = "sua"
#: The grammar: nothing yet, after a system turn, after a user's, after an assistant's (states 0 to 3).
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL, ROLES = 4, (0, 3), {"u": "user", "a": "assistant"}


def symbol(role: str) -> int:
    """The number of a role's initial; 3 for those that the grammar does not know."""
    found = SYMBOLS.find(role[:1]) if role else -1
    return found if found >= 0 else 3


def fault(text: str) -> int:
    """Blank, truncated or neither."""
    shown = text.rstrip(BLANKS)
    return BLANK if not shown else OK if shown[-1] in STOPS else CUT


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """States after no, one and two inserts, with cost and edits; more are never cheapest."""
    cost, edits = 0, ""
    for _ in range(3):
        yield state, cost, edits
        state = next((to for (at, s), to in GRAMMAR.items() if at == state and s in ROLES), -1)
        cost, edits = cost + INSERT, edits + "I"


@lru_cache(maxsize=None)
def composed(code: int) -> tuple[tuple[int, int, int, str], ...]:
    """Arcs (from, to, cost, edits) between grammar states that take one turn; of those between two states the least."""
    initial, faulty = divmod(code, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in range(STATES):
        for state, cost, edits in _inserted(begin):
            arcs = [(state, DELETE, "D")]
            if faulty not in (BLANK, DUPLICATE):
                more = TRUNCATED if faulty == CUT else 0
                arcs += [(GRAMMAR[state, s], REROLE + more, "R") for s in ROLES if (state, s) in GRAMMAR]
                if initial < 3 and (state, SYMBOLS[initial]) in GRAMMAR:
                    arcs.append((GRAMMAR[state, SYMBOLS[initial]], more, "K"))
            for to, add, edit in arcs:
                found = (cost + add, edits + edit)
                if found < best.get((begin, to), (INF, "")):
                    best[begin, to] = found
    return tuple((a, b, *w) for (a, b), w in sorted(best.items()))


def endings() -> tuple[tuple[int, ...], tuple[int, ...], tuple[str, ...]]:
    """After the last turn: cost, rank and edits that lead from each state to a final one."""
    found = [min((cost, edits) for at, cost, edits in _inserted(state) if at in FINAL) for state in range(STATES)]
    order = sorted({e for _, e in found})
    return tuple(c for c, _ in found), tuple(order.index(e) for _, e in found), tuple(e for _, e in found)


@lru_cache(maxsize=1 << 16)
def _stepped(cost: tuple[int, ...], rank: tuple[int, ...], code: int, wide: int):
    best: list = [None] * (STATES * wide)
    for a, b, w, edits in composed(code):
        for o in range(wide):
            if cost[b * wide + o] < INF:
                found = (cost[b * wide + o] + w, edits, rank[b * wide + o], b)
                if best[a * wide + o] is None or found < best[a * wide + o]:
                    best[a * wide + o] = found
    strings = {x: i for i, x in enumerate(sorted({b[1:3] for b in best if b}))}
    low = min((b[0] for b in best if b), default=0)
    return low, tuple(b[0] - low if b else INF for b in best), tuple(strings[b[1:3]] if b else 0 for b in best), tuple(b and (b[1], b[3]) for b in best)


def backward(codes: bytes, cost: tuple[int, ...], rank: tuple[int, ...], wide: int = 1) -> tuple[int, tuple[int, ...], tuple[int, ...], list]:
    """From the weights after these turns to those before them: what all cost more, costs, ranks, and each turn's choices."""
    base, choices = 0, []
    for code in reversed(codes):
        low, cost, rank, chosen = _stepped(cost, rank, code, wide)
        base += low
        choices.append(chosen)
    return base, cost, rank, choices[::-1]


def matrix(codes: bytes) -> tuple[list[int], list[int]]:
    """Costs and ranks of the cheapest edits of a chunk between any two states."""
    unit = tuple(0 if i // STATES == i % STATES else INF for i in range(STATES * STATES))
    base, cost, rank, _ = backward(codes, unit, (0,) * STATES * STATES, STATES)
    return [c + base if c < INF else INF for c in cost], list(rank)


def forward(choices: list, state: int) -> tuple[list[str], int]:
    """Each turn's edits on the cheapest path from a state, and the state it ends in."""
    edits = []
    for chosen in choices:
        mine, state = chosen[state]
        edits.append(mine)
    return edits, state


def cheapest(codes: bytes) -> tuple[int, list[str]]:
    """Cost and edits of a whole conversation, those of each turn together; the last one's include what follows it."""
    cost, rank, ends = endings()
    base, cost, _, choices = backward(codes, cost, rank)
    edits, state = forward(choices, 0)
    if edits:
        edits[-1] += ends[state]
    return cost[0] + base, edits


def chained(costs: list[list[int]], ranks: list[list[int]]) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """For chunks in order: the state each begins in, and costs and ranks after it."""
    cost, rank, _ = endings()
    after, via = [], []
    for c, r in zip(reversed(costs), reversed(ranks), strict=True):
        after.append((list(cost), list(rank)))
        best = [min((c[a * STATES + b] + cost[b], r[a * STATES + b], rank[b], b) for b in range(STATES) if c[a * STATES + b] < INF and cost[b] < INF) for a in range(STATES)]
        order = sorted({x[1:3] for x in best})
        cost, rank = [x[0] for x in best], [order.index(x[1:3]) for x in best]
        via.append([x[3] for x in best])
    states, state = [], 0
    for to in reversed(via):
        states.append(state)
        state = to[state]
    return states, [x for x, _ in reversed(after)], [x for _, x in reversed(after)]


def lines(state: int, edits: str, role: str, text: str) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of a turn and the inserts around it, from a grammar state, and the state after it."""
    out = []
    for e in edits:
        if e == "D":
            out.append((e, role, text))
            continue
        s = role[0] if e == "K" else next(x for at, x in GRAMMAR if at == state and x in ROLES)
        out.append((e, role if e == "K" else ROLES[s], "" if e == "I" else text))
        state = GRAMMAR[state, s]
    return out, state


class Tally:
    """What is counted along a conversation, turn by turn."""

    def __init__(self) -> None:
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.faults, self.illegal, self.before = [0] * 4, 0, None
        self.audit: list[str] = []
        self.state, self.hash, self.any = 0, hashlib.sha256(), False

    def add(self, turn: int | None, code: int, edits: str, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.faults[code & 3] += 1
        if self.before is not None:
            self.illegal += (self.before, code >> 2) not in ((0, 1), (1, 2), (2, 1))
        self.before = code >> 2
        found, self.state = lines(self.state, edits, role, text)
        for e, r, t in found:
            if e != "D":
                self.hash.update(("\n" if self.any else "").encode() + f"{r}:{t}".encode("utf-8", "surrogatepass"))
                self.any = True
        self.audit.append(edits)

    def row(self, conv: int | None, cost: int) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": conv, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT], "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def spent(codes: list[int], edits: list[str]) -> int:
    """What these edits cost."""
    price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
    return sum(sum(price[x] for x in e) + (TRUNCATED if c & 3 == CUT and "D" not in e else 0) for c, e in zip(codes, edits, strict=True))


RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
TURN = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("fault", pa.string()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
#: Turns of conversations that one task cannot finish.
OPEN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("piece", pa.int64()), ("seq", pa.int64()), ("chunk", pa.int64()), ("code", pa.int32()), ("key", pa.binary())])
KINDS = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {KINDS[f.type]}" for f in schema)


def _at(piece: int, seq: int) -> int:
    return (piece << 33) + seq


def _solved(conv: int | None, turns: list[tuple], full: bool, piece: int, first: int) -> list[dict]:
    """A whole conversation's row, or its turns."""
    seen: set[tuple[str, str]] = set()
    codes = []
    for _, role, text in turns:
        f = fault(text)
        if f != BLANK and (role, text) in seen:
            f = DUPLICATE
        seen.add((role, text))
        codes.append(symbol(role) * 4 + f)
    cost, edits = cheapest(bytes(codes))
    if not full:
        tally = Tally()
        for (turn, role, text), code, e in zip(turns, codes, edits, strict=True):
            tally.add(turn, code, e, role, text)
        return [tally.row(conv, cost)]
    out, state = [], 0
    for k, ((turn, role, text), code, e) in enumerate(zip(turns, codes, edits, strict=True)):
        found, state = lines(state, e, role, text)
        out += _turns(conv, _at(piece, first + k), turn, code, found)
    return out


def _turns(conv: int | None, at: int, turn: int | None, code: int, found: list[tuple[str, str, str]]) -> list[dict]:
    return [{"conv_id": conv, "at": at, "turn": None if e == "I" else turn, "fault": None if e == "I" else FAULTS[code & 3], "edit": e, "role": r, "text": t} for e, r, t in found]


def _first_pass(full: bool):
    """Sorted turns of one range to results, and to open turns."""
    schema = pa.schema([*(TURN if full else RESULT), *[pa.field(f"open_{f.name}", f.type) for f in OPEN]])

    def opened(conv: int | None, piece: int, turns: list[tuple], first: int, seen: set[bytes], chunk: int) -> Iterator[dict]:
        for k, (turn, role, text) in enumerate(turns):
            key = hashlib.blake2b(repr((conv, role)).encode("utf-8", "surrogatepass") + b"\0" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            f = fault(text)
            if f != BLANK and key in seen:
                f = DUPLICATE
            seen.add(key)
            yield {f"open_{n}": v for n, v in zip(OPEN.names, (conv, turn, role, text, piece, first + k, chunk, symbol(role) * 4 + f, key), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        now, turns, size, seq = (), [], 0, 0  # () is no conversation
        straddles, seen, chunk, filled = True, set(), -1, 0  # the first one may begin in the range before
        out: list[dict] = []

        def flush() -> Iterator[dict]:
            """The turns held, as open ones."""
            nonlocal chunk, filled, turns, size
            first = seq - len(turns)
            while turns:
                if filled == 0:
                    chunk += 1
                part, turns = turns[: CHUNK - filled], turns[CHUNK - filled :]
                yield from opened(now[0], piece, part, first, seen, chunk)
                first, filled = first + len(part), (filled + len(part)) % CHUNK
            size = 0

        for batch in batches:
            for conv, turn, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True):
                if now != (conv,):
                    if now and straddles:
                        out += flush()
                        straddles = False
                    elif now:
                        out += _solved(now[0], turns, full, piece, seq - len(turns))
                        turns, size = [], 0
                    now, seen, filled = (conv,), set(), 0
                turns.append((turn, role, text))
                seq, size = seq + 1, size + len(text)
                if len(turns) >= (CHUNK if straddles else LONG) or size >= LONG_BYTES:
                    straddles = True  # too long to be held: it is open from here on
                    out += flush()
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        out += flush()  # the last one may go on in the next range
        yield pa.RecordBatch.from_pylist(out, schema)

    return run, _ddl(schema)


def _chunk_edits(open_turns: DataFrame) -> DataFrame:
    """``piece, seq, code, edits, state`` of every open turn: its edits and the grammar state before them."""
    slim = open_turns.select("conv_id", "piece", "seq", "chunk", "code", "key")
    # Within a piece only a text's first place is still no duplicate, so a text has one row for a piece here.
    new = F.expr(f"code % 4 IN ({OK}, {CUT})")
    firsts = slim.where(new).groupBy("key").agg(F.min("piece").alias("first"), F.max("piece").alias("final")).where("first < final").select("key", "first")
    known = slim.join(firsts, "key", "left").select("conv_id", "piece", "seq", "chunk", F.when(new & (F.col("piece") > F.col("first")), F.expr(f"code - code % 4 + {DUPLICATE}")).otherwise(F.col("code")).alias("code"))
    chunks = known.groupBy("conv_id", "piece", "chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("s")).select("conv_id", "piece", "chunk", "s.seq", "s.code")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matrix(bytes(x)) for x in batch["code"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("conv_id", "piece", "chunk", "seq", "code")], pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([r for _, r in found], pa.list_(pa.int64()))], names=["conv_id", "piece", "chunk", "seq", "code", "cost", "rank"])

    held = runtime.written(chunks.mapInArrow(runtime.lean(summed), "conv_id long, piece long, chunk long, seq array<long>, code array<int>, cost array<long>, rank array<long>"), "dialogue-chunks")

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["piece", "chunk"])
        states, cost, rank = chained(rows["cost"].tolist(), rows["rank"].tolist())
        return pd.DataFrame({"piece": rows["piece"], "chunk": rows["chunk"], "state": states, "cost": cost, "rank": rank, "last": [False] * (len(rows) - 1) + [True]})

    ends = held.select("conv_id", "piece", "chunk", "cost", "rank").groupBy("conv_id").applyInPandas(met, "piece long, chunk long, state int, cost array<long>, rank array<long>, last boolean")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                _, _, _, choices = backward(bytes(x["code"]), tuple(x["cost"]), tuple(x["rank"]))
                edits, state = forward(choices, x["state"])
                begun = [x["state"]]
                for c in zip(choices, begun, strict=False):
                    begun.append(c[0][c[1]][1])
                if x["last"]:
                    edits[-1] += endings()[2][state]
                n = len(edits)
                yield pa.RecordBatch.from_arrays([pa.array([x["piece"]] * n, pa.int64()), pa.array(x["seq"], pa.int64()), pa.array(x["code"], pa.int32()), pa.array(edits), pa.array(begun[:n], pa.int32())], names=["piece", "seq", "code", "edits", "state"])

    return runtime.reread(held).select("piece", "chunk", "seq", "code").join(ends, ["piece", "chunk"]).mapInArrow(runtime.lean(own), "piece long, seq long, code int, edits string, state int")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of sorted open turns that know their edits; a turn is held at a time."""
    now, tally, cost, out = (), Tally(), 0, []
    for batch in batches:
        for x in batch.to_pylist():
            if now != (x["conv_id"],):
                if now:
                    out.append(tally.row(now[0], cost))
                now, tally, cost = (x["conv_id"],), Tally(), 0
            tally.add(x["turn"], x["code"], x["edits"], x["role"], x["text"])
            cost += spent([x["code"]], [x["edits"]])
        yield pa.RecordBatch.from_pylist(out, RESULT)
        out = []
    if now:
        yield pa.RecordBatch.from_pylist([tally.row(now[0], cost)], RESULT)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of open turns."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            found, _ = lines(x["state"], x["edits"], x["role"], x["text"])
            out += _turns(x["conv_id"], _at(x["piece"], x["seq"]), x["turn"], x["code"], found)
        yield pa.RecordBatch.from_pylist(out, TURN)


def _repaired(rows: DataFrame, full: bool) -> DataFrame:
    spark = rows.sparkSession
    runtime.arrow_limits(spark)
    given = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    given = given.withColumn("role", F.when(F.col("role") == "", " ").otherwise(F.col("role"))).withColumn("own", F.monotonically_increasing_id())
    # The driver samples the keys of ranges, so they hold no whole texts.
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "own"]
    dealt = given.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("own")
    run, schema = _first_pass(full)
    found = runtime.written(dealt.mapInArrow(runtime.lean(run), schema), "dialogue")
    done = found.where("open_seq IS NULL").select(*(TURN if full else RESULT).names)
    left = runtime.reread(found).where("open_seq IS NOT NULL").select(*[F.col(f"open_{n}").alias(n) for n in OPEN.names])
    told = left.drop("code", "key", "chunk").join(_chunk_edits(left), ["piece", "seq"])
    if full:
        return done.unionByName(told.mapInArrow(runtime.lean(_each), _ddl(TURN)))
    ordered = told.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "seq")
    return done.unionByName(ordered.mapInArrow(runtime.lean(_whole), _ddl(RESULT)))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, at, turn, fault, edit, role, text``: each turn's edit and what it becomes, inserts included.

    ``at`` orders a conversation's turns; an insert has that of the turn it stands
    before (or, at the end, behind). Deleted turns (edit D) are as they were.
    """
    return _repaired(rows, True)


def audited(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, the cheapest repair's cost and edits, and a hash of the repaired turns."""
    return _repaired(rows, False)


def damaged(rows: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given to the user, as a checksum of conversation and turn says."""
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    whole = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return whole.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = runtime.table(spark, sf_dir, "conversations")
    found = audited(damaged(given)).select("conv_id", F.struct(*RESULT.names[1:]).alias("r"))
    every = given.select("conv_id").distinct().withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    one = found.unionByName(every).groupBy("conv_id").agg(F.max("r").alias("r"))
    numbers = [F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c) for c in RESULT.names[1:7]]
    return one.select("conv_id", *numbers, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE_SQL: dict[str, str] = {}
