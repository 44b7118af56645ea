"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate, by iterative-deepening A*.

Rows are edited in order: D deletes a row (2; blank and repeated rows must go), I inserts a row without text (5), K keeps one (0), R gives it the role wanted at its place (1);
a truncated row that stays costs 5 more. The role initials that result must be (s?(ua)+)?. What has been put out so far leaves four states: nothing, a system row, a
user row, an assistant row. The search goes depth first through the edits in ASCII order under a bound on the cost so far plus the least cost of the rows to come; a
bound without an answer is raised to the least cost that exceeded it. States (row, last output, inserts in a row) that failed are kept with the largest
budget they failed with. Every accepting path within the last bound costs exactly that bound, so the first one is the answer: cheapest, and least in ASCII.

Conversations may be long. Rows are dealt by ranges of conversation and place, so a conversation spreads over as many tasks as its rows need, and are worked
on in blocks of BLOCK rows. A conversation within one block is solved there. Otherwise each block is solved from each state to each state; FAN blocks
after another become one larger block by the same search over their tables, until one is left. (Inserts count with the row they precede, so two ways through a block of
equal cost never are one the beginning of the other, and the least way through a whole is made of least ways through its parts.) Only the repaired text's hash
reads a conversation in one go, as a stream of blocks: SHA-256 cannot be split.

A null role or text is one space; null turns come first; a null conversation id is an id of its own. Rows of one turn are taken by role, then text. Repeated rows are
duplicates after the first. A role's initial is its first character; an empty role has none, so keeping it changes nothing. Rows marked as gone only
name their conversation. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ROWS, SPACES, cut, query, table

BLOCK = 32
FAN = 64
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = ("su", "ua", "au")
END = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANKS = SPACES.decode()


def wanted(state: int) -> int:
    """The state after the only role that may be written next, system rows aside."""
    return ASSISTANT if state == USER else USER


def kept(state: int, mark: str) -> int | None:
    """The state after keeping a row; None if its role may not stand there."""
    mark = mark.lower()
    if mark == "e":
        return state
    if mark == "s":
        return SYSTEM if state == NOTHING else None
    return wanted(state) if mark == {USER: "u", ASSISTANT: "a"}[wanted(state)] else None


def moves(mark: str, state: int, inserted: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(label, cost, rows taken, state, inserts in a row) in ASCII order. `mark` is a row's initial (o for another, e for none), in upper case if it is truncated, or x if it must go."""
    yield "D", DELETE, 1, state, 0
    if inserted < 2:                                    # three in a row would lead where one does
        yield "I", INSERT, 0, wanted(state), inserted + 1
    if mark != "x":
        extra = TRUNCATED if mark.isupper() else 0
        after = kept(state, mark)
        if after is not None:
            yield "K", extra, 1, after, 0
        yield "R", REROLE + extra, 1, wanted(state), 0


def deepen(n: int, start: int, goal: int | None, least, step) -> tuple[int, str] | None:
    """Cost and labels of the least way from `start` through all n places to `goal` (None: to an accepting state, inserting at the end).

    `least(i, state)` is a lower bound of what is still to come (infinite if there is no way), `step(i, state, inserted)` the moves in ASCII order.
    """
    never = float("inf")
    bound = least(0, start)
    while bound < never:
        failed: dict[tuple[int, int, int], float] = {}
        beyond = never

        def visit(i: int, state: int, inserted: int, left: float) -> str | None:
            nonlocal beyond
            if i == n:
                if goal is not None:
                    return "" if state == goal else None
                tail = INSERT * len(END[state])
                if tail <= left:
                    return END[state]
                beyond = min(beyond, bound - left + tail)
                return None
            key = (i, state, inserted)
            if failed.get(key, -1) >= left:
                return None
            for label, cost, taken, after, again in step(i, state, inserted):
                need = cost + least(i + taken, after)
                if need > left:
                    beyond = min(beyond, bound - left + need)
                    continue
                rest = visit(i + taken, after, again, left - cost)
                if rest is not None:
                    return label + rest
            failed[key] = left
            return None

        found = visit(0, start, 0, bound)
        if found is not None:
            return int(bound), found
        bound = beyond
    return None


def reachable(marks: str, start: int, goal: int | None) -> bool:
    """Whether some edits lead from `start` to `goal`: nothing and a lone system row come from rows only, the others can be inserted before a row."""
    if goal is None or start == goal:
        return True
    if goal == SYSTEM:
        return start == NOTHING and any(c in "sS" for c in marks)
    return goal != NOTHING and bool(marks)


ALONE = {"x": DELETE, "o": REROLE, **{c: min(DELETE, TRUNCATED) for c in "SUAOE"}}     # the least that a row costs wherever it stands


def floors(marks: str, goal: int | None):
    """A lower bound of what rows i onwards cost from a state: what each costs alone, and one edit for each two clean rows after another whose
    roles cannot stand together (no row counted twice; the first one may clash with the state instead). For a goal without user and assistant rows all others must go."""
    n, never = len(marks), float("inf")
    if goal in (NOTHING, SYSTEM):
        gone = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            gone[i] = gone[i + 1] + (0 if marks[i] == "e" else min(DELETE, TRUNCATED) if marks[i] == "E" else DELETE)
        return lambda i, state: never if state > goal else max(0, gone[i] - (DELETE if state < goal else 0))
    alone, pairs, clash = [0] * (n + 1), [0] * (n + 1), [(None, 0)] * (n + 1)
    first = None                                        # the next clean row, if only rows that must go stand before it
    for i in range(n - 1, -1, -1):
        c = marks[i]
        alone[i] = alone[i + 1] + ALONE.get(c, 0)
        pairs[i], clash[i] = pairs[i + 1], clash[i + 1] if c == "x" else (None, 0)
        if c in ("s", "u", "a"):
            if first is not None and c + marks[first] not in LEGAL:
                pairs[i] = max(pairs[i], 1 + pairs[first + 1])
            clash[i], first = (c, pairs[i + 1]), i
        elif c != "x":
            first = None

    def least(i: int, state: int) -> int:
        c, behind = clash[i]
        return alone[i] + (max(pairs[i], 1 + behind) if c and kept(state, c) is None else pairs[i])
    return least


@lru_cache(200_000)
def solve(marks: str, start: int = NOTHING, goal: int | None = None) -> tuple[int, str] | None:
    """Cheapest edits of one block of rows; None if there is no way."""
    if not reachable(marks, start, goal):
        return None
    return deepen(len(marks), start, goal, floors(marks, goal), lambda i, state, inserted: moves(marks[i], state, inserted))


Ways = list  # sixteen entries, by 4 * start + goal: (cost, labels) or None


@lru_cache(50_000)
def ways(marks: str) -> tuple:
    return tuple(solve(marks, a, b) for a in range(4) for b in range(4))


def chain(parts: list[Ways], start: int, goal: int | None) -> tuple[int, str] | None:
    """The least way through solved blocks in a row. What is to come is known exactly from their costs, so the first bound is the right one."""
    n, never = len(parts), float("inf")
    to_go = [[never] * 4 for _ in range(n)] + [[(INSERT * len(END[s]) if goal is None else 0 if s == goal else never) for s in range(4)]]
    for i in range(n - 1, -1, -1):
        to_go[i] = [min((w[0] + to_go[i + 1][b] for b in range(4) if (w := parts[i][4 * a + b])), default=never) for a in range(4)]

    def step(i: int, state: int, inserted: int):
        for labels, cost, b in sorted((w[1], w[0], b) for b in range(4) if (w := parts[i][4 * state + b])):
            yield labels, cost, 1, b, 0
    return deepen(n, start, goal, lambda i, s: to_go[i][s], step)


class Block:
    """What is known of some rows of a conversation that stand in a row: counts, what lies at both ends, and the rows or the ways through them."""

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.ends: list = [None, None]                  # role initials at both ends
        self.low = self.high = None                     # least and largest turn
        self.marks, self.rows, self.last = "", [], None

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        """The next row; `repeated` if an earlier turn has the same."""
        body = text.strip(BLANKS)
        again = repeated or self.last == (turn, role, text)
        initial = role[:1]
        mark = initial if initial in ("s", "u", "a") else "o" if initial else "e"
        if not body:
            self.blank, mark = self.blank + 1, "x"
        elif again:
            self.duplicate, mark = self.duplicate + 1, "x"
        elif body[-1] not in ".!?":
            self.truncated, mark = self.truncated + 1, mark.upper()
        if self.n:
            self.illegal += self.ends[1] + initial not in LEGAL
        else:
            self.ends[0] = initial
        self.ends[1] = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.n += 1
        self.marks += mark
        self.rows.append((role, text))
        self.last = (turn, role, text)

    def follow(self) -> "Block":
        """An empty block for the rows that come next; it knows the last one."""
        out = Block()
        out.last = self.last
        return out


def render(labels: str, rows: list[tuple[str, str]], state: int) -> tuple[list[str], int]:
    """The repaired rows as `role:text`, and the state they leave."""
    out, i = [], 0
    for x in labels:
        if x in "IR":
            state = wanted(state)
            out.append(ROLE[state] + ":" + (rows[i][1] if x == "R" else ""))
        elif x == "K":
            role, text = rows[i]
            initial = role[:1]
            state = kept(state, initial if initial in ("s", "u", "a") else "e")
            out.append(f"{role}:{text}")
        i += x != "I"
    return out, state


def gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
RESULT = "conv_id {id}, n bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
OPEN = "conv_id {id}, part bigint, seq bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first string, last string, costs array<bigint>, labels array<string>"
PASS = OPEN + ", roles array<string>, texts array<string>, whole boolean, gaps bigint, cost bigint, audit string, repaired_sha256 string"


def batch(rows: list[dict], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], names=schema.names)


def arrow_schema(spark: SparkSession, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def sealed(block: Block) -> dict:
    w = ways(block.marks)
    return {"n": block.n, "blank": block.blank, "duplicate": block.duplicate, "truncated": block.truncated, "illegal": block.illegal, "turns": block.turns, "low": block.low, "high": block.high,
            "first": block.ends[0], "last": block.ends[1], "costs": [x and x[0] for x in w], "labels": [x and x[1] for x in w], "roles": [r for r, _ in block.rows], "texts": [t for _, t in block.rows]}


def merged(blocks: list[dict]) -> dict:
    """Blocks in a row as one: counts added up, with what happens at the borders, and the ways through all of them."""
    out = {c: sum(b[c] for b in blocks) for c in COUNTS}
    full = [b for b in blocks if b["n"]]
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:]))
    dated = [b for b in blocks if b["low"] is not None]
    out["turns"] -= sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    out |= {"low": dated[0]["low"], "high": dated[-1]["high"]} if dated else {"low": None, "high": None}
    out |= {"first": full[0]["first"], "last": full[-1]["last"]} if full else {"first": None, "last": None}
    parts = [[None if c is None else (c, x) for c, x in zip(b["costs"], b["labels"])] for b in blocks]
    w = [chain(parts, a, b) for a in range(4) for b in range(4)]
    return out | {"costs": [x and x[0] for x in w], "labels": [x and x[1] for x in w]}


def first_pass(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows in order to finished conversations (`whole`) and to blocks of the others."""
    ddl = PASS.format(id=rows.schema["conv_id"].dataType.simpleString())
    schema = arrow_schema(rows.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, out = TaskContext.get().partitionId(), []
        now, block, seq, closed = None, None, 0, False

        def flush(whole: bool) -> None:
            if whole:
                cost, audit = solve(block.marks)
                text = "\n".join(render(audit, block.rows, NOTHING)[0])
                out.append({"conv_id": now[0], "whole": True, "n": block.n, "blank": block.blank, "duplicate": block.duplicate, "truncated": block.truncated, "illegal": block.illegal,
                            "gaps": gaps(block.low, block.high, block.turns), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()})
            else:
                out.append({"conv_id": now[0], "whole": False, "part": part, "seq": seq} | sealed(block))

        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                for conv, turn, role, text, gone, repeated in zip(*[c.to_pylist() for c in b.slice(i, ROWS).columns]):
                    if now is None or now[0] != conv:
                        if now is not None:
                            flush(closed and seq == 0)  # the first conversation of a task may have begun in another one
                            closed = True
                        now, block, seq = (conv,), Block(), 0
                    if not gone:
                        if block.n == size:
                            flush(False)
                            block, seq = block.follow(), seq + 1
                        block.add(turn, role, text, repeated)
                if out:
                    yield batch(out, schema)
                    out.clear()
        if now is not None:
            flush(False)                                # the last one may go on
            yield batch(out, schema)

    return rows.select("conv_id", "turn", "role", "text", "gone", "repeated").mapInArrow(run, ddl)


def climb(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """One block per conversation, `fan` at a time: first those of one task, then those of tasks after another."""
    ddl = OPEN.format(id=blocks.schema["conv_id"].dataType.simpleString())
    schema = arrow_schema(blocks.sparkSession, ddl)

    def join(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["seq"])
        out = merged(rows) if len(rows) > 1 else rows[0]
        return pa.Table.from_batches([batch([out | {"conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "seq": rows[0]["seq"] // fan}], schema)])

    while True:
        top = blocks.agg(F.max("seq").alias("seq"), F.max("part").alias("part")).first()
        if not top.seq and not top.part:
            return blocks
        if not top.seq:                                 # tasks after another, once each has one block of a conversation
            blocks = blocks.withColumn("seq", F.col("part")).withColumn("part", F.lit(0).cast("bigint"))
        # nulls group like any other id
        blocks = cut(blocks.withColumn("fan", F.expr(f"seq div {fan}")).groupBy("conv_id", "part", "fan").applyInArrow(lambda t: join(t.drop_columns(["fan"])), ddl))


def finish(blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """Results of the conversations that span blocks: the top block comes first and says which edits to make, then the rows stream by."""
    ddl = RESULT.format(id=blocks.schema["conv_id"].dataType.simpleString())
    schema = arrow_schema(blocks.sparkSession, ddl)

    class Open:
        def __init__(self, top: dict):
            table = [None if c is None else (c, x) for c, x in zip(top["costs"], top["labels"])]
            cost, self.audit = chain([table], NOTHING, None)
            self.result = {"conv_id": top["conv_id"], **{c: top[c] for c in COUNTS}, "gaps": gaps(top["low"], top["high"], top["turns"]), "cost": cost, "audit": self.audit}
            self.hash, self.at, self.state, self.begun = hashlib.sha256(), 0, NOTHING, False

        def write(self, labels: str, rows: list[tuple[str, str]]) -> None:
            lines, self.state = render(labels, rows, self.state)
            for x in lines:
                self.hash.update((("\n" if self.begun else "") + x).encode())
                self.begun = True

        def take(self, rows: list[tuple[str, str]]) -> None:
            end, left = self.at, len(rows)              # inserts count with the row they precede
            while left:
                left -= self.audit[end] != "I"
                end += 1
            self.write(self.audit[self.at:end], rows)
            self.at = end

        def close(self) -> dict:
            self.write(self.audit[self.at:], [])
            return self.result | {"repaired_sha256": self.hash.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for i in range(0, b.num_rows, BLOCK):
                for r in b.slice(i, BLOCK).to_pylist():
                    if r["part"] < 0:
                        done += [now.close()] if now else []
                        now = Open(r)
                    else:
                        now.take(list(zip(r["roles"], r["texts"])))
            if done:
                yield batch(done, schema)
        if now:
            yield batch([now.close()], schema)

    rows = tops.withColumn("part", F.lit(-1).cast("bigint")).unionByName(blocks.select("conv_id", "part", "seq", "roles", "texts"), allowMissingColumns=True)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, ddl)


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, gone): the columns of RESULT."""
    place = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.withColumn("place", place).withColumn("same", same)
    again = (rows.filter("NOT gone").groupBy("conv_id", "same").agg(F.min("place").alias("first"), F.max("place").alias("final"))
             .filter("first < final").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first"))
    marked = rows.join(again, rows["conv_id"].eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left").withColumn("repeated", F.coalesce(F.col("place") > F.col("first"), F.lit(False)))
    order = ["conv_id", "turn", "role"]
    dealt = marked.select(*order, "text", "gone", "repeated").repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    found = cut(first_pass(dealt, block))
    blocks = found.filter("NOT whole")
    names = [f.name for f in arrow_schema(rows.sparkSession, OPEN.format(id="string"))]
    whole = found.filter("whole").select([f.name for f in arrow_schema(rows.sparkSession, RESULT.format(id="string"))])
    return whole.unionByName(finish(blocks, climb(blocks.select(names), fan)))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows in the form of `repair` after the damage that the crc32 of conversation and turn picks."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), "fault")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("fault", "copy")


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(damaged(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
