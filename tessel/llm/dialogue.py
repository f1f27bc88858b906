"""Repair of conversations whose turns don't alternate, by the cheapest edits.

The roles of a sound conversation, by their initials, are ``(s?(ua)+)?``: a system turn if any,
then user and assistant in turn.  Every row may be kept (K), given the role user or assistant (R)
or deleted (D), and turns without text may be inserted (I) anywhere; blank rows and repetitions
must be deleted, and keeping a truncated row costs more.  The edits of least total cost are found,
and of those the least in ASCII order.

Method: layers of rising cost in the manner of Wu and Manber.  Going from the last row to the
first, a layer has, for each place, the bitset of grammar states from which the rest can be
brought to an end at exactly that cost; a row's bitset follows from those of cheaper layers by
shifts.  The first layer whose first place accepts gives the cost; the edits are traced forwards
through the bitsets, the least letter first.

Conversations have no bound on their length, so rows are dealt by ranges of (conversation, turn)
and a conversation may lie in many tasks.  A row becomes one byte.  Each task brings its stretch of
a conversation, in blocks of ``BLOCK`` rows, to a table of least costs from state to state, for
which the bitsets hold pairs of states; the tables of a conversation, one for each task at most,
are then combined; each stretch is traced from the states it may start in, and the traces are put
together.  Only conversations that lie in more than one task need that, at most one for each
border between tasks, so the driver combines two tables a task at most.  Only the audit and a
digest of a conversation, which are one value each, are made in one place, as a stream.

Order and edges: rows stand by turn (null first), then role, then text.  A null id is a
conversation of its own; null roles and texts count as one space.  A role that doesn't begin with
``s``, ``u`` or ``a``, or is empty, can't be kept.  Repeated rows are repetitions.  Other columns
are ignored.  A conversation without rows has cost 0, an empty audit and no rows.  Long texts are
read whole.
"""

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessel.functions.joins import join_back
from tessel.functions.ordering import in_order, task_of
from tessel.plans.staging import staged

#: Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows whose layers are worked out together.
BLOCK = 16
SPACE = " \t\n\x0b\x0c\r"
#: A row's byte: the initial's number (0 s, 1 u, 2 a, 3 other), and two flags.
INITIALS, CUT_OFF, DOOMED = "sua", 4, 8
#: Initials that may follow each other.
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: What tells a stretch of a conversation.
STRETCH = ["unnamed", "conv", "task"]

# Grammar states, as bits of a nibble: 1 nothing yet, 2 after s, 4 after u, 8 after a.
# A bitset of pairs has one nibble for each state that the rows may end in.
_EACH = 0x1111


def _before(initial: int, x: int) -> int:
    """The states from which reading the initial leads into ``x``."""
    if initial == 1:
        y = x & _EACH * 4
        return y >> 2 | y >> 1 | y << 1
    if initial > 2:
        return 0
    return (x & _EACH * 8) >> 1 if initial == 2 else (x & _EACH * 2) >> 1


def _after(initial: int, state: int) -> int:
    """The state after reading the initial in ``state``, -1 if it can't be read there."""
    if initial == 0:
        return 1 if state == 0 else -1
    if initial == 1:
        return 2 if state != 2 else -1
    return 3 if initial == 2 and state == 2 else -1


def _layers(codes: bytes, ends: dict[int, int], wanted: int) -> list[list[int]]:
    """Bitsets by cost and place; ``ends`` has the bits that the last place starts with, by cost.

    The layers stop when those of the first place have met all ``wanted`` bits.
    """
    n, layers, met, last = len(codes), [], 0, max(ends)
    none = [0] * (n + 1)
    while wanted & ~met or len(layers) <= last:
        cost = len(layers)
        less = [layers[cost - c] if cost >= c else none for c in (REROLE, DELETE, INSERT, REROLE + TRUNCATED)]
        rerole, delete, insert, both = less
        now = [0] * (n + 1)
        now[n] = x = ends.get(cost, 0)
        for i in range(n - 1, -1, -1):
            code = codes[i]
            kind = code & 3
            x = _inside(x, kind, code, i, rerole, delete, insert, both)
            now[i] = x
        met |= now[0]
        layers.append(now)
        if len(layers) > (DELETE + 1) * n + 8 * INSERT + last:
            break
    return layers


def _inside(kept: int, kind: int, code: int, i: int, rerole: list, delete: list, insert: list, both: list) -> int:
    """The bitset before row ``i``: ``kept`` is this layer's after it, the others those of cheaper ones."""
    y = insert[i]
    x = delete[i + 1] | _before(1, y) | _before(2, y)
    if code & DOOMED:
        return x
    if code & CUT_OFF:
        y = both[i + 1]
        return x | _before(kind, insert[i + 1]) | _before(1, y) | _before(2, y)
    y = rerole[i + 1]
    return x | _before(kind, kept) | _before(1, y) | _before(2, y)


#: Pairs (from, to) that can be: to any state from the first, to the later ones from the others.
_PAIRS = 0x0001 | 0x0030 | 0x0F00 | 0xF000
INF = 1 << 60


@lru_cache(100_000)
def block_costs(codes: bytes) -> tuple[tuple[int, ...], ...]:
    """``[from][to]``: the least cost of a block's edits between two states."""
    layers = _layers(codes, {0: 0x8421}, _PAIRS)
    out = [[INF] * 4 for _ in range(4)]
    for cost, layer in enumerate(layers):
        for to in range(4):
            for at in range(4):
                if layer[0] >> (4 * to + at) & 1 and out[at][to] == INF:
                    out[at][to] = cost
    return tuple(map(tuple, out))


def costs_before(table: tuple, after: list[int]) -> list[int]:
    """Least costs to the end from each state, before rows with that table and ``after`` them."""
    return [min(INF, *(c + v for c, v in zip(row, after, strict=True))) for row in table]


def joined_costs(a: tuple, b: tuple) -> tuple:
    """The table of two stretches in a row."""
    columns = list(zip(*b, strict=True))
    return tuple(tuple(min(INF, *(x + y for x, y in zip(row, col, strict=True))) for col in columns) for row in a)


@lru_cache(100_000)
def trace_block(codes: bytes, after: tuple[int, ...], start: int) -> tuple[str, int]:
    """The least audit of a block from a state, given the least costs after it; and the state it ends in."""
    ends: dict[int, int] = {}
    for state, cost in enumerate(after):
        if cost < INF:
            ends[cost] = ends.get(cost, 0) | 1 << state
    layers = _layers(codes, ends, 1 << start)
    left = next((c for c, layer in enumerate(layers) if layer[0] >> start & 1), None)
    if left is None:
        return "", -1
    state, i, audit = start, 0, []
    has = lambda cost, place, at: at >= 0 and cost >= 0 and layers[cost][place] >> at & 1
    while i < len(codes):
        code = codes[i]
        more = TRUNCATED if code & CUT_OFF else 0
        given = _after(1, state) if state != 2 else 3
        kept = _after(code & 3, state)
        if has(left - DELETE, i + 1, state):
            step, left, i = "D", left - DELETE, i + 1
        elif has(left - INSERT, i, given):
            step, left, state = "I", left - INSERT, given
        elif not code & DOOMED and has(left - more, i + 1, kept):
            step, left, state, i = "K", left - more, kept, i + 1
        else:
            step, left, state, i = "R", left - REROLE - more, given, i + 1
        audit.append(step)
    return "".join(audit), state


#: Least costs, and audits, that bring a conversation to its end in each state: by inserted turns.
CLOSING = (0, 2 * INSERT, INSERT, 0)


def blocks(codes: bytes) -> list[bytes]:
    """A stretch's rows in blocks."""
    return [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)]


def stretch_costs(codes: bytes) -> tuple:
    """The table of a whole stretch."""
    table = tuple(tuple(0 if a == b else INF for b in range(4)) for a in range(4))
    for block in blocks(codes):
        table = joined_costs(table, block_costs(block))
    return table


def trace_stretch(codes: bytes, after: tuple[int, ...], starts: list[int]) -> dict[int, tuple[str, int, int]]:
    """For each state that a stretch may start in: its least audit, the state it ends in and its cost.

    States from which there is no way to the end are left out.
    """
    parts, costs = blocks(codes), [list(after)]
    for block in reversed(parts):
        costs.append(costs_before(block_costs(block), costs[-1]))
    costs.reverse()
    out = {}
    for start in starts:
        state, audit = start, []
        for k, block in enumerate(parts):
            if state < 0:
                break
            base = min(costs[k + 1])
            step, state = trace_block(block, tuple(c - base if c < INF else INF for c in costs[k + 1]), state)
            audit.append(step)
        if state >= 0 and costs[0][start] < INF:
            out[start] = ("".join(audit), state, costs[0][start] - after[state])
    return out


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str]]:
    """The rows ``(role, text)`` after a stretch's edits."""
    for step in audit:
        given = "assistant" if state == 2 else "user"
        if step == "I":
            yield given, ""
        else:
            role, text = next(rows)
            if step == "D":
                continue
            yield (given if step == "R" else role), text
            if step == "K":
                state = _after(INITIALS.find(role[:1]), state)
                continue
        state = 3 if state == 2 else 2


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", modulus: int = 20) -> DataFrame:
    """The rows with faults that their ids draw, and ``times``: how often each is there.

    By crc32 of ``id:turn`` modulo ``modulus``: 0 drops the row (0 times), 1 empties its text, 2
    takes its ``.``, ``!`` and ``?`` out, 3 has it twice, 4 gives it the role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said(id_col), F.lit(":"), said(turn_col)).cast("binary")) % modulus
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    role = F.when(draw == 4, "user").otherwise(said(role_col))
    times = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    return rows.select(id_col, turn_col, role.alias(role_col), text.alias(text_col), times.alias("times"))


def _faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it ends without a stop."""
    end = F.rtrim(text, F.lit(SPACE))
    return end == "", ~F.right(end, F.lit(1)).isin(".", "!", "?")


def ordered_rows(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows in order, as a table: ``unnamed, conv, timeless, turn, role, text, n, code, at``.

    Equal rows are one with a count ``n``, which is 0 for a row that isn't there; ``code`` is the
    byte of the first of them.
    """
    kind = dict(rows.dtypes)[id_col]
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    plain = rows.select(
        F.col(id_col).isNull().cast("int").alias("unnamed"), F.coalesce(F.col(id_col), F.lit("0").cast(kind)).alias("conv"),
        F.col(turn_col).isNotNull().cast("int").alias("timed"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), times.cast("long").alias("times"),
    )
    each = plain.groupBy("unnamed", "conv", "timed", "turn", "role", "text").agg(F.sum("times").alias("n"))
    each = each.withColumn("digest", F.md5("text"))
    said = F.when(F.col("n") > 0, F.struct("timed", "turn"))
    firsts = each.groupBy("unnamed", "conv", "role", "digest").agg(F.min(said).alias("first"))
    each = join_back(each, firsts, "unnamed", "conv", "role", "digest")
    blank, open_end = _faults(F.col("text"))
    again = (F.col("timed") > F.col("first.timed")) | (F.col("turn") > F.col("first.turn"))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    fault = F.when(blank, 1).when(again, 2).when(open_end, 3).otherwise(0)
    each = each.select("unnamed", "conv", "timed", "turn", "role", "text", "n", initial.cast("int").alias("initial"), fault.alias("fault"))
    return in_order(each, "unnamed", "conv", "timed", "turn", "role", "text").withColumn("task", task_of("at"))


def _streamed(df: DataFrame, keys: list[str], shape: str, each: Callable[[tuple, Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """What ``each`` makes of every run of rows that agree in the keys; rows are read as they are met."""
    names = [part.split()[0] for part in shape.split(", ")]
    target = to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
        held, size = [], 0
        for key, run in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            for row in each(key, run):
                held.append(row)
                size += 64 + sum(len(v) for v in row.values() if isinstance(v, str | bytes))
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(held, target)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], target)

    return df.mapInArrow(read, shape)


def stretches(rows: DataFrame) -> DataFrame:
    """For each conversation and task: the bytes of its rows, counts, both ends and the table of costs."""
    light = rows.select(*STRETCH, "at", "timed", "turn", "initial", "fault", "n").repartition(*STRETCH).sortWithinPartitions(*STRETCH, "at")
    shape = f"unnamed int, conv {dict(rows.dtypes)['conv']}, task long, codes binary, blank long, duplicate long, truncated long, illegal long, head int, tail int, low long, high long, turns long, costs array<long>"

    def each(key, run):
        codes, counts, illegal, tail, turns, low, high = bytearray(), [0, 0, 0, 0], 0, None, 0, None, None
        for r in run:
            n, fault, initial = r["n"], r["fault"], r["initial"]
            if not n:
                continue
            codes.append(initial | (CUT_OFF if fault == 3 else 0) | (DOOMED if fault in (1, 2) else 0))
            codes.extend(bytes([initial | DOOMED]) * (n - 1))
            counts[fault] += 1
            counts[1 if fault == 1 else 2] += n - 1
            illegal += (tail is not None and (tail, initial) not in LEGAL) + n - 1
            tail = initial
            if r["timed"]:
                turns += r["turn"] != high
                low, high = (r["turn"] if low is None else low), r["turn"]
        table = [c for row in stretch_costs(bytes(codes)) for c in row]
        yield dict(zip(STRETCH, key, strict=True)) | dict(zip(("blank", "duplicate", "truncated"), counts[1:], strict=True)) | {
            "codes": bytes(codes), "illegal": illegal, "head": codes[0] & 3 if codes else None, "tail": tail, "low": low, "high": high, "turns": turns, "costs": table,
        }

    return staged(_streamed(light, STRETCH, shape, each), "stretches")


def _split(parts: DataFrame) -> dict[tuple, list]:
    """The stretches of the conversations that lie in several tasks, in order; at most two for each task."""
    spans = parts.groupBy("unnamed", "conv").agg(F.count(F.lit(1)).alias("tasks")).where("tasks > 1").drop("tasks")
    found: dict[tuple, list] = {}
    for r in parts.join(F.broadcast(spans), ["unnamed", "conv"], "left_semi").drop("codes").collect():
        found.setdefault((r["unnamed"], r["conv"]), []).append(r)
    return {k: sorted(v, key=lambda r: r["task"]) for k, v in found.items()}


def audits(parts: DataFrame, split: dict[tuple, list]) -> DataFrame:
    """``(unnamed, conv, task, start, audit, finish, cost)``: each stretch's edits as they are in the whole."""
    after: dict[tuple, tuple] = {}
    for key, found in split.items():
        costs = list(CLOSING)
        for r in reversed(found):
            after[(*key, r["task"])] = tuple(costs)
            costs = costs_before([r["costs"][4 * a : 4 * a + 4] for a in range(4)], costs)
    first = {(*key, found[0]["task"]) for key, found in split.items()}
    last = {(*key, found[-1]["task"]) for key, found in split.items()}
    shape = f"unnamed int, conv {dict(parts.dtypes)['conv']}, task long, start int, audit string, finish int, cost long"

    def each(key, run):
        within = key in after
        for r in run:
            found = trace_stretch(r["codes"], after.get(key, CLOSING), [0] if not within or key in first else [0, 1, 2, 3])
            for start, (audit, finish, cost) in found.items():
                if not within or key in last:
                    audit, cost = audit + "I" * (CLOSING[finish] // INSERT), cost + CLOSING[finish]
                yield dict(zip(STRETCH, key, strict=True)) | {"start": start, "audit": audit, "finish": finish, "cost": cost}

    traced = staged(_streamed(parts.select(*STRETCH, "codes"), STRETCH, shape, each), "audits")
    if not split:
        return traced
    # the way through the stretches, from the ends of at most eight traces a task
    inside = F.broadcast(parts.sparkSession.createDataFrame([(*k, True) for k in after], f"unnamed int, conv {dict(parts.dtypes)['conv']}, task long, within boolean"))
    marked = traced.join(inside, STRETCH, "left")
    ends = {(r["unnamed"], r["conv"], r["task"], r["start"]): r["finish"] for r in marked.where("within").select(*STRETCH, "start", "finish").collect()}
    way = []
    for key, found in split.items():
        state = 0
        for r in found:
            way.append((*key, r["task"], state))
            state = ends[(*key, r["task"], state)]
    chosen = F.broadcast(parts.sparkSession.createDataFrame(way, f"unnamed int, conv {dict(parts.dtypes)['conv']}, task long, start int"))
    return marked.where("within is null").drop("within").unionByName(traced.join(chosen, [*STRETCH, "start"], "left_semi"))


def _bridges(split: dict[tuple, list]) -> list[tuple]:
    """``(unnamed, conv, illegal, turns)``: what the borders between stretches add to the counts."""
    out = []
    for key, found in split.items():
        full = [r for r in found if r["tail"] is not None]
        timed = [r for r in found if r["low"] is not None]
        illegal = sum((a["tail"], b["head"]) not in LEGAL for a, b in pairwise(full))
        out.append((*key, illegal, -sum(a["high"] == b["low"] for a, b in pairwise(timed))))
    return out


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conversations, rows)``: what was found and edited in each conversation, and its rows repaired.

    ``conversations`` has ``id, gaps, blank, duplicate, truncated, illegal, cost, audit``; ``rows``
    has ``id, part, place, role, text``, in order by part and place.  Where ``rows`` has a column
    ``times``, a row is there that often.
    """
    kept = ordered_rows(rows, id_col, turn_col, role_col, text_col)
    parts = stretches(kept)
    split = _split(parts)
    pieces = audits(parts, split)

    kind, whole = dict(parts.dtypes)["conv"], ["unnamed", "conv"]
    counts = ("blank", "duplicate", "truncated", "illegal", "turns")
    said = parts.groupBy(*whole).agg(*[F.sum(c).alias(c) for c in counts], F.min("low").alias("low"), F.max("high").alias("high"))
    edits = pieces.groupBy(*whole).agg(F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("task", "audit"))).alias("audits"))  # a piece for each task
    found = said.join(edits, whole)
    if split:
        bridges = F.broadcast(parts.sparkSession.createDataFrame(_bridges(split), f"unnamed int, conv {kind}, more long, fewer long"))
        found = found.join(bridges, whole, "left").withColumn("illegal", F.col("illegal") + F.coalesce("more", F.lit(0))).withColumn("turns", F.col("turns") + F.coalesce("fewer", F.lit(0)))
    name = F.when(F.col("unnamed") == 0, F.col("conv")).alias(id_col)
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    audit = F.array_join(F.transform("audits", lambda x: x["audit"]), "")
    conversations = found.select(name, gaps.alias("gaps"), *counts[:4], "cost", audit.alias("audit"))

    none = F.lit(None)
    edited = pieces.select(*STRETCH, F.lit(-1).cast("long").alias("at"), F.col("audit").alias("text"), none.cast("string").alias("role"), F.col("start").cast("long").alias("n"))
    both = edited.unionByName(kept.select(*STRETCH, "at", "text", "role", "n").where("n > 0"))
    both = both.repartition(*STRETCH).sortWithinPartitions(*STRETCH, "at")

    def each(key, run):
        first = next(run)
        source = ((r["role"], r["text"]) for r in run for _ in range(r["n"]))
        for place, (role, text) in enumerate(repaired_rows(first["text"], source, first["n"])):
            yield dict(zip(STRETCH, key, strict=True)) | {"place": place, "role": role, "text": text}

    done = _streamed(both, STRETCH, f"unnamed int, conv {kind}, task long, place long, role string, text string", each)
    return conversations, done.select(name, F.col("task").alias("part"), "place", F.col("role").alias(role_col), F.col("text").alias(text_col))


def digests(rows: DataFrame, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, repaired_sha256)`` of repaired rows: the digest of their ``role:text`` lines.

    A digest goes through its conversation from start to end, so one task reads it, as a stream.
    """
    known = rows.select(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("conv"), "part", "place", F.concat(F.col(role_col), F.lit(":"), F.col(text_col)).alias("line"))
    dealt = known.repartition("unnamed", "conv").sortWithinPartitions("unnamed", "conv", "part", "place")

    def each(key, run):
        hashed = hashlib.sha256(next(run)["line"].encode())
        for r in run:
            hashed.update(b"\n" + r["line"].encode())
        yield {"conv": key[1], "repaired_sha256": hashed.hexdigest()}

    out = _streamed(dealt, ["unnamed", "conv"], f"conv {dict(known.dtypes)['conv']}, repaired_sha256 string", each)
    return out.withColumnRenamed("conv", id_col)
