"""Time encodings, message aggregation and per-node memory."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.joins import join_back
from tessel.functions.ordering import place_within
from tessel.functions.vectors import vector_avg
from tessel.model import GraphError
from tessel.plans.staging import cut, staged


def time_encode(t: Column, frequency: list[float], phase: list[float]) -> Column:
    """cos(w t + b) for each frequency."""
    return F.array(*[F.cos(t * w + b) for w, b in zip(frequency, phase, strict=True)])


def both_ends(events: DataFrame, message: str = "msg") -> DataFrame:
    """``(id, t, pos, msg)``: every event's message at its source and at its destination."""
    ends = F.array(F.struct(F.col("src").alias("id"), (F.col("e_id") * 2).alias("pos")), F.struct(F.col("dst").alias("id"), (F.col("e_id") * 2 + 1).alias("pos")))
    return events.select(F.explode(ends).alias("x"), "t", message).select("x.id", "t", "x.pos", F.col(message).alias("msg"))


def last_messages(messages: DataFrame) -> DataFrame:
    """``(id, t, msg)``: each node's message of the latest time; ties go to the first position."""
    picked = F.max_by(F.struct("t", "msg"), F.struct("t", -F.col("pos")))
    return messages.groupBy("id").agg(picked.alias("x")).select("id", "x.t", "x.msg")


def mean_messages(messages: DataFrame, width: int) -> DataFrame:
    """``(id, t, msg)``: each node's mean message and latest time."""
    return messages.groupBy("id").agg(F.max("t").alias("t"), vector_avg(F.col("msg"), width).alias("msg"))


def memory_update(memory: DataFrame, messages: DataFrame, cell: dict, size: int) -> DataFrame:
    """``(id, x, t)``: one batch's step of every node's memory by a GRU; nodes without a message stay.

    All of the batch reads the memory from before the batch.
    """
    from tessel.operators.layers import gru

    met = memory.join(messages.select("id", F.col("t").alias("__t"), "msg"), "id", "left")
    stepped = gru(F.col("msg"), F.col("x"), cell, size)
    return met.select("id", F.when(F.col("msg").isNull(), F.col("x")).otherwise(stepped).alias("x"), F.coalesce("__t", "t").alias("t"))


def decayed_sums(rows: DataFrame, decay: float, keys: list[str], order: str, value: str = "value", name: str = "state") -> DataFrame:
    """``rows`` with the sum of a key's values so far, each multiplied by ``decay`` for every row since.

    The step ``s -> decay * s + value`` is an affine map, and maps compose: a key's rows are cut
    into blocks, a window sums within each, and the sums of the blocks are carried on in the same
    way with the decay of a whole block.  A block is as long as powers of the decay stay well
    within a double, so a key with most rows is spread over its blocks.  A decay below 1e-150
    counts as 0.
    """
    if abs(decay) < 1e-150:
        return rows.withColumn(name, F.col(value).cast("double"))
    width = max(2, min(1024, int(100 / max(abs(math.log10(abs(decay))), 1e-9))))
    placed = staged(place_within(rows, keys, order, name="__p"), "decayed")
    placed = placed.withColumn("__b", F.floor(F.col("__p") / width)).withColumn("__k", F.col("__p") % width)
    power = lambda k: F.pow(F.lit(float(decay)), k)
    inside = F.sum(F.col(value) * power(-F.col("__k"))).over(W.partitionBy(*keys, "__b").orderBy("__k"))
    summed = staged(placed.withColumn("__s", inside * power(F.col("__k"))), "decayed")
    ends = summed.where(F.col("__k") == width - 1).select(*keys, F.col("__b").alias("__o"), F.col("__s").alias("__v"))
    if ends.isEmpty():
        return summed.withColumn(name, F.col("__s")).drop("__p", "__b", "__k", "__s")
    before = decayed_sums(ends, decay**width, keys, "__o", "__v", "__carry").select(*keys, (F.col("__o") + 1).alias("__b"), F.col("__carry").alias("__before"))
    carried = F.coalesce("__before", F.lit(0.0)) * power(F.col("__k") + 1)
    return summed.join(before, [*keys, "__b"], "left").withColumn(name, F.col("__s") + carried).drop("__p", "__b", "__k", "__s", "__before")


def replay(events: DataFrame, batches: str = "batch", decay: float = 0.5) -> DataFrame:
    """``(id, batch, state)``: a node's exponentially decayed sum of values after each of its batches."""
    sums = events.groupBy("id", F.col(batches).alias("batch")).agg(F.sum("value").alias("value"))
    return decayed_sums(sums, decay, ["id"], "batch").select("id", "batch", "state")


def memory_over_batches(
    events: DataFrame, memory: DataFrame, cell: dict, size: int, frequency: list[float], phase: list[float], aggregate: str = "last", unit: float = 1e6
) -> DataFrame:
    """``(id, batch, x, t)``: every node's memory after each batch of ``events(e_id, src, dst, t, batch, raw)``.

    A batch gives both ends of its events a message of the node's and the partner's memory from
    before the batch, the raw vector and the encoded time since the node's last update; a node's
    messages are aggregated (the ``last``, of the first event among the latest, or their ``mean``)
    and a GRU steps its memory, which starts as ``memory(id, x, t)``.

    Batches aren't played one by one: a round steps, for all nodes at once, every batch whose
    memories are known, so there are as many rounds as the longest chain of batches that wait for
    each other.  Messages of a node and batch are combined before they are shuffled, for ``last``
    to one event before any memory is read.
    """
    from tessel.operators.layers import gru

    end = lambda a, b, pos: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), (F.col("e_id") * 2 + pos).alias("pos"))
    ends = events.select(F.explode(F.array(end("src", "dst", 0), end("dst", "src", 1))).alias("x"), "t", "batch", "raw").select("x.*", "t", "batch", "raw")
    if aggregate == "last":
        picked = F.max_by(F.struct("other", "t", "raw"), F.struct("t", -F.col("pos")))
        ends = ends.groupBy("id", "batch").agg(picked.alias("x")).select("id", "batch", "x.*")
    elif aggregate != "mean":
        raise GraphError(f"no aggregate {aggregate!r}")
    both = events.select(F.explode(F.array("src", "dst")).alias("id"), "batch").distinct()
    steps = place_within(both, ["id"], "batch", name="k")  # a node's batches, numbered from 0
    steps = staged(steps, "batches")
    # the number of a node's batches before a batch in which its partner has an event
    own = steps.select("id", "batch", "k")
    ends = ends.join(own, ["id", "batch"]).join(own.select(F.col("id").alias("other"), "batch", F.col("k").alias("other_k")), ["other", "batch"])
    ends = staged(ends, "ends")

    start = memory.select("id", F.lit(0).cast("long").alias("k"), F.col("x").cast("array<double>").alias("x"), F.col("t").cast("long").alias("t"))
    known = staged(start, "memory")  # k batches done
    waiting = ends.select("id", "k", "other", "other_k").distinct()
    made = None
    while True:
        have = known.select("id", "k")
        late = waiting.join(have.withColumnsRenamed({"id": "other", "k": "other_k"}), ["other", "other_k"], "left_anti").select("id", "k").distinct()
        ready = waiting.select("id", "k").distinct().join(late, ["id", "k"], "left_anti").join(have, ["id", "k"], "left_semi")
        ready = cut(ready)
        if ready.isEmpty():
            break
        a = known.select("id", "k", F.col("x").alias("__a"), F.col("t").alias("__t"))
        b = known.select(F.col("id").alias("other"), F.col("k").alias("other_k"), F.col("x").alias("__b"))
        met = ends.join(ready, ["id", "k"], "left_semi").join(a, ["id", "k"]).join(b, ["other", "other_k"])
        message = F.concat("__a", "__b", "raw", time_encode((F.col("t") - F.col("__t")) / unit, frequency, phase))
        told = met.select("id", "k", "batch", "t", message.alias("msg"))
        if aggregate == "mean":
            told = told.groupBy("id", "k", "batch").agg(F.max("t").alias("t"), vector_avg(F.col("msg"), len(cell["ir"][0])).alias("msg"))
        stepped = join_back(told, a.select("id", "k", "__a"), "id", "k").select("id", "k", "batch", gru(F.col("msg"), F.col("__a"), cell, size).alias("x"), "t")
        stepped = staged(stepped, "stepped")
        made = stepped if made is None else made.unionByName(stepped)
        known = known.unionByName(stepped.select("id", (F.col("k") + 1).alias("k"), "x", "t"))
        waiting = cut(waiting.join(ready, ["id", "k"], "left_anti"))
    if not waiting.isEmpty():
        raise GraphError("an event has an end that has no memory")
    if made is None:
        return known.select("id", F.lit(None).cast("long").alias("batch"), "x", "t").where(F.lit(False))
    return made.select("id", "batch", "x", "t")


def event_messages(events: DataFrame, memory: DataFrame, raw: str, frequency: list[float], phase: list[float], unit: float = 1e6) -> DataFrame:
    """``events`` with ``msg``: both ends' memory, the raw message and the encoded time since the source's last update."""
    a = memory.select(F.col("id").alias("src"), F.col("x").alias("__a"), F.col("t").alias("__t"))
    b = memory.select(F.col("id").alias("dst"), F.col("x").alias("__b"))
    met = events.join(a, "src").join(b, "dst")
    return met.withColumn("msg", F.concat("__a", "__b", raw, time_encode((F.col("t") - F.col("__t")) / unit, frequency, phase))).drop("__a", "__b", "__t")
