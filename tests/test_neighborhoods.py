"""Seeded neighbourhoods, history, negatives, walks, rows of matrices and memories: plain programs and hubs."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.functions import draws, ordering
from tessel.functions.batches import gathered
from tessel.model import GraphError, PropertyGraph
from tessel.operators import history, neighborhoods, sampling, sparse, temporal, traverse


@pytest.fixture(scope="module")
def hub(spark):
    """Node 0 has nine in ten of 3000 edges; times rise with the ids, some are equal."""
    rng = random.Random(2)
    rows = [(i, 0 if rng.random() < 0.9 else rng.randrange(60), rng.randrange(60), i // 2) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "e_id long, src long, dst long, t long").cache()


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_and_totals(spark, many_tasks):
    rng = random.Random(1)
    rows = [(rng.randrange(500), i, rng.randrange(5), rng.randrange(9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, tie long, g long, v long")
    want = {r: i for i, r in enumerate(sorted(rows))}
    got = {tuple(r)[:4]: r["position"] for r in ordering.with_position(df, "k", "tie", rows_per_range=100).collect()}
    assert got == want
    places = defaultdict(list)
    for r in ordering.place_within(df, ["g"], "k", "tie").collect():
        places[r["g"]].append((r["place"], r["k"], r["tie"]))
    for g, found in places.items():
        assert [x[1:] for x in sorted(found)] == sorted((k, tie) for k, tie, h, _ in rows if h == g) and sorted(x[0] for x in found) == list(range(len(found)))
    total, before = 0, {}
    for _, tie, _, v in sorted(rows, key=lambda r: r[1]):
        before[tie] = total
        total += v
    assert {r["tie"]: r["before"] for r in ordering.running_total(df, "tie", "v").collect()} == before


def past(rows, t, strict, window, last):
    seen = sorted(((u, e) for e, _, _, u in rows if (u < t if strict else u <= t)))
    seen = seen[-last:] if last else seen
    return {e for u, e in seen if window is None or u >= t - window}


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize(("window", "last"), [(None, 7), (40, None), (40, 7), (0, None), (None, None)])
def test_history_without_a_key(spark, hub, many_tasks, strict, window, last):
    rows, edges = hub
    asked = [(i, t) for i, t in enumerate([0, 1, 5, 700, 700, 1499, 9999, -3])]
    events = spark.createDataFrame(asked, "q long, t long")
    out = sampling.history(edges, events, strict=strict, window=window, last=last)
    assert out.columns == ["e_id", "src", "dst", "t", "q"]
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    found = defaultdict(set)
    for r in out.collect():
        assert r["e_id"] not in found[r["q"]]
        found[r["q"]].add(r["e_id"])
    assert all(found[q] == past(rows, t, strict, window, last) for q, t in asked)


@pytest.mark.parametrize("strict", [True, False])
def test_stretches_of_a_window(spark, many_tasks, monkeypatch, strict):
    monkeypatch.setattr(history, "STRETCH_BITS", 2)
    monkeypatch.setattr(history, "TASK_ROWS", 40)
    rng = random.Random(7)
    rows = [(i, f"n{i % 3}", rng.choice([50, 50, rng.randrange(-200, 400), None])) for i in range(400)]
    asked = [(i, rng.choice([50, 90, rng.randrange(-200, 500), None])) for i in range(150)]
    edges, events = spark.createDataFrame(rows, "e_id long, tag string, t long"), spark.createDataFrame(asked, "q long, t long")
    for window in (0, 40):
        found = history.events_within(edges, events, window, strict)
        want = [(q, e, tag, t) for e, tag, t in rows for q, u in asked if t is not None and u is not None and t >= u - window and (t < u if strict else t <= u)]
        assert found.columns == ["q", "e_id", "tag", "t"]
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
        assert found.rdd.getNumPartitions() == 10
        assert "Coalesce 10" in found._jdf.queryExecution().executedPlan().toString()  # lists of one pair are buffered at once


def test_window_rows_are_written_as_repetitions(spark, tmp_path):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:  # large tables aren't broadcast
        spark.conf.set(key, "-1")
    edges = spark.range(500).select(F.col("id").alias("e_id"), (F.col("id") * 7).alias("t"))
    events = spark.range(20_000).select((F.col("id") * 7919 % 1_000_003).alias("q"), (3500 + F.col("id") % 3500).alias("t"))
    found = history.events_within(edges, events, 3500).select("q", "e_id")
    found.write.option("parquet.dictionary.page.size", "8192").parquet(str(tmp_path / "found"))  # as one of 1 MB is to larger tables
    for key in keys:
        spark.conf.unset(key)
    written = sum(p.stat().st_size for p in (tmp_path / "found").glob("*.parquet"))
    rows = spark.read.parquet(str(tmp_path / "found")).count()
    assert rows == sum(500 - math.ceil(i % 3500 / 7) for i in range(20_000))
    assert written < rows


def test_history_of_a_hub(spark, hub, many_tasks):
    rows, edges = hub
    events = edges.where("e_id % 7 = 0").select(F.col("e_id").alias("q"), "src", "dst", "t")
    for window, last in ((None, 3), (25, None), (25, 3)):
        found = defaultdict(set)
        for r in sampling.history(edges, events, window=window, last=last, on=[("src", "src")]).collect():
            found[r["q"]].add(r["e_id"])
        for e, s, _, t in rows:
            if e % 7 == 0:
                assert found[e] == past([x for x in rows if x[1] == s], t, True, window, last)


def drawn(seed, *parts):
    import hashlib

    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16)


def reached(edges, seeds, caps, seed, request):
    """``edges``: (type, src, type, dst); nodes by (type, id) with their hop."""
    near = defaultdict(set)
    for a, s, b, d in edges:
        near[(a, s)].add((b, d))
        near[(b, d)].add((a, s))
    seen = dict.fromkeys(seeds, 0)
    for hop, cap in enumerate(caps, 1):
        new = {x for n, h in seen.items() if h == hop - 1 for x in near[n]} - set(seen)
        for kind in {k for k, _ in new}:
            mine = sorted((drawn(seed, hop, request, i), i) for k, i in new if k == kind)
            for _, i in mine if cap < 0 else mine[:cap]:
                seen[(kind, i)] = hop
    return seen


def checked(found, edges, requests, caps, seed):
    """``edges``: {name: (type, type, [(e_id, src, dst)])}; ``requests``: {request: (seeds, edges allowed)}."""
    nodes, links = defaultdict(dict), defaultdict(set)
    for r in found.nodes.collect():
        nodes[r["request"]][(r["type"], r["id"])] = (r["hop"], r["new_id"])
    for r in found.edges.collect():
        key = (r["relation"], r["e_id"], r["src"], r["dst"])
        assert key not in links[r["request"]]
        links[r["request"]].add(key)
    for q, (seeds, allowed) in requests.items():
        usable = [(a, s, b, d) for n, (a, b, rows) in edges.items() for e, s, d in rows if allowed(n, e)]
        want = reached(usable, seeds, caps, seed, q)
        assert {n: h for n, (h, _) in nodes[q].items()} == want
        for kind in {k for k, _ in want}:
            assert [nodes[q][(kind, i)][1] for i in sorted(i for k, i in want if k == kind)] == list(range(sum(k == kind for k, _ in want)))
        among = {(n, e, nodes[q][(a, s)][1], nodes[q][(b, d)][1]) for n, (a, b, rows) in edges.items() for e, s, d in rows if allowed(n, e) and (a, s) in want and (b, d) in want}
        assert links[q] == among


def test_node_neighbourhoods_of_a_typed_graph(spark):
    rng = random.Random(4)
    rows = {"likes": ("u", "p", [(i, rng.randrange(20), 0 if rng.random() < 0.8 else rng.randrange(30)) for i in range(200)]), "made": ("m", "p", [(i, rng.randrange(5), rng.randrange(30)) for i in range(60)])}
    edges = {(a, n, b): spark.createDataFrame(e, "e_id long, src long, dst long") for n, (a, b, e) in rows.items()}
    nodes = {k: spark.range(n).toDF("id") for k, n in (("u", 20), ("p", 30), ("m", 5))}
    graph = PropertyGraph.typed(nodes, edges)
    seeds = [(1, "u", 3), (1, "u", 4), (2, "p", 0), (3, "m", 1), (3, "m", 1)]
    requests = {q: ({(k, i) for r, k, i in seeds if r == q}, lambda n, e: True) for q in (1, 2, 3)}
    frame = spark.createDataFrame(seeds, "request long, type string, id long")
    for caps in ([3, 4], [-1], [2, -1, 2]):
        found = neighborhoods.node_neighbourhoods(graph, frame, caps, seed=9)
        checked(found, rows, requests, caps, 9)
    assert found.with_features({"u": spark.createDataFrame([(3, 0.5)], "id long, x double")})["u"].where("id = 3").first()["x"] == 0.5
    with pytest.raises(GraphError):
        neighborhoods.node_neighbourhoods(graph, frame, [0])


def test_link_neighbourhoods_at_a_hub(spark, hub, many_tasks):
    rows, edges = hub
    graph = PropertyGraph.homogeneous(spark.range(60).toDF("id"), edges.select("e_id", "src", "dst"))
    records = [(e, s, d) for e, s, d, _ in rows if e % 250 == 0]
    found = neighborhoods.link_neighbourhoods(graph, spark.createDataFrame(records, "request long, src long, dst long"), [3, 5], seed=2, without_seed_edges=True)
    pairs = {e: (s, d) for e, s, d in records}
    named = {"to": ("node", "node", [r[:3] for r in rows])}
    full = neighborhoods.link_neighbourhoods(graph, spark.createDataFrame(records, "request long, src long, dst long"), [3, 5], seed=2)
    checked(full, named, {e: ({("node", s), ("node", d)}, lambda n, e: True) for e, s, d in records}, [3, 5], 2)
    local = {(r["request"], r["id"]): r["new_id"] for r in found.nodes.collect()}
    gone = {(r["request"], r["e_id"]) for r in full.edges.collect()} - {(r["request"], r["e_id"]) for r in found.edges.collect()}
    ends = {e: (s, d) for e, s, d, _ in rows}
    kept = {(q, e) for q in pairs for e, p in ends.items() if p == pairs[q]}
    assert gone == kept and all((q, i) in local for q in pairs for i in pairs[q])


def test_temporal_neighbourhoods_see_no_later_edge(spark, hub):
    rows, edges = hub
    graph = PropertyGraph.homogeneous(spark.range(60).toDF("id"), edges, time="t")
    records = [(e, s, d, t) for e, s, d, t in rows if e % 400 == 9]
    frame = spark.createDataFrame(records, "request long, src long, dst long, t long")
    named = {"to": ("node", "node", [r[:3] for r in rows])}
    for past_, (strict, window, last) in ((neighborhoods.History(), (True, None, None)), (neighborhoods.History(False, 300, 120), (False, 300, 120)), (neighborhoods.History(last=1), (True, None, 1))):
        found = neighborhoods.temporal_neighbourhoods(graph, frame, [4, 6], seed=5, history=past_)
        requests = {}
        for q, s, d, t in records:
            allowed = past(rows, t, strict, window, last)
            requests[q] = ({("node", s), ("node", d)}, lambda n, e, a=allowed: e in a)
        checked(found, named, requests, [4, 6], 5)
    with pytest.raises(GraphError):
        neighborhoods.History(last=0)
    with pytest.raises(GraphError):
        neighborhoods.temporal_neighbourhoods(PropertyGraph.homogeneous(spark.range(60).toDF("id"), edges), frame, [1])


def test_cap_keeps_the_smallest_draws(spark, many_tasks):
    rng = random.Random(6)
    rows = [(g, rng.choice([rng.randrange(1 << 32), rng.randrange(50)]), i) for g, n in ((1, 2000), (2, 3), (3, 40)) for i in range(n)]
    out = neighborhoods.smallest_draws(spark.createDataFrame(rows, "g long, u long, i long"), ["g"], "u", ["i"], 10)
    want = [r for g in (1, 2, 3) for r in sorted(r for r in rows if r[0] == g)[:10]]
    assert sorted(map(tuple, out.collect())) == want


def test_negatives_of_a_source_that_knows_half_of_all_ids(spark, many_tasks):
    total = 400
    rows = [(i, 7, d) for i, d in enumerate(range(0, total, 2))] + [(1000 + i, 8, d) for i, d in enumerate(range(total))] + [(2000, 9, 3), (2001, 9, 5000)]
    edges = spark.createDataFrame(rows, "e_id long, src long, dst long")
    positives = spark.createDataFrame([(q, 7 if q % 3 else 9, 1 if q == 4 else 2) for q in range(300)] + [(999, 8, 5)], "q long, src long, dst long")
    out = sampling.uniform_negatives(edges, positives, 4, total, seed=1).where("label = 0").collect()
    known = defaultdict(set)
    for _, s, d in rows:
        known[s].add(d)
    for r in positives.collect():
        known[r["src"]].add(r["dst"])
    counts = Counter((r["q"], r["slot"]) for r in out)
    assert set(counts) == {(q, k) for q in range(300) for k in range(1, 5)} and set(counts.values()) == {1}
    for r in out:
        free = [i for i in range(total) if i not in known[r["src"]]]
        assert r["dst"] == free[drawn(1, r["q"], r["slot"]) % len(free)]


def test_rows_of_a_matrix_are_bounded(spark, hub, many_tasks):
    rows, edges = hub
    for by, end in (("row", 1), ("col", 2)):
        pointers, blocks = sparse.compressed(sparse.adjacency(edges, "t"), spark.range(70).toDF("id"), by=by, cells=50)
        held = blocks.collect()
        assert max(len(b["minors"]) for b in held) <= 50 and (by == "col" or sum(b["major"] == 0 for b in held) > 50)
        cells = defaultdict(list)
        for b in sorted(held, key=lambda b: (b["major"], b["block"])):
            assert b["first"] == len(cells[b["major"]])
            cells[b["major"]] += zip(b["order_ids"], b["minors"], b["values"], strict=True)
        at = 0
        for p in sorted(pointers.collect()):
            want = sorted((r[0], r[3 - end], float(r[3])) for r in rows if r[end] == p["major"])
            assert (p["first"], p["n"], cells[p["major"]]) == (at, len(want), want)
            at += p["n"]
        assert sparse.uncompressed(blocks, by).exceptAll(sparse.adjacency(edges, "t").select(by, {"row": "col", "col": "row"}[by], "value", "e_id")).count() == 0


def test_walks_at_a_hub(spark, hub, many_tasks):
    rows, edges = hub
    out = defaultdict(list)
    for e, s, d, _ in rows:
        out[s].append((d, e))
    starts = spark.range(80).select(F.col("id").alias("walk"), (F.col("id") % 65).alias("id"))
    trace = defaultdict(dict)
    for r in traverse.random_walk([edges] * 2, starts, seed=3).collect():
        trace[r["walk"]][r["step"]] = r["id"]
    for w, path in trace.items():
        for i in (1, 2):
            near = sorted(out.get(path[i - 1], []))
            assert path[i] == (near[drawn(3, w, i) % len(near)][0] if near else -1)


def test_walks_do_not_rank_a_hub_in_one_window(spark, hub):
    _, edges = hub
    steps, _ = traverse.neighbour_index(edges)
    traced = traverse.random_walk([edges], spark.range(3).select(F.col("id").alias("walk"), "id"))
    assert "windowspecdefinition(src" not in traced._jdf.queryExecution().toString() and steps.count() == 3000


def test_node2vec_has_the_exact_distribution(spark):
    """The share of 6000 walks at each third node against the weights, within five deviations."""
    rows = [(0, 0, 1), (1, 1, 0), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 0, 2), (6, 2, 1)]
    edges = spark.createDataFrame(rows, "e_id long, src long, dst long")
    p, q, n = 4.0, 0.5, 6000
    starts = spark.range(n).select(F.col("id").alias("walk"), F.lit(0).cast("long").alias("id"))
    trace = defaultdict(dict)
    for r in traverse.node2vec_walk(edges, starts, 2, p, q, seed=11).collect():
        trace[r["walk"]][r["step"]] = r["id"]
    via = [t[2] for t in trace.values() if t[1] == 1]
    weight = {0: 1 / p, 2: 1.0, 3: 2 / q}
    total = sum(weight.values())
    for node, w in weight.items():
        share = w / total
        assert abs(via.count(node) - len(via) * share) < 5 * math.sqrt(len(via) * share * (1 - share))
    assert len(via) > 2000 and all(t[2] in (0, 2, 3, 1) for t in trace.values())


def test_decayed_sums_of_a_hot_node(spark, many_tasks):
    rng = random.Random(8)
    rows = [(0 if rng.random() < 0.9 else rng.randrange(1, 5), i, rng.uniform(-1, 1)) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, batch long, value double")
    for decay in (0.5, 0.999, 1e-30, 0.0, 1.0, -0.9):
        state, want = {}, {}
        for i, b, v in rows:
            state[i] = want[(i, b)] = decay * state.get(i, 0.0) + v
        got = {(r["id"], r["batch"]): r["state"] for r in temporal.replay(df, decay=decay).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def plain_gru(x, h, cell):
    dot = lambda w, v: [sum(a * b for a, b in zip(r, v, strict=True)) for r in w]
    sig = lambda v: 1 / (1 + math.exp(-v))
    r = [sig(a + b) for a, b in zip(dot(cell["ir"], x), dot(cell["hr"], h), strict=True)]
    z = [sig(a + b) for a, b in zip(dot(cell["iz"], x), dot(cell["hz"], h), strict=True)]
    n = [math.tanh(a + c * b) for a, b, c in zip(dot(cell["in"], x), dot(cell["hn"], h), r, strict=True)]
    return [(1 - g) * v + g * o for g, v, o in zip(z, n, h, strict=True)]


@pytest.mark.parametrize("aggregate", ["last", "mean"])
def test_memory_over_batches(spark, aggregate):
    rng = random.Random(3)
    rows = [(i, 0 if rng.random() < 0.5 else rng.randrange(8), rng.randrange(8), 10 + i // 2, rng.choice([0, 1, 2, 4]), [rng.random()]) for i in range(30)]
    size, freq, phase = 2, [0.3], [0.1]
    cell = {k: [[rng.uniform(-1, 1) for _ in range(6 if k[0] == "i" else 2)] for _ in range(2)] for k in ("ir", "iz", "in", "hr", "hz", "hn")}
    memory = {i: ([0.1 * i, -0.2], 0) for i in range(9)}
    frame = spark.createDataFrame([(i, x, t) for i, (x, t) in memory.items()], "id long, x array<double>, t long")
    events = spark.createDataFrame(rows, "e_id long, src long, dst long, t long, batch long, raw array<double>")
    want = {}
    for batch in sorted({r[4] for r in rows}):
        told = defaultdict(list)
        for e, s, d, t, b, raw in rows:
            if b == batch:
                for a, o, pos in ((s, d, 2 * e), (d, s, 2 * e + 1)):
                    told[a].append((t, -pos, memory[a][0] + memory[o][0] + raw + [math.cos((t - memory[a][1]) * freq[0] + phase[0])]))
        new = {}
        for a, m in told.items():
            msg = max(m)[2] if aggregate == "last" else [sum(v) / len(m) for v in zip(*[x[2] for x in m], strict=True)]
            new[a] = (plain_gru(msg, memory[a][0], cell), max(m)[0])
        memory.update(new)
        want |= {(a, batch): v for a, v in new.items()}
    out = temporal.memory_over_batches(events, frame, cell, size, freq, phase, aggregate, unit=1.0)
    got = {(r["id"], r["batch"]): (r["x"], r["t"]) for r in out.collect()}
    assert got.keys() == want.keys()
    for k, (x, t) in want.items():
        assert got[k][0] == pytest.approx(x, rel=1e-9) and got[k][1] == t
    with pytest.raises(GraphError):
        temporal.memory_over_batches(events, frame.where("id < 2"), cell, size, freq, phase).count()




def test_capped_hops_at_shared_and_chunked_neighbours(spark, monkeypatch):
    """Frontier nodes that share all neighbours leave too few draws under the first limit; hubs are met in chunks."""
    taken = []
    plain = neighborhoods._drawn

    def watched(front, near, *more):
        taken.append(near.agg({"chunk": "max"}).first()[0])
        return plain(front, near, *more)

    monkeypatch.setattr(neighborhoods, "CHUNK", 50)
    monkeypatch.setattr(neighborhoods, "_drawn", watched)
    rows = {"has": ("u", "p", [(1000 * u + p, u, p) for u in range(40) for p in range(300)])}
    graph = PropertyGraph.typed({"u": spark.range(40).toDF("id"), "p": spark.range(300).toDF("id")}, {("u", "has", "p"): spark.createDataFrame(rows["has"][2], "e_id long, src long, dst long")})
    seeds = [(1, "u", u) for u in range(40)] + [(2, "u", 7)]
    requests = {q: ({(k, i) for r, k, i in seeds if r == q}, lambda n, e: True) for q in (1, 2)}
    found = neighborhoods.node_neighbourhoods(graph, spark.createDataFrame(seeds, "request long, type string, id long"), [3, 2], seed=5)
    checked(found, rows, requests, [3, 2], 5)
    assert max(taken) > 0


@pytest.mark.parametrize("many", [3, 1024])
def test_draws_of_lists_are_those_of_md5(monkeypatch, many):
    """Tables and pairs, numbers of any length and sign, null ids, and a seed too long for one block's layout."""
    monkeypatch.setattr(draws, "MANY", many)
    monkeypatch.setattr(draws, "PAIRS", 500)
    rng = random.Random(1)
    ids = [rng.choice([None, 0, 9, 10, 99, 100, -1, -10, 2**63 - 1, -(2**63) + 1, rng.randrange(10 ** rng.randrange(1, 18))]) for _ in range(400)]
    asked = [rng.choice([0, 5, -7, 123, 99999, 10**12, 2**63 - 1]) for _ in range(60)]
    start = np.array([rng.randrange(300) for _ in asked])
    count, limits = 1 + start * 7 % 89, np.array([rng.choice([2**32, 2**31, 2**20]) for _ in asked])
    for seed in (11, -5, 10**20):
        got = sorted((int(u), int(i), int(d)) for parts in draws._below(seed, 2, asked, limits, start, count, draws._Ids(pa.array(ids, pa.int64()))) for u, i, d in zip(*parts, strict=True))
        want = []
        for u, q in enumerate(asked):
            for i in range(start[u], start[u] + count[u]):
                d = int(hashlib.md5("|".join(str(x) for x in (seed, 2, q, ids[i]) if x is not None).encode()).hexdigest()[:8], 16)
                want += [(u, i, d)] if d < limits[u] else []
        assert got == sorted(want)


def test_lists_are_cut_and_repeated_rows_are_one(spark):
    rows = [(k, t, i) for k in range(3) for t in "ab" for i in range(25) for _ in range(1 + i % 2)]
    found = gathered(spark.createDataFrame(rows, "at long, type string, id long").repartition(2, "at"), ["at", "type"], "id", 10, "ids", "id").collect()
    assert sorted(len(r["ids"]) for r in found) == [5] * 6 + [10] * 12
    assert sorted((r["at"], r["type"], x["id"]) for r in found for x in r["ids"]) == sorted(set(rows))


def test_capped_hops_read_only_what_their_frontier_can_walk(spark):
    unread = spark.range(3).select(F.col("id").alias("e_id"), F.raise_error(F.lit("read")).cast("long").alias("src"), F.col("id").alias("dst"))
    graph = PropertyGraph.typed({k: spark.range(9).toDF("id") for k in "upx"}, {("u", "has", "p"): spark.createDataFrame([(0, 1, 2), (1, 1, 3)], "e_id long, src long, dst long"), ("x", "far", "p"): unread})
    nodes = neighborhoods.neighbourhood_nodes(graph, spark.createDataFrame([(7, "u", 1)], "request long, type string, id long"), [5], seed=1)
    assert {(r["type"], r["id"], r["hop"]) for r in nodes.collect()} == {("u", 1, 0), ("p", 2, 1), ("p", 3, 1)}
