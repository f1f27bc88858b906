"""Fill-in-middle, conversation repair and mixing: brute force, edge cases and planted skew."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessel.llm import dialogue, infill, mixing, queries
from tessel.sources.tables import table

SF = "/root/testdata/sf0.01"
SPACES = "[ \t\n\v\f\r]"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle


def planned(key: str, text: str) -> tuple:
    digits = sha("1:" + key)
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), sha("<S>" + s + "<P>" + p + "<M>" + m), sha(text)
    return n, "psm", len(p), len(m), sha("<P>" + p + "<S>" + s + "<M>" + m), sha(text)


def test_infill_query_equals_a_plain_program(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], *planned(str(r["doc_id"]), r["text"] or "")) for r in docs)
    assert sorted(map(tuple, queries.op11_fill_in_middle(spark, SF).collect())) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


ODD = ["", None, "a", "<P> in it", "x<S>", "<", "<<<P", "P><S", "\U0001f600é́\n\r\n", "\x00\x01", "long Ünï " * 60_000, "a", "a"]


def test_infill_edges(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "lost <"), (None, None), (2, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fim": F.lit(1), "n": F.lit(2), "output": F.lit(3)})
    out = infill.transform(docs)
    assert out.columns == [*docs.columns, "_fim"]
    proof = out.select("doc_id", "_fim.*", infill.digests(F.col("_fim.output"), F.col("_fim.form")).alias("p"))
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], *r["p"]) for r in proof.collect()]
    assert sorted(got, key=str) == sorted(((i, *planned("" if i is None else str(i), t or "")) for i, t in rows), key=str)
    assert infill.transform(docs.limit(0)).collect() == []


def test_infill_by_other_units():
    import regex

    text = "one two  three\nfour"
    for unit in (r"\w+\s*", r"\X", r"(?s).", "zzz"):
        pattern = regex.compile(unit)
        for key in map(str, range(200)):
            n, form, a, b, output = infill.rearrange(text, key, pattern, "s", 90, 50)
            assert n == len(pattern.findall(text)) and infill.restore(output, form) == text
            if form != "plain":
                ends = {0, *(m.end() for m in pattern.finditer(text))}
                assert {a, a + b} <= ends


# conversations


def is_sound(initials: str) -> bool:
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """The least (cost, audit) by growing all prefixes of edits, best first."""
    import heapq

    seen_rows, fault = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        fault.append("blank" if not body else "duplicate" if (role, text) in seen_rows else "" if body[-1] in ".!?" else "truncated")
        seen_rows.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        state = initials[-1:]
        if i == len(rows) and is_sound(initials):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        options = []
        if i < len(rows):
            role, text = rows[i]
            extra = 5 if fault[i] == "truncated" else 0
            options.append((2, "D", i + 1, initials, out))
            if fault[i] not in ("blank", "duplicate"):
                options.append((extra, "K", i + 1, initials + (role[:1] or "?"), (*out, (role, text))))
                options += [(1 + extra, "R", i + 1, initials + r[0], (*out, (r, text))) for r in ("user", "assistant")]
        options += [(5, "I", i, initials + r[0], (*out, (r, ""))) for r in ("user", "assistant")]
        for more, letter, j, now, rest in options:
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + more, audit + letter, j, now, rest))
    raise AssertionError


def described(rows: list[tuple]) -> tuple:
    """The contract's columns of one conversation's damaged ``(turn, role, text)`` rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, counts = set(), Counter()
    for _, role, text in rows:
        last = re.sub(SPACES + r"+\Z", "", text)[-1:]
        counts["blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"] += 1
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, out = cheapest([r[1:] for r in rows])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out))


def damaged(rows: list[tuple]) -> dict:
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        draw = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        found[conv] += [(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return found


def expected(rows: list[tuple]) -> list[tuple]:
    return sorted(((conv, *described(mine)) for conv, mine in damaged(rows).items()), key=str)


def repaired(frame) -> list[tuple]:
    found, rows = dialogue.repair(frame)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in dialogue.digests(rows).collect()}
    return sorted(((*r, digests.get(r["conv_id"], sha(""))) for r in found.collect()), key=str)


def test_repair_query_equals_brute_force(spark):
    rows = list(map(tuple, table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()))
    got = sorted(map(tuple, queries.op12_conversation_repair(spark, SF).collect()), key=str)
    assert got == expected(rows)


def made_up(n: int, seed: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?  ", "cut", "", " \t", None, "a.b", "é\n.", "same."]
    rows = []
    for conv in [None, *range(n)]:
        for turn in rng.sample([None, *range(longest * 2)], rng.randrange(longest)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]), rng.choice(texts)))
            if rng.random() < 0.2:
                rows.append(rows[-1])
            if rng.random() < 0.2:
                rows.append((conv, turn, "assistant", rng.choice(texts)))
    return rows


def test_repair_edges(spark):
    rows = made_up(150, 3, 9)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("task", "at", "n", "code", "fault", "audit", "place")})
    assert repaired(dialogue.damage(frame)) == expected(rows)
    for found in dialogue.repair(frame.limit(0)):
        assert found.collect() == []


def test_repair_of_conversations_that_lie_in_many_tasks(spark):
    """One conversation with most rows, several longer than a block; 13 ranges put borders within them."""
    rng = random.Random(5)
    rows = [(conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice([f"t{turn}.", f"t{turn}!", f"t{turn}", "again.", " "])) for conv, n in [(7, 600), (3, 90), (4, 2), (9, 40)] for turn in range(n) if rng.random() < 0.9]
    shuffled = rng.sample(rows, len(rows))
    frame = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        damaged_rows = dialogue.damage(frame)
        kept = dialogue.ordered_rows(damaged_rows, "conv_id", "turn", "role", "text")
        assert kept.where("conv = 7").select("task").distinct().count() > 5
        assert repaired(damaged_rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_block_costs_are_those_of_all_edits():
    """Every block of up to three rows, from each state to each, against the trace and joined tables."""
    kinds = [0, 1, 2, 3, 1 | dialogue.CUT_OFF, 2 | dialogue.CUT_OFF, 2 | dialogue.DOOMED]
    for n in (1, 2, 3):
        for codes in itertools.product(kinds, repeat=n):
            codes = bytes(codes)
            table_ = dialogue.block_costs(codes)
            joined = dialogue.block_costs(codes[:1])
            for c in codes[1:]:
                joined = dialogue.joined_costs(joined, dialogue.block_costs(bytes([c])))
            assert joined == table_
            for start in range(4):
                audit, end = dialogue.trace_block(codes, (0, 10, 5, 0), start)
                if end >= 0:
                    best = min(c + v for c, v in zip(table_[start], (0, 10, 5, 0), strict=True))
                    assert best == table_[start][end] + (0, 10, 5, 0)[end] and len(audit) - audit.count("I") == n


# mixing


def filled(words: dict, most: int = 3) -> dict:
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [s for s in words if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    bound, total = set(), sum(words.values())
    while True:
        left = total - sum(most * words[s] for s in bound)
        free = [s for s in names if s not in bound]
        rate = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if rate * weight[s] > most * words[s]}
        if not over:
            return {s: most * words[s] if s in bound else rate * weight[s] for s in names}
        bound |= over


def check_mix(rows: list[tuple], got: list) -> None:
    words = Counter()
    for _, text, source in rows:
        words[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken, largest = filled(words), Counter(), Counter()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows), key=str)
    by_id = {i: s for i, _, s in rows}
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == words[s] and r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= 1.5 * largest[s] + 1e-6 for s in words)


def test_mix_of_the_documents(spark):
    rows = list(map(tuple, table(spark, SF, "documents").select("doc_id", "text", "source").collect()))
    got = queries.op13_mixing(spark, SF).collect()
    check_mix(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op13_mixing(spark, SF).collect()))


def test_mix_edges(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, "w " * rng.randrange(1, 300)]), rng.choice(["a", "b", "b", "b", "Z", "é", "", None, "\U0001f600", "￮"])) for i in range(600)]
    rows += [(1000 + i, " \t\n", "empty") for i in range(3)] + [(2000, "one", "tiny"), (2001, "x " * 90_000, "huge")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("size", "task", "at", "words", "target", "copies")})
    check_mix(rows, mixing.mix(frame).collect())
    again = mixing.mix(frame.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixing.mix(frame).collect()))
    assert mixing.mix(frame.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (None, "", "a"), (None, "", "a")], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(nothing).collect()] == [(0.0, 0)] * 3


def test_mix_of_a_hot_source_in_many_tasks(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else f"s{i % 11}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_mix(rows, mixing.mix(frame).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
