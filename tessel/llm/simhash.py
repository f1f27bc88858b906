"""SimHash near-duplicates through covering locality-sensitive hashing.

A document's fingerprint has 64 bits for each of its words: a bit is 1 if it is set in over half
of the hashes of its word shingles.  Candidates come from a covering family of bit masks, each of
which gives a table: two fingerprints that agree on a whole mask share a key in that table.

* ``covering_masks(radius)``: every bit position gets a non-zero vector of ``radius + 1`` bits,
  and for each non-zero vector v there is a mask of the positions with an odd inner product with
  v.  The vectors of at most ``radius`` positions span too little to leave every v out.
* ``line_masks(band, groups)``: each group of bits is cut into 15 bands, the points of the
  projective space of dimension 3 over two elements, and there is a mask for each of its 35 lines
  of three bands.  Nine untouched bands always hold a line, so 6 differences in a group, and
  ``7 * groups - 1`` in all, leave one mask untouched.

Either way no pair within the radius is missed.  What shares a key is verified by the number of
differing bits of the whole fingerprint.  Distinct fingerprints only are compared, so copies cost nothing; a bucket over a
block is dealt out as pairs of chunks, and a block gives the links that connect its rows, never
all pairs.  A pair that meets in several tables counts in the first.

``near_duplicates`` links fingerprints within ``radius`` bits.  ``deduplicate`` works at a Jaccard
similarity of word shingles, which differ in 15 of 100 bits on average, far beyond a radius that
masks can cover.  Bands grow with the logarithm of the corpus, so a text meets a bounded number of
others by chance, and groups are added until the chance that a pair just at the similarity meets
is at least :data:`RECALL`, by an exact count over the subsets of a group's bands.  Fingerprints
of several words tell such pairs from chance ones; the components of the pairs that pass are then
compared, text by text, by the exact similarity of their shingle sets, again in blocks.

Words are split at ASCII white space after A-Z are lower-cased.  Null and empty texts have the
fingerprint 0 and are linked like any other; texts shorter than a shingle have one shingle, the
whole sequence; texts without words are alike.  Repeated rows share a class.  Other columns are
ignored or, in ``deduplicate``, kept; an empty table gives no rows.
"""

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.joins import join_back
from tessel.llm.common import slices
from tessel.operators.components import star_components
from tessel.plans.staging import staged

BITS = 64
SEED = 42
#: Distinct fingerprints compared at a time, about; of so many one tells the sizes of buckets.
BLOCK, DRAWN = 2048, 16
#: Bits of a table's number.
TABLE_BITS = 12
#: Words of a shingle and least similarity of ``deduplicate``.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Bands of a group; chance of a pair at the least similarity to meet; others a text meets by chance.
POINTS, RECALL, CHANCE = 15, 0.96, 1024
#: Words of a fingerprint at least: so wide, chance pairs lie far beyond the similar ones.
WORDS = 3
#: The pairs compared differ in so many deviations above the mean of texts at the least similarity.
DEVIATIONS = 4.1
#: Documents and characters compared exactly at a time.
TEXTS, CHARACTERS = 512, 2_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str, size: int) -> list[bytes]:
    """The word shingles of a text in their order, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < size:
        return [joined]
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :], strict=False)]


def majority(digests: bytes, width: int) -> bytes:
    """The bits set in over half of the ``width``-byte digests; zeros where there is none."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, width)
    ones = np.zeros(8 * width, np.int64)
    for at in range(0, len(rows), 8192):
        ones += np.unpackbits(rows[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).tobytes()


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    hashed = xxhash.xxh64_digest
    return int.from_bytes(majority(b"".join([hashed(s, SEED) for s in shingles(text, shingle)]), 8), "big")


def wide_fingerprint(text: str, words: int, shingle: int = SHINGLE) -> np.ndarray:
    """A fingerprint of ``64 * words`` bits; words after the second mix the first two of each hash."""
    hashed = xxhash.xxh3_128_digest
    found = shingles(text, shingle)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(found), 8192):
        pair = np.frombuffer(b"".join([hashed(s, SEED) for s in found[at : at + 8192]]), np.uint64).reshape(-1, 2)
        rows = np.empty((len(pair), words), np.uint64)
        rows[:, :2] = pair[:, :words]
        for w in range(2, words):
            h = pair[:, w & 1] + pair[:, 1 - (w & 1)] * np.uint64(2 * w + 1)
            h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            rows[:, w] = h ^ h >> np.uint64(31)
        ones += np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, bits long)``: the signed 64-bit fingerprint of every text."""

    def run(batches):
        for part in (p for batch in batches for p in slices(batch)):
            bits = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits)], [id_col, "bits"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, bits long")


def covering_masks(radius: int = 2, bits: int = BITS) -> list[int]:
    """The masks of all tables: ``2 ** (radius + 1) - 1`` of them, as unsigned numbers.

    Position i carries the non-zero vector ``i mod (2 ** (radius + 1) - 1) + 1``, so each mask
    keeps about 4 of 7 positions for a radius of 2.
    """
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def lines() -> list[tuple[int, int, int]]:
    """The lines of the projective space: three bands whose numbers, from 1, have the exclusive or 0."""
    return [(i, j, i ^ j) for i in range(1, POINTS + 1) for j in range(i + 1, POINTS + 1) if i ^ j > j]


def line_masks(band: int, groups: int) -> list[tuple[int, ...]]:
    """The masks of the lines of every group, each a tuple of 64-bit words."""
    words = max(WORDS, -(-POINTS * band * groups // 64))
    out = []
    for g in range(groups):
        for line in lines():
            whole = sum(((1 << band) - 1) << (g * POINTS + i - 1) * band for i in line)
            out.append(tuple(whole >> 64 * w & (1 << 64) - 1 for w in range(words)))
    return out


def differing(least: tuple[int, int] = SIMILARITY) -> float:
    """The share of bits that differ, on average, between texts at that Jaccard similarity."""
    part, whole = least
    return math.acos(2 * part / (part + whole)) / math.pi


@lru_cache
def _holding() -> list[int]:
    """By size: the sets of bands that hold a line."""
    masks = [sum(1 << i - 1 for i in line) for line in lines()]
    sets = np.arange(1 << POINTS)
    held = np.zeros(len(sets), bool)
    for m in masks:
        held |= sets & m == m
    return np.bincount(np.bitwise_count(sets)[held], minlength=POINTS + 1).tolist()


def meeting(band: int, least: tuple[int, int] = SIMILARITY) -> float:
    """The chance that two texts at a similarity share a key in a group."""
    p = (1 - differing(least)) ** band
    return sum(n * p**k * (1 - p) ** (POINTS - k) for k, n in enumerate(_holding()))


def layout(n: int, recall: float = RECALL, chance: float = CHANCE) -> tuple[int, int]:
    """``(band, groups)`` for so many texts: the narrowest bands that keep chance meetings bounded."""
    for band in range(4, 21):
        groups = math.ceil(math.log(1 - recall) / math.log(1 - meeting(band)))
        if n * len(lines()) * groups <= chance * 2.0 ** (3 * band):
            break
    return band, groups


def widest(bits: int, least: tuple[int, int] = SIMILARITY) -> int:
    """The differing bits up to which two fingerprints are candidates for that similarity."""
    share = differing(least)
    return round(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is connected to by links between rows a and b."""
    low = np.arange(n)
    while True:
        after = low.copy()
        np.minimum.at(after, a, low[b])
        np.minimum.at(after, b, low[a])
        after = after[after]
        if (after == low).all():
            return low
        low = after


def _cut_groups(batches: Iterator[pa.RecordBatch], order: list[str], shift: int = 0) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups, those that agree in numbers less their lowest bits;
    what a group can hold is bounded by its chunks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held).combine_chunks()
        last, n = whole.num_rows - 1, whole.num_rows
        same = np.ones(n, bool)
        for c in order:
            v = whole.column(c).to_numpy() >> shift
            same &= v == v[last]
        at = n - int(np.argmin(same[::-1])) if not same.all() else 0
        if at:
            yield whole.slice(0, at)
        held = whole.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def collisions(distinct: DataFrame, tables: list[tuple[int, ...]], within: int, block: int = BLOCK) -> DataFrame:
    """``(src0, src1, .. dst0, dst1, ..)``: links that connect all fingerprints of at most ``within``
    differing bits that share a key in some table.

    ``distinct`` has one or more long columns, the words of a fingerprint; a table is a tuple of
    masks, one for each word.  A row has its words and one number: a hash of the table's number and
    key, which it is dealt by, that number again and the side of its chunk.  Which buckets are cut
    into chunks is told by one in :data:`DRAWN` fingerprints; that decides how rows are dealt, not
    which are compared.
    """
    words = distinct.columns
    masked = [[F.col(w).bitwiseAND(F.lit(_signed(m))) for w, m in zip(words, masks, strict=True) if m] for masks in tables]
    keys = F.array(*[F.xxhash64(F.lit(t), *parts) for t, parts in enumerate(masked)])
    drawn = distinct.where(F.pmod(F.xxhash64(F.lit("sizes"), *words), F.lit(DRAWN)) == 0)
    counts = drawn.select(F.explode(keys).alias("key")).groupBy("key").agg((F.count(F.lit(1)) * DRAWN).alias("n"))
    full = counts.where(F.col("n") > block).select("key", F.ceil(F.col("n") / F.lit(block // 2)).cast("int").alias("chunks"))
    rows = distinct.select(*words, F.posexplode(keys).alias("t", "key")).join(staged(full, "full-buckets"), "key", "left")
    mine = F.pmod(F.xxhash64(F.lit("chunk"), *words), F.col("chunks").cast("long"))
    # a chunk meets every chunk: the pair is named by its two numbers, and the own chunk meets itself
    rows = rows.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)).cast("long") - 1)))
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    # which side of its pair of chunks a row is on: 0 both, 1 the first, 2 the second
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    name = F.when(F.col("chunks").isNull(), F.col("key")).otherwise(pair)
    packed = F.shiftleft(name, TABLE_BITS + 2).bitwiseOR((F.col("t") * 4 + side).cast("long"))
    rows = rows.select(packed.alias("bucket"), *words)
    rows = rows.repartition(F.shiftright("bucket", 2)).sortWithinPartitions("bucket")

    def compare(batches):
        for whole in _cut_groups(batches, ["bucket"], 2):
            n = whole.num_rows
            packed = whole.column("bucket").to_numpy()
            bucket, t, side = packed >> 2, packed >> 2 & (1 << TABLE_BITS) - 1, packed & 3
            bits = np.stack([whole.column(w).to_numpy() for w in words]).view(np.uint64)
            left, right = [], []
            first = np.arange(n)
            step = 0
            while len(first):
                step += 1
                first = first[first + step < n]
                first = first[bucket[first] == bucket[first + step]]
                i, j = first, first + step
                near = np.bitwise_count(bits[:, i] ^ bits[:, j]).sum(axis=0) <= within
                near &= (side[i] == 0) | (side[i] != side[j])  # between the two chunks of a pair
                i, j = i[near], j[near]
                if not len(i):
                    continue
                new, apart = np.ones(len(i), bool), bits[:, i] ^ bits[:, j]
                for k, masks in enumerate(tables[:-1]):  # met before
                    other = np.zeros(len(i), bool)
                    for w, m in enumerate(masks):
                        if m:
                            other |= apart[w] & np.uint64(m) != 0
                    new &= (t[i] <= k) | other
                left.append(i[new])
                right.append(j[new])
            if left:
                low = connect(n, np.concatenate(left), np.concatenate(right))
                moved = np.flatnonzero(low != np.arange(n))
                ends = bits.view(np.int64)
                found = [pa.array(ends[w, at]) for at in (moved, low[moved]) for w in range(len(words))]
                yield pa.RecordBatch.from_arrays(found, [f"{side}{w}" for side in ("src", "dst") for w in range(len(words))])

    return rows.mapInArrow(compare, ", ".join(f"{side}{w} long" for side in ("src", "dst") for w in range(len(words))))


def bundled(links: DataFrame, rounds: int = 3) -> DataFrame:
    """Fewer links ``(src, dst)``, of larger to smaller, with the same components.

    A fingerprint has a link for every table and chunk at most; its partners are linked to the
    smallest of them instead, which many fingerprints have in common.
    """
    for _ in range(rounds):
        links = staged(links.distinct(), "bundled")
        low = links.groupBy("src").agg(F.min("dst").alias("low"))
        met = join_back(links, low, "src")
        moved = met.where(F.col("dst") > F.col("low")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        links = moved.unionByName(low.select("src", F.col("low").alias("dst")))
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(id, bits, component_id)``: every document with the smallest id it is linked to.

    Links join fingerprints that differ in at most ``radius`` bits, and components follow the
    links.
    """
    marks = staged(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = staged(marks.groupBy("bits").agg(F.min(id_col).alias("low")), "simhash-bits")
    links = collisions(classes.select("bits"), [(m,) for m in covering_masks(radius)], radius)
    roots = star_components(bundled(links.select(F.greatest("src0", "dst0").alias("src"), F.least("src0", "dst0").alias("dst"))))
    classes = classes.join(roots.select(F.col("id").alias("bits"), F.col("component").alias("root")), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = staged(join_back(classes, lows, "root").select("bits", "component_id"), "simhash-classes")
    return marks.join(classes, "bits").select(id_col, "bits", "component_id")


def hex_digits(bits) -> object:
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def alike(texts: list[str], shingle: int = SHINGLE, least: tuple[int, int] = SIMILARITY, step: int = 1 << 22) -> np.ndarray:
    """Whether each two of some texts have a Jaccard similarity of at least ``least``, exactly.

    Shared shingles are counted by products of incidence matrices of bounded size; a shingle of
    one text alone adds to no count.
    """
    n = len(texts)
    sets = [np.unique(np.array([xxhash.xxh64_intdigest(s) for s in shingles(t, shingle)], np.uint64)) for t in texts]
    size = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(n), size)
    _, number, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many > 1
    column = np.cumsum(shared) - 1
    kept = shared[number]
    of, column = of[kept], column[number[kept]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both, wide = np.zeros((n, n), np.float64), max(1, step // n)
    for at in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(column, (at, at + wide))
        seen = np.zeros((n, min(wide, int(shared.sum()) - at)), np.float32)
        seen[of[a:b], column[a:b] - at] = 1
        both += seen @ seen.T
    return least[1] * both >= least[0] * (size[:, None] + size[None, :] - both)


def similar(members: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(src, dst)`` digests: links that connect the texts of a group that are alike.

    ``members``: ``group, chunks, digest, text``; a group of several chunks is compared as pairs
    of chunks.
    """
    mine = F.pmod(F.xxhash64(F.lit("chunk"), "digest"), F.col("chunks").cast("long")).cast("int")
    rows = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("group", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "digest", "text")
    order = ["group", "a", "b"]
    rows = rows.repartition(*order).sortWithinPartitions(*order)

    def compare(batches):
        for whole in _cut_groups(batches, order):
            marks = np.stack([whole.column(c).to_numpy() for c in order])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), whole.num_rows]
            src, dst = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    part = whole.slice(a, b - a)
                    i, j = np.nonzero(np.triu(alike(part.column("text").to_pylist(), shingle), 1))
                    low = connect(b - a, i, j)
                    moved = np.flatnonzero(low != np.arange(b - a))
                    digests = part.column("digest").combine_chunks()
                    src += digests.take(pa.array(moved)).to_pylist()
                    dst += digests.take(pa.array(low[moved])).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])

    return rows.mapInArrow(compare, "src string, dst string")


def _marks(docs: DataFrame, id_col: str, text_col: str, words: int, shingle: int) -> DataFrame:
    """``(id, digest, chars, b0, b1, ..)``: md5, length and wide fingerprint of every text."""
    names = [f"b{w}" for w in range(words)]

    def run(batches):
        for part in (p for batch in batches for p in slices(batch)):
            bits = np.stack([wide_fingerprint(t, words, shingle) for t in part.column(3).to_pylist()]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(bits[:, w].copy()) for w in range(words)]], [id_col, "digest", "chars", *names])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), digest_of(text_col).alias("digest"), F.length(text).cast("long").alias("chars"), text.alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, digest string, chars long, " + ", ".join(f"{n} long" for n in names))


def digest_of(text_col: str) -> Column:
    """The md5 of a text; null counts as empty."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(digest, low, root)``: every distinct text with its smallest id and the root of its group.

    Groups are the components of the links between texts whose shingle sets have a Jaccard
    similarity of at least 0.8, among those that the tables connect.
    """
    tables = line_masks(*layout(docs.count()))
    words = len(tables[0])
    names = [f"b{w}" for w in range(words)]
    marks = _marks(docs, id_col, text_col, words, shingle)
    node = F.xxhash64(*names)  # what shares a hash is compared exactly all the same
    texts = staged(marks.groupBy("digest", "chars", *names).agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("rows")), "texts")
    met = collisions(texts.select(*names).distinct(), tables, widest(64 * words))
    ends = F.xxhash64(*[f"src{w}" for w in range(words)]), F.xxhash64(*[f"dst{w}" for w in range(words)])
    roots = star_components(bundled(met.select(F.greatest(*ends).alias("src"), F.least(*ends).alias("dst"))))
    roots = roots.select(F.col("id").alias("node"), F.col("component").alias("met"))
    grouped = texts.withColumn("node", node).join(roots, "node", "left").select("digest", "low", "chars", F.coalesce("met", "node").alias("group"))
    grouped = staged(grouped, "candidates")
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).where("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / F.lit(TEXTS), F.col("chars") / F.lit(CHARACTERS))).cast("int")
    sizes = staged(sizes.select("group", chunks.alias("chunks")), "candidate-groups")
    chosen = staged(grouped.join(sizes, "group").select("group", "chunks", "digest", F.col("low").alias("__low")), "chosen")
    own = docs.select(F.col(id_col).alias("__id"), digest_of(text_col).alias("__digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    members = own.join(chosen, own["__id"].eqNullSafe(chosen["__low"]) & (own["__digest"] == chosen["digest"])).select("group", "chunks", "digest", "text")
    found = star_components(similar(members, shingle))
    found = found.select(F.col("id").alias("digest"), F.col("component").alias("root"))
    return texts.join(found, "digest", "left").select("digest", "low", "rows", F.coalesce("root", "digest").alias("root"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The document with the smallest id of each group of similar texts; all columns stay.

    Of texts that share the smallest id, the one with the smallest md5 stays; of rows that share
    both id and text, one.  Where no row of a group has an id, the smallest md5 decides alone.
    """
    texts = staged(similar_texts(docs, id_col, text_col, shingle), "similar-texts")
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "digest", "rows")).alias("k")
    kept = staged(texts.groupBy("root").agg(first).select(F.col("k.low").alias("__low"), F.col("k.digest").alias("__digest"), F.col("k.rows").alias("__rows")), "kept-texts")
    here = docs[id_col].eqNullSafe(kept["__low"]) & (digest_of(text_col) == kept["__digest"])
    out = docs.join(kept, here, "left_semi")
    return out if kept.where("__rows > 1").isEmpty() else out.dropDuplicates([id_col, text_col])
