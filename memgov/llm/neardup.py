"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints that differ in at most three of 64 bits agree in at least two of five blocks, so each
distinct fingerprint is dealt to the ten pairs of blocks. Within a pair's value fingerprints are sorted
by Gray rank, which puts those that share bits side by side, and cut into pages of bounded size. A
page that holds part of a very large group meets the group's other pages only if the bits that each
page shares allow it. Between two pages an index over the sorted fingerprints is walked from the
top: every node holds the bits its members share beyond those of the node above, differences add up
on the way down, and a whole group is left once more than three bits differ.

Only the links that connect a page are kept, so that a group of any size gives fewer links than it has
members; connected components join them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgov.llm.common import own_text, shuffle_width
from memgov.llm.components import components
from memgov.llm.lines import marked
from memgov.session import cut_lineage, short_lived

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (lowest bit, bits)
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))
PAGE = 2048
LEAST = 6  # smallest hashes of a text's shingles, of which every three make a key
FAN = 8
CROWD = 512  # texts that one copy of another is compared with, about
FRONTIER = 1 << 18
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str) -> int:
    """64-bit SimHash of the three-word shingles, repeats included; A-Z is lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    span = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[span - 1:].tolist(), strict=False)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray, part: int = 1 << 16) -> int:
    """Bits that are set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), part):
        own = hashes[at:at + part]
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Levels over fingerprints in Gray order. A node: the bits its members share beyond the node above."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        shared, pattern = [np.full(len(codes), ALL)], [self.codes]
        while len(pattern[-1]) > 1:
            starts = np.arange(0, len(pattern[-1]), FAN)
            ones = np.bitwise_and.reduceat(pattern[-1] & shared[-1], starts)
            zeros = np.bitwise_and.reduceat(~pattern[-1] & shared[-1], starts)
            shared.append(ones | zeros)
            pattern.append(ones)
        self.levels = []
        for depth in range(len(pattern)):
            above = shared[depth + 1][np.arange(len(pattern[depth])) // FAN] if depth + 1 < len(pattern) else np.uint64(0)
            self.levels.append((shared[depth] & ~above, pattern[depth]))

    def near(self, queries: np.ndarray, distance: int = DISTANCE):
        """Arrays (query position, code position) of all pairs within the distance, in parts."""
        for at in range(0, len(queries), 256):
            yield from self._walk(np.arange(at, min(at + 256, len(queries))), np.zeros(min(256, len(queries) - at), np.int64),
                                  np.zeros(min(256, len(queries) - at), np.int64), queries, len(self.levels) - 1, distance)

    def _walk(self, query, node, spent, queries, level, distance):
        bits, pattern = self.levels[level]
        spent = spent + np.bitwise_count((queries[query] ^ pattern[node]) & bits[node])
        alive = spent <= distance
        query, node, spent = query[alive], node[alive], spent[alive]
        if not len(query):
            return
        if not level:
            yield query, node
            return
        below = len(self.levels[level - 1][1])
        for at in range(0, len(query), FRONTIER // FAN):  # a bounded front
            part = slice(at, at + FRONTIER // FAN)
            child = (node[part, None] * FAN + np.arange(FAN)).ravel()
            there = child < below
            yield from self._walk(np.repeat(query[part], FAN)[there], child[there], np.repeat(spent[part], FAN)[there],
                                  queries, level - 1, distance)


def spanning_links(own: np.ndarray, other: np.ndarray | None) -> list[tuple[int, int]]:
    """Links within one page, or between two, as few as keep linked fingerprints connected."""
    index = GrayIndex(own)
    queries = index.codes if other is None else other
    nodes = len(index.codes) + (0 if other is None else len(other))
    parent = list(range(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shift, links, group = (0 if other is None else len(index.codes)), [], np.arange(nodes)
    for query, code in index.near(queries):
        new = group[query + shift] != group[code]
        for q, c in zip((query[new] + shift).tolist(), code[new].tolist(), strict=True):
            a, b = root(q), root(c)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(queries[q - shift]), int(index.codes[c])))
        if new.any():
            group = np.array([root(i) for i in range(nodes)])
    return links


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text) and fp (the fingerprint as a signed long) of every row."""
    def run(batches):
        for batch in batches:
            codes = np.array([simhash(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(codes.view(np.int64))],
                                             ["doc_id", "tie", "fp"])

    return (docs.select(F.col("doc_id").cast("long"), text_hash(docs).alias("tie"), own_text(docs).alias("text"))
            .mapInArrow(run, "doc_id long, tie long, fp long"))


def text_hash(docs: DataFrame):
    return F.xxhash64(own_text(docs))


def _block_keys(fp) -> "F.Column":
    """The ten keys of a fingerprint: number of the pair, and the bits of its two blocks."""
    out = []
    for number, (i, j) in enumerate(PAIRS):
        bits = sum(((1 << n) - 1) << low for low, n in (BLOCKS[i], BLOCKS[j]))
        signed = bits - (1 << 64) if bits >> 63 else bits
        out.append(F.struct(F.lit(number).cast("int").alias("pair"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*out)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints of column fp within three bits of each other."""
    spark = distinct.sparkSession
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    dealt = (distinct.select("fp", rank.alias("rank"), F.explode(_block_keys(F.col("fp"))).alias("k"))
             .select("k.pair", "k.bits", "rank", "fp")
             .repartitionByRange(shuffle_width(spark), "pair", "bits", "rank")
             .sortWithinPartitions("pair", "bits", "rank"))

    def pages(batches):
        from pyspark import TaskContext

        task, made, names = TaskContext.get().partitionId(), 0, ["pair", "bits", "page", "shared", "pattern", "codes"]
        # Lone fingerprints are left out, unless their key may go on in a neighbouring task.
        key, codes, edge, goes_on = None, [], True, False

        def page():
            nonlocal made
            own = np.array(codes, np.int64).view(np.uint64)
            ones, zeros = np.bitwise_and.reduce(own), np.bitwise_and.reduce(~own)
            made += 1
            return (*key, task << 32 | made, int((ones | zeros).view(np.int64)), int(ones.view(np.int64)), own.tobytes())

        def batch_of(rows):
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            rows = []
            for pair, bits, fp in zip(*(batch.column(c).to_pylist() for c in ("pair", "bits", "fp")), strict=True):
                if (pair, bits) != key:
                    if codes and (len(codes) > 1 or edge or goes_on):
                        rows.append(page())
                    edge, goes_on, key, codes = key is None, False, (pair, bits), []
                elif len(codes) == PAGE:
                    rows.append(page())
                    goes_on, codes = True, []
                codes.append(fp)
            yield batch_of(rows)
        if codes:
            yield batch_of([page()])

    paged = cut_lineage(dealt.mapInArrow(pages, "pair int, bits long, page long, shared long, pattern long, codes binary"), "pages")
    other = paged.select("pair", "bits", *(F.col(c).alias(f"{c}_2") for c in ("page", "shared", "pattern", "codes")))
    apart = F.bit_count(F.col("pattern").bitwiseXOR(F.col("pattern_2")).bitwiseAND(F.col("shared")).bitwiseAND(F.col("shared_2")))
    between = (paged.join(other, ["pair", "bits"]).filter((F.col("page") < F.col("page_2")) & (apart <= DISTANCE))
               .select("codes", "codes_2"))
    within = paged.filter(F.length("codes") > 8).select("codes", F.lit(None).cast("binary").alias("codes_2"))

    def search(batches):
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for own, other in zip(batch.column("codes").to_pylist(), batch.column("codes_2").to_pylist(), strict=True):
                found.update(spanning_links(np.frombuffer(own, np.uint64), None if other is None else np.frombuffer(other, np.uint64)))
            ends = np.array(sorted(found), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    return within.union(between).mapInArrow(search, "a long, b long").distinct()


def _named(made: DataFrame) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint."""
    distinct = cut_lineage(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp")), "neardup")
    member = (distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("component", F.coalesce("component", "fp")))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    return cut_lineage(member.join(least, "component").select("fp", "component", "component_id"), "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row.

    Documents are linked if their fingerprints differ in at most three bits; component_id is the
    smallest doc_id that can be reached. Texts without a word have fingerprint zero, and null texts are
    empty; both are linked like any other. Rows with one doc_id are separate members of the same id.
    Rows with a null doc_id link others but name no component; alone they have a null component_id.
    """
    made = cut_lineage(fingerprints(docs), "simhash")
    # Many documents can share a fingerprint: both sides are plain tables, so the planner can split it.
    return (made.join(_named(made), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def pieces(docs: DataFrame, shingle: int) -> DataFrame:
    """For every distinct text: tie, n (how many shingles it has), least (the smallest of their hashes) and spot, the first row that has it."""
    def run(batches):
        for batch in batches:
            sets = [hashed_shingles(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tie"), batch.column("doc_id"), pa.array([len(h) for h in sets], pa.int32()),
                 pa.array([h[:LEAST].view(np.int64) for h in sets], pa.list_(pa.int64()))], ["tie", "doc_id", "n", "least"])

    made = docs.select(text_hash(docs).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), own_text(docs).alias("text")).mapInArrow(
        run, "tie long, doc_id long, n int, least array<long>")
    return made.groupBy("tie").agg(F.first("n").alias("n"), F.first("least").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("spot"))


def hashed_shingles(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many words; fewer words make one, none an empty array."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(b" ".join(words[i:i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))}) if words else [], np.uint64)


def _candidates(own: DataFrame, similarity: float) -> DataFrame:
    """(a, b, shared): texts that share keys, and how many, each against the smallest and the largest of a key.

    Every three of a text's smallest hashes make a key. Within a key and a range of sizes, which overlap, texts meet two
    others, so that a group of any size gives two candidates a member.
    """
    keys = [F.when(F.size("least") > max(at), F.xxhash64(*(F.get("least", F.lit(i)) for i in at))) for at in combinations(range(LEAST), 3)]
    keys.append(F.when((F.size("least") > 0) & (F.size("least") < 3), F.xxhash64("least")))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity))).cast("int")
    dealt = (own.filter("n > 0").select("tie", "n", "component", F.explode(F.array(size, size + 1)).alias("size"), F.array(*keys).alias("keys"))
             .select("tie", "n", "component", "size", F.explode("keys").alias("key")).filter("key is not null"))
    # Plain joins with what is grouped map-side: a key of very many texts can be split.
    led = (dealt.groupBy("key", "size").agg(F.min(F.struct("n", "tie", "component")).alias("lo"), F.max(F.struct("n", "tie", "component")).alias("hi"))
           .filter(F.col("lo.tie") != F.col("hi.tie")))
    other = F.explode(F.array("lo", "hi")).alias("other")
    return (dealt.join(led, ["key", "size"]).select("tie", "n", "component", other)
            .filter((F.col("other.component") != F.col("component")) & (F.least("n", "other.n") >= similarity * F.greatest("n", "other.n")))
            .groupBy(F.col("other.tie").alias("a"), F.col("tie").alias("b")).agg(F.count(F.lit(1)).alias("shared")))


def _verified(docs: DataFrame, own: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. A text moves once as `a`, for a bounded number of b, and once for each pair as `b`."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"))
    asks = pairs.join(parts, "a").select(F.col("b").alias("tie"), "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(True).alias("asks"))
    leads = parts.select(F.col("a").alias("tie"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    wanted = cut_lineage(asks.unionByName(leads).join(own.select("tie", "spot"), "tie"), "wanted")
    rows = docs.select(text_hash(docs).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), own_text(docs).alias("text"))
    # Most texts that nobody asks for stay where they are.
    rows = marked(rows, F.xxhash64("tie", "doc_id"), wanted.select(F.xxhash64("tie", "spot.doc_id").alias("place"))).filter("_maybe")
    rows = rows.select("tie", F.struct(F.col("doc_id").isNull(), "doc_id").alias("spot"), "text")
    moved = (rows.join(wanted, ["tie", "spot"]).select("a", "part", "asks", "tie", "text")
             .repartition(shuffle_width(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "asks"))

    def verify(batches):
        at, lead = None, None
        for batch in batches:
            good = []
            for a, asks, text in zip(batch.column("a").to_pylist(), batch.column("asks").to_pylist(), batch.column("text"), strict=True):
                own = hashed_shingles(text.as_py(), shingle)
                if not asks:
                    at, lead = a, own
                common = len(np.intersect1d(lead, own, assume_unique=True)) if asks and at == a else 0
                good.append(asks and common >= similarity * (len(lead) + len(own) - common))
            found = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column("a"), found.column("tie")], ["a", "b"])

    return cut_lineage(moved.mapInArrow(verify, "a long, b long").distinct(), "similar")


def alike(docs: DataFrame, grouped: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(tie, whole) of the texts whose component another one joins: whole is the component of both.

    grouped names the component of every text (tie, component). Texts of different components are candidates if they share a key;
    each is verified against the one it shares most keys with, on all shingles. What is still apart after that is tried against all
    its candidates, and then once more with new ones, until nothing joins: so a key that holds several groups loses none.
    """
    named = grouped.groupBy("tie").agg(F.min("component").alias("component"))
    own = cut_lineage(pieces(docs, shingle).join(named, "tie"), "pieces")
    first = True
    while True:
        pairs = cut_lineage(_candidates(own, similarity), "pairs")
        if not first:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        chosen = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b") if first else pairs.select("a", "b")
        chosen = cut_lineage(chosen, "chosen")
        if chosen.isEmpty():
            return own.select("tie", F.col("component").alias("whole"))
        links = _verified(docs, own, chosen, shingle, similarity)
        tried = chosen if first else cut_lineage(tried.union(chosen).distinct(), "tried")
        if links.isEmpty() and not first:
            return own.select("tie", F.col("component").alias("whole"))
        first = False
        part = own.select("tie", "component")
        ends = links.join(part.select(F.col("tie").alias("a"), F.col("component").alias("u")), "a").join(
            part.select(F.col("tie").alias("b"), F.col("component").alias("v")), "b")
        joined = components(ends.select("u", "v"), "alike").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        own = cut_lineage(own.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole"), "pieces")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component, columns unchanged: that with the smallest doc_id.

    Documents are linked as in near_duplicates, and if their shingles of five words have a Jaccard similarity of 0.8 or more.

    Of several rows with that doc_id the one with the smallest text hash stays, of equal rows any one. A
    row without doc_id stays only if its component has no other.
    """
    with short_lived(docs.sparkSession) as keep:
        made = cut_lineage(fingerprints(docs), "simhash")
        grouped = cut_lineage(made.join(_named(made).select("fp", "component"), "fp")
                              .withColumn("spot", F.struct(F.col("doc_id").isNull(), "doc_id", "tie")), "grouped")
        whole = alike(docs, grouped, shingle, similarity)
        grouped = cut_lineage(grouped.join(whole, "tie", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole"), "grouped")
        first = cut_lineage(grouped.groupBy("component").agg(F.min("spot").alias("kept")), "kept")
        gone = keep(grouped.join(first, "component").filter(F.col("spot") != F.col("kept"))
                    .select(F.col("doc_id").alias("_gone_id"), F.col("tie").alias("_gone_tie")).distinct(), "gone")
        repeated = not (grouped.groupBy("doc_id", "tie").count().filter("count > 1")
                        .join(first.select("kept.doc_id", "kept.tie"), ["doc_id", "tie"], "left_semi")).isEmpty()
    left = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_gone_id")) & (text_hash(docs) == F.col("_gone_tie")), "left_anti")
    if not repeated:
        return left
    return (left.withColumn("_tie", text_hash(left)).withColumn("_id", F.col("doc_id"))
            .dropDuplicates(["_id", "_tie"]).drop("_id", "_tie"))
