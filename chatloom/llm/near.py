"""Near duplicates: a Jaccard join on word shingles by chosen paths.

Texts are sets of hashed five-word shingles; texts with equal sets are one class from the start. In every run a set chooses
some of its shingles by a hash, each with probability 1 / (similarity * size): similar sets choose the same ones. A bucket of
more than SMALL sets is split again by further chosen shingles, up to LEVELS of them. In a bucket of up to SMALL sets all pairs
are compared, in a larger one each set with the leaders before it, both by sketches of the sets, which only say which sets may
belong together; within each group so found every pair is compared exactly, in blocks. Runs are repeated until a pair at the threshold is met with the target probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import KEY, Query, quoted, table, text_key, unused, with_columns
from chatloom.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
LEVELS = 3
# Buckets up to this many sets are not split further.
SMALL = 24
# Larger buckets of the last level are searched in parts of this many sets; the leaders of the parts meet in a second pass.
PART = 5000
# A sketch has one byte per bin; its estimate lies within 0.2 of the similarity, six standard deviations.
BINS = 128
SLACK = 0.2
# Blocks of the exact comparison: sets, and shingles.
BLOCK_SETS = 512
BLOCK_SHINGLES = 400_000
# Words whose hash a task remembers before it starts anew.
REMEMBERED = 200_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ODD = np.uint64(0x9E3779B97F4A7C15)
PATHS = np.dtype([("p1", "<i8"), ("p2", "<i8"), ("p3", "<i8"), ("lead", "u1")])


def meeting(levels: int) -> float:
    """Probability that two sets at the threshold share a path of so many shingles in one run."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, levels: int = LEVELS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(levels)))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_digest(word)
        return found


HASHES = WordHashes()


def forget_words() -> None:
    """At the end of a task; its worker may go on to other work."""
    HASHES.clear()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of all runs of `size` words, A-Z lower-cased; a shorter text is one run, a wordless one has none."""
    words = WORD.findall(text.encode().lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(HASHES.__getitem__, words)), "<u8")
    n = max(1, len(h) - size + 1)
    size = min(size, len(h))
    mixed = np.full(n, size, np.uint64)
    for j in range(size):
        mixed = mixed * ODD + h[j : j + n]
    return np.unique(mix(mixed))


def sketch(hashes: np.ndarray, bins: int = BINS) -> bytes:
    """Per bin of the hash range a byte of its least hash, 0 where the bin is empty."""
    out = np.zeros(bins, np.uint8)
    which, first = np.unique((hashes >> np.uint64(64 - int(math.log2(bins)))).astype(np.int64), return_index=True)
    out[which] = (hashes[first] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def chosen_paths(hashes: np.ndarray, runs: int, similarity: float = SIMILARITY) -> bytes:
    """The paths of a set in all runs, as PATHS records; 0 where a path ends early.

    `lead` has bit 1 on the first record of a first step, bit 2 on the first of a second step.
    """
    n = len(hashes)
    limit = np.uint64(min(2**64 - 1, int(2**64 / (similarity * n))))
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * ODD)

    def choose(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the shingles it goes on with."""
        rows, cols = [], []
        each = max(1, 250_000 // n)  # small enough for a core's cache
        for a in range(0, len(starts), each):
            r, c = np.nonzero((hashes[None, :] ^ starts[a : a + each, None]) * ODD < limit)
            rows.append(r + a)
            cols.append(c)
        return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64),) * 2

    r1, c1 = choose(seeds)
    p1 = mix(seeds[r1] + mix(hashes[c1]))
    r2, c2 = choose(p1)
    ok = c2 != c1[r2]
    r2, c2 = r2[ok], c2[ok]
    p2 = mix(p1[r2] + mix(hashes[c2]))
    r3, c3 = choose(p2)
    ok = (c3 != c2[r3]) & (c3 != c1[r2[r3]])
    r3, c3 = r3[ok], c3[ok]
    p3 = mix(p2[r3] + mix(hashes[c3]))
    # one record per path; those that end early keep one of their own
    ends2 = np.setdiff1d(np.arange(len(p2)), r3)
    ends1 = np.setdiff1d(np.arange(len(p1)), r2)
    out = np.zeros(len(p3) + len(ends2) + len(ends1), PATHS)
    at2 = np.concatenate([r3, ends2])
    at1 = np.concatenate([r2[at2], ends1])
    out["p1"] = p1[at1].view(np.int64)
    out["p2"][: len(at2)] = p2[at2].view(np.int64)
    out["p3"][: len(p3)] = p3.view(np.int64)
    lead = np.zeros(len(out), np.uint8)
    lead[np.unique(at1, return_index=True)[1]] |= 1
    lead[np.unique(at2, return_index=True)[1]] |= 2
    out["lead"] = lead
    return out.tobytes()


def mark(docs: DataFrame, text_col: str, recall: float, similarity: float) -> DataFrame:
    """_sid (the set's digest, null without words), _n, _sketch and _paths in place of the text."""
    runs = runs_for(recall)

    def make():
        def work(texts):
            rows = []
            for text in texts:
                h = shingles(text.as_py())
                rows.append((xxhash.xxh128_digest(h.tobytes()), len(h), sketch(h), chosen_paths(h, runs, similarity)) if len(h) else (None,) * 4)
            return [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.binary(), pa.int64(), pa.binary(), pa.binary()))]

        return work

    fields = [("_sid", "binary"), ("_n", "bigint"), ("_sketch", "binary"), ("_paths", "binary")]
    return with_columns(docs, [text_col], fields, make, after=forget_words).drop(text_col)


def level_rows(sets: DataFrame, level: int) -> DataFrame:
    """_set, path and, behind the first level, parent: the steps of all sets at one level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).to_pylist()
            rows = np.frombuffer(b"".join(packed), PATHS)
            owner = np.repeat(np.arange(len(packed)), [len(p) // PATHS.itemsize for p in packed])
            own = rows["p3"] != 0 if level == 3 else (rows["lead"] & level) > 0
            columns = [batch.column(0).take(pa.array(owner[own])), pa.array(rows[f"p{level}"][own])]
            if level > 1:
                columns.append(pa.array(rows[f"p{level - 1}"][own]))
            yield pa.RecordBatch.from_arrays(columns, names=["_set", "path", "parent"][: len(columns)])

    schema = "_set bigint, path bigint" + ", parent bigint" * (level > 1)
    return sets.select("_set", "_paths").mapInArrow(run, schema)


def buckets(sets: DataFrame, small: int = SMALL) -> DataFrame:
    """path, _set, size: the buckets of two sets or more in which the splitting ends."""
    found, large = [], None
    for level in range(1, LEVELS + 1):
        rows = level_rows(sets, level)
        if large is not None:
            rows = rows.join(large, "parent", "left_semi").drop("parent")
        sizes = materialise(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), f"near-sizes{level}")
        end = sizes if level == LEVELS else sizes.where(F.col("size") <= small)
        # Far fewer than the buckets: written on their own, so that Spark knows their size when it plans the next join.
        large = sizes.where(F.col("size") > small).select(F.col("path").alias("parent"))
        large = materialise(large, f"near-large{level}") if level < LEVELS else None
        found.append(rows.join(end, "path"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def lead(rows: DataFrame, part: str, least: float) -> DataFrame:
    """One pass over buckets, each in the rows of one `part`: all pairs of a `brute` bucket, else leaders.

    In a brute bucket a set is tied to each group of sets before it of which its sketch resembles one; in another every set is tied
    to the leader that its sketch resembles most, or leads. a, b: ties; where b is null, a is a leader of `path` (wanted only where a
    bucket has several parts).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, several, leaders, table_ = None, False, [], np.zeros((0, BINS), np.uint8)
        groups = alike = np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for path, p, parts, brute, one, bits in zip(*columns):
                if (path, p) != current:
                    current, several, leaders, table_ = (path, p), parts > 1, [], np.zeros((16, BINS), np.uint8)
                    groups = np.zeros(16, np.int64)
                row = np.frombuffer(bits, np.uint8)
                held = table_[: len(leaders)]
                if len(leaders):
                    same = ((held == row) & (row > 0)).sum(1)
                    some = ((held > 0) | (row > 0)).sum(1)
                    if brute:
                        alike = np.unique(groups[np.flatnonzero(same >= least * some)])
                        out += [(path, leaders[g], one) for g in alike.tolist()]
                    best = int(np.argmax(same / some))
                    if not brute and same[best] >= least * some[best]:
                        out.append((path, leaders[best], one))
                        continue
                if len(leaders) == len(table_):
                    table_, groups = np.concatenate([table_, np.zeros_like(table_)]), np.concatenate([groups, np.zeros_like(groups)])
                at = len(leaders)
                table_[at], groups[at] = row, at
                if brute and at:
                    joined = np.isin(groups[:at], alike)
                    if joined.any():  # the groups that the new set ties are one from here on, named by their first set
                        groups[at] = alike[0]
                        groups[:at][joined] = alike[0]
                leaders.append(one)
                if several:
                    out.append((path, one, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names=["path", "a", "b"]
            )

    rows = rows.select("path", F.expr(part).alias("part"), "parts", "_brute", "_set", "_sketch")
    rows = rows.repartition("path", "part").sortWithinPartitions("path", "part", F.xxhash64("path", "_set"))
    return rows.mapInArrow(run, "path bigint, a bigint, b bigint")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root of every node with an edge (a, b); the root is the least node of its component.

    Large-star and small-star steps in turn until nothing changes, each written to the shared folder.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = materialise(edges.where("a != b").select(*pair("a", "b")).distinct(), f"{name}-edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v != m").select(*pair("v", "m"))
        edges = materialise(tied.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), f"{name}-step")


def common_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of sorted sets; shingles that only one set has are left out first."""
    sets = left + (right or [])
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(joined, return_inverse=True, return_counts=True)
    useful = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    owner, column = owner[keep], useful[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right) if right is not None else len(left)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        cells = np.zeros((len(sets), min(width, int(column[-1]) + 1 - at)), np.float32)
        cells[owner[a:b], column[a:b] - at] = 1
        out += cells[: len(left)] @ (cells[len(left) :] if right is not None else cells).T
    return out


def compare_blocks(rows: DataFrame, similarity: float) -> DataFrame:
    """Exact links of each pair of blocks: per set, `links` to other sets, their `copies` and a `tie` to a linked set's root."""

    def compared(part: list[tuple], i: int, j: int) -> list[tuple]:
        one, two = ([r for r in part if r[0] == k] for k in (i, j))
        sets = [[shingles(r[2]) for r in one], [shingles(r[2]) for r in two] if i != j else None]
        both = one + two if i != j else one
        if len(both) < 2:
            return []
        common = common_counts(*sets)
        size = np.array([len(s) for s in sets[0]], np.float32)
        other = np.array([len(s) for s in sets[1]], np.float32) if i != j else size
        # in whole numbers, so that the threshold itself counts
        linked = np.round(common * 1e6) >= np.round(similarity * 1e6 * (size[:, None] + other[None, :] - common) - 0.5)
        if i == j:
            np.fill_diagonal(linked, False)
        copies = [np.array([r[3] for r in one], np.int64), np.array([r[3] for r in (two if i != j else one)], np.int64)]
        links = linked.sum(1).tolist() + (linked.sum(0).tolist() if i != j else [])
        weights = (linked @ copies[1]).tolist() + ((copies[0] @ linked).tolist() if i != j else [])
        # each set is tied to the least place it reaches inside these blocks
        shift = len(one) if i != j else 0
        root = np.arange(len(both))
        x, y = np.nonzero(linked)
        y = y + shift
        while True:
            low = root.copy()
            np.minimum.at(low, x, root[y])
            np.minimum.at(low, y, root[x])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return [(r[1], n, w, both[t][1]) for r, n, w, t in zip(both, links, weights, root.tolist()) if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 4)], names=["_set", "links", "copies", "tie"]
            )

        key, part = None, []
        for batch in batches:
            found: list[tuple] = []
            for group, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, i, j) != key:
                    if part:
                        found += compared(part, *key[1:])
                    key, part = (group, i, j), []
                part.append(tuple(row))
            yield give(found)
        if part:
            yield give(compared(part, *key[1:]))

    rows = rows.select("_root", "_i", "_j", "_block", "_set", "_text", "_copies")
    rows = rows.repartition("_root", "_i", "_j").sortWithinPartitions("_root", "_i", "_j", "_set")
    return rows.mapInArrow(run, "_set bigint, links bigint, copies bigint, tie bigint")


def _classes(
    docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float
) -> DataFrame:
    """_id, text key, _sid, class_id, n_links of all rows."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumns(
        dict(zip(KEY, text_key(F.col("_text"))))
    )
    marked = materialise(mark(texts, "_text", recall, similarity), "near-marks")
    sets = marked.where("_sid is not null").groupBy("_sid").agg(
        F.count("*").alias("_copies"), F.first("_n").alias("_n"), F.first("_sketch").alias("_sketch"), F.first("_paths").alias("_paths"),
        F.min(F.struct(*KEY)).alias("_rep"), F.min("_id").alias("_first"),
    )
    # Written with a number for each set: half as wide as the digest in all that follows.
    sets = materialise(sets.withColumn("_set", F.monotonically_increasing_id()), "near-sets")
    least = similarity - SLACK
    held = buckets(sets).withColumns({"parts": F.ceil(F.col("size") / PART), "_brute": F.col("size") <= SMALL}).join(sets.select("_set", "_sketch"), "_set")
    ties = materialise(lead(held, "pmod(xxhash64(_set, path), parts)", least), "near-ties")
    leaders = ties.where("b is null").select("path", F.col("a").alias("_set"), F.lit(1).cast("bigint").alias("parts"), F.lit(False).alias("_brute"))
    more = lead(leaders.join(sets.select("_set", "_sketch"), "_set"), "0L", least)
    groups = components(ties.unionByName(more).where("b is not null").select("a", "b"), "near-groups")

    members = groups.select(F.col("node").alias("_set"), F.col("root").alias("_root")).join(sets.drop("_sid", "_sketch", "_paths"), "_set")
    extent = members.groupBy("_root").agg(F.count("*").alias("_m"), F.sum("_n").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_m") / BLOCK_SETS), F.ceil(F.col("_s") / BLOCK_SHINGLES))
    members = members.join(extent.select("_root", blocks.alias("_blocks")), "_root")
    members = members.select("_root", "_blocks", "_set", "_copies", F.pmod(F.xxhash64("_set"), "_blocks").alias("_block"), "_rep.*")
    members = materialise(members, "near-members")
    shown = texts.select(*KEY, "_text").join(members.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.first("_text").alias("_text"))
    placed = members.join(shown, KEY).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    placed = placed.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")})
    linked = materialise(compare_blocks(placed, similarity), "near-links")
    counts = linked.groupBy("_set").agg(F.sum("links").alias("_links"), F.sum("copies").alias("_linked"))
    # groups of one block are whole already; the others' ties may meet in a third set
    split = linked.join(members.where("_blocks > 1").select("_set"), "_set", "left_semi")
    roots = components(split.select(F.col("_set").alias("a"), F.col("tie").alias("b")), "near-classes")
    whole = linked.join(members.where("_blocks = 1").select("_set"), "_set", "left_semi").select(F.col("_set").alias("node"), F.col("tie").alias("root"))
    roots = whole.unionByName(roots).select(F.col("node").alias("_set"), F.col("root").alias("_class"))
    known = sets.select("_set", "_sid", "_copies", "_first").join(counts, "_set", "left").join(roots, "_set", "left")
    known = known.withColumn("_class", F.coalesce("_class", "_set"))
    named = known.groupBy("_class").agg(F.min("_first").alias("class_id"))
    known = materialise(known.join(named, "_class").drop("_first", "_set"), "near-known")
    return marked.select("_id", *KEY, "_sid").join(known, "_sid", "left").select(
        "_id", *KEY, "_sid", "_class", F.when(F.col("_sid").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.coalesce("_linked", F.lit(0)) + F.col("_copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_linked_sets"),
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """One row per row of `docs`: `id_col`, class_id, n_links, n_linked_sets.

    class_id is the least id of the rows that a chain of links joins; n_links counts the other rows, n_linked_sets the other
    sets, with a similarity of at least `similarity`. Null and wordless texts have no links and are their own class; a text of
    under five words is one shingle. Rows with equal texts are linked; a class without any id has a null class_id. An
    empty table gives an empty one; other columns are not read.
    """
    out = _classes(docs, id_col, text_col, similarity, recall)
    return out.select(F.col("_id").alias(id_col), "class_id", "n_links", "n_linked_sets")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """The rows of `docs` with one row of each class: the one of the least id (null ids last), of equal ids the least text key."""
    found = _classes(docs, id_col, text_col, similarity, recall).where("_class is not null")
    stays = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", *KEY)).alias("_stay")
    stays = found.groupBy("_class").agg(stays).select("_stay.*")
    own = [unused(docs, n) for n in ("near_id", "near_1", "near_2")]
    keyed = docs.withColumns(dict(zip(own, (F.col(id_col), *text_key(F.col(text_col))))))
    same = (keyed[own[1]] == stays["_k1"]) & (keyed[own[2]] == stays["_k2"]) & keyed[own[0]].eqNullSafe(stays["_id"])
    # rows that agree in id and text are one row
    kept = keyed.join(stays, same, "left_semi").dropDuplicates(own)
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return kept.select(*quoted(docs.columns)).unionByName(docs.where(wordless))


def op10_chosen_path(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_chosen_path": Query(op10_chosen_path)}
