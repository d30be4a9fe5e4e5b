"""N-gram Jaccard join: token-combination prefixes, then exact verification.

Documents are sets of word shingles ("tokens"); two link when they share at
least 80 % of their union.  Documents with equal sets are one node.

A set of n tokens can lack at most t = n - ceil(0.8 n) tokens of a partner.  In
one order of all tokens (rare class before frequent class, then by hash) its
prefix is extended until

    rare tokens + sum over groups of frequent tokens of (tokens of the group - 1)

is t + 1.  Rare tokens are indexed singly, frequent ones by the pairs within
their group.  By the pigeonhole principle two sets that link share an index key.
The classes come from exact counts over all documents; any classes give right
results, so a bound on their number (``MAX_FREQUENT``) costs time only.

Two sets that share no rare token have only frequent tokens in common; a set
with f of them can then link only with partners whose size fits f.  Pairs of
frequent tokens are therefore indexed under the size class of the smaller
partner, and sets that cannot link there are left out.

Keys are resolved without listing all pairs: every set under a key is first
compared with one pivot of the key, components are formed, and only pairs under
one key that lie in different components are compared after that, where their
sizes and sketches allow a link.  So each pair that shares a key is compared or
already joined, and no link between components is lost.  Members of a large key
are dealt to tasks for this.  Every step is the same at every size.

Nulls and edge cases: null, empty or blank texts have no tokens and link with
nothing; fewer words than five make one token; rows with one id are separate
documents; a null id never becomes a component's id unless all of its
documents have none; texts of any length are read whole; an empty table gives
no rows.  Sets are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batches, begin_stage, table, to_batch
from .components import connected_components
from .shingles import mix, set_id, shingle_sets

#: A token in more documents than this is of the frequent class.
RARE_MAX = 16
#: Bound of the broadcast frequent tokens (8 bytes each): the most frequent ones are taken.
MAX_FREQUENT = 500_000
#: Tokens to a bucket of the packed shuffles, about.
BUCKET_TOKENS = 1_000_000
#: Buckets of the packed shuffles, as powers of two.  The most, 2^20, hold some 16 million tokens each at 100 TB of text.
MIN_BITS = 8
MAX_BITS = 20
#: Bits of the filter that picks the sets to verify: 8 MB, whatever the number of sets.
FILTER_BITS = 1 << 26
#: Members of an open key that one task compares with the rest of the key.
KEY_PART = 512
#: Rows in an Arrow batch: documents, and pairs of sets.
DOC_ROWS = 1000
PAIR_ROWS = 200


def least_overlap(n):
    """Tokens that a set of n shares at least with any partner: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def lacking(n: int) -> int:
    return n - least_overlap(n)


def size_class(n: int) -> int:
    """Classes 5 % wide; sizes below 20 have their own."""
    return n if n < 20 else 20 + int(np.log(n / 20) / np.log(1.05) + 1e-9)


_CLASS_LEAST = np.array([*range(20), *(np.ceil(20 * 1.05 ** np.arange(400) - 1e-6).astype(np.int64).tolist())])


def groups_of(cls: int) -> int:
    """Groups of the frequent tokens for a size class, about three of a prefix's tokens to each."""
    return max(1, (lacking(int(_CLASS_LEAST[cls])) + 1) // 2)


def flush_tokens(bits: int) -> int:
    """Tokens that a task packs at once: enough for some tens to each bucket, within 128 MB."""
    return max(800_000, min(16_000_000, 32 << bits))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    begin_stage()
    for b in batches:
        yield b.column(0).to_pylist(), b.column(1).to_pylist()


# --- 1. digests -------------------------------------------------------------------

#: A set's sketch: for each of 512 hash classes whether it has an odd number of tokens, in eight integers.
SKETCH = [f"s{k}" for k in range(8)]
DIGEST = "doc_id long, text_key long, n_shingles long, node long, " + ", ".join(f"{s} long" for s in SKETCH)


def sketch(own: np.ndarray) -> list[int]:
    odd = np.bincount((own & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def may_link(a: str, b: str):
    """A condition that no linking pair fails: sets that link differ in at most a ninth of their sizes' sum,
    and two sketches differ in no more places than the sets do."""
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0))
    n_a, n_b = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (9 * differ <= n_a + n_b) & (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b))


def _digest(batches):
    arrow = pa.schema([(name, pa.int64()) for name in ("doc_id", "text_key", "n_shingles", "node", *SKETCH)])
    none = [None] * len(SKETCH)
    begin_stage()
    for batch in batches:
        keys, texts, text_keys = (c.to_pylist() for c in batch.columns)
        sets = zip(keys, text_keys, shingle_sets(texts))
        rows = [(k, x, len(s), set_id(s), *sketch(s)) if len(s) else (k, x, 0, None, *none) for k, x, s in sets]
        yield to_batch(rows, arrow)


def _distinct_sets(batches) -> Iterator[tuple[int, np.ndarray]]:
    """The sets of a partition, equal ones once."""
    seen: set[int] = set()
    for _, texts in _columns(batches):
        for s in shingle_sets(texts):
            if len(s) and (node := set_id(s)) not in seen:
                seen.add(node)
                yield node, s


# --- packing ----------------------------------------------------------------------


def _packed(sorted_low: np.ndarray) -> bytes:
    """Sorted 32-bit integers as compressed differences: about two bytes each where a bucket is full."""
    import zstandard

    steps = np.diff(sorted_low.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    planes = (np.frombuffer(press.decompress(b), np.uint8).reshape(4, -1) for b in blobs)
    return [np.cumsum(np.ascontiguousarray(p.T).view("<u4")[:, 0], dtype=np.uint32) for p in planes]


# --- 2. classes of tokens ---------------------------------------------------------


def _by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys of ``bits + 32`` bits by their top bits."""
    top = (keys >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(top, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, slice(int(cuts[b]), int(cuts[b + 1]))


def _short(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The leading ``bits + 32`` bits."""
    return tokens >> np.uint64(32 - bits)


def _count_blobs(batches, bits: int):
    """Packed token counts by bucket: each token of a partition's flush once, with its count."""
    arrow = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def flush(held):
        keys, counts = np.unique(_short(np.concatenate(held), bits), return_counts=True)
        for b, s in _by_bucket(keys, bits):
            low, n = keys[s].astype("<u4"), counts[s]
            yield b, _packed(low[n == 1]), _packed(low[n > 1]), n[n > 1].astype("<u4").tobytes()

    held, size = [], 0
    for _, s in _distinct_sets(batches):
        held.append(s)
        size += len(s)
        if size >= flush_tokens(bits):
            yield to_batch(list(flush(held)), arrow)
            held, size = [], 0
    if held:
        yield to_batch(list(flush(held)), arrow)


def _sum_counts(key: tuple[pa.Scalar, ...], given: pa.Table) -> pa.Table:
    one = np.concatenate(_unpacked(given["tokens"].to_pylist()))
    more = np.concatenate(_unpacked(given["more"].to_pylist()))
    counts = np.frombuffer(b"".join(given["counts"].to_pylist()), "<u4")
    tokens, place = np.unique(np.concatenate([one, more]), return_inverse=True)
    total = np.bincount(place, np.concatenate([np.ones(len(one)), counts.astype(float)]), len(tokens)).astype(np.int64)
    often = total > RARE_MAX
    full = (np.int64(key[0].as_py()) << 32) + tokens[often].astype(np.int64)
    return pa.table({"token": pa.array(full, pa.int64()), "n": pa.array(total[often], pa.int64())})


def frequent_tokens(docs: DataFrame, bits: int) -> np.ndarray:
    """The leading bits of the tokens of the frequent class, sorted; at most ``MAX_FREQUENT``."""
    counts = table(
        docs.mapInArrow(partial(_count_blobs, bits=bits), "bucket int, tokens binary, more binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(_sum_counts, "token long, n long"),
        "token-counts",
    )
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("k")).count().orderBy(F.col("k").desc()).collect()
    least, held = 64, 0
    for r in sizes:  # whole powers of two, so that equal counts are treated alike
        held += r["count"]
        if held > MAX_FREQUENT:
            break
        least = r["k"]
    rows = counts.where(F.floor(F.log2("n")) >= int(least)).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).astype(np.uint64))


class Classes:
    def __init__(self, frequent: np.ndarray, bits: int):
        self.frequent, self.bits = frequent, bits
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(frequent >> np.uint64(bits + 12)).astype(np.int64)] = True

    def is_frequent(self, tokens: np.ndarray) -> np.ndarray:
        out = self.maybe[(tokens >> np.uint64(44)).astype(np.int64)]
        if out.any():
            own = _short(tokens[out], self.bits)
            at = np.minimum(np.searchsorted(self.frequent, own), len(self.frequent) - 1)
            out[out] = self.frequent[at] == own
        return out


# --- 3. index keys ----------------------------------------------------------------


def _rare_keys(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Rare tokens of the prefix: the first t + 1, or all if there are fewer."""
    rare = own[~often] if often.any() else own
    return rare[: lacking(len(own)) + 1]


def frequent_keys(own: np.ndarray, often: np.ndarray) -> Iterator[tuple[np.ndarray, bool, bool]]:
    """Keys of pairs of frequent tokens by size class of the smaller partner: (keys, may be smaller, may be larger)."""
    n, f = len(own), int(often.sum())
    wanted = lacking(n) + 1 - (n - f)
    if wanted <= 0:
        return
    tokens = own[often]
    own_class = size_class(n)
    smaller = 9 * f >= 8 * n  # 2n * 4/9 <= f: with a partner at least as large
    low, high = least_overlap(n), min(n, 9 * f // 4 - n)
    classes = set(range(size_class(low), size_class(high) + 1)) if high >= low else set()
    for cls in sorted(classes | ({own_class} if smaller else set())):
        groups = groups_of(cls)
        group = (mix(tokens) % np.uint64(groups)).astype(np.int64)
        # Covered by the first k tokens: k less the groups seen.
        _, first = np.unique(group, return_index=True)
        new = np.ones(len(tokens), np.int64)
        new[first] = 0
        covered = np.cumsum(new)
        k = int(np.searchsorted(covered, wanted)) + 1
        tok, grp = tokens[:k], group[:k]
        order = np.argsort(grp, kind="stable")
        tok, grp = tok[order], grp[order]
        keys = []
        for step in range(1, len(tok)):  # pairs ``step`` apart in one group
            same = grp[step:] == grp[:-step]
            if not same.any():
                break
            keys.append(mix(tok[:-step][same] * np.uint64(3) + mix(tok[step:][same]) + np.uint64(cls)))
        if keys:
            yield np.concatenate(keys), smaller and cls == own_class, cls in classes


def _rare_blobs(batches, bits: int, classes):
    arrow = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("places", pa.binary())])
    own_classes = Classes(classes.value, bits)

    def flush(held, nodes):
        keys = _short(np.concatenate(held), bits)
        owner = np.repeat(np.array(nodes, "<i8"), [len(h) for h in held])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        for b, s in _by_bucket(keys, bits):
            names, place = np.unique(owner[s], return_inverse=True)
            yield b, _packed(keys[s].astype("<u4")), names.tobytes(), place.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()

    held, nodes, size = [], [], 0
    for node, s in _distinct_sets(batches):
        got = _rare_keys(s, own_classes.is_frequent(s))
        if len(got):
            held.append(got)
            nodes.append(node)
            size += len(got)
        if size >= flush_tokens(bits) // 2:
            yield to_batch(list(flush(held, nodes)), arrow)
            held, nodes, size = [], [], 0
    if held:
        yield to_batch(list(flush(held, nodes)), arrow)


def _rare_members(key: tuple[pa.Scalar, ...], given: pa.Table) -> pa.Table:
    """Members of the keys that more than one node has, with the key's pivot (its smallest node).

    A rare token is in few documents, so the lists here are short by construction.
    """
    keys = np.concatenate(_unpacked(given["keys"].to_pylist()))
    place = (np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4")[:, 0] for b in given["places"].to_pylist())
    nodes = np.concatenate([np.frombuffer(n, "<i8")[p] for n, p in zip(given["nodes"].to_pylist(), place)])
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)  # one node of a key once
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + 1 if len(keys) else keys) != 0)
    count = np.diff(np.append(first, len(keys)))
    pivot, many = np.repeat(nodes[first], count), np.repeat(count > 1, count)
    full = (np.int64(key[0].as_py()) << 32) + keys[many].astype(np.int64)
    return pa.table(
        {
            "key": pa.array(full, pa.int64()),
            "node": pa.array(nodes[many], pa.int64()),
            "pivot": pa.array(pivot[many], pa.int64()),
            "small": pa.array(np.ones(int(many.sum()), bool)),
        }
    )


def _frequent_rows(batches, bits: int, classes):
    arrow = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("small", pa.bool_()), ("spare", pa.float32())])
    own_classes = Classes(classes.value, bits)
    for node, s in _distinct_sets(batches):
        often = own_classes.is_frequent(s)
        for keys, small, _ in frequent_keys(s, often):
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.view(np.int64)),
                    pa.array(np.full(n, node), pa.int64()),
                    pa.array(np.full(n, small)),
                    pa.array(np.full(n, 1 - often.mean(), np.float32)),
                ],
                schema=arrow,
            )


def _frequent_members(rows: DataFrame) -> DataFrame:
    """As ``_rare_members``.  The pivot is the set with the smallest share of rare tokens that may be the smaller partner."""
    rows = table(rows.groupBy("key", "node").agg(F.max("small").alias("small"), F.min("spare").alias("spare")), "frequent-keys")
    stats = rows.groupBy("key").agg(
        F.min(F.when(F.col("small"), F.struct("spare", "node")))["node"].alias("pivot"), F.count("*").alias("n")
    )
    # Stored, so that both sides of the join are plain exchanges, which Spark splits at a hot key.
    stats = table(stats.where("n > 1 and pivot is not null").select("key", "pivot"), "frequent-pivots")
    return rows.join(stats, "key").select("key", "node", "pivot", "small")


# --- 4. verification --------------------------------------------------------------


def filter_words(keys: DataFrame) -> DataFrame:
    """``word, bits``: a bitmap of ``FILTER_BITS`` by the low bits of the hashes in the column ``h``.  It has at most
    a 64th as many rows, whatever the number of hashes; it lets all of them through, and few others while they
    are fewer than bits."""
    words = keys.select(
        F.expr(f"cast((h & {FILTER_BITS - 1}) >> 6 as int)").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")
    )
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def filter_of(keys: DataFrame) -> np.ndarray:
    rows = filter_words(keys).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _likely_sets(batches, likely):
    """(node, tokens) of the sets that the filter lets through: those of the nodes' first documents, and by chance few others."""
    arrow = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])
    bits, rows, seen = likely.value, [], set()
    places = 64 * len(bits) - 1
    for ids, texts in _columns(batches):
        for key, s in zip(ids, shingle_sets(texts)):
            if not len(s) or (node := set_id(s)) in seen:
                continue
            h = node ^ (key or 0)
            if not int(bits[(h & places) >> 6]) >> (h & 63) & 1:
                continue
            seen.add(node)
            rows.append((node, s.astype("<u8").tobytes()))
            if len(rows) >= 256:
                yield to_batch(rows, arrow)
                rows = []
    if rows:
        yield to_batch(rows, arrow)


def links_exactly(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _verify(batches):
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    begin_stage()
    for batch in batches:
        # The sets are read where they lie in the batch.
        rows = [
            (a.as_py(), b.as_py())
            for a, b, x, y in zip(*batch.columns)
            if links_exactly(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"))
        ]
        if rows:
            yield to_batch(rows, arrow)


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link.  ``pairs`` is stored and distinct.

    Pairs whose sizes or sketches rule a link out go first.  The sets of the others are picked
    by a filter of bounded size, stored where they are found, and joined to their pairs.
    """
    spark = docs.sparkSession
    given = pairs.alias("p").join(nodes.alias("x"), F.col("p.a") == F.col("x.node")).join(nodes.alias("y"), F.col("p.b") == F.col("y.node"))
    pairs = table(given.where(may_link("x", "y")).select("p.a", "p.b"), "likely-pairs")
    names = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    likely = spark.sparkContext.broadcast(filter_of(names.select(F.expr("node ^ coalesce(first, 0L)").alias("h"))))
    sets = docs.mapInArrow(partial(_likely_sets, likely=likely), "node long, tokens binary")
    sets = table(sets.withColumn("row", F.monotonically_increasing_id()), "sets", compression="none")
    # A set may be there from several partitions: one row of each node takes part.
    rows = table(sets.groupBy("node").agg(F.min("row").alias("row")), "set-rows")
    for side in ("a", "b"):
        own = rows.select(F.col("node").alias(side), F.col("row").alias(f"row_{side}"))
        pairs = pairs.join(own, side)
    x, y = (sets.select(F.col("row").alias(f"row_{side}"), F.col("tokens").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    both = x.join(table(pairs, "pairs"), "row_a").join(y, "row_b")
    with arrow_batches(spark, PAIR_ROWS):
        return table(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long").distinct(), "links")


# --- the operator -----------------------------------------------------------------


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    with arrow_batches(docs.sparkSession, DOC_ROWS):
        placed = _placed(docs, id_col, text_col)
        # Stored, so that the join below is between two plain exchanges, which Spark splits where one component is large.
        least = table(placed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id")), "component-ids")
        return placed.join(least, "c", "left").select(
            "doc_id", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
        )


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, n_shingles, c`` for every row; ``c`` is the component's smallest node, null without tokens."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digests = table(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_digest, DIGEST), "digests")
    total = digests.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bits = min(MAX_BITS, max(MIN_BITS, int(-(-total // BUCKET_TOKENS)).bit_length()))
    frequent = frequent_tokens(docs, bits)
    classes = docs.sparkSession.sparkContext.broadcast(frequent)

    rare = (
        docs.mapInArrow(partial(_rare_blobs, bits=bits, classes=classes), "bucket int, keys binary, nodes binary, places binary")
        .groupBy("bucket")
        .applyInArrow(_rare_members, "key long, node long, pivot long, small boolean")
    )
    members = table(rare, "members")
    if len(frequent):
        rows = docs.mapInArrow(partial(_frequent_rows, bits=bits, classes=classes), "key long, node long, small boolean, spare float")
        more = table(_frequent_members(rows), "members")
        members = members.unionByName(more)

    ordered = (F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    first = table(members.where("node <> pivot").select(*ordered).distinct(), "pairs")
    nodes = digests.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), *(F.first(s).alias(s) for s in SKETCH)
    )
    nodes = table(nodes, "nodes")
    links = verified(docs, first, nodes)
    of_node = table(connected_components(links), "node-components")

    # Pairs under one key that the pivots left in different components.
    placed = members.join(of_node, "node", "left").select("key", "node", "pivot", "small", F.coalesce("component", "node").alias("c"))
    placed = table(placed, "placed-members")
    spread = placed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("n"))
    open_keys = spread.where("least <> most and n > 2").select("key", F.ceil(F.col("n") / KEY_PART).cast("int").alias("parts"))
    # Both sides are stored: Spark splits the join at a key of very many members.
    rest = table(placed.where("node <> pivot").join(table(open_keys, "open-keys"), "key").select("key", "node", "small", "c", "parts"), "open")
    rest = rest.join(nodes.select("node", "n_shingles", *SKETCH), "node")
    # Members of a large key are dealt to parts, each compared with the whole key in a task of its own.
    x = rest.where("small").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("x")
    y = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    under_one_key = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.c") != F.col("y.c")) & may_link("x", "y")
    second = x.join(y, under_one_key).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    second = table(second.join(first, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        of_node = table(connected_components(links.unionByName(verified(docs, second, nodes))), "node-components")

    placed = digests.join(of_node, "node", "left").withColumn("c", F.coalesce("component", "node"))
    return placed.select("doc_id", "text_key", "n_shingles", "c")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns that came in.

    The row is the one with the smallest id, and of rows with one id the one
    whose text hashes lowest; a row without an id is kept only where all of its
    component have none.  Rows are told apart by id and text, so an id that
    recurs with other texts loses none of them that stand in other components.
    Rows without tokens link with nothing: all are kept.

    Rows that a filter of bounded size tells from all that may go are not shuffled; the
    others join the rows to drop by id and hash.  Null texts and empty tables go through;
    the columns may have any names.
    """
    with arrow_batches(docs.sparkSession, DOC_ROWS):
        found = table(_placed(docs, id_col, text_col).where("c is not null").select("doc_id", "text_key", "c"), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    # Stored for the same reason as the components' ids.
    first = table(found.groupBy("c").agg(F.min(order).alias("first")), "first-rows")
    own_id, own_key, word, bits = (_unused(docs, name) for name in ("id", "key", "word", "bits"))
    keys = (F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.key"))
    drop = table(found.join(first, "c").where(~is_first).select(*keys).distinct(), "rows-to-drop")
    again = found.groupBy("doc_id", "text_key").count().where("count > 1").select(*keys)
    again = table(again.exceptAll(drop), "repeated-rows")

    row_id, row_key = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))
    h = F.xxhash64(row_id, row_key)
    words = table(filter_words(drop.unionByName(again).select(F.xxhash64(own_id, own_key).alias("h"))), "row-filter")
    words = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    at = h.bitwiseAND(F.lit(FILTER_BITS - 1))
    told = docs.join(F.broadcast(words), F.floor(at / 64).cast("int") == F.col(word), "left")  # bounded by the filter's size
    may_go = F.coalesce(F.substring(F.lpad(F.bin(F.col(bits)), 64, "0"), 64 - F.pmod(at, F.lit(64)).cast("int"), F.lit(1)) == "1", F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clean, rest = told.where(~may_go).select(*columns), told.where(may_go).select(*columns)

    same = row_id.eqNullSafe(F.col(own_id)) & (row_key == F.col(own_key))
    kept = rest.join(drop, same, "left_anti")
    single, repeated = kept.join(again, same, "left_anti"), kept.join(again, same, "left_semi")
    return clean.unionByName(single).unionByName(repeated.dropDuplicates([id_col, text_col]))


def _unused(df: DataFrame, name: str) -> str:
    return next(n for k in range(len(df.columns) + 1) if (n := f"{name}_{k}") not in df.columns)
