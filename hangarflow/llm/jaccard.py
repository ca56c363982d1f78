"""Jaccard join of word-shingle sets over a token-group matrix.

Two documents link when their sets of distinct five-word shingles have a Jaccard
similarity of at least ``PART / WHOLE``. The join is exact up to 64-bit hashes of
the shingles; every step below may only let too much pass, and links are counted on
the sets themselves.

1. *Shared shingles.* Equal sets form one class. A document that links to another set
   shares at least 3/4 of its shingles with it, so of any fixed half of the hash space
   it shares all but a quarter of its set. Shingles of that half are counted over the
   corpus in packed form and documents below the bound are done.
2. *Order.* The sets of what is left, one per class, are built again and all their
   shingles counted. Ordered by document frequency, rare ones first, linked documents
   share one of their first ``n - ceil(3n/4) + 1`` shingles: their prefixes. A set with
   ``s`` shingles that occur elsewhere overlaps nothing by more than s, so it links to no set
   of more than ``7s/3 - n`` shingles: its reach.
3. *Groups.* Documents with the same smallest shingle hash are compared with its few most
   central ones (those with the most frequent shingles) and join the group of one that they
   truly link to, in several rounds with other hashes for the heads of the groups. Groups of
   thousands of near copies come down to few.
4. *Matrix.* The token-group matrix holds a row for each shingle and group with that
   shingle in a member's prefix. Only groups that share a token of it meet, and only
   if their sizes are compatible.
5. *Bound and open.* The documents of the smaller group query the larger one: the
   union of its shingles must hold 3/4 of the query's. Only groups within the bound are
   opened, in chunks of CHUNK members, until a link is found.
6. *Components* over groups and classes.

Hot classes, hot shingles and large groups: copies count once per block, a shingle
is one entry per block with the number of its sets there, whatever that number is, and
large groups are opened in chunks.

Defined cases: null or blank text has an empty set, links with nothing and is its own
component. With fewer than five words, the whole sequence is one shingle. Rows that
share an identifier are one node. A null identifier has a null component. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hangarflow.llm import key_counts as K
from hangarflow.llm.components import components
from hangarflow.llm.interpolation import hashed_words
from hangarflow.llm.texts import carried, rows_again, text_or_empty
from hangarflow.session import stored

SHINGLE_WORDS = 5
PART, WHOLE = 3, 4
BLOCK_TOKENS = 1 << 21
WIDTH = 40
ROUNDS = 3
SUBGROUP = 256
LEADERS = 8
CHUNK = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xFF51AFD7ED558CCD)
_DOCUMENTS = 7 * K.KIND  # rows about a block's documents


def needed(n):
    """Least overlap of a set of n shingles with anything it links to."""
    return (PART * n + WHOLE - 1) // WHOLE


def shingle_sets(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each run of word hashes."""
    sets = []
    size = len(values) - SHINGLE_WORDS + 1
    rolled = np.zeros(max(size, 0), np.uint64)
    for k in range(SHINGLE_WORDS):
        if size > 0:
            rolled = (rolled ^ (rolled >> np.uint64(29))) * _STEP + values[k : k + size]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * _FINISH
    rolled ^= rolled >> np.uint64(31)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - begin >= SHINGLE_WORDS:
            sets.append(np.unique(rolled[begin : end - SHINGLE_WORDS + 1]))
        elif end > begin:
            digest = hashlib.blake2b(values[begin:end].tobytes(), digest_size=8).digest()
            sets.append(np.frombuffer(digest, "<u8").copy())
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    hashes = batch.column("words")
    values = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return shingle_sets(values, hashes.offsets.to_numpy() - hashes.offsets[0].as_py())


def _worded(docs: DataFrame, id_column: str, text_column: str, *extra: str) -> DataFrame:
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), *extra, hashed_words(text_or_empty(text_column)).alias("words")
    )


# ---------------------------------------------------------------------------
# 1. Shared shingles
# ---------------------------------------------------------------------------
def _documents(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, n, digest and whether the bound lets the document pass."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tokens = sequence = 0
        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), _sets_of(batch), strict=True):
                held.append((doc_id, len(own), own[own & np.uint64(1) == 0], _digest(own)))
                tokens += len(own)
                if tokens >= BLOCK_TOKENS:
                    yield from _half_entries(held, sequence, bits)
                    held, tokens, sequence = [], 0, sequence + 1
        yield from _half_entries(held, sequence, bits)

    def merge(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() >= _DOCUMENTS:
            return group
        keys = [np.cumsum(K.from_planes(k, WIDTH // 8), dtype=np.uint64) for k in group.column("keys").to_pylist()]
        counts = np.concatenate([K.unpack(c) for c in group.column("counts").to_pylist()])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        shared = (np.bincount(place, weights=counts.astype(np.float64)) > 1)[place]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        bits_of = [np.packbits(part).tobytes() for part in np.split(shared, ends)]
        return group.set_column(group.column_names.index("keys"), "keys", pa.array([b""] * len(bits_of), pa.binary())).set_column(
            group.column_names.index("counts"), "counts", pa.array(bits_of, pa.binary())
        )

    listed_rows = docs.mapInArrow(listed, K.ENTRY_SCHEMA)
    merged = listed_rows.groupBy("bucket").applyInArrow(merge, K.ENTRY_SCHEMA)
    per_block = merged.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "keys", "counts")).alias("replies"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in K.rows_of(batches):
            (about,) = [r for r in row["replies"] if r["bucket"] >= _DOCUMENTS]
            table = np.frombuffer(about["counts"], _DOCUMENT)
            own = sorted((r["bucket"], r["n"], r["counts"]) for r in row["replies"] if r["bucket"] < _DOCUMENTS)
            bits_of = [np.unpackbits(np.frombuffer(packed, np.uint8), count=many) for _, many, packed in own]
            often, owner = _unpack_owners(about["keys"])
            in_others = np.repeat(np.concatenate([np.zeros(0, np.uint8), *bits_of]), often).astype(bool)
            shared = np.bincount(owner[in_others], minlength=len(table))
            n = table["n"].astype(np.int64)
            # A copy inside the block was counted with its first occurrence.
            passes = shared[table["first"]] >= table["half"] - (n - needed(n))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(table["doc_id"], mask=table["no_id"].astype(bool)),
                    pa.array(n),
                    pa.array([d.tobytes() for d in table["digest"]], pa.binary()),
                    pa.array(passes & (n > 0)),
                ],
                ["doc_id", "n", "digest", "passes"],
            )

    return per_block.mapInArrow(judged, "doc_id long, n long, digest binary, passes boolean")


_DOCUMENT = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("n", "<u4"), ("half", "<u4"), ("first", "<u4"), ("digest", "u1", 16)])


def _pack_owners(often: np.ndarray, owner: np.ndarray) -> bytes:
    packed = K.pack(often)
    return len(packed).to_bytes(8, "little") + packed + K.pack(owner)


def _unpack_owners(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    end = 8 + int.from_bytes(packed[:8], "little")
    return K.unpack(packed[8:end]).astype(np.int64), K.unpack(packed[end:]).astype(np.int64)


def _half_entries(held: list[tuple], sequence: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A block's rows: its documents with the holders of each shingle, and the distinct shingles of the sampled half.

    A shingle is one entry with the number of distinct sets that hold it; which ones stays with the block.
    """
    if not held:
        return
    block = (TaskContext.get().partitionId() << 24) + sequence
    table = np.zeros(len(held), _DOCUMENT)
    seen: dict[bytes, int] = {}
    tokens, owners = [], []
    for at, (doc_id, n, half, digest) in enumerate(held):
        first = seen.setdefault(digest, at)
        table[at] = (doc_id or 0, doc_id is None, n, len(half), first, np.frombuffer(digest, np.uint8))
        if first == at:
            tokens.append(half)
            owners.append(np.full(len(half), at, np.int64))
    keys, owner = np.concatenate(tokens), np.concatenate(owners)
    owner = owner[np.argsort(keys, kind="stable")]
    keys, often = np.unique(keys, return_counts=True)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([_DOCUMENTS + block], pa.int64()),
            pa.array([block], pa.int64()),
            pa.array([len(held)], pa.int64()),
            pa.array([_pack_owners(often, owner)], pa.binary()),
            pa.array([table.tobytes()], pa.binary()),
        ],
        ["bucket", "block", "n", "keys", "counts"],
    )
    yield K.entries(block, 0, keys, often, bits, WIDTH)


# ---------------------------------------------------------------------------
# 2. Order
# ---------------------------------------------------------------------------
def _ordered(chosen: DataFrame, bits: int) -> DataFrame:
    """id, n, tokens (those another set has too), prefix and weight, of sets whose shared part can reach the bound.

    The weight is the mean logarithm of the document frequencies: high for the middle of a group of near copies.
    """

    def packed(held: list[tuple[int, np.ndarray]], sequence: int) -> pa.RecordBatch:
        block = (TaskContext.get().partitionId() << 24) + sequence
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([[doc_id for doc_id, _ in held]], pa.list_(pa.int64())),
                pa.array([[len(own) for _, own in held]], pa.list_(pa.int64())),
                pa.array([np.concatenate([own for _, own in held]).tobytes()], pa.binary()),
            ],
            ["block", "ids", "sizes", "tokens"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        tokens = sequence = 0
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), _sets_of(batch), strict=True)
            for doc_id, digest, own in rows:
                if _digest(own) != digest:  # another text under the same identifier
                    continue
                held.append((doc_id, own))
                tokens += len(own)
                if tokens >= BLOCK_TOKENS:
                    yield packed(held, sequence)
                    held, tokens, sequence = [], 0, sequence + 1
        if held:
            yield packed(held, sequence)

    blocks = stored(
        chosen.mapInArrow(cut, "block long, ids array<long>, sizes array<long>, tokens binary"), "jaccard-sets"
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in K.rows_of(batches):
            keys, times = np.unique(np.frombuffer(row["tokens"], np.uint64), return_counts=True)
            yield K.entries(row["block"], 0, keys, times, bits, WIDTH)

    replies = K.merged(blocks.mapInArrow(counted, K.ENTRY_SCHEMA), {0: WIDTH}).where("block >= 0")
    per_block = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("replies"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in K.rows_of(batches):
            tokens = np.frombuffer(row["tokens"], np.uint64)
            keys, place = np.unique(tokens, return_inverse=True)
            frequency = K.replies_in_order(row["replies"], 0)[place]
            ids, sizes, shared, firsts, weights = [], [], [], [], []
            ends = np.cumsum(row["sizes"])
            for doc_id, n, end in zip(row["ids"], row["sizes"], ends.tolist(), strict=True):
                own, often = tokens[end - n : end], frequency[end - n : end]
                common = often > 1
                if common.sum() < needed(n):
                    continue
                first = np.lexsort((own, often))[: n - needed(n) + 1]
                ids.append(doc_id)
                sizes.append(n)
                shared.append(own[common].view(np.int64))
                firsts.append(own[first[often[first] > 1]].view(np.int64))
                weights.append(float(np.log(often).mean()))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(shared, many),
                    pa.array(firsts, many),
                    pa.array(weights, pa.float64()),
                ],
                ["id", "n", "tokens", "prefix", "weight"],
            )

    return blocks.join(per_block, "block").mapInArrow(
        prefixes, "id long, n long, tokens array<long>, prefix array<long>, weight double"
    )


# ---------------------------------------------------------------------------
# 3. Groups
# ---------------------------------------------------------------------------
def _linked(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    """Whether two sorted sets link; the sizes count unshared shingles too."""
    # The arrays hold the shared shingles only, so they bound the overlap.
    if (PART + WHOLE) * min(len(a), len(b)) < PART * (n_a + n_b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (n_a + n_b - both)


def _calls(spark) -> int:
    """Python calls that small groups share: four for each shuffle partition."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _rows(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches(max_chunksize=256):
        for row in batch.to_pylist():
            yield row | {"tokens": np.sort(np.array(row["tokens"], np.int64))}


def _lead(sets: DataFrame, seed: int) -> DataFrame:
    """id and leader: a central document with the same smallest hash that it links to, or itself."""
    key = F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(seed))))
    keyed = stored(sets.select("id", "n", "tokens", "weight", key.alias("key")), "jaccard-keyed")
    parts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / SUBGROUP))
    narrow = keyed.select("id", "weight", "key").join(parts, "key").withColumn("part", part).repartition("key", "part")
    # The most central documents of each part first, then those of the key: never a whole key at once.
    for within in (["key", "part"], ["key"]):
        central = Window.partitionBy(*within).orderBy(F.desc("weight"), "id")
        narrow = narrow.withColumn("place", F.row_number().over(central)).where(F.col("place") <= LEADERS)
    leaders = narrow.select("id", "key", "place", "many").join(keyed.select("id", "n", "tokens"), "id")

    call = F.pmod(F.xxhash64("key", "part"), F.lit(_calls(sets.sparkSession))).alias("call")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("many") / SUBGROUP) - 1)).alias("part")
    asked = keyed.join(parts, "key").select("id", "n", "tokens", "key", part.alias("part")).select("*", call)
    asked = asked.repartition("call")
    heads = leaders.select("id", "n", "tokens", "key", "place", every).select("*", call)
    heads = heads.toDF(*heads.columns)  # columns of its own, though both sides come from one table

    def follow(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[tuple[int, int], list[dict]] = {}
        for row in sorted(_rows(right), key=lambda row: row["place"]):
            known.setdefault((row["key"], row["part"]), []).append(row)
        for heads_ in known.values():
            for at, row in enumerate(heads_):
                before = (h for h in heads_[:at] if _linked(row["tokens"], row["n"], h["tokens"], h["n"]))
                row["root"] = next((h["root"] for h in before), row["id"])
        chosen: dict[int, int] = {}
        for row in _rows(left):
            own = known.get((row["key"], row["part"]), [])
            near = [h for h in own if h["id"] == row["id"]] or (
                h for h in own if _linked(row["tokens"], row["n"], h["tokens"], h["n"])
            )
            chosen[row["id"]] = next((h["root"] for h in near), row["id"])
        return pa.table({"id": pa.array(list(chosen), pa.int64()), "leader": pa.array(list(chosen.values()), pa.int64())})

    found = asked.groupBy("call").cogroup(heads.groupBy("call")).applyInArrow(follow, "id long, leader long")
    everyone = keyed.select("id").distinct()
    return everyone.join(found, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def _groups(sets: DataFrame) -> DataFrame:
    """id and group: the document whose group it belongs to after all rounds."""
    followed = stored(_lead(sets, 0), "jaccard-leaders")
    for seed in range(1, ROUNDS):
        heads = followed.select(F.col("leader").alias("id")).distinct()
        further = _lead(sets.join(heads, "id", "left_semi"), seed).toDF("leader", "next")
        followed = stored(followed.join(further, "leader").select("id", F.col("next").alias("leader")), "jaccard-leaders")
    return followed.withColumnRenamed("leader", "group")


# ---------------------------------------------------------------------------
# 4 and 5. Matrix, bound, open
# ---------------------------------------------------------------------------
def _open(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between groups: ``a`` and ``b``."""
    spark = sets.sparkSession
    reach = (PART + WHOLE) * F.size("tokens") - PART * F.col("n")  # PART times the largest partner
    grouped = stored(sets.join(groups, "id").withColumn("reach", reach), "jaccard-grouped")
    about = grouped.groupBy("group").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.max("reach").alias("reach"),
    )
    matrix = grouped.select("group", F.explode("prefix").alias("token")).distinct()
    several = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token")
    rows = stored(matrix.join(several, "token").join(about, "group"), "jaccard-matrix")
    compatible = (
        (F.col("x.most") * WHOLE >= F.col("y.least") * PART)
        & (F.col("y.most") * WHOLE >= F.col("x.least") * PART)
        & (F.col("x.reach") >= F.col("y.least") * PART)
        & (F.col("y.reach") >= F.col("x.least") * PART)
    )
    larger = (F.col("y.members") > F.col("x.members")) | (
        (F.col("y.members") == F.col("x.members")) & (F.col("y.group") > F.col("x.group"))
    )
    meeting = (
        rows.alias("x")
        .join(rows.alias("y"), (F.col("x.token") == F.col("y.token")) & larger & compatible)
        .select(
            F.col("x.group").alias("asking"),
            F.col("y.group").alias("opened"),
            F.col("y.members").alias("members"),
            F.col("y.least").alias("least"),
            F.col("y.most").alias("most"),
        )
        .distinct()
    )
    asking = grouped.select("id", "n", "reach", F.col("group").alias("asking"))
    fits = (F.col("reach") >= F.col("least") * PART) & (F.col("most") * WHOLE >= F.col("n") * PART)
    queries = stored(
        meeting.join(asking, "asking").where(fits).select("id", "n", "asking", "opened", "members"), "jaccard-queries"
    )

    # The union of a group's shingles bounds the overlap with each member.
    several_members = queries.where("members > 1")
    opened = several_members.select("opened").distinct()
    union = (
        grouped.join(opened, F.col("group") == F.col("opened"), "left_semi")
        .select(F.col("group").alias("opened"), F.explode("tokens").alias("token"))
        .distinct()
    )
    asked = several_members.join(grouped.select("id", "tokens"), "id").select(
        "id", "n", "opened", F.explode("tokens").alias("token")
    )
    within = (
        asked.join(union, ["opened", "token"])
        .groupBy("id", "n", "opened")
        .agg(F.count(F.lit(1)).alias("overlap"))
        .where(F.col("overlap") * WHOLE >= F.col("n") * PART)
        .select("id", "opened")
    )
    qualifying = queries.join(within, ["id", "opened"], "left_semi").unionByName(queries.where("members = 1"))
    chunks = F.ceil(F.col("members") / CHUNK)
    asks = qualifying.join(grouped.select("id", "tokens"), "id").select(
        "id", "n", "tokens", "asking", "opened", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk")
    )
    holds = (
        grouped.join(qualifying.select(F.col("opened").alias("group"), "members").distinct(), "group")
        .select("id", "n", "tokens", F.col("group").alias("opened"), F.pmod(F.xxhash64("id"), chunks).alias("chunk"))
    )
    call = F.pmod(F.xxhash64("opened", "chunk"), F.lit(_calls(spark)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        members: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for row in _rows(right):
            members.setdefault((row["opened"], row["chunk"]), []).append((row["n"], row["tokens"]))
        links: set[tuple[int, int]] = set()
        for row in _rows(left):
            link, own, n = (row["asking"], row["opened"]), row["tokens"], row["n"]
            held = members.get((row["opened"], row["chunk"]), ())
            if link not in links and any(_linked(own, n, other, m) for m, other in held):
                links.add(link)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return asks.groupBy(call.alias("call")).cogroup(holds.groupBy(call.alias("call"))).applyInArrow(compare, "a long, b long")


# ---------------------------------------------------------------------------
# The join
# ---------------------------------------------------------------------------
def connect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    size = docs.select(F.sum(F.length(text_or_empty(text_column)))).first()[0] or 0
    bits = K.bucket_bits(size // 8)  # about the words of half the texts
    seen = stored(_documents(_worded(docs, id_column, text_column), bits), "jaccard-documents")

    known = seen.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("class"), F.max("passes").alias("passes"))
    chosen = classes.where("passes").select(F.col("class").alias("doc_id_"), "digest")
    texts = docs.select(id_column, text_column).join(chosen, F.col(id_column) == F.col("doc_id_"))
    sets = stored(_ordered(_worded(texts, id_column, text_column, "digest"), bits), "jaccard-ordered")
    groups = _groups(sets)
    links = components(_open(sets, groups))
    joined = groups.join(links, F.col("group") == F.col("node"), "left").select(
        F.col("id"), F.coalesce("component", "group").alias("component")
    )
    # Rows that share an identifier are one node, whatever their classes.
    repeated = known.select("doc_id", "digest").distinct().join(classes.select("digest", "class"), "digest")
    own = known.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    ties = repeated.join(own, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    all_links = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
    final = _smallest(joined) if ties.isEmpty() else components(ties.unionByName(all_links))
    per_class = classes.join(final, F.col("class") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "class").alias("component_id")
    )
    linked = seen.join(per_class, "digest", "left")
    return linked.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias(
            "component_id"
        ),
    )


def _smallest(joined: DataFrame) -> DataFrame:
    """Name each component by its smallest document."""
    least = joined.groupBy("component").agg(F.min("id").alias("least"))
    return joined.join(least, "component").select(F.col("id").alias("node"), F.col("least").alias("component"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of rows: the one with the smallest identifier, null last.

    Rows are numbered, so identifiers may be missing or repeated: near copies among such rows leave
    one row too. Rows of one identifier whose texts do not link all stay. Between equal identifiers
    the hash of the text decides. Rows without words stay.
    """
    numbered = stored(
        carried(docs, number=F.monotonically_increasing_id(), id=F.col(id_column), hash=F.xxhash64(text_or_empty(text_column))),
        "jaccard-rows",
    )
    texts = numbered.select("number", F.col("row").getField(text_column).alias("text"))
    named = connect(texts, "number", "text").select(F.col("doc_id").alias("number"), "component_id")
    order = F.struct(F.col("id").isNull(), "id", "hash", "number")
    keys = numbered.select("number", order.alias("order"))
    first = named.join(keys, "number").groupBy("component_id").agg(F.min("order").getField("number").alias("number"))
    return rows_again(numbered.join(first, "number", "left_semi"))
