"""Near duplicates: MinHash bands, sequential Bayesian pruning, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.text import batches_of, scramble, shingle_set, utf8, word_hashes
from tidewire.operators.graph import SNAP
from tidewire.operators.graph_iter import components
from tidewire.session import settle

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 5  # a pair at the threshold misses every band with probability 2e-4
BATCH = 32  # signature places compared at a time
BLOCK = 256  # nodes of a bucket that are compared with as many others in one group
MISS = 1e-6  # a pair is pruned when its similarity reaches the threshold with at most this probability


def _factors() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(7).integers(0, 1 << 32, size=(2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


_FACTOR, _SHIFT = _factors()
_BAND_SEED = scramble(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the BANDS * ROWS permutations over a set of 64-bit hashes."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(high), 256):
        np.minimum(least, (high[at : at + 256, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = _BAND_SEED
    for place in least.reshape(BANDS, ROWS).T:
        keys = scramble(keys + place.astype(np.uint64))
    return keys.view(np.int64)


def sequence_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))]
)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                low = text.lower()  # A-Z only
                words = low.split()  # at the separators of WORD
                if not words:
                    yield key, mark, 0, None, None, None
                    continue
                shingles = shingle_set(word_hashes(low), WORDS)
                least = signature(shingles)
                # One byte of each place is kept: two unequal places agree in it once in 256 times.
                yield key, mark, len(shingles), sequence_key(words), least.astype(np.uint8).tobytes(), band_keys(least)

    yield from batches_of(rows(), SIGNED, size=4000)


SETS = pa.schema([("node", pa.binary()), ("hashes", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        seen = set()  # nodes of this task: repeated rows give one set
        for batch in batches:
            for text, wanted in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                low = text.lower()
                if wanted not in seen and sequence_key(low.split()) == wanted:
                    seen.add(wanted)
                    yield wanted, shingle_set(word_hashes(low), WORDS).tobytes()

    yield from batches_of(rows(), SETS, size=4000)


def least_matches(n: int, threshold: float = PERCENT / 100, miss: float = MISS) -> int:
    """Fewest matches in ``n`` places that leave the threshold likelier than ``miss``.

    With a uniform prior the similarity given m matches is Beta(m + 1, n - m + 1); its upper tail is a
    binomial sum: P(S >= t) = P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail > miss:
            return m
    return n


_LEAST = [(n, least_matches(n)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def survivors(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Places of the signature pairs that no batch of places rules out; a pair below the bound is compared no further."""
    alive, matches = np.arange(len(one)), np.zeros(len(one), dtype=np.int64)
    for n, least in _LEAST:
        place = slice(n - BATCH, n)
        matches = matches + (one[alive, place] == two[alive, place]).sum(axis=1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def _matrix(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), dtype=np.uint8).reshape(-1, BANDS * ROWS)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alive = pa.array(survivors(*(_matrix(batch.column(i).to_pylist()) for i in (2, 3))))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], names=["a", "b"])


def _overlap(one: np.ndarray, two: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two sets."""
    both = np.intersect1d(one, two, assume_unique=True).size
    return both, one.size + two.size - both


def _similar(one: np.ndarray, two: np.ndarray) -> bool:
    both, total = _overlap(one, two)
    return 100 * both >= PERCENT * total


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        keep = pa.array([_similar(*(np.frombuffer(x, dtype=np.uint64) for x in pair)) for pair in ends], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


EXTRAS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("both", pa.int64()), ("extras", pa.list_(pa.int64()))])


def _extras(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a node b shares with its hub a, and marks of its other shingles; a mark stands for hub and shingle."""

    def rows():
        for batch in batches:
            for hub, node, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                one, two = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                more = np.setdiff1d(two, one, assume_unique=True)
                marks = scramble(more + np.frombuffer(hub[:8], dtype=np.uint64))
                yield hub, node, len(two) - len(more), marks.view(np.int64)

    yield from batches_of(rows(), EXTRAS, size=2000)


def _block(table: pa.Table) -> pa.Table:
    """Links between nodes of different labels in two blocks of a bucket (or in one): pruned, then confirmed.

    Labels that a link has joined count as one from then on.
    """
    nodes, labels, own = table["node"].to_pylist(), table["label"].to_pylist(), table["own"].to_numpy()
    sizes, signs = table["n"].to_numpy(), _matrix(table["sig"].to_pylist())
    sets = [np.frombuffer(h, dtype=np.uint64) for h in table["hashes"].to_pylist()]
    group = {}
    label = np.array([group.setdefault(x, len(group)) for x in labels])
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    links = []
    for x in np.flatnonzero(own == i):
        others = np.flatnonzero(own == j)
        others = others[others > x] if i == j else others
        near = 100 * np.minimum(sizes[others], sizes[x]) >= PERCENT * np.maximum(sizes[others], sizes[x])
        others = others[near & (label[others] != label[x])]
        found = survivors(np.broadcast_to(signs[x], (len(others), signs.shape[1])), signs[others])
        for y in others[found]:
            if label[x] != label[y] and _similar(sets[x], sets[y]):
                links.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
                label[label == label[y]] = label[x]
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def _beside(pairs: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) with the fact of both ends."""
    one, other = (facts.select(F.col("node").alias(end), F.col(name).alias(f"{name}_{end}")) for end in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", f"{name}_a", f"{name}_b")


def _linked(pairs: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked: pruned on their signatures, confirmed on their full sets."""
    alive = _beside(settle(pairs.distinct()), signs, "sig").mapInArrow(_prune, "a binary, b binary")
    return settle(_beside(alive, sets, "hashes").mapInArrow(_confirm, "a binary, b binary"))


def _ordered(one: str, two: str) -> list:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _sizes_allow(one: str, two: str):
    """A pair of sets can only be linked if the smaller has PERCENT of the larger's size."""
    return F.least(one, two) * 100 >= F.greatest(one, two) * PERCENT


def _labels(links: DataFrame) -> DataFrame:
    edges = links.select(F.lit(0).alias(SNAP), F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(F.lit(0).alias(SNAP), "node")
    return components(nodes, edges).select("node", "label")


def _open(placed: DataFrame) -> DataFrame:
    """The rows (band, node, label, ...) of buckets that hold more than one label."""
    divided = placed.groupBy("band").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("band")
    return placed.join(divided, "band", "left_semi")


def _eligible(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of nodes that may have a link to another member of their bucket besides the hub.

    Around a hub a node can share with another one at most what it shares with the hub and those of its other shingles
    that some further node around the hub has. If even that is too little for the smallest partner its
    size allows, the node has no link there. That rules out documents that only share a passage, and copies with
    too many changes of their own, with work in proportion to the nodes.
    """
    around = placed.where(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    seen = settle(_beside(around, sets, "hashes").mapInArrow(_extras, "a binary, b binary, both long, extras array<long>"))
    marks = seen.select("a", "b", F.explode("extras").alias("mark"))
    common = marks.groupBy("mark").agg(F.count("*").alias("often")).where("often > 1").select("mark")
    shared = marks.join(common, "mark").groupBy("a", "b").agg(F.count("*").alias("more"))
    sized = seen.select("a", "b", "both", (F.col("both") + F.size("extras")).alias("n"))
    lowest = sized.groupBy("a").agg(F.min("n").alias("low"))
    bound = F.col("both") + F.coalesce("more", F.lit(0))
    partner = F.greatest("low", F.ceil(F.col("n") * PERCENT / 100), bound)
    alive = (
        sized.join(shared, ["a", "b"], "left").join(lowest, "a")
        .where(bound * 100 >= (F.col("n") + partner - bound) * PERCENT)
        .select(F.col("a").alias("hub"), F.col("b").alias("node"))
    )
    return placed.join(alive, ["hub", "node"], "left_semi")


def _linked_in_blocks(placed: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between differently labelled members of a bucket.

    A bucket of m nodes is dealt into m / BLOCK blocks; a group holds two of them, so no group grows with the bucket and
    each node is sent once per block, not once per partner. Only links leave a group.
    """
    blocks = placed.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))
    )
    rows = dealt.join(signs, "node").join(sets, "node").select("band", "node", "label", "n", "own", "sig", "hashes", F.inline(met))
    return settle(rows.groupBy("band", "i", "j").applyInArrow(_block, "a binary, b binary").distinct())


def signed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, node (null without words), sig and bands of every document."""
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return settle(narrow.mapInArrow(_sign, "doc_id long, hash long, n_shingles long, node binary, sig binary, bands array<long>"))


def _components(docs: DataFrame) -> DataFrame:
    """doc_id, hash, n_shingles, label: nodes of one component share a label, texts without words have none."""
    signed = signed_documents(docs)
    nodes = signed.where("node IS NOT NULL")
    bands = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band")).distinct()
    shared = bands.groupBy("band").agg(F.count("*").alias("_n"), F.min(F.struct("node", "n")).alias("hub")).where("_n > 1").select("band", "hub")
    members = settle(bands.join(shared, "band"))
    # Signatures and full sets of the nodes that met another one, from one document each.
    met = settle(members.select("node").distinct())
    known = nodes.join(met, "node", "left_semi")
    signs = settle(known.select("node", "sig").dropDuplicates(["node"]))
    wanted = known.groupBy("node").agg(F.min("doc_id").alias("_wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = settle(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted"))).select("text", "node").mapInArrow(_sets, "node binary, hashes binary"))
    # First every bucket's hub with its members.
    stars = members.where((F.col("node") != F.col("hub.node")) & _sizes_allow("n", "hub.n")).select(*_ordered("node", "hub.node"))
    links = _linked(stars, signs, sets)
    labels = _labels(links)
    placed = members.join(labels, "node", "left").select("band", "node", "n", F.col("hub.node").alias("hub"), F.coalesce("label", "node").alias("label"))
    # Then those members that are not joined yet but may have a link.
    eligible = settle(_open(settle(_eligible(settle(_open(placed)), sets))))
    more = _linked_in_blocks(eligible, signs, sets)
    labels = _labels(settle(links.unionByName(more)))
    named = signed.select("doc_id", "hash", "n_shingles", "node").join(labels, "node", "left")
    return settle(named.select("doc_id", "hash", "n_shingles", F.coalesce("label", "node").alias("label")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Links by Jaccard similarity of 5-word shingles, as components: doc_id, n_shingles, component_id, kept.

    Words are split at blanks and control characters after lower-casing A-Z. A document's set holds its distinct
    5-word shingles; a shorter one's whole sequence is one shingle; null, empty and blank texts have none and
    stay alone. Linked are documents with 100 * intersection >= 75 * union. The component is named by its smallest
    doc_id, ``kept`` says that a document bears it; rows that repeat a doc_id and its text share their row's
    result; a null doc_id is never a name unless its whole component is null. An empty table gives an
    empty result, other columns are not read.

    Documents with the same word sequence are one node; nodes meet in buckets (they agree in a band). First the hub of
    each bucket is compared with its members, which joins a group of near copies at once; what lies
    inside one component need not be compared. In the buckets that are still divided, nodes for which a bound
    excludes any further link leave; the others are compared block by block. So no link is lost, and a group of copies
    never becomes all its pairs. Pairs are pruned on signatures in batches while the posterior leaves a chance above
    MISS; survivors are confirmed on their full sets.
    """
    named = _components(docs)
    names = named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = named.join(names, "label", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with their columns: of every component the one with the smallest doc_id (null last).

    Of several rows with that doc_id the smallest text hash decides, and rows that repeat both are one. Texts without
    words are never copies of another document.
    """
    named = _components(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash"))
    chosen = named.where("label IS NOT NULL").groupBy("label").agg(first.alias("d")).select("d.doc_id", "d.hash")
    chosen = chosen.unionByName(named.where("label IS NULL").select("doc_id", "hash").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    lowest = F.lit(-(2**63))
    rows = rows.withColumn("id", F.coalesce("doc_id", lowest)).drop("doc_id")
    chosen = chosen.select(F.coalesce("doc_id", lowest).alias("id"), "hash")
    once = Window.partitionBy("id", "hash").orderBy(F.lit(0))
    return rows.join(chosen, ["id", "hash"], "left_semi").withColumn("again", F.row_number().over(once)).where("again = 1").select("row.*")
