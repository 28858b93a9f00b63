"""Near-duplicate detection: banded MinHash, odd sketches, and confirmation on full shingle sets.

1. Every document becomes the set of its distinct shingles of consecutive words (64-bit hashes, in Arrow
   batches), of which only the size, a 128-bit hash of the whole set, band hashes of a MinHash signature
   and an odd sketch are kept. Documents with equal sets are one class from here on.
2. Classes that agree in a band are candidates. BANDS bands of ROWS rows miss a pair at the threshold with
   probability (1 - t^ROWS)^BANDS, 5e-8 for t = 0.8.
3. The odd sketch folds the MinHash samples into a parity bitmap; the population count of the XOR of two
   sketches estimates how many samples differ. Candidates beyond a cut that a pair at the threshold passes
   with all but 1e-9 are dropped.
4. The others are confirmed on the full sets.

Buckets may hold a third of all rows, so pairs within a bucket are not formed. Each member is compared
with the leader that it shares most buckets with, then, if still apart, with the leaders of its other
buckets, and the links are joined into components. Only classes in buckets
that still hold several components go on, to a set-similarity join: every set is ordered by how
common its shingles are, and two sets at the threshold must share one within their rarest fifth and ninth,
at places that leave room for enough others, and the odd sketches of the whole sets, which estimate how much
they differ, must allow it (a pair at the threshold fails with probability MISS at most). Tokens of one
component only are dropped, and of each other token the rows of its largest component never meet each other.
How common a shingle is comes from a table of COUNTERS counters, whose size is fixed; its errors cost time,
not results.

A group of n near copies has up to n * n / 2 such meetings, nearly all of them links that a few others make
needless. So they are taken in rounds (module meetings): cells of a token's sets, which are drawn before the join and
grow from round to round to the whole token, and before each the links found so far are joined. No meeting of sets that
are still apart is left out. Sketches are looked up for the sets of a round and are not written with its posts.

Defined cases: null and empty texts and those without words have no shingles and are linked with nothing;
with fewer words than a shingle has, the whole sequence is the only shingle; rows with a null doc_id are
linked with nothing (component null, kept); rows that repeat a doc_id with other texts are judged each by its own text, and
of those in one component the one with the least hash of its text stays; rows that repeat both stay or go together; an
empty table gives an empty table; further columns pass through near_dedup.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import documents, marked, materialise, rows_of, with_null, without, without_null
from corpusforge.llm.components import components
from corpusforge.llm.meetings import dealt, met, rounds, still_open

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS, PARITY_BITS = 512, 1024
MISS = 1e-9
#: Standard deviations that a normal value exceeds with less than MISS.
DEVIATIONS = 6.2
SIGNATURE = "doc_id long, none boolean, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"
COUNTERS = 1 << 18
WORD_CACHE = 400_000
#: Bytes of text that a worker of the first steps takes at once.
PART_BYTES = 1 << 20

_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
OFFSETS = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hash of a word, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= WORD_CACHE:
            self.clear()
        if len(word) < 64:
            self[word] = found
        return found


def shingles(text: str, words: Words, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(ids) - size + 1)
    out = np.full(n, np.uint64(min(len(ids), size)))
    for k in range(min(size, len(ids))):
        out = mixed(out * MIX[0] + ids[k : k + n])
    return np.unique(out)


def samples(found: np.ndarray) -> np.ndarray:
    """The MinHash signature: the least of each of SAMPLES permutations of 32-bit numbers."""
    out = np.full(SAMPLES, 2**32 - 1, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 16_384):  # parts that stay in the processor's cache
        part = short[at : at + 16_384]
        for i in range(SAMPLES):
            out[i] = min(out[i], (part * FACTORS[i] + OFFSETS[i]).min())
    return out.astype(np.uint64)


def odd_sketch(signature: np.ndarray) -> np.ndarray:
    """Parity bitmap of (index, sample): each flips one bit."""
    where = mixed(signature * MIX[0] + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    bits = np.bincount(where.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * MIX[0] + rows[:, k])
    return out.view(np.int64)


def sketch_limit(percent: int) -> int:
    """XOR bits that a pair at the threshold exceeds with probability under MISS: each differing sample flips two bits at most."""
    p, tail = 1 - percent / 100, 0.0
    for differing in range(SAMPLES, -1, -1):
        tail += math.comb(SAMPLES, differing) * p**differing * (1 - p) ** (SAMPLES - differing)
        if tail > MISS:
            return 2 * differing
    return 0


def set_hash(found: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of a sorted set."""
    return np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut after PART_BYTES of text or the row that exceeds them, so that a worker holds what it makes of a part, not of all texts."""
    begin, held = 0, 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)):
        held += int(n)
        if held > PART_BYTES:
            yield batch.slice(begin, at + 1 - begin)
            begin, held = at + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


LONGS = pa.list_(pa.int64())


def _signatures(size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in (p for batch in batches for p in parts_of(batch)):
            counts, hashes, bands, sketches = [], [], [], []
            with np.errstate(over="ignore"):
                for text in part["text"]:
                    found = shingles(text.as_py(), words, size)
                    signature = samples(found) if len(found) else None
                    counts.append(len(found))
                    hashes.append(set_hash(found) if len(found) else (0, 0))
                    bands.append([] if signature is None else band_hashes(signature))
                    sketches.append([] if signature is None else odd_sketch(signature))
            made = [pa.array(counts, pa.int64()), *[pa.array([h[i] for h in hashes], pa.int64()) for i in (0, 1)], pa.array(bands, LONGS), pa.array(sketches, LONGS)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["none"], part["text_hash"], *made], names=["doc_id", "none", "text_hash", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return of


def _sets(size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in (p for batch in batches for p in parts_of(batch)):
            with np.errstate(over="ignore"):
                found = [shingles(t.as_py(), words, size).view(np.int64) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(found, LONGS)], names=["id", "found"])

    return of


def linked(a: str, b: str, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def xor_bits(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and text_hash, which tells rows of one doc_id apart."""
    texts = plain_texts(docs, text, doc_id)
    signed = with_null(without_null(texts, "doc_id").mapInArrow(_signatures(shingle), SIGNATURE), "doc_id")
    return grouped(signed, ["bands", "sketch"], lambda reps: _class_components(reps, texts, shingle, percent))


def grouped(signed: DataFrame, columns: list[str], link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components of rows (doc_id, text_hash, n_shingles, set_a, set_b and columns), of which those with equal sets are one class.

    link takes the classes (id, doc_id, text_hash, n_shingles and columns of their first rows) and returns (node, component) of those with links.
    Rows are numbered as they are written; columns, which may be long, are shuffled only for rows that may be copies.
    """
    signed = materialise(signed.withColumn("id", F.monotonically_increasing_id()))
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_hash", "id")).alias("first"), F.count("*").alias("n"))
    several = materialise(classes.filter("n > 1").select("set_a", "set_b", "first"))
    light = marked(some.select("id", "set_a", "set_b"), F.col("set_a"), several, F.col("set_a"), "perhaps").filter("perhaps")
    copies = materialise(light.join(several, ["set_a", "set_b"]).filter("id <> first.id").select("id", "first"))
    reps = without(some.select("id", "doc_id", "text_hash", "n_shingles", *columns), "id", copies.select("id"))
    found = link(reps)
    named = found.join(signed.select("id", "doc_id", "text_hash"), F.col("node") == F.col("id")).select("node", "component", F.struct("doc_id", "text_hash").alias("name"))
    named = materialise(named)
    least = named.groupBy("component").agg(F.min("name").alias("least"))
    named = named.join(least, "component").select("node", "least")
    rows = signed.select("id", "doc_id", "text_hash", "n_shingles").join(copies, "id", "left")
    own = F.when(F.col("first").isNotNull(), F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))).otherwise(F.struct("doc_id", "text_hash"))
    rows = rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("first.id", "id").alias("class"), own.alias("own"))
    out = rows.join(named, F.col("class") == F.col("node"), "left")
    member = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.select("doc_id", "text_hash", "n_shingles", F.when(member, F.coalesce("least", "own")).alias("stays"))
    kept = F.col("stays").isNull() | ((F.col("doc_id") == F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash")))
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("stays.doc_id", "doc_id").alias("component_id"), kept.alias("kept"))


def plain_texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))


def sets_of(classes: DataFrame, texts: DataFrame, of: Callable, schema: str) -> DataFrame:
    """What ``of`` makes of the texts of classes (id, doc_id, text_hash), written; only texts whose hash may be theirs are shuffled."""
    wanted = marked(texts, F.col("text_hash"), classes, F.col("text_hash"), "wanted").filter("wanted").drop("wanted")
    wanted = wanted.join(classes.select("id", "doc_id", "text_hash"), ["doc_id", "text_hash"])
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text")
    return materialise(wanted.mapInArrow(of, schema))


def led_buckets(posts: DataFrame) -> DataFrame:
    """posts (token, id) of tokens with several ids, with the leader, the least id, and the number m of each, written."""
    shared = materialise(posts.groupBy("token").agg(F.min("id").alias("leader"), F.count("*").alias("m")).filter("m > 1"))
    perhaps = marked(posts, F.col("token"), shared, F.col("token"), "perhaps").filter("perhaps")
    return materialise(perhaps.join(shared, "token").select("token", "id", "leader", "m"))


def among(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows whose id may be among the members': all that are and, as the filter is a bitmap, some others."""
    return marked(rows, F.col("id"), members.select("id").distinct(), F.col("id"), "perhaps").filter("perhaps").drop("perhaps")


def _class_components(reps: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have links."""
    members = led_buckets(reps.select("id", F.explode("bands").alias("token"))).withColumnRenamed("token", "band")
    sketches = materialise(among(reps.select("id", "doc_id", "text_hash", "n_shingles", "sketch"), members))
    sets = sets_of(sketches, texts, _sets(shingle), "id long, found array<long>")
    limit = sketch_limit(percent)

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and sketches allow a link."""
        a, b = (sketches.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")) for s in "ab")
        fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (xor_bits("sa", "sb") <= limit)
        return pairs.join(a, "a").join(b, "b").filter(fits).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs that are similar by their full sets. The pairs are written first, so that few of them are broadcast."""
        pairs = materialise(plausible(pairs))
        a, b = (sets.select(F.col("id").alias(s), F.col("found").alias(f"f{s}")) for s in "ab")
        return materialise(pairs.join(a, "a").join(b, "b").filter(linked("fa", "fb", percent)).select("a", "b"))

    # the leader that a class shares most bands with, then its other leaders, then all that is still apart
    led = members.filter("id <> leader").groupBy(F.col("id").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("bands"))
    led = materialise(led)
    best = led.groupBy("a").agg(F.max_by("b", F.struct("bands", "b")).alias("b"))
    labels = components(confirmed(best))
    others = led.select("a", "b").join(best, ["a", "b"], "left_anti")
    labels = merged_labels(labels, confirmed(apart(others, labels)))
    tagged = members.filter("m > 2").join(labels, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    open_bands = tagged.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    several = materialise(tagged.join(open_bands, "band", "left_semi").select("id").distinct())
    if several.isEmpty():
        return labels
    posts, facts = prefix_posts(materialise(sets.join(several, "id")), percent)
    for at in range(rounds(posts)):
        posts = still_open(posts, labels)
        labels = merged_labels(labels, confirmed(meetings(posts, facts, percent, at)))
    return labels


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose classes are not in one component yet."""
    la, lb = (labels.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
    pairs = pairs.join(la, "a", "left").join(lb, "b", "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links, which join whole components."""
    if links.isEmpty():
        return labels
    la, lb = (labels.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
    between = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between).withColumnsRenamed({"node": "old", "component": "new"})
    known = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    return materialise(known.join(joined, known["component"] == joined["old"], "left").select("node", F.coalesce("new", "component").alias("component")))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for found in batch["found"]:
            total += np.bincount(counter_of(found), minlength=COUNTERS)
    parts = total.reshape(64, -1)
    yield pd.DataFrame({"part": range(64), "counts": [p.astype(np.int32).tobytes() for p in parts]})


def _summed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in frame["counts"])
    return pd.DataFrame({"part": [key[0]], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def counter_of(found: np.ndarray) -> np.ndarray:
    return (np.asarray(found, np.int64).view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)


def prefix_posts(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rarest shingles of each set (id, found) at their places in the common order, (token, id, n, near, place, deep), and (id, bits)."""
    spark = sets.sparkSession
    # 64 rows of fixed size: COUNTERS counters in all
    parts = sets.select("found").mapInPandas(_counts, "part int, counts binary").groupBy("part").applyInPandas(_summed, "part int, counts binary").collect()
    counts = spark.sparkContext.broadcast(np.frombuffer(b"".join(r.counts for r in sorted(parts)), np.int32))

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, found in zip(batch["id"], batch["found"]):
                found = np.asarray(found, np.int64)
                n = len(found)
                order = np.lexsort((found, counts.value[counter_of(found)]))
                prefix = found[order[: n - -(-percent * n // 100) + 1]]
                rows.append((i, n, n - -(-2 * percent * n // (100 + percent)) + 1, prefix, parity(found)))
            yield pd.DataFrame(rows, columns=["id", "n", "near", "prefix", "bits"])

    rows = materialise(sets.mapInPandas(rarest, "id long, n int, near int, prefix array<long>, bits array<long>"))
    posts = rows.select("id", "n", "near", F.posexplode("prefix").alias("place", "token"))
    return dealt(posts), rows.select("id", "bits")


def meetings(posts: DataFrame, facts: DataFrame, percent: int, at: int) -> DataFrame:
    """(a, b): pairs of sets of different components that may reach the threshold, of the meetings of a round.

    With o common elements, 100 o >= percent (x + y - o) needs (100 + percent) o >= percent (x + y). If the
    first common element in the common order stands at places i and j, o is at most min(x - i, y - j). In the
    smaller set it stands within the first ``near`` places.
    """

    def fits(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        both = x("n") + y("n")
        room = (100 + percent) * F.least(x("n") - x("place"), y("n") - y("place")) >= percent * both
        larger = (x("n") > y("n")) | ((x("n") == y("n")) & (x("id") > y("id")))
        early = F.when(larger, y("place") < y("near")).otherwise(x("place") < x("near"))
        return room & early & (xor_bits(x("bits"), y("bits")) <= parity_limit(both, percent))

    return met(posts, facts, fits, at)


def parity_limit(both: Column, percent: int) -> Column:
    """XOR bits of two parity sketches that two sets of these sizes at the threshold exceed with probability MISS at most.

    They differ in d = both * (100 - percent) / (100 + percent) elements at most, each of which flips one of m
    bits: (1 - q) m / 2 bits in the mean with q = (1 - 2 / m) ** d, with a variance below (1 - q * q) m / 4,
    and never more than d.
    """
    differ = both * (100 - percent) / (100 + percent)
    q = F.pow(F.lit(1 - 2 / PARITY_BITS), differ)
    return F.least(differ, (1 - q) * (PARITY_BITS / 2) + DEVIATIONS * F.sqrt((1 - q * q) * (PARITY_BITS / 4)))


def parity(found: np.ndarray) -> np.ndarray:
    """Odd sketch of a whole set. The XOR of two has at most as many bits as the sets differ in elements: a bound, not an estimate."""
    with np.errstate(over="ignore"):
        where = mixed(found.view(np.uint64) * MIX[0]) % np.uint64(PARITY_BITS)
    bits = np.bincount(where.astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that stay: one of each component and all without links, with all their columns."""
    groups = near_groups(docs, text, doc_id, shingle, percent)
    gone = materialise(groups.filter(~F.col("kept")).select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct())
    rows = docs.select(rows_of(docs).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    rows = marked(rows, F.col("hash"), gone, F.col("gone_hash"), "perhaps")
    judged = rows.filter("perhaps").join(gone, (F.col("id") == F.col("gone")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    return rows.filter("NOT perhaps").select("row.*").unionByName(judged.select("row.*"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), shingle=4).drop("text_hash")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS sh
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
