"""Source divergence audit: term frequencies of each source against the other sources of its language.

Terms are counted by length-bucketed packing. A task takes its texts in blocks of about BLOCK_BYTES, finds all
terms of a block in the bytes of its Arrow column at once, and packs them: up to 8 bytes become one uint64 word,
up to 16 bytes two, big end first, so that the order of words is the order of bytes. Words are radix-sorted, 16
bits a pass, after the passes for the group; equal neighbours are runs, whose lengths are the counts. Longer terms
go to a bucket for each length and are sorted there as bytes. The sorts are stable, so the documents of a run
are in order and those that differ from the one before are its documents. Only (lang, source, term, count,
documents) leaves the task, and Spark sums it before and after one shuffle.

The divergences are exact integers. A pair of sources needs the sum over all kept terms of their language, most of
which one of them may lack. Cells (source, term) are dealt into blocks of terms and tiles of TILE sources, each
pair of tiles meets in one task as two dense tables of at most TILE rows, and pairs leave it as sums, not as
pairs of cells; what neither source has is a product.

Defined cases: null text, lang and source count as ''; a group without kept terms takes part with counts of 0;
rows that repeat are counted each; a language without kept terms has pairs of value 0 and no terms; an empty table
gives an empty table; further columns are not returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import documents, materialise, text_of

LEAST_DOCUMENTS, TOP, UNIT = 10, 10, 1_000_000_000
BLOCK_BYTES = 8 << 20
TERMS_PER_BLOCK, TILE = 4096, 32
COUNTS = "lang string, source string, term string, count long, docs long"
SUMS = "lang string, a int, b int, total long, seen long"

_letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LETTER = np.array([_letter(b) for b in range(256)])


def spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of every term; starts are the documents' first bytes and the end. No term crosses documents."""
    inside = LETTER[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = starts[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin, end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    return begin, end - begin, np.searchsorted(starts, begin, side="right") - 1


def packed(data: np.ndarray, begin: np.ndarray, length: np.ndarray, word: int) -> np.ndarray:
    """Bytes 8 * word to 8 * word + 7 of each term as a number, the first byte highest; bytes beyond its end are 0."""
    out = np.zeros(len(begin), np.uint64)
    for at in range(8 * word, 8 * word + 8):
        there = at < length
        out <<= np.uint64(8)
        out[there] |= data[begin[there] + at]
    return out


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order by several unsigned columns, the last one weighing most: counting passes over 16 bits each."""
    order = np.arange(len(columns[0]))
    for column in columns:
        for shift in range(0, 8 * column.dtype.itemsize, 16):
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def counted(order: np.ndarray, same: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, number of rows, and number of documents of each run; same says whether a sorted row equals the one before."""
    start = np.nonzero(~same)[0]
    fresh = ~same
    fresh[1:] |= doc[order][1:] != doc[order][:-1]
    return order[start], np.diff(np.r_[start, len(order)]), np.add.reduceat(fresh.astype(np.int64), start) if len(start) else start


def runs(data: np.ndarray, begin: np.ndarray, length: np.ndarray, doc: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first occurrence, count, documents) of each (group, term), a bucket of lengths at a time. group: 16-bit number of each term."""

    def equal(order: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        out = np.ones(len(order), bool)
        out[:1] = False
        for column in columns:
            ranked = column[order]
            out[1:] &= ranked[1:] == ranked[:-1]
        return out

    for words in (1, 2):
        own = np.nonzero((length > 8 * (words - 1)) & (length <= 8 * words))[0]
        columns = [packed(data, begin[own], length[own], w) for w in reversed(range(words))] + [group[own]]
        order = radix_order(columns)
        at, count, docs = counted(order, equal(order, columns), doc[own])
        yield own[at], count, docs
    for size in np.unique(length[length > 16]):
        own = np.nonzero(length == size)[0]
        found = np.empty(len(own), f"S{size}")
        for i, b in enumerate(begin[own]):
            found[i] = data[b : b + size].tobytes()
        order = np.argsort(found, kind="stable")
        order = order[radix_order([group[own][order]])]
        at, count, docs = counted(order, equal(order, [found, group[own]]), doc[own])
        yield own[at], count, docs


def strings(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """The terms as an Arrow column."""
    offsets = np.r_[0, np.cumsum(length)]
    where = np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[where])).cast(pa.string())


def count_block(lang: pa.Array, source: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """The counts of some documents, a batch for each bucket of lengths."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    data, starts = LOWER[data], offsets - offsets[0]
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    codes = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    names, codes = np.unique(codes, return_inverse=True)
    begin, length, doc = spans(data, starts)
    group = codes.astype(np.uint16)[doc]
    for at, count, docs in runs(data, begin, length, doc, group):
        if len(at):
            of_lang, of_source = np.divmod(names[group[at]], len(sources.dictionary))
            yield pa.record_batch({
                "lang": langs.dictionary.take(pa.array(of_lang)).cast(pa.string()), "source": sources.dictionary.take(pa.array(of_source)).cast(pa.string()),
                "term": strings(data, begin[at], length[at]), "count": pa.array(count, pa.int64()), "docs": pa.array(docs, pa.int64()),
            })


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each block of whole documents: BLOCK_BYTES of text, or one document that is longer, and 65,535 rows at most."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch["text"]), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, side="right"))), at + 65_535)
            part = batch.slice(at, to - at)
            yield from count_block(part["lang"], part["source"], part["text"])
            at = to


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, count, docs: occurrences of each term in a group, and the documents of the group that hold it."""
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    return rows.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exact."""
    big = lambda c, digits: c.cast(f"decimal({digits},0)")
    return 1 + F.call_function("div", big(count + 2, 19) * big(F.lit(UNIT), 10), big(total + 2 * kept, 20))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are 10^9 at most, so that all stays within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def tile_sums(tile: int) -> Callable:
    """For a block of terms and a pair of tiles: the sum of divergences over the terms that the tiles' sources have, and how many those are.

    A row without a term names a source of the tiles, so that those without a term in the block take part.
    """

    def of_tiles(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        terms, names = pd.factorize(cells["term"])
        width, own = len(names), terms >= 0
        sources = cells[~own].sort_values("i")
        numbers, none = sources["i"].to_numpy(), sources["none"].to_numpy()
        table = np.repeat(none[:, None], width, axis=1)
        table[np.searchsorted(numbers, cells["i"].to_numpy()[own]), terms[own]] = cells["p"].to_numpy()[own]
        out = []
        left, right = (np.nonzero(numbers // tile == key[n])[0] for n in (2, 3))
        for a in left:
            others = right[right > a]
            p, q = table[a], table[others]
            out.append(pd.DataFrame({"a": numbers[a], "b": numbers[others], "total": ((p - q) ** 2 // (p + q)).sum(axis=1), "seen": width}))
        found = pd.concat(out) if out else pd.DataFrame({x.split()[0]: [] for x in SUMS.split(", ")[1:]})
        found.insert(0, "lang", key[0])  # one value: a text column joined from parts has several Arrow chunks, which Spark does not take
        return found

    return of_tiles


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each source's divergence from the others of its language, and the terms that mark it."""
    counts = materialise(term_counts(docs, text, lang, source))
    terms = counts.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    terms = materialise(terms.select("lang", "term", "all"))
    kept = materialise(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "count", "all"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = materialise(groups.withColumn("none", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(1)))
    cells = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    return _pairs(groups, cells).unionByName(_terms(cells, top))


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    blocks = F.ceil(F.col("v") / TERMS_PER_BLOCK)
    here = cells.select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "i", "none", "p", "term")
    every = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block")
    marks = groups.filter("v > 0").select("lang", every, "i", "none", F.col("none").alias("p"), F.lit(None).cast("string").alias("term"))
    last = groups.groupBy("lang").agg(F.floor(F.max("i") / TILE).alias("last"))
    tile = F.floor(F.col("i") / TILE)
    dealt = here.unionByName(marks).join(last, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    dealt = dealt.select("lang", "block", F.least(tile, "other").alias("t1"), F.greatest(tile, "other").alias("t2"), "i", "none", "p", "term")
    found = dealt.groupBy("lang", "block", "t1", "t2").applyInPandas(tile_sums(TILE), SUMS)
    sums = found.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    x, y = (groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("i", "source", "none")], *(["v"] if s == "x" else [])) for s in "xy")
    pairs = x.join(y, "lang").filter("i_x < i_y").join(sums.withColumnsRenamed({"a": "i_x", "b": "i_y"}), ["lang", "i_x", "i_y"], "left").na.fill(0, ["total", "seen"])
    value = F.col("total") + (F.col("v") - F.col("seen")) * divergence(F.col("none_x"), F.col("none_y"))
    pairs = pairs.select("lang", "source_x", "source_y", value.cast("long").alias("value"))
    both = pairs.select("lang", F.col("source_x").alias("source"), F.col("source_y").alias("item"), "value")
    both = both.unionByName(pairs.select("lang", F.col("source_y").alias("source"), F.col("source_x").alias("item"), "value"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", _rank())


def _terms(cells: DataFrame, top: int) -> DataFrame:
    q = share(F.col("all"), F.col("lang_n"), F.col("v"))
    found = cells.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return found.withColumn("rank", _rank()).filter(F.col("rank") <= top)


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), t AS (SELECT r, lang, source, unnest(ts) AS term FROM d
), k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), v AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL
), a AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.c AS all_c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), n AS (SELECT lang, source, sum(c)::BIGINT AS n FROM a GROUP BY ALL
), p AS (
  SELECT a.lang, a.source, a.term, a.c, 1 + (1000000000::HUGEINT * (a.c + 2)) // (n.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (a.all_c + 2)) // (v.n + 2 * v.v) AS q
  FROM a JOIN n USING (lang, source) JOIN v USING (lang)
), f AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
