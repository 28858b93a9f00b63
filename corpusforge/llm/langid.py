"""Language identification by compression.

For each language a Zstandard raw-content dictionary of SAMPLE_PASSAGES passages is made. Every whole
labelled text is cut into passages of PASSAGE characters, all of which are candidates; those with the least
hashes are taken, which is a uniform sample of the labelled text. A text belongs to the language whose
dictionary compresses it to the fewest bytes. Every whole text is compressed once per language, at one level;
the dictionaries, about DICT_BYTES a language, are all that is broadcast. Texts and dictionaries are put in
lower case first, and every run of other ASCII characters than letters becomes one space.

The sample is drawn without gathering a language anywhere: the passages of each language are counted, which
gives the share of hashes that holds some more than the sample; each row lets through only its passages
within that share, and the least of those are taken.

The prediction is rejected (``rejected`` is true) when the two smallest sizes differ by less than
MARGIN_BYTES or by less than MARGIN_SHARE of the smallest; lang_pred then still names the smallest. Equal
sizes are settled by the size of a copy of the text repeated until it is TIE_BYTES long, then by name.
score is 1 / sum over languages of 2^-(bytes above the smallest).

Defined cases: a null text or one without a letter gives und, score 0 and rejected; without any labelled
text every text gives und; rows without a label or without a letter are not learned from; repeated rows are
learned and predicted alike, passages with equal hashes in the order of their text; a null doc_id is neither
held out nor learned from; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import documents

#: The sample of a language: its passages with the least hashes, and their length in characters.
SAMPLE_PASSAGES, PASSAGE = 128, 512
#: Passages let through for each one of the sample, so that enough are there.
SPARE = 2
LEVEL = 9
MARGIN_BYTES, MARGIN_SHARE = 2, 0.005
TIE_BYTES = 512
UNKNOWN = "und"
RESULT = "lang_pred string, score double, rejected boolean"


LETTERS = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def letters_of(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE_PASSAGES, size: int = PASSAGE) -> dict[str, bytes]:
    """Raw content of each language: a uniform sample of the passages of all its texts, joined."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("n", F.ceil(F.length("text") / size))
    # one row a language, as the model has
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return {}
    shares = [(k, min(1.0, (SPARE * sample + 64) / n)) for k, n in counts.items()]
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(shares, "lang string, share double")), "lang")
    place = lambda i: F.xxhash64("doc_id", i)
    within = F.filter(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: F.shiftrightunsigned(place(i), 11) / float(1 << 53) <= F.col("share"))
    taken = F.transform(within, lambda i: F.struct(place(i).alias("hash"), F.col("text").substr(i * size + 1, F.lit(size)).alias("text")))
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("hash", 11), "hash", "text")
    found = rows.select("lang", F.explode(taken).alias("p")).select("lang", "p.*").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample)
    out: dict[str, bytes] = {}
    for row in found.orderBy("lang", F.desc("k")).select("lang", "text").toLocalIterator():
        out[row.lang] = out.get(row.lang, b"") + letters_of(row.text) + b" "
    return out


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.langs = sorted(contents)
        self.compressors = [self._compressor(contents[lang]) for lang in self.langs]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prepared.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=prepared, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, data: bytes) -> list[int]:
        return [len(c.compress(data)) for c in self.compressors]

    def predict(self, text: str) -> tuple[str, float, bool]:
        data = letters_of(text)
        sizes = self.sizes(data)
        least = min(sizes)
        best = [i for i, s in enumerate(sizes) if s == least]
        if len(best) > 1:
            again = self.sizes((data + b" ") * -(-TIE_BYTES // (len(data) + 1)))
            best.sort(key=lambda i: (again[i], self.langs[i]))
        second = min((s for i, s in enumerate(sizes) if i != best[0]), default=None)
        narrow = second is not None and second - least < max(MARGIN_BYTES, MARGIN_SHARE * least)
        return self.langs[best[0]], 1 / sum(2.0 ** -(min(s - least, 1000)) for s in sizes), narrow


def identify(spark: SparkSession, contents: dict[str, bytes], text: Column) -> Column:
    """struct(lang_pred, score, rejected) of every whole text."""
    sent = spark.sparkContext.broadcast(contents)

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(sent.value)
        for texts in batches:
            rows = [classifier.predict(t) if t and classifier.langs else (UNKNOWN, 0.0, True) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    # texts without a letter are not sent: they come as empty ones
    return predict(F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), text).otherwise(""))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = fold() == 0
    contents = dictionaries(docs.filter(~held).select("doc_id", "text", "lang"))
    found = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), identify(spark, contents, F.col("text")).alias("r"))
    return found.select("doc_id", "held_out", "r.*")
