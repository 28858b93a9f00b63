import hashlib
import random

import pytest
from tokenizers import Tokenizer

from corpusforge.llm import bpe as B
from tests.llm.data import docs, prose

PATH = B.default_tokenizer()


@pytest.fixture(scope="module")
def merges():
    return B.MergeList(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digests(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_texts_match_the_library_wherever_segments_are_cut(merges, library):
    transducer, rng = B.Transducer(merges, B.Pieces(merges)), random.Random(1)
    parts = ["a", "th", "an", "'s", " ", "\x1c", "é", "e\u0301", "Σ", "<|endoftext|>", "<|", "1", "\U0001f600", "\u200b", "\x85", "İ", "一", "\n", "'", "''", "re", "!", "\u1100", "\u1161", "\u11a8", "\u0301"]
    texts = ["", " ", prose(300, 4)] + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t in texts:
        size = rng.choice([1, 2, 3, 5, 9, 17, 40, B.SEGMENT])
        assert B.digests_of(t, transducer, size) == digests(library, t), (t, size)
    assert [i for ids in transducer.ids(texts[2], 50) for i in ids] == library.encode(texts[2], add_special_tokens=False).ids


def test_every_document_matches_the_library(spark, merges, library):
    transducer = B.Transducer(merges, B.Pieces(merges))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert B.digests_of(r.text or "", transducer) == digests(library, r.text or "")


def test_words_stream_in_constant_memory(merges, library):
    rng = random.Random(2)
    for alphabet in ("ab", "thean", "aaab", "a", "!'", "é"):
        word = "".join(rng.choice(alphabet) for _ in range(60_000))
        encoder, tokens, most = B.Encoder(merges), [], 0
        symbols = merges.base(word)
        for at in range(0, len(symbols), 5):
            tokens += encoder.feed(symbols[at : at + 5])
            most = max(most, len(encoder.text))
        tokens += encoder.finish()
        assert most <= min(merges.lookahead + B.PORTION, 4 * merges.longest)
        assert [merges.ids[t] for t in tokens] == library.encode(word, add_special_tokens=False).ids


def test_a_long_text_leaves_in_small_portions(merges):
    transducer, held = B.Transducer(merges, B.Pieces(merges)), []
    for text in ("the anthem of then " * 530_000, "thean" * 100_000):
        sizes = []
        for ids in transducer.ids(text):
            sizes.append(len(ids))
            held.append(len(transducer.encoder.text))
        assert len(sizes) == -(-len(text) // B.SEGMENT) and max(sizes) <= B.SEGMENT
    assert max(held) <= 4 * merges.longest and not transducer.encoder.text


def test_lookahead_covers_a_chain():
    merges = [("c", "d"), ("b", "c"), ("a", "b")]  # whether ab merges depends on d, three symbols on
    assert B.sufficient_lookahead(merges) >= 4


def test_decoder_holds_split_characters(merges):
    decoder = B.Decoder(merges)
    decoder.names = {0: "é".encode()[:1], 1: "é".encode()[1:]}
    assert decoder.machine.decode(decoder.names[0]) == "" and decoder.machine.decode(decoder.names[1]) == "é"


def test_query_columns(spark, library):
    texts = [(1, None), (2, ""), (3, "Hello  World"), (3, "Hello  World"), (4, prose(5000, 1)), (None, "x")]
    df = docs(spark, texts)
    got = df.select("doc_id", B.round_trip(spark, PATH, df.text).alias("r")).select("doc_id", "r.*").collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(texts, key=lambda x: x[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = B.decode_column(spark, B.encode_column(spark, df, PATH), PATH).collect()
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in both)
    assert B.encode_column(spark, docs(spark, []), PATH).count() == 0


def test_columns_of_the_same_name_stay(spark):
    df = docs(spark, [(1, "Hello")]).selectExpr("*", "'x' AS ids", "'y' AS IDS_", "'z' AS decoded")
    got = B.decode_column(spark, B.encode_column(spark, df, PATH), PATH, ids="ids__")
    assert got.columns == [*df.columns, "ids__", "decoded_"]
    row = got.first()
    assert (row.ids, row["IDS_"], row.decoded, row["decoded_"]) == ("x", "y", "z", "hello</w>")
