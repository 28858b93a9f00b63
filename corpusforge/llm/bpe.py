"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Encoding applies a merge list in order of rank. Of a prefix of a word, the last token is settled by the
last token of a shorter prefix: a sequence of tokens is the encoding of its symbols just when each token
and each two neighbours are. So the transducer keeps, for every prefix of what it buffers, the length of
its last token. The token after the next symbols can begin only within the longest token's length of the
end; as far back as the encodings of all prefixes that end there agree, their tokens are stable and are
emitted. Whatever they are, what follows a token can change it only through a chain of merges of falling
rank towards the left, each overlapping the next. The longest reach of such a chain is computed once from
the merge list; it is the lookahead that suffices, and tokens that end further back are emitted in any
case, so the buffer is bounded whatever the length of a word. Decoding feeds the bytes of each token to an
incremental UTF-8 state machine.

A text is taken in segments of SEGMENT characters, cut before white space, which no token crosses, or
inside a piece, which the transducer then goes on with. Ids and decoded text leave segment by segment, so
digests need constant memory beside the text itself. The ids of stretches without white space are kept in a
cache of bounded size, filled by the transducer.

Defined cases: null text counts as empty and has no tokens; the strings of special tokens in a text become
those tokens, as in the tokenizer's own library; repeated rows are encoded alike; an empty table gives an
empty table; further columns pass through encode_column and decode_column, and where one has the name of the
new column, that takes underscores until it differs.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import documents

CACHE, PAIRS = 400_000, 200_000
#: Prefixes of words up to SHARED symbols whose last token is kept, and how many.
SHARED, PREFIXES = 8, 400_000
SEGMENT, PORTION = 1 << 16, 256
#: The white space of the tokenizer's \s, and those of Python's str.split that it lacks.
WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
NOT_WHITE = regex.compile(r"[\x1c-\x1f]")
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b not in others else chr(256 + others.index(b)) for b in range(256)]


class MergeList:
    """Vocabulary, merges by rank, and the lookahead that suffices for them.

    Inside, every symbol is one character; one of the range from LAST stands for a byte at the end of a word.
    """

    LAST = 0xE000

    def __init__(self, tokenizer: str):
        spec = json.loads(tokenizer)
        model = spec["model"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        self.last = {c: chr(self.LAST + b) if self.end else c for b, c in enumerate(self.symbols)}
        self.ids: dict[str, int] = {self.inner(t): i for t, i in model["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {tuple(map(self.inner, m)): rank for rank, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t.encode() for t, i in [*model["vocab"].items(), *self.special.items()]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.longest = max(map(len, self.ids))
        #: Lengths above 3 of the tokens with an ending of 4 symbols, longest first; shorter tokens are simply tried.
        lengths: dict[str, set[int]] = {}
        for token in self.ids:
            if len(token) > 3:
                lengths.setdefault(token[-4:], set()).add(len(token))
        self.lengths = {k: (*sorted(v, reverse=True), 3, 2, 1) for k, v in lengths.items()}
        self.digits = {i: str(i) for i in self.names}
        self.lookahead = sufficient_lookahead(self.ranks)
        self.known: dict[tuple[str, str], bool] = {}

    def inner(self, token: str) -> str:
        """A token of the vocabulary with one character a symbol."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token.removesuffix(self.end)
            return body[:-1] + self.last.get(body[-1], body[-1])
        return token

    def base(self, piece: str) -> str:
        """The symbols of a piece, none of them marked as the last."""
        return piece if piece.isascii() and piece.isprintable() and " " not in piece else "".join([self.symbols[b] for b in piece.encode()])

    def fits(self, before: str, token: str) -> bool:
        """Whether the two tokens are the encoding of their symbols; with "" before, whether the one is."""
        found = self.known.get((before, token))
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[before, token] = merged([*before, *token], self.ranks) == [t for t in (before, token) if t]
        return found


def sufficient_lookahead(merges: Iterable[tuple[str, str]]) -> int:
    """The longest reach to the left, in symbols, of a chain of merges of rising rank that overlap.

    reach[x] is what a change may reach through merge x: a merge y of lower rank that begins inside x, and
    agrees with x where they overlap, can prevent or allow x, which begins k symbols earlier.
    """
    starting: dict[str, int] = {}  # the furthest reach of a merge with this prefix
    exact: dict[str, int] = {}
    most = 1
    for left, right in merges:
        x = left + right
        reach = len(x)
        for k in range(1, len(x)):
            tail = x[k:]
            if tail in starting:
                reach = max(reach, k + starting[tail])
            for n in range(1, len(tail)):
                if tail[:n] in exact:
                    reach = max(reach, k + exact[tail[:n]])
        for n in range(1, len(x) + 1):
            starting[x[:n]] = max(reach, starting.get(x[:n], 0))
        exact[x] = max(reach, exact.get(x, 0))
        most = max(most, reach)
    return most


NEVER = 1 << 60


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """All merges of a run of symbols, lowest rank first and leftmost among equals."""
    if len(symbols) > 48:
        return merged_by_heap(symbols, ranks)
    out, get = symbols.copy(), ranks.get
    pairs = [get(p, NEVER) for p in zip(out, out[1:])]
    while pairs and (low := min(pairs)) < NEVER:
        i = pairs.index(low)
        both = out[i] = out[i] + out.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get((out[i - 1], both), NEVER)
        if i < len(pairs):
            pairs[i] = get((both, out[i + 1]), NEVER)
    return out


def merged_by_heap(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    out: list[str | None] = list(symbols)
    after, before = list(range(1, len(out) + 1)), list(range(-1, len(out) - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(out, out[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if out[i] != left or j >= len(out) or out[j] != right:
            continue
        out[i], out[j] = left + right, None
        after[i] = after[j]
        if after[i] < len(out):
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else len(out)
            if b < len(out) and (p := (out[a], out[b])) in ranks:
                heapq.heappush(heap, (ranks[p], a, *p))
    return [x for x in out if x is not None]


SHORT = (3, 2, 1)


class Encoder:
    """The transducer: feed symbols of one word in any portions, get tokens as they become stable."""

    def __init__(self, merges: MergeList):
        self.merges, self.seen = merges, {}
        self._restart()

    def _restart(self) -> None:
        #: Symbols that are not emitted yet, the last token of each of their prefixes (of the empty one, the token before them), and a symbol that may be the word's last.
        self.text, self.last, self.held = "", [""], ""

    def feed(self, symbols: str) -> list[str]:
        symbols, out = self.held + symbols, []
        self.held = symbols[-1:]
        for at in range(0, len(symbols) - 1, PORTION):
            self._extend(symbols[at : min(at + PORTION, len(symbols) - 1)])
            if len(self.text) >= 2 * self.merges.longest:
                out += self._emit(self._stable())
        return out

    def finish(self) -> list[str]:
        if self.held:
            self._extend(self.merges.last[self.held])
        out = self._emit(len(self.text))
        self._restart()
        return out

    def word(self, symbols: str) -> list[str]:
        """All tokens of a word. The steps of its first symbols, which many words share, are kept in a cache of bounded size."""
        n = len(symbols)
        if n > PORTION:
            return [*self.feed(symbols), *self.finish()]
        text, last, seen = symbols[:-1] + self.merges.last[symbols[-1]], [""], self.seen
        for i in range(1, min(n, SHARED + 1)):
            token = seen.get(symbols[:i])
            if token is None:
                if len(seen) >= PREFIXES:
                    seen.clear()
                token = seen[symbols[:i]] = self._last(text, i, last)
            last.append(token)
        for i in range(len(last), n + 1):
            last.append(self._last(text, i, last))
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return out

    def _last(self, text: str, i: int, last: list[str]) -> str:
        """The last token of the first i symbols, given those of all shorter prefixes."""
        merges = self.merges
        for n in merges.lengths.get(text[i - 4 : i], SHORT) if i > 3 else SHORT:
            if n <= i and (token := text[i - n : i]) in merges.ids:
                before = last[i - n]
                found = merges.known.get((before, token))
                if found or found is None and merges.fits(before, token):
                    break
        return token

    def _extend(self, symbols: str) -> None:
        begin, self.text = len(self.text), self.text + symbols
        for i in range(begin + 1, len(self.text) + 1):
            self.last.append(self._last(self.text, i, self.last))

    def _stable(self) -> int:
        """The end of the tokens that no further symbol can change."""
        n, merges, last = len(self.text), self.merges, self.last
        live = set(range(max(0, n - merges.longest + 1), n + 1))
        for at in range(n, 0, -1):
            if at in live:
                if len(live) == 1:
                    return at
                live.discard(at)
                live.add(at - len(last[at]))
        at = n
        while at > max(0, n - merges.lookahead):
            at -= len(last[at])
        return at

    def _emit(self, end: int) -> list[str]:
        out, at = [], end
        while at:
            out.append(self.last[at])
            at -= len(self.last[at])
        out.reverse()
        self.text, self.last = self.text[end:], self.last[end:]
        return out


class Decoder:
    """Token ids to text, portion by portion; bytes of a character may come in several portions.

    As the library does for a tokenizer without a decoder, tokens are joined by a space.
    """

    def __init__(self, merges: MergeList):
        self.names, self.begun = merges.names, False
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, tokens: Iterable[int]) -> str:
        out = b" ".join([b"", *map(self.names.__getitem__, tokens)] if self.begun else map(self.names.__getitem__, tokens))
        self.begun = self.begun or bool(out)
        return self.machine.decode(out)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


class Recent(dict):
    """A cache of bounded size in two generations: when the young one is full it becomes the old one, from which what is used again returns."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key: str) -> list[int]:
        found = self.old.get(key) or self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) < 64:
            self[key] = found
        return found


class Pieces(Recent):
    """The ids of each stretch without white space."""

    def __init__(self, merges: MergeList):
        super().__init__(self._stretch, CACHE)
        self.merges, self.encoder = merges, Encoder(merges)
        self.words = Recent(self._word, CACHE)
        self.find = merges.pieces.findall

    def _stretch(self, stretch: str) -> list[int]:
        if stretch.isascii() and stretch.isalpha():
            return self.words[stretch]
        return [i for p in self.find(stretch) for i in self.words[p]]

    def _word(self, piece: str) -> list[int]:
        ids = self.merges.ids
        return [ids[t] for t in self.encoder.word(self.merges.base(piece))]


def normal(text: str) -> str:
    """NFC, then lower case character by character."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


@cache
def seconds() -> frozenset[str]:
    """Characters that NFC may join to the one before: second halves of canonical decompositions, and the vowels and finals of Hangul."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def segments(text: str, merges: MergeList, size: int = SEGMENT) -> Iterator[tuple[str, bool]]:
    """The text in segments, each with whether the next one may go on with its last piece."""
    at = 0
    while len(text) - at > size:
        end = at + size
        space = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
        if space > 0:
            yield text[at:space], False
            at = space
            continue
        while end < len(text) and not _may_cut(text, end, merges):
            end += 1
        yield text[at:end], end < len(text)
        at = end
    yield text[at:], False


def _may_cut(text: str, at: int, merges: MergeList) -> bool:
    """Whether no composition, no apostrophe with letters near it and no special token lies across this place."""
    if unicodedata.combining(text[at]) or text[at] in seconds():
        return False
    if "'" in text[max(0, at - 3) : at + 1] and any(c.isalpha() for c in text[max(0, at - 3) : at + 4]):
        return False
    return not any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in merges.special)


class Transducer:
    """A whole text to token ids, segment by segment."""

    def __init__(self, merges: MergeList, pieces: Pieces):
        self.merges, self.pieces = merges, pieces
        self.encoder, self.open = Encoder(merges), ""  # the class of the piece that the encoder is inside of
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None

    def ids(self, text: str, size: int = SEGMENT) -> Iterator[list[int]]:
        """Portions of the ids of a text."""
        if len(text) <= size:
            yield self._segment(text, False)
            return
        for segment, more in segments(text, self.merges, size):
            yield self._segment(segment, more)

    def _segment(self, segment: str, more: bool) -> list[int]:
        out: list[int] = []
        parts = self.specials.split(segment) if self.specials and any(s in segment for s in self.merges.special) else [segment]
        for k, part in enumerate(parts):
            if part in self.merges.special:
                out += self._close()
                out.append(self.merges.special[part])
            elif part:
                part, goes_on = normal(part), more and k == len(parts) - 1
                if self.open:
                    first = self.merges.pieces.match(part)
                    if not first or self._class(first.group()) != self.open:
                        out += self._close()
                    else:
                        out += self._feed(first.group())
                        part = part[first.end() :]
                        if part or not goes_on:
                            out += self._close()
                last = ""
                if goes_on and part:
                    *_, found = [None, *self.merges.pieces.finditer(part)]
                    if found and found.end() == len(part) and self._class(found.group()) != "number":
                        last, part = found.group(), part[: found.start()]
                stretches = filter(None, WHITE.split(part)) if NOT_WHITE.search(part) else part.split()
                for ids in map(self.pieces.__getitem__, stretches):
                    out += ids
                if last:
                    self.open = self._class(last)
                    out += self._feed(last)
        return out if more else out + self._close()

    @staticmethod
    def _class(piece: str) -> str:
        return "letters" if regex.match(r"\p{L}", piece) else "number" if regex.match(r"\p{N}", piece) else "others"

    def _feed(self, piece: str) -> list[int]:
        return [self.merges.ids[t] for t in self.encoder.feed(self.merges.base(piece))]

    def _close(self) -> list[int]:
        if not self.open:
            return []
        self.open = ""
        return [self.merges.ids[t] for t in self.encoder.finish()]


def digests_of(text: str, transducer: Transducer, size: int = SEGMENT) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids joined by spaces, and digest of the text decoded from them, in constant memory."""
    n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(transducer.merges)
    digits = transducer.merges.digits.__getitem__
    for ids in transducer.ids(text, size):
        if ids:
            ids_sha.update(((" " if n else "") + " ".join(map(digits, ids))).encode())
            text_sha.update(decoder.feed(ids).encode())
            n += len(ids)
    text_sha.update(decoder.finish().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


_made: dict[str, Transducer] = {}


def _worker(tokenizer) -> Transducer:
    """The transducer with its cache, built once in each Python worker."""
    key = hashlib.sha256(tokenizer.value.encode()).hexdigest()
    if key not in _made:
        merges = MergeList(tokenizer.value)
        _made[key] = Transducer(merges, Pieces(merges))
    return _made[key]


def _free(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def round_trip(spark: SparkSession, tokenizer_path: str, text: Column) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of every whole text. The file is read once and sent to the workers."""
    tokenizer = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    @F.pandas_udf(RESULT)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        transducer = _worker(tokenizer)
        for texts in batches:
            rows = [digests_of(t, transducer) for t in texts]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(F.coalesce(text, F.lit("")))


def encode_column(spark: SparkSession, docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of the whole text as an array column."""
    tokenizer = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transducer = _worker(tokenizer)
        for texts in batches:
            yield pd.Series([[i for portion in transducer.ids(t) for i in portion] for t in texts])

    return docs.withColumn(_free(docs, out), ids(F.coalesce(F.col(text), F.lit(""))))


def decode_column(spark: SparkSession, tokens: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with the decoded text of an array of token ids; null gives empty text."""
    tokenizer = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = _worker(tokenizer).merges
        for rows in batches:
            out = []
            for row in rows:
                decoder = Decoder(merges)
                out.append(decoder.feed(map(int, row)) + decoder.finish())
            yield pd.Series(out)

    return tokens.withColumn(_free(tokens, out), texts(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", round_trip(spark, default_tokenizer(), F.col("text")).alias("r")).select("doc_id", "r.*")
