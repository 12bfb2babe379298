"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the split pattern) is encoded by halves: each half is encoded on its own, then
neighbours are joined. The join takes a few tokens on either side of the border, encodes their bytes
anew and accepts the result once the tokens outside provably stay: a token sequence is the encoding of
its bytes exactly if every two neighbours are the encoding of theirs. (Look at the first merge of the
whole that crosses a border between two tokens. Up to it both tokens have merged as they do alone, so
the same merge happens when the two are encoded as a pair.) Pairs within a half hold already, pairs
within the new window hold as it is an encoding, so only the two pairs at the window's ends are
checked; where one fails, the window grows on that side, by doubling, up to the end of the half.

A text goes up the same kind of tree. It is halved at its middle, whatever stands there, until halves have at
most 1,024 characters; such leaves are encoded by the tiktoken library. A join looks for the border nearest to
the halves' meeting point, in growing windows on the left and onwards on the right, at which the split pattern
begins a new match whatever stands around (a blank before, or a line break or tab after which, something
other than white space follows). Matches on the far side of such a border are the same in the half and in the
whole, so the tokens there provably stay; what lies between the two borders is encoded anew. A half without any
border is split by the pattern and its matches are encoded from bytes as above. Decoding concatenates the
tokens' bytes up a tree of halves.

Defined cases: a null text is empty and has no ids. Rows are encoded one by one, in Arrow batches;
repeated rows, null ids and foreign columns do no harm. An id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import col

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Code points that are letters or numbers to the ``regex`` module here, whose Unicode version is newer, but not yet to
#: the tiktoken library (fixed values). To the pattern they are neither.
YOUNG = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Bytes up to which a half, and a window between halves, is merged directly; tokens on each side of a border to begin with.
LEAF, WINDOW, MARGIN = 12, 48, 1
#: Bytes up to which the encoding of a half is remembered.
SHORT = 32
#: Characters of a text, and ids, up to which it is a leaf; characters of a join's first window.
LEAF_CHARS, LEAF_IDS, FIRST_WINDOW = 1024, 1024, 32
#: Where the split pattern begins a new match whatever stands around. (Narrower than the pattern's own white space.)
SURE = re.compile(r" (?=\S)|(?<=[\t\n\v\f\r])(?=\S)")
#: Remembered halves and pairs; all of a kind are forgotten beyond this number.
REMEMBERED = 200_000
NONE = 1 << 60


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF_CHARS) -> None:
        self.leaf = leaf
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.library = tiktoken.Encoding("leaves", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        young = "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in YOUNG.split())
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{young}]]")
        self.split = regex.compile(pattern, regex.VERSION1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.short: dict[bytes, list[int]] = {}
        self.decimal = {i: str(i) for i in self.bytes_of}

    @staticmethod
    def parse(content: bytes) -> Codec:
        lines = (line.split() for line in content.splitlines() if line)
        return Codec({base64.b64decode(token): int(rank) for token, rank in lines})

    def merged(self, data: bytes) -> list[int]:
        """Plain merging: always the pair of lowest rank, the leftmost among equals."""
        get = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        open_ranks = [get(data[i:i + 2], NONE) for i in range(len(data) - 1)]
        while open_ranks:
            best = min(open_ranks)
            if best == NONE:
                break
            at = open_ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del open_ranks[at]
            if at:
                open_ranks[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(open_ranks):
                open_ranks[at] = get(parts[at] + parts[at + 1], NONE)
        return [self.ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether the pair is the encoding of its own bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            known = self.pairs[(a, b)] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings, one after the other."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        n, m = MARGIN, MARGIN
        while True:
            n, m = min(n, len(left)), min(m, len(right))
            window = b"".join(self.bytes_of[i] for i in (*left[len(left) - n:], *right[:m]))
            middle = self.merged(window) if len(window) <= WINDOW else self.tree(window)
            left_fine = n == len(left) or self.stable(left[-n - 1], middle[0])
            right_fine = m == len(right) or self.stable(middle[-1], right[m])
            if left_fine and right_fine:
                return left[:len(left) - n] + middle + right[m:]
            n, m = (n if left_fine else 2 * n), (m if right_fine else 2 * m)

    def tree(self, data: bytes) -> list[int]:
        """Encoding of bytes: halves first, then their join."""
        if len(data) > SHORT:
            half = len(data) // 2
            return self.join(self.tree(data[:half]), self.tree(data[half:]))
        known = self.short.get(data)
        if known is None:
            half = len(data) // 2
            known = (
                self.merged(data) if len(data) <= LEAF
                else self.join(self.tree(data[:half]), self.tree(data[half:]))
            )
            if len(self.short) > REMEMBERED:
                self.short.clear()
            self.short[data] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Encoding of one match of the pattern; a match that is a token stays whole."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data)

    def plain(self, text: str) -> list[int]:
        """Ids of a text that is not halved: by the library, or match by match from bytes."""
        if len(text) <= LEAF_CHARS and self.library is not None:
            return self.library.encode_ordinary(text)
        return [i for match in self.split.findall(text) for i in self.piece(match.encode())]

    def join_texts(self, text: str, lo: int, at: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of ``text[lo:hi]`` from those of its halves ``text[lo:at]`` and ``text[at:hi]``."""
        a, width = None, FIRST_WINDOW
        while a is None:
            start = max(lo, at - width)
            for a in (m.start() for m in SURE.finditer(text, start, at)):
                pass
            if a is None and start == lo:
                a = lo
            width *= 2
        found = SURE.search(text, at, hi)
        b = found.start() if found else hi
        stays_left = len(left) - len(self.plain(text[a:at])) if a > lo else 0
        stays_right = len(self.plain(text[at:b])) if b < hi else len(right)
        return left[:stays_left] + self.plain(text[a:b]) + right[stays_right:]

    def halves_of(self, text: str, lo: int, hi: int) -> list[int]:
        """Ids of ``text[lo:hi]``: halves first, then their join."""
        if hi - lo <= self.leaf or not SURE.search(text, lo + 1, hi):
            return self.plain(text[lo:hi])
        at = (lo + hi) // 2
        return self.join_texts(text, lo, at, hi, self.halves_of(text, lo, at), self.halves_of(text, at, hi))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, which are those of the tiktoken library for the whole."""
        return self.halves_of(text, 0, len(text))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids: those of the halves, one after the other."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_codecs: dict[str, Codec] = {}


def _codec(content: bytes) -> Codec:
    """The codec of a vocabulary file, made once per Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec.parse(content)
    return _codecs[key]


def _vocabulary(df: DataFrame, path: str | None):
    """The vocabulary file (below a megabyte) as a broadcast."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


#: Rows that are worked on at a time.
ROWS = 512


def _by_rows(work: Callable[[Codec, pa.RecordBatch], list[pa.Array]], content, schema: str, df: DataFrame) -> DataFrame:
    """Columns that ``work`` adds to the first column, which passes as it is."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *work(codec, part)], ["id", *names])

    kind = df.schema[0].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, {schema}")


def encoded(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the tokens of every text."""

    def work(codec: Codec, part: pa.RecordBatch) -> list[pa.Array]:
        ids = [codec.encode(t) for t in part.column(1).to_pylist()]
        return [pa.array(ids, pa.list_(pa.int32()))]

    out = _by_rows(work, _vocabulary(docs, path), "ids array<int>", _slim(docs, id, text))
    return out.withColumnRenamed("id", id)


def decoded(tokens: DataFrame, id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(id, data): the bytes of every array of ids; a null array gives no bytes."""

    def work(codec: Codec, part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([codec.decode(x or []) for x in part.column(1).to_pylist()], pa.binary())]

    slim = tokens.select(col(id).alias("id"), col(ids).alias("ids"))
    return _by_rows(work, _vocabulary(tokens, path), "data binary", slim).withColumnRenamed("id", id)


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded, in one pass."""

    def work(codec: Codec, part: pa.RecordBatch) -> list[pa.Array]:
        n, listed, back = [], [], []
        for t in part.column(1).to_pylist():
            ids = codec.encode(t)
            n.append(len(ids))
            listed.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
            back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(back, pa.string())]

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _by_rows(work, _vocabulary(docs, path), schema, _slim(docs, id, text)).withColumnRenamed("id", id)


def _slim(docs: DataFrame, id: str, text: str) -> DataFrame:
    empty: Column = F.coalesce(col(text), F.lit(""))
    return docs.select(col(id).alias("id"), empty.alias("text"))


def tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """(kept columns, n_tokens, ids, exact): ids of every text, and whether they decode to it."""
    content = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = [codec.encode(t) for t in texts]
                exact = [codec.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([len(x) for x in ids], pa.int64()),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())],
                    names,
                )

    slim = docs.select(*[col(c) for c in keep], F.coalesce(col(text), F.lit("")).alias("_text"))
    names = [*keep, "n_tokens", "ids", "exact"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1])
    return slim.mapInArrow(run, f"{kinds}, n_tokens bigint, ids array<int>, exact boolean")
