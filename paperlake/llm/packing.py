"""Packing documents into sequences of at most ``limit`` tokens: dominance reduction, then best fit.

A document's tokens are its ids and an end id. Documents longer than ``limit`` are cut into pieces of that
length; nothing else is cut. How many sequences are needed depends only on how many pieces there are of each length, so the instance
is that table of at most ``limit`` rows, whatever the size of the corpus. It is packed by length and not by piece:

1. Dominance reduction after Martello and Toth: a set of pieces that holds the longest open piece and is at least as good as any other
   set with it (the others' pieces can be put where its own ones stood) is one sequence of some best packing, so it is
   fixed, for as many copies as there are, and the instance shrinks. With j a length, b the longest that fits beside
   it, and r = limit - j the room beside it:
   * no piece fits beside j: {j};
   * b = r, or no two pieces fit beside j: {j, b}. Whatever else stands beside j is together no longer than b;
   * at most two pieces fit beside j: {j, b}, if b is no shorter than any two together that fit; else {j, b, c}
     with c the longest beside j and b, if every other pair that fits has its second piece no longer than c, or is
     together no longer than b.
   A set that dominates keeps doing so while pieces only disappear, so it is fixed for all copies at once.
   The lengths are gone through from the longest down until nothing more can be fixed.
2. The remainder is packed by best fit, longest first: each piece goes to the open sequence that it leaves the least
   room in. Sequences of equal room are a range of numbers, so a length is placed range by range.

The plan is a table of segments (length, from which copy on, first sequence, copies per sequence, offset). Every piece gets the
number of its copy from its place in its partition and the partitions' counts, and looks its segment up. So a
hot length is never gathered anywhere, and tokens are shuffled only if the counts are too large for a broadcast.

Defined cases: a null or empty text is the end id alone. Rows are documents, repeated ones too, and a null id is
kept. An empty table gives no rows. Foreign columns are not read. Strings of special tokens in a text are ordinary
text.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import col
from paperlake.session import materialise, sized_side

LIMIT, END_ID = 4096, 1
#: Encoded words that a Python worker remembers, and the longest of them in bytes.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64
#: Texts whose tokens are returned together.
ROWS = 256
PIECES = "doc_id {}, piece int, start bigint, length bigint, ids binary, part int, copy bigint"

#: How the tokenizer file with word ends makes a text's normal form and splits it.
WORD_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"
#: Words whose normal form and split are the same by every library's tables: printable ASCII and Latin-1 letters.
PLAIN = re.compile("[\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+| ")
#: Stands between the ids of two words; no id looks like it.
BETWEEN = b"\xff" * 4

_encoders: dict[str, Callable[[bytes], bytes]] = {}


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _plain(vocabulary: dict[str, int], merges: list) -> Callable[[list[str]], list[bytes]] | None:
    """Ids of plain words by tiktoken's merge, where the byte 0xFF, which no text holds, marks the end of a piece.

    None if the order of the ids isn't the order of the merges, which is what that merge goes by.
    """
    import tiktoken

    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ids = [vocabulary[a + b] for a, b in pairs]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these bytes stand for themselves
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    if ids != sorted(ids) or set(letters) - set(vocabulary) or min(ids) < max(vocabulary[c + WORD_END] for c in letters):
        return None
    ranks = {}
    for token in [*letters, *(c + WORD_END for c in letters), *(a + b for a, b in pairs)]:
        ended = len(token) > len(WORD_END) and token.endswith(WORD_END)
        body = token[:-len(WORD_END)] if ended else token
        ranks[bytes(map(letters.__getitem__, body)) + b"\xff" * ended] = vocabulary[token]
    merged = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    known: dict[str, bytes] = {}

    def encode(words: list[str]) -> list[bytes]:
        parts = PLAIN_SPLIT.findall(" ".join(words).lower())
        if len(known) > REMEMBERED:
            known.clear()
        known[" "] = BETWEEN
        new = set(parts).difference(known)
        for p in new:
            known[p] = pack_ids(merged(p.encode() + b"\xff"))
        out = b"".join(map(known.__getitem__, parts)).split(BETWEEN)
        for p in new:
            if len(p) > REMEMBERED_BYTES:
                del known[p]
        return out

    return encode


def _encoder(path: str) -> Callable[[bytes], bytes]:
    """Function from a text's bytes to its ids, as little-endian 32-bit numbers, without special tokens.

    The tokenizer with word ends drops white space before it splits a text, and neither its normal form nor its lower
    case reaches across white space, so words between ASCII blanks are encoded apart and remembered. Plain words
    are merged by ``_plain``, others by the library. Texts of any other tokenizer are encoded whole by the library.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    model, split = config["model"], (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    by_word = (config.get("normalizer") or {}).get("normalizers") == WORD_FORM and split.get("pattern") == {"Regex": WORD_SPLIT}
    plain = _plain(model["vocab"], model["merges"]) if by_word and model.get("end_of_word_suffix") == WORD_END else None
    known: dict[bytes, bytes] = {}

    def slowly(text: str) -> bytes:
        return pack_ids(library.encode(text, add_special_tokens=False).ids)

    def encode(text: bytes) -> bytes:
        if not by_word:
            return slowly(text.decode())
        words = text.split()
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set(words).difference(known))
        if new:
            joined = b" ".join(new).decode()
            easy = new if plain and PLAIN.fullmatch(joined) else [w for w in new if plain and PLAIN.fullmatch(w.decode())]
            if easy:
                known.update(zip(easy, plain([w.decode() for w in easy]), strict=True))
            known.update((w, slowly(w.decode())) for w in set(new).difference(easy))
        out = b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > REMEMBERED_BYTES:
                del known[w]
        return out

    return _encoders.setdefault(path, encode)


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document, with their ids and, within a partition, the number of pieces of this length before."""
    slim = docs.select(col(id).alias("doc_id"), col(text).alias("text"))
    end = pack_ids([end_id])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                batch = whole.slice(s, ROWS)
                out: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "ids", "copy")}
                texts = batch.column("text").cast(pa.binary())
                for row in range(batch.num_rows):
                    ids = encode(texts[row].as_py() or b"") + end
                    for k, at in enumerate(range(0, len(ids), 4 * limit)):
                        own = ids[at:at + 4 * limit]
                        n = len(own) // 4
                        for c, v in zip(out, (row, k, at // 4, n, own, seen[n]), strict=True):
                            out[c].append(v)
                        seen[n] += 1
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(out["row"])), "piece": pa.array(out["piece"], pa.int32()),
                    "start": pa.array(out["start"], pa.int64()), "length": pa.array(out["length"], pa.int64()),
                    "ids": pa.array(out["ids"], pa.binary()), "part": pa.array([part] * len(out["row"]), pa.int32()),
                    "copy": pa.array(out["copy"], pa.int64()),
                })

    return slim.mapInArrow(work, PIECES.format(slim.schema["doc_id"].dataType.simpleString()))


class Lengths:
    """How many pieces of each length are open, and the open lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n}
        self.order = sorted(self.counts)
        self.taken = dict.fromkeys(self.counts, 0)

    def fitting(self, room: int, without: tuple[int, ...] = ()) -> int | None:
        """Longest open length of at most ``room``, besides the pieces ``without``."""
        at = bisect.bisect_right(self.order, room)
        while at:
            at -= 1
            if self.counts[self.order[at]] > without.count(self.order[at]):
                return self.order[at]
        return None

    def shortest(self, n: int, without: int) -> int | None:
        """Sum of the ``n`` shortest open pieces besides one of length ``without``; None if there are fewer."""
        total = 0
        for s in self.order:
            use = min(n, self.counts[s] - (s == without))
            total, n = total + use * s, n - use
            if not n:
                return total
        return None

    def take(self, length: int, n: int) -> int:
        """Close ``n`` pieces; the number of the first one's copy."""
        first = self.taken[length]
        self.taken[length] += n
        self.counts[length] -= n
        if not self.counts[length]:
            self.order.remove(length)
            del self.counts[length]
        return first

    def times(self, group: tuple[int, ...]) -> int:
        """How often the group can be taken."""
        return min(self.counts[s] // group.count(s) for s in group)


def best_pair(open_: Lengths, j: int, room: int) -> int:
    """Greatest sum of two open pieces that fit into ``room`` beside j; 0 if none do."""
    best = 0
    for x in reversed(open_.order):
        if x <= room and open_.counts[x] > (x == j) and 2 * x >= best:
            y = open_.fitting(min(room - x, x), (j, x))
            best = max(best, x + y if y else 0)
    return best


def dominating(open_: Lengths, j: int, limit: int) -> tuple[int, ...] | None:
    """A set with a piece of length j that dominates all others with it; None if this can't be shown."""
    room = limit - j
    b = open_.fitting(room, (j,))
    if b is None:
        return (j,)
    two = open_.shortest(2, j)
    if b == room or two is None or two > room:
        return j, b
    three = open_.shortest(3, j)
    if three is not None and three <= room:
        return None
    if b >= best_pair(open_, j, room):
        return j, b
    c = open_.fitting(room - b, (j, b))
    if c is None:
        return None
    for x in reversed(open_.order):  # pairs x >= y that fit; the longest y for each x
        if x <= room and open_.counts[x] > (x == j):
            y = open_.fitting(min(room - x, x), (j, x))
            if y and y > c and x + y > b:
                return None
    return j, b, c


def reduce(open_: Lengths, limit: int) -> list[tuple[tuple[int, ...], int, list[int]]]:
    """(set, times, first copy of each member) of all sets fixed by dominance; ``open_`` keeps the rest."""
    fixed = []
    changed = True
    while changed:
        changed = False
        for j in sorted(open_.order, reverse=True):
            while open_.counts.get(j, 0) and (group := dominating(open_, j, limit)):
                times = open_.times(group)
                sizes = {s: open_.take(s, times * group.count(s)) for s in set(group)}
                firsts = [sizes[s] + times * group[:k].count(s) for k, s in enumerate(group)]
                fixed.append((group, times, firsts))
                changed = True
    return fixed


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first copy, first sequence, copies per sequence, offset): copy k of a segment stands in
    sequence ``first + k // per`` at ``offset + k % per * length``."""
    open_ = Lengths(counts)
    segments, sequence = [], 0
    for group, times, firsts in reduce(open_, limit):
        offset = 0
        for s, first in zip(group, firsts, strict=True):
            segments.append((s, first, sequence, 1, offset))
            offset += s
        sequence += times
    ranges: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, number of sequences)
    rooms: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                bisect.insort(rooms, room)
            ranges.setdefault(room, []).append((first, n))

    for s in sorted(open_.order, reverse=True):
        n = open_.counts[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                first, many = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(at)
            else:
                room, first, many = limit, sequence, -(-n // (limit // s))
                sequence += many
            per = room // s
            used, over = min(many, n // per), 0
            segments.append((s, open_.taken[s], first, per, limit - room))
            placed = used * per
            leave(room - per * s, first, used)
            if used < many and n > placed:
                over = n - placed
                leave(room - over * s, first + used, 1)
                placed, used = n, used + 1
            leave(room, first + used, many - used)
            open_.taken[s] += placed
            n -= placed
    return sorted(segments)


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece; ``ids`` are little-endian 32-bit numbers."""
    found = materialise(pieces(docs, path, id, text, limit, end_id), "pieces")
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    counts = materialise(counts.select("part", "length", "n", before.alias("before")), "piece-counts")
    instance = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    segments = np.array(plan(instance, limit), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = segments[:, 0] << 44 | segments[:, 1]
        for batch in batches:
            length, copy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            _, first, sequence, per, offset = segments[np.searchsorted(marks, length << 44 | copy, "right") - 1].T
            k = copy - first
            kept = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")}
            yield pa.RecordBatch.from_pydict(kept | {
                "sequence_id": pa.array(sequence + k // per), "offset": pa.array(offset + k % per * length),
            })

    numbered = found.join(sized_side(counts.drop("n")), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids", (F.col("before") + F.col("copy")).alias("number")
    )
    kind = found.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint")


def pack_digest(packed: DataFrame) -> DataFrame:
    """``pack`` with the CRC of the ids in their place."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
