"""Packing against exhaustive search and the tokenizer's library."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from paperlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequences(counts, limit):
    """{sequence: lengths} of a plan, after checking that every sequence is gapless and no longer than the limit."""
    own = {}
    for x in packing.plan(counts, limit):
        own.setdefault(x[0], []).append(x)
    out = {}
    for s, n in counts.items():
        for c in range(n):
            _, first, sequence, per, offset = own[s][bisect.bisect_right([x[1] for x in own[s]], c) - 1]
            out.setdefault(sequence + (c - first) // per, []).append((offset + (c - first) % per * s, s))
    for held in out.values():
        held.sort()
        assert [o for o, _ in held] == [sum(s for _, s in held[:k]) for k in range(len(held))]
        assert sum(s for _, s in held) <= limit
    return out


def fewest(items, limit):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, limit - items[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(4)
    kinds = Counter()
    for _ in range(500):
        limit = rng.choice([10, 20, 30, 50])
        low = max(1, rng.choice([1, limit // 6, limit // 4, limit // 3]))
        items = [rng.randint(low, limit) for _ in range(rng.randint(0, 9))]
        counts = dict(Counter(items))
        best = fewest(items, limit)
        open_ = packing.Lengths(dict(counts))
        fixed = packing.reduce(open_, limit)
        kinds.update({len(g): n for g, n, _ in fixed})
        assert sum(n for _, n, _ in fixed) + fewest([s for s, n in open_.counts.items() for _ in range(n)], limit) == best
        assert best <= len(sequences(counts, limit)) <= best + 1
    assert kinds[1] and kinds[2] and kinds[3]


def test_large_instance_is_near_the_bound():
    lengths = np.minimum(4096, np.random.default_rng(1).lognormal(5.5, 1.2, 30_000).astype(int) + 2)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    assert len(sequences(counts, 4096)) <= -(-int(lengths.sum()) // 4096) + 1


def test_one_hot_length():
    assert len(sequences({4096: 3, 2048: 5, 1: 100_000}, 4096)) == 3 + 2 + -(-(2048 + 100_000) // 4096)


def brute_pieces(rows, limit):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), limit):
            yield doc_id, k // limit, k, len(ids[k:k + limit]), zlib.crc32(np.array(ids[k:k + limit], "<u4").tobytes())


def check(packed, rows, limit):
    got = packing.pack_digest(packed).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(brute_pieces(rows, limit), key=key)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and x[-1][0] + x[-1][1] <= limit
    return len(held), sum(r["length"] for r in got)


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    for limit in (4096, 16):
        check(packing.pack(odd.repartition(3), PATH, limit=limit), rows, limit)
    assert packing.pack(empty, PATH).count() == 0


def documents_words():
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    words = {w for t in table["text"].to_pylist() for w in (t or "").split()}
    letters = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x100)]]
    rng = random.Random(3)
    return [*sorted(words)[::7], *("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(3000))]


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for text in ("a  b\n c's", "", " é <|endoftext|> x"):
        ids = np.frombuffer(packing._encoder(path)(text.encode()), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_words_apart_encode_as_whole_texts():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    encode = packing._encoder(PATH)
    rng = random.Random(8)
    alphabet = "aeZ'st 09\n\t\x0b\x0c\ŕé  가אΣİ‍\U0001f600\x1c\x85.,-|<>"
    for word in documents_words():
        assert np.frombuffer(encode(word.encode()), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids, word
    for _ in range(800):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", " 's it's"])
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    n, tokens = check(packing.pack(documents.repartition(4), PATH), rows, 4096)
    assert n <= -(-tokens // 4096) + 1
