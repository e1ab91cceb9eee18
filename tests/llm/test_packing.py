import json
import random
import zlib

import numpy as np
import pytest

from symlens.llm.packing import FileBPE, pack, pack_documents, packed_sequences, sequence_lengths
from tests.llm.helpers import frame, prose
from tests.llm.test_bpe import BITS

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(pieces, lengths, capacity):
    """Each id in one piece, sequences gapless, full or a power of two."""
    held = [[0] * n for n in lengths]
    sequences = {}
    for d, start, n, s, offset in pieces:
        assert n > 0
        for i in range(start, start + n):
            held[d][i] += 1
        sequences.setdefault(s, []).append((offset, n))
    assert all(x == 1 for h in held for x in h)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == capacity or at < capacity and at & (at - 1) == 0


def naive(lengths, capacity, linear):
    """The same choice with a look at every sequence for every piece."""
    out, waiting, used = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n // capacity * capacity, capacity):
            out.append((d, start, capacity, used, 0))
            used += 1
        if n % capacity:
            waiting.append((-(n % capacity), d, n - n % capacity))
    sizes = sequence_lengths(-sum(w[0] for w in waiting), capacity)
    room, cost = list(sizes), [0] * len(sizes)
    while waiting:
        waiting.sort()
        n, d, start = waiting.pop(0)
        n = -n
        fit = [(cost[s], s) for s in range(len(sizes)) if room[s] >= n]
        _, s = min(fit or [(cost[s], s) for s in range(len(sizes)) if room[s]])
        take = min(n, room[s])
        if take < n:
            waiting.append((take - n, d, start + take))
        out.append((d, start, take, used + s, sizes[s] - room[s]))
        room[s] -= take
        cost[s] += linear * take + take * take
    return out


def test_places_as_a_plain_search_does():
    r = random.Random(1)
    for _ in range(150):
        capacity, linear = r.choice([8, 16, 100, 1024]), r.choice([0, 1, 6144])
        lengths = [r.randrange(1, r.choice([5, 50, 3000])) for _ in range(r.randrange(60))]
        got = pack(lengths, capacity, linear)
        assert sorted(got) == sorted(naive(lengths, capacity, linear))
        check(got, lengths, capacity)


def test_costs_are_balanced():
    r = random.Random(2)
    lengths = [min(1000, int(r.lognormvariate(4.5, 1))) + 1 for _ in range(4000)]
    cost = {}
    for _, _, n, s, _ in pack(lengths, 1024, 6144):
        cost[s] = cost.get(s, 0) + 6144 * n + n * n
    full = sorted(cost.values())[16:]
    given = [0] * len(cost)  # the documents in their order, cut wherever a sequence ends
    at = 0
    for n in lengths:
        while n:
            take = min(n, 1024 - at % 1024)
            given[at // 1024] += 6144 * take + take * take
            at, n = at + take, n - take
    assert np.std(full) < 0.5 * np.std(given[:-1])


def test_ids_are_the_librarys(library, tmp_path):
    r = random.Random(4)
    e = FileBPE(FILE)
    assert e.encode is not e.library
    texts = ["".join(r.choice([*BITS, "'S", "　", "᠎", "qzx"]) for _ in range(r.randrange(16))) for _ in range(4000)] + ["".join(chr(r.randrange(32, 0xD7FF)) for _ in range(20)) for _ in range(1000)]
    assert [e.encode(t) for t in texts] == [library(t) for t in texts]
    spec = json.load(open(FILE, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    prefixed = FileBPE(str(other))
    assert prefixed.encode is prefixed.library and prefixed.encode("the") == library(" the")


def test_pieces_of_documents(spark, library):
    texts = [*prose(3, 50), (500, "the quick " * 30_000), (501, None), (None, "no id"), (500, "again"), (500, "again"), (502, "<|endoftext|>")]
    table = frame(spark, texts).selectExpr("*", "1 as n", "'x' as ids", "2 as grp")
    want = sorted((-1 if i is None else i, len(library(t or "")) + 1, np.array(library(t or "") + [0], "<u4").tobytes()) for i, t in texts)
    pieces = pack_documents(table, FILE, group_tokens=5000)
    rows = sorted(pieces.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.doc_tokens))
    assert sum(r.length for r in rows) == sum(n for _, n, _ in want)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in rows)
    own = [i for i, *_ in want if want.count(i) < 2]
    for i, n, body in want:
        parts = sorted((r.start, bytes(r.ids)) for r in rows if (-1 if r.doc_id is None else r.doc_id) == i and r.doc_tokens == n)
        if i in own and i != 500:
            assert b"".join(b for _, b in parts) == body
        assert parts[0][0] == 0
    lengths = [r.length for r in packed_sequences(pieces).collect()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths)
    whole = packed_sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.length and sum(r.lengths) == r.length and len(r.doc_ids) == len(r.lengths) for r in whole)
    assert pack_documents(table.limit(0), FILE).count() == 0
