import hashlib
import random

import pytest

from symlens.llm.bpe import USUAL, ByteBPE, bpe_decode, bpe_digests, bpe_encode, read_ranks
from tests.llm.helpers import frame, prose

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "aa", "  ", "\n", "\t", "\r\n", "ab", "the", " the", "'s", "é", "漢字", "🙂", "👩‍👩", " ", " ", "\u0085", "\x1c", "1", "２", "Ⅷ", "!!", "​", "́", "ß", "\x00", "<|endoftext|>", "=", " "]


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_encodes_as_the_ranks_say(exact):
    r, c = random.Random(1), ByteBPE(PATH)
    texts = ["".join(r.choice(BITS) for _ in range(r.randrange(1, 16))) for _ in range(4000)] + [x * n for x in "ae .-=1\n\té" for n in (1, 2, 3, 7, 64, 130)]
    got = c.encode(texts)
    assert got == [exact.encode_ordinary(t) for t in texts]
    assert [c.decode(x).decode() for x in got] == texts
    whole = c.tokenizer.encode_batch(texts, add_special_tokens=False)  # the library's own chain
    assert c.encode_offsets(texts) == [(e.ids, e.offsets) for e in whole]


def test_ids_that_the_vocabulary_lacks():
    c = ByteBPE(PATH)
    assert c.decode([]) == b""
    for bad in ([-1], [len(c.tokens.size)], [1, None]):
        with pytest.raises(ValueError):
            c.decode(bad)


def test_own_pattern_gives_the_same_ids(exact):
    texts = ["It's a test, 12 Éa\n\n  go ", ""]
    assert USUAL == P.PATTERN
    for pattern in (P.PATTERN, rf"(?:{P.PATTERN})"):
        assert ByteBPE(PATH, pattern).encode(texts) == [exact.encode_ordinary(t) for t in texts]
    assert len(ByteBPE(PATH, r"\S").encode(["abc d"])[0]) == 4


def test_digests_of_a_table(spark, exact):
    rows = prose(7) + [(100, "x " * 50_000), (None, "a"), (5000, "🙂é漢")]
    want = {}
    for i, t in rows:
        ids = exact.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = bpe_digests(frame(spark, rows).withColumnRenamed("n_chars", "n_tokens"), PATH)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert {r.doc_id: r.ids for r in bpe_digests(frame(spark, rows), PATH, ids=True).collect()} == {i: exact.encode_ordinary(t or "") for i, t in rows}
    assert bpe_digests(frame(spark, rows).limit(0), PATH).count() == 0


def test_offsets_and_round_trip(spark):
    rows = [(1, "héllo 🙂 wörld"), (2, None), (3, "")]
    tokens = bpe_encode(frame(spark, rows), PATH)
    got = {r.doc_id: r for r in tokens.collect()}
    for i, t in rows:
        assert all((t or "")[a:b] for a, b in zip(got[i].starts, got[i].ends))
    assert {r.doc_id: r.text for r in bpe_decode(tokens, PATH).collect()} == {i: t or "" for i, t in rows}
    assert bpe_encode(frame(spark, rows), PATH, offsets=False).filter("starts IS NULL").count() == 3
