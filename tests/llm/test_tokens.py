import base64
import random
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import tokens
from tidemark.llm.bpe import Encoder, Vocabulary

tiktoken = pytest.importorskip("tiktoken")
HERE = Path(tokens.TOKENIZERS)
pytestmark = pytest.mark.skipif(not (HERE / tokens.BYTE_BPE).exists(), reason="no public vocabularies here")
#: The pattern of the public vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(HERE / "byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return Encoder(str(HERE / tokens.BYTE_BPE), memo=2_000)


def encode(enc, texts):
    raw = [t.encode() for t in texts]
    counts, ids = enc.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts)]


def test_every_token_encodes_to_itself():
    v = Vocabulary(str(HERE / tokens.BYTE_BPE))
    assert len(v.bytes_of) == 50_256
    assert [t for t, b in v.bytes_of.items() if v.encode_piece(b) != [t]] == []


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(reference, ours, seed):
    rng = random.Random(seed)
    alphabets = ["ab '\n\tsdlrevtm", "aab  \n\t'sdlrevtm’ éß中あ😀12٣,.!' 　\x1c\x85İ́_-", "aaaa", "the quick brown don't we'll 'session' ' s 's", "\x00\x01ÿ𝔘🏳️‍🌈​ "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    assert encode(ours, texts) == [reference.encode_ordinary(t) for t in texts]


def test_every_character(reference, ours):
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert encode(ours, texts) == [reference.encode_ordinary(t) for t in texts]


def test_contractions_do_not_reach_into_the_next_text(reference, ours):
    texts = ["it'", "s", "'", "ll", "x'l", "l", " ", "a", "  ", " b", "", "'re", "it's'", "'"]
    assert encode(ours, texts) == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 30_000 + "x", "word " * 60_000, "ÿ" * 20_000, "<|endoftext|>" * 500, "\n" * 9_999], ids=len)
def test_very_long_texts(reference, ours, text):
    assert encode(ours, [text, "", text[:7]]) == [reference.encode_ordinary(t) for t in (text, "", text[:7])]


def test_rows_nulls_and_clashing_names(spark, reference):
    texts = ["Hello world", "", None, "Hello world", "naïve  café\n", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id bigint, text string, _made string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df, ["doc_id"]).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counted = tokens.count_tokens(df.repartition(3), ["doc_id"]).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in counted} == {i: len(x) for i, x in got.items()}
    assert tokens.encode_corpus(df.limit(0), ["doc_id"]).count() == 0
    assert tokens.encode_corpus(df, ["doc_id", "_made"]).first()["_made"] == "keep"


def test_nothing_is_shuffled_and_only_two_columns_are_read(spark, tmp_path):
    spark.createDataFrame([(1, "x", "y")], "doc_id bigint, text string, other string").write.parquet(f"{tmp_path}/d")
    plan = tokens.encode_corpus(spark.read.parquet(f"{tmp_path}/d"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "other" not in plan


def test_memory_is_bounded_by_bytes_however_odd_the_texts(reference):
    """Texts without spaces: a hundred thousand distinct pieces of some hundred bytes, and a few of half a megabyte."""
    import resource

    rng = random.Random(3)
    enc = Encoder(str(HERE / tokens.BYTE_BPE), memo_bytes=1 << 20)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    most = 0
    for i in range(25):
        texts = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([40, 200, 300]))) for _ in range(2000 if i else 4000)]
        got = encode(enc, texts)
        most = max(most, enc.held)
        assert got[:3] == [reference.encode_ordinary(t) for t in texts[:3]]
    assert most <= (1 << 20) + 4000 * 256 and len(enc.known) <= 10_000 and max(map(len, enc.known)) <= 256
    long = "".join(rng.choice("xyz") for _ in range(500_000))
    assert encode(enc, [long, long]) == [reference.encode_ordinary(long)] * 2 and long.encode() not in enc.known
    encode(enc, ["a b"])
    assert enc.used < 1000  # what the long text left was forgotten with the batch after it
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
