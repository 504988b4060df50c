"""Encoding against the tokenizers' own libraries, and back."""

import base64

from hypothesis import given, settings
from hypothesis import strategies as st

from reelgrid.llm import bpe

TEXTS = [
    "Hello world", "  two  blanks \n\n tabs\t", "it's we've I'LL", "naïve café — 42 ½ ١٢٣", "日本語のテキスト", "🎬👍🏽 emoji‍joined", "<|endoftext|> is text", "a" * 3000, "ab" * 3000,
    " " * 500, "\u0000�", "ﬁ ligature", "\r\n\r\n", "x" * 40 + "1234567890" * 30,
]


def own():
    import tiktoken

    path = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_against_the_library():
    mine, theirs = bpe.loaded(bpe.vocabulary()), own()
    for text in TEXTS:
        assert mine.encode(text) == theirs.encode_ordinary(text)
        assert mine.decode(mine.encode(text)) == text


def test_other_vocabulary():
    import tiktoken

    path = bpe.vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("multi", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(bpe.loaded(path).encode(t) == theirs.encode_ordinary(t) for t in TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    mine = bpe.loaded(bpe.vocabulary())
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert mine.encode(text) == own_cached().encode_ordinary(text)
        assert mine.decode(mine.encode(text)) == text


def own_cached(made=[]):  # noqa: B006
    if not made:
        made.append(own())
    return made[0]


def test_frames(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in bpe.encoded(docs, bpe.vocabulary()).collect())
    assert got == [(1, (15496, 995)), (1, (15496, 995)), (2, ()), (3, ())]
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(docs, bpe.vocabulary()), bpe.vocabulary()).collect()}
    assert back == {1: "Hello world", 2: "", 3: ""}
    assert sorted(tuple(r) for r in bpe.counted(docs, bpe.vocabulary(), ["doc_id"]).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.encoded(docs.limit(0), bpe.vocabulary()).count() == 0


def test_round_trip_of_the_documents(spark):
    from conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    back = bpe.decoded(bpe.encoded(docs, bpe.vocabulary()), bpe.vocabulary()).withColumnRenamed("text", "back")
    assert docs.join(back, "doc_id").filter("coalesce(text, '') <> back").count() == 0
