"""Byte-level BPE against a public library, and back."""

import hashlib
import struct
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings as hypothesis_settings, strategies as st

from veil.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH),
                             special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return byte_bpe.Merges(byte_bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def vocabulary(spark):
    return byte_bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)


def check(rows, library):
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        assert list(r["ids"]) == ids
        assert bytes(r["bytes"]) == (r["text"] or "").encode()
        assert r["digest"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def both(df, vocabulary, **options):
    return byte_bpe.decode(byte_bpe.encode(df, vocabulary, **options), vocabulary, ids_sha256="digest").collect()


@pytest.mark.parametrize("block_chars", [1, 1000, 2_000_000])
def test_like_the_library(docs, vocabulary, library, block_chars):
    rows = both(docs.limit(40), vocabulary, block_chars=block_chars)
    assert len(rows) == 40
    check(rows, library)


def test_edges(edges, nothing, clashing, vocabulary, library):
    rows = both(edges, vocabulary)
    assert len(rows) == edges.count()
    check(rows, library)
    assert both(nothing, vocabulary) == []
    wide = byte_bpe.decode(byte_bpe.encode(clashing, vocabulary), vocabulary, ids="ids_")
    assert wide.columns == [*clashing.columns, "ids_", "bytes"] and {r["ids"] for r in wide.collect()} == {"9"}


SPACES = st.sampled_from([" ", "  ", "\n", " \n", "\t", "\u00a0", "\x1c", "\x85", "\u2003", "\r\n", "   "])
PIECES = st.one_of(SPACES, st.text(max_size=6), st.sampled_from(["don't", "'ll", "'s", "123", "über", "日本", "a" * 200]))


@hypothesis_settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12))
def test_any_text(library, merges, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    coder = byte_bpe.Coder(public_tokenizers.PATTERN, merges)
    coder.block(["some other text before it"])
    assert coder.block([text, text])[1].as_py() == library.encode_ordinary(text)


def test_the_heap_and_the_matrix_agree(merges):
    for word in ("ththererandthe" * 4, "aaaaaaaaaaaaa", "ßßßß", "thereisnothing"):
        raw = word.encode()
        assert merges._long(raw).tolist() == merges.words([raw])[0].tolist()


def test_the_memory_of_chunks_is_bounded(merges):
    coder = byte_bpe.Coder(public_tokenizers.PATTERN, merges, most=5)
    texts = [f"word{i} and word{i + 1} again" for i in range(30)]
    once = byte_bpe.Coder(public_tokenizers.PATTERN, merges)
    assert [coder.block([t]).to_pylist() for t in texts] == [once.block([t]).to_pylist() for t in texts]


def test_long_words_leave_nothing_in_the_worker(library):
    """The tables are a broadcast value, which outlives the task."""
    merges = byte_bpe.Merges(byte_bpe.read_ranks(PATH))
    before = set(vars(merges))
    raw = "there" * 40
    assert merges.words([raw.encode()])[0].tolist() == library.encode_ordinary(raw)
    assert set(vars(merges)) == before


def test_texts_become_strings_block_by_block(merges, monkeypatch):
    """A batch may hold 10,000 rows; only those of a block are Python strings at a time."""
    taken = []
    monkeypatch.setattr(byte_bpe, "mapped", lambda df, inputs, run, added: taken.append(run))
    monkeypatch.setattr(byte_bpe, "fresh", lambda df, *names: list(names))
    monkeypatch.setattr(byte_bpe, "whole_text", lambda name: None)
    docs = SimpleNamespace(columns=["text"], dtypes=[("text", "string")])
    byte_bpe.encode(docs, SimpleNamespace(pattern=public_tokenizers.PATTERN, merges=SimpleNamespace(value=merges)),
                    block_chars=100_000)
    batch = pa.RecordBatch.from_arrays([pa.array(["only a few words " * 600] * 2000)], ["text"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in taken[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 15e6 < batch.nbytes


def test_columns_are_sent_to_tasks_once(spark, vocabulary, monkeypatch):
    sent, real = [], byte_bpe.mapped
    monkeypatch.setattr(byte_bpe, "mapped", lambda df, inputs, run, added: (
        sent.append(len(inputs)), real(df, inputs, run, added))[1])
    texts = spark.createDataFrame([(None, "a"), ("", "b"), ("some words", None)], "text string, other string")
    out = byte_bpe.decode(byte_bpe.encode(texts, vocabulary), vocabulary, ids_sha256="digest")
    assert sent == [0, 0]
    assert {(r["text"], r["other"], bytes(r["bytes"])) for r in out.collect()} == {
        (None, "a", b""), ("", "b", b""), ("some words", None, b"some words")}
    # Other types are cast first, and null ids are none.
    numbers = byte_bpe.encode(spark.createDataFrame([(None,), (12,)], "text int"), vocabulary)
    assert {bytes(r["bytes"]) for r in byte_bpe.decode(numbers, vocabulary).collect()} == {b"", b"12"}
    for kind in ("array<int>", "array<bigint>"):
        ids = spark.createDataFrame([(1, None), (2, []), (3, [256, 257]), (4, None)], f"n int, ids {kind}")
        rows = {r["n"]: r for r in byte_bpe.decode(ids, vocabulary, ids_sha256="digest").collect()}
        assert len({(bytes(rows[n]["bytes"]), rows[n]["digest"]) for n in (1, 2, 4)}) == 1 and not rows[1]["bytes"]
        pieces = vocabulary.merges.value.pieces(np.array([256, 257]))[0].tobytes()
        assert bytes(rows[3]["bytes"]) == pieces and rows[1]["ids"] is None
