import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from focuslake.llm import bpe
from focuslake.llm.queries import split_pattern, tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"


def whole(text):
    """The library's ids of a whole text."""
    return bpe.encoding(tokenizer_path(RANKS), split_pattern()).encode_ordinary(text or "")


def found(spark, documents, rows, tmp_path, chunk, overlap):
    encoded = bpe.encode(documents(rows, extra=True), tokenizer_path(RANKS), split_pattern(), chunk, overlap, str(tmp_path / "b"))
    return bpe.decode(encoded, tokenizer_path(RANKS)).collect()


def check(got, rows):
    want = [(i, whole(t), (t or "").encode()) for i, t in rows]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


# Overlaps without a boundary, white space of all kinds at joints, apostrophes, letters newer than some tables.
HARD = ["a" * 5_000, " " * 3_000 + "x", "it's they'll we've 're " * 300, "word\n\n  \n\tnext " * 300, "'" * 900 + "s" * 50, "文字列" * 900,
        "!? ''  \u0085 z " * 300, "x՘y'\U00032000s 12 \x1c's " * 300, ("a" * 700 + " b, ") * 9, "1234567890" * 400 + " .", "\U0001f600é" * 800]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 200), (1024, 64)])
def test_ids_equal_the_library(spark, documents, odd, tmp_path, chunk, overlap):
    rows = [*odd, *enumerate(HARD, 100), *enumerate(HARD, 100)]
    check(found(spark, documents, rows, tmp_path, chunk, overlap), rows)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab'srelv.,1 \n\t é文՘\x1c"), min_size=2, max_size=60), st.data())
def test_a_firm_boundary_ends_a_piece(text, data):
    firm = [b for b in range(1, len(text)) if bpe.is_firm(text, b)]
    if firm:
        b = data.draw(st.sampled_from(firm))
        assert whole(text[:b]) + whole(text[b:]) == whole(text)


def test_empty_table(spark, documents, tmp_path):
    assert found(spark, documents, [], tmp_path, 64, 16) == []


def test_long_texts_become_many_rows(spark, documents, prose):
    text = prose(60_000, 1)
    chunks = bpe.cut(documents([(1, text)]).select("doc_id", "text"), 4096, 256)
    bounds = bpe.pre_tokenise(chunks, split_pattern(), 4096, 256).cache()
    parts = bpe.pieces(bounds, 4096).orderBy("piece").collect()
    assert len(parts) == bounds.count() > 50 and "".join(r.text for r in parts) == text


def test_overlap_is_checked(spark, documents):
    with pytest.raises(ValueError):
        bpe.encode(documents([]), tokenizer_path(RANKS), split_pattern(), 10, 20)


def test_digest(spark, documents, tmp_path):
    row = bpe.digest(bpe.decode(bpe.encode(documents([(1, "It's x")]), tokenizer_path(RANKS), split_pattern(), folder=str(tmp_path / "d")),
                                tokenizer_path(RANKS))).first()
    ids = np.array(whole("It's x"), "<u4").tobytes()
    assert (row.ids_sha256, row.decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"It's x").hexdigest())
