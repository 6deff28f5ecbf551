import struct
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from focuslake.llm.queries import tokenizer_path
from focuslake.llm.tokens import END_ID, Encoder, digest, pack, parse_shard, shard_bytes, store_ids, unpack
from focuslake.llm.words import slices


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_round_trip_of_ranks(values):
    control, data = pack(np.array(values, np.uint32))
    assert len(control) == (len(values) + 3) // 4
    assert unpack(control, data, len(values)).tolist() == values


def test_round_trip_of_a_file():
    there, ids, counts, ranks = parse_shard(shard_bytes([3, None], np.array([2, 1]), np.array([0, 70_000, 5], np.uint32)))
    assert (there.tolist(), ids[0], counts.tolist(), ranks.tolist()) == ([True, False], 3, [2, 1], [0, 70_000, 5])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB'st.,1 \n\u00a0éÉ文İΣσ\u0301<|endoftext>"), max_size=25), min_size=1, max_size=6))
def test_ids_equal_the_tokenizer(texts):
    encoder = Encoder(tokenizer_path())
    found = []
    for s in slices(pa.array(texts + ["<|endoftext|> It's"]), 40):
        ids, counts = encoder.encode(s)
        found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [END_ID] for t in texts + ["<|endoftext|> It's"]]


def test_files(spark, documents, odd, tmp_path):
    got = digest(store_ids(documents(odd, extra=True), tokenizer_path(), str(tmp_path / "ids"))).collect()
    tokenizer = Encoder(tokenizer_path()).tokenizer
    want = []
    for i, t in odd:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID]
        want.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    assert [r.doc_id or 0 for r in ordered] == sorted(r.doc_id or 0 for r in ordered)


def test_empty_table(spark, documents, tmp_path):
    assert store_ids(documents([]), tokenizer_path(), str(tmp_path / "ids")).collect() == []
