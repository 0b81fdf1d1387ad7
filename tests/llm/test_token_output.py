from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelloom.llm import token_output as t

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = t.pack(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8
    assert (t.unpack(data, 1001, bits) == ids).all()


def test_bits_are_the_least():
    assert [t.bits_for(v) for v in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_shard_random_access():
    rng = np.random.default_rng(3)
    docs = [(None, rng.integers(0, 3000, 7).astype(np.uint32))] + [(i, rng.integers(0, 3000, n).astype(np.uint32)) for i, n in enumerate([0, 1, 5000, 300, 0, 17])]
    f = t.ShardFile(t.shard_bytes(docs, 12, block=64))
    assert f.total == sum(len(d) for _, d in docs) and f.nulls.tolist() == [1] + [0] * 6
    for k, (_, ids) in enumerate(docs):
        assert (f.document(k) == ids).all()
    flat = np.concatenate([d for _, d in docs])
    for a, b in ((0, 1), (63, 65), (100, 3000), (f.total - 1, f.total), (5, 5)):
        assert (f.ids(a, b) == flat[a:b]).all()
    with pytest.raises(ValueError, match="shard"):
        t.ShardFile(b"x" * 100)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcÀé'stlldremv ²½3_!<|>\n\t\u00a0\u0301İßдŉ\x1c东"), max_size=40))
def test_encoder_is_the_library(text):
    e = t.encoder(FILE)
    assert e.encode([text])[0] == e._whole(text)


def test_encoder_on_mixed_batches():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefghijéü.,!'-9") for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(60)] + [None, ""]
    e = t.Encoder(FILE)
    whole = Tokenizer.from_file(FILE)
    want = [np.array(whole.encode(x, add_special_tokens=False).ids if x else [], "<u4").tobytes() for x in texts]
    assert e.encode(texts) == want and e.encode(texts) == want


def test_cache_that_is_too_small(monkeypatch):
    monkeypatch.setattr(t, "CACHE_PIECES", 10)
    e = t.Encoder(FILE)
    texts = [f"alpha{i} beta{i} common words" for i in range(40)]
    assert e.encode(texts) == [e._whole(x) for x in texts]


def test_documents_round_trip(docs):
    got = t.encode_documents(docs, FILE).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    whole = Tokenizer.from_file(FILE)
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), np.array([*(whole.encode(r["text"], add_special_tokens=False).ids if r["text"] else []), t.END_ID], "<u4").tobytes()) for r in rows)
    at, expect = 0, []
    for (have, i), ids in want:
        expect.append((i if have else None, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == expect


def test_many_shards_agree_with_one(docs, spark):
    from pixelloom.llm.common import new_path

    path = new_path(spark, "test-shards")
    manifest = t.write_shards(docs, FILE, path, shard_docs=3, shard_ids=40)
    assert manifest.count() > 3 and manifest.where("part > 0").count() > 0
    many = sorted(map(tuple, t.read_shards(manifest, path).collect()), key=lambda r: r[1])
    one = sorted(map(tuple, t.encode_documents(docs, FILE).collect()), key=lambda r: r[1])
    assert many == one


def test_empty_table(none):
    assert t.encode_documents(none, FILE).count() == 0


def test_ranges_don_t_meet_in_a_task(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 60, 211):
        keys = t.even_keys(spark, n)
        d = spark.createDataFrame([(k,) for k in keys], "key long").repartition(n, "key").select(F.spark_partition_id().alias("p"))
        assert len(set(keys)) == n == d.distinct().count()


def test_another_vocabulary_goes_to_the_library(tmp_path):
    """Same end-of-word mark, other splitter: pieces would give wrong ids, so texts are encoded whole."""
    import json

    data = json.load(open(FILE))
    assert t.Encoder(FILE).marked
    data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(data))
    e, whole = t.Encoder(str(other)), Tokenizer.from_file(str(other))
    texts = ["it's a small-scale test, isn't it?", "12 3a4"]
    assert not e.marked and e.encode(texts) == [np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    byte_level = public_tokenizers.path("byte_bpe_50k.json")
    assert not t.Encoder(byte_level).marked and t.Encoder(byte_level).encode(texts) == [np.array(Tokenizer.from_file(byte_level).encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
