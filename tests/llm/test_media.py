"""Exact round trips of payloads through tar shards."""

import hashlib
import tarfile
import zlib

from hypothesis import given
from hypothesis import strategies as st

from skyloom.llm import media
from skyloom.llm.common import shared_folder


@given(st.binary(max_size=2000))
def test_round_trip(raw):
    payload = media.padded(raw)
    stored = media.encoded(payload)
    assert media.decoded(stored) == payload and len(payload) % 64 == 0 and payload
    assert media.header(stored[: media.HEADER_BYTES])["height"] == len(payload) // 64


def test_features_and_shards(spark):
    rows = [(1, "abc", "x"), (2, None, None), (3, "", "x"), (4, "é" * 70000, "x"), (5, "abc", "x"), (5, "abc", "x"), (None, "z", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    folder = shared_folder(spark, "media-test")
    places = media.stored(docs, folder)
    out = {r["doc_id"]: r.asDict() for r in media.features(places).collect()}
    for doc_id, text, _ in rows:
        payload = media.padded((text or "").encode())
        got = out[doc_id]
        assert got["n_bytes"] == len((text or "").encode()) and got["payload_bytes"] == len(payload) == got["width"] * got["height"]
        assert got["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got["tail_crc32"] == zlib.crc32(payload[-64:])
    assert {k: v for k, v in out[1].items() if k != "doc_id"} == {k: v for k, v in out[5].items() if k != "doc_id"}
    for place in media.canonical(places).collect():
        with tarfile.open(place["shard"].removeprefix("file:")) as tar:
            member = tar.getmember(place["digest"] + ".png")
            assert (member.offset_data, member.size) == (place["offset"], place["length"])
    assert media.features(media.stored(docs.limit(0), folder)).count() == 0
