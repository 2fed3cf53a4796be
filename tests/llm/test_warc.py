"""Archives: exact round trips, and damage that is noticed."""

import base64
import hashlib
import io

import pytest

from skyloom.llm import warc
from skyloom.llm.common import file_system, shared_folder


def test_round_trip(spark):
    rows = [(i, f"http://a/{i}\r\nX: y", f"<p>page {i % 7}</p>" * (i % 5 + 1), "z") for i in range(200)]
    rows += [(300, None, None, None), (301, "u", "", None), (None, "u", "<p>page 1</p>", None), (302, "long", "é" * 300000, "")]
    rows += [(303, "u", "same", ""), (303, "u", "same", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    archives = warc.write_archives(pages, shared_folder(spark, "warc-test"))
    out = warc.read_archives(archives).collect()
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        rep = first.get(html or "", i) if i is not None else i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if rep == i else "revisit", None if rep == i else rep))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert warc.read_archives(warc.write_archives(pages.limit(0), shared_folder(spark, "warc-test"))).count() == 0
    system, path = file_system(archives.first()["archive"])
    raw = system.open_input_stream(path).read()
    assert raw[:4] == warc.DICTIONARY_MAGIC and int.from_bytes(raw[4:8], "little") > 0
    with pytest.raises(warc.Damaged):
        list(warc.frames(io.BytesIO(raw[:-3])))


def test_repeated_ids_revisit_by_their_own_payload(spark):
    rows = [(1, "A"), (2, "B"), (5, "A"), (5, "B"), (5, "C"), (7, ""), (6, None)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    out = warc.read_archives(warc.write_archives(pages, shared_folder(spark, "warc-test"))).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in out) == [
        (1, 1, "response", 0), (2, 1, "response", 0), (5, 1, "response", 0), (5, 1, "revisit", 1), (5, 1, "revisit", 2), (6, 0, "response", 0), (7, 0, "revisit", 6)
    ]


def test_damage():
    good = warc.record(1, "u", b"body", None)
    assert warc.described(good)["payload_bytes"] == 4
    for bad in (good.replace(b"body", b"bodx"), good[:-1], good.replace(b"WARC-Date", b"WARC-Dat"), b"x" + good):
        with pytest.raises(warc.Damaged):
            warc.described(bad)
