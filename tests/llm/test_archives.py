"""Archives: round trips, damage of every kind against what was written, equal payloads against a plain loop."""

import gzip
import hashlib
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.llm import warc
from weft.llm.common import shared_dir

PAGES = "page_id long, url string, html string"


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def salvaged(data):
    rows = list(warc.salvage(warc.Window(File(data), len(data))))
    return [r for r in rows if not r["fault"]], [(r["start"], r["stop"], r["fault"]) for r in rows if r["fault"]]


def archive(payloads, compress):
    whole = [warc.record_bytes("response", f"urn:page:{i}/x", f"http://h/{i}", p, None, "1970-01-01T00:00:00Z", compress) for i, p in enumerate(payloads)]
    starts = [sum(map(len, whole[:i])) for i in range(len(whole) + 1)]
    return whole, starts


def texts(n, seed=0):
    rng = random.Random(seed)
    return [bytes(rng.choice(b"abc <>\r\n") for _ in range(rng.choice([0, 1, 30, 3000, 70_000]))) for _ in range(n)]


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip_and_damage(compress):
    payloads = texts(40)
    whole, starts = archive(payloads, compress)
    data = b"".join(whole)
    good, bad = salvaged(data)
    assert [r["payload"] for r in good] == payloads and not bad
    assert [r["payload_digest"] for r in good] == [hashlib.sha1(p).hexdigest() for p in payloads]
    rng = random.Random(1)
    for trial in range(60):
        hit = sorted(rng.sample(range(40), rng.randint(1, 6)))
        damaged = bytearray(data)
        for i in hit:
            at = rng.randrange(starts[i], starts[i + 1])
            damaged[at] ^= 1 << rng.randrange(8)
        good, bad = salvaged(bytes(damaged))
        places = [r["start"] for r in good]
        # a gzip header's time, flags of no use and a plain header's free text may change without harm
        assert set(starts[:-1]) - {starts[i] for i in hit} <= set(places) <= set(starts[:-1])
        for r in good:
            i = starts.index(r["start"])
            assert i in hit or r["payload"] == payloads[i]
        covered = sorted([(r["start"], r["stop"]) for r in good] + [b[:2] for b in bad])
        assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


@pytest.mark.parametrize("compress", [True, False])
def test_lost_and_added_bytes(compress):
    payloads = texts(12, 3)
    whole, starts = archive(payloads, compress)
    cut = b"".join(whole[:4]) + whole[4][: len(whole[4]) // 2] + b"".join(whole[5:])  # a member cut short within the file
    good, bad = salvaged(cut)
    assert [r["payload"] for r in good] == payloads[:4] + payloads[5:] and [b[:2] for b in bad] == [(starts[4], starts[4] + len(whole[4]) // 2)]
    junk = b"\x1f\x8b\x08 WARC/1.1\r\n no record" * 50
    good, bad = salvaged(junk + b"".join(whole[:6]) + junk + b"".join(whole[6:]) + b"\0" * 100)
    assert [r["payload"] for r in good] == payloads and len(bad) == 3 and bad[0][:2] == (0, len(junk))
    good, bad = salvaged(b"".join(whole)[:-3])
    assert len(good) == 11 and bad[0][1] == starts[-1] - 3
    assert salvaged(b"") == ([], []) and salvaged(b"not an archive")[1] == [(0, 14, "no member or version line")]


def test_records_of_others():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    digest = hashlib.sha1(b"body").hexdigest()
    two = f"WARC/1.0\r\nwarc-type: response\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n".encode()
    good, bad = salvaged(gzip.compress(one + two) + one + two)  # two records of a member, then plain ones
    assert [(r["record_type"], r["payload"]) for r in good] == [("warcinfo", b"hi"), ("response", b"body")] * 2 and not bad
    wrong = two.replace(b"body", b"bode")
    good, bad = salvaged(one + wrong + one)
    assert len(good) == 2 and bad == [(len(one), len(one + wrong), "payload digest differs")]
    assert salvaged(wrong.replace(b"sha1", b"what"))[0][0]["payload"] == b"bode"  # an unknown algorithm isn't checked


def expected(rows):
    groups = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append(page)
    out, seen = Counter(), set()
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p in groups.get(data, []) if p is not None), default=None)
        revisit = len(groups.get(data, [])) > 1 and (page != top or data in seen)
        if data in groups and page == top:
            seen.add(data)
        out[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_write_and_read(spark, compress):
    long, longer, same = "é" * 600, "x y\r\n" * 400_000, "same " * 300
    rows = [(1, "http://a/ b\r\nX: y", long), (2, None, long), (3, "", None), (None, "http://n", long), (4, "http://a", "short"), (5, "http://a", "short"), (6, "u", longer), (7, "u", same), (7, "u", same), (7, "v", same), (6, "u", same), (None, None, None)]
    rows += [(100 + i, "http://hot", "hot page " * 200) for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit("clash"), "top": F.lit(1), "n": F.lit(2), "bytes": F.lit(3), "row": F.create_map(F.lit(1), F.lit(2))}).repartition(3)
    manifest = warc.write_archives(pages, shared_dir(spark), compress=compress, bytes_per_file=50_000)
    read = warc.read_archives(manifest).persist()
    assert warc.gaps(read).isEmpty()
    got = warc.records(read).withColumns({c: F.regexp_extract(a, r"urn:page:(-?\d+)/", 1).try_cast("long") for c, a in (("page", "record_id"), ("other", "refers_to"))})
    found = got.collect()
    assert Counter((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["other"]) for r in found) == expected(rows)
    assert len({r["record_id"] for r in found if r["payload_bytes"] >= 1000}) == sum(r["payload_bytes"] >= 1000 for r in found)
    assert {r["target_uri"] for r in found if r["page"] == 1} == {"http://a/%20b%0D%0AX:%20y"}
    responses = {r["record_id"][1:-1] if r["record_id"].startswith("<") else r["record_id"] for r in found if r["record_type"] == "response"}
    assert all((r["refers_to"] or "").strip("<>") in responses for r in found if r["record_type"] == "revisit")
    sizes = {r["archive"].removeprefix("file://"): r["bytes"] for r in manifest.collect()}
    listed = {r["archive"].partition("file:")[2]: r["bytes"] for r in warc.archives(spark, next(iter(sizes)).rpartition("/")[0]).collect()}
    assert listed == sizes
    read.unpersist()


def test_nothing_to_archive(spark):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES), shared_dir(spark))
    assert warc.read_archives(manifest).collect() == []


def test_only_rows_without_ids(spark):
    rows = [(None, "a", "q" * 1500), (None, "b", "q" * 1500)]
    read = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES), shared_dir(spark)))
    assert sorted(r["record_type"] for r in read.collect()) == ["response", "revisit"]
