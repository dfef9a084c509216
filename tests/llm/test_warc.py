"""WARC archives: exact round trips, standard framing, broken archives, odd rows."""

import base64
import gzip
import hashlib
import random
import zlib

import duckdb
import pytest

from quarry.llm import warc

SCHEMA = "page_id long, url string, html string, size long, sha1 string, record_id string, `to` int"


def pages():
    rng = random.Random(5)
    rows = [(1, "http://a.org/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a.org/ü x\n", "<p>one</p>"), (4, "http://b.org/", None),
            (5, "", ""), (None, "http://c.org/", "<p>one</p>"), (None, None, "alone"), (None, "x", "none"), (None, None, "none"),
            (6, "u", "twice"), (6, "u", "twice"), (6, "v", "twice"), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", "other html of 7"),
            (-9, "u", "é" * 70_000), (8, "u", "".join(rng.choice("ab <>\n") for _ in range(300_000)))]
    rows += [(100 + i, f"http://h.org/{i}", "copied page") for i in range(40)]
    return rows + [(200 + i, f"http://h.org/{i}", f"page {i} " * 50) for i in range(40)]


def expected(rows):
    out, best = [], {}
    key = [(p is None, -(p or 0), u is not None, u or "") for p, u, _ in rows]
    for i, (_, _, html) in enumerate(rows):
        t = html or ""
        if t not in best or key[i] < key[best[t]]:
            best[t] = i
    for i, (p, _, html) in enumerate(rows):
        raw = (html or "").encode()
        first = best[html or ""]
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit",
                    None if i == first else rows[first][0]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table(spark):
    rows = pages()
    return spark.createDataFrame([(*r, 1, "s", "r", 2) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def folder(table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write_archives(table, path)
    return path


def test_round_trip(table):
    got = sorted((tuple(r) for r in warc.archived(table).collect()), key=str)
    assert got == expected(pages())


def test_sql_twin(table):
    con = duckdb.connect()
    frame = table.select("page_id", "url", "html").toArrow()  # noqa: F841
    con.execute("CREATE VIEW pages AS SELECT * FROM frame")
    assert sorted(con.execute(warc.oracle()).fetchall(), key=str) == expected(pages())


def test_payloads_and_names(spark, folder):
    rows = warc.read_archives(spark, folder, payload=True).collect()
    assert sorted(r.payload.decode() for r in rows if r.record_type == "response") == sorted({h or "" for _, _, h in pages()})
    names = [r.record_id for r in rows]
    assert len(set(names)) == len(names)
    for r in rows:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.refers_to_id is None or r.refers_to_id in names
    assert {r.target_uri for r in rows if r.record_id.startswith("urn:page:3:")} == {"http://a.org/ü%20x%0A"}


def test_files_are_plain_gzip_of_one_record_a_member(folder):
    import glob
    n = 0
    for f in glob.glob(f"{folder}/part-*"):
        raw = open(f, "rb").read()
        assert gzip.decompress(raw).count(b"WARC-Record-ID") == sum(1 for _ in warc.read_records([raw]))
        while raw:
            z = zlib.decompressobj(31)
            one = z.decompress(raw)
            assert z.eof and one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC-Record-ID") == 1 and one.endswith(b"\r\n\r\n")
            raw = z.unused_data.lstrip(b"\0")
            n += 1
    assert n == len(pages())


def one(payload=b"hello", name="urn:page:1:x"):
    return warc.member(warc.record(name, "http://a/", len(payload), hashlib.sha1(payload).digest(), payload))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_any_chunks_padding_and_blocks(size):
    rng = random.Random(size)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 50, 5000)]
    raw = b"\0".join(one(t) for t in texts) + b"\0\0"
    got = list(warc.read_records((raw[i:i + size] for i in range(0, len(raw), size)), payload=True, block=size))
    assert [r["payload"] for r in got] == texts
    assert all(raw[r["offset"]:r["offset"] + 2] == b"\x1f\x8b" for r in got)
    assert list(warc.read_records([])) == [] == list(warc.read_records([b"", b"\0\0"]))


def test_broken_archives_raise():
    whole = zlib.decompress(one(), 31)
    bad = [one()[:-9], one()[:40], b"junk", warc.member(b"no record\r\n\r\n"), warc.member(whole.replace(b"hello", b"hullo")),
           warc.member(whole + b"x"), warc.member(whole[:-4]), warc.member(whole.replace(b"length: 5", b"length: 4").replace(b"Length: 5", b"Length: 6")),
           warc.member(whole + whole)]
    for raw in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_records([raw]))


def test_least_bytes_and_empty(spark, table):
    got = warc.archived(table, least_bytes=100).collect()
    assert {r.record_type for r in got if r.payload_bytes < 100} == {"response"} and len(got) == len(pages())
    assert warc.archived(table.limit(0)).count() == 0
