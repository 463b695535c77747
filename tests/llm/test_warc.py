"""WARC archives: round trips, roles, and what is left after damage."""

import gzip
import hashlib
import random
from collections import Counter

import pytest

from staylens.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, last string"  # the last two clash with columns of the operator


def pages():
    r = random.Random(8)
    words = lambda k: " ".join(r.choice(["ä", "WARC/1.1", "<p>", "\r\n\r\n", "x"]) for _ in range(k))
    big = [words(600) + str(i) for i in range(4)]
    out = [(i, f"http://h/{i}", words(r.randint(0, 900))) for i in range(40)]
    out += [(100 + i, "http://h/copy", big[i % 2]) for i in range(9)] + [(200, None, big[2]), (201, "http://x/\r\n\x00 y", big[2]), (202, "u", big[2])]
    out += [(300, "u", None), (301, "u", ""), (302, None, None), (303, "u", "short"), (304, "u", "short"), (None, "u", big[3]), (None, "u", big[3]), (305, "u", big[3])]
    out += [(306, "u", "e" * 999), (307, "u", "e" * 999), (308, "u", "f" * 1000), (309, "u", "f" * 1000), (310, "u", "é" * 500), (311, "u", "é" * 500), (312, "u", "y" * 3_000_000)]
    return out + [(311, "u", "é" * 500)]  # a repeated row


def wanted(rows):
    last = {}
    for id, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and id is not None:
            last[b] = max(last.get(b, id), id)
    out = []
    for id, _, html in rows:
        b = (html or "").encode()
        refers = last[b] if id is not None and b in last and id < last[b] else None
        out.append((id, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return Counter(out)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*p, "own", "own") for p in pages()], SCHEMA).repartition(4)


@pytest.mark.parametrize("compress, target", [(True, 32 << 20), (True, 400_000), (False, 32 << 20), (False, 400_000)])
def test_round_trip(spark, table, tmp_path, compress, target):
    folder = warc.archived(table, str(tmp_path / "a"), compress, target=target)
    found = warc.read(spark, folder)
    assert found.where("reason is not null").count() == 0
    got = found.select(warc.number(found.record_id), "payload_bytes", "payload_digest", "record_type", warc.number(found.refers_to), "payload", "url").collect()
    assert Counter(tuple(r)[:5] for r in got) == wanted(pages())
    texts = Counter((r[0], bytes(r[5]).decode()) for r in got if r[3] == "response")
    assert texts == Counter((i, t or "") for i, _, t in pages() if (i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), "response", None) in wanted(pages()))
    assert {r[6] for r in got if r[0] in (200, 201)} == {None, "http://x/%0D%0A%00%20y"}
    assert {tuple(r) for r in warc.read(spark, folder, payloads=False).select("payload").distinct().collect()} == {(None,)}


def test_files_are_gzip(spark, table, tmp_path):
    """Any gzip reader reads the archives."""
    folder = warc.archived(table, str(tmp_path / "a"), target=400_000)
    parts = list((tmp_path / "a").glob("part-*"))
    assert len(parts) > 3 and sum(gzip.decompress(p.read_bytes()).count(b"WARC-Type: ") for p in parts) == len(pages())
    assert folder == str(tmp_path / "a")


def test_hot_payload(spark, tmp_path):
    """Half of the rows share one payload: its revisits carry none through the shuffle, and every row is written once."""
    rows = [(i, "u", "same " * 300 if i % 2 else f"own {i} " * 200) for i in range(3000)]
    found = warc.roles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8), target=200_000)
    got = found.collect()
    assert len(got) == 3000 and sum(r["refers_to"] == 2999 for r in got) == 1499 and sum(r["payload"] is None for r in got) == 1499


def test_empty(spark, tmp_path):
    folder = warc.archived(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read(spark, folder).collect() == []


def one(i, size=300):
    payload = random.Random(i).randbytes(size)
    return warc.record(i, f"http://h/{i}", payload, None, size, hashlib.sha1(payload).hexdigest()) + warc.END


def archive(compress, n=12):
    """Bytes of an archive and the places of its records."""
    data, places = b"", []
    for i in range(n):
        part = warc.member(one(i)) if compress else one(i)
        places.append((len(data), len(data) + len(part)))
        data += part + (warc.NOTHING if compress else b"")
    return data, places


def read(data):
    rows = list(warc.salvaged(data))
    assert all(a[1] <= b[0] for a, b in zip(rows, rows[1:]))
    return [int(warc.NUMBER.match(r[2]["record_id"])[1]) for r in rows if isinstance(r[2], dict)], [r for r in rows if isinstance(r[2], str)]


def test_every_damaged_byte():
    """Whichever byte of a compressed record changes, this record is a gap or still right, and the others are read."""
    data, places = archive(True, 3)
    assert read(data) == ([0, 1, 2], [])
    lo, hi = places[1]
    for at in range(lo, hi):
        ids, gaps = read(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
        assert (ids, gaps) == ([0, 1, 2], []) or (ids == [0, 2] and len(gaps) == 1 and (gaps[0][0], gaps[0][1]) == (lo, places[2][0]))


def test_every_damaged_byte_of_a_plain_record():
    """No check covers the values of a plain header; the block is covered by its digest, the rest by the form of a record."""
    data, places = archive(False, 3)
    lo, hi = places[1]
    block = data.index(warc.END, lo) + 4
    for at in range(lo, hi):
        rows = list(warc.salvaged(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]))
        kept, gaps = [r[:2] for r in rows if isinstance(r[2], dict)], [r[:2] for r in rows if isinstance(r[2], str)]
        assert (kept, gaps) == ([places[0], places[2]], [places[1]]) or (at < block and kept == places and not gaps)


@pytest.mark.parametrize("compress", [True, False])
def test_cut_junk_and_loss(compress):
    data, places = archive(compress)
    everything = list(range(12))
    assert read(data[: places[11][1] - 9]) == (everything[:11], [(places[11][0], places[11][1] - 9, read(data[: places[11][1] - 9])[1][0][2])])
    middle = places[4][0]
    junk = b"\x1f\x8b\x08junk WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + bytes(500)
    ids, gaps = read(data[:middle] + junk + data[middle:])
    assert ids == everything and [(g[0], g[1]) for g in gaps] == [(middle, middle + len(junk))]
    lost = places[6][0] + 40
    ids, gaps = read(data[: places[3][0] + 25] + data[lost:])  # from inside record 3 to inside record 6
    assert ids == [0, 1, 2, *everything[7:]] and len(gaps) == 1
    assert read(junk)[0] == [] and read(b"") == ([], [])
    # a whole plain archive behind a damaged compressed one, and the other way round
    other, _ = archive(not compress)
    ids, gaps = read(data[:middle] + b"?" + other + data[places[8][0] :])
    assert ids == [0, 1, 2, 3, *everything, 8, 9, 10, 11] and [(g[0], g[1]) for g in gaps] == [(middle, middle + 1)]


def test_quoted_record_stays_inside():
    inner = one(7)
    outer = warc.record(1, "u", inner, None, len(inner), hashlib.sha1(inner).hexdigest()) + warc.END
    assert read(outer + one(2)) == ([1, 2], [])


def test_damaged_files(spark, tmp_path):
    data, places = archive(True)
    (tmp_path / "a.warc.gz").write_bytes(data[: places[5][0] + 30] + b"\0" * 10 + data[places[5][0] + 40 :])
    (tmp_path / "b.warc.gz").write_bytes(b"no archive")
    (tmp_path / "c.warc.gz").write_bytes(b"")
    found = warc.read(spark, str(tmp_path)).collect()
    assert sorted(int(warc.NUMBER.match(r["record_id"])[1]) for r in found if r["record_id"]) == [i for i in range(12) if i != 5]
    gaps = {r["archive"].rsplit("/", 1)[1]: (r["start"], r["end"]) for r in found if r["reason"]}
    assert gaps == {"a.warc.gz": (places[5][0], places[6][0]), "b.warc.gz": (0, 10)}
