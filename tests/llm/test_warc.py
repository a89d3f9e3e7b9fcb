import hashlib

import pytest
import zstandard
from helpers import rows

from adlake.llm import warc
from adlake.llm.queries import op12_warc_archives

DATE = "2020-01-01T00:00:00Z"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(pages):
    """(page_id, url) to what the archives must say; pages are (page_id, url, html)."""
    order = lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or "")
    out = []
    for p in pages:
        html = p[2] or ""
        first = min((q for q in pages if (q[2] or "") == html), key=order)
        revisit = len(html.encode()) >= 100 and order(first) != order(p)
        out.append((str(p[0]), len(html.encode()), sha(html), "revisit" if revisit else "response",
                    str(first[0]) if revisit else "None", "None"))
    return sorted(out)


def outcome(df):
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]),
                   str(r["error"])) for r in rows(df))


SCHEMA = "page_id long, url string, html string, archive string, error string, payload string"


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x", "y", "z") for p in pages], SCHEMA)


def test_round_trip_of_odd_pages(spark, tmp_path):
    long = "<p>é long " * 300_000
    pages = [(i, f"http://a.org/{i}", f"<html>page {i % 7} " + "filler é " * 40) for i in range(300)]
    pages += [(1000, None, None), (1001, "http://b c\r\nX: y", ""), (1002, "u", "x" * 99), (1003, "u", "x" * 99),
              (1004, "u", "é" * 50), (1005, "u", "é" * 50), (None, "u", "n" * 200), (None, None, "n" * 200), (7, "u", "n" * 200),
              (2000, "u", long), (2001, "u", long), (5, "http://a.org/5", pages[5][2]),
              (3000, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (3001, "u", warc.EMPTY_FRAME * 30)]
    frame(spark, pages).repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = outcome(op12_warc_archives(spark, str(tmp_path)))
    assert got == plain(pages)
    folder = warc.write(spark.read.parquet(str(tmp_path / "pages.parquet")), archive_bytes=2000)
    back = rows(warc.read(spark, folder))
    assert len({r["archive"] for r in back}) > 8 and not any(r["error"] for r in back)
    texts = {r["page_id"]: r["payload"].decode() for r in back if r["record_type"] == "response" and r["page_id"]}
    assert texts[2000] == long and texts[3001] == warc.EMPTY_FRAME * 30
    assert next(r["target_uri"] for r in back if r["page_id"] == 1001) == "http://b%20c%0D%0AX:%20y"


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "pages.parquet"))
    assert rows(op12_warc_archives(spark, str(tmp_path))) == []


def test_archive_layout(spark, tmp_path):
    pages = frame(spark, [(i, f"http://a.org/{i}", f"<html>{i} " + "common words of pages " * 30) for i in range(200)])
    dictionary = warc.learned_dictionary(pages)
    assert dictionary and dictionary == warc.learned_dictionary(pages.repartition(3))
    folder = warc.write(pages, str(tmp_path / "w"), dictionary=dictionary)
    data = next(f for f in sorted((tmp_path / "w").glob("part-*")) if f.stat().st_size).read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18" and data[8:8 + len(dictionary)] == dictionary
    assert data.endswith(warc.EMPTY_FRAME.encode()) and folder
    found = list(warc.frames(data))
    for (at, raw), end in zip(found, [*[a for a, _ in found[1:]], len(data) - 8]):
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(data[at:end])
        assert one == raw and raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def made(*records, dictionary=b"", pack=False):
    more = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    body = zstandard.ZstdCompressor().compress(dictionary) if pack else dictionary
    head = warc.DICTIONARY_MAGIC + len(body).to_bytes(4, "little") + body if dictionary else b""
    coder = zstandard.ZstdCompressor(write_checksum=True, **more)
    return head + b"".join(coder.compress(r) for r in records)


def some(html="<html>", **more):
    raw = html.encode()
    return warc.record("response", 1, "u", hashlib.sha256(raw).hexdigest(), raw, len(raw), None, DATE)


@pytest.mark.parametrize("pack", [False, True])
def test_foreign_archives(pack):
    text = [f"<html>{i} and some more common words".encode() * 3 for i in range(400)]
    dictionary = zstandard.train_dictionary(4096, text, k=64, d=8).as_bytes()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: d\r\nX: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    skip = b"\x55\x2a\x4d\x18\x03\x00\x00\x00abc"
    data = made(info, some(), dictionary=dictionary, pack=pack) + skip + made(some("later"))
    kinds = [warc.parsed(raw) for _, raw in warc.frames(data)]
    assert [k["record_type"] for k in kinds] == ["warcinfo", "response", "response"] and not any(k["error"] for k in kinds)
    assert kinds[0]["payload"] == b"abc" and kinds[2]["payload"] == b"later"
    assert warc._fields(b"X: a\r\n b") == {"x": "a b"}
    large = "".join(chr(97 + (i * i * 7919) % 26) for i in range(400_000))
    assert [warc.parsed(r)["payload"].decode() for _, r in warc.frames(made(some(large), some()))] == [large, "<html>"]


@pytest.mark.parametrize(("old", "new", "reason"), [
    (b"WARC/1.1", b"WARC/9.9", "version"), (b"WARC-Date: " + DATE.encode() + b"\r\n", b"", "no WARC-Date"),
    (b"<html>\r\n\r\n", b"<html>x\r\n\r\n", "Content-Length says"), (b"<html>", b"<htmx>", "digest"),
    (b"text/html; charset=utf-8\r\nContent-Length: 6", b"text/html; charset=utf-8\r\nContent-Length: 7", "HTTP header says"),
    (b"msgtype=response\r\nContent-Length: 8", b"msgtype=response\r\nContent-Length: 9", "Content-Length says"),
    (b"Page-ID: 1", b"no colon", "without a name"), (b"Page-ID: 1", b"Page-ID: x", "invalid literal")])
def test_records_that_do_not_hold(old, new, reason):
    raw = some()
    assert old in raw and warc.parsed(raw)["error"] is None
    assert reason in warc.parsed(raw.replace(old, new, 1))["error"]


def test_archives_that_break_off(spark, tmp_path):
    good = made(some("one"), some("two"), dictionary=b"")
    flipped = bytearray(good)
    flipped[-6] ^= 1
    cases = {"cut": good[:-3], "flipped": bytes(flipped), "junk": good + b"junk", "dict": warc.DICTIONARY_MAGIC + b"\xff\0\0\0x",
             "skip": good + b"\x50\x2a\x4d\x18\xff\0\0\0", "empty": b"", "good": good}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in rows(warc.read(spark, str(tmp_path))):
        got.setdefault(r["archive"].rsplit("/", 1)[1], []).append((r["payload"], r["error"]))
    assert [p for p, e in got["good"]] == [b"one", b"two"] and "empty" not in got
    for name, n in (("cut", 2), ("flipped", 2), ("junk", 3), ("dict", 1), ("skip", 3)):
        assert len(got[name]) == n and got[name][-1][1] and not any(e for _, e in got[name][:-1]), name


def test_revisits_of_what_is_not_there(spark, tmp_path):
    digest = sha("gone")
    stray = warc.record("revisit", 4, "u", digest, b"", 4, "<urn:uuid:gone>", DATE)
    other = warc.record("revisit", 5, "u", digest, b"", 4, warc.record_id(1, "u", sha("<html>")), DATE)
    (tmp_path / "a").write_bytes(made(stray, other, some()))
    got = {r["page_id"]: r["error"] for r in rows(warc.resolved(warc.read(spark, str(tmp_path))))}
    assert got == {4: "the response is missing", 5: "the response has another payload", 1: None}
