"""Round trips and salvage of damaged archives."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import pytest

from labelproof.llm import warc
from labelproof.session import scratch_path

PAGES = [(i, f"http://h/{i}", f"<p>{i} {'x' * (i * 7)}</p>") for i in range(40)]


def plain(page, url, html):
    data = html.encode()
    return warc.record(str(page), url, data, hashlib.sha256(data).hexdigest(), None)


def archive(packed=True):
    parts = [plain(*p) for p in PAGES]
    return [warc.gzip_member(p) if packed else p for p in parts]


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archive(packed):
    found = list(warc.salvaged(b"".join(archive(packed))))
    assert [f[3] for f in found] == [None] * len(PAGES)
    assert [warc.http_payload(f[2][0][1])[1].decode() for f in found] == [p[2] for p in PAGES]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_loses_only_damaged_records(packed):
    rng = random.Random(2)
    for _ in range(60):
        parts = archive(packed)
        damaged = set(rng.sample(range(len(parts)), 3))
        for i in damaged:
            part = bytearray(parts[i])
            how = rng.randrange(3)
            if how == 0:  # a changed byte in the payload or its checksum
                part[-6 if packed else -9] ^= 0xFF
            elif how == 1:  # cut off
                part = part[: len(part) // 2]
            else:  # head lost
                part = part[rng.randrange(1, 20) :]
            parts[i] = bytes(part)
        data = b"".join(parts)
        found = list(warc.salvaged(data))
        got = {int(warc.page_name(h["warc-record-id"])) for f in found for h, _ in f[2]}
        assert got == set(range(len(PAGES))) - damaged
        # records and gaps cover every byte once
        at = 0
        for offset, length, _, _ in found:
            assert offset == at
            at += length
        assert at == len(data)


def pages_of(found):
    return [int(warc.page_name(h["warc-record-id"])) for f in found for h, _ in f[2]]


@pytest.mark.parametrize("how", ["digest", "length", "cut", "stream", "checksum"])
@pytest.mark.parametrize("level", [0, 6])
def test_sound_records_of_a_damaged_member_are_kept(how, level):
    rng = random.Random(3)
    noise = {i: rng.randbytes(3000).hex() for i in range(40)}
    parts = [plain(i, f"http://h/{i}", noise[i]) for i in range(40)]
    if how == "digest":
        parts[20] = parts[20].replace(noise[20][:8].encode(), b"????????")
    if how == "length":
        parts[20] = parts[20].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = bytearray(packer.compress(b"".join(parts)) + packer.flush())
    if how == "cut":
        del member[len(member) // 2 :]
    if how == "stream":
        member[len(member) // 2 : len(member) // 2 + 2000] = b"\xff" * 2000
    if how == "checksum":
        member[-6] ^= 0xFF
    after = warc.gzip_member(plain(99, "http://h/99", "after"))
    found = list(warc.salvaged(bytes(member) + after))
    got = pages_of(found)
    assert len(got) == len(set(got)) and 99 in got
    if how in ("digest", "length"):
        assert sorted(got) == [i for i in range(40) if i != 20] + [99]
        assert any(f[3] and f"bytes {sum(map(len, parts[:20]))} to" in f[3] for f in found)
    elif how == "checksum":
        assert sorted(got) == [*range(40), 99]
    else:
        assert set(range(17)) <= set(got)
    assert sum(f[3] is not None for f in found) == 1
    at = 0
    for offset, length, _, _ in found:
        assert offset == at
        at += length
    assert at == len(member) + len(after)


def covered(found, size):
    """Records and gaps cover every byte once."""
    at = 0
    for offset, length, _, _ in found:
        assert offset == at
        at += length
    assert at == size


@pytest.mark.parametrize("level", [0, 1, 6])
@pytest.mark.parametrize("count", [500, 2000, 4000])
def test_long_members_give_each_record_once(level, count):
    """Stored and deflated members, cut or damaged at any place: true records, each once, and one gap."""
    rng = random.Random(level * 10000 + count)
    parts = [plain(i, f"http://h/{i}", f"<p>{i} {rng.randbytes(rng.randrange(8, 60)).hex()}</p>") for i in range(count)]
    known = {p[: p.index(b"\r\n\r\n")] for p in parts}
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = packer.compress(b"".join(parts)) + packer.flush()
    after = warc.gzip_member(plain("after", "http://h/after", "after"))
    assert pages_of_text(warc.salvaged(whole + after)) == [*map(str, range(count)), "after"]

    def check(data, least, follows):
        found = list(warc.salvaged(data))
        names = pages_of_text(found)
        assert len(names) == len(set(names))
        assert {*names} <= {*map(str, range(count)), "after"} and ("after" in names) == follows
        assert sum(f[3] is not None for f in found) == 1 and len(names) >= least
        covered(found, len(data))
        for _, _, records, _ in found:
            for headers, block in records:
                if headers["warc-record-id"] != "<urn:page:after>":
                    text = parts[int(warc.page_name(headers["warc-record-id"]))]
                    assert text.endswith(b"\r\n\r\n" + block + b"\r\n\r\n")

    assert len(known) == count
    check(whole[:-20], count - 1, False)
    check(whole[: -rng.randrange(9, 300)] + after, 1, True)
    for share in (0.1, 0.5, 0.9):
        place = int(len(whole) * share)
        check(whole[:place], int(count * share * 0.9) - 60, False)
        check(whole[:place] + after, int(count * share * 0.9) - 60, True)
        hurt = bytearray(whole)
        hurt[place : place + 40] = rng.randbytes(40)
        check(bytes(hurt) + after, int(count * share * 0.9) - 60, True)
        check(whole[:place] + whole[place + 7 :] + after, int(count * share * 0.9) - 60, True)


def pages_of_text(found):
    return [warc.page_name(h["warc-record-id"]) for f in found for h, _ in f[2]]


def test_a_block_border_in_a_header_is_no_record():
    sound = plain(1, "http://h/1", "text")
    for place in range(9, sound.index(b"\r\n\r\n")):
        for border in (b"\x00\xff\xff\x00\x00", b"\x01\x10\x00\xef\xff"):
            with pytest.raises(warc.Damaged):
                warc.parsed(sound[:place] + border + sound[place:], 0)


def test_bare_records_after_a_cut_member_are_kept():
    member = warc.gzip_member(b"".join(plain(i, f"http://h/{i}", "x" * i) for i in range(30)))
    bare = [plain(i, f"http://h/{i}", f"bare {i}") for i in range(100, 140)]
    data = member[: len(member) // 2] + b"".join(bare)
    names = pages_of(list(warc.salvaged(data)))
    assert len(names) == len(set(names)) and set(range(110, 140)) <= set(names)


def test_rows(spark):
    big = "<html>" + "same " * 40
    rows = [
        (5, "http://a", big, "x"),
        (3, "http://b\r\nWARC/1.1", big, None),
        (9, None, big, "x"),
        (9, None, big, "x"),
        (None, "http://c", big, "x"),
        (1, "http://d", None, "x"),
        (2, "http://e", None, "x"),
        (4, "http://f", "short", "x"),
        (6, "http://g", "ü" * 200_000, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = scratch_path(spark, "warc-test")
    warc.write(pages, "page_id", "url", "html", folder, records_per_file=2)
    found = warc.read(spark, folder).collect()
    assert len(found) == len(rows)
    got = sorted((str(r.page), r.kind, str(r.refers_to), r.stated_bytes) for r in found)
    assert got == sorted(
        [
            ("3", "response", "None", 206),
            ("5", "revisit", "3", 206),
            ("9", "revisit", "3", 206),
            ("9", "revisit", "3", 206),
            ("None", "revisit", "3", 206),
            ("1", "response", "None", 0),
            ("2", "response", "None", 0),
            ("4", "response", "None", 5),
            ("6", "response", "None", 400_000),
        ]
    )
    assert warc.gaps(warc.read(spark, folder)).count() == 0


def test_archives_are_gzip_files(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-gzip")
    warc.write(pages, "page_id", "url", "html", folder)
    files = spark.read.format("binaryFile").load(folder).collect()
    text = b"".join(gzip.decompress(bytes(f.content)) for f in files)
    assert text.count(b"WARC-Type: response") == len(PAGES)


def test_damage_in_files_is_logged(spark):
    data = b"".join(archive())
    cut = bytearray(data)
    middle = data.find(warc.MAGIC, len(data) // 2)
    cut[middle + 12] ^= 0xFF
    folder = scratch_path(spark, "warc-damage")
    # written as the writer does: members as lines that end with the byte zero
    frame = spark.createDataFrame([(bytes(cut[:-1] if cut[-1] == 0 else cut),)], "b binary")
    frame.selectExpr("cast(b as string) AS value").write.option("lineSep", "\x00").text(folder)
    found = warc.read(spark, folder)
    assert warc.records(found).count() == len(PAGES) - 1
    assert warc.gaps(found).count() == 1


def test_empty_table(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").limit(0)
    folder = scratch_path(spark, "warc-empty")
    warc.write(pages, "page_id", "url", "html", folder)
    assert warc.read(spark, folder).count() == 0
