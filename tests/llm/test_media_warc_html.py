"""MPEG audio, WARC archives and HTML content: exact round trips, damage, odd input."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelith.llm import html_content as hc
from panelith.llm import mpeg_audio as ma
from panelith.llm import warc

TEXTS = ["", "a", "é" * 1000, "x" * 50000, "\xff\xfa" * 700, "plain text " * 300]


def naive_crc(data):
    crc = 0
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
    return crc


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_music_crc(n):
    data = random.Random(n).randbytes(n)
    assert ma.music_crc(data) == naive_crc(data)


@pytest.mark.parametrize("text", TEXTS)
def test_audio_roundtrip(text):
    payload = ma.payload_of(text)
    assert len(payload) % 64 == 0 and payload and payload.startswith(text.encode())
    data = ma.write_audio(payload, len(text.encode()))
    a = ma.read_audio(data)
    assert ma.read_payload(data, a) == payload and a.music_ok and a.crc_bad == a.skipped == 0 and a.crc_ok == len(a.offsets) == a.vbr_frames
    assert a.seconds == 1152 * len(a.offsets) / 32000 and all(ma.header(data[o : o + 4]) for o in a.offsets)


def second_decoder(data):
    """The payload and the number of frames by the standard's arithmetic alone: ID3 size, then frame after frame of layer III at 32 kHz."""
    at = 10 + sum(b << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    n = int(re.search(rb"payload_bytes\0(\d+)", data[:at])[1])
    out, frames = b"", 0
    while at < len(data):
        head = int.from_bytes(data[at : at + 4], "big")
        assert head >> 21 == 0x7FF and head >> 19 & 3 == 3 and head >> 17 & 3 == 1 and head >> 10 & 3 == 2
        size = 144 * [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][head >> 12 & 15] * 1000 // 32000
        if not head >> 16 & 1:  # protected: not the table's frame
            out += data[at + 23 : at + size]
            frames += 1
        at += size
    assert at == len(data)
    return out[:n], frames


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["TAG", "APETAGEX", "ID3", "Xing", "VBRI", "\xff\xfb", "\x00", "a", " ", "é", "TAG" + "\x00" * 125, "y" * 32, "z" * 50, "\x7f" * 100]), max_size=40))
def test_payload_of_any_form(parts):
    text = "".join(parts)
    payload = ma.payload_of(text)
    data = ma.write_audio(payload, len(text.encode()))
    a = ma.read_audio(data)
    assert ma.read_payload(data, a) == payload and a.music_ok and a.crc_bad == a.skipped == 0 and not [k for k in a.tags if k[:3] in ("id3", "ape")]
    assert second_decoder(data) == (payload, len(a.offsets))
    tagged = ma.read_audio(data + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["id3v1:title"] == "Song" and tagged.offsets == a.offsets


@pytest.mark.parametrize("place", range(20, 200, 3))
def test_tags_in_the_payload(place):
    for mark in ("TAG", "APETAGEX"):
        text = "x" * 29 + mark + "x" * place
        data = ma.write_audio(ma.payload_of(text), len(text))
        assert ma.read_payload(data, ma.read_audio(data)) == ma.payload_of(text)


def bitwise_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ b else crc << 1) & 0xFFFF
    return crc


def test_crc_of_layers_one_and_two():
    """Frames put together bit by bit: layer I in joint stereo, and layer II with the table for 96 kbit/s a channel."""
    rng = random.Random(5)
    bits = lambda value, n: [value >> (n - 1 - k) & 1 for k in range(n)]
    for head, covered in ((0xFFFE9014 | 1 << 6, [rng.randrange(15) for _ in range(2 * 8 + 24)]), (0xFFFCA0C0, None)):
        raw = bits(head, 32)
        if covered is not None:
            side = [b for v in covered for b in bits(v, 4)]
        else:
            alloc = [(rng.randrange(1 << n), n) for n in [4] * 11 + [3] * 12 + [2] * 7]
            side = [b for v, n in alloc for b in bits(v, n)] + [rng.randrange(2) for v, _ in alloc if v for _ in range(2)]
        h = ma.header(head.to_bytes(4, "big"))
        crc = bitwise_crc(raw[16:] + side)
        whole = raw + bits(crc, 16) + side
        whole += [1] * (8 * h.size - len(whole))
        frame = bytes(int("".join(map(str, whole[k : k + 8])), 2) for k in range(0, len(whole), 8))
        assert h.protected and len(frame) == h.size
        a = ma.read_audio(frame * 3)
        assert (a.layer, a.crc_ok, a.crc_bad) == (h.layer, 3, 0)
        worse = bytearray(frame * 3)
        worse[7] ^= 16
        assert ma.read_audio(bytes(worse)).crc_bad == 1


def test_seek_tables():
    data = ma.write_audio(ma.payload_of("hello " * 20000), 120000)
    a = ma.read_audio(data)
    assert len(a.table) == 100 and a.table == sorted(a.table)
    for i in range(100):  # within a 256th of the bytes of the frame at that part of the time
        assert abs(a.table[i] - a.offsets[i * len(a.offsets) // 100]) <= (a.vbr_bytes or 0) / 256 + 1
    frame = bytes((0xFF, 0xFB, 0x90, 0xC0))
    body = frame.ljust(417, b"\0")
    vbri = frame + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 417 * 5, 4, 4, 1, 2, 1) + struct.pack(">4H", 417, 417, 417, 417)
    b = ma.read_audio(vbri.ljust(417, b"\0") + body * 4)
    assert (b.vbr, b.vbr_frames, b.table) == ("VBRI", 4, [417, 834, 1251, 1668]) and b.offsets == b.table


def test_audio_resync_and_tags():
    data = ma.write_audio(ma.payload_of("hello " * 2000), 12000)
    a = ma.read_audio(data)
    junk = b"junk\xff\xfb\x90\x00" + random.Random(1).randbytes(300)
    cut = a.offsets[1]
    item = (3).to_bytes(4, "little") + bytes(4) + b"k\0abc"
    ape = item + b"APETAGEX" + (2000).to_bytes(4, "little") + (len(item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    b = ma.read_audio(data[:cut] + junk + data[cut:] + ape + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95))
    assert len(b.offsets) >= len(a.offsets) - 1 and b.skipped >= len(junk) and b.tags["id3v1:title"] == "Song" and b.tags["ape:k"] == "abc"
    bad = bytearray(data)
    bad[a.offsets[2] + 10] ^= 1
    assert ma.read_audio(bytes(bad)).crc_bad == 1 and not ma.read_audio(bytes(bad)).music_ok
    worse = bytearray(data)
    worse[a.offsets[2] + 100] ^= 1
    with pytest.raises(ValueError):
        ma.read_payload(bytes(worse), ma.read_audio(bytes(worse)))
    for odd in (None, b"", b"no audio at all" * 10, b"\xff" * 100):
        assert ma.read_audio(odd).offsets == []


def test_headers():
    assert ma.header(bytes((0xFF, 0xFB, 0x90, 0))).size == 417 and ma.header(bytes((0xFF, 0xFB, 0x92, 0))).size == 418
    assert ma.header(b"\xff\xfb\xf0\0") is None and ma.header(b"\xff\xfb\x9c\0") is None and ma.header(b"\xff\xe9\x90\0") is None


def test_audio_columns(spark):
    df = spark.createDataFrame([(1, "abc", 9), (2, None, 9), (2, None, 9), (None, "", 9)], "doc_id long, text string, media int")
    rows = ma.probe(ma.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in rows) == [(0, 0, 64), (1, 3, 64), (2, 0, 64), (2, 0, 64)]
    one = next(r for r in rows if r.doc_id == 1)
    assert one.payload_sha256 == hashlib.sha256(b"abc" + bytes(61)).hexdigest() and one.tail_crc32 == zlib.crc32(b"abc" + bytes(61))
    assert ma.probe(ma.encode(df.limit(0))).collect() == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_roundtrip(spark):
    big, other = "b" * 1000, "é" * 700
    rows = [(i, f"http://h/{i}", f"<p>page {i} {i * 7919}</p>" * 20) for i in range(40)] + [(100, "http://h/a\r\nX: y", big), (101, None, big), (102, "", big), (103, "u", "small"), (104, "u", "small"), (105, "u", None), (106, "u", other), (None, "u", other), (107, "u", other), (107, "u", other)]
    archives = warc.write_warc(pages(spark, rows), 1 << 14)
    archives.cache()
    assert all(bytes(a.data)[:4] == (0x184D2A5D).to_bytes(4, "little") for a in archives.collect() if a.records > 30)
    got = sorted(warc.read_warc(archives).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert len(got) == len(rows)
    html = {}
    for p, _, h in rows:
        html[p] = (h or "").encode()
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        want = {100: 102, 101: 102, 106: 107, None: 107}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", want) if want else ("response", None))
        assert r.payload is None if want else bytes(r.payload) == html[r.page_id]
    assert warc.read_warc(warc.write_warc(pages(spark, []))).collect() == []
    limit, warc.BROADCAST_BYTES = warc.BROADCAST_BYTES, -1
    try:  # the same by a shuffle
        again = sorted(warc.read_warc(warc.write_warc(pages(spark, rows))).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
        assert again == got
    finally:
        warc.BROADCAST_BYTES = limit


def test_warc_urls_and_references(spark):
    urls = ["http://a/b%20c", "http://a/b c", "http://a/é\tx", "", None, "http://a/%"]
    big = "b" * 1000
    rows = [(i, u, big) for i, u in enumerate(urls)] + [(10, "http://a/last page", big)]
    archives = warc.write_warc(pages(spark, rows)).collect()
    records = [warc.parse_record(r) for a in archives for r in warc.read_archive(bytes(a.data))]
    by_id = {r["warc-record-id"]: r for r in records}
    assert len(by_id) == 7
    for r in records:
        if r["warc-type"] == "revisit":
            assert by_id[r["warc-refers-to"]]["x-page-id"] == "10" and r["warc-refers-to-target-uri"] == by_id[r["warc-refers-to"]]["warc-target-uri"] == "http://a/last%20page"
            assert r["warc-payload-digest"] == by_id[r["warc-refers-to"]]["warc-payload-digest"]
    assert next(r for r in records if r["x-page-id"] == "0")["warc-target-uri"] == "http://a/b%20c"
    back = {r.page_id: r.url for r in warc.read_warc(warc.write_warc(pages(spark, rows))).collect()}
    assert back == {**dict(enumerate(urls)), 10: "http://a/last page"}


def test_archive_frames():
    records = [random.Random(i).randbytes(200).hex().encode() * 3 for i in range(50)] + [b""]
    data = warc.write_archive(records)
    assert list(warc.read_archive(data)) == records and list(warc.read_archive(warc.write_archive([b"one"]))) == [b"one"]
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\0\0\0\0 no frame"))


def text_of(page):
    return hc.extract(hc.parse(page), None)


def test_html_parts():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>top</header><nav><ul><li>menu</ul></nav><div class="ad">buy</div><aside>side</aside>
    <article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>\n  word<p>Two<br>lines &lt;b&gt; &#233;<div class="cookie-notice">cookies</div><ul><li>a<li>b</ul><form>f<input></form><script>if (a < b) "</p>"</script><section class="comments">bad</section></article>
    <footer>foot</footer></body></html>"""
    assert text_of(page) == "Title & more One bold word Two lines <b> é a b"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain", "plain"), ("a < b", "a < b"), ("<p>x", "x"), ("<!-- c --><p>x</p><!-- open", "x"), ("<div>one<div>two</div>three", "one two three"), ("<p>a&nbsp;&nbsp; b</p>", "a b"), ("<script>never closed", ""), ("</p></div>x", "x"), ("<p title='>'>q</p>", "q")])
def test_html_odd(page, text):
    assert text_of(page) == text


def tree(*paths):
    """A tree from paths of labels."""
    nodes, known = [(-1, "")], {(): 0}
    for p in paths:
        parts = tuple(p.split("/"))
        for k in range(1, len(parts) + 1):
            if parts[:k] not in known:
                known[parts[:k]] = len(nodes)
                nodes.append((known[parts[: k - 1]], parts[k - 1]))
    return nodes


def brute_match(a, b, i=0, j=0):
    """The weight of the best matching below a pair, by its definition."""
    xs, ys = ([k for k, (p, _) in enumerate(t) if p == r] for t, r in ((a, i), (b, j)))

    def best(m, n):
        if not m or not n:
            return 0
        x, y = xs[m - 1], ys[n - 1]
        same = a[x][1].split(".")[0] == b[y][1].split(".")[0]
        return max(best(m - 1, n), best(m, n - 1), best(m - 1, n - 1) + brute_match(a, b, x, y) if same else 0)

    return best(len(xs), len(ys)) + 2 + (a[i][1] == b[j][1])


def test_tree_matching():
    a = tree("body/div.x/p", "body/ul/li", "body/p")
    assert hc.match(a, a) == (3 * len(a), {i: i for i in range(len(a))})
    one, two = tree("body/div.a/p"), tree("body/div.b/p")
    assert hc.match(one, two)[1] == {0: 0, 1: 1, 2: 2, 3: 3}
    assert hc.slots_of(two, one) == hc.ids_of(one) and hc.from_text(hc.to_text(a)) == a
    rng = random.Random(4)
    for _ in range(60):
        x, y = ([(-1, ""), *((rng.randrange(max(1, k - 3), k + 1) - 1, rng.choice(("p", "div.a", "div.b", "ul"))) for k in range(1, rng.randint(2, 9)))] for _ in range(2))
        assert hc.match(x, y)[0] == brute_match(x, y)
        assert hc.slots_of(x, hc.merge([x, y])) == hc.ids_of(x)


def test_deep_and_wide_pages():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    page = hc.parse(deep)
    assert [b.text for b in page.blocks] == ["x"] and hc.match(page.nodes, page.nodes)[1] == {i: i for i in range(5001)}
    wide = hc.parse("".join(f"<div class={''.join(chr(97 + int(c)) for c in str(i))}><p>t</p></div>" for i in range(1600)))
    assert len(wide.nodes) < 300 and len(wide.blocks) == 1600


SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu".split()


def neutral_page(rng, host, i):
    """(html, content) of a page without telling elements or names; only the place in the tree and what varies tell the content."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    title, paragraphs = line(6), [line(rng.randint(20, 60)) for _ in range(rng.randint(3, 8))]
    side = "".join(f"<div class=q{k}><a href=/{word()}>{line(4)}</a></div>" for k in range(4))
    top = "".join(f"<span><a href=/{word()}>{word()}</a></span> " for _ in range(8))
    body = f"<div class=c1><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs[:-1])}<div class='z{i % 3} {'ab'[i % 2]}'>Sent to all readers of {host} each week</div><p>{paragraphs[-1]}</p></div>"
    html = f"<html><body><div class=a1>{host} daily</div><div class=b1>{top}</div><div class={'x' if i % 2 else 'y'}><div class=d1>{side}</div>{body}</div><div class=e1>{line(5)}</div><div class=f1>All rights reserved, {host}</div></body></html>"
    return html, " ".join([title, *paragraphs])


def word_f1(got, want):
    both = sum((Counter(got.split()) & Counter(want.split())).values())
    return 2 * both / max(1, len(got.split()) + len(want.split()))


def test_induction_decides(spark):
    rng = random.Random(8)
    made = [(h, *neutral_page(rng, f"site{h}.example", i)) for h in range(3) for i in range(150 if h == 0 else 12)]
    df = pages(spark, [(k, f"http://site{h}.example/{k}", html) for k, (h, html, _) in enumerate(made)])
    with_wrapper = {r.page_id: r.text for r in hc.main_text(df).collect()}
    assert [with_wrapper[k] == want for k, (_, _, want) in enumerate(made)].count(False) == 0
    without = {r.page_id: r.text for r in hc.main_text(df, use_wrappers=False).collect()}
    assert not any(without[k] == want for k, (_, _, want) in enumerate(made)) and sum(word_f1(without[k], want) for k, (_, _, want) in enumerate(made)) / len(made) < 0.95
    limit = hc.BROADCAST_BYTES
    try:  # the same by a shuffle
        hc.BROADCAST_BYTES = 0
        assert {r.page_id: r.text for r in hc.main_text(df).collect()} == with_wrapper
    finally:
        hc.BROADCAST_BYTES = limit


def test_wrapper_induction(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=t>Our site since 1999</div><div class=m><p>story {i} {'w' * i}</p></div><div class={'m' if i % 2 else 'n'}2>Call us</div>") for i in range(8)]
    rows += [(20 + i, "http://copies.example/x", f"<article><h1>Same</h1><p>{'the very same words ' * 20}</p><p>{i}</p></article>") for i in range(6)]
    rows += [(30, None, "<p>no host</p>"), (31, "http://[bad", "<p>bad url</p>"), (32, "http://h.example/z", None), (33, "http://one.example/", "<p>alone</p>")]
    df = pages(spark, rows)
    got = {r.page_id: r.text for r in hc.main_text(df.selectExpr("*", "1 AS text", "2 AS host", "3 AS wrapper", "4 AS row")).collect()}
    assert got[3] == f"story 3 {'w' * 3}" and got[6] == "story 6 wwwwww"  # constant nodes went, also where a class differs
    assert got[22].startswith("Same the very same words") and got[22].endswith("2")  # copies are content
    assert (got[30], got[31], got[32], got[33]) == ("no host", "bad url", "", "alone")
    assert hc.main_text(df.selectExpr("*", "1 AS text", "2 AS host", "3 AS wrapper")).columns == ["page_id", "url", "html", "host", "wrapper", "text"]
    assert hc.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize(("n", "size"), [(20, 400_000), (3, 2_000_000), (40, 300)])
def test_dictionary_of_few_or_long_records(n, size):
    rng = random.Random(n)
    words = [f"<p class='{rng.randrange(10**6)}'>" for _ in range(3000)]
    records = [b"".join(rng.choice(words).encode() for _ in range(size // 18)) for _ in range(n)]
    data = warc.write_archive(records)
    assert warc.build_dictionary(records) and int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert list(warc.read_archive(data)) == records
