import hashlib
import random
import zlib

import pytest

from glossa.llm import media_sequence as M
from glossa.llm import queries


def test_images_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 575, 576, 577, 5000):
        payload = M.padded(rng.randbytes(n))
        assert len(payload) % 576 == 0 and len(payload) >= 576
        stored = M.encode_png(payload)
        assert M.decode_png(stored).tobytes() == payload
    with pytest.raises(ValueError):
        M.decode_png(stored[:60] + b"x" + stored[61:])


def test_items_keep_order_positions_and_captions():
    d = "a" * 64
    page = f'<p>one <b>two</b></p><figure><img src="sha256:{d}" alt=x><figcaption>Cap &amp; tion</figcaption></figure><p>three<img src="http://e/x.png" alt="alt text"> four</p><video src="sha256:{d}"></video>'
    items = M.items_of(page)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [
        (0, "text", "one two", None, None), (1, "media", None, d, "Cap & tion"), (2, "text", "three", None, None), (3, "media", None, None, "alt text"), (4, "text", "four", None, None), (5, "media", None, d, None),
    ]
    assert M.items_of(None) == M.items_of("") == []


def test_unknown_digests_resolve_to_nulls(spark):
    pages = spark.createDataFrame([(1, f'<img src="sha256:{"0" * 64}">', "k"), (2, None, None)], "page_id long, html string, items string")
    media = spark.createDataFrame([("1" * 64, 5)], "digest string, size int")
    rows = M.resolve(M.sequences(pages), media).collect()
    assert [(r.page_id, r.position, r.size) for r in rows] == [(1, 0, None)]


def plain_feature(payload):
    """The feature of a payload, sample by sample."""
    rows = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    counts = [sum(b // 32 == k for b in payload) for k in range(8)]
    edge = sum(abs(a - b) for r in rows for a, b in zip(r, r[1:])) / len(payload)
    return f"png:576x{len(rows)}:mean={sum(payload) / len(payload):.4f}:edge={edge:.4f}:hist=" + "-".join(map(str, counts))


def plain_png(stored):
    """The samples of a grey PNG image whose rows have no filter, read by the format's rules."""
    assert stored[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(stored):
        n = int.from_bytes(stored[at : at + 4], "big")
        chunks.append((stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]))
        assert zlib.crc32(stored[at + 4 : at + 8 + n]) == int.from_bytes(stored[at + 8 + n : at + 12 + n], "big")
        at += 12 + n
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    width, height = int.from_bytes(chunks[0][1][:4], "big"), int.from_bytes(chunks[0][1][4:8], "big")
    assert chunks[0][1][8:] == bytes([8, 0, 0, 0, 0])
    lines = zlib.decompress(chunks[1][1])
    assert len(lines) == height * (width + 1) and not any(lines[:: width + 1])
    return b"".join(lines[i + 1 : i + 1 + width] for i in range(0, len(lines), width + 1))


def test_documents_are_described_from_stored_bytes(spark):
    texts = ["", None, "a" * 576, "é" * 300, "<b>&\n" * 2000, "a" * 576, "x\n\n y\n", "long " * 200_000]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, items string, position int")
    rows = {r.doc_id: r for r in M.digest(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = M.encode_png(payload)
        assert plain_png(stored) == payload
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(payload))
        n = sum(bool(x.strip()) for x in (t or "").split("\n"))
        assert (r.n_texts, r.position, r.caption) == (n, n, f"{len(data)} bytes")
    assert rows[2].feature == rows[5].feature and rows[0].feature == rows[1].feature
    assert M.digest(docs.limit(0)).count() == 0


def test_pages_keep_their_items_in_order(spark, tmp_path):
    pages = [(1, "u", "<p>one</p><p>two <b>three</b></p>"), (2, "u", None), (3, "u", ""), (4, "u", '<p>a</p><img src="http://e/x.png" alt="A">')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = sorted(queries.media_sequence_pages(spark, str(tmp_path)).collect())
    assert [(r.page_id, r.position, r.kind, r.text or r.caption, r.n_payload) for r in rows] == [
        (1, 0, "text", "one", None), (1, 1, "text", "two three", None), (1, 2, "media", "page 1", 576),
        (2, 0, "media", "page 2", 576), (3, 0, "media", "page 3", 576),
        (4, 0, "text", "a", None), (4, 1, "media", "A", None), (4, 2, "media", "page 4", 576),
    ]
