import hashlib
import zlib

import numpy as np
import pytest

from orrery.llm import webp

from .webp_encoder import encode


def _tiles(n):
    return -(-n // 8)


@pytest.mark.parametrize("seed", range(8))
def test_images_come_back(seed):
    rng = np.random.default_rng(seed)
    h, w = int(rng.integers(1, 30)), int(rng.integers(1, 40))
    colours = rng.integers(0, 2**32, size=int(rng.integers(1, 40)), dtype=np.uint32)
    image = colours[rng.integers(0, len(colours), size=(h, w))]
    modes = rng.integers(0, 14, size=(_tiles(h), _tiles(w)))
    cross = rng.integers(0, 2**24, size=(_tiles(h), _tiles(w))).astype(np.uint32)
    meta = rng.integers(0, 3, size=(_tiles(h), _tiles(w)))
    for how in ({}, {"green": True}, {"modes": modes}, {"cross": cross}, {"cache_bits": 5}, {"meta": meta}, {"palette": True}, {"palette": True, "cache_bits": 4}, {"modes": modes, "cross": cross, "green": True, "cache_bits": 3, "meta": meta}):
        assert (webp.decode(encode(image, **how)) == image).all(), how


def test_near_offsets_are_the_formats():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


TEXTS = [b"", b"a", b"a" * 5000, b"ab" * 300, bytes(range(255)) * 90, "é".encode() * 4000, b"x\n" + b"a line that stands here many times over and over\n" * 300, b"\xff" * 576]
TEXTS += [b"".join(bytes([i % 251, 7, (i * 3) % 251, 9]) for i in range(9000)), b"".join(bytes([i % 7] * 4) for i in range(3000))]


def _files(media):
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + size]
        at += size


def test_payloads_come_back():
    rng = np.random.default_rng(3)
    texts = TEXTS + [b" ".join(TEXTS[4][a : a + 9] for a in rng.integers(0, 240, size=int(k))) for k in rng.integers(1, 4000, size=40)]
    payloads = [webp.padded(t) for t in texts]
    assert all(len(p) % webp.ROW_BYTES == 0 and p.startswith(t) for p, t in zip(payloads, texts))
    media = webp.encode_payloads(payloads)
    assert [f[0] for f in webp.decode_payloads(media)] == payloads
    assert [webp.encode_payloads([p])[0] for p in payloads] == media  # whatever stands beside it
    assert webp.encode_payloads([]) == webp.decode_payloads([]) == []
    # what the stored files use: transforms, the colour cache, codes of different lengths; abreast and one by one give the same
    files = [f for m in media for f in _files(m)]
    images = [webp.Image(f) for f in files]
    assert {k for i in images for k, *_ in i.transforms} >= {webp.PREDICTOR} and {i.pixels.cache_bits for i in images} == {0, 8}
    assert any(len({n for n in g[0] if n}) > 3 for i in images for g in i.pixels.groups)
    assert all((a == webp.decode(f)).all() for a, f in zip(webp.decode_all(files), files))


def test_many_images_of_any_kind_abreast():
    rng = np.random.default_rng(11)
    images, files = [], []
    for k in range(60):
        h, w = int(rng.integers(1, 20)), int(rng.integers(1, 30))
        colours = rng.integers(0, 2**32, size=int(rng.integers(1, 30)), dtype=np.uint32)
        image = colours[rng.integers(0, len(colours), size=(h, w))]
        tiles = lambda most: rng.integers(0, most, size=(_tiles(h), _tiles(w)))  # noqa: E731, B023
        how = [{}, {"modes": tiles(14)}, {"cross": tiles(2**24).astype(np.uint32), "green": True}, {"palette": True, "cache_bits": 3}, {"meta": tiles(3), "cache_bits": 6, "modes": tiles(14)}][k % 5]
        images.append(image)
        files.append(encode(image, **how))
    assert all((a == b).all() for a, b in zip(webp.decode_all(files), images))
    found = webp.decode_all([*files, files[0][:30], b"", files[1][:-6] + bytes(6)])
    assert all((a == b).all() for a, b in zip(found, images)) and isinstance(found[60], ValueError) and isinstance(found[61], ValueError)


def test_a_file_of_another_encoder():
    # one transparent pixel, as browsers are asked whether they can show it
    import base64

    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[0]]


def test_a_file_by_hand():
    # written bit by bit from the format's description: two pixels, simple codes, subtract-green; blue of two symbols
    bits = "10000000000000" + "00000000000000" + "0" + "000"  # width 2 and height 1 less one, no alpha, version 0
    bits += "1" + "01" + "0"  # a transform: subtract-green; no more
    bits += "0" + "0"  # no colour cache, one group of codes
    eight = lambda n: format(n, "08b")[::-1]
    bits += "101" + eight(10) + "101" + eight(5) + "111" + eight(3) + eight(200) + "101" + eight(255) + "100" + "0"  # green 10, red 5, blue 3 or 200, alpha 255, distance 0
    bits += "0" + "1"
    body = b"\x2f" + bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    body += bytes(len(body) % 2)
    size = len(body)
    data = b"RIFF" + (size + 12).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body
    pixel = lambda a, r, g, b: a << 24 | r << 16 | g << 8 | b
    assert webp.decode(data).tolist() == [[pixel(255, 15, 10, 13), pixel(255, 15, 10, 210)]]


def test_repeated_lines_are_copies():
    line = b"a line that stands here many times over and over in rows of pixels...\n\n\n"[:72]
    assert len(webp.encode_payloads([webp.padded(line * 200)])[0]) < len(line) * 200 / 10


def test_damage_is_an_error():
    media = webp.encode_payloads([webp.padded(b"hello world " * 80)])[0]
    for bad in (b"", media[:40], b"RIFX" + media[4:], media[:60] + b"\0" * (len(media) - 60)):
        found = webp.decode_payloads([bad])[0]
        assert isinstance(found, Exception) or found[0] != webp.padded(b"hello world " * 80)


def test_operator(spark):
    rows = [(1, "some text", 5), (2, None, 6), (3, "", 7), (4, "some text", 8), (None, "äöü" * 400, 9), (6, "long " * 40_000, 1), (6, "long " * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    found = {r.doc_id: r for r in webp.digest(webp.read_media(webp.store_texts(docs))).collect()}
    for i, text, _ in rows:
        payload = webp.padded((text or "").encode())
        assert found[i].payload_bytes == len(payload) and found[i].tail_crc32 == zlib.crc32(payload[-32:]) and found[i].n_bytes == len((text or "").encode())
        assert bytes(found[i].pixels) == payload and found[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and found[i].height == len(payload) // 576
    assert found[1].media_sha256 == found[4].media_sha256 and found[2].media_sha256 == found[3].media_sha256
    assert webp.read_media(webp.store_texts(docs.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, 0, b"nothing"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.error and r.pixels is None for r in webp.read_media(broken).collect())


def test_an_image_without_copies_alone():
    for n in (1, 7, 16):
        payload = np.random.default_rng(n).integers(0, 256, 576 * n, dtype=np.uint8).tobytes()
        assert webp.decode_payloads(webp.encode_payloads([payload])) == [(payload, n)]


def test_smooth_payloads_get_transforms_whatever_stands_beside_them():
    """Every image is offered all transforms: slopes get a predictor, like channels subtract-green, text neither; all come back."""
    rng = np.random.default_rng(3)
    slope = (np.arange(144)[None, :, None] + np.arange(16)[:, None, None] * 3 + rng.integers(0, 3, (16, 144, 1)) + [0, 0, 0, 0]).astype(np.uint8)
    alike = np.repeat(rng.integers(0, 256, (16, 144, 1)), 4, axis=2).astype(np.uint8)
    leaning = alike.copy()
    leaning[..., 2] = (leaning[..., 1].view(np.int8).astype(int) * 3 // 4).astype(np.uint8)
    text = b" ".join(b"word%d" % k for k in rng.integers(0, 300, 1500))[: 576 * 16]
    payloads = [slope.tobytes(), alike.tobytes(), leaning.tobytes(), text]
    raw = [np.frombuffer(p, dtype="<u4").astype(np.uint32) for p in payloads]
    px, owner, first = np.concatenate(raw), np.repeat(np.arange(4), 144 * 16), np.tile(np.arange(144 * 16), 4)
    _, heads = webp._transformed(px, owner, first, np.full(4, 16), 144)
    assert [bool(h) for h in heads] == [True, True, True, False]
    assert [b for b, _ in webp.decode_payloads(webp.encode_payloads(payloads))] == payloads
    assert len(webp.encode_payloads(payloads[:1])[0]) < 0.35 * len(payloads[0])
