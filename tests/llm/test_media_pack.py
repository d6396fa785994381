"""JPEG media and packing: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kerbside.llm import jpeg, pack


def payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def test_media_read_back(make, odd):
    from tests.llm.conftest import ODD

    rows = [*enumerate(ODD), (100, "ÿ" * 3000), (101, "".join(chr(i) for i in range(1, 2000)))]
    got = {r.doc_id: r for r in jpeg.decode(jpeg.encode(make(rows))).collect()}
    for i, text in rows:
        p = payload(text)
        assert (got[i].n_bytes, got[i].payload_bytes) == (len((text or "").encode()), len(p))
        assert (got[i].payload_sha256, got[i].tail_crc32) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[0].media_sha256 == got[1].media_sha256 and got[0].feature == got[1].feature
    assert jpeg.decode(jpeg.encode(odd)).count() == odd.count() and jpeg.decode(jpeg.encode(make([]))).count() == 0


def test_large_payloads_take_several_shapes(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST_ROWS", 30)
    rng = np.random.default_rng(1)
    for n in (576, 576 * 2, 576 * 30, 576 * 31, 576 * 65):
        raw = rng.integers(0, 256, n, np.uint8).tobytes()
        files = jpeg.encode_group(list(jpeg.frames(raw)))
        assert b"".join(t.tobytes() for t in jpeg.decode_group([jpeg.parse(f) for f in files])) == raw


def test_plain_decoder_agrees_and_takes_components():
    raw = bytes(range(256)) * 9
    image = jpeg.parse(jpeg.encode_group(list(jpeg.frames(raw)))[0])
    assert jpeg.decode_plain(image).tobytes() == raw
    # 2x1 sampled luminance with one chrominance, one bit codes: DC size 0 or 3, AC end or a coefficient of 2 bits
    image = jpeg.Image()
    image.height, image.width, image.interval, image.quant = 8, 16, 0, {0: 8, 1: 8}
    image.components = [[1, 0x21, 0, 0], [2, 0x11, 1, 0]]
    dht = bytes([0, 2, *[0] * 14])
    image.dht = {0: dht + bytes([0, 3]), 16: dht + bytes([0, 0x12])}
    bits = "01" + "101" + "01" + "11" + "00" + "00" + "00" + "01" + "010" + "00"
    image.scan = int(bits.ljust(24, "1"), 2).to_bytes(3, "big")
    assert jpeg.decode_plain(image).tolist() == [[128 + 5, 128 + 5]]


def brute_pieces(rows, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    return sorted(out, key=str)


def check_packing(got, capacity):
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_and_places(make, odd):
    from tests.llm.conftest import ODD

    rng = random.Random(2)
    rows = [*enumerate(ODD), (77, "a  b \n c\n  d <|endoftext|> it's")]
    rows += [(200 + i, " ".join(rng.choice(["é", "word", "tion", "12"]) for _ in range(rng.randint(1, 400)))) for i in range(80)]
    got = pack.pack(make(rows), 256).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute_pieces(rows, 256)
    n = check_packing(got, 256)
    assert n <= -(-sum(r.length for r in got) // 256) + 2
    assert check_packing(pack.pack(odd, 64).collect(), 64) and pack.pack(make([])).count() == 0


def test_ids_equal_the_other_library_around_odd_characters():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = pack.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple(pack.SPECIAL.items()))
    points = [*range(1, 0x3100), *range(0xA600, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F300, 0x1FB00)]
    for at in range(0, len(points), 50):
        text = "".join(f"a{c}1 {c} {c}{c}\n{c}'s<|endoftext|>{c}" for c in map(chr, points[at : at + 50]))
        assert ids_of.encode(text, allowed_special="all") == t.encode(text, add_special_tokens=False).ids


def test_ranks_over_many_buckets(make, monkeypatch):
    monkeypatch.setattr(pack, "BUCKET_PIECES", 2)
    monkeypatch.setattr(pack, "RUN", 3)
    rows = [(i, ("word " * (i % 3 + 1)).strip()) for i in range(200)]
    got = pack.pack(make(rows), 64).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute_pieces(rows, 64)
    assert len({(r.sequence_id, r.offset) for r in got}) == 200 and check_packing(got, 64) <= -(-sum(r.length for r in got) // 64) + 1


def test_queries_take_special_tokens_as_tokenizers_does(spark, tmp_path, make):
    from kerbside.llm import queries

    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "<|endoftext|>" * 3000, " plain  text"]
    make(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        at = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    got = queries.op9_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_plan_uses_every_piece_once():
    rng = random.Random(9)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        slots = pack.plan(dict(counts), 64)
        used = {}
        for length, first, copies, times, _, _ in slots:
            assert first == used.get(length, 0)
            used[length] = first + copies * times
        assert used == counts
