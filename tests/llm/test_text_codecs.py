import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tidewright.llm import media, packing
from tidewright.llm import sentencepieces as sp
from tidewright.llm.bpe import BytePairEncoder

TEXTS = ["", " ", "hello world", "  two  spaces ", "tab\tline\n\nend ", "naïve façade", "日本語 テキスト", "emoji 😀!", "a" * 3000, "<s></s><unk>▁▁", "<|endoftext|>", "x\x00y", "½²ª", " nbsp", "'s 'LL don't 123abc"]


def test_sentencepiece_parity_and_round_trip():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder, decoder = sp.Encoder(path, compare=None), sp.Decoder(path)
    for t, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(t)
        assert decoder.decode(ids) == other.decode(other.encode(t)) == t.replace("▁", " ")


def test_long_texts_are_encoded_in_parts(monkeypatch):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(sp, "PART", 7)
    encoder = sp.Encoder(path, compare=0)
    texts = [*TEXTS, "the quick  brown   fox " * 30, " a▁b ▁ c" * 20, "x" * 100 + " y" * 50]
    assert encoder.model.by_word and len(encoder.parts(encoder.normalise(texts[-3]))) > 20
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(t)


def _field(n, kind, data):
    out, key = b"", n << 3 | kind
    for v in (key, *((len(data),) if kind == 2 else ())):
        while v > 127:
            out += bytes([v & 127 | 128])
            v >>= 7
        out += bytes([v])
    return out + data


def test_unigram_model_is_rebuilt():
    import struct

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("▁ab", -1.5, 1), ("b", -2.0, 1), ("▁", -3.0, 1), ("a", -3.5, 1)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    data = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += _field(2, 2, _field(3, 0, b"\x01") + _field(35, 0, b"\x01"))
    m = sp.SentencePieceModel(data)
    assert m.kind == sp.UNIGRAM and m.byte_fallback and m.pieces[1] == ("▁a", -1.0, 1)
    ids = m.tokenizer().encode(m.normaliser()("ab  é"), add_special_tokens=False).ids
    assert ids[0] == 2 and [m.pieces[i][0] for i in ids[-2:]] == ["<0xC3>", "<0xA9>"]


def test_unigram_ids_like_sentencepiece():
    """A unigram model written by hand: all ids of random texts, with overlapping pieces, ties aside, and byte fallback."""
    import random
    import struct

    import sentencepiece

    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abc▁", k=n)) for n in (2, 3, 4, 5) for _ in range(40)})
    words = [w for w in words if "▁" not in w[1:]]
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces = special + [(w, -5.0 - 0.7 * len(w) - rng.random() * 4, 1) for w in words] + [(c, -9.0 - rng.random(), 1) for c in "abc▁"]
    data = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += _field(2, 2, _field(3, 0, b"\x01") + _field(35, 0, b"\x01") + _field(40, 0, b"\x00") + _field(41, 0, b"\x01") + _field(42, 0, b"\x02")) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, b"\x01") + _field(4, 0, b"\x00") + _field(5, 0, b"\x01"))
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    m = sp.SentencePieceModel(data)
    assert m.kind == sp.UNIGRAM
    tokenizer, normalise = m.tokenizer(), m.normaliser()
    same = 0
    for n in range(600):
        text = "".join(rng.choices("abc éab日c", k=n % 30))
        got, want = tokenizer.encode(normalise(text), add_special_tokens=False).ids, other.encode(text)
        same += got == want
        assert sorted(got) == sorted(want), text  # the same pieces in another order score the same
    assert same >= 570


def test_long_texts_as_media(spark):
    """Megabytes of text, in rows of both filters: what comes back is what went in, and all filters are undone fast."""
    import time

    import numpy as np

    text = "".join(chr(32 + (i * i // 7) % 90) for i in range(300_000)) * 7
    r = media.read_media(media.to_media(media.payloads(spark.createDataFrame([(1, text)], "doc_id bigint, text string")), row_filter="least"), keep_payload=True).first()
    assert bytes(r.payload)[: len(text)].decode() == text and set(bytes(r.payload)[len(text) :]) <= {0}
    samples = np.frombuffer(bytes(r.payload), dtype=np.uint8).reshape(-1, media.WIDTH)
    kinds = np.frombuffer(__import__("zlib").decompress(media.png_encode(samples, "least")[41:-16]), dtype=np.uint8).reshape(-1, media.WIDTH + 1)[:, 0]
    assert set(kinds.tolist()) == {1, 2}
    times = {}
    for kind in ("up", "paeth", "average"):
        data = media.png_encode(samples[:20000], kind)
        began = time.perf_counter()
        assert (media.png_decode(data) == samples[:20000]).all()
        times[kind] = time.perf_counter() - began
    assert times["paeth"] < 60 * times["up"] + 5  # diagonals, not samples, are what the loop goes over


def test_sentencepiece_frames(spark):
    path = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "hello", "old"), (None, None, None), (1, "hello", "old"), (2, "", "x")], "doc_id bigint, text string, ids string")
    out = sp.decode(sp.encode(df, path), path).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out if r.decoded is not None) == [(1, "hello"), (1, "hello"), (2, "")]
    assert [r.ids for r in out if r.text is None] == [None]
    assert sp.encode(df.where("false"), path).count() == 0


def test_bpe_parity():
    files = packing.tokenizer_files()
    slow = BytePairEncoder(files[0])
    fast = BytePairEncoder(*files)
    assert fast.encode(TEXTS) == slow.encode(TEXTS)


def test_bpe_of_long_texts(monkeypatch):
    from tidewright.llm import bpe

    files = packing.tokenizer_files()
    texts = [*TEXTS, "naïve 日本 it's a\nb  c \n d\t e 12 x " * 40, "日本 語\nの テ" * 30]
    whole = BytePairEncoder(files[0]).encode(texts)
    monkeypatch.setattr(bpe, "PART", 5)
    assert BytePairEncoder(files[0]).encode(texts) == whole == BytePairEncoder(*files).encode(texts)


@pytest.mark.parametrize("row_filter", [*media.FILTERS, "least"])
def test_png_round_trip(row_filter):
    a = np.random.default_rng(3).integers(0, 256, (9, 64), dtype=np.uint8)
    data = media.png_encode(a, row_filter)
    assert (media.png_decode(data) == a).all()
    for broken in (data[:-5], data[:40] + bytes([data[40] ^ 1]) + data[41:], b"x" + data):
        with pytest.raises((ValueError, zlib.error)):
            media.png_decode(broken)


def test_png_mixed_filters():
    a = np.arange(64 * 5, dtype=np.uint8).reshape(5, 64)
    rows = np.vstack([np.zeros((1, 64), np.uint8), a])
    kinds = np.array([2, 2, 1, 0, 2], dtype=np.uint8)
    body = np.empty_like(a)
    for i, k in enumerate(kinds):
        left = np.concatenate(([0], a[i, :-1])).astype(np.uint8)
        body[i] = a[i] - (0 if k == 0 else left if k == 1 else rows[i])
    assert (media.unfilter(kinds, body) == a).all()


def test_media_columns(spark):
    texts = {1: "x" * 64, 2: "", 3: None, 4: "é" * 1000, 5: "x" * 64}
    df = spark.createDataFrame([(k, v, "m") for k, v in texts.items()], "doc_id bigint, text string, media string")
    out = {r.doc_id: r for r in media.read_media(media.to_media(media.payloads(df)), keep_payload=True).collect()}
    for k, v in texts.items():
        b = (v or "").encode()
        padded = b + b"\0" * ((-len(b)) % 64 if b else 64)
        r = out[k]
        assert r.n_bytes == len(b) and bytes(r.payload) == padded and r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:]) and len(r.feature) == 16
    assert out[1].media_sha256 == out[5].media_sha256 and out[1].feature == out[5].feature
    assert media.to_media(media.payloads(df.where("false"))).count() == 0


def test_similar_images_have_near_hashes():
    rng = np.random.default_rng(1)
    a = np.clip(np.cumsum(rng.normal(0, 8, (64, 64)), axis=0) + 128, 0, 255).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    x, y = (int(media.cosine_hash(i), 16) for i in (a, b))
    assert (x ^ y).bit_count() <= 8


def test_every_text_is_compared():
    encoder = sp.Encoder(P.path("piece_bpe_32k.model"))
    encoder.encode(["a word"] * 64)
    encoder.normalise = lambda text: "other"
    with pytest.raises(ValueError):
        encoder.encode(["a word"])


def test_stored_media_have_a_row_filter(spark, tmp_path):
    import hashlib

    text = "some text " * 100
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = media.op3_png_media_columns(spark, str(tmp_path)).first()
    samples = np.frombuffer(text.encode().ljust(1024, b"\0"), dtype=np.uint8).reshape(-1, 64)
    assert r.media_sha256 == hashlib.sha256(media.png_encode(samples, "least")).hexdigest()
    assert r.payload_sha256 == hashlib.sha256(samples.tobytes()).hexdigest()
