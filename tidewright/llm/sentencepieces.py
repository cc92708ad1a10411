"""SentencePiece models on the `tokenizers` library.

The model's protobuf is parsed here; normaliser, metaspace marker, scores (unigram) or merges (BPE) and byte
fallback are rebuilt from it. Whole texts are encoded in multithreaded batches and compared with
the sentencepiece library.
"""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_slices, table

MARK = "▁"
WORD_START = re.compile(f"(?<=[^{MARK}]){MARK}")
#: Field numbers and enumerations of the model's protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts encoded at once, and characters of a part, about.
BATCH, PART = 32, 1 << 15


def _fields(data: bytes):
    """(number, value) of a protobuf message: an int, 4 or 8 raw bytes, or bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError("damaged model")
                size = varint()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class SentencePieceModel:
    """What a .model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.charsmap, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.trim = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        # no piece holds a marker behind another character: then no merge crosses from one word into the next
        self.by_word = self.kind == BPE and self.escape and all(MARK not in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @classmethod
    def load(cls, path: str) -> SentencePieceModel:
        with open(path, "rb") as f:
            return cls(f.read())

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, those of higher score first."""
        found = []
        usable = {p for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED, UNUSED)}
        for piece, score, kind in self.pieces:
            if kind not in (NORMAL, USER_DEFINED) or len(piece) < 2:
                continue
            own = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
            own.sort(key=lambda p: (self.ids[p[0]], self.ids[p[1]]))
            found += [(-score, self.ids[piece], k, pair) for k, pair in enumerate(own)]
        found.sort(key=lambda x: x[:3])
        return [x[3] for x in found]

    def tokenizer(self):
        """A tokenizers.Tokenizer that encodes what normalise() returns; it normalises nothing itself."""
        from tokenizers import AddedToken, Tokenizer, decoders, models

        if self.kind == UNIGRAM:
            low = min((s for _, s, _ in self.pieces), default=0.0) - 10
            model = models.Unigram([(p, s if k in (NORMAL, USER_DEFINED) else low) for p, s, k in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        else:
            model = models.BPE(self.ids, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        t = Tokenizer(model)
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        t.add_tokens([AddedToken(p, normalized=False, special=False) for p, _, k in self.pieces if k == USER_DEFINED])
        return t

    def normaliser(self):
        """text -> normalised text with markers."""
        charsmap = None
        if self.charsmap:
            from tokenizers import normalizers

            charsmap = normalizers.Precompiled(self.charsmap)

        def f(text: str) -> str:
            if charsmap is not None:
                text = charsmap.normalize_str(text)
            if self.trim:
                text = " ".join(w for w in text.split(" ") if w)
            if not text:
                return ""
            text = (" " if self.dummy_prefix else "") + text
            return text.replace(" ", MARK) if self.escape else text

        return f


class Encoder:
    """texts -> little-endian unsigned 32-bit ids, in multithreaded batches.

    The first `compare` texts (all, if None) are also encoded by the sentencepiece library; any difference is
    a ValueError.
    """

    def __init__(self, path: str, compare: int | None = None):
        self.model = SentencePieceModel.load(path)
        self.tokenizer, self.normalise = self.model.tokenizer(), self.model.normaliser()
        self.left, self.other = compare, None
        if compare != 0:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_file=path)

    def parts(self, text: str) -> list[str]:
        """A normalised text in parts that can be encoded apart; one part where the model doesn't allow more."""
        out, at = [], 0
        while self.model.by_word and len(text) - at > 2 * PART:
            m = WORD_START.search(text, at + PART)
            if not m:
                break
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        owner, parts = [], []
        for i, t in enumerate(texts):
            own = self.parts(self.normalise(t))
            owner += [i] * len(own)
            parts += own
        found: list[list[bytes]] = [[] for _ in texts]
        for at in range(0, len(parts), BATCH):
            got = self.tokenizer.encode_batch_fast(parts[at : at + BATCH], add_special_tokens=False)
            for i, e in zip(owner[at : at + BATCH], got, strict=True):
                found[i].append(np.array(e.ids, dtype="<u4").tobytes())
        out = [b"".join(f) for f in found]
        for text, ids in zip(texts[: self.left], out, strict=False):
            if np.asarray(self.other.encode(text), dtype="<u4").tobytes() != ids:
                raise ValueError(f"the two libraries differ on {text[:80]!r}")
        if self.left is not None:
            self.left = max(0, self.left - len(texts))
        return out


class Decoder:
    """ids -> text: pieces and fallback bytes in order, without the prefix; bytes that aren't UTF-8 become U+FFFD."""

    def __init__(self, path: str):
        self.model = SentencePieceModel.load(path)
        self.pieces = []
        for p, _, k in self.model.pieces:
            if k == BYTE:
                self.pieces.append(bytes([int(p[3:5], 16)]))
            elif k == CONTROL:
                self.pieces.append(b"")
            elif k == UNKNOWN:
                self.pieces.append(" ⁇ ".encode())
            else:
                self.pieces.append((p.replace(MARK, " ") if self.model.escape else p).encode())

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", compare: int | None = None) -> DataFrame:
    """Adds the binary column `ids`: the ids of the whole text, little-endian uint32.

    A null text gives null, an empty one no ids. Other columns stay; one already named like `ids` is replaced.
    """
    keep = [f for f in df.schema.fields if f.name != ids]
    schema = T.StructType([*keep, T.StructField(ids, T.BinaryType())])

    def start():
        encoder = Encoder(path, compare)

        def f(rows: dict) -> dict:
            got = encoder.encode([t or "" for t in rows[text]])
            return rows | {ids: [None if t is None else g for t, g in zip(rows[text], got, strict=True)]}

        return f

    return map_slices(df.select(*[F.col(f"`{f.name}`") for f in keep]), start, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the string column `text`, decoded from the binary column `ids`; null stays null. Other columns stay."""
    keep = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField(text, T.StringType())])

    def start():
        decoder = Decoder(path)
        return lambda rows: rows | {text: [None if x is None else decoder.decode(x) for x in rows[ids]]}

    return map_slices(df.select(*[F.col(f"`{f.name}`") for f in keep]), start, schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and whether the decoded text is the whole text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    out = decode(encode(docs, path).drop("text"), path)
    sha = F.sha2(F.col("decoded").cast("binary"), 256)
    return out.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), sha.alias("decoded_sha256"), (sha == F.col("text_sha256")).alias("same_text"))
