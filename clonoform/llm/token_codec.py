"""Exact token ids of whole texts, with a memo of white-space separated chunks.

A tokenizer whose pre-tokenizer removes all white space treats each chunk between ASCII
white space alone, so the ids of a text are the ids of its chunks in order. Chunks repeat
a lot in prose; the memo makes the common case one dictionary look-up. Everything that the
memo doesn't hold is encoded by the tokenizers library itself.
"""

from __future__ import annotations

import json
import re

import regex

#: The split pattern of the tokenizer family for which chunks are independent.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PIECES = regex.compile(SPLIT_PATTERN)
#: Letters whose case and composition are settled alike in every Unicode version.
_PLAIN = re.compile(r"[!-~¡-ɏ]+")
#: ASCII characters that are neither letters nor digits nor white space.
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def splits_at_white_space(path: str) -> bool:
    """Whether chunks between ASCII white space are independent under this tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    special = any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
    lone = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens", []))
    return (
        not special
        and lone
        and spec.get("post_processor") is None
        and [{k: v for k, v in n.items() if k != "content"} for n in (spec.get("normalizer") or {}).get("normalizers", [])] == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}}, {"type": "Lowercase"}]
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and first.get("pattern") == {"Regex": SPLIT_PATTERN}
    )


class _Chunks(dict):
    """chunk (bytes) -> its ids as little-endian unsigned integers of ``width`` bytes.

    ``limit`` bounds the memory of a worker, not the result: beyond it, chunks are encoded
    again each time they occur. Letters and the symbols behind them are pieces of their own,
    so a chunk that isn't known is mostly put together from a known word and known symbols.
    """

    def __init__(self, tokenizer, limit: int, width: int):
        super().__init__()
        self.tokenizer, self.limit, self.width = tokenizer, limit, width
        self.model = tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _bytes(self, ids) -> bytes:
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def _encode(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        """Ids of one piece of lower-case ASCII letters, straight from the model."""
        ids = self.words.get(word)
        if ids is None:
            ids = self._bytes([t.id for t in self.model.tokenize(word.decode())])
            if len(self.words) < self.limit and len(word) < 64:
                self.words[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self._word(piece.encode())
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._encode(piece)
            if len(self.pieces) < self.limit and len(piece) < 64:
                self.pieces[piece] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        head = chunk.rstrip(_SYMBOLS)
        if head.isalpha():
            out = self._word(head.lower())
        else:
            text = head.decode("utf-8", "replace")
            low = text.lower()
            if text.isalpha() and low.isalpha() and _PLAIN.fullmatch(text):
                out = self._piece(low)
            else:
                head, text = chunk, chunk.decode("utf-8", "replace")
                out = b"".join(map(self._piece, _PIECES.findall(text.lower()))) if _PLAIN.fullmatch(text) and "<|" not in text else self._encode(text)
        if len(head) < len(chunk):
            out += self._piece(chunk[len(head) :].decode())
        if len(self) < self.limit and len(chunk) < 64:
            self[chunk] = out
        return out


class TokenCodec:
    """``encode(text)``: ids of a UTF-8 text as little-endian unsigned integers of ``width``
    bytes (4, or 2 if the vocabulary fits)."""

    def __init__(self, path: str, limit: int = 500_000, width: int = 4):
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_file(path), width
        self.chunks = _Chunks(self.tokenizer, limit, width) if splits_at_white_space(path) else None

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if self.chunks is not None:
            return b"".join(map(self.chunks.__getitem__, text.split()))
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return b"".join([i.to_bytes(self.width, "little") for i in ids])


_CODECS: dict[tuple[str, int], TokenCodec] = {}


def codec(path: str, width: int = 4) -> TokenCodec:
    """The codec of this Python worker; later tasks of the worker use its memo again."""
    if (path, width) not in _CODECS:
        _CODECS[path, width] = TokenCodec(path, width=width)
    return _CODECS[path, width]
