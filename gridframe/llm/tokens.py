"""Public tokenizers in Python workers: fast encoders and the bytes of their tokens.

A byte-level BPE file is run by ``tiktoken`` on the ranks that the file's own
vocabulary gives: its merges are listed in the order of their ids, which is
checked, so both libraries make the same ids.
"""

from __future__ import annotations

import json

import numpy as np

#: the pre-tokenising pattern of the byte-level vocabulary (fixed value)
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves and the others, in order, for the characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE file: ``encode`` and ``token_bytes`` (by id)."""

    def __init__(self, path: str | None, added_tokens: bool):
        """``added_tokens``: their strings in a text get their own ids, else they are plain text."""
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        vocabulary = {t: i for t, i in file["model"]["vocab"].items() if t not in added}
        merged = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        ids = [vocabulary["".join(m)] for m in merged]
        if ids != sorted(ids) or len(ids) + 256 != len(vocabulary):
            raise ValueError("the merges of the vocabulary do not follow its ids")
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        self.size = max([*ranks.values(), *added.values()]) + 1
        self.token_bytes = [b""] * self.size
        for raw, i in ranks.items():
            self.token_bytes[i] = raw
        for content, i in added.items():
            self.token_bytes[i] = content.encode()
        self.specials = set(added) if added_tokens else set()
        self.core = tiktoken.Encoding("byte-bpe", pat_str=PIECE_PATTERN, mergeable_ranks=ranks,
                                      special_tokens=added if added_tokens else {})

    def encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special=self.specials, disallowed_special=())


class PieceModel:
    """A sentencepiece model: ``encode`` of several texts and ``token_bytes`` (by id)."""

    def __init__(self, path: str | None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.size = self.model.get_piece_size()
        self.token_bytes = [
            bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


_LOADED: dict[tuple, ByteBpe | PieceModel] = {}


def byte_bpe(path: str | None = None, added_tokens: bool = False) -> ByteBpe:
    """The encoder of this worker, loaded once for all its tasks."""
    key = ("byte", path, added_tokens)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(path, added_tokens)
    return _LOADED[key]


def piece_model(path: str | None = None) -> PieceModel:
    key = ("piece", path)
    if key not in _LOADED:
        _LOADED[key] = PieceModel(path)
    return _LOADED[key]
