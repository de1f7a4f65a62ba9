"""Byte-level BPE vocabularies, read from the public tokenizer files. The path is a parameter; nothing is trained."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


@dataclass
class Vocabulary:
    """token_bytes by id, merge rank and result by pair of ids, and special strings by id."""

    token_bytes: list[bytes]
    ids: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]
    single: list[int] = field(default_factory=list)

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        data = json.loads(content)
        model, letters = data["model"], byte_letters()
        raw = {piece: bytes(letters[c] for c in piece) for piece in model["vocab"]}
        specials = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *specials.values()]) + 1
        token_bytes = [b""] * size
        for piece, i in model["vocab"].items():
            token_bytes[i] = raw[piece]
        for piece, i in specials.items():
            token_bytes[i] = piece.encode()
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merges[(model["vocab"][left], model["vocab"][right])] = (rank, model["vocab"][left + right])
        ids = {raw[piece]: i for piece, i in model["vocab"].items()}
        return cls(token_bytes, ids, merges, specials, [ids[bytes([b])] for b in range(256)])

    def split_specials(self, text: str) -> list[str | int]:
        """Text parts and ids of special strings, leftmost first and the longest at a place, as the library finds them."""
        import re

        if not self.specials or not any(s in text for s in self.specials):
            return [text]
        pattern = "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        out: list[str | int] = []
        at = 0
        for m in re.finditer(pattern, text):
            out += [text[at : m.start()], self.specials[m.group()]]
            at = m.end()
        return [*out, text[at:]]


_parsed: dict[str, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """Parsed once in each Python process."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _parsed:
        _parsed[key] = Vocabulary.parse(content)
    return _parsed[key]
