"""Token ids of whole texts, with each distinct word sent to the tokenizer once per Python worker.

A tokenizer that drops white space and never joins across it, as its file says, gives a text the
ids of its white-space separated pieces in order. Pieces are looked up in a bounded table; words
of Latin-1 letters go to the tokenizer's model directly, since its rules leave them as they are.
Texts with characters on which Python and the tokenizer could disagree are encoded whole, and so
are all texts with a tokenizer of other rules.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Sequence
from itertools import chain

import numpy as np

#: Pieces held by one worker; beyond it those seen once are forgotten.
MAX_PIECES = 200_000
#: Separators of Python's split() that the tokenizer doesn't call white space, and the start of its special tokens.
UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: ASCII signs. A run of them at the end of Latin-1 letters is a tokenizer word of its own.
SIGNS = string.punctuation
#: The rules that make pieces independent of each other, as the tokenizer's file states them (fixed values).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
END = "\n"

_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level model: itself if it is printable, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer of this file has the rules above."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    normalizer, before, model = (rules[x] or {} for x in ("normalizer", "pre_tokenizer", "model"))
    words = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
    special = all(x["special"] and x["content"].startswith("<|") for x in rules["added_tokens"])
    return words and special and normalizer.get("normalizers") == NORMALIZERS and before.get("pretokenizers") == PRE_TOKENIZERS


def encoder(path: str, end_id: int) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = PieceEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def is_latin(text: str) -> bool:
    """Latin-1 only. Beyond it, lower case may depend on who makes it."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class PieceEncoder:
    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.by_piece = Tokenizer.from_file(path), end_id, splits_at_space(path)
        self.model = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.hits = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.filled = 0
        self._add([END], np.array([1]), np.array([self.end_id], np.uint32))

    def _add(self, pieces: Sequence[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        """New pieces with their ids one after the other in ``flat``."""
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + len(flat)] = flat
        self._point(pieces, self.filled + np.cumsum(sizes) - sizes, sizes)
        self.filled += len(flat)

    def _point(self, pieces: Sequence[str], starts: np.ndarray, sizes: np.ndarray) -> None:
        """New pieces whose ids are held already."""
        first, last = len(self.slot), len(self.slot) + len(pieces)
        while last > len(self.start):
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits))
        self.start[first:last], self.size[first:last], self.hits[first:last] = starts, sizes, 0
        self.slot.update(zip(pieces, range(first, last), strict=True))

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        """Ids of the slots, one after the other."""
        sizes = self.size[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[slots] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _encode_new(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 10_000):
            part = pieces[i : i + 10_000]
            coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            self._add(part, np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part)), np.array(coded.ids, np.uint32))

    def _encode_letters(self, words: list[str]) -> None:
        """Words of lower-case Latin-1 letters only, by the model alone."""
        tokenize, sizes, flat = self.model.tokenize, [], []
        for word in words:
            found = tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS))
            sizes.append(len(found))
            flat.extend([token.id for token in found])
        self._add(words, np.array(sizes, np.int64), np.array(flat, np.uint32))

    def _learn(self, pieces: set[str]) -> None:
        # Parallel lists: many small tuples would keep the garbage collector busy.
        bare, bare_core, ended, ended_core, ended_signs = [], [], [], [], []
        letters, others = set(), set()
        for piece in pieces:
            core = piece.rstrip(SIGNS)
            if not (core.isalpha() and is_latin(core)):
                others.add(piece)
                continue
            signs, core = piece[len(core) :], core.lower()
            letters.add(core)
            if signs:
                others.add(signs)
                ended.append(piece)
                ended_core.append(core)
                ended_signs.append(signs)
            elif core != piece:
                bare.append(piece)
                bare_core.append(core)
        known = self.slot
        self._encode_letters([x for x in letters if x not in known])
        self._encode_new([x for x in others if x not in known])
        cores = np.fromiter(map(known.__getitem__, bare_core), np.int64, len(bare))
        self._point(bare, self.start[cores], self.size[cores])
        pairs = np.stack([np.fromiter(map(known.__getitem__, x), np.int64, len(ended)) for x in (ended_core, ended_signs)], axis=1)
        self._add(ended, self.size[pairs].sum(axis=1).astype(np.int64), self._gather(pairs.ravel()))

    def _shrink(self) -> None:
        """Keep what was seen more than once since the last time."""
        kept = [(piece, at) for piece, at in self.slot.items() if self.hits[at] > 1 and piece != END]
        slots = np.array([at for _, at in kept], np.int64)
        sizes, flat = self.size[slots].astype(np.int64), self._gather(slots)
        self._clear()
        if len(kept) < MAX_PIECES // 2:
            self._add([piece for piece, _ in kept], sizes, flat)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text, followed by the end id."""
        if not self.by_piece:
            return [np.array([*x.ids, self.end_id], np.uint32) for x in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)]
        if len(self.slot) > MAX_PIECES:
            self._shrink()
        unsure = [any(x in t for x in UNSURE) for t in texts]
        # The tokenizer sees lower case only, so that Latin-1 texts need no pieces with capitals.
        pieces = [[END] if odd else (t.lower() if is_latin(t) else t).split() + [END] for t, odd in zip(texts, unsure, strict=True)]
        flat = list(chain.from_iterable(pieces))
        if missing := set(flat).difference(self.slot):
            self._learn(missing)
        slots = np.fromiter(map(self.slot.__getitem__, flat), np.int64, len(flat))
        self.hits[slots] += 1  # once for each call that has the piece
        ends, ids = np.cumsum(self.size[slots], dtype=np.int64), self._gather(slots)
        bounds = ends[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) - 1] if pieces else []
        found = np.split(ids, bounds[:-1]) if len(bounds) else []
        for i in np.flatnonzero(unsure):
            found[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.end_id], np.uint32)
        return found
