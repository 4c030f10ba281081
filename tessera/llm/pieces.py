"""Exact token ids of whole texts, unit by unit, with the tokenizers library and a bounded cache.

A tokenizer first cuts a text into pieces and then merges within each piece alone, so ids of a text are
the ids of its pieces in order. No piece goes on from other characters into white space, so a text may be
cut before any white space (word level, which drops white space: around it) without a change. What
lies between is a unit, mostly a word with its marks. Prose repeats its units; each distinct one
is merged by the library's model once and kept as packed ids.

The two known pipelines are recognised by the whole of their description; texts of any other, and
at word level those with characters from U+0250 on, where a normalizer may join what stands apart, go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Code points below this are cut by our own pattern; no Unicode version differs in their kinds.
PLAIN = 0x250
#: Units and pieces of more characters are not kept.
LONG_PIECE = 64
#: Units and pieces kept by each cache of a worker; beyond, it starts anew.
CACHE_UNITS = 300_000
#: Marks that are a piece of their own after a word.
_MARKS = frozenset(".,;:!?)\"")
#: White space as the library's patterns have it.
SPACE = r"\x09-\x0d\x20\x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B))))

#: Pre-tokenizers and normalizers of the two known kinds, fixed values.
_BYTE_PIPELINE = (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
_WORD_PIPELINE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
        ],
    },
)


def _char_class(test) -> str:
    """The code points below PLAIN that pass, as ranges of a regular expression's class."""
    out, start = [], None
    for c in range(PLAIN + 1):
        ok = c < PLAIN and test(c)
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


_L = _char_class(lambda c: unicodedata.category(chr(c))[0] == "L")
_N = _char_class(lambda c: unicodedata.category(chr(c))[0] == "N")
_NOT_PLAIN = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
#: Python's split takes these for white space, the patterns don't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BYTE_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{SPACE}{_L}{_N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_UNIT = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_WORD_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{SPACE}{_L}{_N}]+")
_WORD_UNIT = re.compile(rf"[^{SPACE}]+")
#: A space after white space and before more of it, or at the end: a cut before it would part one piece.
_RUN = re.compile(rf"[{SPACE}] (?=[{SPACE}]|\Z)")
#: The same as characters.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _bare(x):
    """A description without what only concerns offsets."""
    if isinstance(x, dict):
        return {k: _bare(v) for k, v in x.items() if k != "trim_offsets"}
    return [_bare(v) for v in x] if isinstance(x, list) else x


def kind_of(tok) -> str | None:
    """byte, word, or None for a tokenizer whose texts only the library may cut."""
    made = json.loads(tok.to_str())
    if made["post_processor"] or made["model"]["type"] != "BPE" or made["model"].get("dropout"):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in made["added_tokens"]):
        return None
    pipeline = _bare(made["normalizer"]), _bare(made["pre_tokenizer"])
    return next((k for k, p in (("byte", _BYTE_PIPELINE), ("word", _WORD_PIPELINE)) if pipeline == p), None)


class _Known(dict):
    """A bounded cache that makes what it lacks."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONG_PIECE:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[key] = value
        return value


class PieceCodec:
    """ids(text) are those of Tokenizer.encode(text, add_special_tokens=False), without truncation and padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = kind_of(self.tok)
        self.tokenize = self.tok.model.tokenize
        self.shown = byte_alphabet()
        #: Packed ids of pieces, of word-level units, and of byte-level units after a space.
        self.pieces_known = _Known(self.piece)
        self.units_known = _Known(self._word_unit)
        self.spaced_known = _Known(self._spaced_unit)
        self.added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def forget(self) -> None:
        """Empties the caches: at the end of a task, so that a worker's memory is free for what it does next."""
        for known in (self.pieces_known, self.units_known, self.spaced_known):
            known.clear()

    def library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a text that is one piece: the model alone."""
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def pieces(self, unit: str) -> list[str]:
        """A byte-level text's pieces."""
        if not unit.isascii() and _NOT_PLAIN.search(unit):
            return [unit[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(unit)]
        return _BYTE_PIECE.findall(unit)

    def _word_unit(self, unit: str) -> bytes:
        if unit.isalpha():
            return self.piece(unit)
        if unit[:-1].isalpha():
            return self.units_known[unit[:-1]] + self.pieces_known[unit[-1]]
        return b"".join(map(self.pieces_known.__getitem__, _WORD_PIECE.findall(unit)))

    def _spaced_unit(self, unit: str) -> bytes:
        if unit.isalpha() or not unit:
            return self.piece(" " + unit)
        if unit[:-1].isalpha() and unit[-1] in _MARKS:
            return self.spaced_known[unit[:-1]] + self.pieces_known[unit[-1]]
        return self.unit(" " + unit)

    def unit(self, unit: str) -> bytes:
        """Ids of a byte-level unit, of its own."""
        return b"".join(map(self.pieces_known.__getitem__, self.pieces(unit)))

    def _word_level(self, text: str) -> bytes:
        if not text.isascii() and _NOT_PLAIN.search(text):
            return self.library(text)
        text = text.lower()
        units = _WORD_UNIT.findall(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.units_known.__getitem__, units))

    def _byte_level(self, text: str) -> bytes:
        """Units that begin with one space are kept without it; others are taken anew each time they occur."""
        if not _RUN.search(text):
            first, *rest = text.split(" ")
            return self.unit(first) + b"".join(map(self.spaced_known.__getitem__, rest))
        return b"".join([self.spaced_known[u[1:]] if u[0] == " " and len(u) > 1 and u[1] not in SPACES else self.unit(u) for u in _UNIT.findall(text)])

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        if self.kind is None:
            return self.library(text)
        return self._byte_level(text) if self.kind == "byte" else self._word_level(text)

    def parts(self, text: str) -> list[str]:
        """The text around its added tokens; these stand at odd places."""
        if self.split_added is None or not any(t in text for t in self.added):
            return [text]
        return self.split_added.split(text)

    def packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.kind is None:
            return self.library(text)
        parts = self.parts(text)
        if len(parts) == 1:
            return self.plain(text)
        return b"".join(array("I", [self.added[x]]).tobytes() if k % 2 else self.plain(x) for k, x in enumerate(parts))

    def ids(self, text: str | None) -> list[int]:
        return array("I", self.packed(text)).tolist()


_CODECS: dict[tuple, PieceCodec] = {}


def codec(path: str, kind: type[PieceCodec] = PieceCodec) -> PieceCodec:
    """One for each worker."""
    if (kind, path) not in _CODECS:
        _CODECS[kind, path] = kind(path)
    return _CODECS[kind, path]
