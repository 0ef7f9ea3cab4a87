"""Token ids of whole texts.

A vocabulary file whose ids follow the order of its merges (byte-level BPE) is encoded by
``tiktoken`` with the file's tokens as ranks: the ids are those of ``tokenizers`` (tests
hold them against each other) at about a fifth of the CPU time.  Any other file is encoded
by ``tokenizers`` itself.  The file's added tokens, special ones too, are found in the text
as the library finds them: where their string stands there is their id, and what lies
between them is encoded by itself.
"""

from __future__ import annotations

import array
import json
import re

import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pattern by which the byte-level pre-tokenizer splits text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: the white space of ``SPLIT``, in runs longer than the pattern's look-ahead should walk.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def added_tokens(spec: dict) -> dict[str, int] | None:
    """The added tokens' ids by string, or None if one takes more of the text than its string."""
    added = spec.get("added_tokens") or []
    if any(a.get(flag) for a in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    return {a["content"]: a["id"] for a in added if a["content"]}


def as_ranks(spec: dict) -> dict[bytes, int] | None:
    """The file's tokens as byte strings by id, or None if its ids don't follow its merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer"):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocab[m] for m in merged]
    if ids != list(range(256, 256 + len(ids))) or any(vocab[c] > 255 for c in letters):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if i < 256 + len(ids)}


class TextEncoder:
    _shared: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = added_tokens(spec)
        ranks = as_ranks(spec) if self.added is not None else None
        # of several that begin at a place the longest counts
        self.marks = ranks and self.added and re.compile("|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)))
        self.bpe = ranks and tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.space = ranks and tiktoken.Encoding("white-space", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})
        if not self.bpe:
            self.tokenizer = Tokenizer.from_file(path)

    @classmethod
    def shared(cls, path: str) -> TextEncoder:
        """One encoder per worker process and file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, text: str) -> bytes:
        """Its ids as little-endian unsigned 32-bit numbers; none are put round them."""
        if not self.bpe:
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not self.marks:
            return self._plain(text)
        parts, at = [], 0
        for mark in self.marks.finditer(text):
            parts += [self._plain(text[at : mark.start()]), self.added[mark[0]].to_bytes(4, "little")]
            at = mark.end()
        return b"".join([*parts, self._plain(text[at:])]) if parts else self._plain(text)

    def _plain(self, text: str) -> bytes:
        parts, at = [], 0
        for run in LONG_SPACE.finditer(text):
            # the pattern takes a run as one piece, but for its last character if text follows
            past = run.end() - (run.end() < len(text))
            parts += [self._ids(self.bpe, text[at : run.start()]), self._ids(self.space, text[run.start() : past])]
            at = past
        return b"".join([*parts, self._ids(self.bpe, text[at:])])

    @staticmethod
    def _ids(bpe: tiktoken.Encoding, text: str) -> bytes:
        return bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
