"""Ids of whole texts by a public tokenizer, for operators that write or pack ids."""
from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import STORES, no_collector

#: White space of the tokenizer files' regular expressions: Unicode's White_Space. Python and Arrow
#: also split at \x1c-\x1f, which are no white space there.
_WHITE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = re.compile(f"[{_WHITE_CHARS}]+")


def split_runs(texts: pa.Array) -> pa.Array:
    """Each text's runs without white space, as a list array; null texts have none."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():
        return pa.array([[x for x in _WHITE.split(t) if x] for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer file encodes each run without white space on its own.

    True if the normalizers are NFC, lower case and replacing white space, and the first
    pre-tokenizer keeps only matches of a pattern that takes in no white space.
    """
    import regex

    norm = spec.get("normalizer") or {}
    for x in norm.get("normalizers", [norm] if norm else []):
        if x["type"] not in ("NFC", "Lowercase") and not (
            x["type"] == "Replace" and x["pattern"].get("Regex") in (r"\s", r"\s+") and x["content"] == " "
        ):
            return False
    pre = spec.get("pre_tokenizer") or {}
    first, *rest = pre.get("pretokenizers", [pre])
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    if any(x["type"] != "ByteLevel" or x.get("add_prefix_space") or x.get("use_regex") for x in rest):
        return False
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
        return False
    pattern = regex.compile(first["pattern"]["Regex"])
    return not any(c in m.group() for c in _WHITE_CHARS for m in pattern.finditer(f"a{c}b{c}{c}1{c}!{c}"))


#: Fixed value: a pattern under which letters followed by other marks are two words on their own.
_LETTERS_THEN_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
def ranges(fits: Callable[[str], bool]) -> list[tuple[int, int]]:
    """The ranges of the characters that fit."""
    out, start = [], None
    for c in range(0x110001):
        own = c < 0x110000 and not 0xD800 <= c < 0xE000 and fits(chr(c))
        if own and start is None:
            start = c
        elif not own and start is not None:
            out.append((start, c - 1))
            start = None
    return out


@lru_cache
def _parts() -> str:
    """A pattern for letters and ASCII marks behind them; an apostrophe may belong to letters and is none of these marks.

    The letters are those that stay as they are in the composed form (jamo, which compose, are left out) and whose
    lower case is one letter; so a word of them is one piece, and its case doesn't matter. (Arrow's own utf8_normalize
    gives the decomposed form for "NFC" and is of no use here.)
    """
    own = ranges(lambda c: unicodedata.category(c)[0] == "L" and not "\u1100" <= c <= "\u11ff" and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c)
    letters = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in own)
    return rf"^(?P<word>[{letters}]+)(?P<marks>[!-&(-/:-@\[-`{{-~]*)$"


def has_words_and_marks(spec: dict) -> bool:
    """Whether a word of letters and the marks behind it are encoded on their own, whatever the letters' case."""
    pre = spec.get("pre_tokenizer") or {}
    return drops_white_space(spec) and pre.get("pretokenizers", [pre])[0]["pattern"]["Regex"] == _LETTERS_THEN_MARKS and "Lowercase" in str(spec["normalizer"])


def words_and_marks(runs: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(word, marks, pieces) of distinct runs: a lower-cased word of letters alone and the marks behind it, or the run as
    it is and no marks; pieces: into how many the pattern cuts the word, 0 where that isn't certain (beyond ASCII)."""
    parts = pc.extract_regex(runs, _parts())
    fits = pc.is_valid(parts)
    low, marks = pc.utf8_lower(parts.field("word")), parts.field("marks")
    # In ASCII no normal form changes the count; special tokens hold "<|".
    sure = pc.and_(pc.string_is_ascii(runs), pc.invert(pc.match_substring(runs, "<|")))
    counted = pc.count_substring_regex(pc.ascii_lower(pc.if_else(pc.and_(sure, pc.invert(fits)), runs, "")), _LETTERS_THEN_MARKS)
    return pc.if_else(fits, low, runs), pc.if_else(fits, marks, ""), pc.if_else(fits, pa.scalar(1, pa.int32()), counted)


class RunCoder:
    """Maps whole texts to bytes, run by run; each distinct run of a batch is looked at once, in Arrow's kernels.

    learn(words, pieces) gives one or more byte strings for each new word; pieces: the number of each, 0 for unknown. Up to `keep` words of at most 64
    characters are kept between batches; then the store is emptied, so memory is bounded.
    """

    def __init__(self, learn: Callable[[list[str], list[int]], list[tuple[bytes, ...]]], outputs: int, parted: bool, keep: int = 600_000):
        self.learn, self.outputs, self.parted, self.keep = learn, outputs, parted, keep
        self.known: dict[str, tuple[bytes, ...]] = {}
        STORES.append(self.known)

    def _of(self, words: pa.Array, pieces: pa.Array | None) -> list[pa.Array]:
        """The outputs of each word, by its distinct values."""
        d = words.dictionary_encode()
        keys = d.dictionary.to_pylist()
        known = self.known
        have = list(map(known.get, keys))
        new = [i for i, x in enumerate(have) if x is None]
        if new:
            n = np.zeros(len(keys), dtype=np.int64)
            if pieces is not None:
                n[d.indices.to_numpy()] = pieces.to_numpy(zero_copy_only=False)
            for i, x in zip(new, self.learn([keys[i] for i in new], n[new].tolist()), strict=True):
                have[i] = x
                if len(keys[i]) <= 64:
                    known[keys[i]] = x
        return [pa.array([x[k] for x in have], pa.binary()).take(d.indices) for k in range(self.outputs)]

    def code(self, texts: pa.Array) -> list[pa.Array]:
        """For each output a binary array: each text's bytes, run after run."""
        if len(self.known) > self.keep:
            self.known.clear()
        with no_collector():
            lists = split_runs(texts)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            d = lists.flatten().dictionary_encode()
            if self.parted:
                words, marks, pieces = words_and_marks(d.dictionary)
                outs = [pc.binary_join_element_wise(a, b, b"") for a, b in zip(self._of(words, pieces), self._of(marks, None), strict=True)]
            else:
                outs = self._of(d.dictionary, None)
            got = []
            for x in outs:
                flat = x.take(d.indices)
                _, offsets, data = flat.buffers()
                at = np.frombuffer(offsets, np.int32)[ends].astype(np.int32) if len(flat) else np.zeros(len(ends), np.int32)
                got.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), data or pa.py_buffer(b"")]))
            return got


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, in little-endian integers of `width` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        end = spec["model"].get("end_of_word_suffix")
        self.ends = np.array([bool(end) and t.endswith(end) for t, _ in sorted(self.tok.get_vocab().items(), key=lambda x: x[1])])
        self.runs = RunCoder(self._learn, 1, has_words_and_marks(spec)) if drops_white_space(spec) else None

    def _each(self, texts: list[str]) -> list[tuple[bytes]]:
        return [(np.array(x.ids, dtype=self.dtype).tobytes(),) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], pieces: list[int]) -> list[tuple[bytes]]:
        """Words of a known number of pieces are encoded in one text a thousand: a piece gives one token that ends it."""
        out: list[tuple[bytes] | None] = [None] * len(words)
        some = [i for i, n in enumerate(pieces) if n] if self.ends.any() else []
        groups = [some[i : i + 1000] for i in range(0, len(some), 1000)]
        texts = [" ".join([words[i] for i in g]) for g in groups]
        for group, got in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(array("I", got.ids), dtype=self.dtype)
            last = np.flatnonzero(self.ends[ids])
            each = np.cumsum([pieces[i] for i in group])
            if len(last) == each[-1] and last[-1] == len(ids) - 1:
                raw, at = ids.tobytes(), 0
                for i, to in zip(group, ((last[each - 1] + 1) * self.width).tolist(), strict=True):
                    out[i] = (raw[at:to],)
                    at = to
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, self._each([words[i] for i in left]), strict=True):
            out[i] = x
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        """A binary array of each text's ids; a null text has none."""
        if self.runs:
            return self.runs.code(texts)[0]
        return pa.array([x for (x,) in self._each(["" if t is None else t for t in texts.to_pylist()])], pa.binary())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def word_end_punctuation(path: str, marks: str = ".!?") -> np.ndarray:
    """By id: whether the token ends a sentence (its visible characters end with one of marks)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    table = np.zeros(tok.get_vocab_size(), dtype=bool)
    for token, i in tok.get_vocab().items():
        table[i] = token.removesuffix("</w>")[-1:] in set(marks)
    return table
