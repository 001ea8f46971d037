"""Operator 2: BPE encoding and decoding by a prefix-sharing trie.

Distinct words go into a trie. A depth-first walk gives each node the last token of its prefix's
encoding; the encoding of the rest is that of an ancestor, so shared prefixes are worked out once.
The last token is the one suffix of the prefix that merges leave apart from the ancestor's last token.
The words are those of a batch that no earlier batch had; a part of a word that no other word shares
is no chain of nodes but stays a piece of that word. Time and memory are linear in a word's length.
"""
from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STORES, bounded_batches, slices, tokenizer_path, trimmed
from .tokens import RunCoder, drops_white_space, has_words_and_marks, ranges


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    own = set(shown)
    return [chr(b) if b in own else chr(next(hidden)) for b in range(256)]


@lru_cache
def category_ranges(kind: str) -> str:
    """The ranges of characters of a general category (its first letter), as the inside of a class in brackets."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges(lambda c: unicodedata.category(c)[0] == kind))


class TrieBpe:
    """Encodes and decodes with a BPE file whose words are cut at white space."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if not drops_white_space(spec) or model["type"] != "BPE" or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: not a BPE file whose words are cut at white space")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.text: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.longest = max(len(t) for t in self.vocab)
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.merge = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.text |= {i: t for t, i in self.added.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pre = spec["pre_tokenizer"]
        split = pre.get("pretokenizers", [pre])[0]["pattern"]["Regex"]
        for kind in "LN":  # as Python's Unicode tables have them; the regex module's differ where nothing is assigned
            split = split.replace(rf"\p{{{kind}}}", category_ranges(kind))
        self.pattern = regex.compile(split)
        norm = spec.get("normalizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [norm] if norm else [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.shown = dict(enumerate(byte_chars()))
        self.lib = Tokenizer.from_file(path)
        self.apart: dict[int, bool] = {}
        STORES.append(self.apart)
        self.symbols: dict[int, tuple[int, ...]] = {}
        self.runs = RunCoder(self.learn, 1, has_words_and_marks(spec))
        if spec.get("decoder"):
            raise ValueError(f"{path}: decoders are not known here")
        # By id the token and a space: without a decoder, tokens are joined by spaces. Ids without a token give nothing.
        self.spaced = pa.array([self.text[i] + " " if i in self.text else "" for i in range(max(self.text) + 1)], pa.large_string())

    # Merging as the vocabulary defines it: used on the few symbols of one or two tokens only.
    def _units(self, token: int) -> tuple[int, ...]:
        if token not in self.symbols:
            t = self.text[token]
            body = t.removesuffix(self.end) if self.end else t
            last = body[-1] + (self.end if body != t else "")
            self.symbols[token] = (*(self.vocab[c] for c in body[:-1]), self.vocab[last])
        return self.symbols[token]

    def _merged(self, units: tuple[int, ...]) -> list[int]:
        have = list(units)
        while len(have) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(have, have[1:])) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            have[i : i + 2] = [self.merge[have[i], have[i + 1]][1]]
        return have

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, given in the vocabulary's characters, by one walk over their trie."""
        # A node's edges lead to nodes or, where one word alone goes on, to (that word, the place after the edge). The
        # edge that ends a word bears the end mark and is a symbol of its own: words end under "".
        root: dict = {}
        for w in words:
            node, stop = root, len(w) - 1
            for at in range(stop):
                nxt = node.get(w[at])
                if nxt is None:
                    node[w[at]] = (w, at + 1)
                    break
                if type(nxt) is tuple:  # a second word: the first one's next edge becomes a node's
                    other, place = nxt
                    nxt = node[w[at]] = {other[place]: (other, place + 1)} if place < len(other) - 1 else {"": [other]}
                node = nxt
            else:
                node.setdefault("", []).append(w)
        out: dict[str, list[int]] = {}
        lasts: list[int] = []  # by depth: the last token of the prefix's encoding, and its number of symbols
        sizes: list[int] = []
        last, end, most = self._last, self.end, self.longest

        def ended(w: str) -> None:
            n = len(w)
            token, size = last(w[-most:] + end, min(n, most), n, lasts, sizes)
            ids, at = [token], n - size
            while at:
                ids.append(lasts[at - 1])
                at -= sizes[at - 1]
            ids.reverse()
            out[w] = ids

        if len(self.apart) > 500_000:
            self.apart.clear()
        # (the prefix's last `most` characters, what follows, depth)
        stack: list[tuple[str, dict | tuple, int]] = [("", root, 0)]
        while stack:
            tail, node, depth = stack.pop()
            if depth:
                del lasts[depth - 1 :], sizes[depth - 1 :]
                token, size = last(tail, len(tail), depth, lasts, sizes)
                lasts.append(token)
                sizes.append(size)
            if type(node) is tuple:
                w, at = node
                for n in range(at + 1, len(w)):
                    token, size = last(w[max(0, n - most) : n], min(n, most), n, lasts, sizes)
                    lasts.append(token)
                    sizes.append(size)
                ended(w)
                continue
            for edge, child in node.items():
                if edge:
                    stack.append(((tail + edge)[-most:], child, depth + 1))
                    continue
                for w in child:
                    ended(w)
        return out

    def _last(self, text: str, held: int, n: int, lasts: list[int], sizes: list[int]) -> tuple[int, int]:
        """The last token of a prefix of n symbols and its size; text: its last `held` symbols. One suffix only stays
        apart from what stands before it, so the order of trying doesn't matter; mostly it is the last symbol alone or
        with the token before it."""
        vocab, apart = self.vocab.get, self.apart
        likely = min(sizes[n - 2] + 1 if n > 1 else 1, held)
        for size in (likely, *range(1, likely), *range(likely + 1, held + 1)):
            token = vocab(text[held - size :])
            if token is not None:
                key = (lasts[n - size - 1] + 1) << 20 | token if size < n else token
                fits = apart.get(key)
                if fits is None:
                    units = self._units(token)
                    if size == n:
                        fits = self._merged(units) == [token]
                    else:
                        before = lasts[n - size - 1]
                        fits = self._merged(self._units(before) + units) == [before, token]
                    apart[key] = fits
                if fits:
                    return token, size
        raise ValueError(f"the vocabulary has no token for {text!r}")

    def _pieces(self, chunk: str) -> list[str | int]:
        """A chunk's words in the vocabulary's characters; ids stand for special tokens."""
        parts = self.specials.split(chunk) if self.specials else [chunk]
        out: list[str | int] = []
        for p in parts:
            if p in self.added:
                out.append(self.added[p])
            elif p and not p.isascii() and any(unicodedata.category(c) == "Cn" for c in p):
                # Characters newer than Python's Unicode tables: the library's own steps cut them.
                out += [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(p) if self.lib.normalizer else p)]
            elif p:
                p = unicodedata.normalize("NFC", p) if self.nfc and not p.isascii() else p
                if self.lower:  # character by character: no final sigma
                    p = p.lower() if p.isascii() else "".join(map(str.lower, p))
                out += ["".join(map(self.shown.__getitem__, w.encode())) for w in self.pattern.findall(p)]
        return out

    def learn(self, words: list[str], pieces: list[int]) -> list[tuple[bytes]]:
        """Of each distinct word its ids as little-endian 32-bit integers."""
        cut = [[x] if n == 1 and x.isascii() and x.isalpha() and x.islower() else self._pieces(x) for x, n in zip(words, pieces, strict=True)]
        ids = self.encode_words({w for p in cut for w in p if isinstance(w, str)})
        out = []
        for pieces in cut:
            own = array("I", ids[pieces[0]] if len(pieces) == 1 and isinstance(pieces[0], str) else [i for w in pieces for i in ((w,) if isinstance(w, int) else ids[w])])
            if sys.byteorder == "big":
                own.byteswap()
            out.append((own.tobytes(),))
        return out

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each value of little-endian 32-bit ids: tokens joined by a space, special tokens included."""
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 4
        flat = np.frombuffer(data, "<u4")[at[0] : at[-1]] if data else np.empty(0, "<u4")
        tokens = self.spaced.take(pa.array(flat))
        _, ends, chars = tokens.buffers()
        ends = np.frombuffer(ends, np.int64)[at - at[0]] if len(flat) else np.zeros(len(at), np.int64)
        starts, to = ends[:-1], np.maximum(ends[1:] - 1, ends[:-1])  # without the last space
        raw = memoryview(chars) if chars else b""
        return pa.array([bytes(raw[i:j]) for i, j in zip(starts.tolist(), to.tolist(), strict=True)], pa.binary()).cast(pa.string())

    def codec(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of each whole text: its ids and the text decoded from them."""
        ids = self.runs.code(texts)[0]
        return ids, self.decode(ids)


_CODECS: dict[str, TrieBpe] = {}


def codec(path: str) -> TrieBpe:
    if path not in _CODECS:
        _CODECS[path] = TrieBpe(path)
    return _CODECS[path]


def bpe_encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes every whole text and decodes the ids again: (id, n_tokens, ids, decoded), one row for each input row.

    ids holds little-endian unsigned 32-bit integers. A null or empty text has no tokens and decodes to "".
    Null ids, ties and repeated rows are kept as they are; other columns are not read. No shuffle: a map over
    the scan, whose memory is a batch of texts and a bounded store of known words.
    """
    path = path or tokenizer_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for b in slices(batch, 16 << 20):
                ids, text = own.codec(b.column(1))
                n = pc.divide(pc.binary_length(ids).cast(pa.int64()), 4)
                yield pa.RecordBatch.from_arrays([b.column(0), n, ids, text], names=["id", "n_tokens", "ids", "decoded"])

    out = bounded_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda x: trimmed(run(x), keep=True), f"id {kind}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
