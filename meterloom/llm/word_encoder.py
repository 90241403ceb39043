"""Encodes texts with a word-level BPE file of the tokenizers library.

The library spends most of its time on normalising and splitting. White space
ends a word there and is dropped, so the ids of a text are the ids of its
white-space separated chunks, one after the other. A mark at a word's end is a
piece of its own, so a word and its mark are looked up apart. Each worker keeps
the ids of what it has seen lately in a bounded cache; only new ones go to the
library. Workers live on and serve later stages, and Spark asks one after the
other, so many of them have an encoder; a task's end empties the caches.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

#: Characters for which case folding, composition or white space need the library's own normaliser, and marks of special tokens.
_ODD = r"[\x00-\x08\x0e-\x1f\x7f-\x{bf}\x{130}\x{180}-\x{10ffff}]|<\|"
#: What a file must say for chunks to be independent.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PRE_TOKENIZERS = ["Split", "ByteLevel"]
#: With this splitter no piece goes on from a letter to a mark.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Longer chunks are not kept, so that the caches' size is bounded by their number of entries.
_LONG = 64
#: Texts that are encoded at once, which should be many, as an equal word in them is looked up once; and those whose ids are put together at once.
ROWS, _TEXTS = 2048, 256


def strings(texts: pa.Array) -> list[str]:
    """What to_pylist() gives of a string array without nulls, in a fraction of its time."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, max_entries: int = 1 << 16):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        self._bound = max_entries
        #: What was asked for lately, and before. Once the first are many they become the second, which go.
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._odd_chunks: dict[bytes, bytes] = {}
        #: The file's BPE model alone, given pieces that are split and written in byte letters already.
        self._bare = Tokenizer(self.library.model)
        self._bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._letters = byte_letters() | {32: " "}
        suffix = said["model"].get("end_of_word_suffix") or ""
        self._ends = np.zeros(self.vocab_size, bool)
        for token, i in said["model"]["vocab"].items():
            self._ends[i] = bool(suffix) and token.endswith(suffix)
        self.by_chunk = self._independent(said)

    def _independent(self, said: dict) -> bool:
        normal, pre = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
        if [x["type"] for x in normal.get("normalizers", [])] != _NORMALIZERS:
            return False
        splits = pre.get("pretokenizers", [])
        if [x["type"] for x in splits] != _PRE_TOKENIZERS or not splits[0].get("invert") or splits[0]["behavior"] != "Removed":
            return False
        if splits[1].get("use_regex") or splits[1].get("add_prefix_space"):
            return False
        self._piece_or_break = regex.compile("\n|" + splits[0]["pattern"]["Regex"])
        self._marked = splits[0]["pattern"]["Regex"] == _PIECES
        if not said["model"].get("end_of_word_suffix"):
            return False
        return all(not x["lstrip"] and not x["rstrip"] and "<|" in x["content"] for x in said["added_tokens"])

    def forget(self) -> None:
        """Empties the caches."""
        self._chunks, self._older, self._odd_chunks = {}, {}, {}

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many(pa.array([text], pa.string()))[0]

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array; null counts as empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not self.by_chunk:
            odd = np.ones(len(texts), bool)
        plain = iter(self._plain(texts.filter(pa.array(~odd))))
        return [self._alone(texts[i].as_py()) if x else next(plain) for i, x in enumerate(odd)]

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        words, marks = self._split(coded.dictionary)
        # Each distinct chunk is two pieces, the second of which may be empty.
        pieces = pa.chunked_array([words, marks]).dictionary_encode().combine_chunks()
        found = self._found(pieces.dictionary)
        first, second = pieces.indices.to_numpy().reshape(2, -1)
        codes = coded.indices.to_numpy()
        ids = np.frombuffer(b"".join(found), self.dtype)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = []
        # Places are many times as large as ids, so they are made for some texts at a time.
        for at in range(0, len(texts), _TEXTS):
            here = bounds[at : at + _TEXTS + 1]
            own = codes[here[0] : here[-1]]
            pairs = np.stack([first[own], second[own]], 1).ravel()
            each = lengths[pairs]
            ends = np.concatenate(([0], np.cumsum(each)))
            flat = ids[np.repeat(starts[pairs] - ends[:-1], each) + np.arange(ends[-1])]
            cuts = ends[2 * (here - here[0])]
            out += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    def _split(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of chunks that are letters and one mark, the letters and the mark; of others the whole and nothing."""
        if not self._marked:
            return chunks, pc.binary_slice(chunks.cast(pa.binary()), 0, 0).cast(pa.string())
        stems = pc.utf8_rtrim(chunks, _MARKS)
        one = pc.equal(pc.subtract(pc.binary_length(chunks), pc.binary_length(stems)), 1)
        one = pc.and_(one, pc.utf8_is_alpha(stems))
        return pc.if_else(one, stems, chunks), pc.if_else(one, pc.utf8_slice_codeunits(chunks, -1), "")

    def _found(self, pieces: pa.Array) -> list[bytes]:
        """The ids of chunks or of their parts, from the cache or learned now."""
        texts = strings(pieces)
        if len(self._chunks) > self._bound:
            self._older, self._chunks = self._chunks, {}
        known, older = self._chunks, self._older
        found = list(map(known.get, texts))
        new = []
        for i in [i for i, x in enumerate(found) if x is None]:
            x = older.get(texts[i])
            if x is None:
                new.append(i)
            else:
                known[texts[i]] = found[i] = x
        # A run of letters is one piece and needs no splitter.
        single = pc.utf8_is_alpha(pieces.take(pa.array(new, pa.int64()))).to_numpy(zero_copy_only=False)
        at = np.array(new, np.int64)
        for part, learn in ((at[single], self._learn_words), (at[~single], self._learn)) if self._marked else ((at, self._learn),):
            for i, x in zip(part.tolist(), learn([texts[i] for i in part.tolist()])):
                found[i] = x
                if len(texts[i]) <= _LONG:
                    known[texts[i]] = x
        return found

    def _alone(self, text: str) -> np.ndarray:
        if not self.by_chunk or "<|" in text:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(b"".join(map(self._odd, text.encode().split())), self.dtype)

    def _odd(self, chunk: bytes) -> bytes:
        found = self._odd_chunks.get(chunk)
        if found is None:
            if len(self._odd_chunks) > self._bound:
                self._odd_chunks.clear()
            ids = self.library.encode(chunk.decode(), add_special_tokens=False).ids
            found = np.asarray(ids, self.dtype).tobytes()
            if len(chunk) <= _LONG:
                self._odd_chunks[chunk] = found
        return found

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and where each piece's end."""
        letters = " ".join(pieces).encode().decode("latin-1").translate(self._letters)
        ids = np.asarray(self._bare.encode_batch_fast([letters], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("a piece without an end of word")
        return ids, ends

    def _cut(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        flat, cuts = ids.tobytes(), (bounds * self.dtype.itemsize).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn_words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        # No letter here becomes two in lower case, and none ends a word.
        ids, ends = self._encoded("\n".join(words).lower().split("\n"))
        return self._cut(ids, np.concatenate(([0], ends)))

    def _learn(self, chunks: list[str]) -> list[bytes]:
        if not chunks:
            return []
        pieces = self._piece_or_break.findall("\n".join(chunks).lower())
        breaks = np.array([p == "\n" for p in pieces], bool)
        chunk_of = np.cumsum(breaks)[~breaks]
        ids, ends = self._encoded([p for p in pieces if p != "\n"])
        bounds = np.zeros(len(chunks) + 1, np.int64)
        np.maximum.at(bounds, chunk_of + 1, ends)
        np.maximum.accumulate(bounds, out=bounds)
        return self._cut(ids, bounds)


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    return WordEncoder(path)
