"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if each token
encodes to itself and each two neighbours encode to themselves when joined. So
every prefix of the input has one last token, found among the tokens that end
there by testing the pair with the last token of what stands before. The merge
list bounds how far to the right of a token something can still change it: once
that many bytes have been read, the token is stable and is emitted. The
transducer holds the places inside that bound only, whatever the input's length.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_encoder import byte_letters

#: What byte-level BPE files split at, and Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Two white-space characters side by side, as RE2 writes it.
_SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"


class Transducer:
    """Encodes one pre-token, given in parts of any size."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], max_pairs: int = 1 << 19):
        self.tokens, self.max_pairs = tokens, max_pairs
        self.ranks = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.longest = max(map(len, tokens))
        self.lookahead = sufficient_lookahead(merges)
        # How each token is made, and by which merge. If two merges made one token, its parts would not be certain.
        self.parts = {a + b: (a, b) for a, b in merges}
        self.made = {a + b: i for i, (a, b) in enumerate(merges)}
        self._certain = len(self.parts) == len(merges)
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        own = [t for t in tokens if len(t) == 1 or self._merged(t) == [t]]
        self._own = set(own)
        self._tails = {t[k:] for t in own for k in range(len(t))}

    def _merged(self, data: bytes) -> list[bytes]:
        """BPE by its definition, for a token or two."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fits(self, pair: tuple[bytes, bytes]) -> bool:
        if len(self._pairs) > self.max_pairs:
            self._pairs.clear()
        found = self._pairs[pair] = self._apart(*pair) if self._certain else self._merged(pair[0] + pair[1]) == [*pair]
        return found

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens, each its own encoding, stay apart when joined.

        Goes back in time: what was made last is taken apart, and at each point
        the parts that touch must not have merged before either went into its
        whole. Of equal merges the left one comes first.
        """
        left_until = right_until = len(self.ranks) + 1
        while True:
            rank = self.ranks.get((left, right))
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            a, b = self.made.get(left, -1), self.made.get(right, -1)
            if a > b:
                left_until, left = a, self.parts[left][1]
            elif b >= 0:
                right_until, right = b, self.parts[right][0]
            else:
                return True

    def encode(self, parts: Iterator[bytes]) -> Iterator[int]:
        """Ids of the joined parts, each as soon as it is stable."""
        tails, own, pairs, ids = self._tails, self._own, self._pairs, self.tokens
        # buffer[0] is the byte after the last emitted token; last[i] is the last token of buffer[:i].
        buffer, last = b"", [b""]
        before = b""
        room = self.longest + self.lookahead
        for part in parts:
            for start in range(0, len(part), room):
                buffer += part[start : start + room]
                for i in range(len(last), len(buffer) + 1):
                    for k in range(i - 1, -1, -1):
                        t = buffer[k:i]
                        if t not in tails:
                            raise ValueError("bytes that no token covers")
                        if t in own:
                            p = last[k] if k else before
                            if not p:
                                if k == 0:
                                    break
                                continue
                            pair = (p, t)
                            fits = pairs.get(pair)
                            if self._fits(pair) if fits is None else fits:
                                break
                    last.append(t)
                if len(buffer) > 2 * room:
                    done, stable = self._back(last), len(buffer) - self.lookahead
                    cut = 0
                    for t in done:
                        if cut + len(t) > stable:
                            break
                        yield ids[t]
                        cut, before = cut + len(t), t
                    buffer, last = buffer[cut:], [b"", *last[cut + 1 :]]
        for t in self._back(last):
            yield ids[t]

    @staticmethod
    def _back(last: list[bytes]) -> list[bytes]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right of a token after which it can't change any more.

    A token's right edge can only be taken by an earlier merge whose left part
    ends there, and whether that merge happens hangs on its right part and on
    what lies within that part's own bound, by still earlier merges. Merges are
    gone through by rank, so each bound rests on finished ones.
    """
    reach: dict[bytes, int] = {}  # left part: the farthest that merges so far with it look
    edge: dict[bytes, tuple[bytes, ...]] = {}  # token: the parts of it that end at its right edge

    def edges(t: bytes) -> tuple[bytes, ...]:
        return edge.get(t, (t,))

    for left, right in merges:
        bound = len(right) + max(reach.get(x, 0) for x in edges(right))
        reach[left] = max(reach.get(left, 0), bound)
        edge.setdefault(left + right, (left + right, *edges(right)))
    return max(reach.values(), default=0)


class ByteBpe:
    """Whole texts to ids, as the tokenizers library encodes them with a byte-level BPE file."""

    def __init__(self, path: str, max_entries: int = 1 << 18):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file")
        letters = {c: b for b, c in byte_letters().items()}
        self.specials = {x["content"]: x["id"] for x in said["added_tokens"]}
        as_bytes = lambda t: bytes(letters[c] for c in t)
        tokens = {as_bytes(t): i for t, i in said["model"]["vocab"].items() if t not in self.specials}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in said["model"]["merges"]]
        self.transducer = Transducer(tokens, [(as_bytes(a), as_bytes(b)) for a, b in pairs])
        self.texts = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.dtype = np.dtype("<u2") if max(self.texts) < 1 << 16 else np.dtype("<u4")
        self._special = regex.compile("|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        self._bound = max_entries
        self._chunks: dict[str, tuple[bytes, bytes]] = {}
        self._pieces: dict[str, bytes] = {}
        size = max(self.texts) + 1
        self._lengths = np.array([len(self.texts.get(i, b"")) for i in range(size)])
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(self.texts.get(i, b"") for i in range(size)), np.uint8)
        self.decimals = [b"%d," % i for i in range(size)]

    def _piece(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            found = np.fromiter(self.transducer.encode(iter([piece.encode()])), self.dtype).tobytes()
            if len(piece) <= 64:
                if len(self._pieces) > 2 * self._bound:
                    self._pieces.clear()
                self._pieces[piece] = found
        return found

    def _split(self, text: str) -> bytes:
        return b"".join(map(self._piece, _SPLIT.findall(text)))

    def _alone(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self._special.finditer(text) if self.specials else ():
            out += [self._split(text[at : m.start()]), np.array([self.specials[m[0]]], self.dtype).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._split(text[at:])]), self.dtype)

    def encode(self, text: str | None) -> np.ndarray:
        return self._alone(text or "")

    def encode_many(self, texts: pa.Array) -> list[tuple[np.ndarray, bytes]]:
        """Ids of each text, and the same in decimal with a comma after each; null counts as empty.

        Between single spaces a text's chunks don't touch each other, so each
        distinct chunk of the texts is encoded once. Texts with special tokens
        or with white space side by side go through the splitter as a whole.
        """
        texts = texts.fill_null("")
        whole = pc.or_(pc.match_substring_regex(texts, _SPACES), pc.match_substring(texts, "<|")).to_numpy(zero_copy_only=False)
        if any("<|" not in x for x in self.specials):
            whole[:] = True
        chunked = iter(self._chunked(texts.filter(pa.array(~whole))))
        out = []
        for i, x in enumerate(whole):
            if x:
                ids = self._alone(texts[i].as_py())
                out.append((ids, b"".join(map(self.decimals.__getitem__, ids.tolist()))))
            else:
                out.append(next(chunked))
        return out

    def _chunked(self, texts: pa.Array) -> list[tuple[np.ndarray, bytes]]:
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes, known = coded.indices.to_numpy(), self._chunks
        chunks = [f" {x}" for x in coded.dictionary.to_pylist()]
        if len(known) > self._bound:
            known.clear()
        found, decimals = [], []
        for c in chunks:
            made = known.get(c)
            if made is None:
                ids = self._split(c)
                made = ids, b"".join(map(self.decimals.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
                if len(c) <= 64:
                    known[c] = made
            found.append(made[0])
            decimals.append(made[1])
        bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        out = []
        for a, b in zip(bounds, bounds[1:]):
            first = np.frombuffer(self._split(chunks[codes[a]][1:]), self.dtype)
            own = codes[a + 1 : b].tolist()
            ids = np.frombuffer(b"".join([first.tobytes(), *map(found.__getitem__, own)]), self.dtype)
            out.append((ids, b"".join([*map(self.decimals.__getitem__, first.tolist()), *map(decimals.__getitem__, own)])))
        return out

    def token_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        return self._bytes[np.repeat(self._starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> str:
        state, out = TextState(), []
        for i in range(0, len(ids), step):
            out.append(state.push(self.token_bytes(ids[i : i + step])))
        return "".join([*out, state.finish()])


class TextState:
    """Bytes to text, given in parts; it holds the bytes of an unfinished character, three at most.

    Bytes that are no UTF-8 become U+FFFD, one for each longest part that could have begun a character.
    """

    def __init__(self):
        self.held = b""

    def push(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if need > back and self._may_begin(data[-back:]):
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _may_begin(tail: bytes) -> bool:
        """Whether some character of UTF-8 begins with these bytes."""
        try:
            tail.decode()
        except UnicodeDecodeError as e:
            return e.reason == "unexpected end of data"
        return False

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each worker process and file."""
    return ByteBpe(path)


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids array<int> of each row's whole text; null counts as empty, every row stands for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids = [x.astype(np.int32) for x, _ in bpe.encode_many(rows.column(1))]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row's ids; a null list counts as empty. Null ids and those that no token has are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        size = len(bpe.decimals)
        for batch in batches:
            texts = [bpe.decode(np.array([i for i in x or [] if i is not None and 0 <= i < size], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text, encoded and decoded again.

    Null texts count as empty: no token, and the digests of an empty string.
    Every row stands for itself, those with null or equal ids too; other columns
    are not read; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                done = bpe.encode_many(rows.column(1))
                columns = [rows.column(0), pa.array([len(x) for x, _ in done], pa.int64()), pa.array([hexed(d[:-1]) for _, d in done]), pa.array([hexed(bpe.decode(x).encode()) for x, _ in done])]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
