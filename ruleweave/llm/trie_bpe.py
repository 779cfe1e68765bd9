"""BPE encoding and decoding by a prefix-sharing trie of words.

What a vocabulary makes of the first d bytes of a word is told by its last token
alone: taking that token's bytes away leaves a shorter prefix of the same word.
Distinct words are inserted into a trie; a depth-first walk carries the last
token of every prefix on the current path, so a prefix that many words share is
encoded once, and the ids of a word are read backwards from its leaf.

The last token of a prefix is the one of its suffix tokens that may follow the
last token of the prefix before it.  Two tokens may follow each other if no merge
joins bytes of both before each is complete; for a list of merges in which parts
come before wholes exactly one suffix token passes.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ruleweave.llm.chunks import IDS, Chunks, binary_column, gathered, slices

#: Chunks and words whose ids a worker remembers, and pairs of tokens it has judged.
CHUNKS, WORDS, PAIRS = 180_000, 60_000, 300_000
#: The split pattern of byte-level vocabularies; {L} and {N} stand for letters and numbers.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\p{White_Space}{L}{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The printable characters by which vocabulary files write the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def newcomers(pre_tokenizer) -> str:
    """Letters and numbers of the `regex` module's Unicode version that the library's does not know yet."""
    named = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)])))
    spans = {span for _, span in pre_tokenizer.pre_tokenize_str(".".join(named))}
    return "".join(c for i, c in enumerate(named) if (2 * i, 2 * i + 1) not in spans)


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's file format, without normalizer and post-processor."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        named = json.loads(text)
        model, letters = named["model"], byte_letters()
        kind = named["pre_tokenizer"] or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("not a byte-level BPE vocabulary without a prefix blank")
        if named["normalizer"] or model.get("ignore_merges") or model.get("dropout") or len(named["added_tokens"]) > 1:
            raise ValueError("normalizers, dropout, unmerged words and several added tokens are not supported")
        spell = lambda token: bytes(map(letters.__getitem__, token))
        ids = model["vocab"]
        self.special, self.special_id = "", -1
        for added in named["added_tokens"]:
            if added["lstrip"] or added["rstrip"] or added["single_word"]:
                raise ValueError("an added token that takes in its surroundings is not supported")
            self.special, self.special_id = added["content"], added["id"]
        top = max([*ids.values(), self.special_id]) + 1
        self.bytes_of = [b""] * top
        for token, i in ids.items():
            self.bytes_of[i] = spell(token)
        #: Rank at which a token is made (-1 for bytes), its two parts, and the rank of a pair.
        self.rank, self.left, self.right = [-1] * top, [-1] * top, [-1] * top
        self.pairs: dict[int, int] = {}
        self.top = top
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made, a, b = ids[a + b], ids[a], ids[b]
            if max(self.rank[a], self.rank[b]) >= rank or self.rank[made] >= 0:
                raise ValueError("merges whose parts come later, or that make one token twice, are not supported")
            self.rank[made], self.left[made], self.right[made] = rank, a, b
            self.pairs[a * top + b] = rank
        #: Tokens that their own bytes are encoded to; no text has another one.
        self.reached = [i for i in ids.values() if self.rank[i] < 0 and len(self.bytes_of[i]) == 1 or self._made(i)]
        if self.special:
            self.bytes_of[self.special_id] = self.special.encode()
        self.newcomers = newcomers(Tokenizer.from_str(text).pre_tokenizer)

    def _made(self, token: int) -> bool:
        return self.rank[token] >= 0 and not self.crossed(self.left[token], self.right[token], self.rank[token])

    def crossed(self, a: int, b: int, before: int = sys.maxsize) -> bool:
        """Whether some merge joins bytes of a and b before both are complete and, of the whole pair, before the given rank.

        At its right edge a is first a byte, then ever larger tokens, each until the
        next is made; so is b at its left edge.  A merge of two such tokens comes
        first if neither has been taken up yet; of equal merges the left one does.
        """
        top, pairs, rank = self.top, self.pairs, self.rank
        x, x_taken = a, before
        while x >= 0:
            y, y_taken = b, before
            while y >= 0:
                m = pairs.get(x * top + y)
                if m is not None and m < x_taken and (m < before and m <= y_taken):
                    return True
                y, y_taken = self.left[y], rank[y]
            x, x_taken = self.right[x], rank[x]
        return False


class Walker:
    """Encodes words; lives in one worker."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.size = [len(b) for b in v.bytes_of]
        self.longest = max(self.size[i] for i in v.reached)
        self.suffixes = ahocorasick.Automaton()
        for i in v.reached:
            self.suffixes.add_word(v.bytes_of[i].decode("latin-1"), i)
        self.suffixes.make_automaton()
        self.judged: dict[int, bool] = {}
        self.new = frozenset(v.newcomers)
        new = "[" + regex.escape(v.newcomers or "\ue000") + "]"
        self.split_plain = regex.compile(_SPLIT.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}")).findall
        self.split_exact = regex.compile("(?V1)" + _SPLIT.replace("{L}", rf"[\p{{L}}--{new}]").replace("{N}", rf"[\p{{N}}--{new}]")).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunks = Chunks(self.ids_of, CHUNKS, v.special)

    def words(self, words: list[bytes]) -> list[bytes]:
        """Id bytes of distinct words, which are sorted: the leaves of their trie in depth-first order.

        A word leaves the path of the one before it at the length of their common
        prefix; states above stay, those below are dropped.
        """
        judged, size, crossed, top = self.judged, self.size, self.v.crossed, self.v.top
        if len(judged) > PAIRS:
            judged.clear()
        out, last, before = [], [-1], b""  # last[d]: last token of the first d bytes of the path
        for word in words:
            done = _shared(before, word)
            del last[done + 1 :]
            start = max(0, done + 1 - self.longest)
            for end, token in self.suffixes.iter(word.decode("latin-1"), start):
                if end < done:  # a prefix that has its token
                    continue
                begin = end + 1 - size[token]
                if begin:
                    pair = last[begin] * top + token
                    fits = judged.get(pair)
                    if fits is None:
                        fits = judged[pair] = not crossed(last[begin], token)
                    if not fits:
                        continue
                last.append(token)
                done = end + 1
            d, ids = len(word), []
            while d:
                ids.append(last[d])
                d -= size[last[d]]
            out.append(np.array(ids[::-1], IDS).tobytes())
            before = word
        return out

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """Id bytes of chunks; all their words not met lately form one trie."""
        special, special_id = self.v.special, np.array([self.v.special_id], IDS).tobytes()
        cut = []  # of each chunk the words, None for the added token
        for c in chunks:
            if special and special in c:
                words: list[str | None] = []
                for i, part in enumerate(c.split(special)):
                    words += [None] * (i > 0)
                    words += self.split(part)
                cut.append(words)
            else:
                cut.append(self.split(c))
        if len(self.young) > WORDS:
            self.young, self.old = {}, self.young
        own: dict[str | None, bytes] = {None: special_id}
        memories, new = (self.young, self.old, self.chunks.young, self.chunks.old), []
        for word in set().union(*cut).difference(own):
            for memory in memories:
                if word in memory:
                    own[word] = memory[word]
                    break
            else:
                new.append((word.encode("utf-8"), word))
        new.sort()
        own.update(zip([w for _, w in new], self.words([b for b, _ in new])))
        # a chunk of one word stays in the memory of chunks
        self.young.update((w, own[w]) for words in cut if len(words) > 1 for w in words if w is not None)
        return [own[words[0]] if len(words) == 1 else b"".join(map(own.__getitem__, words)) for words in cut]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without the added token."""
        if not text.isascii() and not self.new.isdisjoint(text):
            return self.split_exact(text)
        return [text] if text[1:].isalpha() and text[0] == " " else self.split_plain(text)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    if n > 64:  # halves, as long words may agree far
        low, high = 0, n
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
        return low
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


class Shared:
    """The vocabulary as it is broadcast; a worker makes what it needs once, the walker only if it encodes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.made, self.spelt = vocabulary, None, None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "made": None, "spelt": None}

    def tokens(self) -> pa.LargeBinaryArray:
        if self.spelt is None:
            self.spelt = pa.array(self.vocabulary.bytes_of, pa.large_binary())
        return self.spelt

    def walker(self) -> Walker:
        if self.made is None:
            self.made = Walker(self.vocabulary)
        return self.made


def share(spark, path: str):
    """A vocabulary file for `encode` and `decode`; its size is that of the file."""
    return spark.sparkContext.broadcast(Shared(Vocabulary(Path(path).read_text(encoding="utf-8"))))


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_DECODED = _ENCODED.append(pa.field("decoded", pa.string()))
_KINDS = "doc_id long, ids binary"


def _texts(tokens: pa.LargeBinaryArray, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts of the ids up to each end, the first of which is 0."""
    stops, data = gathered(tokens, ids.astype(np.int64))
    view, cuts = memoryview(data), stops[ends].tolist()
    return [str(view[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def encode(documents: DataFrame, shared, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text.

    With `decoded` also the text that the ids stand for, read back from them as
    `decode` does.  The added token's string in a text is that token.  A null or
    empty text has no ids.  Repeated rows and null doc_ids stay as they are, other
    columns are ignored, an empty table gives no rows, and ties cannot arise: each
    row is encoded alone.
    """
    schema = _DECODED if decoded else _ENCODED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, tokens = shared.value.walker().chunks, shared.value.tokens()
        for batch in slices(batches):
            ends, data = chunks.encode(batch.column("text"))
            columns = [batch.column("doc_id"), binary_column(ends * IDS.itemsize, data)]
            if decoded:
                columns.append(pa.array(_texts(tokens, np.frombuffer(data, IDS), ends), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, _KINDS + ", decoded string" * decoded)


def decode(encoded: DataFrame, shared) -> DataFrame:
    """The rows of `encode` with the text that their ids stand for, added token included.

    Bytes that are no UTF-8 become U+FFFD; an id outside the vocabulary is an error;
    null ids decode to a null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens()
        for batch in slices(batches, "ids"):
            rows = batch.column("ids").to_pylist()
            ends = np.cumsum([0, *(len(r or b"") // IDS.itemsize for r in rows)])
            texts = _texts(tokens, np.frombuffer(b"".join(r or b"" for r in rows), IDS), ends)
            read = pa.array([None if r is None else t for r, t in zip(rows, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, read], schema=_DECODED)

    return encoded.select("doc_id", "ids").mapInArrow(run, _KINDS + ", decoded string")
