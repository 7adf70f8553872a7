"""Byte-pair encoding by speculation: longest match proposes tokens, pair checks accept or reject them.

A token sequence is the encoding of a word exactly if every two neighbours are compatible, that is, if merging
the two tokens' characters from scratch gives back those two tokens. So longest match proposes, all pairs of all
new words are checked in one vectorised pass, and only words with a failing pair are merged exactly.

Edge cases: null and empty texts have no tokens and decode to the empty text; texts of any length are encoded
whole; repeated rows give repeated rows; an empty table gives an empty table; other columns are passed through
untouched, whatever their names, except that the output columns replace columns of the same name.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.frames import fresh, map_arrow, map_texts

# The vocabulary's own word pattern and end-of-word mark.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# Encoded words a worker keeps; past it the older half goes. Only time depends on it.
WORDS_KEPT = 100_000
BYTES_AT_ONCE = 1 << 19  # of texts, whose words are objects of some ten times their size


def category(initial: str) -> str:
    """The characters up to U+00FF of a Unicode category, as the inside of a character class."""
    return "".join(f"\\x{p:02x}" for p in range(256) if unicodedata.category(chr(p))[0] == initial)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of one tokenizer file, with what the checks need."""

    def __init__(self, path: str, read=None):
        raw = json.loads(read(path) if read else open(path, encoding="utf-8").read())
        model = raw["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        size = 1 + max(chain(self.ids.values(), self.special.values()))
        self.tokens = [""] * size
        for token, number in chain(self.ids.items(), self.special.items()):
            self.tokens[number] = token
        self.size = size
        # For each token, the merge that makes it: its rank (-1: a single symbol) and its two parts.
        self.rank = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            x, y, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges.setdefault((x, y), (rank, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        table = byte_characters()
        self.characters = {b: table[b] for b in range(256)}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        # Longest match proposes only tokens that merging reproduces; a token no merge can reach would be a false proposal.
        self.reachable = {t: n for t, n in self.ids.items() if self.merge(self.symbols(t)) == [n]}
        # A trie of dictionaries; a token's number is kept under its last node's empty key, an ending one's under the mark.
        self.trie: dict = {}
        for token, number in self.reachable.items():
            node = self.trie
            for letter in token.removesuffix(WORD_END):
                node = node.setdefault(letter, {})
            node[WORD_END if token.endswith(WORD_END) else ""] = number

    def symbols(self, spelled: str) -> list[int]:
        ended = spelled.endswith(WORD_END)
        letters = list(spelled.removesuffix(WORD_END)) if ended else list(spelled)
        if ended and letters:
            letters[-1] += WORD_END
        return [self.ids[x] for x in letters if x in self.ids]

    def spell(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.characters)

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        return self._merge_short(symbols) if len(symbols) <= 48 else self._merge_long(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        symbols, none = list(symbols), (sys.maxsize, -1)
        find = self.merges.get
        pairs = [find(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is none or best[1] < 0:
                break
            i = pairs.index(best)
            symbols[i : i + 2] = [best[1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = find((symbols[i], symbols[i + 1]), none)
            if i:
                pairs[i - 1] = find((symbols[i - 1], symbols[i]), none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """With a heap and links, so that a word of any length takes n log n steps."""
        symbols = list(symbols)
        count = len(symbols)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(*self.merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.merges]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= count or self.merges.get((symbols[i], symbols[j])) != (rank, made):
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] < count:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < count and (found := self.merges.get((symbols[a], symbols[b]))):
                    heapq.heappush(heap, (found[0], a, found[1]))
        return [s for s in symbols if s >= 0]

    def propose(self, spelled: str) -> list[int]:
        """Longest match, left to right; the word's last piece carries the end mark."""
        out, at, end = [], 0, len(spelled)
        while at < end:
            node, here, stop, number = self.trie, at, at, -1
            while here < end and (node := node.get(spelled[here])) is not None:
                here += 1
                if here == end:
                    if WORD_END in node:
                        stop, number = here, node[WORD_END]
                elif "" in node:
                    stop, number = here, node[""]
            out.append(number)  # a single symbol always matches
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether no merge would ever join them across their border.

        Undo the two tokens' merges at the border, the later one first (at equal rank the right one, as the left
        would have been merged first). In each state, a merge over the border fires if it ranks before the merge
        that was undone last.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(x), bool)
        limit = np.full(len(x), np.iinfo(np.int64).max)
        todo = np.arange(len(x))
        while len(todo):
            key = x[todo] * self.size + y[todo]
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            fires = (self.pair_keys[place] == key) & (self.pair_ranks[place] < limit[todo])
            good[todo[fires]] = False
            todo = todo[~fires]
            rx, ry = self.rank[x[todo]], self.rank[y[todo]]
            todo, rx, ry = (v[(rx >= 0) | (ry >= 0)] for v in (todo, rx, ry))
            undo_y = ry >= rx
            at = todo[undo_y]
            limit[at] = ry[undo_y] + 1  # an equal merge further left goes first
            y[at] = self.left[y[at]]
            at = todo[~undo_y]
            limit[at] = rx[~undo_y]
            x[at] = self.right[x[at]]
        return good

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Encodings of distinct words, as 32-bit numbers: propose all, check all pairs at once, merge the failing ones."""
        spelled = [self.spell(w) for w in words]
        proposed = [self.propose(s) for s in spelled]
        flat = np.fromiter(chain.from_iterable(proposed), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(p) for p in proposed])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = inner[~self.compatible(flat[inner], flat[inner + 1])]
        for i in np.unique(owner[bad]).tolist():
            s = spelled[i]
            proposed[i] = self.merge([self.ids[c] for c in s[:-1]] + [self.ids[s[-1] + WORD_END]])
        return [np.array(p, np.int32).tobytes() for p in proposed]


class Encoder:
    """A vocabulary with the words a worker has met lately."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.find = regex.compile(WORDS).findall
        # The same pattern for texts within U+00FF, for which the plain engine is faster.
        letters, numbers = category("L"), category("N")
        narrow = WORDS.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", r"\t-\r \x85\xa0")
        self.find_narrow = re.compile(narrow).findall

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            # Lower case goes by character, with no final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_narrow(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The tokens of each text, as 32-bit numbers."""
        parts: list[list[list[str] | bytes]] = []
        for text in texts:
            own: list[list[str] | bytes] = []
            at = 0
            for m in self.vocabulary.split_special.finditer(text) if "<|" in text else ():
                own += [self.words(text[at : m.start()]), np.int32(self.vocabulary.special[m[0]]).tobytes()]
                at = m.end()
            own.append(self.words(text[at:] if at else text))
            parts.append(own)
        self.learn(set(chain.from_iterable(p for own in parts for p in own if isinstance(p, list))))
        find = self.fresh.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(find, p)) for p in own) for own in parts]

    def learn(self, met: set[str]) -> None:
        new = [w for w in met if w not in self.fresh]
        if len(self.fresh) + len(new) > WORDS_KEPT:
            self.old, self.fresh = self.fresh, {}
            new = list(met)
        for w in new:
            if w in self.old:
                self.fresh[w] = self.old[w]
        new = [w for w in new if w not in self.fresh]
        if new:
            self.fresh.update(zip(new, self.vocabulary.encode_words(new), strict=True))


@lru_cache(maxsize=4)
def encoder(content: str) -> Encoder:
    return Encoder(Vocabulary(content, read=lambda c: c))


def _broadcast(df: DataFrame, path: str):
    """The tokenizer file, read once on the driver: a file of fixed size."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the tokens of ``text`` in the column ``ids`` (array<int>), by the tokenizer file at ``path``."""
    content = _broadcast(docs, path)
    kept = [c for c in docs.columns if c.lower() != ids.lower()]
    own = fresh("_text", docs)
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(own))
    fields = "".join(f"`{c}` {t}, " for c, t in source.drop(own).dtypes)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        found = encoder(content.value).encode(batch.column(own).to_pylist())
        offsets = (np.cumsum([0, *map(len, found)]) // 4).astype(np.int32)
        values = np.frombuffer(b"".join(found), np.int32)
        return [*(batch.column(i) for i in range(len(kept))), pa.ListArray.from_arrays(offsets, values)]

    return map_texts(source, own, f"{fields}`{ids}` array<int>", work, BYTES_AT_ONCE)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the tokens of ``ids`` joined by spaces in ``text``; the vocabulary names no decoder of its own."""
    content = _broadcast(encoded, path)
    kept = [c for c in encoded.columns if c.lower() != text.lower()]
    own = fresh("_ids", encoded)
    source = encoded.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias(own))
    fields = "".join(f"`{c}` {t}, " for c, t in source.drop(own).dtypes)

    def run(batches):
        tokens = pa.array(encoder(content.value).vocabulary.tokens)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                lists = piece.column(own)
                spelled = pa.ListArray.from_arrays(_offsets(lists), pc.take(tokens, lists.flatten()))
                joined = pc.binary_join(spelled, " ")
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(kept))), joined], names=[*kept, text])

    return map_arrow(source, run, f"{fields}`{text}` string")


def _offsets(lists: pa.ListArray) -> pa.Array:
    ends = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    return pa.array(ends.astype(np.int32))
