"""Token counts by a compiled finite-state tokenizer (operator 7).

The vocabulary of a word-end BPE is compiled, as texts ask for it, into one
deterministic transducer over characters.  A transition holds the number of
tokens by which the encoding of the text so far grows.  A state holds what the
rest of a word can depend on: the pre-token class, how the count changes if the
word ends here, and for every suffix of the word that begins some token, the
last token before it and its count.  That is enough, since a
split of a word is the tokenizer's if and only if each two neighbours are what
the merges make of the two together.

A long text is cut into chunks.  White space leads every state to the start
state, so the state map of a chunk is constant behind its first white space, and
maps compose associatively; a tree of compositions (the reduction of a parallel
prefix scan) gives the count of the text.  A table of states that reaches its
bound is dropped, also in the middle of a text, and compiled anew from the state
that the text is in; so there are never more states than the bound and those
that the chunks of one text end in.

Defined cases: a null or empty text has 0 tokens and 0 bytes; special strings in
a text count as one token each, which is the library's default; rows that repeat
are each returned; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loctrack.llm.common import keyed, slices

#: Tokens above which a text is over the limit.
LIMIT = 2048
#: Characters of a chunk; states of a table; remembered pairs.
CHUNK, STATES, PAIRS = 1 << 14, 150_000, 300_000

# The characters with the Unicode property White_Space, and the
# contractions that are pre-tokens of their own (after an apostrophe).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WORD_END = "</w>"

_SPACE = re.compile(f"[{SPACES}]")
_LETTER, _NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
#: Behind the last character of a text.
END = "\ud800"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The merges of the vocabulary: which neighbours in a split are stable."""

    def __init__(self, model: dict) -> None:
        self.pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(self.pairs)}
        self.made = {a + b: i for (a, b), i in self.rank.items()}
        if len(self.made) < len(self.rank):
            raise ValueError("two merges make one token")
        self.tokens = set(model["vocab"])
        self.opens = {""}  # what can go on to a longer token
        for t in self.tokens:
            body = t.removesuffix(WORD_END)
            self.opens.update(body[:k] for k in range(1, len(body)))
        self.stable_pairs: dict[tuple[str, str], bool] = {}

    def stable(self, a: str, b: str) -> bool:
        """Whether the merges of the text of two tokens end in these two.

        The merges are undone from the last to the first.  At each point the
        parts that meet are neighbours; a merge of them that comes before the
        one undone (or is the same, further left) would have joined them."""
        found = self.stable_pairs.get((a, b))
        if found is None:
            if len(self.stable_pairs) >= PAIRS:
                self.stable_pairs.clear()
            left, right, limit, found = a, b, 1 << 60, True
            while True:
                if self.rank.get((left, right), limit) < limit:
                    found = False
                    break
                made_left, made_right = self.made.get(left, -1), self.made.get(right, -1)
                if made_left < 0 and made_right < 0:
                    break
                if made_left > made_right:
                    limit, left = made_left, self.pairs[made_left][1]
                else:
                    limit, right = made_right + 1, self.pairs[made_right][0]
            self.stable_pairs[a, b] = found
        return found

    def step(self, word: tuple, symbol: str) -> tuple[int, tuple]:
        """Tokens by which the word's encoding grows, and the word's new state.

        A word's state is (open, places): the longest suffix that begins a
        token, and for its suffixes that do, by length, (length, last token
        before it, tokens before it less those before length 0)."""
        open_, places = word
        last = symbol.endswith(WORD_END)
        body = open_ + symbol.removesuffix(WORD_END)
        for length, before, n in places:
            token = body[len(open_) - length :] + WORD_END * last
            if token in self.tokens and (before is None or self.stable(before, token)):
                grown = n + 1
                break
        else:
            raise ValueError(f"no token ends {body!r}")
        if last:
            return grown, ("", ())
        kept = [(length + 1, t, n - grown) for length, t, n in places if body[len(open_) - length :] in self.opens]
        return grown, (body[-kept[0][0] :] if kept else "", (*kept, (0, token, 0)))


WORD_START = ("", ((0, None, 0),))


class State(dict):
    """Character to (tokens, next state); ``end``: tokens more if the word ends here."""

    __slots__ = ("end", "kind", "transducer", "word")

    def __init__(self, transducer: Transducer, kind: str, word: tuple, end: int) -> None:
        self.transducer, self.kind, self.word, self.end = transducer, kind, word, end

    def __missing__(self, char: str) -> tuple[int, State]:
        out = self[char] = self.transducer.compile(self, char)
        return out


class Transducer:
    _loaded: dict[str, Transducer] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as lines:
            whole = json.load(lines)
        self.merges = Merges(whole["model"])
        special = [t["content"] for t in whole["added_tokens"] if t["special"] and not t["normalized"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.of_byte = byte_symbols()
        self.reset()

    @classmethod
    def load(cls, path: str) -> Transducer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def reset(self) -> None:
        """Drop all states; what still holds one reads on from it, and nothing
        that it led to stays."""
        for state in getattr(self, "states", {}).values():
            state.clear()
        self.states: dict[tuple, State] = {}
        self.start = self.state("start", WORD_START, 0)

    def state(self, kind: str, word: tuple, end: int) -> State:
        key = (kind, word, end)
        if key not in self.states:
            if len(self.states) >= STATES:  # also in the middle of a text
                self.reset()
            self.states[key] = State(self, *key)
        return self.states[key]

    @staticmethod
    def kind_of(char: str) -> str:
        if char in SPACES:
            return "space"
        return "letter" if _LETTER.match(char) else "number" if _NUMBER.match(char) else "other"

    def feed(self, word: tuple, char: str, last: bool) -> tuple[int, tuple]:
        total, raw = 0, char.encode("utf-8", "replace")
        for k, byte in enumerate(raw, 1):
            n, word = self.merges.step(word, self.of_byte[byte] + (WORD_END if last and k == len(raw) else ""))
            total += n
        return total, word

    def whole(self, text: str) -> int:
        word, total = WORD_START, 0
        for k, char in enumerate(text, 1):
            n, word = self.feed(word, char, k == len(text))
            total += n
        return total

    def grow(self, kind: str, word: tuple, char: str, before: int = 0) -> tuple[int, State]:
        """The transition that adds a character to a word."""
        n, longer = self.feed(word, char, False)
        return before + n, self.state(kind, longer, self.feed(word, char, True)[0] - n)

    def compile(self, at: State, char: str) -> tuple[int, State]:
        """The transition of ``at`` on a character."""
        kind = "space" if char == END else self.kind_of(char)
        if at.kind == "start":
            if kind == "space":
                return 0, self.start
            if kind == "number":
                return self.whole(char), self.start
            if char == "'":
                return 0, self.state("'", WORD_START, 0)
            return self.grow(kind, WORD_START, char)
        if at.kind == kind:
            return self.grow(kind, at.word, char)
        if at.kind[0] == "'":  # an apostrophe that begins a pre-token, and letters
            so_far = at.kind[1:] + char
            if so_far in CONTRACTIONS:
                return self.whole("'" + so_far), self.start
            if any(c.startswith(so_far) for c in CONTRACTIONS):
                return 0, self.state("'" + so_far, WORD_START, 0)
            if at.kind == "'" and kind == "other":
                n, word = self.feed(WORD_START, "'", False)
                return self.grow("other", word, char, n)
            n, state = self.whole("'"), self.start
            for c in so_far:
                more, state = state[c]
                n += more
            return n, state
        more, state = self.start[char]
        return at.end + more, state

    def run(self, text: str, state: State) -> tuple[int, State]:
        total = 0
        for char in text:
            n, state = state[char]
            total += n
        return total, state

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if self.special and "<" in text:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self._plain(p, chunk) for p in parts)
        return self._plain(text, chunk)

    def _plain(self, text: str, chunk: int) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would look at the place of a sigma
        text = text.lower()
        if len(text) <= chunk:
            total, state = self.run(text, self.start)
            return total + state[END][0]
        maps = [ChunkMap.of(self, text[k : k + chunk]) for k in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [maps[k].then(maps[k + 1], self) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        whole = maps[0]
        n, state = self.run(whole.head, self.start)
        if whole.tail is None:
            return n + state[END][0]
        return n + state[END][0] + whole.n + whole.tail[END][0]


@dataclass
class ChunkMap:
    """The state map of a chunk.  From any state: read ``head``; if ``tail`` is
    given there is white space behind it, and so whatever the state was, ``n``
    more tokens follow that white space and the chunk ends in ``tail``."""

    head: str
    n: int = 0
    tail: State | None = None

    @classmethod
    def of(cls, t: Transducer, text: str) -> ChunkMap:
        cut = _SPACE.search(text)
        if cut is None:
            return cls(text)
        return cls(text[: cut.start()], *t.run(text[cut.end() :], t.start))

    def then(self, after: ChunkMap, t: Transducer) -> ChunkMap:
        if self.tail is None:
            return ChunkMap(self.head + after.head, after.n, after.tail)
        n, state = t.run(after.head, self.tail)
        if after.tail is None:
            return ChunkMap(self.head, self.n + n, state)
        return ChunkMap(self.head, self.n + n + state[END][0] + after.n, after.tail)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer.load(path)
        for batch in slices(batches, 500):
            texts = batch.column(1).to_pylist()
            n = [t.count(x) for x in texts]
            size = [len(x.encode("utf-8", "replace")) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return keyed(docs, id_col, text_col).mapInArrow(tasks, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
