"""Byte-pair vocabularies as finite automata: exact encoding without running merges.

Two properties carry everything here. A token sequence is the byte-pair encoding of
its bytes exactly if each neighbouring pair is *compatible*, that is, encodes to
itself; and for every prefix of a word there is one last token that is compatible
with the last token of what remains. So one pass over the matches of an automaton
finds, for each prefix, its last token, and the back-pointers give the ids.
"""

from __future__ import annotations

import base64
from functools import cache
from itertools import chain
from pathlib import Path

import ahocorasick
import regex
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: How the byte-level vocabularies cut text before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the vocabulary files lie, unless a query is given another folder.
FOLDER = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"

#: Words remembered by a worker; past it the memory is emptied and fills again.
REMEMBERED = 500_000


class Vocabulary:
    """A byte-level vocabulary given as ``bytes -> id``, where a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self._pairs: dict[tuple[int, int], bool] = {}
        self._ids = _Memory(self._encode)
        self._counts = _Memory(self._count)
        self._matches = ahocorasick.Automaton()
        for token, i in ranks.items():
            self._matches.add_word(token.decode("latin-1"), (len(token), i))
        self._matches.make_automaton()
        self._steps: list[dict[int, int]] | None = None

    def merged(self, word: bytes) -> list[int]:
        """The encoding by its definition: merge the pair of lowest id until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def by_prefix(self, word: bytes) -> list[int]:
        """Ids of ``word``: the last token of every prefix, then the back-pointers from its end."""
        last: list[tuple[int, int] | None] = [None] * (len(word) + 1)
        for end, (size, i) in self._matches.iter(word.decode("latin-1")):
            start = end + 1 - size
            if last[end + 1] is None and (not start or (last[start] is not None and self.compatible(last[start][1], i))):
                last[end + 1] = (start, i)
        ids, at = [], len(word)
        while at:
            at, i = last[at]
            ids.append(i)
        return ids[::-1]

    def _automaton(self) -> None:
        """The trie of the vocabulary with failure links, and what each failure emits.

        A node's failure link is where matching goes on when no child fits, after
        emitting the tokens that greedy longest match has settled by then.
        """
        steps: list[dict[int, int]] = [{}]
        own: list[int | None] = [None]
        for token, i in self.ranks.items():
            node = 0
            for byte in token:
                if byte not in steps[node]:
                    steps[node][byte] = len(steps)
                    steps.append({})
                    own.append(None)
                node = steps[node][byte]
            own[node] = i
        link, emits = [-1] * len(steps), [()] * len(steps)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in steps[node].items():
                    below.append(child)
                    if own[child] is not None:
                        link[child], emits[child] = 0, (own[child],)
                        continue
                    at, out = link[node], list(emits[node])
                    while at >= 0 and byte not in steps[at]:
                        out.extend(emits[at])
                        at = link[at]
                    if at >= 0:
                        link[child], emits[child] = steps[at][byte], tuple(out)
            level = below
        self._steps, self._link, self._emits = steps, link, emits

    def longest_match(self, word: bytes) -> list[int]:
        """Ids of greedy longest match, in time linear in the word.

        Every byte is a token, so matching never fails for good.
        """
        if self._steps is None:
            self._automaton()
        steps, link, emits, node, out = self._steps, self._link, self._emits, 0, []
        for byte in word:
            while byte not in steps[node]:
                out.extend(emits[node])
                node = link[node]
            node = steps[node][byte]
        while node:
            out.extend(emits[node])
            node = link[node]
        return out

    def _encode(self, word: str) -> list[int]:
        return self.by_prefix(word.encode("utf-8", "surrogatepass"))

    def _count(self, word: str) -> int:
        """Tokens of a word: longest match where its pairs are compatible, else the exact prefix pass."""
        data = word.encode("utf-8", "surrogatepass")
        ids = self.longest_match(data)
        exact = all(map(self.compatible, ids, ids[1:]))
        return len(ids) if exact else len(self.by_prefix(data))

    def encode(self, text: str):
        """Iterates over the ids of a text."""
        self._ids.bound()
        return chain.from_iterable(map(self._ids.__getitem__, self.split(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a text; none for null and ''."""
        self._counts.bound()
        return sum(map(self._counts.__getitem__, self.split(text))) if text else 0


class _Memory(dict):
    """Results by word, filled on demand."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        self[word] = made = self.make(word)
        return made

    def bound(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def ship(spark: SparkSession, name: str = DEFAULT, folder: str = FOLDER) -> None:
    """Send the vocabulary file to all executors, whether or not they have the folder."""
    path = Path(folder, f"{name}.tiktoken")
    if not any(own.endswith(f"/{path.name}") for own in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(str(path))


@cache
def load(name: str = DEFAULT, folder: str = FOLDER) -> Vocabulary:
    """The vocabulary of ``<folder>/<name>.tiktoken``, or of the file that was sent, once for each worker process."""
    path = Path(folder, f"{name}.tiktoken")
    lines = (path if path.exists() else Path(SparkFiles.get(path.name))).read_bytes().splitlines()
    return Vocabulary({base64.b64decode(token): int(i) for token, i in (line.split() for line in lines if line)})
