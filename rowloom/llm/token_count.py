"""Token counts by greedy longest match in one pass over each word's bytes.

The vocabulary becomes a trie. Each state has a failure link and the number of tokens that are popped
when the link is followed, so that a word's token count is known without building its tokens, in
time linear in its length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A file with a base64 token and its rank on each line, read by the driver.
VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
CACHE_WORDS = 300_000
UNMATCHED = -1


@dataclass(frozen=True)
class Automaton:
    """Per state: the next states by byte, the failure link and the tokens popped by following it."""

    edges: list[dict[int, int]]
    link: list[int]
    popped: list[int]

    def count(self, word: bytes) -> int:
        """Tokens of a word by longest match; ``UNMATCHED`` if the vocabulary can't spell it."""
        edges, link, popped = self.edges, self.link, self.popped
        state = tokens = 0
        for byte in word:
            while (following := edges[state].get(byte)) is None:
                if link[state] < 0:
                    return UNMATCHED
                tokens += popped[state]
                state = link[state]
            state = following
        while state:
            if link[state] < 0:
                return UNMATCHED
            tokens += popped[state]
            state = link[state]
        return tokens


def build_automaton(vocabulary: Iterable[bytes]) -> Automaton:
    """Trie, failure links and popped counts, breadth first. Empty tokens are ignored."""
    edges: list[dict[int, int]] = [{}]
    ends = [False]
    for token in vocabulary:
        state = 0
        for byte in token:
            if byte not in edges[state]:
                edges[state][byte] = len(edges)
                edges.append({})
                ends.append(False)
            state = edges[state][byte]
        ends[state] = state != 0
    link, popped = [-1] * len(edges), [0] * len(edges)
    layer = [0]
    while layer:
        following = []
        for parent in layer:
            for byte, state in edges[parent].items():
                following.append(state)
                if ends[state]:
                    link[state], popped[state] = 0, 1
                    continue
                at, tokens = link[parent], popped[parent]
                while at >= 0 and byte not in edges[at]:
                    tokens += popped[at]
                    at = link[at]
                if at >= 0:
                    link[state], popped[state] = edges[at][byte], tokens
        layer = following
    return Automaton(edges, link, popped)


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


class Counter:
    """Counts the tokens of texts and remembers words, up to a bound."""

    def __init__(self, automaton: Automaton, mark: bytes) -> None:
        self.automaton, self.mark, self.known = automaton, mark, {}

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and words that can't be spelt (each of those is one token)."""
        words = (text or "").split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        counts = [known.get(w, 0) for w in words]
        for i, found in enumerate(counts):
            if not found:
                w = words[i]
                counts[i] = known[w] = self.automaton.count(self.mark + w.encode("utf-8", "surrogatepass"))
        unknown = counts.count(UNMATCHED)
        return len(words), sum(counts) + 2 * unknown, unknown


def token_counts(docs: DataFrame, vocabulary: Sequence[bytes], text: str = "text", mark: bytes = b" ") -> Column:
    """A column ``struct<n_words, n_tokens, n_unknown: bigint>``.

    Words are what white space separates. Each is matched with ``mark`` before it, the way the vocabulary
    writes the start of a word; a word the vocabulary can't spell is one token. Null and empty
    texts have no words. The vocabulary is a given file's and is broadcast as an automaton.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_automaton(vocabulary))

    @F.pandas_udf("n_words bigint, n_tokens bigint, n_unknown bigint")
    def count(texts: pd.Series) -> pd.DataFrame:
        counter = _counter(shared, mark)
        found = [counter.text(t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame(found, columns=["n_words", "n_tokens", "n_unknown"])

    return count(docs[text].cast("string"))


_counters: dict[tuple[int, bytes], Counter] = {}


def _counter(shared, mark: bytes) -> Counter:
    """One counter per worker, automaton and mark; an older automaton's words are let go."""
    key = (shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared), mark)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(shared.value, mark)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary: Sequence[bytes] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_tokens, n_unknown``. Null ids and repeated rows keep their rows."""
    counted = token_counts(docs, read_vocabulary() if vocabulary is None else vocabulary)
    return docs.select("doc_id", counted.alias("c")).select("doc_id", "c.n_words", "c.n_tokens", "c.n_unknown")
