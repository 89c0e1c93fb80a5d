"""Token counts (operator 10): greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link (where matching goes on after the pieces that are certain have
been popped) and the number of pieces popped on the way, both computed once. A word is then one walk over its
symbols, adding pop counts; no piece is ever built. The vocabulary is the token set of a word-level BPE file, matched
greedily (longest first), which is a different segmentation from that file's merges.

Defined cases: a null or empty text has zero words and zero tokens; every symbol is in the vocabulary, so no word is
unknown; a vocabulary without some symbol counts a word that holds it as one unknown token; repeated rows count
alike, and there are no ties, as the longest match at a place is unique; texts of any length are counted whole; an
empty table gives an empty result; other columns pass through, those with the name of a result column are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from idloom.llm import bpe
from idloom.llm.common import CACHE_WORDS, table, with_columns

ROOT, NONE = 0, -1


class MatchAutomaton:
    """Trie of ``pieces`` with failure links and popped-piece counts."""

    def __init__(self, pieces: list[str]):
        step: list[dict[str, int]] = [{}]
        final, order = {ROOT: False}, [(ROOT, NONE, "")]
        for piece in pieces:
            at = ROOT
            for c in piece:
                if c not in step[at]:
                    step[at][c] = len(step)
                    order.append((len(step), at, c))
                    step.append({})
                at = step[at][c]
            final[at] = True
        depth = [0] * len(step)
        for node, parent, _ in order[1:]:
            depth[node] = depth[parent] + 1
        self.step, self.link, self.pops = step, [NONE] * len(step), [0] * len(step)
        for node, parent, c in sorted(order[1:], key=lambda x: depth[x[0]]):
            if final.get(node):
                self.link[node], self.pops[node] = ROOT, 1
                continue
            pops, at = self.pops[parent], self.link[parent]
            while at != NONE and c not in step[at]:
                pops, at = pops + self.pops[at], self.link[at]
            if at != NONE:
                self.link[node], self.pops[node] = step[at][c], pops

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match segmentation; 1 if the word can't be segmented."""
        at, total, step, link, pops = ROOT, 0, self.step, self.link, self.pops
        for c in word:
            while c not in step[at]:
                total, at = total + pops[at], link[at]
                if at == NONE or (at == ROOT and c not in step[ROOT]):
                    return 1
            at = step[at][c]
        while at != ROOT:
            total, at = total + pops[at], link[at]
            if at == NONE:
                return 1
        return total


class Counter(dict):
    """Word -> number of pieces, in a bounded cache."""

    def __init__(self, path: str):
        super().__init__()
        self.bpe = bpe.load(path)
        self.automaton = MatchAutomaton(list(self.bpe.token))

    def __missing__(self, word: str) -> int:
        n = 1 if word in self.bpe.special else self.automaton.count(self.bpe.symbols(word))
        if len(word) <= bpe.CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` of every whole text, in one narrow pass."""
    path = vocabulary or bpe.default_vocabulary()
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def run(texts: list[bytes | None]) -> list:
        counter, words, tokens = load(path), [], []
        for text in texts:
            found = counter.bpe.words((text or b"").decode("utf-8", "replace"))
            words.append(len(found))
            tokens.append(sum(map(counter.__getitem__, found)))
        return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]

    return with_columns(docs, text_col, fields, run)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")
