"""BPE encoding and decoding (operator 1): a backtracking encoder and offset-table decoding.

The encoder finds, for every position of a word, the longest token that starts there (an Aho-Corasick pass over the
reversed word), then walks left to right. A token is accepted only if it is compatible with the token before it,
that is, if the merges would indeed have produced this pair; otherwise the next shorter token is tried, and if none
is left the walk goes back one token. This gives exactly the merges' result without a merge queue.
Decoding gathers byte ranges by an offset table. Word results are kept in a bounded per-worker cache.

Defined cases: a null text encodes like an empty one (no ids, empty decoded text); texts of any length are encoded
whole; equal texts give equal results; every other input column passes through except those that have the name of a
result column, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from idloom.llm.common import CACHE_WORDS, table, with_columns

#: Words longer than this are not cached, so that the cache's memory is bounded.
CACHE_CHARS = 64
#: Bounds the memory of the memo over pairs.
PAIR_MEMO = 1_000_000
#: First character that stands for a word's last byte; characters 0-255 stand for the others.
LAST = 256
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """Printable letter -> byte, by the usual rule of byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ranges:
    """An offset table: entry i is ``blob[start[i] : start[i] + size[i]]``."""

    def __init__(self, entries: list[bytes]):
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all entries in a row, end offset of each)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        at = np.repeat(self.start[ids] - (ends - size), size)
        at += np.arange(total)
        return self.blob[at], ends


class WordBpe:
    """Encoder and decoder for a word-level BPE vocabulary with a word-end mark (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters, mark = spec["model"], byte_letters(), spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        strings = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        self.find_words = regex.compile(rf"{contractions}|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+").findall
        # tokens as strings of symbols
        self.token = {}
        for s, i in model["vocab"].items():
            body, last = (s[: -len(mark)], True) if s.endswith(mark) and len(s) > len(mark) else (s, False)
            symbols = [letters[c] for c in body]
            if last:
                symbols[-1] += LAST
            self.token["".join(map(chr, symbols))] = i
        self.length = {i: len(s) for s, i in self.token.items()}
        self.shorter = {i: next((self.token[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.token), -1) for s, i in self.token.items()}
        vocab = model["vocab"]
        self.pair, self.parts = {}, {}
        for rank, (a, b) in enumerate(model["merges"]):
            made = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = made
            self.parts[made] = vocab[a], vocab[b]
            if made != vocab[model["merges"][0][0] + model["merges"][0][1]] + rank:
                raise ValueError("ids must follow the order of the merges")
        self.matcher = ahocorasick.Automaton()
        for s, i in self.token.items():
            self.matcher.add_word(s[::-1], (len(s), i))
        self.matcher.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        ids = range(max(strings) + 1)
        self.texts = Ranges([strings[i].encode() + b" " for i in ids])
        self.decimals = Ranges([b"%d " % i for i in ids])

    def words(self, text: str) -> list[str]:
        """Pieces that are encoded on their own; special tokens stay whole."""
        if self.split_special and "<|" in text:
            out: list[str] = []
            for part in self.split_special(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find_words(text.lower())

    def symbols(self, word: str) -> str:
        data = word.encode()
        return data[:-1].decode("latin-1") + chr(data[-1] + LAST)

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side: undo merges at the seam, newest first, and look for
        one across the seam that would have come before the merge just undone."""
        key = a, b
        known = self.compatible.get(key)
        if known is not None:
            return known
        pair, parts, before, fits = self.pair, self.parts, float("inf"), True
        while True:
            if pair.get((a, b), before) < before:
                fits = False
                break
            # undo the newer of both tokens; a merge across the seam had to be older than it (at its left: or equal)
            if a > b and a in parts:
                before, a = a, parts[a][1]
            elif b in parts:
                before, b = b + 1, parts[b][0]
            elif a in parts:
                before, a = a, parts[a][1]
            else:
                break
        if len(self.compatible) >= PAIR_MEMO:
            self.compatible.clear()
        self.compatible[key] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        s = self.symbols(word)
        whole = self.token.get(s)
        n, longest = len(s), [0] * (len(s) + 1)
        width = [0] * n
        for end, (size, i) in self.matcher.iter(s[::-1]):
            at = n - 1 - end
            if size > width[at]:
                width[at], longest[at] = size, i
        if whole is not None and longest[0] == whole:
            return [whole]
        out: list[int] = []
        dead, at, token = set(), 0, longest[0]
        while at < n:
            end = at + self.length[token]
            if end not in dead and (not out or self._fits(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
                continue
            token = self.shorter[token]
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return out

    def __missing(self, word: str) -> bytes:
        ids = np.array(self.encode_word(word), np.int32).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: bytes | None) -> np.ndarray:
        """Ids of a whole text."""
        words, get = self.words((text or b"").decode("utf-8", "replace")), self.cache.get
        found = list(map(get, words))
        if None in found:
            found = [x if x is not None else (get(w) or self.__missing(w)) for w, x in zip(words, found, strict=True)]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids: token strings joined by one space (this vocabulary has no decoder of its own)."""
        return self.texts.gather(ids)[0][:-1].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` array<int> of every whole text."""
    path = vocabulary or default_vocabulary()
    return with_columns(docs, text_col, [T.StructField("token_ids", T.ArrayType(T.IntegerType()))], lambda texts: [pa.array([load(path).encode(x) for x in texts], pa.list_(pa.int32()))])


def decode(rows: DataFrame, vocabulary: str | None = None, ids_col: str = "token_ids") -> DataFrame:
    """``rows`` with ``decoded`` string of every id list; null ids decode to an empty text."""
    path = vocabulary or default_vocabulary()
    names = [c for c in rows.columns if c != "decoded"]
    rows = rows.select(*[f"`{c}`" for c in names])
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(names.index(ids_col)).to_pylist()
            texts = [load(path).decode(np.array(x or [], np.int32)).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and the SHA-256 of the decimal ids and of the decoded text, in one narrow pass."""
    path = vocabulary or default_vocabulary()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(texts: list[bytes | None]) -> list:
        bpe = load(path)
        each = [bpe.encode(x) for x in texts]
        last = np.cumsum([len(x) for x in each])
        ids = np.concatenate(each) if each else np.empty(0, np.int32)

        def hashed(ranges: Ranges) -> list[str]:
            data, ends = ranges.gather(ids)
            view, out, start = memoryview(data), [], 0
            for stop in last:
                end = int(ends[stop - 1]) if stop else 0
                out.append(hashlib.sha256(view[start : max(end - 1, start)]).hexdigest())
                start = max(end, start)
            return out

        return [pa.array([len(x) for x in each], pa.int64()), pa.array(hashed(bpe.decimals)), pa.array(hashed(bpe.texts))]

    return with_columns(docs, text_col, fields, run)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
