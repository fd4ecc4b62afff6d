"""Token counts of whole texts with a public byte-level BPE vocabulary.

The number of tokens of a text is the sum over its pre-tokens, so lengths are looked up,
not encoded.  Tier one is a broadcast hash table of pre-tokens that are frequent by
construction: the vocabulary's own entries, the most frequent strings of the text it was
made from.  Its size is that of the vocabulary.  Tier two is a bounded cache in each
Python worker; only a pre-token in neither is encoded.  No pre-token leaves its task, and
the data are read once.

Pre-tokens are cut by the standard library's ``re`` where a text has only characters
whose classes are plain, and by the tokenizer's own splitter elsewhere.

Defined cases: a null text counts as empty, 0 tokens; a special string inside a text is
one token, the library's default; rows are counted one by one, so repeated rows, ties and
null ids need no rule; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS = 512
CACHE_ENTRIES = 400_000
BLOCK_CHARS = 1 << 19
# Characters whose letter, digit and space classes are the same in every Unicode version:
# printable ASCII, Latin-1 letters, Latin Extended-A and the basic Cyrillic block.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſЀ-џ"
_UNUSUAL = re.compile(rf"[^\t\n\r -~{_LETTERS}]")
_SPLIT = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Splitter and encoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take in their surroundings")
        names, letters = spec["model"]["vocab"], _byte_of_letter()
        self.special = [t["content"] for t in spec["added_tokens"]]
        for at, merge in enumerate(spec["model"]["merges"]):
            if names["".join(merge if isinstance(merge, list) else merge.split(" "))] != 256 + at:
                raise ValueError(f"{path} numbers its merges in another order")
        ranks = {bytes(letters[c] for c in name): k for name, k in names.items() if name not in self.special}
        self.library = Tokenizer.from_file(path)
        self._encode = tiktoken.Encoding(
            "own", pat_str=_SPLIT.pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.entries = ranks
        self._special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")

    def length(self, piece: str) -> int:
        """Tokens of one pre-token."""
        return len(self._encode(piece.encode()))

    def split(self, text: str) -> list[str]:
        if _UNUSUAL.search(text) is None:
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Number of special tokens in a text, and the texts between."""
        between = self._special.split(text)
        return len(between) - 1, between

    def frequent(self) -> dict[str, int]:
        """Lengths of the entries that are whole pre-tokens."""
        out = {}
        for raw in self.entries:
            try:
                piece = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self.split(piece) == [piece]:
                out[piece] = self.length(piece)
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lengths(dict):
    """Lengths of pre-tokens: the frequent ones and a bounded cache of others."""

    def __init__(self, words: Vocabulary, frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.words, self.frequent = words, frequent

    def __missing__(self, piece: str) -> int:
        if len(self) >= len(self.frequent) + CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        n = self.words.length(piece)
        if len(piece) < 64:
            self[piece] = n
        return n


def _blocks(text: str) -> Iterator[str]:
    """Pieces of a text cut where a pre-token must begin: at one space between two words."""
    at = 0
    while at < len(text):
        gap = _CUT.search(text, at + BLOCK_CHARS)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def count_tokens(text: str | None, lengths: Lengths) -> int:
    if not text:
        return 0
    total, between = lengths.words.parts(text)
    for part in between:
        for block in _blocks(part):
            total += sum(map(lengths.__getitem__, lengths.words.split(block)))
    return total


_CACHES: dict[str, Lengths] = {}


def token_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT_TOKENS,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row.

    ``path`` names the tokenizer file, which every machine must have.
    """
    path = path or default_vocabulary()
    table = docs.sparkSession.sparkContext.broadcast(vocabulary(path).frequent())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _CACHES.get(path)
        if lengths is None:
            lengths = _CACHES[path] = Lengths(vocabulary(path), table.value)
        for batch in batches:
            counts = pa.array([count_tokens(t.as_py(), lengths) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=[key, "n_bytes", "n_tokens"])

    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes")
    rows = docs.select(F.col(key), size, F.col(text))
    counted = rows.mapInArrow(
        run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
