"""Exact token counts of every prefix of a text, by dynamic programming over prefixes (operator 11).

A byte-level BPE cuts a text into pieces and merges within each piece. The encoding of a piece's prefix ends in exactly one token that may
stand after the encoding of what precedes it, so last token and count of every prefix follow from those of shorter ones. Pieces are joined
by what the cut does at the end of a shortened text: its last run of white space is one piece, and an unfinished contraction is two.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of chunks and of pieces that a worker remembers; the rest are found anew each time.
REMEMBERED = 1_000_000
#: Pairs of tokens that a worker remembers before it begins anew.
PAIRS = 2_000_000
#: Code points of a batch that a task gives back at once.
BATCH = 1 << 21
#: The contractions that byte-level BPE cuts off; fixed values.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: A run of white space with what follows it.
_UNIT = regex.compile(rf"(?:\s++(?<! ))?(?:{'|'.join(CONTRACTIONS)})|\s*+(?:\p{{L}}++|\p{{N}}++|[^\s\p{{L}}\p{{N}}]++)|\s++")
_SPACE = regex.compile(r"\s*+")
#: A space next to other white space; without one, a text falls into chunks before its spaces.
_MIXED = regex.compile(r" (?:\s|$)|\s ")
#: Characters outside these blocks may have joined their class after the library's tables were made: the library then cuts the text.
_LATER = regex.compile(r"[^\u0000-\u052F\u2000-\u206F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]")
_NEVER = 1 << 60
_counters: dict[str, Counter] = {}


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts the tokens of every prefix as the tokenizers library would encode it (no added special tokens; those in a text count as the library has it)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, cut = made["model"], made["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or made["normalizer"] or odd:
            raise ValueError(f"{path} is no plain byte-level BPE")
        added = made["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} has added tokens that take in what stands around them")
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.names = list(model["vocab"])
        self.step = len(self.names)
        self.tokens = ahocorasick.Automaton()
        for i, token in enumerate(self.names):
            self.tokens.add_word(token, (len(token), i))
        self.tokens.make_automaton()
        self.rank: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(model["merges"]):
            self.rank[tuple(pair) if isinstance(pair, list) else tuple(pair.split(" "))] = i
        self.letters = dict(enumerate(_byte_letters()))
        self.spines: dict[str, tuple[list, list] | None] = {}
        self.allowed: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _spine(self, token: str) -> tuple[list, list] | None:
        """The symbols at the left and at the right end of a token while merges make it, each with the rank of the merge that ends it; None if merges don't make it."""
        if token in self.spines:
            return self.spines[token]
        parts: list = [(c, None, _NEVER) for c in token]
        while len(parts) > 1:
            rank, at = min((self.rank.get((x[0], y[0]), _NEVER), i) for i, (x, y) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], (parts[at], parts[at + 1]), rank)]
        found = None
        if len(parts) == 1:
            found = ([], [])
            for side in (0, 1):
                node, until = parts[0], _NEVER
                while node:
                    found[side].append((node[0], until))
                    node, until = (node[1][side] if node[1] else None), node[2]
        self.spines[token] = found
        return found

    def _may_follow(self, first: str, second: str) -> bool:
        """Whether no merge crosses the border of the two tokens: a crossing one would have to come before both of its symbols are merged elsewhere."""
        right = self._spine(second)
        if not first or not right:
            return bool(right)
        left = self._spine(first)
        return not any((r := self.rank.get((x, y), _NEVER)) < until_x and r <= until_y and r < _NEVER for x, until_x in left[1] for y, until_y in right[0])

    def _judge(self, pair: int) -> bool:
        """_may_follow for places in the list of tokens, -1 for no token before; remembered."""
        if len(self.allowed) > PAIRS:
            self.allowed.clear()
        first, second = divmod(pair, self.step)
        may = self.allowed[pair] = self._may_follow(self.names[first] if first >= 0 else "", self.names[second])
        return may

    def piece(self, text: str) -> list[int]:
        """Tokens of each prefix of one piece, by code points.

        An automaton finds every token that occurs, by the place where it ends. The last token before a place is settled by the first that may
        follow what stands before it; no other can.
        """
        data = text.encode().decode("latin-1").translate(self.letters)
        n, get = len(data), self.allowed.get
        last, count = [-1, *[None] * n], [0] * (n + 1)
        for end, (size, token) in self.tokens.iter(data):
            end += 1
            if last[end] is None:
                pair = last[end - size] * self.step + token
                may = get(pair)
                if may is None:
                    may = self._judge(pair)
                if may:
                    last[end], count[end] = token, count[end - size] + 1
        if n == len(text):
            return count[1:]
        at, found = 0, []
        for c in text:
            at += len(c.encode())
            found.append(count[at])
        return found

    def _unit(self, unit: str) -> bytes:
        """By how much each code point of a run of white space and of what follows it changes the count."""
        known = self.units.get(unit)
        if known is not None:
            return known
        edge = _SPACE.match(unit).end()
        gap, body = unit[:edge], unit[edge:]
        if not body or gap == " ":
            counts = self.piece(unit)
        else:
            taken = gap.endswith(" ")  # the space belongs to the piece that follows
            before = gap[:-1] if taken else gap
            counts, base = self.piece(gap), 0
            for part in [before] if taken else [before[:-1], before[-1:]]:
                base += self.piece(part)[-1] if part else 0
            inner = self.piece(" " + body if taken else body)
            if body in CONTRACTIONS and not taken and len(body) > 2:
                inner[1] = inner[0] + self.piece(body[1])[-1]  # unfinished, its letter is a piece of its own
            counts += [base + x for x in (inner[1:] if taken else inner)]
        steps = array("h", [x - y for x, y in zip(counts, [0, *counts[:-1]], strict=True)]).tobytes()
        if len(self.units) < REMEMBERED:
            self.units[unit] = steps
        return steps

    def _units(self, text: str) -> list[str]:
        if not _LATER.search(text):
            return _UNIT.findall(text)
        units, gap = [], ""
        for _, (low, high) in self.cutter.pre_tokenize_str(text):
            gap += text[low:high]
            if _SPACE.match(gap).end() < len(gap):
                units.append(gap)
                gap = ""
        return [*units, gap] if gap else units

    def _plain(self, text: str) -> bytes:
        """Steps of a text without added tokens."""
        if _MIXED.search(text):
            return b"".join([self._unit(u) for u in self._units(text)])
        first, *rest = text.split(" ")
        known, parts = self.chunks, []
        for chunk in ([first] if first else []) + [" " + x for x in rest]:
            steps = known.get(chunk)
            if steps is None:
                steps = b"".join([self._unit(u) for u in self._units(chunk)])
                if len(known) < REMEMBERED and len(chunk) < 64:
                    known[chunk] = steps
            parts.append(steps)
        return b"".join(parts)

    def steps(self, text: str) -> np.ndarray:
        """By how much each code point changes the count; the running sum is the count of every prefix."""
        found = list(self.added.finditer(text)) if self.added else []
        parts, low = [], 0
        for token in found:
            # until its last character an added token is plain text
            parts.append(np.frombuffer(self._plain(text[low : token.end() - 1]), np.int16))
            whole = int(np.frombuffer(self._plain(text[low : token.start()]), np.int16).sum(dtype=np.int64)) + 1
            parts.append(np.array([whole - int(parts[-1].sum(dtype=np.int64))], np.int16))
            low = token.end()
        parts.append(np.frombuffer(self._plain(text[low:]), np.int16))
        return np.concatenate(parts) if found else parts[0]


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text, prefix_tokens for every row of docs (doc_id, text): prefix_tokens[i] is the number of tokens of the text's first i code points
    (from 1 on), exactly as the tokenizers library encodes that prefix with the byte-level BPE in the file tokenizer.

    A null text stays null and has an empty array, as an empty text has. Texts are taken whole, whatever their length. Rows with equal or null
    ids are rows of their own; doc_id may be of any type; extra columns are left out whatever their names; an empty table gives an empty result.
    Counts may fall from one prefix to the next, where a character completes a longer token.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            low, sizes, parts = 0, [0], []
            texts = batch.column(1)
            for at in range(batch.num_rows):
                parts.append(np.cumsum(counter.steps(texts[at].as_py() or ""), dtype=np.int32))
                sizes.append(sizes[-1] + len(parts[-1]))
                if sizes[-1] >= BATCH or at + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
                    some = batch.slice(low, at + 1 - low)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists], names=["doc_id", "text", "prefix_tokens"])
                    low, sizes, parts = at + 1, [0], []

    return rows.mapInArrow(count, f"doc_id {kind}, text string, prefix_tokens array<int>")


def tokens_before(position: Column | str = "position", counts: Column | str = "prefix_tokens") -> Column:
    """Tokens of the first position code points; beyond the end those of the whole text, 0 at 0 and below."""
    at = F.least(F.col(position) if isinstance(position, str) else position, F.size(counts))
    return F.when(at <= 0, 0).otherwise(F.try_element_at(counts, F.greatest(at, F.lit(1)).cast("int")))


def total_tokens(counts: Column | str = "prefix_tokens") -> Column:
    return F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0)).cast("long")


def longest_prefix(budget: int, counts: Column | str = "prefix_tokens") -> Column:
    """Code points of the longest prefix of at most budget tokens."""
    fits = F.transform(counts, lambda x, i: F.when(x <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))


def truncate_texts(counted: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_tokens (of the whole text), kept_chars, kept_tokens and the longest prefix of at most budget tokens as text, from the rows of prefix_counts; nothing is encoded
    again."""
    cut = counted.withColumn("kept_chars", longest_prefix(budget))
    return cut.select("doc_id", total_tokens().alias("n_tokens"), "kept_chars", tokens_before("kept_chars").cast("long").alias("kept_tokens"), F.substring("text", F.lit(1), F.col("kept_chars")).alias("text"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), n_tokens, over_limit (n_tokens > limit) from prefix_counts, with its treatment of nulls and of awkward rows."""
    counted = prefix_counts(docs, tokenizer).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), total_tokens().alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
