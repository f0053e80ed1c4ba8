"""Token counts by a compiled finite-state tokenizer.

Two transducers replace the tokenizer. The splitter has five states over classes of characters; it marks where a
word-like piece of the vocabulary's pattern begins. Texts are cut into chunks, each chunk becomes a map from every
entry state to an exit state, and the maps are composed by a parallel prefix scan, so no chunk waits for the one before
it. The merger works on one piece: its states say which tokens can still end a piece and what has been emitted before
them, and each transition carries the number of tokens that it emits. Its states are made when first met.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.llm.common import text_batches

CHUNK = 64
#: Compiled transitions and counted pieces that a Python worker keeps; beyond it they start anew.
KEPT = 400_000

SPACE, LETTER, DIGIT, OTHER, SHORT, LONG = range(6)
START, IN_LETTERS, IN_OTHERS, ONE_MORE, TWO_MORE = range(5)
_STATES = 5
#: Next state and "a piece begins here", by state and class. SHORT and LONG are an apostrophe before a contraction of
#: one or two letters; inside a run of other characters it belongs to the run.
NEXT = np.array([
    [START, IN_LETTERS, START, IN_OTHERS, ONE_MORE, TWO_MORE],
    [START, IN_LETTERS, START, IN_OTHERS, ONE_MORE, TWO_MORE],
    [START, IN_LETTERS, START, IN_OTHERS, IN_OTHERS, IN_OTHERS],
    [START, START, START, START, START, START],
    [START, ONE_MORE, ONE_MORE, ONE_MORE, ONE_MORE, ONE_MORE],
], dtype=np.uint8)
BEGINS = np.array([
    [0, 1, 1, 1, 1, 1],
    [0, 0, 1, 1, 1, 1],
    [0, 1, 1, 0, 0, 0],
    [0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 0],
], dtype=bool)

#: Unicode white space, and the contractions of the vocabulary's pattern.
WHITE_SPACE = ("\t\n\v\f\r \x85\xa0            "
               "    　")
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = DIGIT
    table[[ord(c) for c in WHITE_SPACE]] = SPACE
    return table


def classes_of(codes: np.ndarray) -> np.ndarray:
    """Class of each character, with apostrophes looked at together with the two characters after them."""
    table = _classes()
    kinds = table[codes]
    quotes = np.flatnonzero(codes == ord("'"))
    if len(quotes):
        padded = np.append(codes, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        for word in CONTRACTIONS:
            if len(word) == 1:
                kinds[quotes[one == ord(word)]] = SHORT
            else:
                kinds[quotes[(one == ord(word[0])) & (two == ord(word[1]))]] = LONG
    return kinds


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps (rows), by doubling: row i maps an entry state through rows 0..i."""
    maps = maps.copy()
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2
    return maps


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """True where a piece begins."""
    n = len(codes)
    lanes = -(-n // CHUNK)
    kinds = np.zeros(lanes * CHUNK, dtype=np.uint8)
    kinds[:n] = classes_of(codes)
    columns = np.ascontiguousarray(kinds.reshape(lanes, CHUNK).T).astype(np.intp)
    flat = NEXT.ravel().astype(np.intp)
    states = np.tile(np.arange(_STATES), (lanes, 1))
    for column in columns:
        states = flat[states * 6 + column[:, None]]
    entry = np.zeros(lanes, dtype=np.intp)
    entry[1:] = compose_scan(states.astype(np.uint8))[:-1, START]
    begins = np.empty((CHUNK, lanes), dtype=bool)
    marks = BEGINS.ravel()
    for i, column in enumerate(columns):
        at = entry * 6 + column
        begins[i] = marks[at]
        entry = flat[at]
    return begins.T.ravel()[:n]


class Merger:
    """The merge rules of a byte-pair vocabulary with word ends as a transducer over the bytes of one piece.

    Tokens of a text's prefix are a prefix of nothing that later bytes could change, except for its last tokens. So a
    state holds, for each suffix that begins some token, the last token before that suffix and the tokens emitted up to
    there. A byte is read by taking the one token that ends with it and that the rules allow behind the token before.
    """

    def __init__(self, merges: list[tuple[str, str]], end: str):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.end = end
        tokens = {a + b for a, b in merges}
        self.by_length = tokens
        self.begins = {t[:i] for t in tokens for i in range(1, len(t))}
        self.joined: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.states.clear()
        self.content.clear()
        self.steps.clear()
        self._state((("", "", 0),))

    def _state(self, content: tuple) -> int:
        found = self.states.get(content)
        if found is None:
            found = self.states[content] = len(self.content)
            self.content.append(content)
        return found

    def merged(self, symbols: list[str]) -> list[str]:
        """The rules applied as they are defined: the best-ranked pair, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: self.ranks.get(p, len(self.ranks)))
            if best not in self.ranks:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _letters(self, token: str) -> list[str]:
        if token.endswith(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def allowed(self, before: str, token: str) -> bool:
        """Whether the rules leave ``token`` as it is right behind ``before`` (empty: at the start)."""
        key = (before, token)
        known = self.joined.get(key)
        if known is None:
            if before:
                known = (self.allowed("", before) and self.allowed("", token)
                         and self.merged(self._letters(before) + self._letters(token)) == [before, token])
            else:
                known = self.merged(self._letters(token)) == [token]
            if len(self.joined) > 4 * KEPT:
                self.joined.clear()
            self.joined[key] = known
        return known

    def step(self, state: int, symbol: str, last: bool) -> tuple[int, int]:
        """Next state and tokens emitted on reading ``symbol``; ``last``: it ends the piece."""
        key = (state, symbol + self.end if last else symbol)
        known = self.steps.get(key)
        if known is not None:
            return known
        read = key[1]
        emitted = None
        for suffix, before, count in self.content[state]:
            token = suffix + read
            if (not suffix or token in self.by_length) and self.allowed(before, token):
                emitted = (token, count + 1)
                break
        if emitted is None:
            raise AssertionError("no token ends here")
        token, count = emitted
        if last:
            known = (0, count)
        else:
            live = [(s + symbol, b, c - count) for s, b, c in self.content[state] if s + symbol in self.begins]
            known = (self._state((*live, ("", token, 0))), count)
        self.steps[key] = known
        return known

    def count(self, piece: str) -> int:
        """Tokens of one piece, given as the vocabulary's byte characters."""
        if len(self.steps) > KEPT:
            self._forget()
        state = total = 0
        steps, final = self.steps, len(piece) - 1
        for i, symbol in enumerate(piece):
            known = steps.get((state, symbol)) if i < final else None
            state, emitted = known or self.step(state, symbol, i == final)
            total += emitted
        return total


def _byte_characters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself, or the next one above 255."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class CompiledTokenizer:
    """Counts tokens of whole texts as the library does for one vocabulary file with lower-casing and word ends."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        pairs = [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in model["model"]["merges"]]
        self.merger = Merger(pairs, model["model"]["end_of_word_suffix"])
        self.normal = Tokenizer.from_file(path).normalizer
        special = [re.escape(x["content"]) for x in model["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.byte = _byte_characters()
        self.counts: dict[str, int] = {}

    def _normalised(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return self.normal.normalize_str(text)

    def _piece(self, piece: str) -> int:
        return self.merger.count("".join([self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]))

    def count(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        parts, owners = [], []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                counts[i] = len(self.special.findall(text))
                for part in self.special.split(text):
                    parts.append(self._normalised(part))
                    owners.append(i)
            else:
                parts.append(self._normalised(text))
                owners.append(i)
        for start, stop in text_batches(parts):
            for i, n in zip(owners[start:stop], self._count(parts[start:stop])):
                counts[i] += n
        return counts

    def _count(self, parts: list[str]) -> list[int]:
        joined = "\n".join(parts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        starts = np.flatnonzero(piece_starts(codes))
        solid = np.maximum.accumulate(np.where(_classes()[codes] == SPACE, 0, np.arange(1, len(codes) + 1)))
        ends = solid[np.append(starts[1:], len(codes)) - 1]
        if len(self.counts) > KEPT:
            self.counts.clear()
        known = self.counts
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        for piece in set(pieces) - known.keys():
            known[piece] = self._piece(piece)
        each = np.zeros(len(pieces) + 1, dtype=np.int64)
        each[1:] = [known[x] for x in pieces]
        sums = each.cumsum()
        bounds = np.cumsum([len(x) + 1 for x in parts])
        upto = sums[np.searchsorted(starts, bounds)]
        return np.diff(upto, prepend=0).tolist()


@lru_cache(maxsize=2)
def compiled(path: str) -> CompiledTokenizer:
    return CompiledTokenizer(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row, without any shuffle.

    Null text counts as empty and has no tokens; ids pass through, nulls and repeated rows included.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        tool = compiled(tokenizer)
        for batch in batches:
            counts = tool.count(batch.column("text").to_pylist())
            yield batch.append_column("n_tokens", pa.array(counts, pa.int64()))

    counted = source.mapInArrow(run, "doc_id long, text string, n_tokens long")
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
