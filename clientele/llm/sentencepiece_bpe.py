"""SentencePiece BPE encoding by backtracking, and decoding.

The encoder never merges from single letters upward. At each position it takes the longest piece that an Aho-Corasick
automaton finds there, provided that it is compatible with the token before (merging the two tokens' text again gives
just these two); if nothing fits it steps back, and a bitfield keeps the positions from which no way leads to the end. The
first sequence of pairwise compatible tokens is the one that merging by score would give.

No piece of the vocabulary holds a space mark behind another character (checked when the model is read), so a text is cut
before each space mark that follows one, and equal parts of a batch are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

MARK = "▁"
PART = re.compile(MARK + "*[^" + MARK + "]+|" + MARK + "+")
NONE = float("-inf")             # score of a pair that is no piece
KEPT = 200_000                   # remembered parts per worker, in each of two generations; one chunk of texts may come on top
LONG = 64                        # longer parts are not remembered
PAIRS = 500_000                  # remembered compatibility checks per worker


class Codec:
    """Encoder and decoder of one model file (BPE, byte fallback, no normalisation but the space mark)."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece as spm
        sp = spm.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.ids: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark inside; texts can't be cut there")
        if len(self.byte_of) != 256 or sp.encode("   a  ", out_type=str) != [MARK, *sp.encode("   a  ", out_type=str)[1:]]:
            raise ValueError("expected byte fallback, a leading space mark and no normalisation")
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.auto = ahocorasick.Automaton()
        self.usable = {p for p in self.ids if self.merge(p) == [p]}        # pieces that merging can give at all
        for p in self.usable:
            self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        self.shorter = {p: self._next_prefix(p) for p in self.usable}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.known: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _next_prefix(self, piece: str) -> str | None:
        """The longest piece that is a shorter prefix of this one."""
        for k in range(len(piece) - 1, 0, -1):
            if piece[:k] in self.usable:
                return piece[:k]
        return None

    def merge(self, text: str) -> list[str]:
        """Merging by score, best pair first, leftmost of equals: the definition, used for compatibility checks and tests."""
        part, score = list(text), self.score.get
        joint = [score(a + b, NONE) for a, b in zip(part, part[1:])]
        while joint:
            best = max(joint)
            if best == NONE:
                break
            i = joint.index(best)
            part[i:i + 2] = [part[i] + part[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = score(part[i - 1] + part[i], NONE)
            if i < len(joint):
                joint[i] = score(part[i] + part[i + 1], NONE)
        return part

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the text of two neighbouring tokens again leaves just these two."""
        row = self.pairs.get(a)
        if row is None:
            row = self.pairs[a] = {}
        got = row.get(b)
        if got is None:
            self.n_pairs += 1
            if self.n_pairs > PAIRS:
                self.pairs, self.n_pairs = {a: (row := {})}, 1
            got = row[b] = self.merge(a + b) == [a, b]
        return got

    def greedy(self, part: str) -> list[str] | None:
        """The longest match at each position, if these are compatible throughout: then no step back is needed."""
        tokens, at, last, row = [], 0, None, None
        for end, size in self.auto.iter_long(part):
            if end - size + 1 != at:
                return None
            token = part[at:end + 1]
            if last is not None:
                row = self.pairs.get(last)
                fits = None if row is None else row.get(token)
                if not (self.compatible(last, token) if fits is None else fits):
                    return None
            tokens.append(token)
            last, at = token, end + 1
        return tokens if at == len(part) else None

    def backtrack(self, part: str) -> list[str]:
        """Tokens of a part; characters outside the vocabulary stand alone."""
        tokens = self.greedy(part)
        return self.search(part) if tokens is None else tokens

    def search(self, part: str) -> list[str]:
        """The backtracking search."""
        n, reach, pairs, shorter = len(part), [0] * len(part), self.pairs, self.shorter
        for end, size in self.auto.iter(part):
            if size > reach[end - size + 1]:
                reach[end - size + 1] = size
        failed, tokens, at, last = 0, [], 0, None                  # last: the token before, if it is a piece
        token = part[:reach[0]] if n and reach[0] else None
        while at < n:
            if not reach[at]:                                      # an unknown character: nothing merges with it
                tokens.append(part[at])
                at, last = at + 1, None
                token = part[at:at + reach[at]] if at < n and reach[at] else None
                continue
            while token is not None:
                end = at + len(token)
                if not failed >> end & 1:
                    if last is None:
                        break
                    row = pairs.get(last)
                    fits = None if row is None else row.get(token)
                    if self.compatible(last, token) if fits is None else fits:
                        break
                    pairs = self.pairs
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                at, last = end, token
                token = part[at:at + reach[at]] if at < n and reach[at] else None
            else:                                                  # no way on from here: take the last token back
                failed |= 1 << at
                back = tokens.pop()
                at -= len(back)
                last = tokens[-1] if tokens and tokens[-1] in self.ids else None
                token = shorter[back]
        return tokens

    def part(self, part: str) -> tuple[str, int, str]:
        """Of a part: its ids joined by commas, their number, and the text they decode to."""
        tokens = self.backtrack(part)
        try:
            ids = [self.ids[token] for token in tokens]
            text = "".join(tokens).replace(MARK, " ")
        except KeyError:                                           # characters outside the vocabulary become bytes
            ids = [i for token in tokens for i in ([self.ids[token]] if token in self.ids else map(self.byte_ids.__getitem__, token.encode()))]
            text = self.decode(ids, first=False)
        return ",".join(map(str, ids)), len(ids), text

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; byte ids are gathered and read as UTF-8, bad bytes become U+FFFD; one leading space goes."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.hidden:
                out.append(self.pieces[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if first and text.startswith(" ") else text

    def lines(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """Ids joined by commas, number of ids and decoded text of whole texts."""
        out = []
        for a, z in K.chunks([len(t) for t in texts], K.CHUNK):
            if len(self.known) > KEPT:
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            for t in texts[a:z]:
                if not t:
                    out.append(("", 0, ""))
                    continue
                done = []
                for p in PART.findall(MARK + t.replace(" ", MARK)):
                    got = known.get(p)
                    if got is None:
                        got = older.get(p) or self.part(p)
                        if len(p) <= LONG:
                            known[p] = got
                    done.append(got)
                ids, counts, words = zip(*done)
                text = "".join(words)
                out.append((",".join(ids), sum(counts), text[1:] if text.startswith(" ") else text))
        return out

    def encode(self, text: str) -> list[int]:
        line = self.lines([text])[0][0]
        return [int(i) for i in line.split(",")] if line else []


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def _apply(docs: DataFrame, path: str, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield make(batch, own.lines(K.texts_of(batch)))
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int), one row per input row; null and empty texts have no ids."""
    def make(batch, lines):
        ids = [np.array(x[0].split(","), np.int32) if x[0] else np.zeros(0, np.int32) for x in lines]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return _apply(docs.select("doc_id", "text"), path, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>", make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: one row per input row.

    Null texts count as empty: 0 tokens, digests of the empty string. Repeated rows give repeated results; other columns
    are not read.
    """
    def make(batch, lines):
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([x[1] for x in lines], pa.int64()), pa.array([sha256(x[0].encode()).hexdigest() for x in lines]),
             pa.array([sha256(x[2].encode()).hexdigest() for x in lines])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = dict(docs.dtypes)["doc_id"]
    return _apply(docs.select("doc_id", "text"), path, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
