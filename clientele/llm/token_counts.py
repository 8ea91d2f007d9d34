"""Token counts by a public tokenizer, as lengths only.

Inside Arrow functions every text is cut at ASCII white space, which no token of the supported tokenizers spans, so very
long texts never reach the tokenizer whole. The distinct pieces of a batch are encoded in calls balanced by bytes; their
lengths are added up per text. A bounded memory of frequent pieces lives in the worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

PIECE = re.compile(r"[^\x20\x09-\x0D]+")
KEPT = 300_000                   # remembered pieces per worker; one chunk of texts may come on top
CALL_BYTES = 1 << 18             # bytes of one call of the tokenizer


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _memory(path: str) -> dict[str, int]:
    return {}


def cuts_at_spaces(path: str) -> bool:
    """Whether pieces between white space can be encoded alone: the tokenizer drops white space before it looks for words.

    That holds if its only pre-splitting step is a pattern that keeps no white space; other tokenizers get whole texts.
    """
    import json
    spec = json.loads(_tokenizer(path).to_str())
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    pattern = str((steps[0].get("pattern") or {}).get("Regex", " ")) if steps and steps[0]["type"] == "Split" else " "
    drops = bool(steps) and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and not re.search(r" |\\s[^\\]|\\s\+(?!.*\\p)", pattern.replace(r"[^\s", "[^"))
    return bool(drops) and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] for s in steps[1:])


def piece_lengths(path: str, pieces: list[str]) -> list[int]:
    """Numbers of tokens of single pieces, by calls of about ``CALL_BYTES`` each."""
    tokenizer, out = _tokenizer(path), []
    for a, z in K.chunks([4 * len(p) for p in pieces], CALL_BYTES):
        out += map(len, tokenizer.encode_batch_fast(pieces[a:z], add_special_tokens=False))
    return out


def lengths(path: str, texts: list[str], apart: bool = True) -> np.ndarray:
    """Tokens per text."""
    if not apart:
        return np.array(piece_lengths(path, texts), np.int64)
    known, out = _memory(path), np.zeros(len(texts), np.int64)
    for a, z in K.chunks([len(t) for t in texts], 4 * K.CHUNK):
        if len(known) > KEPT:
            known.clear()
        split = [PIECE.findall(t) for t in texts[a:z]]
        fresh = {p for line in split for p in line}
        fresh.difference_update(known)
        order = sorted(fresh, key=len)
        known.update(zip(order, piece_lengths(path, order)))
        for i, line in enumerate(split, a):
            out[i] = sum(map(known.__getitem__, line))
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``: one row per input row.

    Null texts count as empty (0 tokens); repeated rows count alike; other columns are not read. Special strings inside
    texts are handled as the tokenizer's default; none is added.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        apart = cuts_at_spaces(path)
        for batch in batches:
            texts = K.texts_of(batch)
            n = lengths(path, texts, apart)
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
