"""Token counts: Arrow functions encode batches of about equal bytes and return lengths only.

Texts are cut at safe boundaries, where the tokenizer cannot merge across: before a lone space between two characters that aren't
white space. A pre-token ends there whatever precedes it, and no special string may contain a space (checked), so the
counts of the pieces add up to the text's. Equal pieces are encoded once while they are remembered; the memory is bounded.
A text without such a place stays whole.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SAFE = re.compile(r"(?<=\S)(?= \S)")
_OTHER = re.compile(r" \s|\s |\0|^ | $")
MEMORY = 32 << 20  # bytes of remembered pieces, their overhead included


def pieces(text: str) -> list[str]:
    """text cut at its safe boundaries."""
    return SAFE.split(text) if _OTHER.search(text) else text.replace(" ", "\0 ").split("\0")


def batches_of(parts: list[str], most: int) -> Iterator[list[str]]:
    """parts in runs of about `most` bytes."""
    a, size = 0, 0
    for z, part in enumerate(parts, 1):
        size += len(part) if part.isascii() else len(part.encode())
        if size >= most or z == len(parts):
            yield parts[a:z]
            a, size = z, 0


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Special strings inside texts count as the tokenizer's default has it."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    if spaced := [x["content"] for x in json.loads(model).get("added_tokens", []) if re.search(r"\s", x["content"])]:
        raise ValueError(f"special strings with white space: {spaced}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok, known, held = None, {}, 0
        for b in common.slices(batches):
            tok = tok or Tokenizer.from_str(model)
            _, off = common.utf8(b.column(1))
            cut = [pieces(text) if text else [] for text in b.column(1).to_pylist()]
            new = set().union(*cut).difference(known)
            size = sum(120 + 2 * len(p) for p in new)
            if held + size > MEMORY:
                known, held, new = {}, 0, set().union(*cut)
                size = sum(120 + 2 * len(p) for p in new)
            held += size
            for part in batches_of(sorted(new, key=len), batch_bytes):
                known.update(zip(part, map(len, tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
            n = np.array([sum(map(known.__getitem__, own)) for own in cut], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.arrow_map(common.texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
