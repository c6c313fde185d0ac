"""Operator 1: token counts of whole texts.

Arrow batches go to a byte-level BPE tokenizer that returns lengths only.
Texts are cut where a pre-token must begin (before ASCII white space that
follows a printable character), so pieces can be counted apart; the counts of
pieces seen before are remembered, and the unseen ones are encoded in batches
that hold about the same number of bytes.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, resident, small_batches

#: A group of texts that is handled at once, and the pieces of one encode call.
GROUP_BYTES, ENCODE_BYTES = 2_000_000, 500_000
#: Remembered pieces per Python worker; beyond it the memory starts anew.
MEMORY_PIECES = 1_000_000

#: White space beyond the ASCII four: a cut next to it may not be a boundary.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
PIECE = re.compile("[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
#: Always a boundary, whatever stands around it.
PLAIN_BOUNDARY = re.compile("(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")


def pieces(text: str) -> list[str]:
    """Pieces of ``text`` whose token counts add up to that of the whole."""
    return PIECE.findall(text) if not ODD_SPACE.search(text) else PLAIN_BOUNDARY.split(text)


class Counter:
    """Counts tokens of pieces; lives as long as its Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        return resident(("token_counts", path), lambda: cls(path))

    def _encode(self, batch: list[str]) -> None:
        for piece, found in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
            self.known[piece] = len(found)

    def learn(self, unseen: set[str]) -> None:
        """Encode unseen pieces, by batches of about the same bytes."""
        if len(self.known) + len(unseen) > MEMORY_PIECES:
            self.known.clear()
        batch, held = [], 0
        for piece in unseen:
            batch.append(piece)
            held += len(piece)
            if held >= ENCODE_BYTES:
                self._encode(batch)
                batch, held = [], 0
        if batch:
            self._encode(batch)

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = [pieces(t) if t else [] for t in texts]
        used = set().union(*cut)
        unseen = used.difference(self.known)
        if unseen:
            if len(self.known) + len(unseen) > MEMORY_PIECES:
                unseen = used
            self.learn(unseen)
        get = self.known.__getitem__
        return [sum(map(get, c)) for c in cut]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Counts are those of the tokenizer file's own library without added special
    tokens, truncation or padding.  Null and empty texts have 0 bytes and 0
    tokens; a null id stays null; repeated rows give repeated results; an empty
    table gives an empty result; columns besides the two are not read.
    """

    def count(batches):
        counter = Counter.of(tokenizer_path)
        for whole in batches:
            for batch in byte_slices(whole, "text", GROUP_BYTES):
                n = counter.counts(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
