"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A space between two characters that are neither space nor the mark. The vocabulary has no piece with a mark after
#: another character, so no piece can reach over it, and the text may be cut before it.
SAFE = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def _processor(model: bytes):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    inner = re.compile("[^▁]▁")
    cuttable = not any(inner.search(processor.id_to_piece(i)) for i in range(processor.get_piece_size()))
    probe = "a  b c\n d"
    plain = len(processor.encode(probe)) == len(processor.encode("a  b")) + len(processor.encode("c\n d"))
    return processor, cuttable and plain


def safe_parts(text: str, most_chars: int) -> list[str]:
    """Cut a text into parts of at least most_chars, each but the last ending before a safe space.

    The space at a cut goes: the processor puts one before every part.
    """
    parts, start = [], 0
    while len(text) - start > most_chars:
        cut = SAFE.search(text, start + most_chars)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 batch_bytes: int = 1 << 20, part_chars: int = 1 << 16) -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit (more tokens than limit).

    A null text counts as empty and has 0 tokens. Repeated rows and null ids give a row each; an empty table gives none.
    Other columns are ignored. Each call to the library gets about batch_bytes of text, and texts over part_chars are
    encoded in parts cut where no piece can reach over.
    """

    def count(batches):
        processor, cuttable = _processor(model)
        for batch in batches:
            for part in slices(batch, "text", batch_bytes):
                texts = part.column(1).to_pylist()
                whole, owner = [], []
                for k, text in enumerate(texts):
                    for piece in safe_parts(text, part_chars) if cuttable else (text,):
                        whole.append(piece)
                        owner.append(k)
                counts = [0] * len(texts)
                for k, ids in zip(owner, processor.encode(whole, num_threads=1)):
                    counts[k] += len(ids)
                size = pc.binary_length(part.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
