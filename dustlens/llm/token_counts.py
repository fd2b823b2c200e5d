"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustlens.llm.common import as_bytes, table, texts_of
from dustlens.llm.sentence_pieces import read_model

#: The vocabulary file, by the name under which the installed package of public tokenizers knows it.
MODEL = "piece_bpe_32k.model"
#: Bytes that go to the encoder at once, and the length from which a text is cut.
BATCH_BYTES, CUT_BYTES = 1 << 21, 1 << 14
TOKEN_LIMIT = 4096

_encoders: dict[str, Callable[[list[bytes]], list[int]]] = {}
_safe: dict[str, bool] = {}


def safe_to_cut(model: str) -> bool:
    """Whether ``cut`` holds for a model: it is a library file that takes texts as they are, and no piece of it crosses words."""
    if model not in _safe:
        import public_tokenizers

        own = model.endswith(".model")
        if own:
            with open(public_tokenizers.path(model), "rb") as f:
                rules = read_model(f.read())
            own = rules.plain and not rules.inner_marks
        _safe[model] = own
    return _safe[model]


def _encoder(model: str) -> Callable[[list[bytes]], list[int]]:
    """Lengths of texts in tokens. Loaded once by each worker."""
    if model not in _encoders:
        import public_tokenizers

        path = public_tokenizers.path(model)
        if model.endswith(".model"):
            import sentencepiece

            encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
            _encoders[model] = lambda texts: [len(x) for x in encode(texts, num_threads=1)]
        else:
            import tokenizers

            whole = tokenizers.Tokenizer.from_file(path)
            _encoders[model] = lambda texts: [len(x.ids) for x in whole.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    return _encoders[model]


def cut(text: bytes, most: int = CUT_BYTES) -> list[bytes]:
    """Parts whose token counts add up to that of the whole.

    The encoder turns spaces into a mark (U+2581), puts one mark before a text, and no piece of
    the vocabulary has a mark behind another character. So no merge crosses the place between a
    character that is neither space nor mark and a space; that space is the mark which the
    encoder puts before the next part. A text without such a place is left whole.
    """
    parts, start = [], 0
    while len(text) - start > most:
        at = text.find(b" ", start + most)
        while at >= 0 and (text[at - 1 : at] == b" " or text[at - 3 : at] == b"\xe2\x96\x81"):
            at = text.find(b" ", at + 1)
        if at < 0 or at + 1 >= len(text):
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


def counts_of(texts: list[bytes], model: str = MODEL) -> np.ndarray:
    """Tokens of each text; what goes to the encoder at once is balanced by bytes."""
    encode, safe = _encoder(model), safe_to_cut(model)
    total = np.zeros(len(texts), np.int64)
    parts: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        np.add.at(total, owner, encode(parts))
        parts.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        for part in cut(text) if safe else [text]:
            parts.append(part)
            owner.append(i)
            size += len(part)
            if size >= BATCH_BYTES:
                flush()
    if parts:
        flush()
    return total


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``, without a shuffle.

    Counts equal those of the library on the whole text, without begin, end or added tokens;
    a null is the empty text and has none. Very long texts are cut at places that no merge
    crosses (see ``cut``), if the model has such places. Repeated rows are counted each; other
    columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            n = counts_of(texts, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count_tokens`` of all ``documents``, and their bytes a token; see there for nulls and empty texts."""
    return count_tokens(table(spark, sf_dir, "documents")).select("*", (F.col("n_bytes") / F.greatest("n_tokens", F.lit(1))).alias("bytes_per_token"))
