"""Sizes in tokens of a public tokenizer, counted over whole texts. The vocabulary file is a parameter and is never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def _encoder(path: str):
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


def token_counts(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The kept columns and n_tokens: 0 for null and empty texts. Equal texts of a batch are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in batches:
            coded = batch.column(len(keep)).dictionary_encode()
            texts = coded.dictionary.to_pylist()
            sizes: list[int] = []
            begin, chars = 0, 0
            for i, t in enumerate(texts):  # a bounded amount of text at a time
                chars += len(t)
                if chars > 1_000_000 or i - begin >= 1000:
                    sizes += count(texts[begin : i + 1])
                    begin, chars = i + 1, 0
            sizes += count(texts[begin:]) if begin < len(texts) else []
            n = pa.array(sizes, pa.int64()).take(coded.indices).fill_null(0) if texts else pa.array([0] * batch.num_rows, pa.int64())
            yield pa.record_batch([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens bigint")
