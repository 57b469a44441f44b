"""Token counts of whole texts by rank-synchronous array merging."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .bpe import byte_bpe
from .common import map_batches


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file; any operator here takes another path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text: (id, n_bytes, n_tokens, over_limit), one row per input row.

    Whole texts are counted, in one narrow pass without a shuffle; a null or empty text has 0 bytes and
    0 tokens, a null id stays null, repeated rows are counted each, other columns are left aside, and an
    empty table gives an empty result. The count is the library's: no added special tokens, a special
    string inside a text is one token. Memory follows the batch, not the partition.
    """
    path = path or vocabulary()

    def run(columns):
        ids, texts = columns
        texts = [t or "" for t in texts]
        tokens = byte_bpe(path).count(texts)
        return [ids, [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, run, [id_col, text_col], f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
