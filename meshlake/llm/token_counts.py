"""Token counts: the tokenizer's own batch encoder in Arrow functions that hand back lengths only.

Texts are cut into parts of bounded size, at places where the tokenizer's own splitting surely has a border: a
blank between two ASCII letters starts a new pre-token, so no token reaches across. The parts are encoded in
batches of equal bytes, however long or short the texts are, and a text's count is the sum over its parts. A text
without such a place stays whole. Null counts as empty; empty texts have no tokens; rows keep their order and
repeated rows their own counts; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.texts import annotate, read, slices

PART_CHARS, ENCODE_BYTES = 32_768, 1 << 20
_BORDER = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_encoders: dict[str, Callable[[list[str]], list[int]]] = {}

FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths of a batch, by the library that the file is for; loaded once in a worker."""
    if path not in _encoders:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _encoders[path] = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _encoders[path]


def parts(text: str, size: int) -> list[str]:
    """text in parts of about size characters, cut before blanks between letters; longer where there's no such blank."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _BORDER.search(text, start + size - 1)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def counts(texts: list[bytes | None], path: str, size: int = PART_CHARS, batch: int = ENCODE_BYTES) -> list[tuple[int, int]]:
    encode = encoder(path)
    cut = size if path.endswith(".json") else 1 << 62  # the cutting rule is that of byte-level BPE
    owner, pieces = [], []
    for k, t in enumerate(texts):
        for p in parts(t.decode(), cut) if t else ():
            owner.append(k)
            pieces.append(p)
    totals = [0] * len(texts)
    size_of = [len(p) if p.isascii() else len(p.encode()) for p in pieces]
    order = sorted(range(len(pieces)), key=size_of.__getitem__)
    for a, b in slices((size_of[i] for i in order), batch) if order else ():
        for i, n in zip(order[a:b], encode([pieces[i] for i in order[a:b]]), strict=True):
            totals[owner[i]] += n
    return [(len(t or b""), n) for t, n in zip(texts, totals, strict=True)]


def token_counts(documents: DataFrame, tokenizer: str, doc_id: str | None = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """doc_id (all columns, if None) and a struct of n_bytes and n_tokens. tokenizer: a path that every worker has."""
    return annotate(documents, text, FIELDS, lambda: lambda texts: counts(texts, tokenizer), None if doc_id is None else [doc_id], "tokens")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found, name = token_counts(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    r = F.col(name)
    return found.select("doc_id", r.n_bytes.alias("n_bytes"), r.n_tokens.alias("n_tokens"), (r.n_tokens > 1024).alias("over_limit"))
