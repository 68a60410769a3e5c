"""Token counts by a whole-token shortcut.

The model is byte-pair encoding over the text with spaces as U+2581, one of which is put before a non-empty text.
No piece of the vocabulary has another character before a U+2581, so no merge ever crosses from a word into the
space after it, and a character that is in no piece of two or more characters never merges at all.  Both facts are
checked against the vocabulary when it is loaded.  A text therefore falls into pre-tokens whose counts add up:
runs of spaces with the word after them, and the lines between characters that never merge.

Which vocabulary strings encode alone as one token is proved once, offline on the driver, by encoding each of them,
and the list (no longer than the vocabulary) is broadcast; pre-tokens among them count 1 without a merge.  The rest
are encoded, each different one once a batch, and remembered in a bounded table.

Defined results: null text is empty and has 0 tokens; rows with equal ids are counted one by one; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LIMIT = 4096
#: Entries of the table of counts, and the longest pre-token that it keeps.
TABLE_ENTRIES, TABLE_KEY = 400_000, 64
#: Characters that the usual normal forms, case folding or white-space rules would change.
_FOLDED = "Aﬁ①Ａé\u0301ﷺ\t\u00a0\u3000\u200b"
_RUNS = re.compile(r" +[^ ]*")


class Counter:
    """Counts tokens of one model; ``break_char`` is a character that never merges."""

    def __init__(self, path: str, proven: list[str] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        merging = {c for p in self.pieces if len(p) > 1 for c in p}
        self.break_char = "\n"
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces) or self.break_char in merging:
            raise ValueError(f"{path}: words of this vocabulary can't be counted apart")
        if self.model.encode(" a", out_type=str)[0] not in (SPACE * 2, SPACE) or self.model.encode(""):
            raise ValueError(f"{path}: this model does not keep spaces")
        if any(self.model.normalize(" " + c) not in (SPACE * 2 + c, SPACE + c) for c in _FOLDED):
            raise ValueError(f"{path}: this model rewrites characters")
        self.break_tokens = len(self.model.encode(self.break_char)) - 1
        self.proven = self.prove() if proven is None else dict.fromkeys(proven, 1)
        self.table: dict[str, int] = dict(self.proven)

    def prove(self) -> dict[str, int]:
        """The vocabulary strings that encode alone as one token, by their pre-token key."""
        keys = [self._key(p) for p in self.pieces]
        return {k: 1 for k, n in zip(keys, self._merged(keys), strict=True) if n == 1}

    @staticmethod
    def _key(piece: str) -> str:
        """Key of a pre-token: what stands after its first space; without a space it is marked by a line break."""
        return piece[1:].replace(SPACE, " ") if piece.startswith(SPACE) else "\n" + piece

    def _merged(self, keys: list[str]) -> list[int]:
        # a key "\nxyz" is encoded after a space and a break that stand apart; the single space has to be, too
        own = [k if k and k[0] != "\n" else "\n" + (k[1:] or SPACE) for k in keys]
        extra = 1 + self.break_tokens
        return [len(t) - (extra if o[0] == "\n" else 0) for o, t in zip(own, self.model.encode(own, num_threads=1), strict=True)]

    def split(self, text: str) -> tuple[list[str], int]:
        """The keys of a text's pre-tokens, and the tokens of the breaks between its lines."""
        text = text.replace(SPACE, " ")
        if not text:
            return [], 0
        lines = text.split("\n")
        keys: list[str] = []
        for i, line in enumerate(lines):
            if i and line and line[0] != " ":
                head, _, line = line.partition(" ")
                keys.append("\n" + head)
                if not _:
                    continue
            elif i:
                if not line:
                    continue
                line = line[1:]
            # now a space stands before ``line``
            words = line.split(" ")
            if "" in words:
                words = [run[1:] for run in _RUNS.findall(" " + line)]
            keys += words
        return keys, (len(lines) - 1) * self.break_tokens

    def count(self, texts: list[str]) -> list[int]:
        if len(self.table) > TABLE_ENTRIES:
            self.table = dict(self.proven)
        table = self.table
        parts = [self.split(t) for t in texts]
        missing = list({k for keys, _ in parts for k in keys if k not in table})
        table.update(zip(missing, self._merged(missing), strict=True))
        counts = [sum(map(table.__getitem__, keys)) + n for keys, n in parts]
        for k in missing:
            if len(k) > TABLE_KEY:
                del table[k]
        return counts


@cache
def counter(path: str) -> Counter:
    return Counter(path)


_workers: dict[str, Counter] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _counts(name: str, path: str | None, proven, limit: int):
    def run(batches):
        place = path or model_path(name)
        if place not in _workers:
            _workers[place] = Counter(place, proven.value)
        own = _workers[place]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = pa.array(own.count(texts), pa.int64())
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, *, model: str = MODEL, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) without a shuffle; ``path`` names a model file that all executors have."""
    spark = docs.sparkSession
    proven = spark.sparkContext.broadcast(list(counter(path or model_path(model)).proven))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = slim.mapInArrow(_counts(model, path, proven, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    with common.batches_of(spark, 4 << 20, rows=500):
        return common.materialise(counted, "counts")
