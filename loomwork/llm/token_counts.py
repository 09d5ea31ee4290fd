"""Token counts: pieces are counted once per distinct pre-token.

The pre-tokens of all texts are gathered with their frequencies; a merge-based tokenizer never
joins two of them, so a text's tokens are the sum over its pre-tokens of times * pieces. Ids are
never kept. Pre-tokens that are frequent are looked up in a broadcast list of at most
``HOT_KEYS`` short strings; the rest meets the table in a shuffled join.

Defined results: null or empty text has 0 tokens and 0 bytes; special strings inside texts are
single tokens, as the library has it by default; texts of any length are whole; repeated rows
each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.lookup import finish, frequent
from loomwork.llm.words import raw, row_keys, trimmed
from loomwork.session import cut

HOT_KEYS = 1 << 17
HOT_CHARS = 48
#: The splitting pattern of byte-level vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges in which the regex module and the library's own engine agree on every character's class.
AGREED = r"[\x00-՗ -⁤₠-₿℀-⅏←-⇿ぁ-ゖァ-ヺ一-龥가-힣]*"


class Splitter:
    """Pre-tokens of a text as the tokenizer file gives them, and pieces of a pre-token."""

    def __init__(self, path: str):
        import os

        # Threads of the library's own would each keep memory in every worker.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.pattern, self.agreed = regex.compile(PATTERN), regex.compile(AGREED)
        added = self.own.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added) or self.own.normalizer is not None:
            raise ValueError("added tokens that take in their surroundings and normalizers are not handled")
        self.special = regex.compile("|".join(regex.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None

    def split(self, text: str) -> list[str]:
        if self.agreed.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(text)]

    def counts(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens with their times, and the number of special tokens."""
        if self.special is None or not self.special.search(text):
            return Counter(self.split(text)), 0
        out, parts = Counter(), self.special.split(text)
        for x in parts:
            out.update(self.split(x))
        return out, len(parts) - 1

    def pieces(self, pre: list[str]) -> list[int]:
        return [len(e) for e in self.own.encode_batch_fast(pre, add_special_tokens=False)]


@lru_cache(1)
def splitter(path: str) -> Splitter:
    """One for all tasks of a worker; a vocabulary read by every task leaves its memory in pieces."""
    return Splitter(path)


def count_tokens(docs: DataFrame, path: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs`` (doc_id, text)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splitter(path)
        seen: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    seen.update(s.counts(x.as_py())[0])
                if len(seen) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splitter(path)
        for b in batches:
            n = [x for i in range(0, len(b), 1000) for x in s.pieces(b.column(0)[i : i + 1000].to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["pre", "n", "pieces"])

    seen = docs.select("text").mapInArrow(trimmed(gather), "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    table = cut(seen.mapInArrow(trimmed(pieces), "pre string, n long, pieces long"))
    hot = frequent(table.where(F.length("pre") <= HOT_CHARS), "n", hot_keys).select("pre", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(hot["pre"].to_pylist(), hot["pieces"].to_pylist(), strict=True)))
    schema = "row_key long, doc_id long, pre string, times long, n_bytes long, held long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, pieces_of = splitter(path), known.value
        for b in batches:
            ids = b.column(0)
            data, off = raw(b.column(1))
            keys = row_keys(ids, data, off, 0, len(ids))
            out: list[tuple] = []
            for k, x in enumerate(b.column(1)):
                found, held = s.counts(x.as_py() or "")
                key, doc = int(keys[k]), ids[k].as_py()
                for pre, times in found.items():
                    if (n := pieces_of.get(pre)) is None:
                        out.append((key, doc, pre, times, None, None))
                    else:
                        held += n * times
                out.append((key, doc, f"\0{key}", 0, int(off[k + 1] - off[k]), held))
                if len(out) > 20_000:
                    yield arrow(out)
                    out = []
            yield arrow(out)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["row_key", "doc_id", "pre", "times", "n_bytes", "held"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(count), schema)
    out = finish(rows, table.select("pre", "pieces"), "pre", ["n_bytes", "held"], {"rest": F.coalesce("pieces", F.lit(0))})
    return out.select("doc_id", "n_bytes", (F.col("held") + F.col("rest").cast("long")).alias("n_tokens"))


LIMIT = 512


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
